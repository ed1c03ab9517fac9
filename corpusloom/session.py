"""Session-level helpers: staging, checked broadcasts and ordered numbering."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache, wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A side is broadcast only if it was measured to be no larger than this.
BROADCAST_BYTES = 64 * 1024 * 1024
# Copies of a larger lookup side, so that one hot key is spread over many tasks; a
# session with more shuffle partitions gets more of them.
SALTS = 16
# Groups counted to be no larger are ordered by a plain window.
WINDOW_ROWS = 500_000


def built_once(make: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the columns that ``make`` builds. A large expression takes thousands
    of calls into the JVM to put together, and a column never changes."""
    made: dict[tuple, Column] = {}

    @wraps(make)
    def get(*args) -> Column:
        key = (id(SparkContext._gateway), *args)
        if key not in made:
            made[key] = make(*args)
        return made[key]

    return get


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="corpusloom-")


def is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def staging_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or what
    ``setCheckpointDir`` was given. Only a local session may do without one: on a
    cluster every executor would write to its own disk and rows would be lost."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not is_local(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = _own_folder()
    return shared.rstrip("/")


# Innermost last: paths of the tables staged inside ``staged_paths`` blocks.
_collecting: list[list[str]] = []


@contextmanager
def staged_paths() -> Iterator[list[str]]:
    """Collect the paths of the tables that are staged inside the block."""
    paths: list[str] = []
    _collecting.append(paths)
    try:
        yield paths
    finally:
        _collecting.remove(paths)


def remove_staged(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables, wherever they are; frames that read them end here."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    paths.clear()


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    The rows are fixed from then on, also if an executor is lost later.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/stage-{uuid.uuid4().hex}"
    for paths in _collecting:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Measure ``df``: string bytes plus 16 for every column of every row."""
    width = F.lit(16 * len(df.columns)).cast("bigint")
    for field in df.schema.fields:
        if field.dataType.typeName() in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(F.col(field.name)), F.lit(0))
    return (df.agg(F.sum(width)).first()[0] or 0) <= limit


def lookup_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "left",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join a large side to a lookup side with unique keys, without a hot task.

    A lookup side measured to be small is broadcast. Otherwise every lookup row
    is copied per salt and the large side picks one salt per row.
    """
    if fits_broadcast(right, limit):
        return left.join(F.broadcast(right), on, how)
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(SALTS, partitions // 16)
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    salted = left.withColumn("_salt", salt)
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def one_by_one(array: Column) -> Column:
    """``explode(array)`` whose rows go on as they are made. Generated code holds all rows that
    come from one row of its input, those of several explodes multiplied, until the last is
    made. There is none for a lambda: rows are made then when they are asked for."""
    return F.explode(F.transform(array, lambda x: x))


def check_often(spark: SparkSession) -> None:
    """Have Parquet writers of this session look at what they hold after every row. They do so
    after 100 rows at the soonest otherwise, which are some hundred MB if a row is a tree; how
    soon they look again they tell from the rows so far. What the caller has set stays."""
    for kind in ("page", "block"):
        name = f"parquet.{kind}.size.row.check.min"
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, "1")


def filter_made(df: DataFrame, condition: Column) -> DataFrame:
    """``df.filter(condition)`` behind the work on the columns of ``df``. A plain filter is moved
    below it and does the work on a column anew for each time that ``condition`` names it;
    below a column that depends on the task it is not moved."""
    made = df.withColumn("_task", F.spark_partition_id())
    return made.filter(condition & (F.col("_task") >= 0)).drop("_task")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out by ``keys`` to as many tasks as there are cores at least."""
    spark = df.sparkSession
    tasks = max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    return df.repartition(tasks, *keys)


def number_in_order(
    df: DataFrame, group: str, key: str, name: str = "ord", window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """Add the 1-based position of each row by ``key`` within its ``group``.

    If no group was counted to have more than ``window_rows`` rows, a window per
    group does it. Otherwise rows are cut into ranges of (group, key), so a hot
    group is spread over many tasks. Each range can only continue one group from
    an earlier range, so the table of offsets has no more rows than there are
    ranges. The input is staged then, as finding the ranges reads it once more.
    """
    largest = df.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    if largest <= window_rows:
        whole = Window.partitionBy(group).orderBy(key)
        return df.withColumn(name, F.row_number().over(whole).cast("bigint"))
    staged = stage(
        stage(df).repartitionByRange(F.col(group), F.col(key)).withColumn(
            "_range", F.spark_partition_id()
        )
    )
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        staged.groupBy(group, "_range")
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.sum("_n").over(before))
        .filter("_offset > 0")
        .select(group, "_range", "_offset")
    )
    inside = Window.partitionBy("_range", group).orderBy(key)
    return (
        staged.withColumn("_row", F.row_number().over(inside))
        .join(F.broadcast(offsets), [group, "_range"], "left")
        .withColumn(name, F.col("_row") + F.coalesce("_offset", F.lit(0).cast("bigint")))
        .drop("_row", "_range", "_offset")
    )


def swept(
    df: DataFrame, groups: list[str], order: list[str], values: list[str], how: str = "sum",
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Add ``<value>_upto`` for each of ``values``: their sum over the rows of the group up
    to this one in ``order``, or with ``how='last'`` the last one that is not null.

    Like ``number_in_order``, a group counted to have more than ``window_rows`` rows is cut
    into ranges of (group, order). A range continues at most one group from the ranges before
    it, so what is carried into ranges has no more rows than there are ranges and is broadcast.
    """
    def over(window, value: str) -> Column:
        return (F.sum(value) if how == "sum" else F.last(value, ignorenulls=True)).over(window)

    upto = (Window.unboundedPreceding, Window.currentRow)
    largest = df.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0
    if largest <= window_rows:
        whole = Window.partitionBy(*groups).orderBy(*order).rowsBetween(*upto)
        return df.withColumns({f"{v}_upto": over(whole, v) for v in values})
    staged = stage(
        stage(df).repartitionByRange(*groups, *order).withColumn("_range", F.spark_partition_id())
    )

    def of_range(value: str) -> Column:
        if how == "sum":
            return F.sum(value)
        return F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))

    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        staged.groupBy(*groups, "_range")
        .agg(*[of_range(v).alias(v) for v in values])
        .withColumn("_first", F.row_number().over(Window.partitionBy(*groups).orderBy("_range")))
        .withColumns({f"_{v}_carried": over(earlier, v) for v in values})
        .filter("_first > 1")
        .select(*groups, "_range", *[f"_{v}_carried" for v in values])
    )
    inside = Window.partitionBy("_range", *groups).orderBy(*order).rowsBetween(*upto)
    met = staged.withColumns({f"{v}_upto": over(inside, v) for v in values}).join(
        F.broadcast(carried), [*groups, "_range"], "left"
    )

    def joined(value: str) -> Column:
        own, before = F.col(f"{value}_upto"), F.col(f"_{value}_carried")
        if how == "last":
            return F.coalesce(own, before)
        return F.coalesce(own + before, own, before)

    met = met.withColumns({f"{v}_upto": joined(v) for v in values})
    return met.drop("_range", *[f"_{v}_carried" for v in values])
