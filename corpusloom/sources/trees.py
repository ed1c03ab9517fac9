"""Scan directory trees into rows, and read and write the other tables.

Spark's file sources leave out names that begin with '.' or '_' and empty files,
but ``.gitignore`` and ``.env`` matter here. So directories are listed by tasks,
a bounded number of them from each place at a time, and files are read by tasks as
well. Nothing passes through the driver.
"""

from __future__ import annotations

import os
import re
import stat
import sys
from collections import deque
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.constants import BINARY_EXTENSIONS
from corpusloom.functions.globs import hidden_in_python
from corpusloom.functions.paths import extension
from corpusloom.session import is_local, stage

# The functions below go to the executors by value; no package has to be there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ENTRY = "repo string, root string, path string, is_dir boolean, size bigint"
_FILE = "repo string, path string, size bigint, content binary"
_BATCH_ROWS = 5_000
_BATCH_BYTES = 32 * 1024 * 1024


LISTED_AT_ONCE = 64  # directories that a task lists from one place before it hands on the rest
HEAD_BYTES = 512  # a file with a NUL byte here is a binary and not read further


class _Stores:
    """File-system clients of one task, one per scheme and host. A root without a scheme
    is a folder of this machine, which only suits a local session."""

    def __init__(self, local: bool):
        self.local, self.clients = local, {}

    def at(self, path: str):
        """(client, path for it); no client for a folder of this machine."""
        if "://" not in path:
            if not self.local:
                raise ValueError(f"name the file system of {path!r}, such as file:///, hdfs:// or s3://")
            return None, path
        from pyarrow import fs

        scheme, rest = path.split("://", 1)
        host, _, below = rest.partition("/")
        if (scheme, host) not in self.clients:
            # Stores of buckets take the bucket as part of the path, the others don't.
            self.clients[scheme, host] = fs.FileSystem.from_uri(f"{scheme}://{host}/")
        client, top = self.clients[scheme, host]
        return client, f"/{below}" if top in ("", "/") else rest


def _local_entries(folder: str) -> Iterator[tuple[str, bool, int]]:
    with os.scandir(folder) as entries:
        for entry in entries:
            size = entry.stat(follow_symlinks=False).st_size
            if entry.is_dir(follow_symlinks=False):
                yield entry.name, True, 0
            # A link is a file of its own; links to directories are not followed.
            elif os.path.exists(entry.path) and stat.S_ISREG(os.stat(entry.path).st_mode):
                yield entry.name, False, size


def _remote_entries(store, folder: str) -> Iterator[tuple[str, bool, int]]:
    from pyarrow import fs

    for info in store.get_file_info(fs.FileSelector(folder)):
        is_dir = info.type == fs.FileType.Directory
        yield info.base_name, is_dir, 0 if is_dir else info.size


def _list(batches: Iterator[pd.DataFrame], local: bool, hidden: str | None, budget: int) -> Iterator[pd.DataFrame]:
    """Files below each directory, as far as ``budget`` directories go, nearest first;
    directories still to be entered come as rows of their own."""
    columns = ["repo", "root", "path", "is_dir", "size"]
    rows, stores = [], _Stores(local)
    skipped = re.compile(hidden).search if hidden else lambda path: None
    for batch in batches:
        for repo, root, top in zip(batch["repo"], batch["root"], batch["path"]):
            waiting = deque([top])
            for _ in range(budget):
                if not waiting:
                    break
                path = waiting.popleft()
                store, folder = stores.at(f"{root}/{path}" if path else root)
                for name, is_dir, size in _remote_entries(store, folder) if store else _local_entries(folder):
                    below = f"{path}/{name}" if path else name
                    if not is_dir:
                        rows.append((repo, root, below, False, size))
                    elif not skipped(below):
                        waiting.append(below)
                    if len(rows) >= _BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            rows += [(repo, root, path, True, 0) for path in waiting]
    yield pd.DataFrame(rows, columns=columns)


def _read_one(stores: _Stores, path: str, whole: bool) -> bytes:
    store, name = stores.at(path)
    with store.open_input_stream(name) if store else open(name, "rb") as stream:
        head = stream.read(HEAD_BYTES)
        return head if not whole and b"\0" in head else head + stream.read()


def _read(batches: Iterator[pd.DataFrame], local: bool, whole: bool) -> Iterator[pd.DataFrame]:
    columns = ["repo", "path", "size", "content"]
    rows, held, stores = [], 0, _Stores(local)
    for batch in batches:
        for repo, root, path, size, wanted in zip(
            batch["repo"], batch["root"], batch["path"], batch["size"], batch["wanted"]
        ):
            content = _read_one(stores, f"{root}/{path}", whole) if wanted else None
            rows.append((repo, path, size, content))
            held += len(content or b"")
            if held >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                yield pd.DataFrame(rows, columns=columns)
                rows, held = [], 0
    yield pd.DataFrame(rows, columns=columns)


def list_trees(
    roots: DataFrame, globs: Sequence[str] = (), everything: bool = False, budget: int = LISTED_AT_ONCE
) -> DataFrame:
    """Files below every root, from ``roots`` (repo, root): repo, root, path,
    is_dir, size. Ignored directories are not entered, unless ``everything`` is asked
    for. A job lists up to ``budget`` directories from every place that was left open by the
    job before, so a wide tree is soon dealt out to all tasks and a deep one takes a
    ``budget``-th of its depth in jobs."""
    tasks = roots.sparkSession.sparkContext.defaultParallelism
    hidden = None if everything else hidden_in_python(list(globs))
    local = is_local(roots.sparkSession.sparkContext.master)
    frontier = roots.select("repo", F.rtrim("root", F.lit("/")).alias("root"), F.lit("").alias("path"))
    rounds = []
    while True:
        listed = stage(
            frontier.repartition(tasks * 4, "repo", "path").mapInPandas(lambda b: _list(b, local, hidden, budget), _ENTRY)
        )
        rounds.append(listed.filter(~F.col("is_dir")))
        frontier = listed.filter("is_dir").select("repo", "root", "path")
        if frontier.isEmpty():
            break
    return reduce(DataFrame.unionByName, rounds)


def _contents(listed: DataFrame, whole: bool) -> DataFrame:
    spark = listed.sparkSession
    local = is_local(spark.sparkContext.master)
    # Spread by path: neighbours in a directory may be far larger than others.
    return listed.repartition(spark.sparkContext.defaultParallelism * 4, "repo", "path").mapInPandas(
        lambda batches: _read(batches, local, whole), _FILE
    )


def scan_trees(roots: DataFrame, globs: Sequence[str] = ()) -> DataFrame:
    """Files as (repo, path, size, content binary). Files with a binary extension
    are listed but not opened; their content is null. Of a file with a NUL byte among
    its first 512 bytes the content is these, which marks it as a binary."""
    wanted = ~extension(F.col("path")).isin(BINARY_EXTENSIONS)
    return _contents(list_trees(roots, globs).withColumn("wanted", wanted), whole=False)


def as_text(files: DataFrame) -> DataFrame:
    """Binary content as string with the same bytes, and ``valid_utf8``. Invalid
    bytes are replaced by functions that look at characters."""
    return files.withColumns(
        {
            "valid_utf8": F.is_valid_utf8(F.col("content").cast("string")),
            "content": F.coalesce(F.col("content").cast("string"), F.lit("")),
        }
    )


def read_responses(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """Response files as (repo, resp_id, body), one row per file, hidden and nested ones
    too. ``resp_id`` is the path below ``path``."""
    roots = spark.createDataFrame([(repo, path)], "repo string, root string")
    listed = list_trees(roots, everything=True).withColumn("wanted", F.lit(True))
    return _contents(listed, whole=True).select(
        "repo", F.col("path").alias("resp_id"), F.col("content").cast("string").alias("body")
    )


def write_parts(parts: DataFrame, path: str) -> None:
    """Part rows in files by range of (repo, part); ``path`` must not exist yet. Rows
    of ``named_parts`` carry their output name and marker with them."""
    parts.repartitionByRange("repo", "part").write.parquet(path)


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """A new snapshot of the files. It goes to a path of its own, so a failed job
    leaves the old snapshot whole."""
    snapshot.drop("change").write.parquet(path)
