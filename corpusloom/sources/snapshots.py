"""Versioned snapshots of files: a commit writes the buckets that its blocks touch.

Files lie in buckets by the hash of (repo, path), each a folder of its own. A version is a
manifest, a small table that names the folder of every bucket. A commit reads and rewrites
the touched buckets only, writes a new manifest and then renames a pointer file to the next
version number. Until that rename readers see the old version whole; a job that is killed
before it leaves folders that nothing names. A commit that finds its number taken fails
and can be run again. Where a rename replaces what is there (local folders, some object
stores) commits have to come one at a time; HDFS refuses it.

The driver holds the manifest, one row per bucket. Choose so many buckets that one fits a
task; a snapshot keeps its number of buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.unpacking import apply_blocks
from corpusloom.session import stage

BUCKETS = 1024
_FILES = "repo string, path string, content string"


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("repo", "path"), F.lit(buckets)).cast("int")


class _Folder:
    """The store of a snapshot, seen through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def versions(self) -> list[int]:
        folder = self._path("versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest_of(self, version: int) -> str:
        stream = self._fs.open(self._path(f"versions/{version:012d}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, version: int, manifest: str) -> None:
        """Give ``manifest`` the number ``version``, if nobody else has taken it."""
        self._fs.mkdirs(self._path("versions"))
        draft, final = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(f"versions/{version:012d}")
        stream = self._fs.create(draft)
        stream.write(bytearray(manifest.encode()))
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"version {version} of {self.root} was written by another commit")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


def latest_version(spark: SparkSession, root: str) -> int:
    """Number of the last version; 0 if there is none."""
    return max(_Folder(spark, root).versions(), default=0)


def _manifest(spark: SparkSession, root: str, version: int) -> tuple[int, dict[int, str]]:
    """Number of buckets and the folder of each one that has files."""
    name = _Folder(spark, root).manifest_of(version)
    rows = spark.read.parquet(f"{root.rstrip('/')}/{name}").collect()
    return rows[0]["buckets"], {r["bucket"]: r["folder"] for r in rows if r["folder"]}


def _read_buckets(spark: SparkSession, root: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], _FILES)
    return spark.read.schema(_FILES).parquet(*[f"{root.rstrip('/')}/{f}" for f in sorted(folders)])


def _write_buckets(files: DataFrame, root: str, buckets: int, tasks: int) -> dict[int, str]:
    """Write ``files`` bucket by bucket to a new folder, by so many tasks: the folder of each."""
    spark = files.sparkSession
    folder = f"data/{uuid.uuid4().hex}"
    content = F.col("content").cast("string").alias("content")
    numbered = files.select("repo", "path", content, bucket_of(buckets).alias("bucket"))
    # All rows of a bucket go through one task, which writes it as one file.
    numbered.repartition(tasks, "bucket").write.partitionBy("bucket").parquet(f"{root}/{folder}")
    written = spark.read.schema(f"{_FILES}, bucket int").parquet(f"{root}/{folder}")
    return {r["bucket"]: f"{folder}/bucket={r['bucket']}" for r in written.select("bucket").distinct().collect()}


def _publish(spark: SparkSession, root: str, version: int, buckets: int, folders: dict[int, str]) -> int:
    rows = [(buckets, b, f) for b, f in sorted(folders.items())] or [(buckets, 0, None)]
    name = f"manifests/{uuid.uuid4().hex}"
    manifest = spark.createDataFrame(rows, "buckets int, bucket int, folder string")
    manifest.coalesce(1).write.parquet(f"{root}/{name}")
    _Folder(spark, root).publish(version, name)
    return version


def create_snapshot(files: DataFrame, root: str, buckets: int = BUCKETS) -> int:
    """Version 1 of a snapshot of ``files`` (repo, path, content) in the new folder ``root``."""
    root = root.rstrip("/")
    return _publish(files.sparkSession, root, 1, buckets, _write_buckets(files, root, buckets, buckets))


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(repo, path, content) of a version, the last one by default."""
    _, folders = _manifest(spark, root, version or latest_version(spark, root))
    return _read_buckets(spark, root, list(folders.values()))


def commit_blocks(spark: SparkSession, root: str, blocks: DataFrame) -> int:
    """Write blocks (repo, clean_path, content; one per path) over the last version: the
    number of the new one. Buckets without a block are neither read nor written."""
    root = root.rstrip("/")
    before = latest_version(spark, root)
    buckets, folders = _manifest(spark, root, before)
    new = stage(blocks.select("repo", "clean_path", "content"))
    at = new.select("repo", F.col("clean_path").alias("path")).select(bucket_of(buckets).alias("bucket"))
    touched = [r["bucket"] for r in at.distinct().collect()]
    if not touched:
        return before
    old = _read_buckets(spark, root, [folders[b] for b in touched if b in folders])
    written = _write_buckets(apply_blocks(old, new, written=True), root, buckets, len(touched))
    return _publish(spark, root, before + 1, buckets, folders | written)


def drop_versions(spark: SparkSession, root: str, keep: int = 1) -> list[int]:
    """Delete all but the last ``keep`` versions and the buckets that only they name: the
    numbers of those deleted. Folders that no version names are left, as they may belong to a
    commit that is under way."""
    store = _Folder(spark, root)
    versions = store.versions()
    dropped = versions[: -max(keep, 1)]

    def named(numbers: list[int]) -> set[str]:
        folders = {f for n in numbers for f in _manifest(spark, root, n)[1].values()}
        return folders | {store.manifest_of(n) for n in numbers}

    gone = named(dropped) - named(versions[len(dropped) :])
    # Pointers first: a version that can be opened is whole.
    for name in [*(f"versions/{n:012d}" for n in dropped), *sorted(gone)]:
        store.delete(name)
    return dropped
