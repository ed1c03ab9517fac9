"""Line dedup by sharded minimal perfect hashes.

Every distinct line key becomes a 128-bit hash. A shard of hashes gets a minimal
perfect hash (a cascade of collision-free bit maps) whose slots index three compact
arrays: a fingerprint, the number of documents and the document that keeps the line.
Documents send the hashes of their lines to the shards and probe those arrays; line
texts are never moved or joined. A shard with many probes is copied for several
tasks, as many as its measured load asks for.

Defined results: a null or empty text is one empty line. Rows that repeat an id are one
document for the counts, and all rows of the largest id keep the line; each row gives a
result of its own. Rows without an id are not counted and lose nothing. An empty table
gives no rows. Texts are taken whole, whatever their length. Columns are picked by name at
the start, so others don't matter, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.llm.common import by_value, chunks, mix, shard_count, table
from corpusloom.session import fits_broadcast, lookup_join, stage

by_value(__name__)

MIN_CHARS = 20  # code points of a key that counts
MIN_DOCS = 3  # documents from which on a line is a duplicate
LOAD = 500_000  # probes of one shard that one task takes

_STRIP = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
_INNER = re.compile(rb"[\x80-\xbf]")


# Hashing ---------------------------------------------------------------------


def line_keys(text: str | None, min_chars: int) -> list[tuple[int, bytes]]:
    """(line number, 16-byte hash) of the lines whose key counts."""
    if not text:
        return []
    out = []
    for number, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        key = line.strip(_STRIP).translate(_UPPER)
        size = len(key)
        if size >= min_chars and (size >= 4 * min_chars or size - len(_INNER.findall(key)) >= min_chars):
            out.append((number, xxhash.xxh3_128_digest(key)))
    return out


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=">u8").reshape(-1, 2).astype(np.uint64)


def _hashed(batches, shards: int, min_chars: int, counted: bool):
    """Hash rows of a chunk. ``counted``: per hash with its documents counted and
    the largest; else one row for each hash of each document."""
    for batch in chunks(batches):
        ids, digests = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if doc is None:
                continue
            own = {d for _, d in line_keys(text, min_chars)}
            digests += own
            ids += [doc] * len(own)
        if not ids:
            continue
        half, ids = _halves(digests), np.array(ids, dtype=np.int64)
        order = np.lexsort((ids, half[:, 1], half[:, 0]))
        half, ids = half[order], ids[order]
        columns = {"n": np.ones(len(ids), dtype=np.int64)}
        if counted:
            first = np.ones(len(ids), dtype=bool)
            first[1:] = (half[1:] != half[:-1]).any(axis=1)
            starts = np.flatnonzero(first)
            ends = np.concatenate((starts[1:], [len(ids)]))
            columns["n"], ids, half = ends - starts, ids[ends - 1], half[starts]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array((half[:, 0] % np.uint64(shards)).astype(np.int32)),
                pa.array(half[:, 0].view(np.int64)),
                pa.array(half[:, 1].view(np.int64)),
                pa.array(ids),
                pa.array(columns["n"]),
            ],
            names=["shard", "h1", "h2", "doc", "n"],
        )


_HASHES = "shard int, h1 bigint, h2 bigint, doc bigint, n bigint"


# Minimal perfect hash --------------------------------------------------------


def _slot(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h1 + mix(h2 + np.uint64(level))) % np.uint64(size)).astype(np.int64)


def build_mph(h1: np.ndarray, h2: np.ndarray, gamma: float = 1.5) -> list[np.ndarray]:
    """Bit maps of a cascade: each level marks the slots that exactly one of the
    remaining keys falls into. Keys must be distinct."""
    levels = []
    while len(h1):
        slot = _slot(h1, h2, len(levels), size := max(8, int(gamma * len(h1))))
        hits = np.bincount(slot, minlength=size)
        levels.append(hits == 1)
        rest = hits[slot] > 1
        h1, h2 = h1[rest], h2[rest]
    return levels


def mph_index(levels: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Index of each key, 0 to n-1; -1 for one that falls through all levels."""
    out = np.full(len(h1), -1, dtype=np.int64)
    rest, base = np.arange(len(h1)), 0
    for level, bits in enumerate(levels):
        slot = _slot(h1[rest], h2[rest], level, len(bits))
        found = bits[slot]
        out[rest[found]] = base + (np.cumsum(bits) - 1)[slot[found]]
        base += int(bits.sum())
        rest = rest[~found]
    return out


def _pack(levels: list[np.ndarray]) -> tuple[bytes, list[int]]:
    return b"".join(np.packbits(x).tobytes() for x in levels), [len(x) for x in levels]


def _unpack(data: bytes, sizes: list[int]) -> list[np.ndarray]:
    out, at = [], 0
    for size in sizes:
        n = (size + 7) // 8
        out.append(np.unpackbits(np.frombuffer(data, np.uint8, n, at), count=size).astype(bool))
        at += n
    return out


def _build(rows: pa.Table) -> pa.Table:
    h1, h2, doc, n = (rows.column(c).to_numpy() for c in ("h1", "h2", "doc", "n"))
    h1, h2 = h1.view(np.uint64), h2.view(np.uint64)
    order = np.lexsort((h2, h1))
    h1, h2, doc, n = h1[order], h2[order], doc[order], n[order]
    new = np.ones(len(h1), dtype=bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    starts = np.flatnonzero(new)
    h1, h2 = h1[starts], h2[starts]
    docs, keeper = np.add.reduceat(n, starts), np.maximum.reduceat(doc, starts)
    levels = build_mph(h1, h2)
    at = mph_index(levels, h1, h2)
    arrays = [np.empty(len(h1), t) for t in (np.uint32, np.uint32, np.int64)]
    arrays[0][at] = (h2 >> np.uint64(32)).astype(np.uint32)
    arrays[1][at] = np.minimum(docs, 2**32 - 1)
    arrays[2][at] = keeper
    bits, sizes = _pack(levels)
    return pa.table(
        {
            "shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()),
            "n_keys": pa.array([len(h1)], pa.int64()),
            "load": pa.array([int(n[n > 0].sum())], pa.int64()),
            "sizes": pa.array([sizes], pa.list_(pa.int64())),
            "bits": pa.array([bits], pa.binary()),
            **{name: pa.array([a.tobytes()], pa.binary()) for name, a in zip(("fingerprint", "docs", "keeper"), arrays)},
        }
    )


_INDEX = (
    "shard int, n_keys bigint, load bigint, sizes array<bigint>, bits binary, "
    "fingerprint binary, docs binary, keeper binary"
)


def line_index(documents: DataFrame, shards: int, min_chars: int = MIN_CHARS) -> DataFrame:
    """Written table with one row per shard: its minimal perfect hash and arrays."""
    hashed = documents.select("doc_id", "text").mapInArrow(
        lambda batches: _hashed(batches, shards, min_chars, True), _HASHES
    )
    # Ids of several rows are counted per row above; what is too much is taken off.
    repeated = stage(documents.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if repeated.take(1):
        rows = lookup_join(documents.select("doc_id", "text"), repeated, ["doc_id"], "left_semi")
        single = rows.mapInArrow(lambda batches: _hashed(batches, shards, min_chars, False), _HASHES)
        again = single.groupBy("shard", "h1", "h2", "doc").agg((F.lit(1) - F.sum("n")).alias("n"))
        hashed = hashed.unionByName(again.filter("n < 0"))
    # Lines are counted inside each chunk first, so a hot line comes once per chunk.
    return stage(hashed.groupBy("shard").applyInArrow(_build, _INDEX))


def _probe(min_docs: int):
    def run(key, rows: pa.Table, index: pa.Table) -> pa.Table:
        if not rows.num_rows or not index.num_rows:
            return pa.table({"doc": pa.array([], pa.int64()), "h1": pa.array([], pa.int64()), "h2": pa.array([], pa.int64())})
        entry = index.slice(0, 1).to_pylist()[0]
        h1, h2 = (rows.column(c).to_numpy() for c in ("h1", "h2"))
        at = mph_index(_unpack(entry["bits"], entry["sizes"]), h1.view(np.uint64), h2.view(np.uint64))
        doc = rows.column("doc").to_numpy()
        known = np.frombuffer(entry["fingerprint"], np.uint32)[at] == (h2.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
        drop = (
            (at >= 0) & known
            & (np.frombuffer(entry["docs"], np.uint32)[at] >= min_docs)
            & (np.frombuffer(entry["keeper"], np.int64)[at] != doc)
        )
        return pa.table({"doc": doc[drop], "h1": h1[drop], "h2": h2[drop]})

    return run


def duplicate_lines(
    documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int | None = None, load: int = LOAD
) -> DataFrame:
    """(doc, h1, h2): hashes of the lines that each document has to drop."""
    shards = shards or shard_count(documents)
    index = line_index(documents, shards, min_chars)
    copies = F.ceil(F.col("load") / load).cast("int").alias("copies")
    loads = index.select("shard", copies)
    rows = (
        documents.select("doc_id", "text")
        .mapInArrow(lambda batches: _hashed(batches, shards, min_chars, False), _HASHES)
        .drop("n")
    )
    # One small row per shard: who takes which copy of a hot shard.
    loads = loads.filter("copies > 1")
    rows = rows.join(F.broadcast(loads) if fits_broadcast(loads) else loads, "shard", "left")
    rows = rows.withColumn("copy", F.coalesce(F.pmod(F.xxhash64("doc"), F.col("copies")).cast("int"), F.lit(0))).drop("copies")
    copied = index.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    return (
        rows.groupBy("shard", "copy")
        .cogroup(copied.groupBy("shard", "copy"))
        .applyInArrow(_probe(min_docs), "doc bigint, h1 bigint, h2 bigint")
    )


# Rewriting -------------------------------------------------------------------


def _rewritten(batches, min_chars: int):
    for batch in chunks(batches):
        kept, total, dropped = [], [], []
        for text, drops in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            lines = (text or "").split("\n")
            total.append(len(lines))
            if drops:
                gone = {d["h1"].to_bytes(8, "big", signed=True) + d["h2"].to_bytes(8, "big", signed=True) for d in drops}
                out = {number for number, digest in line_keys(text, min_chars) if digest in gone}
                lines = [x for number, x in enumerate(lines) if number not in out]
            dropped.append(total[-1] - len(lines))
            kept.append("\n".join(lines))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())],
            names=["row", "kept", "n_lines", "n_dropped"],
        )


def dedup_rows(
    documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int | None = None, load: int = LOAD
) -> DataFrame:
    """(row, kept, n_lines, n_dropped): each row's columns but its text, and its text
    without the duplicate lines.

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents
    loses all its lines except in the largest id that holds it. ``kept`` is null for
    no row; ``n_lines`` counts before dropping.
    """
    rest = F.struct(*[F.col(c) for c in documents.columns if c != "text"]).alias("row")
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    drops = (
        duplicate_lines(rows, min_chars, min_docs, shards, load)
        .groupBy("doc")
        .agg(F.collect_list(F.struct("h1", "h2")).alias("drops"))
    )
    keyed = documents.select(rest, "text", F.col("doc_id").cast("bigint").alias("doc"))
    # Rows without an id find nothing; a second key deals them out to all tasks.
    spread = F.when(F.col("doc").isNull(), F.xxhash64("text", "row")).otherwise(0)
    joined = keyed.withColumn("spread", spread).join(
        drops.withColumn("spread", F.lit(0).cast("bigint")), ["doc", "spread"], "left"
    ).select("row", "text", "drops")
    schema = (
        StructType().add("row", joined.schema["row"].dataType).add("kept", "string")
        .add("n_lines", "long").add("n_dropped", "long")
    )
    return joined.mapInArrow(lambda batches: _rewritten(batches, min_chars), schema)


def dedup_lines(documents: DataFrame, **settings) -> DataFrame:
    """(doc_id, kept, n_lines, n_dropped); settings as for ``dedup_rows``."""
    done = dedup_rows(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), **settings)
    return done.select("row.doc_id", "kept", "n_lines", "n_dropped")


def op1_linededup(spark, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, i, lines[i] AS line,
         translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), d AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT l.doc_id, l.i, l.line, d.keeper IS NOT NULL AND l.doc_id <> d.keeper AS gone
  FROM l LEFT JOIN d ON l.k = d.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
