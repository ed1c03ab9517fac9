"""N-gram Jaccard join by T-occurrence search.

A document is the set of its distinct 5-word shingles; two sets link at a Jaccard
similarity of 0.75 or more. Documents with the same set are one class from the start.

Candidates. Sets x and y can only link if they share one of the first
a = |x| - ceil(0.75 |x|) + 1 shingles of x in any order that is the same for all sets.
The order used is: shingles with a hash in the low part of the hash range first, by
number of documents, then by hash. So every document sends out its low shingles (or its
first a, if those are more), they are counted by shard, and only the shared ones come
back. A set with a or more low shingles of its own can have no link and is done; this
is nearly every set. For the others the remaining shared shingles of the first a make
edges to the smallest set with the same shingle. Connected sets form a block; no
link leaves its block.

Search. Inside a block each set asks an inverted index for the sets that hold enough
of its shingles, by DivideSkip: the longest lists are set aside, the short ones are merged
and counted, and what reaches the lower threshold is looked up in the long ones by
binary search. Sets found leave the index, so a group of copies is walked once and
not once per pair. A block of more than ``block_sets`` sets or ``block_shingles`` shingles is
cut into chunks: first each chunk is
searched together with a common pivot set, then the sets that have not met the pivot's
component are searched in every chunk. That is the same result in bounded memory.

Defined results: a null or empty text, or one without words, has 0 shingles and links
with nothing. Each row is a document; rows without an id count as no document. Rows that
repeat an id are one node of the graph with the links of all its rows. An empty table gives
no rows. Texts are taken whole, whatever their length. Columns are picked by name at the
start, so others don't matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import (
    by_value, chunks, distinct_by_row, shard_count, shingles, table, text_bytes, words,
)
from corpusloom.session import fits_broadcast, lookup_join, stage

by_value(__name__)

WIDTH = 5
PERCENT = 75  # least similarity
LOW = 0.40  # part of the hash range whose shingles are counted
LOAD = 2_000_000  # postings of one shard that one task takes
BLOCK_SETS = 20_000  # sets that one task searches
BLOCK_SHINGLES = 8_000_000  # shingles of the sets that one task searches
SKIP_FACTOR = 0.01  # the constant of DivideSkip's rule for long lists


def document_sets(batch: pa.RecordBatch, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes of all rows and the row offsets."""
    data, offsets = text_bytes(batch.column(1))
    word, _, per_row = words(data, offsets)
    return distinct_by_row(*shingles(word, per_row, width), batch.num_rows)


def _digests(value: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """Name of each set: a 128-bit hash of its sorted shingles."""
    return [xxhash.xxh3_128_digest(value[a:b].tobytes()) if b > a else None for a, b in zip(at[:-1], at[1:])]


def _least(n: np.ndarray | int, percent: int):
    """Fewest shingles that a set of ``n`` shares with any set it links with."""
    return -(-n * percent // 100)


# Candidate postings ----------------------------------------------------------


def _described(batches, width: int):
    for batch in chunks(batches):
        value, at = document_sets(batch, width)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(at)), pa.array(_digests(value, at), pa.binary())],
            names=["doc_id", "n", "set"],
        )


def _postings(batches, shards: int, width: int, percent: int, low: float, counted: bool):
    """Per chunk and shard: the low shingles, either with their number of documents or
    with the sets they are from."""
    top = np.uint64(int(low * 2**64))
    for batch in chunks(batches):
        value, at = document_sets(batch, width)
        size = np.diff(at)
        if not len(value):
            continue
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(value)) - at[row]
        need = size - _least(size, percent) + 1
        sent = (value < top) | (place < need[row])
        whole, value, row = value, value[sent], row[sent]
        count = np.bincount(row, minlength=len(size))
        if not counted:
            # Equal sets inside the chunk send once.
            digests = _digests(whole, at)
            first: dict[bytes | None, int] = {}
            for i, d in enumerate(digests):
                first.setdefault(d, i)
            own = np.array([first[d] == i and count[i] > 0 for i, d in enumerate(digests)])
            keep = own[row]
            value, row = value[keep], row[keep]
        order = np.argsort(value, kind="stable")
        value, row = value[order], row[order]
        shard = (value % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        value, row, shard = value[order], row[order], shard[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]))
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if counted:
                v, n = np.unique(value[a:b], return_counts=True)
                rows.append((int(shard[a]), v.tobytes(), n.astype(np.uint32).tobytes()))
            else:
                owners, ref = np.unique(row[a:b], return_inverse=True)
                rows.append(
                    (
                        int(shard[a]), value[a:b].tobytes(), ref.astype(np.uint16 if len(owners) < 65536 else np.uint32).tobytes(),
                        b"".join(digests[i] for i in owners), size[owners].astype(np.uint32).tobytes(),
                        count[owners].astype(np.uint32).tobytes(),
                    )
                )
        names = ["shard", "keys", "counts"] if counted else ["shard", "keys", "refs", "sets", "sizes", "sents"]
        kinds = [pa.int32()] + [pa.binary()] * (len(names) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _count(rows: pa.Table) -> pa.Table:
    keys, counts = _joined(rows.column("keys"), np.uint64), _joined(rows.column("counts"), np.uint32).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    total = np.add.reduceat(counts, starts)
    shared = total > 1
    return pa.table(
        {
            "shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()),
            "load": pa.array([int(total.sum())], pa.int64()),
            "shared": pa.array([keys[starts][shared].tobytes()], pa.binary()),
            "docs": pa.array([np.minimum(total[shared], 2**32 - 1).astype(np.uint32).tobytes()], pa.binary()),
        }
    )


_SHARED = "set binary, n int, sent int, docs bigint, h bigint"


def _probe(key, rows: pa.Table, index: pa.Table) -> pa.Table:
    """Postings of shared shingles, once for each set and shingle."""
    out = {"set": [], "n": [], "sent": [], "docs": [], "h": []}
    if rows.num_rows and index.num_rows:
        shared = np.frombuffer(index.column("shared")[0].as_py(), np.uint64)
        docs = np.frombuffer(index.column("docs")[0].as_py(), np.uint32)
        for row in rows.to_pylist() if len(shared) else []:
            keys = np.frombuffer(row["keys"], np.uint64)
            refs = np.frombuffer(row["refs"], np.uint16 if len(row["refs"]) == 2 * len(keys) else np.uint32)
            at = np.minimum(np.searchsorted(shared, keys), len(shared) - 1)
            hit = shared[at] == keys
            if not hit.any():
                continue
            refs = refs[hit].astype(np.int64)
            out["set"].append(np.frombuffer(row["sets"], "V16")[refs])
            out["n"].append(np.frombuffer(row["sizes"], np.uint32)[refs])
            out["sent"].append(np.frombuffer(row["sents"], np.uint32)[refs])
            out["docs"].append(docs[at[hit]])
            out["h"].append(keys[hit])
    if not out["h"]:
        return pa.table({c: pa.array([], t) for c, t in zip(out, (pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))})
    made = {c: np.concatenate(v) for c, v in out.items()}
    halves = made["set"].view(">u8").reshape(-1, 2)
    order = np.lexsort((halves[:, 1], halves[:, 0], made["h"]))
    new = np.ones(len(order), dtype=bool)
    s, h = halves[order], made["h"][order]
    new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1]).any(axis=1)
    pick = order[new]
    sets = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(pick), [None, pa.py_buffer(made["set"][pick].tobytes())])
    return pa.table(
        {
            "set": sets.cast(pa.binary()),
            "n": made["n"][pick].astype(np.int32),
            "sent": made["sent"][pick].astype(np.int32),
            "docs": made["docs"][pick].astype(np.int64),
            "h": made["h"][pick].view(np.int64),
        }
    )


def shared_postings(documents: DataFrame, width: int, percent: int, low: float, shards: int, load: int) -> DataFrame:
    """(set, n, sent, docs, h): the sent shingles that more than one document sent."""
    text = documents.select("doc_id", "text")
    counted = text.mapInArrow(
        lambda b: _postings(b, shards, width, percent, low, True), "shard int, keys binary, counts binary"
    )
    index = stage(
        counted.groupBy("shard").applyInArrow(_count, "shard int, load bigint, shared binary, docs binary")
    )
    copies = F.greatest(F.lit(1), F.ceil(F.col("load") / load)).cast("int").alias("copies")
    loads = index.select("shard", copies).filter("copies > 1")
    rows = text.mapInArrow(
        lambda b: _postings(b, shards, width, percent, low, False),
        "shard int, keys binary, refs binary, sets binary, sizes binary, sents binary",
    )
    # One small row per shard: a hot shard is searched by several tasks.
    rows = rows.join(F.broadcast(loads) if fits_broadcast(loads) else loads, "shard", "left")
    rows = rows.withColumn("copy", F.coalesce(F.pmod(F.xxhash64("keys"), F.col("copies")).cast("int"), F.lit(0))).drop("copies")
    copied = index.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).select("shard", "copy", "shared", "docs")
    return rows.groupBy("shard", "copy").cogroup(copied.groupBy("shard", "copy")).applyInArrow(_probe, _SHARED)


def candidate_edges(postings: DataFrame, percent: int) -> DataFrame:
    """(a, b): distinct edges from a set to the smallest set with the same prefix shingle."""
    listed = postings.groupBy("set").agg(
        F.first("n").alias("n"), F.first("sent").alias("sent"),
        # A set sends each shingle once, but tasks that share a shard may repeat it.
        F.sort_array(F.collect_set(F.struct("docs", "h"))).alias("list"),
    )
    n = F.col("n")
    need = n - F.ceil(n * percent / 100).cast("int") + 1
    left = need - (F.col("sent") - F.size("list"))
    # Shingles below the limit of the hash range come before those added to reach ``need``;
    # if some were added, all that were sent are in the prefix.
    prefix = listed.withColumn("left", left).filter("left > 0").select(
        "set", F.explode(F.slice("list", 1, F.col("left"))["h"]).alias("h")
    )
    prefix = stage(prefix)
    pivots = prefix.groupBy("h").agg(F.min("set").alias("b"), F.max("set").alias("most")).filter("b < most").drop("most")
    edges = prefix.join(pivots, "h").filter("set > b").select(F.col("set").alias("a"), "b")
    return edges.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): smallest node reachable, for every node of ``edges`` (a > b).

    Rounds of large-star and small-star until the edges are stars. Each round is
    written, so a lost executor costs one round at most."""
    def oriented(df):
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()

    edges = stage(oriented(edges))
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = lookup_join(both.filter("b > a"), least, ["a"], "inner").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = oriented(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = lookup_join(large, least, ["a"], "inner")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        after = stage(oriented(small))
        # Stars: every node has one edge and no centre has an edge of its own.
        several = after.groupBy("a").count().filter("count > 1").limit(1)
        chained = after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", F.lit(1)).limit(1)
        edges = after
        if not several.unionAll(chained).take(1):
            break
    centres = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(centres)


# T-occurrence search ---------------------------------------------------------


class Index:
    """Inverted lists over some sets (sorted hash arrays)."""

    def __init__(self, sets: list[np.ndarray], members: np.ndarray):
        self.members = members
        size = np.array([len(sets[i]) for i in members], dtype=np.int64)
        value = np.concatenate([sets[i] for i in members]) if len(members) else np.zeros(0, np.uint64)
        order = np.argsort(value, kind="stable")
        value, self.ids = value[order], np.repeat(np.arange(len(members)), size)[order]
        first = np.concatenate(([True], value[1:] != value[:-1])) if len(value) else np.zeros(0, bool)
        self.start = np.flatnonzero(first)
        self.keys, self.end = value[self.start], np.concatenate((self.start[1:], [len(value)]))
        self.sizes = size

    def search(self, query: np.ndarray, percent: int, alive: np.ndarray) -> np.ndarray:
        """Positions of the live sets that link with ``query``, by DivideSkip."""
        if not len(self.keys) or not len(query):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        at = at[self.keys[at] == query]
        need = int(_least(len(query), percent))
        if len(at) < need:
            return np.zeros(0, np.int64)
        length = self.end[at] - self.start[at]
        at = at[np.argsort(-length, kind="stable")]
        length = self.end[at] - self.start[at]
        n_long = min(need - 1, int(need / (SKIP_FACTOR * np.log2(max(2, length[0])) + 1)))
        long, short = at[:n_long], at[n_long:]
        merged = np.concatenate([self.ids[a:b] for a, b in zip(self.start[short], self.end[short])])
        found = np.bincount(merged[alive[merged]], minlength=len(self.members))
        # Sizes too far apart can't link.
        n = len(query)
        fit = (found >= max(1, need - n_long)) & (100 * np.minimum(self.sizes, n) >= percent * np.maximum(self.sizes, n))
        candidates = np.flatnonzero(fit)
        if not len(candidates):
            return candidates
        overlap = found[candidates]
        for k, (a, b) in enumerate(zip(self.start[long], self.end[long])):
            # A list holds its sets in rising order.
            ids = self.ids[a:b]
            place = np.minimum(np.searchsorted(ids, candidates), b - a - 1)
            overlap = overlap + (ids[place] == candidates)
            possible = overlap + (n_long - k - 1) >= need
            candidates, overlap = candidates[possible], overlap[possible]
            if not len(candidates):
                return candidates
        union = self.sizes[candidates] + n - overlap
        return candidates[100 * overlap >= percent * union]


def linked_components(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Label of each set: the first position of its component. Sets that were found
    leave the index, which is made anew whenever half of its sets are gone."""
    label = np.full(len(sets), -1, dtype=np.int64)
    index, alive = Index(sets, np.arange(len(sets))), np.ones(len(sets), dtype=bool)
    left = len(sets)

    def take(position: int) -> None:
        nonlocal left
        alive[position] = False
        left -= 1

    for root in range(len(sets)):
        if label[root] >= 0:
            continue
        label[root] = root
        take(int(np.searchsorted(index.members, root)))
        queue = [root]
        while queue and left:
            if left * 2 <= len(index.members) and len(index.members) > 16:
                index = Index(sets, index.members[alive])
                alive = np.ones(len(index.members), dtype=bool)
            for position in index.search(sets[queue.pop()], percent, alive):
                found = int(index.members[position])
                label[found] = root
                take(int(position))
                queue.append(found)
    return label


def _block_sets(rows: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]


def _searched(percent: int):
    """Components of one chunk of a block together with the block's pivot."""
    def run(rows: pa.Table) -> pa.Table:
        names = rows.column("set").to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        sets = _block_sets(rows)
        label = linked_components([sets[i] for i in order], percent)
        return pa.table(
            {
                "a": pa.array([names[i] for i in order], pa.binary()),
                "b": pa.array([names[order[i]] for i in label], pa.binary()),
            }
        )

    return run


def _crossed(percent: int):
    """Links of the sets left over in a block with the sets of one of its chunks."""
    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and rows.num_rows:
            sets, names = _block_sets(rows), rows.column("set").to_pylist()
            index, alive = Index(sets, np.arange(len(sets))), np.ones(len(sets), dtype=bool)
            for name, query in zip(queries.column("set").to_pylist(), _block_sets(queries)):
                # One link to each component of the chunk joins all of it.
                seen = set()
                for i in index.search(query, percent, alive):
                    label = rows.column("label")[int(i)].as_py()
                    if names[i] != name and label not in seen:
                        seen.add(label)
                        out.append((name, names[i]))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _hashes(batches, width: int):
    for batch in chunks(batches):
        value, at = document_sets(batch, width)
        names = batch.column(2).to_pylist()
        # Only the texts that are the set looked for: an id may repeat.
        rows = [i for i, digest in enumerate(_digests(value, at)) if digest == names[i]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([names[i] for i in rows], pa.binary()),
                batch.column(3).take(pa.array(rows, pa.int64())),
                pa.array([value[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary()),
            ],
            names=["set", "block", "hashes"],
        )


def _block_links(sets: DataFrame, percent: int, block_sets: int, block_shingles: int) -> DataFrame:
    """(a, b): enough links to connect the components of every block."""
    # What a task holds, as a share of what it may hold: sets and their shingles.
    share = F.greatest(F.count("*") / block_sets, F.sum(F.octet_length("hashes") / 8) / block_shingles)
    sizes = sets.groupBy("block").agg(share.alias("share"), F.min("set").alias("pivot"))
    large = stage(sizes.filter(F.col("share") > 1))
    link = "a binary, b binary"
    if not large.take(1):
        return sets.groupBy("block").applyInArrow(_searched(percent), link).filter("a > b")
    told = lookup_join(sets, large, ["block"])
    chunk_count = F.ceil(2 * F.col("share"))
    told = told.withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("set"), chunk_count), F.lit(0)).cast("bigint"))
    told = stage(told)
    pivot = told.filter("set = pivot").select(
        "set", "block", "hashes", F.explode(F.sequence(F.lit(0).cast("bigint"), chunk_count - 1)).alias("chunk"), F.col("chunk").alias("home")
    ).filter("chunk <> home").drop("home")
    first = stage(
        told.select("set", "block", "hashes", "chunk").unionByName(pivot)
        .groupBy("block", "chunk").applyInArrow(_searched(percent), link)
    )
    # Where every chunk stands after its own search; the pivot's component is common to all.
    joined = components(first.filter("a <> b"))
    state = (
        told.filter("share is not null")
        .join(joined.withColumnRenamed("node", "set"), "set", "left")
        .withColumn("label", F.coalesce("label", "set"))
    )
    state = stage(state)
    main = state.filter("set = pivot").select("block", F.col("label").alias("main"))
    rest = stage(lookup_join(state, main, ["block"], "inner").filter("label <> main"))
    parts = rest.groupBy("block").agg(F.ceil(2 * share).alias("parts"))
    rest = lookup_join(rest, parts, ["block"], "inner")
    rest = rest.withColumn("part", F.pmod(F.xxhash64("set", F.lit(1)), F.col("parts")))
    rest = rest.select("set", "block", "hashes", "part", F.explode(F.sequence(F.lit(0).cast("bigint"), chunk_count - 1)).alias("chunk"))
    part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")
    targets = lookup_join(state, parts, ["block"], "inner").select("set", "block", "hashes", "chunk", "label", part)
    crossed = (
        rest.groupBy("block", "chunk", "part").cogroup(targets.groupBy("block", "chunk", "part"))
        .applyInArrow(_crossed(percent), link)
    )
    return first.filter("a <> b").unionByName(crossed)


def near_duplicates(
    documents: DataFrame,
    percent: int = PERCENT,
    width: int = WIDTH,
    low: float = LOW,
    shards: int | None = None,
    load: int = LOAD,
    block_sets: int = BLOCK_SETS,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """(doc_id, n_shingles, component_id): size of each document's set and the smallest
    id reachable over links, its own included."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    shards = shards or shard_count(rows, 4.0)
    described = stage(rows.mapInArrow(lambda b: _described(b, width), "doc_id bigint, n bigint, set binary"))
    members = described.filter("set is not null and doc_id is not null")
    classes = members.groupBy("set").agg(F.min("doc_id").alias("least"))
    classes = stage(classes)
    # Ids of several rows with different texts: ``own`` is one of their sets.
    several = described.filter("doc_id is not null").groupBy("doc_id").agg(
        F.min("set").alias("own"), F.max("set").alias("other"), F.count_if(F.col("set").isNull()).alias("without")
    )
    several = stage(several.filter("own is not null and (own <> other or without > 0)").select("doc_id", "own"))
    same_id = lookup_join(members, several, ["doc_id"], "inner").select(F.col("set").alias("a"), F.col("own").alias("b"))

    postings = shared_postings(rows, width, percent, low, shards, load)
    blocks = components(candidate_edges(postings, percent)).withColumnRenamed("node", "set").withColumnRenamed("label", "block")
    wanted = stage(blocks.join(classes, "set").select("set", "block", "least"))
    texts = lookup_join(rows, wanted.withColumnRenamed("least", "doc_id"), ["doc_id"], "inner")
    sets = texts.select("doc_id", "text", "set", "block").mapInArrow(
        lambda b: _hashes(b, width), "set binary, block binary, hashes binary"
    )
    joined = stage(components(_block_links(sets, percent, block_sets, block_shingles).unionByName(same_id)))
    least = joined.join(classes, joined["node"] == classes["set"]).groupBy("label").agg(F.min("least").alias("component"))
    linked = joined.join(least, "label").select(F.col("node").alias("set"), "component")
    named = classes.join(linked, "set", "left").select(
        "set", F.coalesce("component", "least").alias("component")
    )
    # A hot set is looked up, not grouped.
    described = lookup_join(described, several, ["doc_id"]).withColumn("set", F.coalesce("set", "own"))
    return lookup_join(described, named, ["set"]).select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def op10_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
links AS (
  SELECT x, y FROM (
    SELECT a.doc_id AS x, b.doc_id AS y, a.n AS na, b.n AS nb, count(*) AS c
    FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL)
  WHERE 100 * c >= 75 * (na + nb - c)
), reach AS (
  SELECT doc_id, doc_id AS r FROM s
  UNION
  SELECT reach.doc_id, links.y FROM reach JOIN links ON reach.r = links.x
)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, m.component_id
FROM s JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) m ON s.doc_id = m.doc_id
"""
