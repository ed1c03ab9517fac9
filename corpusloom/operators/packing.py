"""Packing ordered blocks into token-limited parts, first come, never cut.

A part takes the next block unless that would pass the limit and the part
already has one. The walk is sequential, but it is done in bounded chunks of
each repo. Within a part only its token sum matters, so a chunk is a step
function from the sum on entry to (parts opened, sum on exit). The functions are
composed level by level (up), the entry sums are handed back (down), and then
every chunk assigns its own blocks. A chunk is only entered with sums up to the tokens
before it in its repo, so steps above that are dropped; a repo that fits one part has
two steps per chunk. Without a limit there are no steps at all.

Functions are composed inside one task only while a group of them has ``GROUP_STEPS``
steps at most. A limit far above the chunks' tokens can need a step for nearly every
block; from there on two neighbours at a time are composed by a sweep over the entry sums,
cut into ranges: the exit sums of the first meet the steps of the second.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import WINDOW_ROWS, lookup_join, spread, stage, swept

# The functions below go to the executors by value; no package has to be there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1024  # nodes of one repo handled by one task at a time
FAN = 64  # chunk functions composed in one step
GROUP_STEPS = 1_000_000  # steps that one task composes

# Step function rows: from entry sum ``lo`` on (-1: empty part), ``opened`` new
# parts, exit sum ``base`` plus, if ``keep``, the entry sum.
_STEPS = "repo string, id bigint, lo bigint, opened bigint, base bigint, keep boolean"
_ENTRY = "repo string, id bigint, part bigint, used bigint"


def _chunk_steps(repo: str, number: int, room: int, reach: int, tokens: np.ndarray) -> pd.DataFrame:
    total = np.cumsum(tokens)
    n = len(total)
    prior = np.concatenate(([0], total[:-1]))
    # First block after the one at j that no longer fits a part begun at j.
    following = np.maximum(np.searchsorted(total, prior + room, side="right"), np.arange(1, n + 1))
    # Parts begun after j until the chunk ends, and where the last one begins: jumps of
    # one part, then of two, four and so on.
    opened = np.append((following < n).astype("int64"), 0)
    begin = np.append(np.where(following < n, following, np.arange(n)), n)
    while True:
        further = opened + opened[begin]
        if (further == opened).all():
            break
        opened, begin = further, begin[begin]
    last = np.append(total[-1] - prior, 0)[begin]
    # A part holding r tokens is closed before block j if j is the first with
    # r + total[j] > room; without such a block it stays open.
    closing = np.flatnonzero((prior <= room) | (np.arange(n) == 0))
    lo = np.maximum(0, room - total[closing] + 1)
    possible = ((closing == 0) | (lo <= room - prior[closing])) & (lo <= reach)
    closing, lo = closing[possible], lo[possible]
    rows = [[(-1, opened[0], last[0], 0)]]
    if total[-1] <= room:
        rows.append([(0, 0, total[-1], 1)])
    rows.append(np.column_stack((lo, opened[closing] + 1, last[closing], np.zeros_like(lo))))
    return _frame(repo, number, _merged(np.vstack(rows)))


def _all_chunk_steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for repo, number, room, reach, tokens in zip(
            batch["repo"], batch["chunk"], batch["room"], batch["reach"], batch["tokens"]
        ):
            yield _chunk_steps(repo, number, room, reach, np.asarray(tokens, dtype="int64"))


def _frame(repo: str, number: int, steps: np.ndarray) -> pd.DataFrame:
    out = pd.DataFrame(steps, columns=["lo", "opened", "base", "keep"]).astype({"keep": bool})
    out.insert(0, "id", number)
    out.insert(0, "repo", repo)
    return out


def _merged(steps: np.ndarray) -> np.ndarray:
    """Sorted by entry sum, without steps that repeat the one before."""
    steps = steps[np.argsort(steps[:, 0], kind="stable")]
    new = np.ones(len(steps), dtype=bool)
    new[1:] = (steps[1:, 1:] != steps[:-1, 1:]).any(axis=1)
    return steps[new]


def _functions(steps: pd.DataFrame) -> list[tuple[int, np.ndarray]]:
    columns = ["lo", "opened", "base", "keep"]
    return [
        (number, f.sort_values("lo")[columns].to_numpy(dtype="int64"))
        for number, f in sorted(steps.groupby("id"), key=lambda g: g[0])
    ]


def _at(f: np.ndarray, used: np.ndarray) -> np.ndarray:
    return f[np.searchsorted(f[:, 0], used, side="right") - 1]


def _then(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The step function of ``f`` followed by ``g``."""
    fixed = f[f[:, 3] == 0]
    hit = _at(g, fixed[:, 2])
    rows = [
        np.column_stack(
            (fixed[:, 0], fixed[:, 1] + hit[:, 1], hit[:, 2] + hit[:, 3] * fixed[:, 2], 0 * hit[:, 3])
        )
    ]
    for i in np.flatnonzero(f[:, 3]):
        # Entry sums from lo on leave shifted by base: cut them at the steps of g.
        lo, opened, base, _ = f[i]
        starts = np.unique(np.concatenate(([lo], g[:, 0] - base)))
        starts = starts[(starts >= lo) & ((i + 1 == len(f)) | (starts < f[min(i + 1, len(f) - 1), 0]))]
        hit = _at(g, starts + base)
        rows.append(
            np.column_stack((starts, opened + hit[:, 1], hit[:, 2] + hit[:, 3] * base, hit[:, 3]))
        )
    return _merged(np.vstack(rows))


def _compose(steps: pd.DataFrame, fan: int) -> pd.DataFrame:
    functions = [f for _, f in _functions(steps)]
    return _frame(steps["repo"].iloc[0], steps["id"].iloc[0] // fan, reduce(_then, functions))


def _hand_down(steps: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
    rows = []
    if len(entry) and len(steps):
        part, used = int(entry["part"].iloc[0]), int(entry["used"].iloc[0])
        for number, f in _functions(steps):
            rows.append((steps["repo"].iloc[0], number, part, used))
            _, opened, base, keep = (int(x) for x in _at(f, used))
            part, used = part + opened, base + keep * used
    return pd.DataFrame(rows, columns=["repo", "id", "part", "used"])


_PAIR = ["repo", "up"]


def _halves(level: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first and the second function of every pair of neighbours."""
    paired = level.withColumn("up", F.floor(F.col("id") / 2).cast("bigint"))
    return paired.filter("id % 2 = 0").drop("id"), paired.filter("id % 2 = 1").drop("id")


def _compose_wide(level: DataFrame, window_rows: int) -> DataFrame:
    """``level`` with every two neighbours as one function, without a pair ever being in
    one task. A function keeps the entry sum in one step at most, from sum 0 on."""
    first, second = _halves(level)
    step = F.struct("opened", "base", "keep")
    # Every step of the first function leaves with one sum; the step of the second that
    # begins at it or last before it is the one taken.
    leaving = first.select(
        *_PAIR, F.col("base").alias("key"), F.lit(1).alias("_asks"), "lo", step.alias("_f")
    )
    rows = leaving.unionByName(
        second.select(*_PAIR, F.col("lo").alias("key"), F.lit(0).alias("_asks"), step.alias("_g")), allowMissingColumns=True
    )
    met = swept(rows, _PAIR, ["key", "_asks"], ["_g"], "last", window_rows).filter("_asks = 1")
    # A pair's second function may be missing at the end of a repo.
    f, g = F.col("_f"), F.col("_g_upto")
    through = F.struct(
        (f["opened"] + g["opened"]).alias("opened"),
        (g["base"] + F.when(g["keep"], f["base"]).otherwise(0)).alias("base"),
        (f["keep"] & g["keep"]).alias("keep"),
    )
    out = met.select(*_PAIR, "lo", F.when(g.isNotNull(), through).otherwise(f).alias("step"))
    # Sums that the first function keeps arrive shifted: steps of the second that begin
    # inside that stretch begin in the pair, too.
    kept = first.groupBy(*_PAIR).agg(
        F.max(F.when(F.col("keep"), F.col("base"))).alias("_shift"),
        F.max(F.when(F.col("keep"), F.col("opened"))).alias("_already"),
        F.min(F.when(F.col("lo") > 0, F.col("lo"))).alias("_until"),
    ).filter("_shift is not null")
    shifted = lookup_join(second, stage(kept), _PAIR, "inner").filter(
        "lo > _shift and (_until is null or lo < _shift + _until)"
    )
    inner = shifted.select(
        *_PAIR, (F.col("lo") - F.col("_shift")).alias("lo"),
        F.struct(
            (F.col("_already") + F.col("opened")).alias("opened"),
            (F.col("base") + F.when(F.col("keep"), F.col("_shift")).otherwise(0)).alias("base"),
            F.col("keep"),
        ).alias("step"),
    )
    return out.unionByName(inner).select("repo", F.col("up").alias("id"), "lo", "step.*")


def _hand_down_wide(level: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries of both functions of every pair from those of the pair."""
    first, second = _halves(level)
    entries = stage(entries.withColumnRenamed("id", "up"))
    taken = F.max_by(F.struct("opened", "base", "keep"), "lo").alias("step")
    reached = lookup_join(first, entries, _PAIR, "inner").filter("lo <= used").groupBy(*_PAIR, "part", "used").agg(taken)
    step = F.col("step")
    after = reached.select(
        "repo", (2 * F.col("up") + 1).alias("id"), (F.col("part") + step["opened"]).alias("part"),
        (step["base"] + F.when(step["keep"], F.col("used")).otherwise(0)).alias("used"),
    )
    there = second.select("repo", (2 * F.col("up") + 1).alias("id")).distinct()
    before = entries.select("repo", (2 * F.col("up")).alias("id"), "part", "used")
    return before.unionByName(after.join(there, ["repo", "id"], "left_semi"))


def _entries(bags: DataFrame, last_chunk: int, fan: int, group_steps: int, window_rows: int) -> DataFrame:
    """Part number and token sum on entry to every chunk of the repos with more
    than one. ``last_chunk`` only sets the number of levels."""

    def up(by: int) -> Column:
        return F.floor(F.col("id") / by).cast("bigint").alias("_up")

    chunks = bags.filter("last_chunk > 0").select(
        "repo", "chunk", "room", "reach", F.col("items.tokens").alias("tokens")
    )
    level = stage(chunks.mapInPandas(_all_chunk_steps, _STEPS))
    # From below: each level with the number of its functions that make one above.
    levels = []
    top = last_chunk
    while True:
        most = level.groupBy("repo", up(fan)).count().agg(F.max("count")).first()[0] or 0
        by = fan if most <= group_steps else 2
        levels.append((level, by, most > group_steps))
        if top < by:
            break
        if most <= group_steps:
            level = stage(level.groupBy("repo", up(fan)).applyInPandas(lambda steps: _compose(steps, fan), _STEPS))
        else:
            level = stage(_compose_wide(level, window_rows))
        top //= by
    entries = levels[-1][0].select(
        "repo", F.lit(0).cast("bigint").alias("id"),
        F.lit(1).cast("bigint").alias("part"), F.lit(-1).cast("bigint").alias("used"),
    ).distinct()
    for level, by, wide in reversed(levels):
        if wide:
            entries = _hand_down_wide(level, entries)
        else:
            entries = (
                level.groupBy("repo", up(by))
                .cogroup(entries.groupBy("repo", "id"))
                .applyInPandas(_hand_down, _ENTRY)
            )
    return entries


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk each chunk part by part from its entry: a part reaches up to the first block
    that its sum leaves no room for."""
    for batch in batches:
        for repo, room, part, used, items in zip(
            batch["repo"], batch["room"], batch["part"], batch["used"], batch["items"]
        ):
            ord_ = np.array([i["ord"] for i in items], dtype="int64")
            tokens = np.array([i["tokens"] for i in items], dtype="int64")
            total = np.cumsum(tokens)
            n = len(total)
            prior = total - tokens
            parts, base = np.empty(n, dtype="int64"), np.empty(n, dtype="int64")
            first = np.zeros(n, dtype=bool)
            j = 0
            while j < n:
                # The open part holds ``used`` tokens, -1 if it has no block yet.
                held = max(used, 0) - prior[j]
                end = int(np.searchsorted(total, room - held, side="right"))
                end = max(end, j + 1) if used < 0 else max(end, j)
                first[j] |= used < 0 and end > j
                parts[j:end], base[j:end] = part, held
                if end < n:
                    part, used = part + 1, -1
                j = end
            yield pd.DataFrame(
                {"repo": repo, "ord": ord_, "tokens": tokens, "part": parts, "before": prior + base, "first": first}
            )


_PLACED = "repo string, ord bigint, tokens bigint, part bigint, before bigint, first boolean"


def _one_part(blocks: DataFrame, chunk: int) -> DataFrame:
    """Everything in part 1: sums inside chunks, and of the chunks before."""
    at = blocks.withColumn("_chunk", F.floor((F.col("ord") - 1) / chunk))
    sums = at.groupBy("repo", "_chunk").agg(F.sum("tokens").alias("_sum"))
    earlier = Window.partitionBy("repo").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("repo", "_chunk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_reach"))
    inside = Window.partitionBy("repo", "_chunk").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    own = at.withColumn("_own", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    own = own.withColumn("_row", F.row_number().over(Window.partitionBy("repo", "_chunk").orderBy("ord")))
    starts = own.groupBy("repo").agg(F.min("ord").alias("_least"))
    placed = lookup_join(own.join(sums, ["repo", "_chunk"]), starts, ["repo"])
    return placed.select(
        "repo", F.col("ord").cast("bigint").alias("ord"), F.col("tokens").cast("bigint").alias("tokens"),
        F.lit(1).cast("bigint").alias("part"), (F.col("_reach") + F.col("_own")).cast("bigint").alias("before"),
        (F.col("ord") == F.col("_least")).alias("first"),
    )


def pack_parts(
    blocks: DataFrame,
    overhead: DataFrame,
    max_tokens: int = 0,
    chunk: int = CHUNK,
    fan: int = FAN,
    group_steps: int = GROUP_STEPS,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Assign blocks (repo, ord, tokens) to parts.

    ``overhead`` (repo, overhead) is what every part of a repo starts with.
    Result: (repo, ord, tokens, part, before, first): ``before`` counts the block
    tokens already in the part, ``first`` marks its first block. Without a limit
    there is one part.
    """
    if max_tokens <= 0:
        return _one_part(blocks, chunk)
    where = F.floor((F.col("ord") - 1) / chunk).cast("bigint")
    bags = (
        blocks.select(
            "repo",
            where.alias("chunk"),
            F.col("ord").cast("bigint").alias("ord"),
            F.col("tokens").cast("bigint").alias("tokens"),
        )
        .groupBy("repo", "chunk")
        .agg(
            F.sort_array(F.collect_list(F.struct("ord", "tokens"))).alias("items"),
            F.sum("tokens").alias("sum"),
        )
    )
    bags = stage(bags)
    repo = Window.partitionBy("repo")
    earlier = repo.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # One row per chunk, without its blocks: tokens before it, and its repo's last chunk.
    facts = bags.select(
        "repo", "chunk", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("reach"),
        F.max("chunk").over(repo).alias("last_chunk"),
    )
    room = F.lit(max_tokens).cast("bigint") - F.coalesce("overhead", F.lit(0))
    facts = stage(
        lookup_join(facts, overhead.select("repo", "overhead"), ["repo"]).withColumn("room", room).drop("overhead")
    )
    last_chunk = facts.agg(F.max("last_chunk")).first()[0] or 0
    bags = bags.drop("sum").join(facts, ["repo", "chunk"])
    # used = -1 marks a part without a block.
    given = _entries(bags, last_chunk, fan, group_steps, window_rows).withColumnRenamed("id", "chunk")
    bags = bags.join(given, ["repo", "chunk"], "left")
    return spread(
        bags.select(
            "repo", "chunk", "room", F.coalesce("part", F.lit(1).cast("bigint")).alias("part"),
            F.coalesce("used", F.lit(-1).cast("bigint")).alias("used"), "items",
        ),
        "repo", "chunk",
    ).drop("chunk").mapInPandas(_placed, _PLACED)
