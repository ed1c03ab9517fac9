import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import models
from corpusloom.operators import packing
from corpusloom.operators.packing import pack_parts
from corpusloom.plans import pack as plan


def run(spark, repos, limit, chunk, fan=packing.FAN, **bounds):
    """repos: {repo: (overhead, [tokens])} -> {repo: [(part, before)]}"""
    rows = [(r, i, t) for r, (_, ts) in repos.items() for i, t in enumerate(ts, 1)]
    blocks = spark.createDataFrame(rows, "repo string, ord bigint, tokens bigint")
    overhead = spark.createDataFrame([(r, o) for r, (o, _) in repos.items()], "repo string, overhead bigint")
    out = {}
    for row in pack_parts(blocks, overhead, limit, chunk, fan, **bounds).orderBy("repo", "ord").collect():
        out.setdefault(row["repo"], []).append((row["part"], row["before"]))
    return out


# name: (room, tokens); the room is what the limit leaves beside the overhead
CASES = {
    "exact_fit": (60, [20, 40, 1]),
    "one_too_large": (45, [10, 100, 10, 10]),
    "too_large_first": (45, [100, 10, 10]),
    "overhead_above_limit": (-10, [1, 1, 1]),
    "zero_tokens": (0, [0, 5, 0, 0]),
    "one_block": (5, [3]),
}


@pytest.mark.parametrize("chunk", [1, 2, 4096])
def test_small_cases(spark, chunk):
    repos = {name: (1000 - room, tokens) for name, (room, tokens) in CASES.items()}
    expected = {name: models.next_fit(tokens, room) for name, (room, tokens) in CASES.items()}
    assert run(spark, repos, 1000, chunk) == expected


def test_chunks_compose_over_several_levels(spark):
    """One huge repo beside small ones, with gaps in the order, four levels deep."""
    rng = random.Random(5)
    repos = {"big": (7, [rng.choice([0, 1, 3, 9, 40, 120]) for _ in range(400)])}
    for i in range(6):
        repos[f"s{i}"] = (rng.randint(0, 120), [rng.randint(0, 60) for _ in range(rng.randint(1, 40))])
    for limit in (100, 1000, 0):
        got = run(spark, repos, limit, 8, fan=3)
        for repo, (overhead, tokens) in repos.items():
            room = limit - overhead if limit else 10**12
            assert got[repo] == models.next_fit(tokens, room), (repo, limit)


@pytest.mark.parametrize("window_rows, limits", [(0, [2500]), (10**6, [150, 6000])])
def test_functions_of_many_steps(spark, window_rows, limits):
    """Composed by ranges of entry sums, at limits around and far above the chunks' tokens."""
    rng = random.Random(8)
    repos = {"big": (7, [rng.choice([0, 1, 3, 9, 40, 120]) for _ in range(500)])}
    repos |= {f"s{i}": (rng.randint(0, 120), [rng.randint(0, 60) for _ in range(rng.randint(1, 60))]) for i in range(5)}
    for limit in limits:
        got = run(spark, repos, limit, 8, fan=3, group_steps=4, window_rows=window_rows)
        for repo, (overhead, tokens) in repos.items():
            assert got[repo] == models.next_fit(tokens, limit - overhead), (repo, limit)


def test_pairs_equal_composition_in_one_task(spark):
    """Every entry sum, not only those that occur."""
    rng = np.random.default_rng(4)
    room = 900
    frames = [packing._chunk_steps("r", i, room, 10**9, rng.integers(0, 30, 25)) for i in range(5)]
    level = spark.createDataFrame(pd.concat(frames), packing._STEPS)
    wide = packing._compose_wide(level, 10**6).toPandas()
    sums = np.arange(-1, room + 1)

    def leave(steps, used):
        f = steps.sort_values("lo")[["lo", "opened", "base", "keep"]].to_numpy(dtype="int64")
        hit = packing._at(f, used)
        return hit[:, 1], hit[:, 2] + hit[:, 3] * used

    assert sorted(wide["id"].unique()) == [0, 1, 2]
    for k in range(3):
        opened, used = leave(frames[2 * k], sums)
        if 2 * k + 1 < 5:
            more, used = leave(frames[2 * k + 1], used)
            opened = opened + more
        got = leave(wide[wide["id"] == k], sums)
        assert (got[0] == opened).all() and (got[1] == used).all()


def test_a_repo_of_a_million_blocks(spark):
    """A limit of about 300 chunks: no task composes more than 20,000 steps."""
    n, limit = 1_000_000, 300 * packing.CHUNK * 50
    tokens = F.pmod(F.xxhash64("id"), F.lit(100)).cast("bigint")
    blocks = spark.range(1, n + 1).select(F.lit("r").alias("repo"), F.col("id").alias("ord"), tokens.alias("tokens"))
    overhead = spark.createDataFrame([("r", 10)], "repo string, overhead bigint")
    placed = pack_parts(blocks, overhead, limit, group_steps=20_000).select("ord", "tokens", "part", "before").toPandas()
    placed = placed.sort_values("ord")
    expected = np.array(models.next_fit(placed["tokens"].tolist(), limit - 10))
    assert len(placed) == n and expected[-1, 0] > 3
    assert (placed[["part", "before"]].to_numpy() == expected).all()


FILES = [
    ("r", "src/a.go", "package a\n// c\nfunc A() {}\n"),
    ("r", "src/b.py", "# c\nx = 1\n"),
    ("r", "z.md", "text ]]> more"),
    ("r", "node_modules/m/i.js", "x"),
    ("r", "logo.png", "x"),
    ("q", "only.txt", "one"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "repo string, path string, content string")


def test_pack_formats(files):
    body = {(r.repo, r.part): r.body for r in plan.part_body(plan.pack(files, fmt="XML")).collect()}
    assert set(body) == {("r", 1), ("q", 1)}
    assert body["q", 1] == (
        "Below is the repository context of the code files packed for analysis.\n\n"
        "Repository Tree Structure:\n```\n\U0001F4C4 only.txt\n```\n\n"
        '<file path="only.txt" size="0.00 KB" tokens="0">\n<![CDATA[\none\n]]>\n</file>\n\n'
    )
    assert "]]]]><![CDATA[> more\n]]>" in body["r", 1]
    assert "\U0001F4C1 src/\n  \U0001F4C4 a.go\n  \U0001F4C4 b.py\n\U0001F4C4 z.md\n```" in body["r", 1]
    markdown = {r.repo: r.body for r in plan.part_body(plan.pack(files)).collect()}
    assert "## File: src/a.go (Size: 0.02 KB | Tokens: 5)\n```go\npackage a\nfunc A() {}\n```\n\n" in markdown["r"]
    assert "node_modules" not in markdown["r"] and "logo" not in markdown["r"]


def test_rows_of_a_part_join_to_the_same_text(files):
    packed = plan.pack(files, 60)
    whole = {(r.repo, r.part): r.body for r in plan.part_body(packed).collect()}
    rows = plan.part_body(packed, piece_tokens=1, tree_chunk=1).orderBy("repo", "part", "piece").collect()
    assert len(rows) > len(whole)
    joined = {}
    for r in rows:
        joined[r.repo, r.part] = joined.get((r.repo, r.part), "") + r.body
    assert joined == whole
    sizes = {(r.repo, r.part): (r.bytes, r.tokens) for r in plan.part_summary(packed).collect()}
    assert sizes == {k: (len(v.encode()), len(v.encode()) // 4) for k, v in whole.items()}
    pieces = plan.tree_text(packed.nodes, chunk=2).orderBy("repo", "piece").collect()
    trees = {}
    for r in pieces:
        trees[r.repo] = trees.get(r.repo, "") + r.tree
    assert trees == {r.repo: r.tree for r in plan.tree_text(packed.nodes).collect()}


def test_part_names(files):
    split = plan.part_names(plan.pack(files, 1), "out", ".md").orderBy("repo", "part").collect()
    assert [(r.repo, r.part_name, r.marker) for r in split] == [
        ("q", "out.md", ""),
        ("r", "out_part1.md", "=== PART 1 of 3 ===\n"),
        ("r", "out_part2.md", "=== PART 2 of 3 ===\n"),
        ("r", "out_part3.md", "=== PART 3 of 3 ===\n"),
    ]


def test_selection_leaves_files_out(spark, files):
    rules = spark.createDataFrame(
        [("r", 1, "src", False), ("r", 2, "src/b.py", True), ("q", 1, "only.txt", False)],
        "repo string, seq int, path string, selected boolean",
    )
    packed = plan.pack(files, selection=rules)
    body = {r.repo: r.body for r in plan.part_body(packed).collect()}
    assert set(body) == {"r"}  # a repo without a selected file has no part
    assert "a.go" not in body["r"] and "src/\n" not in body["r"] and "src/b.py" in body["r"]


def test_reports(files):
    nodes = plan.token_nodes(files)
    row = plan.corpus_summary(nodes).filter("repo = 'r'").first()
    assert (row.selected_files, row.all_files) == (3, 3)
    assert row.selected_bytes == sum(len(c) for r, p, c in FILES[:3])
    fit = plan.context_fit(plan.corpus_summary(nodes), 1).select(F.min("fit"), F.max("fit")).first()
    assert tuple(fit) == (0.0, 1.0)
    saved = plan.strip_savings(files).filter("repo = 'q'").first()
    assert saved.saved_pct == 0.0


@pytest.mark.parametrize("factor", [1, 50])
def test_steps_stay_bounded_when_a_repo_fits_one_part(factor):
    """64 full chunks composed, for a limit at and far above the repo's total."""
    rng = random.Random(2)
    chunks = [[rng.randint(1, 200) for _ in range(packing.CHUNK)] for _ in range(packing.FAN)]
    total, reach, frames = sum(map(sum, chunks)), 0, []
    for number, tokens in enumerate(chunks):
        frames.append(packing._chunk_steps("r", number, total * factor, reach, np.array(tokens)))
        reach += sum(tokens)
    steps = packing._compose(pd.concat(frames), packing.FAN)
    assert sum(map(len, frames)) < 2 * packing.CHUNK and len(steps) < 2 * packing.CHUNK
    # A full part in between: the steps still give the sequential walk.
    room = total // 3
    frames = [packing._chunk_steps("r", n, room, sum(map(sum, chunks[:n])), np.array(t)) for n, t in enumerate(chunks[:4])]
    composed = packing._functions(packing._compose(pd.concat(frames), 4))[0][1]
    walked = models.next_fit([t for c in chunks[:4] for t in c], room)
    assert packing._at(composed, np.array([-1]))[0][1] + 1 == walked[-1][0]


def long_tree(spark, n):
    """A repo of ``n`` small files with long paths."""
    path = F.format_string("a-folder-with-a-long-name-%04d/file.txt", "id")
    return spark.range(n).select(F.lit("r").alias("repo"), path.alias("path"), F.lit("x\n").alias("content"))


@pytest.mark.parametrize("named", [False, True])
def test_trees_are_not_shuffled_with_every_part(spark, named):
    packed = plan.pack(long_tree(spark, 300), 1)
    df = plan.named_parts(packed, "out", ".md") if named else plan.part_body(packed)
    moved = models.moved_bytes(df)
    bodies = {r.part: r.body for r in df.collect()}
    tree = plan.tree_text(packed.nodes).first().tree
    assert len(bodies) == 300 and all(tree in b and b.count("## File: ") == 1 for b in bodies.values())
    assert moved < 10 * len(tree) < sum(map(len, bodies.values())) / 10


@pytest.mark.parametrize("named", [False, True])
def test_tree_rows_lie_beside_their_copies(spark, named):
    packed = plan.pack(long_tree(spark, 150), 1)
    df = plan.named_parts(packed, "out", ".md", tree_chunk=7) if named else plan.part_body(packed, tree_chunk=7)
    trees = plan.tree_text(packed.nodes, 7).orderBy("piece").collect()
    rows = df.withColumn("task", F.spark_partition_id()).collect()
    early = [r for r in rows if r.piece < len(trees) - 1]
    assert sorted((r.part, r.piece) for r in early) == [(p, t.piece) for p in range(1, 151) for t in trees[:-1]]
    assert all(r.body.endswith(trees[r.piece].tree) for r in early)
    runs = sum((a.task, a.piece) != (b.task, b.piece) for a, b in zip(early, early[1:])) + 1
    assert runs == len(trees) - 1
