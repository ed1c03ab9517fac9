"""Part texts of large repos: what is shuffled, broadcast and held at a time."""

import re

import pyarrow.parquet as pq
import pytest

import models
from corpusloom import session
from corpusloom.plans import pack as plan
from test_packing import long_tree


@pytest.fixture
def no_broadcasts_of_its_own(spark):
    """Spark replaces no shuffled join by a broadcast while it runs."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


def test_names_are_made_where_the_parts_are(spark, monkeypatch, no_broadcasts_of_its_own):
    files = spark.createDataFrame([(f"r{i % 2}", f"f{i}.txt", f"{i} " * 5000) for i in range(40)], "repo string, path string, content string")
    packed = plan.pack(files, 1)
    named = {(r.repo, r.part): r.body for r in plan.named_parts(packed, "out", ".md").collect()}
    monkeypatch.setattr(session.fits_broadcast, "__defaults__", (0,))
    monkeypatch.setattr(session.lookup_join, "__defaults__", ("left", 0))
    df, body = plan.named_parts(packed, "out", ".md"), plan.part_body(packed)
    assert models.moved_bytes(df) < 1.2 * models.moved_bytes(body)
    rows = {(r.repo, r.part): r for r in df.collect()}
    assert {at: r.body for at, r in rows.items()} == named
    bodies = {(r.repo, r.part): r.body for r in body.collect()}
    assert len(rows) == 40 and all(r.body == f"=== PART {part} of 20 ===\n" + bodies[repo, part] for (repo, part), r in rows.items())
    assert all(r.part_name == f"out_part{part}.md" for (_, part), r in rows.items())


def test_trees_too_large_for_a_broadcast_meet_the_blocks_where_they_are(spark, no_broadcasts_of_its_own):
    files = spark.createDataFrame([(f"r{i % 2}", f"f{i}.txt", f"{i} " * 5000) for i in range(40)], "repo string, path string, content string")
    packed = plan.pack(files, 1)
    for pieces in ((10**6, 10**5), (300, 7)):
        small = plan._assembled(packed, packed.parts, *pieces, True)
        large = plan._assembled(packed, packed.parts, *pieces, True, most=0)
        assert models.moved_bytes(large) < 1.2 * models.moved_bytes(small)
        assert sorted(map(str, large.collect())) == sorted(map(str, small.collect()))


def test_writers_look_at_rows_with_trees_often(spark, tmp_path):
    packed = plan.pack(long_tree(spark, 300), 1)
    plan.part_body(packed).coalesce(1).write.option("parquet.block.size", 1 << 18).parquet(str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("*.parquet")
    held = pq.ParquetFile(file).metadata
    assert held.num_rows == 300 and max(held.row_group(i).num_rows for i in range(held.num_row_groups)) < 60


def test_copies_of_trees_are_made_one_by_one(spark):
    packed = plan.pack(long_tree(spark, 150), 1)
    df = plan.part_body(packed, tree_chunk=7)
    assert len(df.collect()) > 150 * 20
    lines = df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0].splitlines()
    made = [line for line in lines if "Generate explode" in line]
    assert len(made) >= 3 and not any(re.search(r"\*\(\d+\) Generate", line) for line in made)


@pytest.mark.parametrize("most", [0, plan.LOOKUP_BYTES])
def test_every_stretch_of_parts_meets_every_tree_row(spark, monkeypatch, most):
    monkeypatch.setattr(plan, "PART_BLOCK", 4)
    monkeypatch.setattr(plan, "STRETCH", 2)
    parts = [(r, p) for r, n in (("a", 50), ("b", 3), ("c", 9)) for p in range(1, n + 1) if p % 11 != 5]
    trees = [(r, k, f"{r}{k}") for r, n in (("a", 30), ("b", 0), ("c", 1), ("d", 2)) for k in range(n)]
    got = plan._in_every_part(
        spark.createDataFrame(parts, "repo string, part bigint"),
        spark.createDataFrame(trees, "repo string, piece bigint, body string"), 100, most,
    )
    expected = sorted((r, p, k, t) for r, p in parts for q, k, t in trees if q == r)
    assert sorted(map(tuple, got.select("repo", "part", "piece", "body").collect())) == expected
