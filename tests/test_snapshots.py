"""Versioned snapshots: what a commit writes, and what a commit that fails leaves."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import snapshots


def contents(df):
    return {(r.repo, r.path): r.content for r in df.collect()}


def blocks(spark, rows):
    return spark.createDataFrame(rows, "repo string, clean_path string, content string")


@pytest.fixture
def made(spark, tmp_path):
    rows = {(f"r{i % 3}", f"d{i % 40}/f{i}"): f"text {i}" for i in range(3000)}
    files = spark.createDataFrame([(*k, v) for k, v in rows.items()], "repo string, path string, content string")
    root = str(tmp_path / "snap")
    assert snapshots.create_snapshot(files, root, 1000) == 1
    return root, rows


def written(root):
    return {f"data/{d}/{b}" for d in os.listdir(f"{root}/data") for b in os.listdir(f"{root}/data/{d}") if "=" in b}


def test_a_commit_writes_the_touched_buckets(spark, made):
    root, rows = made
    assert contents(snapshots.read_snapshot(spark, root)) == rows
    old = written(root)
    assert len(old) > 900
    change = {("r0", "d0/f0"): "new", ("r0", "d3/f3"): rows["r0", "d3/f3"], ("new", "x"): "", **{("r1", f"add/{k}"): f"a{k}" for k in range(7)}}
    assert snapshots.commit_blocks(spark, root, blocks(spark, [(*k, v) for k, v in change.items()])) == 2
    assert 1 <= len(written(root) - old) <= 10 and old <= written(root)
    assert contents(snapshots.read_snapshot(spark, root)) == rows | change
    assert contents(snapshots.read_snapshot(spark, root, 1)) == rows
    assert snapshots.commit_blocks(spark, root, blocks(spark, [])) == 2
    read = snapshots.read_snapshot(spark, root).filter(F.col("repo") == "new").inputFiles()
    assert len(read) <= 1000


def test_a_commit_that_dies_leaves_the_old_version(spark, made, monkeypatch):
    root, rows = made

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(snapshots._Folder, "publish", die)
        with pytest.raises(KeyboardInterrupt):
            snapshots.commit_blocks(spark, root, blocks(spark, [("r0", "d0/f0", "half")]))
    assert snapshots.latest_version(spark, root) == 1
    assert contents(snapshots.read_snapshot(spark, root)) == rows


def test_two_commits_cannot_share_a_number(spark, made):
    root, _ = made
    folder = snapshots._Folder(spark, root)
    folder.publish(2, folder.manifest_of(1))
    with pytest.raises(RuntimeError):
        folder.publish(2, folder.manifest_of(1))
    assert snapshots.latest_version(spark, root) == 2


def test_an_empty_snapshot(spark, tmp_path):
    root = str(tmp_path / "none")
    none = spark.createDataFrame([], "repo string, path string, content string")
    assert snapshots.create_snapshot(none, root, 4) == 1
    assert contents(snapshots.read_snapshot(spark, root)) == {}
    assert snapshots.commit_blocks(spark, root, blocks(spark, [("r", "p", "c")])) == 2
    assert contents(snapshots.read_snapshot(spark, root)) == {("r", "p"): "c"}


def test_old_versions_can_go(spark, tmp_path):
    root = str(tmp_path / "old")
    files = spark.createDataFrame([("r", f"f{k}", "a") for k in range(40)], "repo string, path string, content string")
    snapshots.create_snapshot(files, root, 16)
    for k in range(3):
        snapshots.commit_blocks(spark, root, blocks(spark, [("r", "f1", f"v{k}")]))
    whole = contents(snapshots.read_snapshot(spark, root))
    os.makedirs(f"{root}/data/underway/bucket=0")
    before = written(root)
    assert snapshots.drop_versions(spark, root, keep=2) == [1, 2]
    # The first version's bucket of f1 and the second version's.
    assert len(before - written(root)) == 2 and "data/underway/bucket=0" in written(root)
    assert contents(snapshots.read_snapshot(spark, root)) == whole
    assert contents(snapshots.read_snapshot(spark, root, 3))["r", "f1"] == "v1"
    assert snapshots.drop_versions(spark, root, keep=2) == []
    assert snapshots.commit_blocks(spark, root, blocks(spark, [("r", "f1", "last")])) == 5
