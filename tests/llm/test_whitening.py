"""Whitening: exact sums, the decomposition and the query against numpy and whole numbers."""

import math
import os

import numpy as np
import pytest

from corpusloom.llm import whitening
from corpusloom.llm.whitening import decomposed, deviations, fit, one_sided_jacobi, pivoted_cholesky, whiten

SF_DIR = "/root/testdata/sf0.001"


def brute(rows):
    """{component: ...} by numpy's symmetric solver, and the whole numbers of each row."""
    kept = [
        (i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v))
        for i, v in rows
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    fitted = sorted({x for _, x in kept})
    n = len(fitted)
    sums = [sum(column) for column in zip(*fitted)]
    c = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fitted])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return kept, n, sums, values[::-1], vectors[:, ::-1].T


def compare(rows, got):
    kept, n, sums, values, vectors = brute(rows)
    width = min(16, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == width * len(kept)
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    signs = {}
    for i, x in kept:
        assert sorted(by_id[i]) == list(range(1, width + 1))
        off = [n * a - s for a, s in zip(x, sums)]
        for k, r in by_id[i].items():
            assert r["n"] == n and r["deviation"] == sum(o * o for o in off)
            want = float(np.dot([o / n for o in off], vectors[k - 1]) / math.sqrt(values[k - 1]))
            signs.setdefault(k, 1 if abs(want - r["whitened"]) < abs(want + r["whitened"]) else -1)
            assert r["whitened"] == pytest.approx(signs[k] * want, abs=1e-7)
            assert r["explained"] == pytest.approx(values[k - 1] / values.sum(), rel=1e-9)
            assert 0 <= r["identity_error"] < 1e-9


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_query_is_brute_force(spark):
    rows = [tuple(r)[:2] for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()]
    compare(rows, whitening.op12_whitening(spark, SF_DIR).collect())


def written(spark, tmp_path, rows):
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as x", "'a' as key", "2 as size")
    table.write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return whitening.op12_whitening(spark, str(tmp_path)).collect()


def test_defined_cases(spark, tmp_path):
    draw = np.random.default_rng(3)
    good = [(i, (draw.normal(size=5) * [9, 4, 2, 1, 0.5]).tolist()) for i in range(60)]
    same = [(100 + i, good[0][1]) for i in range(40)]
    bad = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [math.nan] * 5), (203, [1.0, 1.0, math.inf, 1.0, 1.0]), (204, [1e300, 1.0, 1.0, 1.0, 1.0]), (205, [])]
    other = [(206, [1.0, 2.0])]
    got = written(spark, tmp_path, good + same + bad + other)
    assert {r["vec_id"] for r in got} == {i for i, _ in good + same}
    compare(good + same, got)
    assert got[0]["n"] == 60


def test_low_rank_and_none(spark, tmp_path):
    line = [(i, [float(i), 2.0 * i, 7.0]) for i in range(20)]
    compare(line, written(spark, tmp_path, line))
    assert written(spark, tmp_path, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    assert written(spark, tmp_path, []) == []
    assert written(spark, tmp_path, [(1, None), (2, [])]) == []


def test_repeated_and_missing_ids(spark, tmp_path):
    got = written(spark, tmp_path, [(None, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [0.0, 3.0]), (None, [2.0, 2.0])])
    assert len(got) == 10 and {r["n"] for r in got} == {3}


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(2**50) + 1000 * i, float(i % 7)]) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    model = fit(table)
    x = [(math.floor(64 * a) + 1_000_000, math.floor(64 * b) + 1_000_000) for _, (a, b) in rows]
    assert model.sums == tuple(sum(c) for c in zip(*x))
    got = {r["vec_id"]: r["deviation"] for r in whiten(table, model).filter("component = 1").collect()}
    for (i, _), v in zip(rows, x):
        exact = sum((300 * a - s) ** 2 for a, s in zip(v, model.sums))
        assert got[i] == (exact if exact < 2**63 else None)


def test_deviations_at_the_edge():
    x = np.array([[0], [2**30]], dtype=np.int64)
    assert deviations(x, 2, (2**30,)) == [2**60, 2**60]
    assert deviations(np.array([[0], [2**33]], dtype=np.int64), 2, (2**33,)) == [None, None]


@pytest.mark.parametrize("rank", [1, 5, 30, 40])
def test_decomposition(rank):
    draw = np.random.default_rng(rank)
    b = draw.normal(size=(40, rank)) * np.logspace(0, -5, rank)
    a = b @ b.T
    factor = pivoted_cholesky(a)
    assert factor.shape[1] <= rank + 1
    assert np.abs(factor @ factor.T - a).max() < 1e-12 * a.max()
    g = one_sided_jacobi(factor)
    gram = g.T @ g
    scale = np.sqrt(np.outer(np.diag(gram), np.diag(gram)))
    assert np.abs(gram / scale - np.eye(len(gram))).max() < 1e-13
    values, units = decomposed(a)
    assert (np.diff(values) <= 0).all()
    assert np.allclose(values[:rank], np.linalg.eigvalsh(a)[::-1][: len(values)][:rank], rtol=1e-6, atol=1e-13)
    assert np.abs(units @ units.T - np.eye(len(units))).max() < 1e-12
