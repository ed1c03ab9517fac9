import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import quality as m

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return m.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_held_out_ranking(spark, model):
    rows = m.score_quality(spark.read.parquet(f"{SF}/documents.parquet"), model)
    assert rows.count() == 1000
    held = rows.filter("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good = [r["score"] for r in held if r["quality"] == 1]
    bad = [r["score"] for r in held if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in held)


def test_gradients_reach_every_part():
    # A bag is good if one passage has the sign: only attention can find it.
    rng = np.random.default_rng(0)
    bags = []
    for k in range(640):
        x = rng.normal(0, 1, (6, m.WIDTH)).astype(np.float32)
        if k % 2:
            x[rng.integers(6), :8] += 6
        bags.append((k % 2, x))
    model = m.train(bags[:600])
    score = m.scores(model, np.concatenate([x for _, x in bags[600:]]), np.full(40, 6))
    assert ((score > 0.5) == (np.arange(40) % 2 == 1)).mean() > 0.9
    x = bags[1][1]
    weight = m.attention(model, x, np.array([6]))
    assert weight.sum() == pytest.approx(1, abs=1e-5) and weight.argmax() == x[:, :8].sum(axis=1).argmax()


def test_passages():
    text = pa.array(["word " * 130, None, "", "  ", "\n one\n"])
    x, count = m.passages(text)
    assert count.tolist() == [3, 1, 1, 1, 1] and x.shape == (7, m.WIDTH)
    assert not x[3:6].any() and x[6].any()
    # A row's passages don't depend on the rows beside it.
    for i in range(len(text)):
        alone, _ = m.passages(text.slice(i, 1))
        assert np.allclose(alone, x[sum(count[:i]) : sum(count[: i + 1])])


def test_defined_cases(docs, spark, model):
    rows = docs([(1, None), (2, ""), (None, "some text here"), (3, "x" * 1_000_000), (3, "again"), (4, "a " * 300_000)])
    got = m.score_quality(rows, model).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert m.score_quality(docs([]), model).collect() == []


def test_labels_of_one_class_or_none(docs, spark):
    one = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id bigint, quality int")
    some = docs([(i, "text of it") for i in range(20)])
    assert {r["score"] for r in m.score_quality(some, m.learn(some, one)).collect()} == {1.0}
    assert {r["score"] for r in m.score_quality(some, m.learn(some, one.filter("false"))).collect()} == {0.5}
