import itertools

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import langcrf as m

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return m.learn(spark.read.parquet(f"{SF}/documents.parquet"))


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(3)
    e, a = rng.normal(size=(11, 3)), rng.normal(size=(3, 3))
    start, size = np.array([0, 4, 5]), np.array([4, 1, 6])
    posterior, pairs = m.forward_backward(e, start, size, a)
    expected, moves = np.zeros_like(e), np.zeros_like(a)
    for s, n in zip(start, size):
        weights = {}
        for path in itertools.product(range(3), repeat=int(n)):
            score = sum(e[s + t, y] for t, y in enumerate(path)) + sum(a[x, y] for x, y in zip(path, path[1:]))
            weights[path] = np.exp(score)
        total = sum(weights.values())
        for path, w in weights.items():
            for t, y in enumerate(path):
                expected[s + t, y] += w / total
            for x, y in zip(path, path[1:]):
                moves[x, y] += w / total
    assert np.allclose(posterior, expected) and np.allclose(pairs, moves)


def test_held_out_accuracy(spark, model):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = m.identify(documents, model).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and len(held) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_switching_text(model):
    import duckdb

    rows = duckdb.sql(f"SELECT lang, text FROM '{SF}/documents.parquet' WHERE lang IN ('de', 'es') AND length(text) > 400").fetchall()
    texts = {lang: " ".join(text.split()[:40]) for lang, text in rows}
    posterior, sizes = m.word_labels(model, pa.array([texts["de"] + " " + texts["es"]]))
    names = np.array(model["langs"])[posterior.argmax(axis=1)]
    assert (names[: sizes[0] // 2] == "de").mean() > 0.9 and (names[sizes[0] // 2 :] == "es").mean() > 0.9
    assert (np.diag(model["transition"]) > model["transition"].mean(axis=1)).all()


def test_defined_cases(docs, model):
    rows = docs([(1, None), (2, ""), (3, "123 ### 45"), (None, "the and of"), (5, "É"), (6, "the " * 200_000), (6, "the")])
    got = [tuple(r) for r in m.identify(rows, model).collect()]
    assert got[:3] == [(1, got[0][1], "und", 0.0), (2, got[1][1], "und", 0.0), (3, got[2][1], "und", 0.0)]
    assert got[3][:2] == (None, False) and got[3][2] in model["langs"]
    assert all(g[2] in model["langs"] for g in got[3:])
    assert m.identify(docs([]), model).collect() == []


def test_nothing_to_learn_from(docs):
    empty = docs([])
    assert m.identify(docs([(1, "text")]), m.learn(empty)).first()["lang_pred"] == "und"
    assert m.learn(docs([(i, "12 34") for i in range(9)]))["langs"] == []


def test_chains_hold_the_whole_text():
    words = [str(n) for n in range(1000)]
    assert " ".join(m.chains_of(" ".join(words), 32)).split() == words
    assert len(m.chains_of(" ".join(words), 32)) == 32
    assert m.chains_of("") == [] and m.chains_of("a b") == ["a b"]


@pytest.mark.parametrize("step", [1, 3, 64])
def test_cuts_carry_what_is_beyond_them(model, step):
    import duckdb

    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 60").fetchall()]
    rows = pa.array(texts + [None, "", " ".join(t or "" for t in texts[:20])])
    whole, sizes = m.word_labels(model, rows, step=10**9)
    cut, again = m.word_labels(model, rows, step=step)
    assert (sizes == again).all() and np.allclose(whole, cut, atol=1e-9)


def test_sample_of_labelled_rows(docs, monkeypatch):
    monkeypatch.setattr(m, "WORDS", 50)
    monkeypatch.setattr(m, "LONG", 30)
    rows = docs([(i, "one two three four five six seven eight nine ten") for i in range(40)] + [(99, "long " * 31)])
    chains = m.training_chains(rows.select("doc_id", "text", "lang").withColumn("text", rows.text))
    assert all(lang == "en" for lang, _ in chains) and not any("long" in c for _, c in chains)
    only = m.training_chains(docs([(99, "long " * 31)]).select("doc_id", "text", "lang"))
    assert sum(len(c.split()) for _, c in only) == 31
    assert m.words_per_language(4) == 50 and m.words_per_language(2000) == 4
