import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import lmscore as m

SF = "/root/testdata/sf0.01"


def test_probabilities_sum_to_one():
    model = m.initial(1)
    context = np.array([[1, 2, 3, m.PAD]] * m.VOCABULARY)
    total = np.exp(m.log_probabilities(model, context, np.arange(m.VOCABULARY)).astype(float)).sum()
    assert total == pytest.approx(1, abs=1e-4)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(2)
    context, token = rng.integers(0, m.VOCABULARY + 1, (40, 4)), rng.integers(0, m.VOCABULARY, 40)
    trainer = m.Trainer(m.initial(3))
    trainer.learn(context, token)
    # After one step of Adam the first moment is a tenth of the gradient of the mean loss.
    start = m.flatten(m.initial(3)).astype(np.float64)
    gradient = m.flatten(trainer.m) * 10
    direction = rng.normal(size=len(start)) * (gradient != 0)
    step = 1e-3
    def loss(v):
        return -m.log_probabilities(m.unflatten(v), context, token).astype(float).mean()
    measured = (loss(start + step * direction) - loss(start - step * direction)) / (2 * step)
    assert measured == pytest.approx(float(gradient @ direction), rel=0.05, abs=0.02)


def test_scores_are_sums_over_positions():
    text = pa.array(["a b c a b", None, "", " z "])
    vocab = m.words(*m.text_bytes(pa.array(["a b c"])))[0]
    token, per_row = m.tokens(text, vocab)
    assert per_row.tolist() == [5, 0, 0, 1] and token[:5].tolist() == [0, 1, 2, 0, 1] and token[5] >= m.VOCABULARY - m.ENDINGS
    context = m.contexts(token, per_row)
    assert context[0].tolist() == [m.PAD, m.PAD, 1, 2] and context[4].tolist() == [2, 0, m.PAD, m.PAD]
    assert context[5].tolist() == [m.PAD] * 4


def test_learns_from_the_corpus(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = m.score_documents(documents).collect()
    assert len(rows) == documents.count()
    total, n = sum(r["log_prob"] for r in rows), sum(r["n_tokens"] for r in rows)
    assert total / n > -np.log(m.VOCABULARY) + 1
    assert all(r["mean_log_prob"] == pytest.approx(r["log_prob"] / r["n_tokens"]) for r in rows if r["n_tokens"])


def test_vocabulary_counts_all(docs):
    rows = docs([(i, "the the cat") for i in range(5)] + [(9, "Cat dog"), (None, None)])
    vocab = m.vocabulary(rows.select("doc_id", "text"))
    expected = m.words(*m.text_bytes(pa.array(["the cat dog"])))[0]
    assert vocab.tolist() == expected.tolist()


def test_defined_cases(docs):
    rows = docs([(1, None), (2, ""), (None, "a b"), (3, "a " * 300_000), (3, "x" * 1_000_000)])
    got = [(r["doc_id"], r["n_tokens"], r["log_prob"] <= 0, r["mean_log_prob"] is None) for r in m.score_documents(rows, rounds=1).collect()]
    assert got == [(1, 0, True, True), (2, 0, True, True), (None, 2, True, False), (3, 300_000, True, False), (3, 1, True, False)]
    assert m.score_documents(docs([]), rounds=1).collect() == []


def test_defined_cases_of_the_query(docs):
    """With the shares of rare words: null ids, empty texts, repeated rows, long texts, no rows."""
    texts = [(1, None), (2, ""), (None, "a b"), (3, "a " * 300_000), (3, "x" * 1_000_000), (4, "a b"), (4, "a b")]
    got = [tuple(r) for r in m.score_documents(docs(texts), rounds=1, whole_words=True).collect()]
    assert sorted((g[0] or 0, g[1]) for g in got) == [(0, 2), (1, 0), (2, 0), (3, 1), (3, 300_000), (4, 2), (4, 2)]
    assert all((g[3] is None) == (g[1] == 0) and g[2] <= 0 for g in got)
    assert len({round(g[2], 4) for g in got if g[1] == 2}) == 1
    assert m.score_documents(docs([]), rounds=1, whole_words=True).collect() == []


def test_block_sums():
    rows = pa.table({
        "block": [3, 3, 3], "part": [1, 1, 1], "n": [1.0, 2.0, 4.0],
        "total": pa.array([np.full(5, float(k)).tobytes() for k in (1, 2, 3)], pa.binary()),
    })
    made = m._sum_table(rows).to_pylist()
    assert len(made) == 1 and made[0]["n"] == 7 and np.frombuffer(made[0]["total"]).tolist() == [6.0] * 5


def test_trains_on_every_token(monkeypatch):
    vocab = m.words(*m.text_bytes(pa.array(["a b c"])))[0]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b c " * 40, "c a " * 30])], names=["doc_id", "text"])
    seen = []
    monkeypatch.setattr(m.Trainer, "learn", lambda self, context, token: seen.extend(zip(map(tuple, context.tolist()), token.tolist())))
    weights = [b.column("n")[0].as_py() for k in range(3) for b in m._trained([batch], vocab, m.flatten(m.initial()), k, 3)]
    token, per_row = m.tokens(batch.column(1), vocab)
    assert sum(weights) == len(token) == 180
    assert sorted(seen) == sorted(zip(map(tuple, m.contexts(token, per_row).tolist()), token.tolist()))


def test_whole_words_tells_all_words_apart(docs, monkeypatch):
    monkeypatch.setattr(m, "VOCABULARY", m.ENDINGS + 2)
    text = [(1, "the the the a a a xing Ying"), (2, "the a zing xing XING"), (2, "ying the a"), (3, None)]
    rows = docs(text).select("doc_id", "text")
    vocab, total = m.counted_vocabulary(rows)
    assert len(vocab) == 2 and total.sum() == 6 and total.max() == 6
    monkeypatch.undo()
    # 6 words of one ending: xing 3, ying 2, zing 1.
    model, shares = m.initial(), np.log(np.array([3, 2, 1]) / 6)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in text]), pa.array([r[1] for r in text])], names=["doc_id", "text"])
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    plain = next(iter(m._scored([batch], vocab, model))).column(2).to_pylist()
    parts = pa.Table.from_batches(list(m._scored_in_parts([batch], vocab, model, total, 1)))
    added = m._word_counts(parts.slice(1).select(["shard", "chunk", "keys", "rows", "counts"]))
    found = m._chunk_scores(parts.slice(0, 1).select(["chunk", "docs", "nulls", "n_tokens", "log_prob"]), added)
    own = found.column("log_prob").to_pylist()
    assert found.column("doc_id").to_pylist() == [1, 2, 2, 3] and found.column("mean_log_prob").to_pylist()[3] is None
    expected = [shares[0] + shares[1], shares[2] + 2 * shares[0], shares[1], 0]
    assert [own[k] - plain[k] for k in range(4)] == pytest.approx(expected, abs=1e-4)


def test_query_scores_whole_words(spark):
    """A document of words that occur once in the corpus is less likely by their shares."""
    documents = spark.read.parquet(f"{SF}/documents.parquet").limit(300).select("doc_id", "text").cache()
    whole = {r["doc_id"]: r for r in m.score_documents(documents, 1, whole_words=True).collect()}
    tokens = {r["doc_id"]: r for r in m.score_documents(documents, 1).collect()}
    vocab, total = m.counted_vocabulary(documents)
    texts = documents.collect()
    token, word, per_row = m._tokens_and_words(pa.array([r["text"] for r in texts]), vocab)
    key, back, n = np.unique(word, return_inverse=True, return_counts=True)
    rare = token >= m.VOCABULARY - m.ENDINGS
    assert total.sum() == rare.sum()
    share = np.where(rare, np.log(n[back]) - np.log(np.maximum(1, total[np.maximum(0, token - m.VOCABULARY + m.ENDINGS)])), 0)
    row = np.repeat(np.arange(len(texts)), per_row)
    for k, r in enumerate(texts):
        assert whole[r["doc_id"]]["n_tokens"] == tokens[r["doc_id"]]["n_tokens"] == per_row[k]
        assert whole[r["doc_id"]]["log_prob"] - tokens[r["doc_id"]]["log_prob"] == pytest.approx(share[row == k].sum(), rel=0.02, abs=0.5)


def test_a_batch_needs_little_fresh_memory():
    """What a batch takes and gives back costs more time than its arithmetic."""
    rng = np.random.default_rng(4)
    context, token = rng.integers(0, m.VOCABULARY + 1, (m.BATCH, 4)), rng.integers(0, m.VOCABULARY, m.BATCH)
    trainer = m.Trainer(m.initial())
    trainer.learn(context, token)
    tracemalloc.start()
    trainer.learn(context, token)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5e6
