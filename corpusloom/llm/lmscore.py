"""Language-model scores: masked pseudo-likelihood of a bidirectional window network.

Every token is predicted from the ``SIDE`` tokens on either side, itself masked; the sum of
these conditional log-probabilities is the document's score. The network is numpy: context
embeddings, one tanh layer, and a softmax in two steps (the token's group, then the token
in the group).

The network's tokens are the most frequent words, counted over all documents; other words
share tokens by their last two bytes, A-Z lower-cased. With ``whole_words`` (the query) such
a word's probability is that of its token times its share of the token, by the counts of all
words of the corpus, so all words are told apart and their number grows with the corpus.
The counts are never gathered: words meet by their hash, and only sums go back to a document.
Without it a score is that of the tokens.

Training goes over all documents in ``ROUNDS`` rounds: each task starts from the common
parameters, learns from the tokens of its documents whose turn it is and sends its
parameters; their mean, weighted by tokens, starts the next round. Every token has its turn
in one of the rounds. So what is learned from grows with the corpus, and what any place
gathers does not: the parameters travel in blocks, and blocks are summed in two steps.

Defined results: a null or empty text, or one without words, has 0 tokens, log-probability 0
and no mean. Repeated rows and ids are scored each, rows without an id too. An empty table
gives no rows. Columns are picked by name, others don't matter. A very long text is worked
on in one task. Sums of floats depend on their order, so scores of two runs may differ in
late digits, and the model depends on how the table is split into tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER, SPACES, by_value, chunks, mix, shard_count, table, text_bytes, words
from corpusloom.session import stage

by_value(__name__)

SIDE = 2
GROUPS, GROUP_SIZE = 32, 32
VOCABULARY = GROUPS * GROUP_SIZE
ENDINGS = 64  # tokens for words outside the vocabulary
PAD = VOCABULARY  # beyond the document
EMBEDDING, HIDDEN = 16, 32
BATCH, RATE = 4096, 1.5e-2
ROUNDS = 2
BLOCK = 4096  # parameters sent as one value
SUMS = 64  # first sums of a block

SHAPES = {
    "emb": (VOCABULARY + 1, EMBEDDING), "w": (2 * SIDE * EMBEDDING, HIDDEN), "b": (HIDDEN,),
    "group": (HIDDEN, GROUPS), "group_b": (GROUPS,), "out": (GROUPS, HIDDEN, GROUP_SIZE), "out_b": (GROUPS, GROUP_SIZE),
}


# Vocabulary ------------------------------------------------------------------


def _by_shard(key: np.ndarray, shards: int, *values: np.ndarray) -> list[tuple]:
    """(shard, keys, values ...) as bytes, one row per shard of the keys."""
    shard = (mix(key) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    shard, columns = shard[order], [x[order] for x in (key, *values)]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]))
    return [(int(shard[a]), *(x[a:b].tobytes() for x in columns)) for a, b in zip(cuts[:-1], cuts[1:])]


def _counts(batches, shards: int):
    for batch in chunks(batches):
        data, offsets = text_bytes(batch.column(1))
        word, starts, _ = words(data, offsets)
        if not len(word):
            continue
        order = np.argsort(word)  # equal words have equal endings, whichever comes first
        word = word[order]
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        n = np.diff(np.concatenate((first, [len(word)])))
        rows = _by_shard(word[first], shards, n.astype(np.uint32), _endings(data, starts)[order[first]].astype(np.uint8))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["shard", "keys", "counts", "endings"])


def _joined(rows: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)


def _most_frequent(rows: pa.Table) -> pa.Table:
    """The shard's most frequent words, and without a word the count of each ending."""
    key, ending = _joined(rows, "keys", np.uint64), _joined(rows, "endings", np.uint8)
    n = _joined(rows, "counts", np.uint32).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, n, ending = key[order], n[order], ending[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    key, n, ending = key[starts].view(np.int64), np.add.reduceat(n, starts), ending[starts]
    total = np.zeros(ENDINGS, np.int64)
    np.add.at(total, ending, n)
    top = np.lexsort((key, -n))[:VOCABULARY]
    return pa.table({
        "word": pa.array(np.concatenate((key[top], np.zeros(ENDINGS, np.int64))), mask=np.arange(len(top) + ENDINGS) >= len(top)),
        "n": pa.array(np.concatenate((n[top], total))),
        "ending": pa.array(np.concatenate((ending[top], np.arange(ENDINGS))).astype(np.int32)),
    })


def counted_vocabulary(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent words, most frequent first, and how many of the other
    words have each ending. A word is counted in one shard, so the shards' most frequent
    words hold those of the corpus."""
    shards = shard_count(documents)
    counted = documents.mapInArrow(lambda b: _counts(b, shards), "shard int, keys binary, counts binary, endings binary")
    best = stage(counted.groupBy("shard").applyInArrow(_most_frequent, "word bigint, n bigint, ending int"))
    total = np.zeros(ENDINGS, np.int64)
    for r in best.filter("word is null").groupBy("ending").agg(F.sum("n").alias("n")).collect():
        total[r["ending"]] = r["n"]
    rows = best.filter("word is not null").orderBy(F.desc("n"), "word").limit(VOCABULARY - ENDINGS).collect()
    for r in rows:
        total[r["ending"]] -= r["n"]
    return np.array([r["word"] for r in rows], np.int64).view(np.uint64), total


def vocabulary(documents: DataFrame) -> np.ndarray:
    return counted_vocabulary(documents)[0]


def _endings(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of each word's last two bytes; words of equal hash have the same one."""
    # A word's bytes are all that isn't white space up to the next word.
    last = starts + np.add.reduceat(~SPACES[data], starts, dtype=np.int64) - 1
    before = np.where(last > starts, LOWER[data[last - 1]], 0).astype(np.uint64)
    return (mix(LOWER[data[last]].astype(np.uint64) * np.uint64(257) + before) % np.uint64(ENDINGS)).astype(np.int64)


def tokens(text: pa.Array, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token of every word of the rows in order, and words per row."""
    token, _, per_row = _tokens_and_words(text, vocab)
    return token, per_row


def _tokens_and_words(text: pa.Array, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = text_bytes(text)
    word, starts, per_row = words(data, offsets)
    if not len(word):
        return np.zeros(0, np.int64), word, per_row
    token = VOCABULARY - ENDINGS + _endings(data, starts)
    if len(vocab):
        # Look words up by their top bits first; few words of a text pass that.
        short = np.zeros(1 << 16, bool)
        short[(vocab >> np.uint64(48)).astype(np.int64)] = True
        likely = np.flatnonzero(short[(word >> np.uint64(48)).astype(np.int64)])
        order = np.argsort(vocab)
        known = vocab[order]
        place = np.minimum(np.searchsorted(known, word[likely]), len(vocab) - 1)
        hit = known[place] == word[likely]
        token[likely[hit]] = order[place[hit]]
    return token, word, per_row


def contexts(token: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    """The tokens on both sides of every token, ``PAD`` beyond its row."""
    rows = len(per_row)
    row = np.repeat(np.arange(rows), per_row)
    at = np.arange(len(token)) + SIDE * (row + 1)
    padded = np.full(len(token) + SIDE * (rows + 1), PAD, np.uint16)
    padded[at] = token
    return np.column_stack([padded[at + d] for d in range(-SIDE, SIDE + 1) if d])


# Network ---------------------------------------------------------------------


def initial(seed: int = 5) -> dict:
    rng = np.random.default_rng(seed)
    made = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in SHAPES.items()}
    return made | {k: np.zeros(SHAPES[k], np.float32) for k in ("b", "group_b", "out_b")}


def flatten(model: dict) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in SHAPES]).astype(np.float32)


def unflatten(values: np.ndarray) -> dict:
    out, at = {}, 0
    for k, shape in SHAPES.items():
        n = math.prod(shape)
        out[k] = values[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


class Buffers:
    """Arrays that are used again from batch to batch: getting fresh memory for each one takes
    longer than filling it."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        n = math.prod(shape)
        if name not in self.held or len(self.held[name]) < n:
            self.held[name] = np.empty(n, np.float32)
        return self.held[name][:n].reshape(shape)


def _exponents(x: np.ndarray) -> np.ndarray:
    """exp of logits, one column per token, up to a factor per column; in place."""
    x -= x.max(axis=0)
    return np.exp(x, out=x)


def _picked(x: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """Log-probability of each column's choice; the logits are overwritten."""
    at = np.arange(x.shape[1])
    x -= x.max(axis=0)
    chosen = x[choice, at]
    return chosen - np.log(np.exp(x, out=x).sum(axis=0))


def _outer(model: dict, h: np.ndarray, buffer: Buffers) -> np.ndarray:
    """Logits of the groups, one column per token."""
    out = np.matmul(model["group"].T, h.T, out=buffer("outer", GROUPS, len(h)))
    out += model["group_b"][:, None]
    return out


def _inner(model: dict, h: np.ndarray, cuts: list[int], buffer: Buffers) -> np.ndarray:
    """Logits inside its group for each token, one column per token in order of the groups."""
    out = buffer("inner", GROUP_SIZE, len(h))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if a < b:
            np.matmul(model["out"][k].T, h[a:b].T, out=out[:, a:b])
            out[:, a:b] += model["out_b"][k][:, None]
    return out


def log_probabilities(model: dict, context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Log-probability of each token given its context."""
    out = np.empty(len(token), np.float32)
    token = token.astype(np.uint16)
    order = np.argsort(token, kind="stable")  # by group
    # The first layer's part of each context position is one row per token.
    parts = [model["emb"] @ model["w"][i * EMBEDDING : (i + 1) * EMBEDDING] for i in range(2 * SIDE)]
    parts[0] = parts[0] + model["b"]
    buffer = Buffers()
    for a in range(0, len(order), 1 << 13):
        pick = order[a : a + (1 << 13)]
        near, own = context[pick], token[pick]
        h = np.take(parts[0], near[:, 0], axis=0, out=buffer("h", len(pick), HIDDEN), mode="clip")
        for i in range(1, 2 * SIDE):
            h += np.take(parts[i], near[:, i], axis=0, out=buffer("part", len(pick), HIDDEN), mode="clip")
        np.tanh(h, out=h)
        group, place = own // GROUP_SIZE, own % GROUP_SIZE
        score = _picked(_outer(model, h, buffer), group)
        cuts = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        out[pick] = score + _picked(_inner(model, h, cuts, buffer), place)
    return out


class Trainer:
    """Adam steps on minibatches, from given parameters."""

    def __init__(self, model: dict):
        self.model = {k: v.copy() for k, v in model.items()}
        self.m = {k: np.zeros_like(v) for k, v in model.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.items()}
        self.step = 0
        self.buffer = Buffers()

    def learn(self, context: np.ndarray, token: np.ndarray) -> None:
        p, n, buffer = self.model, len(token), self.buffer
        token = token.astype(np.uint16)
        order = np.argsort(token, kind="stable")  # by group
        context, token = context[order], token[order]
        group, place, at = token // GROUP_SIZE, token % GROUP_SIZE, np.arange(n)
        flat = context.ravel().astype(np.uint16)
        x = np.take(p["emb"], flat, axis=0, out=buffer("x", len(flat), EMBEDDING), mode="clip").reshape(n, -1)
        h = np.matmul(x, p["w"], out=buffer("h", n, HIDDEN))
        h += p["b"]
        np.tanh(h, out=h)

        # Gradients by the logits, one column per token: what is summed lies in a row then.
        def gradient(logits: np.ndarray, choice: np.ndarray) -> np.ndarray:
            d = _exponents(logits)
            d /= d.sum(axis=0) * n
            d[choice, at] -= np.float32(1 / n)
            return d

        dg = gradient(_outer(p, h, buffer), group)
        dh = np.matmul(dg.T, p["group"].T, out=buffer("dh", n, HIDDEN))
        cuts = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        d = gradient(_inner(p, h, cuts, buffer), place)
        grad = {"out": np.zeros_like(p["out"]), "out_b": np.zeros_like(p["out_b"]), "emb": np.zeros_like(p["emb"])}
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if a < b:
                own = d[:, a:b]
                dh[a:b] += np.matmul(own.T, p["out"][k].T, out=buffer("own", b - a, HIDDEN))
                grad["out"][k], grad["out_b"][k] = (own @ h[a:b]).T, own.sum(axis=1)
        grad |= {"group": h.T @ dg.T, "group_b": dg.sum(axis=1)}
        h *= h
        dh *= np.subtract(1, h, out=h)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        dx = np.matmul(dh, p["w"].T, out=buffer("dx", *x.shape)).reshape(-1, EMBEDDING)
        dx = np.take(dx, order, axis=0, out=buffer("sorted", *dx.shape), mode="clip")
        grad["emb"][flat[starts]] = np.add.reduceat(dx, starts, axis=0)
        grad |= {"w": x.T @ dh, "b": dh.sum(axis=0)}
        self.step += 1
        for k, g in grad.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            rate = RATE * (1 - 0.99**self.step) ** 0.5 / (1 - 0.9**self.step)
            p[k] -= rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)


# Spark -----------------------------------------------------------------------


def _trained(batches, vocab: np.ndarray, start: np.ndarray, number: int, rounds: int):
    trainer, seen, held = Trainer(unflatten(start)), 0, []

    def learn(last: bool) -> None:
        nonlocal held
        context, token = (np.concatenate(x) for x in zip(*held))
        rest = 0 if last else len(token) % BATCH
        whole = len(token) - rest
        order = np.random.default_rng(whole).permutation(whole)
        for a in range(0, whole, BATCH):
            trainer.learn(context[order[a : a + BATCH]], token[order[a : a + BATCH]])
        held = [(context[whole:], token[whole:])] if rest else []

    for batch in chunks(batches):
        token, per_row = tokens(batch.column(1), vocab)
        # Over the rounds, every token once.
        pick = np.arange(number, len(token), rounds)
        if len(pick):
            held.append((contexts(token, per_row)[pick], token[pick]))
            seen += len(pick)
            if sum(len(t) for _, t in held) >= 64 * BATCH:
                learn(False)
    if held:
        learn(True)
    if seen:
        values = flatten(trainer.model).astype(np.float64) * seen
        blocks = [values[a : a + BLOCK] for a in range(0, len(values), BLOCK)]
        from pyspark import TaskContext

        task = TaskContext.get()
        part = np.full(len(blocks), task.partitionId() % SUMS if task else 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(blocks))), pa.array(part), pa.array(np.full(len(blocks), float(seen))),
             pa.array([b.tobytes() for b in blocks], pa.binary())], names=["block", "part", "n", "total"],
        )


_SUM = "block bigint, part bigint, n double, total binary"


def _sum_table(rows: pa.Table) -> pa.Table:
    """One row for all vectors of a group: those of the tasks of one number, then of all numbers."""
    total = sum(np.frombuffer(x.as_buffer()) for x in rows.column("total"))
    return rows.slice(0, 1).drop_columns(["n", "total"]).append_column(
        "n", pa.array([float(rows.column("n").to_numpy().sum())])
    ).append_column("total", pa.array([total.tobytes()], pa.binary()))


def train(documents: DataFrame, vocab: np.ndarray, rounds: int = ROUNDS) -> dict:
    values = flatten(initial())
    for number in range(rounds):
        start = values
        trained = documents.mapInArrow(lambda b: _trained(b, vocab, start, number, rounds), _SUM)
        for keys in (["block", "part"], ["block"]):
            trained = trained.groupBy(*keys).applyInArrow(_sum_table, _SUM)
        rows = sorted(trained.collect(), key=lambda r: r["block"])  # one row per block of parameters
        if rows:
            values = np.concatenate([np.frombuffer(r["total"]) / r["n"] for r in rows]).astype(np.float32)
    return unflatten(values)


def _scored(batches, vocab: np.ndarray, model: dict):
    for batch in chunks(batches):
        token, per_row = tokens(batch.column(1), vocab)
        total = np.zeros(len(per_row))
        if len(token):
            each = log_probabilities(model, contexts(token, per_row), token).astype(np.float64)
            total = np.bincount(np.repeat(np.arange(len(per_row)), per_row), weights=each, minlength=len(per_row))
        mean = pa.array(total / np.maximum(per_row, 1), mask=per_row == 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(per_row.astype(np.int64)), pa.array(total), mean],
            names=["doc_id", "n_tokens", "log_prob", "mean_log_prob"],
        )


_PARTS = (
    "chunk bigint, shard int, docs binary, nulls binary, n_tokens binary, log_prob binary, keys binary, rows binary, counts binary"
)


def _scored_in_parts(batches, vocab: np.ndarray, model: dict, total: np.ndarray, shards: int):
    """For every chunk of documents one row with the scores of their tokens and the logarithms
    of what their words' shares are of, and one per shard with the words whose counts are
    missing. Documents are told by their row in the chunk."""
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 40
    share = np.concatenate((np.zeros(VOCABULARY - ENDINGS), np.log(np.maximum(total, 1))))
    names = [x.split()[0] for x in _PARTS.split(", ")]
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 7)
    for batch in chunks(batches):
        token, word, per_row = _tokens_and_words(batch.column(1), vocab)
        n = len(per_row)
        row = np.repeat(np.arange(n), per_row)
        score = np.zeros(n)
        if len(token):
            each = log_probabilities(model, contexts(token, per_row), token) - share[token]
            score = np.bincount(row, weights=each, minlength=n)
        docs = batch.column(0)
        null = docs.is_null().to_numpy(zero_copy_only=False)
        docs = docs.fill_null(0).to_numpy().astype(np.int64)
        own = (docs, null, per_row.astype(np.int64), score)
        out = [(chunk, None, *(x.tobytes() for x in own), None, None, None)]
        rare = np.flatnonzero(token >= VOCABULARY - ENDINGS)
        if len(rare):
            key, place = word[rare], row[rare]
            order = np.lexsort((key, place))
            key, place = key[order], place[order]
            first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (place[1:] != place[:-1]))))
            often = np.diff(np.concatenate((first, [len(key)])))
            found = _by_shard(key[first], shards, place[first].astype(np.uint32), often.astype(np.uint32))
            out += [(chunk, shard, None, None, None, None, *packed) for shard, *packed in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
        chunk += 1


_ADDED = "chunk bigint, rows binary, log_prob binary"


def _word_counts(rows: pa.Table) -> pa.Table:
    """What the counts of a shard's words add to the scores of each chunk's documents."""
    key, n = _joined(rows, "keys", np.uint64), _joined(rows, "counts", np.uint32)
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.add.reduceat(n[order].astype(np.int64), starts)
    added = np.empty(len(n))
    added[order] = np.repeat(np.log(count), np.diff(np.concatenate((starts, [len(key)]))))
    added *= n
    chunk, place, value, a = rows.column("chunk"), [], [], 0
    for packed in rows.column("rows").to_pylist():
        # A chunk's rows are in order.
        row = np.frombuffer(packed, np.uint32)
        starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        place.append(row[starts].tobytes())
        value.append(np.add.reduceat(added[a : a + len(row)], starts).tobytes())
        a += len(row)
    return pa.table({"chunk": chunk, "rows": pa.array(place, pa.binary()), "log_prob": pa.array(value, pa.binary())})


_SCORES = "doc_id bigint, n_tokens bigint, log_prob double, mean_log_prob double"


def _chunk_scores(own: pa.Table, added: pa.Table) -> pa.Table:
    """The documents of one chunk with what all shards add."""
    n, score = _joined(own, "n_tokens", np.int64), _joined(own, "log_prob", np.float64).copy()
    for rows, more in zip(added.column("rows").to_pylist(), added.column("log_prob").to_pylist()):
        score[np.frombuffer(rows, np.uint32)] += np.frombuffer(more)
    docs = pa.array(_joined(own, "docs", np.int64), mask=_joined(own, "nulls", bool))
    mean = pa.array(score / np.maximum(n, 1), mask=n == 0)
    return pa.table({"doc_id": docs, "n_tokens": pa.array(n), "log_prob": pa.array(score), "mean_log_prob": mean})


def score_documents(documents: DataFrame, rounds: int = ROUNDS, whole_words: bool = False) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob) by a model trained on the documents."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    vocab, total = counted_vocabulary(rows)
    model = train(rows, vocab, rounds)
    if not whole_words:
        return rows.mapInArrow(
            lambda b: _scored(b, vocab, model), _SCORES
        )
    shards = shard_count(rows)
    parts = stage(rows.mapInArrow(lambda b: _scored_in_parts(b, vocab, model, total, shards), _PARTS))
    counted = parts.filter("shard is not null").select("shard", "chunk", "keys", "rows", "counts")
    added = counted.groupBy("shard").applyInArrow(_word_counts, _ADDED)
    own = parts.filter("shard is null").select("chunk", "docs", "nulls", "n_tokens", "log_prob")
    return own.groupBy("chunk").cogroup(added.groupBy("chunk")).applyInArrow(_chunk_scores, _SCORES)


def op9_lmscore(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), whole_words=True)
