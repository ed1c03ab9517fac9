"""Language identification by a linear-chain conditional random field.

Every word of a text gets a label, so that code-switched text is told apart word by
word. A word's emission is the sum of weights of its affixes, its character bigrams and
trigrams and, if it is in the learned lexicon, the word itself; learned transitions
say how languages follow each other. Forward-backward gives the probability of each label
at each word, over the whole text as one chain: it is worked on in pieces, and what the
words before and behind a piece say about its ends is carried over the cuts exactly. A
document's language is the one with the largest mean probability, and that mean is its
score.

Training is fitted on a bounded sample of labelled rows: at most ``PER_LANGUAGE`` rows of
each of at most ``LANGUAGES`` languages, taken by a hash of their ids until a language has
``WORDS`` words (fewer if there are many languages, see ``words_per_language``). Rows of
more than ``LONG`` words come last. All text of a row in the sample is learned from, in
chains of ``CHAIN_WORDS`` words. Half of the chains are joined from two languages, from
which the transitions learn how often text switches. Everything is predicted for every
whole text.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is any
text if there is no row to learn from. Languages of equal probability: the first by name.
Rows with a null id are predicted, not learned from, and not held out. Repeated rows give
repeated results, an empty table none. Columns are picked by name, others don't matter. A
very long text takes memory in proportion to its words in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import by_value, chunks, crc_mod, mix, table

by_value(__name__)

UNKNOWN = "und"
LANGUAGES = 200
PER_LANGUAGE = 400
WORDS = 100_000  # per language, from which on no more rows are taken
LONG = 10_000  # words
CHAIN_WORDS = 32  # of a training chain
STEP_WORDS = 64  # of a piece in prediction
FEW_LANGUAGES = 16  # more: chains are followed whole, as pieces need a matrix each
BUCKETS = 1 << 17
LEXICON_COUNT = 3  # training occurrences from which on a word is in the lexicon
ROUNDS = 60


# Words and features ----------------------------------------------------------


def text_words(text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct letter-only lower-case words, the word number of each word in order,
    and the number of words of each row. Words without a letter are left out."""
    split = pc.utf8_split_whitespace(pc.fill_null(text.cast(pa.large_string()), ""))
    coded = pc.dictionary_encode(pc.list_flatten(split))
    core = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"[^\pL]+", "")
    core = pc.dictionary_encode(core)
    ids = core.indices.to_numpy()[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    names = core.dictionary.to_pylist()
    row = np.repeat(np.arange(len(text)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    if "" in names:
        keep = ids != names.index("")
        ids, row = ids[keep], row[keep]
    return names, ids.astype(np.int64), np.bincount(row, minlength=len(text))


def features(names: list[str], lexicon: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, bucket, value) of every feature, and the hash of each word. N-grams of a
    word share the value 1."""
    size = np.array([len(x) for x in names], dtype=np.int64)
    # "^word$" for each word, one after the other.
    code = np.frombuffer("".join(f"^{x}$" for x in names).encode("utf-32-le"), np.uint32).astype(np.uint64)
    end = np.cumsum(size + 2)
    start = end - size - 2
    owner = np.repeat(np.arange(len(names)), size + 2)
    out = []
    with np.errstate(over="ignore"):
        grams = {1: mix(code)}
        for k in (2, 3, 4):
            longer = np.zeros_like(code)
            if len(code) >= k:
                longer[: len(code) - k + 1] = mix(grams[k - 1][: len(code) - k + 1] * np.uint64(31) + code[k - 1 :] + np.uint64(k))
            grams[k] = longer
        for k in (2, 3):
            fits = np.flatnonzero(np.arange(len(code)) + k <= end[owner])
            out.append((owner[fits], grams[k][fits] + np.uint64(10 + k), 1.0 / np.maximum(1, size[owner[fits]] + 3 - k)))
        for k in (2, 3, 4):  # the boundary sign and one to three letters
            long = np.flatnonzero(size + 2 >= k)
            out.append((long, grams[k][start[long]] + np.uint64(20 + k), np.ones(len(long))))
            out.append((long, grams[k][end[long] - k] + np.uint64(30 + k), np.ones(len(long))))
        place = np.arange(len(code)) - start[owner] + 1
        whole = np.add.reduceat(mix(code) * mix(place.astype(np.uint64)), start) if len(names) else np.zeros(0, np.uint64)
    known = np.arange(len(names)) if lexicon is None else np.flatnonzero(np.isin(whole, lexicon))
    out.append((known, whole[known] + np.uint64(40), np.ones(len(known))))
    word, bucket, value = (np.concatenate(x) for x in zip(*out))
    return word, (mix(bucket) % np.uint64(BUCKETS)).astype(np.int64), value.astype(np.float32), whole


def emissions(model: dict, names: list[str]) -> np.ndarray:
    """Score of each label for each distinct word."""
    word, bucket, value, _ = features(names, model["lexicon"])
    return np.column_stack(
        [np.bincount(word, weights=w[bucket] * value, minlength=len(names)) for w in model["weights"].T]
    )


# Forward-backward ------------------------------------------------------------


def forward_backward(
    e: np.ndarray, start: np.ndarray, size: np.ndarray, transition: np.ndarray,
    before: np.ndarray | None = None, after: np.ndarray | None = None,
):
    """Label probabilities at each position of chains that lie at ``start`` in ``e``
    (scores), and the expected number of each transition. ``before`` and ``after`` are the
    messages that reach each chain's ends from words outside."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    longest = int(size[0]) if len(size) else 0
    active = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest)]
    step = np.exp(transition - transition.max())
    local = np.exp(e - e.max(axis=1, keepdims=True)) if len(e) else e
    alpha, beta = np.empty_like(local), np.ones_like(local)
    if after is not None:
        beta[start + size - 1] = after[order]
    for t in range(longest):
        at = start[: active[t]] + t
        if t:
            a = local[at] * (alpha[at - 1] @ step)
        else:
            a = local[at] if before is None else local[at] * before[order]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    pairs = np.zeros_like(step)
    for t in range(longest - 1, 0, -1):
        at = start[: active[t]] + t
        onward = local[at] * beta[at]
        b = onward @ step.T
        norm = (alpha[at - 1] * b).sum(axis=1, keepdims=True)
        pairs += (alpha[at - 1] / norm).T @ onward * step
        beta[at - 1] = b / b.sum(axis=1, keepdims=True)
    posterior = alpha * beta
    return posterior / posterior.sum(axis=1, keepdims=True), pairs


# Training --------------------------------------------------------------------


def chains_of(text: str, size: int = CHAIN_WORDS) -> list[str]:
    """The whole text in runs of ``size`` words."""
    words = text.split()
    return [" ".join(words[a : a + size]) for a in range(0, len(words), size)]


def words_per_language(languages: int) -> int:
    """Words of the sample, so that words times languages stays below 2**24 numbers."""
    return max(1, min(WORDS, (1 << 24) // max(1, languages) ** 2))


def training_chains(labelled: DataFrame) -> list[tuple[str, str]]:
    """(lang, chain) from (doc_id, text, lang), bounded as described above."""
    langs = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang")
    langs = [r["lang"] for r in langs.collect()]
    # Rows that repeat an id are told apart by their text's hash, so one id can't bring many.
    labelled = labelled.withColumn("_h", F.xxhash64("text"))
    rows = labelled.select("doc_id", "lang", "_h", F.size(F.split("text", r"\s+")).alias("n")).filter(F.col("lang").isin(langs))
    order = [F.col("n") > LONG, F.xxhash64("doc_id"), F.col("doc_id"), F.col("_h")]
    first = Window.partitionBy("lang").orderBy(*order)
    rows = rows.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= PER_LANGUAGE)
    # Of at most LANGUAGES * PER_LANGUAGE rows.
    earlier = first.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    chosen = rows.filter(F.col("_before") < words_per_language(len(langs))).select("doc_id", "lang", "_h").distinct()
    texts = labelled.join(F.broadcast(chosen), ["doc_id", "lang", "_h"], "left_semi").select("lang", F.col("text").cast("string").alias("text"))
    return sorted((r["lang"], chain) for r in texts.distinct().collect() for chain in chains_of(r["text"]))


def train(chains: list[tuple[str, str]], rounds: int = ROUNDS, seed: int = 7) -> dict:
    """Fit weights and transitions by gradient ascent on the likelihood (Adam)."""
    langs = sorted({lang for lang, _ in chains})
    number = {lang: i for i, lang in enumerate(langs)}
    names, ids, sizes = text_words(pa.array([chain for _, chain in chains], pa.string()))
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    parts = [(number[lang], p) for (lang, _), p in zip(chains, parts) if len(p)]
    rng = np.random.default_rng(seed)
    examples, labels = [], []
    for i in rng.permutation(len(parts)):
        lang, words = parts[i]
        tags = np.full(len(words), lang)
        if rng.random() < 0.5:  # a text that switches
            other, more = parts[rng.integers(len(parts))]
            a, b = rng.integers(1, len(words) + 1), rng.integers(0, len(more))
            words = np.concatenate((words[:a], more[b:]))
            tags = np.concatenate((tags[:a], np.full(len(more) - b, other)))
        examples.append(words)
        labels.append(tags)
    flat, gold = np.concatenate(examples), np.concatenate(labels)
    size = np.array([len(x) for x in examples])
    start = np.cumsum(size) - size
    _, _, _, whole = features(names)
    counts = np.bincount(ids, minlength=len(names))
    lexicon = np.sort(whole[counts >= LEXICON_COUNT])
    word, bucket, value, _ = features(names, lexicon)
    n = len(langs)
    weights, transition = np.zeros((BUCKETS, n), np.float64), np.zeros((n, n))
    onehot = np.eye(n)[gold]
    inner = np.ones(len(flat), dtype=bool)
    inner[start] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((n, n))
    np.add.at(seen, (gold[at - 1], gold[at]), 1)
    moments = [[np.zeros_like(weights), np.zeros_like(weights)], [np.zeros_like(transition), np.zeros_like(transition)]]
    for step in range(1, rounds + 1):
        scores = np.column_stack([np.bincount(word, weights=w[bucket] * value, minlength=len(names)) for w in weights.T])
        posterior, pairs = forward_backward(scores[flat], start, size, transition)
        error = onehot - posterior
        by_word = np.column_stack([np.bincount(flat, weights=x, minlength=len(names)) for x in error.T])
        gradient = np.column_stack([np.bincount(bucket, weights=x[word] * value, minlength=BUCKETS) for x in by_word.T])
        for target, g, m, rate in (
            (weights, gradient / len(flat) - 1e-7 * weights, moments[0], 0.1),
            (transition, (seen - pairs) / len(flat) - 1e-5 * transition, moments[1], 0.1),
        ):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.02 * (g * g - m[1])
            target += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.98**step)) + 1e-8)
    return {"langs": langs, "weights": weights.astype(np.float32), "transition": transition, "lexicon": lexicon}


# Prediction ------------------------------------------------------------------


def messages(e: np.ndarray, start: np.ndarray, size: np.ndarray, pieces: np.ndarray, transition: np.ndarray):
    """What reaches both ends of every piece from the rest of its text. ``pieces`` is the
    number of pieces per text; pieces lie in order."""
    n = e.shape[1]
    step = np.exp(transition - transition.max())
    local = np.exp(e - e.max(axis=1, keepdims=True))
    # A piece as a matrix: from labels of its first word to labels of its last one.
    through = np.zeros((len(start), n, n))
    through[:, np.arange(n), np.arange(n)] = local[start]
    for t in range(1, int(size.max())):
        some = np.flatnonzero(size > t)
        now = (through[some] @ step) * local[start[some] + t][:, None, :]
        through[some] = now / now.max(axis=(1, 2), keepdims=True)
    before, after = np.ones((len(start), n)), np.ones((len(start), n))
    first, last = np.cumsum(pieces) - pieces, np.cumsum(pieces) - 1
    for k in range(1, int(pieces.max())):
        text = pieces > k
        here = first[text] + k
        m = np.einsum("pi,pij->pj", before[here - 1], through[here - 1]) @ step
        before[here] = m / m.sum(axis=1, keepdims=True)
        here = last[text] - k
        m = np.einsum("pij,pj->pi", through[here + 1], after[here + 1]) @ step.T
        after[here] = m / m.sum(axis=1, keepdims=True)
    return before, after


def word_labels(model: dict, text: pa.Array, step: int = STEP_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each word of the rows in order, and words per row. ``step``
    only says how the work is cut."""
    names, ids, sizes = text_words(text)
    if not len(ids):
        return np.zeros((0, len(model["langs"]))), sizes
    if len(model["langs"]) > FEW_LANGUAGES:
        step = int(sizes.max())
    pieces = -(-sizes // step)
    first = np.repeat(np.cumsum(sizes) - sizes, pieces)
    place = np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = first + place * step
    size = np.minimum(step, np.repeat(np.cumsum(sizes), pieces) - start)
    scores = emissions(model, names)[ids]
    ends = messages(scores, start, size, pieces, model["transition"]) if pieces.max() > 1 else (None, None)
    posterior, _ = forward_backward(scores, start, size, model["transition"], *ends)
    return posterior, sizes


def _predicted(batches, model: dict):
    for batch in chunks(batches):
        n = batch.num_rows
        langs, scores = [UNKNOWN] * n, np.zeros(n)
        if model["langs"]:
            posterior, sizes = word_labels(model, batch.column(1))
            some = np.flatnonzero(sizes)
            if len(some):
                mean = np.add.reduceat(posterior, (np.cumsum(sizes) - sizes)[some]) / sizes[some, None]
                best = mean.argmax(axis=1)
                for row, label in zip(some, best):
                    langs[row] = model["langs"][label]
                scores[some] = np.clip(mean[np.arange(len(some)), best], 0.0, 1.0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores)],
            names=["doc_id", "held_out", "lang_pred", "score"],
        )


def learn(documents: DataFrame) -> dict:
    """Model learned from the rows of (doc_id, text, lang) that aren't held out."""
    remainder = crc_mod("doc_id", 4)
    usable = documents.select("doc_id", "text", "lang").filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & (remainder != 2) & F.col("doc_id").isNotNull()
    )
    chains = training_chains(usable)
    if not any(any(c.isalpha() for c in chain) for _, chain in chains):
        return {"langs": []}
    return train(chains)


def identify(documents: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, from its text alone."""
    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", (crc_mod("doc_id", 4) == 2).alias("held_out")
    )
    return rows.mapInArrow(
        lambda batches: _predicted(batches, model), "doc_id bigint, held_out boolean, lang_pred string, score double"
    )


def op2_langcrf(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return identify(documents, learn(documents))
