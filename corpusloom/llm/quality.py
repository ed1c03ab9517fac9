"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words, and only the bag has a label.
Every passage is described by hashed character trigrams and a few shares (capitals,
digits, signs, distinct words, word length) and encoded by a learned layer. Gated
attention, softmax of w * (tanh(V h) o sigmoid(U h)) over the passages, weights the
encodings; the weighted mean is scored by a logistic unit. All parts are learned jointly
from the document labels.

Training is fitted on a bounded sample of labelled rows: at most ``PER_CLASS`` documents of
each class, taken by a hash until they have ``PASSAGES`` passages; those of more than
``LONG`` passages come last. All passages of a document in the sample are learned from.
Scoring encodes every passage.

Defined results: a null or empty text, or one without words, is a bag of one passage of
zeros and so gets a score as well; without any labelled row to learn from, or with labels
of one class only, every score is that class's share, or 0.5. Repeated rows are scored
each; a document labelled several times is learned from once per label. An empty table
gives no rows. Columns are picked by name, others don't matter. A very long text is one bag
and takes memory in proportion to its passages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER, by_value, chunks, crc_mod, mix, table, text_bytes, words

by_value(__name__)

PASSAGE_WORDS = 64
TRIGRAMS = 256
SHARES = 8
WIDTH = TRIGRAMS + SHARES
HIDDEN, GATE = 32, 16
PER_CLASS = 1500
PASSAGES = 40_000  # per class, from which on no more documents are taken
LONG = 400  # passages
STEPS = 800
BATCH = 128
CUT = 0.3  # score from which on a document is predicted good

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


# Passages --------------------------------------------------------------------


def passages(text: pa.Array, size: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage and the number of passages of each row (1 at least)."""
    data, offsets = text_bytes(text)
    word, starts, per_row = words(data, offsets)
    count = np.maximum(1, -(-per_row // size))
    total = int(count.sum())
    out = np.zeros((total, WIDTH), np.float32)
    if not len(word):
        return out, count
    row = np.repeat(np.arange(len(per_row)), per_row)
    inside = np.arange(len(word)) - (np.cumsum(per_row) - per_row)[row]
    passage = (np.cumsum(count) - count)[row] + inside // size
    # A passage reaches from its first word to the next passage's; a row's first one
    # also has the row's leading white space.
    begins = np.zeros(len(data) + 1, np.int64)
    begins[starts[(inside > 0) & (inside % size == 0)] + 1] = 1
    begins = np.cumsum(begins)
    byte_row = np.repeat(np.arange(len(per_row)), np.diff(offsets))
    owner = (np.cumsum(count) - count - begins[offsets[:-1]])[byte_row] + begins[1:]
    n_words = np.bincount(passage, minlength=total).astype(np.float32)
    n_bytes = np.bincount(owner, minlength=total).astype(np.float32)
    n_words[n_words == 0] = 1
    n_bytes[n_bytes == 0] = 1
    if len(data) >= 3:
        low = LOWER[data].astype(np.uint32)
        gram = (low[:-2] * np.uint32(0x9E3779B1)) ^ (low[1:-1] * np.uint32(0x85EBCA77)) ^ (low[2:] * np.uint32(0xC2B2AE3D))
        gram = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        gram = ((gram >> np.uint32(20)) % np.uint32(TRIGRAMS)).astype(np.int64)
        same = owner[2:] == owner[:-2]
        table_ = np.bincount((owner[:-2] * TRIGRAMS + gram)[same], minlength=total * TRIGRAMS).reshape(total, TRIGRAMS)
        out[:, :TRIGRAMS] = np.sqrt(table_ / n_bytes[:, None])
    key = mix(word ^ mix(passage.astype(np.uint64)))
    _, first = np.unique(key, return_index=True)
    line = data == 10
    shares = [
        np.bincount(owner[mask[data] if mask is not None else line], minlength=total) / n_bytes
        for mask in (_UPPER, _DIGIT, _SIGN, None)
    ]
    shares.append(np.bincount(passage[first], minlength=total) / n_words)
    shares.append(n_bytes / n_words / 16)
    shares.append(n_words / size)
    shares.append(np.bincount(owner[data >= 128], minlength=total) / n_bytes)
    out[:, TRIGRAMS:] = np.column_stack(shares)
    out[np.bincount(passage, minlength=total) == 0] = 0
    return out, count


# Model -----------------------------------------------------------------------


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _forward(model: dict, x: np.ndarray, count: np.ndarray) -> dict:
    start = np.cumsum(count) - count
    x = (x - model["mean"]) / model["scale"]
    h = np.maximum(0, x @ model["E"] + model["e"])
    t, g = np.tanh(h @ model["V"]), _sigmoid(h @ model["U"])
    a = (t * g) @ model["w"]
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, start), count))
    a /= np.repeat(np.add.reduceat(a, start), count)
    z = np.add.reduceat(a[:, None] * h, start)
    return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "start": start, "p": _sigmoid(z @ model["c"] + model["b"][0])}


def attention(model: dict, x: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Weight of every passage within its document."""
    return _forward(model, x, count)["a"]


def scores(model: dict, x: np.ndarray, count: np.ndarray) -> np.ndarray:
    if "E" not in model:
        return np.full(len(count), model["share"])
    return _forward(model, x, count)["p"]


def train(bags: list[tuple[int, np.ndarray]], steps: int = STEPS, seed: int = 11) -> dict:
    """Fit the model to (label, passage features) by Adam on the log-likelihood."""
    labels = np.array([label for label, _ in bags], np.float32)
    if len(set(labels.tolist())) < 2:
        return {"share": float(labels.mean()) if len(labels) else 0.5}
    rng = np.random.default_rng(seed)
    whole = np.concatenate([x for _, x in bags])
    model = {
        "mean": whole.mean(axis=0), "scale": whole.std(axis=0) + 1e-3,
        "E": rng.normal(0, (2 / WIDTH) ** 0.5, (WIDTH, HIDDEN)), "e": np.zeros(HIDDEN),
        "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "w": rng.normal(0, GATE**-0.5, GATE), "c": np.zeros(HIDDEN), "b": np.zeros(1),
    }
    model = {k: v.astype(np.float32) for k, v in model.items()}
    names = ["E", "e", "V", "U", "w", "c", "b"]
    moments = {k: [np.zeros_like(model[k]), np.zeros_like(model[k])] for k in names}
    step = 0
    for _ in range(-(-steps * BATCH // len(bags)) if len(bags) > BATCH else steps):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            count = np.array([len(bags[i][1]) for i in pick])
            f = _forward(model, np.concatenate([bags[i][1] for i in pick]), count)
            d = (f["p"] - labels[pick]) / len(pick)
            dz = np.repeat(d[:, None] * model["c"], count, axis=0)
            da = (dz * f["h"]).sum(axis=1)
            da = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["start"]), count))
            dtg = da[:, None] * model["w"]
            dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
            dh = (f["a"][:, None] * dz + dt @ model["V"].T + dg @ model["U"].T) * (f["h"] > 0)
            gradient = {
                "E": f["x"].T @ dh + 1e-4 * model["E"], "e": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
                "w": (f["t"] * f["g"]).T @ da, "c": f["z"].T @ d + 1e-4 * model["c"], "b": np.array([d.sum()]),
            }
            step += 1
            for k in names:
                m = moments[k]
                m[0] += 0.1 * (gradient[k] - m[0])
                m[1] += 0.001 * (gradient[k] ** 2 - m[1])
                model[k] -= (2e-3 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


# Spark -----------------------------------------------------------------------


def _bags(batches):
    for batch in chunks(batches):
        x, count = passages(batch.column(1))
        out = [part.astype(np.float16).tobytes() for part in np.split(x, np.cumsum(count)[:-1])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(2), pa.array(out, pa.binary()), pa.array(count.astype(np.int64))], names=["label", "bag", "n"]
        )


def learn(documents: DataFrame, labels: DataFrame) -> dict:
    """Model learned from the labelled rows that aren't held out."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (crc_mod("doc_id", 5) != 0)
    )
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = usable.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= PER_CLASS).drop("_rank")
    # At most 2 * PER_CLASS rows. A repeated id may give more texts, so these are bounded too.
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    order = Window.partitionBy("label").orderBy(F.col("n") > LONG, F.xxhash64("bag"), "bag")
    bags = rows.mapInArrow(_bags, "label int, bag binary, n bigint")
    bags = bags.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= PER_CLASS)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    bags = bags.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).filter(F.col("_before") < PASSAGES)
    found = [(r["label"], bytes(r["bag"])) for r in bags.select("label", "bag").collect()]
    return train([(label, np.frombuffer(b, np.float16).reshape(-1, WIDTH).astype(np.float32)) for label, b in sorted(found)])


def _scored(batches, model: dict):
    for batch in chunks(batches):
        x, count = passages(batch.column(1))
        score = np.clip(np.asarray(scores(model, x, count), np.float64), 0.0, 1.0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(score), pa.array((score >= CUT).astype(np.int32))],
            names=["doc_id", "held_out", "score", "predicted"],
        )


def score_quality(documents: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from its text alone."""
    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", (crc_mod("doc_id", 5) == 0).alias("held_out")
    )
    return rows.mapInArrow(
        lambda batches: _scored(batches, model), "doc_id bigint, held_out boolean, score double, predicted int"
    )


def op4_quality(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score_quality(documents, learn(documents, table(spark, sf_dir, "labels")))
