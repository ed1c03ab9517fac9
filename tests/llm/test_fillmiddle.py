"""Fill-in-the-middle: brute force over code points, round trip, defined cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import fillmiddle
from corpusloom.llm.fillmiddle import Blocks, fill_in_middle, restored

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(spark, rows, **more):
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, output string, n int")
    made = fill_in_middle(table, **more)
    made = made.withColumn("again", restored(F.col("output"), F.col("form"))).collect()
    knobs = {k: v for k, v in more.items() if k != "block"}
    got = sorted(((r["doc_id"] is None, r["doc_id"]), r["n"], r["form"], r["prefix_chars"] or 0, r["middle_chars"] or 0, r["output"], r["again"]) for r in made)
    expected = []
    for i, t in rows:
        n, form, p, m, out = brute(i, t, **knobs)
        expected.append(((i is None, i), n, form, p or 0, m or 0, out, t or ""))
    assert got == sorted(expected)
    return made


def texts(seed, count):
    draw = random.Random(seed)
    pieces = ["a", "wörd", "語", "😀", " ", "  ", "\n", "\t\r\x0b\x0c", "\u00a0", "\u2003", "\x1f", "<", "P>", "x" * 30]
    return ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 60))) for _ in range(count)]


@pytest.mark.parametrize("block", [1, 3, 64, 1024])
def test_random_texts(spark, block):
    made = check(spark, list(enumerate(texts(block, 300))), block=block, rate=90, spm=50)
    assert {r["form"] for r in made} == {"plain", "spm", "psm"}


def test_short_stretches(spark, monkeypatch):
    data = np.frombuffer("".join(t := texts(5, 50)).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(x.encode()) for x in t])))
    whole = Blocks(data, offsets, 8)
    monkeypatch.setattr(fillmiddle, "STRETCH", 20)
    parts = Blocks(data, offsets, 8)
    for name in ("units", "points", "total"):
        assert (getattr(whole, name) == getattr(parts, name)).all()


def test_every_cut():
    t = " a bc\n\nd ü 語語  "
    data, units = np.frombuffer(t.encode(), np.uint8), UNIT.findall(t)
    blocks = Blocks(data, np.array([0, len(data)]), 2)
    place, points = blocks.cut(np.zeros(len(units) + 1, np.int64), np.arange(len(units) + 1))
    for k, (at, n) in enumerate(zip(place, points)):
        assert data[:at].tobytes().decode() == "".join(units[:k]) == t[:n]


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "holds <S> a mark"), (None, "a b c d"), (None, None)]
    check(spark, rows + rows, rate=100)
    check(spark, [], rate=100)


def test_very_long_text(spark):
    words = ["wort", "語", "x y"]
    check(spark, [(8, " ".join(words[k % 3] for k in range(600_000))), (9, "z" * 3_000_000), (10, " " * 2_000_000)], rate=100)


def test_query(spark, tmp_path):
    rows = list(enumerate(texts(11, 400)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit("clash"))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in fillmiddle.op13_fillmiddle(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in rows:
        *head, out = brute(i, t)
        assert got[i] == (*head, sha(out), sha(t))
