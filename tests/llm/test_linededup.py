import hashlib
import random

import numpy as np

from corpusloom.llm import linededup as m

WS = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=20, min_docs=3):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WS))

    docs = {}
    for i, t in rows:
        for line in set(map(key, (t or "").split("\n"))):
            if len(line) >= min_chars:
                docs.setdefault(line, []).append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(docs.get(key(x), [])) >= min_docs and max(docs[key(x)]) != i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def run(df, **more):
    return sorted(tuple(r) for r in m.dedup_lines(df, **more).collect())


def test_against_brute_force(docs):
    rng = random.Random(3)
    common = [f"  A Shared line number {k} é \r" for k in range(30)] + ["short", "", "ééééééééééééééééééé"]
    rows = [
        (i, "\n".join(rng.choice(common) if rng.random() < 0.6 else f"line {rng.random():.18f} of its own" for _ in range(rng.randrange(12))))
        for i in range(200)
    ]
    rows += [(1000, None), (1001, ""), (1002, "\n"), (1003, common[0].strip().lower())]
    expected = brute(rows)
    assert run(docs(rows)) == expected
    # Hot shards are split; the result is the same.
    assert run(docs(rows), shards=3, load=20) == expected


def test_repeated_and_missing_ids(docs):
    line = "the very same line in here"
    rows = [(1, line), (1, line), (2, line), (2, line + "\nx"), (None, line)]
    got = m.dedup_lines(docs(rows)).collect()
    kept = sorted((r["doc_id"] or 0, r["kept"], r["n_dropped"]) for r in got)
    # Five rows, yet only two documents.
    assert kept == [(0, line, 0), (1, line, 0), (1, line, 0), (2, line, 0), (2, line + "\nx", 0)]
    got = m.dedup_lines(docs([*rows, (3, line), (3, "y")])).collect()
    kept = sorted((r["doc_id"] or 0, r["kept"], r["n_dropped"]) for r in got)
    assert kept == [(0, line, 0), (1, "", 1), (1, "", 1), (2, "", 1), (2, "x", 1), (3, line, 0), (3, "y", 0)]


def test_empty_table_and_long_text(docs):
    assert run(docs([])) == []
    long = "word " * 400_000
    rows = [(i, f"{long}\nown {i}") for i in range(3)]
    assert [r[3] for r in run(docs(rows))] == [1, 1, 0]


def test_rows_keep_their_other_columns(docs):
    row = m.dedup_rows(docs([(1, "a\nb")])).first()
    assert row["row"].asDict() == {"doc_id": 1, "lang": "en", "source": "s", "n_chars": 3, "shard": 7, "kept": "x"}
    assert row["kept"] == "a\nb"


def test_minimal_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        h1, h2 = rng.integers(0, 2**64, (2, n), dtype=np.uint64)
        h1[: n // 2] = h1[0] if n else 0  # equal first halves are told apart
        levels = m.build_mph(h1, h2)
        assert sorted(m.mph_index(levels, h1, h2)) == list(range(n))
        again = m._unpack(*m._pack(levels))
        assert (m.mph_index(again, h1, h2) == m.mph_index(levels, h1, h2)).all()
    other = rng.integers(0, 2**64, (2, 100), dtype=np.uint64)
    assert (m.mph_index(levels, *other) < n).all()


def test_digest_of_kept():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
