import random

import numpy as np

from corpusloom.llm import jaccard as m
from corpusloom.llm.common import shingles, text_bytes, words


def edited(rng, words_, share):
    return [f"n{rng.randrange(10**6)}" if rng.random() < share else w for w in words_]


def corpus():
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(60)]
    rows, number = [], 0
    for family in range(12):
        base = [f"f{family}w{rng.randrange(500)}" for _ in range(rng.choice([3, 5, 9, 40, 200, 400]))]
        for _ in range(rng.randrange(1, 9)):
            text = edited(rng, base, rng.choice([0, 0, 0.01, 0.02, 0.04, 0.06]))
            if rng.random() < 0.5:
                text = text + passage
            rows.append((number, " ".join(text)))
            number += 1
    for share in (0.01, 0.015):  # one large group of near copies
        base = [f"g{rng.randrange(300)}" for _ in range(120)]
        for _ in range(40):
            rows.append((number, "\n ".join(edited(rng, base, share)).upper()))
            number += 1
    rows += [(number + 1, None), (number + 2, ""), (number + 3, " \t\n"), (number + 4, "one two"), (number + 5, "ONE  two")]
    return rows


def run(df, **more):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in m.near_duplicates(df, **more).collect()}


def test_against_brute_force(docs, brute_components):
    rows = corpus()
    expected = brute_components(rows)
    assert len({c for _, c in expected.values()}) < len(rows) - 60
    assert run(docs(rows)) == expected
    # Blocks cut into chunks, shards into copies, and another share of low hashes.
    assert run(docs(rows), block_sets=6, shards=3, load=500) == expected
    assert run(docs(rows), low=0.05) == expected


def test_exact_limit(docs):
    # 7 shingles each, 6 shared: 6 of 8 are 75 per cent.
    a = "a b c d e f g h i j k"
    b = "a b c d e f g h i j x"
    assert run(docs([(1, a), (2, b)])) == {1: (7, 1), 2: (7, 1)}
    c = "a b c d e f g h i x y"  # 5 of 9
    assert run(docs([(1, a), (3, c)])) == {1: (7, 1), 3: (7, 3)}


def test_missing_and_repeated_ids(docs):
    text = "one two three four five six"
    got = m.near_duplicates(docs([(None, text), (4, text), (4, text), (4, "other words that are here now"), (9, text)]))
    rows = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in got.collect())
    assert rows == [(0, 2, 4), (4, 2, 4), (4, 2, 4), (4, 2, 4), (9, 2, 4)]
    assert m.near_duplicates(docs([(None, None)])).first()["component_id"] is None


def test_rows_of_one_id_are_one_node(docs):
    a, b, c = "one two three four five six", "other words that are here now", "and a third text of words"
    got = m.near_duplicates(docs([(4, a), (9, a), (9, b), (9, None), (7, b), (12, c), (11, c), (11, ""), (3, None), (3, "")]))
    rows = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect())
    assert rows == [(3, 0, 3), (3, 0, 3), (4, 2, 4), (7, 2, 4), (9, 0, 4), (9, 2, 4), (9, 2, 4), (11, 0, 11), (11, 2, 11), (12, 2, 11)]


def test_blocks_bounded_by_shingles(docs, brute_components):
    rows = corpus()
    assert run(docs(rows), block_shingles=300) == brute_components(rows)


def test_empty_table_and_long_text(docs):
    assert run(docs([])) == {}
    long = " ".join(f"w{k}" for k in range(120_000))
    assert run(docs([(1, long), (2, long + " end"), (3, "x" * 1_000_000)])) == {1: (119_996, 1), 2: (119_997, 1), 3: (1, 3)}


def test_search_equals_comparing_all():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 400, rng.integers(1, 60))).astype(np.uint64) for _ in range(40)]
    sets = [np.unique(np.where(rng.random(len(b)) < 0.06, rng.integers(0, 400, len(b)), b)).astype(np.uint64) for b in base for _ in range(4)]
    index, alive = m.Index(sets, np.arange(len(sets))), np.ones(len(sets), bool)
    for query in sets[:60]:
        expected = [
            i for i, s in enumerate(sets)
            if 100 * len(np.intersect1d(query, s)) >= 75 * len(np.union1d(query, s))
        ]
        assert index.search(query, 75, alive).tolist() == expected


def test_shingles_of_rows():
    import pyarrow as pa

    word, _, per_row = words(*text_bytes(pa.array(["A b c d e f", None, "a", "", " a b c d e ", "a b"])))
    value, row = shingles(word, per_row)
    assert row.tolist() == [0, 0, 2, 4, 5]
    assert value[0] == value[3] and len(set(value.tolist())) == 4
