import random

import numpy as np
import pytest

from corpusloom.llm import decontam as m

ITEM = (
    "If Alice Smith buys 12 apples for 30 dollars and Bob eats 12 of them at noon, "
    "how many apples does Alice Smith keep today?"
)
CHANGED = (
    "IF Carol buys 77 apples for 9 euros and Dan eats 77 of them at noon; "
    "how many apples does Carol keep today?"
)
MIXED = CHANGED.replace("eats 77", "eats 55").replace("does Carol", "does Erin")


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame([(*r, "x") for r in rows], "item_id bigint, text string, doc_id string")


def found(docs, items, texts, more=(), **settings):
    table = items([(1, ITEM), (2, None), (3, "too short"), *more])
    rows = m.contaminated(docs(texts), table, **settings).collect()
    return sorted((r["doc_id"] or 0, r["item_id"], r["n_changed"]) for r in rows)


@pytest.mark.parametrize("filter_windows", [10**6, 0])
def test_same_and_changed_questions(docs, items, filter_windows):
    texts = [
        (1, f"Words before. {ITEM} And words behind."), (2, CHANGED), (3, MIXED), (4, None), (5, ""), (6, ITEM[:40]),
        (7, "How many apples does anybody eat at noon? " * 50), (8, "word " * 300_000 + "end. " + ITEM), (None, ITEM),
    ]
    assert found(docs, items, texts, filter_windows=filter_windows) == [(0, 1, 0), (1, 1, 0), (2, 1, 5), (8, 1, 0)]


def test_short_and_repeated_items_and_rows(docs, items):
    more = [(5, "what is the old capital"), (5, "what is the old capital"), (6, "what is the"), (None, "quite another question of some words here")]
    texts = [(1, "so: what is the old capital of it"), (1, "so: what is the old capital"), (2, "Quite another question of some words here.")]
    # Item 6 has three words and is found as it stands.
    assert [(d, i) for d, i, _ in found(docs, items, texts, more)] == [(1, 5), (1, 6), (2, None)]


def test_empty_tables(docs, items):
    assert found(docs, items, []) == []
    assert m.contaminated(docs([(1, ITEM)]), items([])).collect() == []


def test_placeholders():
    import pyarrow as pa

    text = pa.array(["He met Ann Lee and paid 5 km or 7kg - 1,000.", None, "Ann met\nLee"])
    word, value, slot, per_row = m.template(text)
    # he met NAME and paid NUMBER UNIT or NUMBER UNIT NUMBER; names that open a line stay words
    assert per_row.tolist() == [11, 0, 3]
    assert slot.tolist() == [False, False, True, False, False, True, True, False, True, True, True] + [False] * 3
    assert [word[i] for i in (2, 5, 6, 8, 9, 10)] == [m.NAME, m.NUMBER, m.UNIT, m.NUMBER, m.UNIT, m.NUMBER]
    assert word[12] == word[1]


def test_numbers_are_parted_from_letters():
    import pyarrow as pa

    both = [m.template(pa.array([t])) for t in ("ran 5km in 10-min by 3rd x86 x", "ran 5 km in 10 min by 3 rd x86 x")]
    for a, b in zip(*both):
        assert a.tolist() == b.tolist()
    # Names in any alphabet that has capitals; the word after a number is counted, if it isn't short.
    word = m.template(pa.array(["сегодня Иван купил 12 яблок, η Μαρία 3 y 4 manzanas Żaneta"]))[0]
    assert [int(np.flatnonzero([w == k for k in (m.NUMBER, m.UNIT, m.NAME)])[0]) if w in (m.NUMBER, m.UNIT, m.NAME) else -1 for w in word] == [
        -1, 2, -1, 0, 1, -1, 2, 0, -1, 0, 1, 2]


QUESTIONS = [
    "If {a} travels {n} {u} in {k} hours with {b}, how many {u} does {a} travel every hour on average?",
    "Un tren recorre {n} {u} en {k} horas con {a} a bordo, y luego {b} quiere saber cuantos pasajeros quedan en la estacion",
    "Wenn {a} am Morgen {n} {u} kauft und {b} davon {k} {u} verliert, wie viele bleiben dann am Abend noch da",
    "Quand {a} ajoute {n} {u} dans le panier et que {b} en prend {k} de plus, combien en reste-t-il pour le soir",
]
KINDS = [["miles", "kilometers"], ["kilometros", "millas"], ["pfund", "gramm"], ["pommes", "poires"]]
NAMES = ["Anna", "Émile", "Ölaf", "Иван", "Μαρία", "Zoe Smith", "Łukasz"]


def test_recall_of_re_parameterised_questions(docs, items):
    """In four languages, among texts of the same words in another order."""
    rng = random.Random(9)

    def ask(k, kind):
        a, b = rng.sample(NAMES, 2)
        n, m_ = rng.sample(range(2, 900), 2)
        return QUESTIONS[k].format(a=a, b=b, n=n, k=m_, u=KINDS[k][kind])

    benchmark = [(20 + k, ask(k, 0)) for k in range(4)] + [(10, "Alice buys apples"), (11, "2 + 2")]
    filler = lambda: " ".join(rng.choice(" ".join(QUESTIONS).replace("{", "").replace("}", "").split()) for _ in range(60))
    planted = [(i, f"{filler()}. {ask(i % 4, i % 2)}. {filler()}") for i in range(200)]
    clean = [(1000 + i, filler()) for i in range(100)]
    short = [(2000, "so Alice buys apples now"), (2001, "Alice buys 3 apples"), (2002, "is 2 + 2 so"), (2003, "2 + 3")]
    got = [(d, i) for d, i, _ in found(docs, items, planted + clean + short, benchmark)]
    right = sum((i, 20 + i % 4) in got for i, _ in planted)
    assert right >= 0.9 * len(planted), right
    assert [g for g in got if g[0] >= 1000] == [(2000, 10), (2002, 11)]
    assert all(20 + d % 4 == i for d, i in got if d < 1000)


def test_against_containment(spark):
    """On the given tables the items found are those that texts hold."""
    import duckdb

    sf = "/root/testdata/sf0.01"
    got = {(r["doc_id"], r["item_id"]) for r in m.op3_decontam(spark, sf).collect()}
    held = duckdb.sql(
        f"SELECT doc_id, item_id FROM '{sf}/documents.parquet' d JOIN '{sf}/benchmark.parquet' b ON contains(d.text, b.text)"
    ).fetchall()
    assert set(held) <= got and len(got - set(held)) <= 1


def test_several_versions_in_one_document(docs, items):
    other = CHANGED.replace("77", "41").replace("Carol", "Frank").replace("Dan", "Gus")
    edited = ITEM.replace("at noon", "at high noon")
    texts = [
        (1, f"{ITEM} {CHANGED}"), (2, f"{CHANGED} {other}"), (3, f"{CHANGED} words between. {other} {ITEM}"), (4, f"{MIXED} {MIXED}"),
        (5, ITEM), (5, CHANGED), (5, other), (6, f"{CHANGED} {edited} {other}"), (None, CHANGED), (None, other),
    ]
    assert [(d, i) for d, i, _ in found(docs, items, texts)] == [(0, 1), (1, 1), (2, 1), (3, 1), (5, 1), (6, 1)]


@pytest.mark.parametrize("filter_windows", [10**6, 0])
def test_items_of_placeholders_are_found_verbatim(docs, items, filter_windows):
    sums, names = "12 + 7 - 3 = 16 and 5 * 4 = 20; 9 + 9 = 18", "ALICE SMITH BOB JONES CAROL KING"
    table = "Apples 12 kg 30 dollars\nPears 7 kg 9 euros\nPlums 5 kg 4 usd"
    more = [(11, sums), (12, names), (13, table), (14, "1 2 3 4")]
    texts = [
        (1, f"so: {sums}. Then"), (2, f"met {names} today"), (3, f"List:\n{table}\nEnd."), (4, sums.replace("7", "8").replace("4", "6").replace("5", "2")),
        (5, names.replace("BOB", "DAN")), (6, "1 2 3 4"), (7, f"{table} {ITEM} {CHANGED}"), (None, names),
    ]
    got = found(docs, items, texts, more, filter_windows=filter_windows)
    assert [(d, i) for d, i, _ in got] == [(0, 12), (1, 11), (2, 12), (3, 13), (6, 14), (7, 1), (7, 13)]
