import pytest
from pyspark.sql import functions as F

from corpusloom.operators.counting import PieceCounter
from corpusloom.plans import pack as plan

FACTS = ["repo", "ord", "path", "tokens", "part", "before", "first", "block_bytes"]
WORDS = PieceCounter(r"\S+|\s+", lambda piece: F.length(piece))


def tree(n=120):
    files = [(f"r{i % 3}", f"src/d{i % 7}/f{i}.py", f"x = {i}  # note\n" + "print('abc')\n" * (i % 11)) for i in range(n)]
    return files + [("r0", ".gitignore", "f9.py\n"), ("alone", "a.md", "text\n")]


def table(spark, files):
    return spark.createDataFrame(files, "repo string, path string, content string")


def edit(files, changed=(), gone=(), more=()):
    return [(r, p, c + "more\n" if p in changed else c) for r, p, c in files if p not in gone] + list(more)


# name: how the files change
EDITS = {
    "one file": {"changed": ["src/d1/f1.py"]},
    "deleted and added": {"gone": ["src/d3/f3.py"], "more": [("r1", "src/new.py", "y\n"), ("fresh", "b.py", "z\n")]},
    "ignore rules": {"changed": [".gitignore"], "more": [("r1", ".gitignore", "d1/\n")]},
    "a whole repo": {"gone": ["a.md"]},
}


@pytest.mark.parametrize("name, counter", [*[(name, plan.token_estimate) for name in EDITS], ("deleted and added", WORDS)])
def test_repack_equals_pack(spark, name, counter):
    files = tree()
    new = table(spark, edit(files, **EDITS[name]))
    before = plan.pack(table(spark, files), 700, counter=counter)
    got, full = plan.repack(before, new), plan.pack(new, 700, counter=counter)
    assert sorted(got.parts.select(FACTS).collect()) == sorted(full.parts.select(FACTS).collect())
    rendered = {r["path"] for r in got.nodes.filter("rendered").collect()}
    expected = set(EDITS[name].get("changed", [])) | {p for _, p, _ in EDITS[name].get("more", [])}
    assert rendered == {p for p in expected if not p.startswith(".")} | (rendered & {".gitignore"})
    # Exactly the parts whose text differs are told, and can be built alone.
    bodies = [{(r["repo"], r["part"]): r["body"] for r in plan.part_body(p).collect()} for p in (before, full)]
    told = {(r["repo"], r["part"]): r["change"] for r in plan.part_changes(before, got).collect()}
    assert told == {
        k: "added" if k not in bodies[0] else "gone" if k not in bodies[1] else "same" if bodies[0][k] == bodies[1][k] else "changed"
        for k in bodies[0].keys() | bodies[1].keys()
    }
    only = plan.part_changes(before, got).filter("change in ('added', 'changed')")
    alone = {(r["repo"], r["part"]): r["body"] for r in plan.part_body(got, only=only).collect()}
    assert alone == {k: bodies[1][k] for k, change in told.items() if change in ("added", "changed")}


def test_another_selection_renders_nothing(spark):
    files = table(spark, tree(60))
    rules = spark.createDataFrame([("r0", 1, "src/d0", False), ("r2", 1, "src", False)], "repo string, seq int, path string, selected boolean")
    before = plan.pack(files, 700)
    got, full = plan.repack(before, files, rules), plan.pack(files, 700, selection=rules)
    assert got.nodes.filter("rendered").count() == 0
    assert sorted(got.parts.select(FACTS).collect()) == sorted(full.parts.select(FACTS).collect())
    again = plan.repack(got, files)
    assert sorted(again.parts.select(FACTS).collect()) == sorted(before.parts.select(FACTS).collect())
