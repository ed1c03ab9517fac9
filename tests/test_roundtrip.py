"""Round trip through whole part texts: what neighbours do to one another."""

import pytest
from pyspark.sql import functions as F

import models
from corpusloom.operators.unpacking import from_first_opening, markdown_blocks, xml_blocks
from corpusloom.plans import pack as plan
from corpusloom.plans.unpack import roundtrip_parts

FILES = [
    ("r", "a.md", "plain\n"),
    ("r", "b.md", "before\n</file>\nafter"),  # a lone close tag cuts the file short
    ("r", "c.md", "x ]]> y"),
    ("r", "d e.md", "a path with a blank"),
    ("r", "f.md", 'before\n</file>\n<file path="zz.md">\ntext\n</file>\n<file path="a.md">\nagain\n</file>'),
    ("r", "g.md", "text\n```\nfenced\n```\n## File: zz.md\n```\nmore\n```"),
    ("r", "h.md", ""),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "repo string, path string, content string")


def report(files, **more):
    rows = roundtrip_parts(plan.pack(files, strip=False, **more)).collect()
    return sorted((r.path, r.fidelity) for r in rows)


def test_xml(files):
    got = report(files, fmt="XML")
    assert got == [
        ("a.md", "newline"), ("a.md", "repeated"), ("b.md", "changed"), ("c.md", "exact"), ("d e.md", "exact"),
        ("f.md", "changed"), ("g.md", "exact"), ("h.md", "exact"), ("zz.md", "invented"),
    ]


def test_markdown(files):
    got = dict(report(files))
    # The path ends at its blank; a fence inside ends the block.
    assert got["d"] == "invented" and got["d e.md"] == "missing"
    assert got["g.md"] == "changed" and got["a.md"] == "newline" and got["c.md"] == "exact"


def test_alone_in_its_part_equals_alone(files):
    """With a part per file only a file's own text can hurt it."""
    rows = roundtrip_parts(plan.pack(files, 1, fmt="xml", strip=False)).collect()
    assert len({r.part for r in rows}) == len(FILES)
    assert ("a.md", "invented") in {(r.path, r.fidelity) for r in rows}


def test_no_files(spark, files):
    assert report(files.limit(0)) == []


NAMES = [("r", f"{'long/' * 9}{i}.md", f"text {i}\n") for i in range(200)]


@pytest.mark.parametrize("fmt", ["xml", "markdown"])
def test_trees_are_not_read_with_every_part(spark, fmt):
    packed = plan.pack(spark.createDataFrame(NAMES, "repo string, path string, content string"), 1, fmt, strip=False)
    rows = roundtrip_parts(packed)
    moved = models.moved_bytes(rows)
    assert sorted((r.part, r.fidelity) for r in rows.collect()) == [(i, "newline") for i in range(1, 201)]
    tree = plan.tree_text(packed.nodes).first().tree
    assert moved < 50 * len(tree)


def test_names_that_open_blocks(spark):
    """A tree whose names look like block marks is still read by every part."""
    rows = [("r", 'a<file path="z.md">', "one\n"), ("r", "b.md", "two\n"), ("r", "c\n## File: b.md\n```", "three\n")]
    files = spark.createDataFrame(rows, "repo string, path string, content string")
    for fmt, parse in (("xml", xml_blocks), ("markdown", markdown_blocks)):
        packed = plan.pack(files, 1, fmt, strip=False)
        bodies = plan.part_body(packed).select("part", parse(F.col("body")).alias("found")).collect()
        found = sorted((b.part, f.path) for b in bodies for f in b.found)
        got = [(r.part, r.path) for r in roundtrip_parts(packed).filter("fidelity <> 'missing'").collect()]
        assert sorted(got) == found and found


@pytest.mark.parametrize("text", ["", "x", "\n", 'a\nb <file path="x">\nc', "##", "a\n## File: x\n```", "a## b\n# c", "<file"])
def test_from_first_opening(spark, text):
    lines = text.split("\n")
    for fmt, opens in (("xml", lambda x: "<file" in x), ("markdown", lambda x: x.startswith("##"))):
        first = next((i for i, x in enumerate(lines) if opens(x)), len(lines))
        assert spark.range(1).select(from_first_opening(F.lit(text), fmt)).first()[0] == "\n".join(lines[first:])
