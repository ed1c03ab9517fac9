import random

import pytest
from pyspark.sql import functions as F

import models
from corpusloom.functions import text
from corpusloom.functions.secrets import passes_gate
from corpusloom.functions.strip import strip_comments
from corpusloom.operators.unpacking import markdown_blocks, xml_blocks
from corpusloom.session import filter_made

PIECES = {
    ".go": ["//", "/*", "*/", "/", "*", " ", "x", "\n", "\n", "\r\n", "\r", "\xa0", "\u0085", "\n\n", '"', "\u00e9"],
    ".py": ['"""', "'''", '"', "'", "#", "#!", " ", "x", "\n", "\n", "\r\n", "\u2028", "\n \n", "\t"],
    ".sh": ["#", "#!", " ", "x", "\n", "\n\n", "\r\n", "\r", "\u3000", "\n \n"],
    ".html": ["<!--", "-->", "<", "-", ">", " ", "x", "\n", "\n\n", "\r\n", "\xa0", "\n \n"],
    ".md": [" ", "x", "\n", "\n\n", "\r\n", "\r", "\xa0", "\t", "\n \n", "\x0b"],
}


def random_texts(pieces, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(pieces, k=rng.randint(0, 24))) for _ in range(n)]


@pytest.mark.parametrize("ext", PIECES)
def test_strip_agrees_with_model(spark, ext):
    texts = ["", "\n", "\r", "\r\n", "a\n\r"] + random_texts(PIECES[ext], 600, 7)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    got = dict(df.select("i", strip_comments(F.col("content"), F.lit("d/f" + ext.upper()))).collect())
    for i, t in enumerate(texts):
        assert got[i] == models.strip(t, ext), repr(t)


def test_strip_long_runs_of_markers(spark):
    """Several thousand marker lines neither overflow nor lose their order."""
    c = "\n".join(["a /* b", "gone", "c */ d // e", "/* x */ f"] * 3000)
    py = "\n".join(['x """ y', "''' gone", "z \"\"\" ''' w", "q ''' r # s", "t"] * 2000)
    for content, ext in ((c, ".go"), (py, ".py")):
        df = spark.createDataFrame([(content,)], "content string")
        got = df.select(strip_comments(F.col("content"), F.lit("f" + ext))).first()[0]
        assert got == models.strip(content, ext)


STRIP_CASES = [
    (
        "m.go",
        "package p\n\n// note\nimport \"os\"\n\n/*\nlong\n*/\nfunc f() {\n\tg() // call\n}\n",
        "package p\n\nimport \"os\"\n\nfunc f() {\n\tg() \n}",
    ),
    ("m.go", 'u := "http://x" // y', 'u := "http:'),
    ("m.go", "// a /* b\nhidden\n*/ c", "// a \n c"),
    ("m.go", "/*/ x\ny */ z", " z"),
    ("m.go", "a */ b /* c", "a */ b "),
    ("m.go", "a\n/* open\n\nb", "a"),
    ("m.py", "#!/bin/py\n# c\nimport os\n\ndef f():\n    # c\n    g()  # d\n", "#!/bin/py\nimport os\n\ndef f():\n    g()  "),
    ("m.py", 'a = """one"""\n"""two\nthree""" b\n', "a = \n b"),
    ("m.py", "x '''y\n\"\"\" z\n''' w", "x \n w"),
    ("m.py", "'''a''' \"\"\"b\"\"\"", "'''a''' "),
    ("m.py", '"""a"""b"""c\nd', 'b"""c\nd'),
    ("m.py", 'x\n"""never closed\ny', "x"),
    ("m.html", "<!-- a -->\n<p><!-- b --></p>\n<!-- c --> kept? <!-- d -->\n<!-- e\n-->", "<p></p>\n<!-- e\n-->"),
    ("m.html", "<!-->\nx", "x"),
    ("m.txt", "\n\n a \n \n\t\n\nb\n\n", " a \n\nb\n"),
    ("m.txt", " \n\u0085\nx\u0085 y // z", "x\u0085 y // z"),
    ("Dockerfile", "# stays\nRUN x", "# stays\nRUN x"),
    ("a.dockerfile", "# goes\nRUN x", "RUN x"),
    ("m.rs", "// stays", "// stays"),
]


@pytest.mark.parametrize("path,content,expected", STRIP_CASES)
def test_strip_cases(spark, path, content, expected):
    df = spark.createDataFrame([(path, content)], "path string, content string")
    assert df.select(strip_comments(F.col("content"), F.col("path"))).first()[0] == expected


XML_PIECES = [
    '<file path="a.txt">', "<file path='b'>", "</file>", "<![CDATA[", "]]>", " ", "x", "\n", "\n",
    "\n", "\r\n", '<file  path="c d" size="1">', "]]]]><![CDATA[>",
]
MD_PIECES = ["## File: a.txt (x)", "##  File:b", "## File:", "```", " ```go", "x", " ", "\n", "\n", "\n", "\r\n", "#"]


@pytest.mark.parametrize(
    "pieces,parse,model",
    [(XML_PIECES, xml_blocks, models.unpack_xml), (MD_PIECES, markdown_blocks, models.unpack_markdown)],
)
def test_unpack_agrees_with_model(spark, pieces, parse, model):
    texts = [""] + random_texts(pieces, 800, 11)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, body string")
    got = dict(df.select("i", parse(F.col("body"))).collect())
    for i, t in enumerate(texts):
        assert [tuple(b) for b in got[i]] == model(t), repr(t)


def test_lines(spark):
    cases = ["", "a", "a\n", "a\r\nb\r", "\n", "\n\n", "\r", "a\r\r\n", "a\n\r", "a\rb"]
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    for c, got, pre in df.select("c", text.lines(F.col("c")), text.preceded(F.col("c"))).collect():
        expected = models.split_lines(c) if c else []
        assert got == expected, repr(c)
        assert pre == "".join("\n" + line for line in expected)


def test_numbers(spark):
    sizes = [0, 1, 5, 128, 512, 1023, 1024, 1029, 10**6 + 7, 3 * 2**30]
    df = spark.createDataFrame([(n,) for n in sizes], "n bigint")
    for n, kb in df.select("n", text.size_kb(F.col("n"))).collect():
        assert kb == "%.2f" % (n / 1024)
    counts = [0, 999, 1000, 1049, 1050, 1150, 1250, 1350, 99950, 999949, 999950, 10**6, 1005000, 1015000,
              1234567, 10**9 + 5000, 1023995000, 2 * 10**9 + 15000, 2**40 + 5000]
    df = spark.createDataFrame([(n,) for n in counts], "n bigint")
    for n, short in df.select("n", text.compact_number(F.col("n"))).collect():
        expected = str(n) if n < 1000 else "%.1fk" % (n / 1e3) if n < 10**6 else "%.2fm" % (n / 1e6)
        assert short == expected, n


def test_tokens_count_bytes(spark):
    df = spark.createDataFrame([("",), ("abc",), ("abcd",), ("éé",), ("日本語",)], "c string")
    assert [r[0] for r in df.select(text.token_estimate(F.col("c"))).collect()] == [0, 0, 1, 1, 2]


def test_cdata(spark):
    df = spark.createDataFrame([("a]]>b]]>",), ("]]]>",), ("x",)], "c string")
    for c, escaped, back in df.select(
        "c", text.cdata_escape(F.col("c")), text.cdata_restore(text.cdata_escape(F.col("c")))
    ).collect():
        assert escaped == c.replace("]]>", "]]]]><![CDATA[>")
        assert back == c


def test_the_gate_is_asked_of_texts_made_once(spark):
    """A filter that names a long expression nine times doesn't work it out nine times."""
    rows = spark.createDataFrame([("a token", 1), ("ASIA" + "B" * 16, 2), (None, 3)], "t string, i int")
    made = rows.select(F.concat(F.lit("<mark>"), F.reverse(F.reverse("t"))).alias("content"), "i")
    missed = filter_made(made, ~passes_gate(F.col("content")))
    assert [r.i for r in missed.collect()] == [2] and missed.columns == ["content", "i"]
    assert missed._jdf.queryExecution().optimizedPlan().toString().count("<mark>") == 1
