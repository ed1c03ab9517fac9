import os
import time

import pytest
from pyspark.sql import functions as F

import models
from corpusloom import session
from corpusloom.constants import ENV_LABEL
from corpusloom.operators import unpacking
from corpusloom.plans import pack as plan
from corpusloom.plans.unpack import roundtrip_report, unpack_into
from corpusloom.sources import trees
from corpusloom.streaming.rows import stream_blocks


def write(root, files):
    for path, content in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(content)


def test_scan_trees(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    write(one, {
        ".gitignore": b"x\n", ".env": b"A=1", "empty": b"", "a/b/c.txt": b"deep", "_u/f": b"under",
        "node_modules/m": b"n", "p.png": b"\x89", "bad": b"\xff\xfe", "a/dist": b"hidden file",
    })
    write(two, {"f.go": b"package f"})
    os.symlink(one / "a", one / "link_dir")
    os.symlink(one / "a/b/c.txt", one / "link_file")
    roots = spark.createDataFrame([("1", str(one) + "/"), ("2", str(two))], "repo string, root string")
    rows = {(r.repo, r.path): r for r in trees.scan_trees(roots).collect()}
    assert set(p for r, p in rows if r == "1") == {
        ".gitignore", ".env", "empty", "a/b/c.txt", "_u/f", "p.png", "bad", "a/dist", "link_file",
    }
    assert bytes(rows["1", "link_file"].content) == b"deep"
    assert rows["1", "p.png"].content is None and rows["1", "p.png"].size == 1
    assert bytes(rows["2", "f.go"].content) == b"package f"
    text = {r.path: r for r in trees.as_text(trees.scan_trees(roots)).collect()}
    assert not text["bad"].valid_utf8 and text["a/b/c.txt"].valid_utf8
    nodes = plan.walk(trees.as_text(trees.scan_trees(roots)))
    assert {r.path for r in nodes.filter("repo = '1'").collect()} == {
        ".gitignore", ".env", "empty", "a", "a/b", "a/b/c.txt", "_u", "_u/f", "bad", "link_file",
    }


def test_scan_pruned_by_glob_and_uri(spark, tmp_path):
    write(tmp_path, {"logs/x": b"1", "keep/x": b"2"})
    roots = spark.createDataFrame([("r", f"file://{tmp_path}")], "repo string, root string")
    assert [r.path for r in trees.scan_trees(roots, ["logs"]).collect()] == ["keep/x"]


def test_sinks(spark, tmp_path):
    parts = spark.createDataFrame([("r", 1, "b")], "repo string, part bigint, body string")
    trees.write_parts(parts, str(tmp_path / "parts"))
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 1
    with pytest.raises(Exception):
        trees.write_parts(parts, str(tmp_path / "parts"))


def secret(*pieces):
    return "".join(pieces)


def test_secrets(spark):
    key = secret("sk", "-", "a1" * 24)
    aws_id = secret("AK", "IA", "B2" * 8)
    temp_id = secret("AS", "IA", "B2" * 8)
    hook = secret("https://hooks.sl", "ack.com/services/", "T" * 9, "/", "B" * 9, "/", "c" * 24)
    aws_key = secret("aws_", "secret_access = '", "d/" * 20, "'")
    quoted = '"' + "v" * 8 + '"'
    rows = [
        ("m.go", f'const k = "{key}"', ["OpenAI API Key"]),
        ("m.go", 'const k = "plain"', []),
        (".env", "PORT=1", [ENV_LABEL]),
        ("x.Environment/a", "clean", [ENV_LABEL]),
        ("c.json", aws_id, ["AWS Access Key ID"]),
        ("h", hook, ["Slack Webhook URL"]),
        ("s", aws_key, ["AWS Secret Access Key"]),
        ("two.env", f"{aws_id} then password = {quoted}", [ENV_LABEL, "AWS Access Key ID", "Generic API Key/Secret"]),
        ("upper", f"PASSWORD = {quoted}", []),
        ("passwd", f"passwd: {quoted}", []),
        ("asia", temp_id, []),
        ("gate", f"token; PASSWD={quoted} {temp_id}", ["Generic API Key/Secret", "AWS Access Key ID"]),
        ("fold", f"token; to\u212aen={quoted} pa\u017fsword={quoted}", ["Generic API Key/Secret"] * 2),
        ("short", 'token = "1234567"', []),
        ("bare", "token = 123456789", []),
        ("vt", f"token\x0b= {quoted}", []),
        ("proj", secret("sk", "-", "proj-", "z" * 32), ["OpenAI API Key"]),
    ]
    files = spark.createDataFrame([("r", p, c) for p, c, _ in rows], "repo string, path string, content string")
    got = {}
    for r in plan.secret_findings(files).orderBy("path", "match_ord").collect():
        assert set(r.asDict()) == {"repo", "path", "match_ord", "rule"}
        got.setdefault(r.path, []).append(r.rule)
    expected = {}
    for p, _, labels in rows:
        expected.setdefault(p, []).extend(labels)
    assert got == {p: labels for p, labels in expected.items() if labels}
    strict = {r.path for r in plan.secret_findings(files, strict=True).collect()} - set(got)
    assert strict == {"upper", "passwd", "asia"}
    assert plan.with_secret_flag(files).filter("has_secret").select("path").distinct().count() == len(got)
    assert plan.secret_rollup(plan.secret_findings(files)).agg(F.sum("n_findings")).first()[0] == sum(
        len(v) for v in got.values()
    )


XML = """Here you go.
<file path="a.txt" size="1 KB" tokens="3">
<![CDATA[
one
two ]]]]><![CDATA[> three
]]>
</file>

<file path='sub/b.txt' extra="1">
no cdata
</file>
<file path="../evil">
x
</file>
<file path="/abs">
x
</file>
<file path="a.txt">
again
</file>
<file path="open.txt">
lost
"""
MARKDOWN = """Intro
## File: a.py (Size: 1 KB | Tokens: 2)
```python
print(1)
```

## File: with space.txt
## File: second.txt
text
```
body
```
after
```
not in a block
```
## File: open.txt
```
"""


@pytest.fixture(scope="module")
def responses(spark):
    return spark.createDataFrame(
        [("r", "1", XML), ("r", "2", MARKDOWN), ("r", "3", MARKDOWN + XML), ("r", "4", "nothing")],
        "repo string, resp_id string, body string",
    )


def test_unpack(responses):
    rows = unpacking.unpack(responses).orderBy("resp_id", "block_ord").collect()
    one = [(r.path, r.status, r.content) for r in rows if r.resp_id == "1"]
    assert one == [
        ("a.txt", "ok", "one\ntwo ]]> three"), ("sub/b.txt", "ok", "no cdata"),
        ("../evil", "traversal", "x"), ("/abs", "traversal", "x"), ("a.txt", "ok", "again"),
    ]
    two = [(r.path, r.content) for r in rows if r.resp_id == "2"]
    assert two == [("a.py", "print(1)"), ("with", "body")]
    assert [r.path for r in rows if r.resp_id == "3"] == [p for p, _, _ in one]  # XML wins
    assert not [r for r in rows if r.resp_id == "4"]


def test_unsafe_paths_can_fail_the_job(responses):
    blocks = unpacking.unpack(responses)
    assert unpacking.safe_blocks(blocks).filter("status <> 'ok'").isEmpty()
    with pytest.raises(Exception, match="leaves the workspace"):
        unpacking.safe_blocks(blocks, "fail").collect()


def test_apply(spark, responses):
    snapshot = spark.createDataFrame(
        [("r", "a.txt", "old"), ("r", "sub/b.txt", "no cdata"), ("r", "other", "x"), ("q", "a.txt", "mine")],
        "repo string, path string, content string",
    )
    got = {(r.repo, r.path): (r.content, r.change) for r in unpack_into(snapshot, responses.filter("resp_id < 3")).collect()}
    assert got == {
        ("r", "a.txt"): ("again", "replaced"), ("r", "sub/b.txt"): ("no cdata", "same"),
        ("r", "other"): ("x", "kept"), ("q", "a.txt"): ("mine", "kept"),
        ("r", "a.py"): ("print(1)", "added"), ("r", "with"): ("body", "added"),
    }


def test_read_responses(spark, tmp_path):
    write(tmp_path, {"one.txt": XML.encode(), "two.txt": MARKDOWN.encode()})
    write(tmp_path, {"deep/one.txt": XML.encode(), "_x/.hidden": XML.encode(), "node_modules/z": b"\0 no block"})
    for root in (str(tmp_path), f"file://{tmp_path}"):
        read = trees.read_responses(spark, root, "r")
        assert {r.resp_id for r in read.collect()} == {"one.txt", "two.txt", "deep/one.txt", "_x/.hidden", "node_modules/z"}
        assert {r.resp_id for r in unpacking.unpack(read).collect()} == {"one.txt", "two.txt", "deep/one.txt", "_x/.hidden"}


def test_binaries_are_read_to_their_head_only(spark, tmp_path):
    write(tmp_path, {"big.dat": b"\0" + b"x" * 3_000_000, "text.dat": b"y" * 511 + b"z\0", "late.dat": b"y" * 512 + b"\0"})
    for root in (str(tmp_path), f"file://{tmp_path}"):
        roots = spark.createDataFrame([("r", root)], "repo string, root string")
        got = {r.path: (len(r.content), r.size) for r in trees.scan_trees(roots).collect()}
        assert got == {"big.dat": (512, 3_000_001), "text.dat": (513, 513), "late.dat": (513, 513)}


def test_roots_without_a_scheme_need_a_local_session():
    with pytest.raises(ValueError, match="name the file system"):
        trees._Stores(local=False).at("/data/repo")
    assert trees._Stores(local=False).at("file:///data/repo/x")[1] == "/data/repo/x"


def test_parts_keep_their_repo_and_names(spark, tmp_path):
    files = spark.createDataFrame(
        [("007", f"f{i}.md", "some text " * 20) for i in range(6)], "repo string, path string, content string"
    )
    packed = plan.pack(files, 150)
    rows = plan.named_parts(packed, "out", ".md")
    trees.write_parts(rows, str(tmp_path / "parts"))
    again = spark.read.parquet(str(tmp_path / "parts")).orderBy("part").collect()
    assert {r.repo for r in again} == {"007"}
    assert [r.part_name for r in again] == [f"out_part{i}.md" for i in range(1, len(again) + 1)]
    assert all(r.body.startswith(f"=== PART {r.part} of {len(again)} ===\nBelow is") for r in again)
    paths = list(packed.staged)
    assert paths and all(os.path.isdir(p) for p in paths)
    packed.close()
    assert not any(os.path.exists(p) for p in paths) and packed.staged == []


def test_snapshot_is_written_and_not_shuffled(spark, responses, tmp_path):
    spark.createDataFrame(
        [("r", "a.txt", "old"), ("q", "b", "mine")], "repo string, path string, content string"
    ).write.parquet(str(tmp_path / "old"))
    snapshot = spark.read.parquet(str(tmp_path / "old"))
    result = unpack_into(snapshot, responses.filter("resp_id < 3"))
    trees.write_snapshot(result, str(tmp_path / "new"))
    again = {(r.repo, r.path): r.content for r in spark.read.parquet(str(tmp_path / "new")).collect()}
    assert again["r", "a.txt"] == "again" and again["q", "b"] == "mine" and len(again) == 5
    plan_text = result._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan_text and "strategy=broadcast" in plan_text


def test_searches_are_linear(spark):
    texts = [
        ("a.html", "<!--" * 250_000), ("b.html", "x <!-- a --> y\n" + "<!-->" * 200_000), ("c.html", "-->" * 300_000),
        ("k1", "aws_secret" * 100_000), ("k2", "password" * 125_000), ("k3", "token" + " " * 1_000_000),
    ]
    files = spark.createDataFrame([("r", p, c) for p, c in texts], "repo string, path string, content string")
    started = time.time()
    assert files.select(F.sum(F.length(plan.text(True)))).first()[0] > 0
    assert plan.secret_findings(files, strict=True).collect() == []
    assert time.time() - started < 30
    end = spark.createDataFrame([("r", "s", "aws_secret" * 50_000 + "=" + "d/" * 20)], files.schema)
    assert [r.rule for r in plan.secret_findings(end).collect()] == ["AWS Secret Access Key"]


def test_findings_of_what_is_packed(spark):
    secret_text = "password = '" + "x1" * 8 + "'"
    files = spark.createDataFrame(
        [("r", p, secret_text) for p in ("a.py", "node_modules/i.js", "logo.png", "off/b.py")] + [("r", "c.go", "x")],
        "repo string, path string, content string",
    )
    rules = spark.createDataFrame([("r", 1, "off", False)], "repo string, seq int, path string, selected boolean")
    packed = plan.pack(files, selection=rules)
    assert [r.path for r in plan.secret_findings(plan.packed_files(packed)).collect()] == ["a.py"]
    totals = plan.pack_totals(packed).first()
    assert (totals.all_files, totals.n_files, totals.n_parts) == (3, 2, 1)


def test_staging_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.staging_root(Session)
    Context.getCheckpointDir = lambda self: "hdfs://shared/x/"
    assert session.staging_root(Session) == "hdfs://shared/x"


def test_roundtrip(spark):
    rows = [
        ("plain", "a\nb"), ("ended.txt", "a\n"), ("fence.md", "a\n```\nb"), ("with space", "a"),
        ("cdata", "a ]]> b"), ("close", "a\n</file>\nb"), ("crlf", "a\r\nb"), ('q"uote', "a"), ("gone", "a]]>"),
    ]
    files = spark.createDataFrame([("r", p, c) for p, c in rows], "repo string, path string, content string")
    got = {(r.path, r.fmt): r.fidelity for r in roundtrip_report(files).collect()}
    assert {p: (got[p, "xml"], got[p, "markdown"]) for p, _ in rows} == {
        "plain": ("exact", "exact"), "ended.txt": ("newline", "newline"), "fence.md": ("exact", "changed"),
        "with space": ("exact", "renamed"), "cdata": ("exact", "exact"), "close": ("changed", "exact"),
        "crlf": ("changed", "changed"), 'q"uote': ("renamed", "exact"), "gone": ("exact", "exact"),
    }


def test_streams(spark, tmp_path, responses):
    files = spark.createDataFrame(
        [("r", "a.go", "x // c\n"), ("r", "bin/x", "x"), ("r", "p.png", "x"), ("r", ".env", "token = '12345678'")],
        "repo string, path string, content string",
    )
    files.write.parquet(str(tmp_path / "files"))
    responses.write.parquet(str(tmp_path / "responses"))

    def run(name, table, schema, transform):
        stream = transform(spark.readStream.schema(schema).parquet(str(tmp_path / table)))
        query = (
            stream.writeStream.format("memory").queryName(name)
            .option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
        return spark.table(name).collect()

    got = {r.path: r for r in run("s_blocks", "files", files.schema, stream_blocks)}
    assert set(got) == {"a.go", ".env"}
    assert got["a.go"].block == "## File: a.go (Size: 0.00 KB | Tokens: 0)\n```go\nx \n```\n\n"
    assert got[".env"].findings == [ENV_LABEL, "Generic API Key/Secret"]
    batch = sorted(tuple(r) for r in unpacking.unpack(responses).collect())
    assert sorted(tuple(r) for r in run("s_unpack", "responses", responses.schema, unpacking.unpack)) == batch


def test_a_deep_chain_takes_few_jobs(spark, tmp_path, monkeypatch):
    folder, expected = tmp_path / "deep", set()
    for k in range(200):
        folder = folder / f"d{k}"
        if k == 150:
            (tmp_path / "deep").joinpath(*[f"d{i}" for i in range(150)], "node_modules").mkdir(parents=True)
    folder.mkdir(parents=True)
    at = tmp_path / "deep"
    for k in range(200):
        at = at / f"d{k}"
        if k % 9 == 0:
            (at / f"f{k}").write_text("x")
            expected.add(str((at / f"f{k}").relative_to(tmp_path / "deep")))
    (tmp_path / "deep" / "d0" / "node_modules").mkdir()
    (tmp_path / "deep" / "d0" / "node_modules" / "x").write_text("x")
    for k in range(300):  # and a wide place
        (tmp_path / "deep" / "wide" / f"w{k}").mkdir(parents=True)
        (tmp_path / "deep" / "wide" / f"w{k}" / "f").write_text("x")
        expected.add(f"wide/w{k}/f")
    jobs = []
    staged = trees.stage
    monkeypatch.setattr(trees, "stage", lambda df: jobs.append(1) or staged(df))
    roots = spark.createDataFrame([("r", str(tmp_path / "deep"))], "repo string, root string")
    for budget, most in ((64, 6), (7, 40)):
        jobs.clear()
        listed = [r.path for r in trees.list_trees(roots, budget=budget).collect()]
        assert len(listed) == len(set(listed)) and set(listed) == expected
        assert len(jobs) <= most


def test_hidden_directories_in_python_and_spark(spark):
    import re

    from corpusloom.functions import globs

    patterns = ["*.x", "[a-c]?", "a\\*b", "x\\zy", "lib*/d", "[^é]z", "q[", "^$"]
    names = ["a.x", "b1", "a*b", "x\\zy", "xzy", "libs/d", "u/libs/d", "éz", "yz", "q[", "^$", "node_modules", "k/.git/y", "a.x\n"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    both = globs.custom_ignore(F.col("p"), patterns) | globs.default_ignore(F.col("p"))
    search = re.compile(globs.hidden_in_python(patterns)).search
    for row in df.select("p", both.alias("hidden")).collect():
        assert bool(search(row.p)) is row.hidden, row.p


def test_blocks_too_many_to_be_looked_up_are_not_copied(spark, monkeypatch):
    files = [("r", f"p{i % 290}", f"old {i} " * 20) for i in range(300)] + [(None, "p1", "x"), ("r", None, "y")]
    news = [("r", f"p{i}", f"new {i} " * 20) for i in range(100, 400)] + [("r", "p3", "old 3 " * 20), (None, "p1", "z")]
    snapshot = spark.createDataFrame(files, "repo string, path string, content string")
    blocks = spark.createDataFrame(news, "repo string, clean_path string, content string")
    looked_up = sorted(map(str, unpacking.apply_blocks(snapshot, blocks).collect()))
    monkeypatch.setattr(session.fits_broadcast, "__defaults__", (0,))
    monkeypatch.setattr(session.lookup_join, "__defaults__", ("left", 0))
    met = unpacking.apply_blocks(snapshot, blocks)
    moved = models.moved_bytes(met)
    assert sorted(map(str, met.collect())) == looked_up
    assert {r.change for r in met.collect()} == {"added", "kept", "replaced", "same"}
    assert moved < 3 * sum(len(c) for _, _, c in files + news)
