import fnmatch
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.functions import globs, paths
from corpusloom.operators import tree


def frame(spark, rows, schema="repo string, path string, content string"):
    return spark.createDataFrame(rows, schema)


GLOB_CASES = [
    ("*.json", "a/b.json", True), ("*.json", "a.json/x", True), ("*.json", "a.jsonx", False),
    ("logs", "a/logs/b", True), ("logs", "a/logsx", False), ("Logs", "logs", False),
    ("a/*", "a/b/c", True), ("a/*", "x/a/b", False), ("*", "anything/at/all", True),
    ("?", "ab/c", True), ("?", "ab/cd", False), ("a?c", "a/c", False),
    ("[ab]x", "z/bx", True), ("[^ab]x", "bx", False), ("[^ab]x", "cx/y", True),
    ("a[^b]c", "a/c", True), ("a[^b]c", "x/a/c", False), ("[a-c]", "b", True), ("[c-a]", "b", False),
    ("[!a]", "!", True), ("[!a]", "b", False), ("\\*", "*", True), ("\\*", "a", False),
    ("[a", "[a", False), ("[]a]", "a", False), ("[-a]", "a", False), ("a\\", "a", False),
    ("[\\]]", "]", True), ("a+b", "a+b", True), ("a.b", "axb", False), ("*é*", "xéy", True),
]


@pytest.fixture(scope="module")
def glob_results(spark):
    columns = [
        globs.custom_ignore(F.lit(path), [glob]).alias(f"c{i}")
        for i, (glob, path, _) in enumerate(GLOB_CASES)
    ]
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("i", range(len(GLOB_CASES)))
def test_custom_glob(glob_results, i):
    assert glob_results[i] is GLOB_CASES[i][2], GLOB_CASES[i]


IGNORE_CASES = [
    ("*.log", "a/x.log", True), ("*.log\n!keep.log", "a/keep.log", False),
    ("*.log\n!keep.log", "x.log/keep.log", True), ("!keep.log\n*.log", "keep.log", True),
    ("/build", "build/x", True), ("/build", "a/build", False), ("foo/", "foo", False),
    ("foo/", "a/foo/x", True), ("a/b", "a/b/c", True), ("a/b", "x/a/b", False),
    ("**/b", "a/x/b", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True),
    ("a/**", "a/x", True), ("a/**", "a", False), ("# c", "# c", False), ("\\# c", "# c", True),
    ("\\!x", "!x", True), ("x  ", "x", True), ("x\\ ", "x ", True), ("[!a]x", "bx", True),
    ("[!a]x", "ax", False), ("[[:digit:]]x", "1x", True), ("[a-c]?", "bz", True),
    ("[a&&b]", "&", True), ("doc/*.txt", "doc/a/b.txt", False), ("", "x", False),
    ("*.x\n!a.x\n*.x", "a.x", True), ("*.x\n!a.x\n!b.x\nb.x", "b.x", True),
    ("*.x\n!a.x\n!b.x\nc.x", "a.x", False), ("a\r\nb\r\n", "b", True), ("src/*\n!src/k", "src/k/f", False),
    ("[z-a]\nx", "x", True), ("[z-a]", "m", False), ("[!z-a]", "m", True), ("[]x]", "]", True),
    ("[a\\]b]", "]", True), ("[[:nope:]]", "n", False), ("[unclosed", "[unclosed", False),
    ("end\\", "end", False), ("a[+*?.]b", "a?b", True), ("(x|y)$^{1}", "(x|y)$^{1}", True),
    ("src/*", "src", False), ("x[[:alpha:]_-]", "x-", True), ("[é-ü]", "ö", True), ("a[/]b", "a/b", False),
]


def test_ignore_file(spark):
    rows = [(str(i), ".gitignore", rules) for i, (rules, _, _) in enumerate(IGNORE_CASES)]
    rows += [(str(i), path, "") for i, (_, path, _) in enumerate(IGNORE_CASES)]
    rows += [("none", "sub/.gitignore", "*"), ("none", "x", "")]
    files = frame(spark, rows)
    nodes = files.filter("path <> '.gitignore'").select("repo", "path", F.lit(False).alias("is_dir"))
    got = {r.repo + r.path: r.reason for r in tree.ignore_reason(nodes, tree.ignore_rules(files)).collect()}
    for i, (rules, path, hidden) in enumerate(IGNORE_CASES):
        assert (got[str(i) + path] == "file") is hidden, (rules, path)
    assert got["nonex"] is None  # only the root ignore file counts


def test_ignore_file_of_many_rules(spark):
    rules = "\n".join(f"{'!' if i % 3 == 2 else ''}f{i % 50}*.t" for i in range(600))
    rng = random.Random(3)
    names = [f"f{rng.randint(0, 60)}{rng.choice('ab')}.t" for _ in range(80)]

    def hidden(name):
        verdict = False
        for rule in rules.split("\n"):
            if fnmatch.fnmatchcase(name, rule.lstrip("!")):
                verdict = not rule.startswith("!")
        return verdict

    files = frame(spark, [("r", ".gitignore", rules)] + [("r", n, "") for n in set(names)])
    nodes = files.filter("path <> '.gitignore'").select("repo", "path", F.lit(False).alias("is_dir"))
    for r in tree.ignore_reason(nodes, tree.ignore_rules(files)).collect():
        assert (r.reason == "file") is hidden(r.path), r.path


def test_walk(spark):
    files = frame(spark, [
        ("r", ".git/config", "[core]"), ("r", "src/main.go", "package main"),
        ("r", "src/utils.go", "package main"), ("r", ".gitignore", "src/utils.go\n/only/\n"),
        ("r", "README.md", "# T"), ("r", "only/x", "y"), ("r", "pics/a.PNG", "x"), ("r", "nul", "a\0b"),
        ("r", "a.json", "{}"), ("r", "deep/er/b.json", "{}"),
    ])
    got = {(r.path, r.is_dir, r.depth) for r in tree.walk(files, ["*.json"]).collect()}
    assert got == {
        ("src", True, 0), ("src/main.go", False, 1), (".gitignore", False, 0), ("README.md", False, 0),
        ("pics", True, 0), ("deep", True, 0), ("deep/er", True, 1),
    }
    # The rules count even if a glob hides the ignore file itself.
    hidden = {r.path for r in tree.walk(files, [".git*"]).collect()}
    assert "src/utils.go" not in hidden and ".gitignore" not in hidden


def test_binary(spark):
    rows = [
        ("a.png", b"x", "extension"), ("a.TAR.gz", b"x", "extension"), ("a.xyz", b"text", None),
        ("early", b"a\0b", "nul"), ("at512", b"a" * 511 + b"\0", "nul"), ("at513", b"a" * 512 + b"\0", None),
        ("two", b"\x48\x00", "nul"), ("lookalike", b"\x10\x0f", None), ("empty", b"", None),
        ("wide", "é".encode() * 256 + b"\0", None), ("wide2", "é".encode() * 255 + b"a\0", "nul"),
    ]
    df = frame(spark, [(p, c) for p, c, _ in rows], "path string, content binary")
    for column in (F.col("content"), F.col("content").cast("string")):
        got = dict(df.select("path", paths.binary_reason(F.col("path"), column)).collect())
        assert got == {p: reason for p, _, reason in rows}


@pytest.mark.parametrize("window_rows", [0, 100])
def test_order(spark, window_rows, monkeypatch):
    monkeypatch.setattr(session.number_in_order, "__defaults__", ("ord", window_rows))
    nodes = [
        ("r", "main.go", False), ("r", "b", True), ("r", "b/x.go", False), ("r", "a.txt", False),
        ("r", "a", True), ("r", "a/x", False), ("r", "a.b", True), ("r", "a.b/x", False),
        ("r", "a/z", True), ("r", "a/z/1", False), ("r", "é", False), ("r", "Z", False), ("r", "zz", True),
        ("r", "a-b", True), ("q", "x", False),
    ]
    df = frame(spark, nodes, "repo string, path string, is_dir boolean")
    rows = tree.hierarchical_order(df).orderBy("repo", "ord").collect()
    assert [r.path for r in rows if r.repo == "r"] == [
        "a", "a/z", "a/z/1", "a/x", "a-b", "a.b", "a.b/x", "b", "b/x.go", "zz",
        "Z", "a.txt", "main.go", "é",
    ]
    assert [r.ord for r in rows] == [1] + list(range(1, 15))


def test_order_of_a_group_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [("big", f"{rng.randint(0, 10**9):010d}{i}") for i in range(20_000)]
    rows += [(f"s{i % 7}", f"k{i}") for i in range(50)]
    df = frame(spark, rows, "repo string, key string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = session.number_in_order(df, "repo", "key", window_rows=0).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {}
    for r in sorted(numbered, key=lambda r: r.ord):
        got.setdefault(r.repo, []).append(r.key)
        assert r.ord == len(got[r.repo])
    expected = {}
    for repo, key in sorted(rows):
        expected.setdefault(repo, []).append(key)
    assert got == expected


def test_selection(spark):
    nodes = frame(spark, [
        ("r", "a", True), ("r", "a/x", False), ("r", "a/y", False), ("r", "ab/z", False), ("q", "a/x", False),
    ], "repo string, path string, is_dir boolean")
    rules = frame(spark, [
        ("r", 1, "a", False), ("r", 2, "a/x", True), ("r", 3, "a/y", True), ("r", 4, "a/y", False),
    ], "repo string, seq int, path string, selected boolean")
    got = {(r.repo, r.path): r.selected for r in tree.select_subtree(nodes, rules).collect()}
    assert got == {("r", "a"): False, ("r", "a/x"): True, ("r", "a/y"): False, ("r", "ab/z"): True, ("q", "a/x"): True}
    later = rules.unionByName(frame(spark, [("r", 9, "a", False)], rules.schema))
    assert not tree.select_subtree(nodes, later).filter("repo = 'r' and path = 'a/x'").first().selected


def test_hide(spark):
    nodes = frame(spark, [
        ("r", "a", True), ("r", "a/b", True), ("r", "a/b/c", False), ("r", "ab", False), ("q", "a/b", False),
    ], "repo string, path string, is_dir boolean")
    shut = frame(spark, [("r", "a/b"), ("r", "a/b")], "repo string, path string")
    got = {(r.repo, r.path) for r in tree.hide_descendants(nodes, shut).collect()}
    assert got == {("r", "a"), ("r", "a/b"), ("r", "ab"), ("q", "a/b")}


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_salted_lookup_equals_broadcast(spark, how):
    left = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 11).cast("string")).alias("repo"), "id"
    )
    right = frame(spark, [("hot", 1), ("3", 2), ("5", 3), ("x", 4)], "repo string, v int")
    small = session.lookup_join(left, right, ["repo"], how)
    large = session.lookup_join(left, right, ["repo"], how, limit=0)
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, large.collect()), key=str)


def test_path_pieces(spark):
    rows = [
        ("a/b.C", "b.C", 1, ".c", ""), (".env", ".env", 0, ".env", ""), ("x/Dockerfile", "Dockerfile", 1, "", ""),
        ("a.b/c", "c", 1, "", ""), ("q.tar.GZ", "q.tar.GZ", 0, ".gz", ""), ("m.tsx", "m.tsx", 0, ".tsx", "typescript"),
        ("x.", "x.", 0, ".", ""),
    ]
    df = frame(spark, [(r[0],) for r in rows], "p string")
    p = F.col("p")
    got = df.select("p", paths.name(p), paths.depth(p), paths.extension(p), paths.language(p)).collect()
    assert [tuple(r) for r in got] == rows
    w = spark.range(1).select(
        paths.relative_path(F.lit("C:\\r\\a\\b"), F.lit("C:\\r"), windows=True),
        paths.relative_path(F.lit("/r/a\\b"), F.lit("/r")),
    ).first()
    assert tuple(w) == ("a/b", "a\\b")


def test_path_status(spark):
    rows = [
        ("a/./b/../c", "a/c", "ok"), ("../x", "../x", "traversal"), ("/abs", "/abs", "traversal"),
        ("a/../../x", "../x", "traversal"), ("..x", "..x", "traversal"), ("a/..", ".", "directory"),
        ("", ".", "directory"), ("/../a", "/a", "traversal"), ("../../a/..", "../..", "traversal"),
        ("a//b/", "a/b", "ok"), ("a/...", "a/...", "ok"), ("/", "/", "traversal"),
    ]
    df = frame(spark, [(r[0],) for r in rows], "p string")
    got = df.select("p", paths.clean_path(F.col("p")), paths.path_status(F.col("p"))).collect()
    assert [tuple(r) for r in got] == rows


def test_ignore_file_of_random_rules(spark):
    """Both regexes against the rules one by one, each on every prefix."""
    rng = random.Random(11)
    names = ["a", "b", "ab", "x.log", "y.log", "d"]

    def pattern():
        body = rng.choice(["a", "*.log", "b", "a*", "?", "d/b", "a/**", "**/b", "a/*/b", "[ab]b", "*"])
        return rng.choice(["", "", "!"]) + rng.choice(["", "", "/"]) + body + rng.choice(["", "", "/"])

    def matches(rule, prefix, is_dir):
        dir_only, bare = rule.endswith("/"), rule.rstrip("/")
        if dir_only and not is_dir:
            return False
        anchored, bare = "/" in bare, bare.lstrip("/")
        out, i = "", 0
        while i < len(bare):
            if bare.startswith("/**/", i):
                out, i = out + "/(?:.*/)?", i + 4
            elif i == 0 and bare.startswith("**/"):
                out, i = "(?:.*/)?", 3
            elif bare[i:] == "/**":
                out, i = out + "/.+", len(bare)
            else:
                c = bare[i]
                end = bare.find("]", i)
                out += "[^/]*" if c == "*" else "[^/]" if c == "?" else bare[i : end + 1] if c == "[" else re.escape(c)
                i = end + 1 if c == "[" else i + 1
        return re.fullmatch(("" if anchored else "(?:.*/)?") + out, prefix) is not None

    def hidden(rules, path):
        seg = path.split("/")
        for k in range(1, len(seg) + 1):
            verdict = False
            for rule in rules:
                if matches(rule.lstrip("!"), "/".join(seg[:k]), k < len(seg)):
                    verdict = not rule.startswith("!")
            if verdict:
                return True
        return False

    lists = {f"r{i}": [pattern() for _ in range(rng.randint(1, 6))] for i in range(60)}
    rows = [(repo, "/".join(rng.choice(names) for _ in range(rng.randint(1, 4))), "") for repo in lists for _ in range(25)]
    files = frame(spark, rows + [(repo, ".gitignore", "\n".join(rules)) for repo, rules in lists.items()])
    nodes = files.filter("path <> '.gitignore'").select("repo", "path", F.lit(False).alias("is_dir"))
    for r in tree.ignore_reason(nodes, tree.ignore_rules(files)).collect():
        assert (r.reason == "file") is hidden(lists[r.repo], r.path), (lists[r.repo], r.path)


def test_rules_are_met_repo_by_repo(spark):
    """The sort that saves compiling stays in the plan, whatever comes behind it."""
    files = frame(spark, [("r", ".gitignore", "x"), ("r", "x/y", ""), ("s", "z", "")])
    marked = tree.ignore_reason(tree.tree_nodes(files), tree.ignore_rules(files)).groupBy("reason").count()
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [repo" in plan


def random_tree(rng, repos, files):
    """Rows (repo, path, is_dir, size) with names that sort around the separator."""
    names = ["a", "b", "a.b", "a-b", "a\x01", "a\x00x", "é", "zz"]
    rows = set()
    for _ in range(files):
        repo, path = f"r{rng.randrange(repos)}", "/".join(rng.choice(names) for _ in range(rng.randint(1, 5)))
        above = [path.rsplit("/", k)[0] for k in range(1, path.count("/") + 1)]
        if (repo, path + "/f", False) in rows or any((repo, p, False) in rows for p in above):
            continue
        rows.add((repo, path + "/f", False))
        rows |= {(repo, p, True) for p in [path, *above]}
    return sorted((*r, 0 if r[2] else rng.randrange(100)) for r in rows)


NODE_SCHEMA = "repo string, path string, is_dir boolean, size bigint"


@pytest.mark.parametrize("window_rows", [0, 10**6])
def test_subtrees_of_random_trees(spark, window_rows):
    rng = random.Random(window_rows + 1)
    nodes = random_tree(rng, 3, 250)
    dirs = [n for n in nodes if n[2]]
    below = lambda path, top: path.startswith(top + "/")
    df = frame(spark, nodes, NODE_SCHEMA).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shut = rng.sample(dirs, 12)
        got = {tuple(r) for r in tree.hide_descendants(df, frame(spark, shut, NODE_SCHEMA), window_rows).collect()}
        assert got == {n for n in nodes if not any(n[0] == s[0] and below(n[1], s[1]) for s in shut)}

        picked = rng.sample(nodes, 40) + [("r0", "absent/x", False, 0), ("none", "a", True, 0)]
        rules = [(n[0], seq, n[1], rng.random() < 0.5) for seq, n in enumerate(picked + picked[:5])]

        def on(n):
            verdict = True
            for repo, _, path, selected in rules:
                if repo == n[0] and (n[1] == path or below(n[1], path)):
                    verdict = selected
            return verdict

        rule_df = frame(spark, rules, "repo string, seq int, path string, selected boolean")
        marked = tree.select_subtree(df, rule_df, window_rows)
        assert marked.columns == [*df.columns, "selected"]
        assert {tuple(r) for r in marked.collect()} == {(*n, on(n)) for n in nodes}

        totals = tree.subtree_totals(df, ["size"], window_rows)
        expected = {}
        for repo, path, is_dir, _ in [*nodes, *((r, "", True, 0) for r in {n[0] for n in nodes})]:
            own = [n for n in nodes if n[0] == repo and not n[2] and (path == "" or n[1] == path or below(n[1], path))]
            expected[repo, path] = (is_dir, len(own), sum(n[3] for n in own))
        assert {(r.repo, r.path): (r.is_dir, r.n_files, r["size"]) for r in totals.collect()} == expected

        summed = tree.selection_totals(totals, rule_df, ["size"]).collect()
        for r in summed:
            chosen = [n for n in nodes if n[0] == r.repo and not n[2] and on(n)]
            assert (r.selected_files, r.selected_size) == (len(chosen), sum(n[3] for n in chosen))
            assert r.all_files == expected[r.repo, ""][1]
        assert len(summed) == len({n[0] for n in nodes})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("how", ["sum", "last"])
def test_sweep_over_ranges(spark, how):
    rng = random.Random(5)
    rows = [(rng.choice("aab"), k, rng.choice([None, None, 1, 2, 3])) for k in range(4000)]
    df = frame(spark, rows, "g string, k int, v int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.k: r.v_upto for r in session.swept(df, ["g"], ["k"], ["v"], how, window_rows=0).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    state = {}
    for g, k, v in rows:
        if v is not None:
            state[g] = v if how == "last" else state.get(g, 0) + v
        assert got[k] == state.get(g)


def test_subtree_operators_without_rows(spark):
    none = frame(spark, [], NODE_SCHEMA)
    rules = frame(spark, [], "repo string, seq int, path string, selected boolean")
    one = frame(spark, [("r", "a", False, 3)], NODE_SCHEMA)
    assert tree.hide_descendants(none, one).collect() == []
    assert tree.select_subtree(one, rules).first().selected
    assert [r.n_files for r in tree.subtree_totals(one, ["size"]).collect()] == [1, 1]
    assert tree.selection_totals(tree.subtree_totals(none, ["size"]), rules, ["size"]).collect() == []
