import math
import random
import re
from collections import Counter

from corpusloom.llm import secretscan as m


def brute_base(text):
    out = []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out += [("assign", *x.span()) for x in assign.finditer(text) if len(x[2]) >= 6]
    out += [("access", *x.span()) for x in re.finditer("AKIA[A-Z0-9]+", text) if len(x[0]) >= 20]
    out += [("hex", *x.span()) for x in re.finditer("[0-9a-f]+", text) if len(x[0]) >= 24]
    return sorted(out)


def brute_windows(run, least, window=20):
    marks = [False] * len(run)
    for a in range(len(run) - window + 1):
        n = Counter(run[a : a + window])
        if -sum(c / window * math.log2(c / window) for c in n.values()) >= least - 1e-9:
            marks[a : a + window] = [True] * window
    return marks


def test_base_against_plain_patterns():
    rng = random.Random(4)
    parts = ["password", "PassWd", "api_key", "apikey", "token", "ſecret", "toKen", "secret", " ", "=", ": ", '"', "'", "AKIA", "AKIAAKIA",
             "ABCDEFGHIJKLMNOP0", "deadbeef", "0123456789abcdef", "x", "\n", "é", "abc123"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert sorted(m.base_spans(text)) == brute_base(text), text


def test_windows_against_recounting():
    rng = random.Random(6)
    for _ in range(200):
        run = "".join(rng.choice("0123456789abcdef"[: rng.choice([2, 6, 16])]) for _ in range(rng.randrange(80)))
        marks = [False] * len(run)
        for a, b in m.dense_windows(run, 3.0):
            marks[a:b] = [True] * (b - a)
        assert marks == brute_windows(run, 3.0)


KEY = "x7Gq2" + "Zr9LmP4vT1" + "sBn8KcWd"


def test_entropy_and_allow_list():
    assert [s[0] for s in m.entropy_spans(f"use {KEY} now")] == ["entropy_base64"]
    uuid = "-".join(["3f2504e0", "4f89", "11d3", "9a0c", "0305e82c3301"])
    for harmless in (uuid, f"sha256:{'0123456789abcdef' * 4}", f"{KEY}EXAMPLE", "a" * 100 + "1", "antidisestablishmentarianism",
                     "https://www.example.net/de/the-quick-brown-fox-jumps-over-2024/index.html"):
        assert m.entropy_spans(f"see {harmless} .") == []
    for kept in (f"https://host/{KEY}", f"https://user:{KEY}@host/x", f"http://h/x?sig={KEY}&a=1", f"https://h/a/{KEY}/b-c"):
        assert [kept[a:b] for _, a, b in m.entropy_spans(kept)] == [KEY], kept
    # Cut at what is allowed, not dropped with it.
    text = f"{KEY}/{uuid} md5:{KEY} {KEY * 2}EXAMPLE"
    assert [text[a:b] for _, a, b in m.entropy_spans(text)][0].startswith(KEY)
    assert len(m.entropy_spans(text)) == 3


def brute_entropy(text):
    """Marks of every class, window by window, candidate by candidate."""
    free = [True] * len(text)
    for pattern in m.ALLOW:
        for x in re.finditer(pattern, text):
            free[x.start() : x.end()] = [False] * (x.end() - x.start())
    in_url = [False] * len(text)
    for x in re.finditer(r"https?://[^\s\"'<>]+", text):
        in_url[x.start() : x.end()] = [True] * (x.end() - x.start())
    whole = set()
    for x in re.finditer(r"[A-Za-z0-9+/_-]+", text):
        if x.end() - x.start() >= 20:
            whole |= set(range(x.start(), x.end()))

    def usable(i):
        return i in whole and free[i] and not (in_url[i] and text[i] in "/-")

    found, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and usable(j) and in_url[j] == in_url[i]:
            j += 1
        piece = text[i:j]
        if len(piece) >= 20 and re.search("[0-9]", piece) and re.search("[A-Za-z]", piece):
            for kind, (chars, least) in m.CLASSES.items():
                marks = [False] * len(piece)
                for x in re.finditer(f"[{chars}]+", piece):
                    for a in range(x.start(), x.end() - 19):
                        counts = Counter(piece[a : a + 20]).values()
                        if -sum(c / 20 * math.log2(c / 20) for c in counts) >= least - 1e-9:
                            marks[a : a + 20] = [True] * 20
                for x in re.finditer("1+", "".join("01"[v] for v in marks)):
                    part = piece[x.start() : x.end()]
                    if re.search("[0-9]", part) and re.search("[A-Za-z]", part):
                        found.append((kind, i + x.start(), i + x.end()))
        i = max(j, i + 1)
    return sorted(found)


def test_all_spans_against_brute_force(docs):
    rng = random.Random(12)
    uuid = "3f2504e0-4f89-11d3-9a0c-0305e82c3301"
    pieces = [KEY, uuid, "https://", "http://h.x/", "/", "-", "?a=", " ", "\n", "é", "EXAMPLE", "EXAMPLEKEY", "words-and-more", "sha1:" + "0a" * 20,
              "DEADBEEF0123456789", "0123456789abcdef", "q", "_", "@", '"', "Zz9"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9)))) for i in range(1500)]
    rows += [(9000, None), (9001, "")]
    got = {r["doc_id"]: r["spans"] for r in m.scan_secrets(docs(rows)).collect()}
    assert sum(bool(x) for x in got.values()) > 300
    for i, text in rows:
        text = text or ""
        assert got[i] == m.joined(brute_base(text) + brute_entropy(text)), text
    # A base finding stays, whatever the allow-list says.
    assert m.base_spans(f"token = {KEY}EXAMPLE")[0][0] == "assign"


def test_query_columns_and_defined_cases(docs):
    rows = docs([(1, f"é token={KEY}"), (2, None), (3, ""), (None, "deadbeef" * 3), (5, "x"), (5, "x")])
    got = {(r["doc_id"], r["base"], r["spans"]) for r in m.scan_secrets(rows).collect()}
    end = 8 + len(KEY)
    assert (1, f"assign:2:{end}", f"assign:2:{end},entropy_base64:8:{end}") in got
    assert (2, "", "") in got and (3, "", "") in got and (5, "", "") in got
    assert any(r[0] is None and r[1] == "hex:0:24" for r in got)
    assert m.scan_secrets(docs([])).collect() == []


def test_long_texts_are_linear():
    for text in ("password" * 200_000, "token" + " " * 2_000_000, "a1" * 1_000_000, "AKIA" * 500_000, "http://" * 300_000, "-" * 2_000_000 + "1a"):
        m.base_spans(text)
        m.entropy_spans(text)
