"""Secret scan: fixed patterns and sliding-window entropy.

Base findings come from three patterns. Besides, every candidate string (a run of
key-like characters) is scanned per character class: a window slides over the run, its
Shannon entropy is kept up to date from incremental counts, and windows above the
threshold of the class are joined to spans. An allow-list names what is dense but no
secret by its own shape: UUIDs, digests with their name, documented sample keys. Candidates
are cut there, and what is left on either side is scanned as before. Inside a URL each part
between '/', '-' and other marks is a candidate of its own, so that keys in user parts, paths
and queries are found and words joined by hyphens are not. Base findings are never touched.

Defined results: a null text counts as empty and has no span. Every row is scanned by
itself, so repeated rows and ids give repeated results. Spans of one start come in the order
of ``KINDS``, then by end. Positions are code points. An empty table gives no rows. Texts are
scanned whole, in time linear in their length. Columns are picked by name at the start, so
others don't matter, whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import by_value, chunks, table

by_value(__name__)

WINDOW = 20
# Class: characters, least entropy of a window in bits. Fixed values.
CLASSES = {
    "entropy_hex": ("0-9a-fA-F", 3.0),
    "entropy_upper": ("A-Z0-9", 3.4),
    "entropy_base64": ("A-Za-z0-9+/_-", 3.8),
}
KINDS = ["assign", "access", "hex", *CLASSES]
_KEY = "A-Za-z0-9+/_-"
# Stretches that are no part of a candidate. Fixed values.
ALLOW = [
    r"(?<![0-9a-fA-F-])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9a-fA-F-])",
    r"(?:md5[:-][0-9a-fA-F]{32}|sha1[:-][0-9a-fA-F]{40}|sha256[:-](?:[0-9a-fA-F]{64}|[0-9A-Za-z+/]{43}=)"
    r"|sha512[:-](?:[0-9a-fA-F]{128}|[0-9A-Za-z+/]{86}==))(?![0-9A-Za-z+/])",
    # A sample key ends in this word and is no longer than the keys it stands for.
    rf"(?<![{_KEY}])[{_KEY}]{{0,33}}EXAMPLE(?:KEY)?(?![{_KEY}])",
]

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_WORDS = ("passw", "secret", "token", "api")  # every keyword has one of these
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_RUN = re.compile(rf"(?<![{_KEY}])[{_KEY}]{{{WINDOW},}}")
_URL = re.compile(r"https?://[^\s\"'<>]+")
_URL_PART = re.compile(rf"[A-Za-z0-9+_]{{{WINDOW},}}")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
_ALLOW = re.compile("|".join(ALLOW))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = []
    low = text.lower()
    if any(word in low for word in _WORDS):
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    return spans + [("hex", *m.span()) for m in _HEX.finditer(text)]


def dense_windows(run: str, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Joined windows of ``run`` with an entropy of ``least`` bits or more."""
    if len(run) < window:
        return []
    plogp = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, full, spans = 0.0, math.log2(window), []
    for i, char in enumerate(run):
        if i >= window:
            old = run[i - window]
            n = counts[old]
            counts[old] = n - 1
            total += plogp[n - 1] - plogp[n]
        n = counts.get(char, 0)
        counts[char] = n + 1
        total += plogp[n + 1] - plogp[n]
        if i >= window - 1 and full - total / window >= least - 1e-9:
            start = i - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


_CLASS_RUNS = {kind: (re.compile(rf"[{chars}]{{{WINDOW},}}"), least) for kind, (chars, least) in CLASSES.items()}


def _cut(start: int, end: int, stretches: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What is left of start to end without the stretches, which are sorted and apart."""
    k = max(0, bisect_left(stretches, (start, 0)) - 1)
    while k < len(stretches) and stretches[k][0] < end:
        if stretches[k][1] > start:
            if stretches[k][0] > start:
                yield start, stretches[k][0]
            start = stretches[k][1]
        k += 1
    if start < end:
        yield start, end


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Where strings begin and end that could hold a secret."""
    runs = [m.span() for m in _RUN.finditer(text)]
    if not runs:
        return
    allowed = [m.span() for m in _ALLOW.finditer(text)]
    urls = [m.span() for m in _URL.finditer(text)] if "://" in text else []
    for run in runs:
        for start, end in _cut(*run, allowed):
            for part in _cut(start, end, urls):
                if part[1] - part[0] >= WINDOW:
                    yield part
            if urls:
                # The rest of it, which lies in a URL.
                outside = list(_cut(start, end, urls))
                for part in _cut(start, end, outside):
                    yield from (m.span() for m in _URL_PART.finditer(text, *part))


def entropy_spans(text: str) -> list[tuple[str, int, int]]:
    spans = []
    for at, until in candidates(text):
        if not _DIGIT.search(text, at, until) or not _LETTER.search(text, at, until):
            continue
        for kind, (pattern, least) in _CLASS_RUNS.items():
            for part in pattern.finditer(text, at, until):
                for start, end in dense_windows(part[0], least):
                    start, end = part.start() + start, part.start() + end
                    if _DIGIT.search(text, start, end) and _LETTER.search(text, start, end):
                        spans.append((kind, start, end))
    return spans


def joined(spans: list[tuple[str, int, int]]) -> str:
    spans = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _scanned(batches):
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"]
    for batch in chunks(batches):
        columns = {name: [] for name in names[1:]}
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            for kind in ("assign", "access", "hex"):
                columns[f"n_{kind}"].append(sum(s[0] == kind for s in base))
            columns["base"].append(joined(base))
            columns["spans"].append(joined(base + entropy_spans(text)))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(columns[n], t) for n, t in zip(names[1:], kinds))], names=names
        )


def scan_secrets(documents: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans): ``base`` and ``spans`` list
    kind:start:end, the first of the fixed patterns only, the second of all kinds."""
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _scanned, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base string, spans string"
    )


def op8_secretscan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans"
    )
