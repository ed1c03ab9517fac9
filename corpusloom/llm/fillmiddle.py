"""Fill-in-the-middle: texts cut at two unit boundaries and put in another order.

A unit is a word with the white space before it, or the white space at the end of a text.
A text is held as fixed blocks of bytes, never over two texts. Two Fenwick trees over the
blocks count the units that end in them and the code points that begin in them. A cut after
k units is found by binary lifting down the tree of units, which carries the code points
along; only the block it ends in is looked at byte by byte. Blocks are counted a bounded
stretch at a time, so a very long text takes little more memory than its own bytes.

Cuts and the form are drawn from the SHA-256 of seed and id, so they don't depend on tasks
or on the order of rows.

Defined results: a null text counts as empty, has no units and stays plain. A null id draws
as an empty one. Rows that repeat an id draw alike, each for its own text. Equal draws give an
empty middle, a draw of all units an empty suffix. Texts that hold a mark stay plain, as the
result could not be told apart. White space is blank, tab to carriage return; all other
characters belong to words. An empty table gives no rows. Columns are picked by name at the
start, so others don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACES, by_value, chunks, table, text_bytes

by_value(__name__)

BLOCK = 1024  # bytes of a block of text
STRETCH = 1 << 20  # bytes whose units are looked for at once
SEED = 42
RATE = 50  # percent of the texts that are cut
SPM = 80  # percent of those with the suffix first
MARKS = ("<P>", "<S>", "<M>")  # prefix, suffix, middle
PLAIN, PSM_FORM, SPM_FORM = "plain", "psm", "spm"


class Blocks:
    """Fenwick trees over the blocks of several texts, one after the other in ``data``.

    Text i has the blocks ``first[i]`` to ``first[i + 1]``; node j (from 1 on) of its tree
    is at ``first[i] + j - 1`` and covers the ``j & -j`` blocks up to its own."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, block: int = BLOCK):
        self.data, self.block = data, block
        self.begin, self.end = offsets[:-1], offsets[1:]
        per_text = -(-np.diff(offsets) // block)
        self.first = np.concatenate(([0], np.cumsum(per_text)))
        inside = np.arange(self.first[-1]) - np.repeat(self.first[:-1], per_text)
        self.start = np.repeat(self.begin, per_text) + inside * block
        self.stop = np.minimum(self.start + block, np.repeat(self.end, per_text))
        units, points = self._counts()
        node = inside + 1
        self.units, self.points = self._tree(units, node), self._tree(points, node)
        sums = np.concatenate(([0], np.cumsum(units)))
        self.total = sums[self.first[1:]] - sums[self.first[:-1]]

    def unit_ends(self, start: int, stop: int, last: np.ndarray) -> np.ndarray:
        """Whether a unit ends with each byte: the last of a word or of a text."""
        space = SPACES[self.data[start : stop + 1]]
        ends = np.zeros(stop - start, dtype=bool)
        ends[: len(space) - 1] = (~space[:-1] & space[1:])[: stop - start]
        ends[last - start] = True
        return ends

    def _counts(self) -> tuple[np.ndarray, np.ndarray]:
        units, points = (np.zeros(len(self.start), np.int64) for _ in range(2))
        last = self.end[self.end > self.begin] - 1
        a = 0
        while a < len(self.start):
            b = max(a + 1, int(np.searchsorted(self.stop, self.start[a] + STRETCH, side="right")))
            start, stop = int(self.start[a]), int(self.stop[b - 1])
            own = last[np.searchsorted(last, start) : np.searchsorted(last, stop)]
            at = self.start[a:b] - start
            units[a:b] = np.add.reduceat(self.unit_ends(start, stop, own), at, dtype=np.int64)
            points[a:b] = np.add.reduceat(_begins(self.data[start:stop]), at, dtype=np.int64)
            a = b
        return units, points

    @staticmethod
    def _tree(counts: np.ndarray, node: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(counts)))
        upto = np.arange(1, len(counts) + 1)
        return sums[upto] - sums[upto - (node & -node)]

    def cut(self, text: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and code points before the end of so many units of each text."""
        size = self.first[text + 1] - self.first[text]
        left, points = units.astype(np.int64), np.zeros(len(text), np.int64)
        node = np.zeros(len(text), np.int64)
        step = 1 << (int(size.max(initial=1)).bit_length() - 1)
        while step:
            # A node is passed as long as fewer units than wanted end in it.
            reach = node + step
            where = np.where(reach <= size, self.first[text] + reach - 1, 0)
            go = (reach <= size) & (self.units[where] < left)
            left -= np.where(go, self.units[where], 0)
            points += np.where(go, self.points[where], 0)
            node = np.where(go, reach, node)
            step >>= 1
        place = np.zeros(len(text), np.int64)
        for k in np.flatnonzero(units > 0):
            block = self.first[text[k]] + node[k]
            start, stop = int(self.start[block]), int(self.stop[block])
            last = np.array([stop - 1] if stop == self.end[text[k]] else [], np.int64)
            size_in = int(np.flatnonzero(self.unit_ends(start, stop, last))[left[k] - 1]) + 1
            place[k] = start + size_in - self.begin[text[k]]
            points[k] += np.count_nonzero(_begins(self.data[start : start + size_in]))
        return place, np.where(units > 0, points, 0)


def _begins(data: np.ndarray) -> np.ndarray:
    """Whether a code point begins with each byte of UTF-8."""
    return (data & 0xC0) != 0x80


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers below 2**32 for an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4)]


def _transformed(batch: pa.RecordBatch, seed: int, rate: int, spm: int, block: int) -> pa.RecordBatch:
    data, offsets = text_bytes(batch.column(1))
    blocks = Blocks(data, offsets, block)
    raw = data.tobytes()
    marks = [m.encode() for m in MARKS]
    texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    forms, cuts, outputs = [], [], list(texts)
    for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), texts)):
        h, n = draws(seed, doc_id), int(blocks.total[i])
        if not text or h[2] % 100 >= rate or any(m in text for m in marks):
            forms.append(PLAIN)
            continue
        forms.append(SPM_FORM if h[3] % 100 < spm else PSM_FORM)
        cuts.append((i, *sorted((h[0] % (n + 1), h[1] % (n + 1)))))
    chars: list[list[int | None]] = [[None] * len(texts) for _ in range(2)]
    if cuts:
        text, low, high = np.array(cuts, dtype=np.int64).T
        (at, before), (until, points) = blocks.cut(text, low), blocks.cut(text, high)
        for i, a, b, p, m in zip(*(x.tolist() for x in (text, at, until, before, points - before))):
            prefix, middle, suffix = texts[i][:a], texts[i][a:b], texts[i][b:]
            first, second, third = marks
            if forms[i] == PSM_FORM:
                parts = (first, prefix, second, suffix, third, middle)
            else:
                parts = (second, suffix, first, prefix, third, middle)
            outputs[i] = b"".join(parts)
            chars[0][i], chars[1][i] = p, m
    columns = [
        batch.column(0), pa.array(blocks.total, pa.int64()), pa.array(forms, pa.string()),
        *(pa.array(c, pa.int64()) for c in chars), pa.array(outputs, pa.binary()).cast(pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(
    documents: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, block: int = BLOCK
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): units, 'plain', 'psm' or
    'spm', code points of prefix and middle (null if plain) and the new text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield _transformed(batch, seed, rate, spm, block)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from. Marks occur once each, as no cut text holds one."""
    prefix, suffix, middle = MARKS

    def between(start: str, end: str) -> Column:
        return F.substring_index(F.substring_index(output, end, 1), start, -1)

    tail = F.substring_index(output, middle, -1)
    psm = F.concat(between(prefix, suffix), tail, between(suffix, middle))
    spm = F.concat(between(prefix, middle), tail, between(suffix, prefix))
    return F.when(form == PSM_FORM, psm).when(form == SPM_FORM, spm).otherwise(output)


def op13_fillmiddle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
    FROM documents
), drawn AS (
    SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS c1,
           ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS c2,
           ('0x' || substr(h, 17, 8))::BIGINT % 100 AS d3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS d4
    FROM cut
), formed AS (
    SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d3 >= 50
                   THEN 'plain' WHEN d4 < 80 THEN 'spm' ELSE 'psm' END AS form,
           array_to_string(u[1:least(c1, c2)], '') AS p,
           array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
           array_to_string(u[greatest(c1, c2) + 1:], '') AS s
    FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM formed
"""
