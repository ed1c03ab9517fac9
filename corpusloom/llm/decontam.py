"""Benchmark decontamination by template canonicalisation.

Words become a template: punctuation is dropped, letters are lower-cased, and numbers,
units behind a number and runs of names become typed placeholders, whose
values are kept as slots. A number is parted from letters that follow it, so 5km is 5 km. A
unit is what is counted: in any language the word after a number, if it has ``UNIT_BYTES``
bytes or more or is a known symbol; shorter words are mostly articles and conjunctions. A name
begins with a capital of any alphabet that has them, but not at the head of a sentence. Windows of ``WINDOW`` template words are hash-joined with those
of the benchmark items. A document has an item if it holds at least ``COVERAGE`` of the
item's windows and the slots agree: each value of the item stands for the same value of
the document wherever it occurs, and the other way round. So a question with other
numbers or names is found, while a chance meeting of templates is not.

This is asked of all matches in the document together, of those of each occurrence (same
distance between the places in the document and in the item) and of those of neighbouring
occurrences (distances no more than a window apart, as words may be put in or left out).
One that agrees is enough, so several versions of an item in one document don't hide it.

Items without any window of ``MIN_LITERALS`` words other than numbers and names (arithmetic,
tables, lists of names) are searched word by word instead: windows of their words as they
stand, in which a number or name is no placeholder. So verbatim copies of them are found.

Defined results: null or empty texts, and items without a letter or digit, match nothing;
items shorter than a window are one window of their own length. Items of fewer than
``MIN_WORDS`` words are found word for word only. Rows that
repeat a document id are one document, and so are all rows without an id. Items that
repeat an id count as one item with the windows of all. Of matches that agree, the one of the
whole document is told, else the fullest, then the one with the fewest changes. Empty tables give no rows. Texts
are taken whole, whatever their length. Columns are picked by name at the start, so others
don't matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER, SPACES, by_value, byte_codes, chunks, mix, powers, table, text_bytes, word_groups, word_starts
from corpusloom.session import fits_broadcast

by_value(__name__)

WINDOW = 8
MIN_WORDS = 5
MIN_LITERALS = 4  # words of a window that are no numbers and no names
COVERAGE = 0.5
AGREEMENT = 0.8
EXACT = 1 << 40  # tells windows of words as they stand, and their places, from those of templates
FILTER_WINDOWS = 2_000_000  # benchmark windows that are sent to every task as a filter

UNIT_BYTES = 4
# Symbols and words of units that are shorter. Fixed values.
UNITS = (
    "km m cm mm ft in yd kg g mg lb lbs oz ton t l ml s ms sec min h hr day d mi usd eur gbp mph kmh w kw v a j cal hz khz mhz "
    "b kb mb gb tb k c f"
).split()

_CORE = np.zeros(256, bool)
_CORE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = _CORE & ~_DIGIT
# Capitals among the characters of one or two bytes.
_CAPITAL = np.array([chr(c).isupper() for c in range(0x800)])
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?:|"]] = True
# Placeholder codes.
NUMBER, UNIT, NAME = (mix(np.array([k], np.uint64))[0] for k in (101, 102, 103))


def _word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the letters and digits of each word, their number and that of digits."""
    codes = byte_codes(3)
    codes[~_CORE] = 0
    value = np.empty(len(starts), np.uint64)
    n_core, n_digit = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
    for a, b, part, at in word_groups(data, starts):
        core = _CORE[part]
        before = np.cumsum(core) - core
        place = before - np.repeat(before[at], np.diff(np.concatenate((at, [len(part)]))))
        with np.errstate(over="ignore"):
            value[a:b] = mix(np.add.reduceat(codes[LOWER[part]] * powers(int(place.max()) + 1)[place], at))
        n_core[a:b] = np.add.reduceat(core, at, dtype=np.int64)
        n_digit[a:b] = np.add.reduceat(_DIGIT[part], at, dtype=np.int64)
    return value, n_core, n_digit


def _unit_hashes() -> np.ndarray:
    data, offsets = text_bytes(pa.array([" ".join(UNITS)]))
    starts, _ = word_starts(data, offsets)
    return np.sort(_word_hashes(data, starts)[0])


def _parted(data: np.ndarray, starts: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with a number's letters as a word of their own."""
    core, letter = np.flatnonzero(_CORE[data]), np.flatnonzero(_LETTER[data])
    if not len(letter):
        return starts, per_row
    ends = np.append(starts[1:], len(data))
    lead = core[np.minimum(np.searchsorted(core, starts), len(core) - 1)]
    first = letter[np.minimum(np.searchsorted(letter, starts), len(letter) - 1)]
    cut = (lead >= starts) & (lead < ends) & _DIGIT[data[lead]] & (first > lead) & (first < ends)
    row = np.repeat(np.arange(len(per_row)), per_row)
    return np.sort(np.concatenate((starts, first[cut]))), per_row + np.bincount(row[cut], minlength=len(per_row))


def template(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template word, slot value and whether it is a slot, for all rows in order, and
    the number of template words of each row."""
    return _read(text)[0]


def _read(text: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The template of all rows, and their words as they stand with the number of each row."""
    data, offsets = text_bytes(text)
    starts, per_row = word_starts(data, offsets)
    starts, per_row = _parted(data, starts, per_row)
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return (none, none, np.zeros(0, bool), per_row), (none, per_row)
    value, n_core, n_digit = _word_hashes(data, starts)
    row = np.repeat(np.arange(len(per_row)), per_row)
    new_row = np.concatenate(([True], row[1:] != row[:-1]))
    # Last byte of a word, and whether a line ends between it and the next.
    last = data[starts + np.add.reduceat(~SPACES[data], starts, dtype=np.int64) - 1]
    breaks = np.add.reduceat((data == 10).astype(np.int64), starts) > 0
    opens = new_row.copy()
    opens[1:] |= _ENDS[last[:-1]] | breaks[:-1]
    core = np.flatnonzero(_CORE[data])
    lead = core[np.minimum(np.searchsorted(core, starts), max(0, len(core) - 1))] if len(core) else starts
    lead_byte, next_byte = data[lead], data[np.minimum(lead + 1, len(data) - 1)]
    two = (lead_byte >= 0xC2) & (lead_byte < 0xE0)
    point = np.where(two, (lead_byte.astype(np.int64) & 0x1F) << 6 | (next_byte & 0x3F), np.where(lead_byte < 0x80, lead_byte, 0))
    capital = _CAPITAL[point]
    keep = n_core > 0
    value, row, opens, capital, n_core, n_digit = (x[keep] for x in (value, row, opens, capital, n_core, n_digit))
    if not len(value):
        none = np.zeros(len(per_row), np.int64)
        return (value, value, np.zeros(0, bool), none), (value, none)
    number = n_digit == n_core
    same = np.concatenate(([False], row[1:] == row[:-1]))
    counted = (n_core >= UNIT_BYTES) & (n_digit == 0) & ~capital
    unit = (counted | np.isin(value, _unit_hashes())) & ~number & same & ~opens & np.concatenate(([False], number[:-1]))
    name = capital & ~opens & ~number & ~unit
    word = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, value)))
    slot = number | unit | name
    # A run of names is one placeholder with one value.
    goes_on = name & same & np.concatenate(([False], name[:-1]))
    heads = np.flatnonzero(~goes_on)
    with np.errstate(over="ignore"):
        joined = np.add.reduceat(mix(value + (np.arange(len(value)) - heads[np.cumsum(~goes_on) - 1]).astype(np.uint64)), heads)
    rows = len(per_row)
    made = word[heads], joined, slot[heads], np.bincount(row[heads], minlength=rows)
    return made, (value, np.bincount(row, minlength=rows))


def windows(word: np.ndarray, slot: np.ndarray, per_row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word) of every window with enough literal words."""
    n = len(word) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(per_row)), per_row)
    weight = mix(np.arange(1, size + 1, dtype=np.uint64) + np.uint64(size << 8)) | np.uint64(1)
    with np.errstate(over="ignore"):
        value = sum(word[k : k + n] * weight[k] for k in range(size))
    # What is counted may be another thing, but that something is counted is kept.
    literal = np.concatenate(([0], np.cumsum(~slot | (word == UNIT))))
    fits = (row[:n] == row[size - 1 :]) & (literal[size:] - literal[:-size] >= min(MIN_LITERALS, size))
    at = np.flatnonzero(fits)
    return mix(value[at]), row[at], at


def exact_windows(value: np.ndarray, per_row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for every window of words as they stand; no hash is that of a template."""
    h, row, at = windows(value, np.zeros(len(value), bool), per_row, size)
    return mix(h ^ np.uint64(EXACT)), row, at


def _no_slots(n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.int64()))


def _slots(values: np.ndarray, slot: np.ndarray, at: np.ndarray, size: int) -> pa.Array:
    inside = at[:, None] + np.arange(size)
    mask = slot[inside]
    flat = values[inside][mask].view(np.int64)
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate(([0], np.cumsum(mask.sum(axis=1)))).astype(np.int32)), pa.array(flat)
    )


def _document_windows(batches, sizes: list[int], wanted):
    names = ["doc_id", "h", "slots", "pos", "part"]
    for batch in chunks(batches):
        (word, values, slot, per_row), (raw, raw_per_row) = _read(batch.column(1))
        known = None if wanted is None else wanted.value
        first, raw_first = np.cumsum(per_row) - per_row, np.cumsum(raw_per_row) - raw_per_row
        # Rows of one id are told apart by what they say.
        with np.errstate(over="ignore"):
            said = mix(values + (np.arange(len(values)) - np.repeat(first, per_row)).astype(np.uint64))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(said, dtype=np.uint64)))
            part = (sums[first + per_row] - sums[first]).view(np.int64)
        for size in sizes:
            exact = size < 0
            h, row, at = exact_windows(raw, raw_per_row, -size) if exact else windows(word, slot, per_row, size)
            if known is not None:
                if not len(known):
                    continue
                place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[place] == h
                h, row, at = h[hit], row[hit], at[hit]
            if len(h):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row)), pa.array(h.view(np.int64)), _no_slots(len(h)) if exact else _slots(values, slot, at, size),
                        pa.array(at - raw_first[row] + EXACT if exact else at - first[row]), pa.array(part[row]),
                    ],
                    names=names,
                )


def _item_windows(batches, size: int):
    """``size`` is below 0 for windows of words as they stand."""
    names = ["item_id", "h", "place", "size", "item_slots"]
    for batch in chunks(batches):
        (word, values, slot, per_row), (raw, raw_per_row) = _read(batch.column(1))

        def made(h, row, place, n, slots):
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(h.view(np.int64)), pa.array(place), pa.array(np.full(len(h), n, np.int32)), slots],
                names=names,
            )

        first, raw_first = np.cumsum(per_row) - per_row, np.cumsum(raw_per_row) - raw_per_row
        usable = np.zeros(len(per_row), bool)
        for n in range(MIN_WORDS, size + 1):
            rows = np.flatnonzero(per_row == n) if n < size else np.flatnonzero(per_row >= n)
            h, row, at = windows(word, slot, per_row, n)
            keep = np.isin(row, rows)
            h, row, at = h[keep], row[keep], at[keep]
            usable[row] = True
            if len(h):
                yield made(h, row, at - first[row], n, _slots(values, slot, at, n))
        for n in range(1, size + 1):
            rows = np.flatnonzero(~usable & (raw_per_row == n if n < size else raw_per_row >= n))
            h, row, at = exact_windows(raw, raw_per_row, n)
            keep = np.isin(row, rows)
            h, row, at = h[keep], row[keep], at[keep]
            if len(h):
                yield made(h, row, at - raw_first[row] + EXACT, -n, _no_slots(len(h)))


def contaminated(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE,
    agreement: float = AGREEMENT, filter_windows: int = FILTER_WINDOWS,
) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, n_slots, n_changed): the items that
    documents hold. ``n_windows`` of the item's windows were found; ``n_changed`` of its
    ``n_slots`` slot values stand for another value in the document."""
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").mapInArrow(
        lambda b: _item_windows(b, window), "item_id bigint, h bigint, place bigint, size int, item_slots array<bigint>"
    )
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most ``window`` numbers
    wanted = None
    hashes = items.select("h").distinct()
    if hashes.count() <= filter_windows:
        wanted = spark.sparkContext.broadcast(np.sort(np.array([r["h"] for r in hashes.collect()], np.int64).view(np.uint64)))
    found = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        lambda b: _document_windows(b, sizes, wanted), "doc_id bigint, h bigint, slots array<bigint>, pos bigint, part bigint"
    )
    met = found.join(F.broadcast(items) if fits_broadcast(items) else items, "h")
    pair = F.arrays_zip("item_slots", "slots")
    whole = items.groupBy("item_id").agg(F.count_distinct("place").alias("item_windows"))
    single = met.groupBy("doc_id", "item_id", "part", (F.col("pos") - F.col("place")).alias("offset")).agg(
        F.collect_set("place").alias("places"), F.array_distinct(F.flatten(F.collect_set(pair))).alias("pairs")
    )
    by_offset = Window.partitionBy("doc_id", "item_id", "part").orderBy("offset")
    far = F.coalesce((F.col("offset") - F.lag("offset").over(by_offset) > window).cast("int"), F.lit(0))
    near = single.withColumn("_far", far).withColumn("run", F.sum("_far").over(by_offset))
    # The matches of the whole document, of neighbouring occurrences and of each one.
    none = F.lit(0).cast("bigint")
    kinds = [(none, none), (F.col("part"), F.col("run")), (F.col("part"), F.col("offset"))]
    level = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), a.alias("part"), b.alias("at")) for k, (a, b) in enumerate(kinds))))
    matched = near.select("doc_id", "item_id", "places", "pairs", level.alias("g")).groupBy("doc_id", "item_id", "g").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("bigint").alias("n_windows"),
        F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"),
    ).withColumn("level", F.col("g.level"))
    matched = matched.join(F.broadcast(whole) if fits_broadcast(whole) else whole, matched["item_id"].eqNullSafe(whole["item_id"])).drop(whole["item_id"])
    n_pairs = F.size("pairs")
    n_item = F.size(F.array_distinct("pairs.item_slots"))
    n_text = F.size(F.array_distinct("pairs.slots"))
    changed = F.size(F.filter("pairs", lambda p: p["item_slots"] != p["slots"]))
    held = matched.filter(
        (F.col("n_windows") >= coverage * F.col("item_windows")) & (F.least(n_item, n_text) >= agreement * n_pairs)
    )
    # The whole document where that agrees, else the fullest occurrence, with the fewest changes.
    best = F.min(F.struct("level", -F.col("n_windows"), changed.alias("c"), n_item.alias("n"), "n_windows", "item_windows"))
    return held.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", "b.n_windows", "b.item_windows",
        F.col("b.n").cast("bigint").alias("n_slots"), F.col("b.c").cast("bigint").alias("n_changed"),
    )


def op3_decontam(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
