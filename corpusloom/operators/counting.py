"""Exact token counts by an expensive counter: every distinct piece of a corpus once.

A byte-pair counter first cuts a text into pieces by a regex and never joins tokens across
pieces, so the count of a text is the sum over its pieces. There are far fewer distinct
pieces than pieces. They are gathered with how often each occurs, counted once, and looked up:

- Pieces that make up more than one in ``COMMON`` of all occurrences are broadcast by their
  hashes. There can't be as many as ``COMMON`` of those, whatever the corpus.
- The others are joined by hash. None of them is frequent, so no task gets a hot key, and a
  text sends each of its rare pieces once, with its number.

Pieces are told apart by two 64-bit hashes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.render import Counter
from corpusloom.functions.text import WS
from corpusloom.session import stage

COMMON = 500_000

# Pieces of the public byte-level BPE vocabularies of 50,000 entries.
BYTE_BPE_PIECES = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++"
    rf"| ?[^{WS}\p{{L}}\p{{N}}]++|[{WS}]++\z|[{WS}]+(?![^{WS}])|[{WS}]"
)


@dataclass(frozen=True)
class PieceCounter:
    """Tokens of a text: the sum of ``count`` over what ``pattern`` matches, left to right.
    ``count`` may be a Pandas UDF; it is only given distinct pieces."""

    pattern: str
    count: Counter


def bpe_counter(spark: SparkSession, ranks_file: str, pattern: str = BYTE_BPE_PIECES) -> PieceCounter:
    """Tokens of a byte-pair vocabulary in the ranks format (a base64 token and its rank per
    line). The file is read on the driver; its size is that of the vocabulary."""
    with open(ranks_file, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        ranks = spark.sparkContext.broadcast({base64.b64decode(token): int(rank) for token, rank in pairs})

    def count(pieces: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        # What arrives is one piece already, so nothing is cut any more.
        engine = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks.value, special_tokens={})
        for batch in pieces:
            yield pd.Series([len(t) for t in engine.encode_ordinary_batch(batch.tolist(), num_threads=1)], dtype="int64")

    return PieceCounter(pattern, F.pandas_udf(count, "bigint"))


def count_texts(
    texts: DataFrame, keys: list[str], text: Column, counter: PieceCounter, name: str = "tokens", common: int = COMMON
) -> DataFrame:
    """(``keys``, ``name``): tokens of every text; rows that repeat their keys are added up. A
    null or empty text, and one without any piece, has 0. Other columns of ``texts`` don't
    matter; an empty table gives no rows."""
    pieces = F.regexp_extract_all(text, F.lit(counter.pattern), F.lit(0))
    piece = F.col("_piece")
    hashes = [F.xxhash64(piece).alias("_a"), F.xxhash64(F.lit(1), piece).alias("_b")]
    cut = texts.select(*keys, F.explode_outer(pieces).alias("_piece"))
    found = stage(cut.filter(piece.isNotNull()).groupBy("_piece").agg(F.count("*").alias("_n")))
    dictionary = stage(found.select(*hashes, "_n", counter.count(piece).cast("bigint").alias("_each")))
    frequent = F.col("_n") > (found.agg(F.sum("_n")).first()[0] or 0) / common
    met = cut.select(*keys, "_piece", *hashes).join(
        F.broadcast(dictionary.filter(frequent).drop("_n")), ["_a", "_b"], "left"
    )
    rare = piece.isNotNull() & F.col("_each").isNull()
    sums = stage(
        met.groupBy(*keys, F.when(rare, F.col("_a")).alias("_a"), F.when(rare, F.col("_b")).alias("_b")).agg(
            F.sum(F.when(piece.isNull(), 0).otherwise(F.coalesce("_each", F.lit(0)))).cast("bigint").alias(name),
            F.count("*").alias("_times"),
        )
    )
    others = sums.filter("_a is not null").join(dictionary.filter(~frequent).drop("_n"), ["_a", "_b"])
    summed = sums.filter("_a is null").select(*keys, name).unionByName(
        others.select(*keys, (F.col("_times") * F.col("_each")).alias(name))
    )
    return summed.groupBy(*keys).agg(F.sum(name).alias(name))
