import base64
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import counting
from corpusloom.operators.counting import PieceCounter, bpe_counter, count_texts
from corpusloom.plans import pack as plan

LETTERS = PieceCounter("[a-z]+|[^a-z]", lambda piece: F.length(piece))
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
TEXTS = [
    "It's  a test,\n\n\n  we'll see   ", "", "   ", "x", "\t\tif a == 10:\r\n    return  'ü'  # žluťoučký 12345\n",
    "日本語 ١٢٣ — “quoted”  end", "a" * 300, "<|endoftext|> and \u0085 on", "don't DON'T 'tis 've",
]


@pytest.mark.parametrize("common", [1, 3, counting.COMMON])
def test_sums_of_pieces(spark, common):
    """Few, some or all pieces are looked up by broadcast."""
    rows = [("a", "xx yy xx", 1), ("b", "", 2), ("c", None, 3), (None, "zz xx", 4), ("d", "d" * 100_000 + "! " * 1000, 5), ("a", "q", 6)]
    table = spark.createDataFrame(rows, "id string, body string, tokens int")
    got = {r["id"]: r["tokens"] for r in count_texts(table, ["id"], F.col("body"), LETTERS, common=common).collect()}
    assert got == {"a": 9, "b": 0, "c": 0, None: 5, "d": 102_000}
    assert count_texts(table.limit(0), ["id"], F.col("body"), LETTERS).count() == 0


def test_each_piece_is_counted_once(spark):
    counted = spark.sparkContext.accumulator(0)

    @F.pandas_udf("bigint")
    def dear(piece):
        counted.add(len(piece))
        return piece.str.len()

    table = spark.range(2000).select("id", F.concat(F.lit("to be or not to be "), F.col("id") % 5).alias("body"))
    counts = count_texts(table, ["id"], F.col("body"), PieceCounter(r"\S+|\s+", dear))
    assert counts.agg(F.sum("tokens")).first()[0] == 2000 * 20
    # to, be, or, not, a blank and five numbers
    assert counted.value == 10


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary files")
def test_byte_pairs_equal_direct_encoding(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANKS, "rb"))}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
    engine = tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    table = spark.createDataFrame(list(enumerate(TEXTS)), "id int, body string")
    got = {r["id"]: r["tokens"] for r in count_texts(table, ["id"], F.col("body"), bpe_counter(spark, RANKS)).collect()}
    assert got == {i: len(engine.encode_ordinary(t)) for i, t in enumerate(TEXTS)}


def test_pack_by_pieces_equals_a_direct_counter(spark):
    files = [("r", f"src/d{i % 3}/f{i}.py", f"x = {i}  # note\n" + "print('abc 123')\n" * i) for i in range(40)]
    files += [("r", "empty.md", ""), ("r", ".gitignore", "f7.py\n"), ("s", "one.go", "package a\n")]
    table = spark.createDataFrame(files, "repo string, path string, content string")
    pattern = "[A-Za-z]+|[^A-Za-z]"

    def direct(column):
        return F.regexp_count(column, F.lit(pattern)).cast("bigint")

    pieces = PieceCounter(pattern, lambda piece: F.lit(1) + F.length(piece) * 0)
    one, other = (plan.pack(table, 400, counter=c, globs=["f9.py"]) for c in (direct, pieces))
    facts = ["repo", "ord", "path", "tokens", "part", "before", "block_bytes"]
    assert sorted(one.parts.select(facts).collect()) == sorted(other.parts.select(facts).collect())
    assert other.parts.agg(F.max("part")).first()[0] > 1
    assert sorted(plan.part_body(one).collect()) == sorted(plan.part_body(other).collect())
    assert sorted(plan.part_summary(one).collect()) == sorted(plan.part_summary(other).collect())
    sums = [plan.corpus_summary(plan.token_nodes(table, counter=c)).orderBy("repo").collect() for c in (direct, pieces)]
    assert sums[0] == sums[1]
