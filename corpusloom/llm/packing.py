"""Packing by power-of-two decomposition.

A document of n tokens (its ids and a closing id 0) is cut into as many pieces of
``length`` as fit and then into one piece for each bit of the rest, longest first.
Pieces of one length form a bucket; each piece is a sequence of its own, so no
sequence crosses documents and none needs padding.

Ids are those of the ``tokenizers`` file. The file's merges run in ``tiktoken``'s
engine, which gives the same ids at about five times the speed; very long texts, texts
that hold the string of an added token (it becomes that token's id) and whatever the fast
engine refuses go through ``tokenizers`` itself.

Defined results: null text counts as empty and gives the one piece of id 0. Rows that
repeat an id, or have none, are packed like any other.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import by_value, chunks, table

by_value(__name__)

LENGTH = 1024  # a power of two
END_ID = 0
LONG_TEXT = 1 << 20  # characters from which on ``tokenizers`` encodes by itself


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_LOADED: dict = {}


def encoder(path: str | None = None):
    """text -> list of ids, by the byte-level BPE file at ``path``."""
    path = path or tokenizer_file()
    if path in _LOADED:
        return _LOADED[path]
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    # The visible characters that stand for the 256 bytes in a byte-level vocabulary.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    added = {x["content"] for x in content.get("added_tokens", [])}
    ranks = {
        bytes(byte[c] for c in token): number
        for token, number in content["model"]["vocab"].items()
        if token not in added
    }
    fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if len(text) < LONG_TEXT and not any(token in text for token in added):
            try:
                return fast.encode_ordinary(text)
            except BaseException as error:  # the engine's panic is not an Exception
                if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return whole.encode(text, add_special_tokens=False).ids

    _LOADED[path] = encode
    return encode


def binary_lengths(n: int, length: int = LENGTH) -> list[int]:
    """``n`` as whole ``length``s and then falling powers of two."""
    rest = n % length
    return [length] * (n // length) + [1 << k for k in range(length.bit_length() - 1, -1, -1) if rest >> k & 1]


def _pieces(batches, path: str | None, length: int, with_ids: bool):
    encode = encoder(path)
    for batch in chunks(batches):
        docs, starts, sizes, crcs, totals, ids = [], [], [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tokens = np.array([*encode(text or ""), END_ID], dtype="<u4")
            at = 0
            for size in binary_lengths(len(tokens), length):
                piece = tokens[at : at + size].tobytes()
                docs.append(doc)
                starts.append(at)
                sizes.append(size)
                crcs.append(zlib.crc32(piece))
                totals.append(len(tokens))
                if with_ids:
                    ids.append(piece)
                at += size
        columns = [docs, starts, sizes, crcs, totals]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        arrays = [pa.array(c, pa.int64()) for c in columns]
        if with_ids:
            arrays.append(pa.array(ids, pa.binary()))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def pack(documents: DataFrame, length: int = LENGTH, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, [ids,] sequence_id, offset): one
    row per piece. ``length`` is also the piece's bucket; ``ids`` holds little-endian
    32-bit ids. Written by ``write_buckets``, each bucket is a table of equal lengths.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length has to be a power of two")
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    pieces = documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        lambda batches: _pieces(batches, path, length, with_ids), schema + (", ids binary" if with_ids else "")
    )
    # A piece is a whole sequence; its number is that of the row in its task.
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn(
        "offset", F.lit(0).cast("bigint")
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per length; a bucket is written by all tasks that have pieces of it."""
    pieces.write.partitionBy("length").parquet(path)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
