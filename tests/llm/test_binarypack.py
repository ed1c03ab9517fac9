import collections
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import packing as m


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(m.tokenizer_file())


TEXTS = [
    (1, "Hello there, it's 12 o'clock.\n\n  Yes!"), (2, None), (3, ""), (4, "é ß 漢字 🙂  x" * 50), (5, "a" * 5000),
    (6, " \n\t" * 3000), (None, "no id"), (7, "again"), (7, "again"), (8, "word " * 20_000),
    (9, "x<|endoftext|>y"), (10, "hello <|endoftext|> world"), (11, "<|endoftext|>" * 700), (12, "<|endoftext|"),
]


def test_pieces_hold_every_id(docs, whole):
    rows = m.pack(docs(TEXTS)).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert all(r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 1024 for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(r["ids"])
    for doc, text in TEXTS:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by[doc], key=lambda r: r["start"])
        if doc == 7:
            assert len(pieces) == 2 * len(m.binary_lengths(len(ids)))
            continue
        assert np.frombuffer(b"".join(r["ids"] for r in pieces), "<u4").tolist() == ids
        assert [r["start"] for r in pieces] == [0, *np.cumsum([r["length"] for r in pieces])[:-1]]
        assert all(r["doc_tokens"] == len(ids) for r in pieces)


def test_engines_agree(whole):
    encode = m.encoder()
    for text in [" " * 100_000 + "a", "\n" * 50_000, "<|endoftext|> x", "é" * 70_000, "a" * 100_000, " \t" * 600_000, "퟿\x00  x"]:
        assert encode(text) == whole.encode(text, add_special_tokens=False).ids


def test_lengths():
    assert m.binary_lengths(1024 * 2 + 5) == [1024, 1024, 4, 1]
    assert m.binary_lengths(7, 4) == [4, 2, 1]
    with pytest.raises(ValueError):
        m.pack(None, length=1000)


def test_empty_table_and_buckets(docs, spark, tmp_path):
    assert m.pack(docs([])).collect() == []
    m.write_buckets(m.pack(docs(TEXTS)), str(tmp_path / "out"))
    again = spark.read.parquet(str(tmp_path / "out"))
    assert again.filter("octet_length(ids) <> 4 * length").count() == 0
    assert again.count() == m.pack(docs(TEXTS)).count()
