import gzip
import io
import random

import pytest

from corpusloom.llm import warc as m

SCHEMA = "page_id bigint, url string, html string, _digest string, member int"


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)

    return make


ROWS = [
    (1, "http://a/ b\r\nX: y", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://c", None), (4, "http://d", ""),
    (5, "http://e", "é" * 50 + "\r\n\r\nWARC/1.1\r\n"), (None, "http://n", "<p>same</p>"), (7, "http://g", "seven"), (7, "http://g", "seven"),
]


def test_round_trip(pages, spark, tmp_path):
    rng = random.Random(1)
    rows = ROWS + [(100 + i, f"http://x/{i}", rng.choice(["dup", "".join(rng.choices("\x1f\x8b\x08ab<", k=3000))])) for i in range(300)]
    m.write_warc(pages(rows), str(tmp_path / "w"))
    largest = {}
    for page, _, html in rows:
        if page is not None:
            largest[html or ""] = max(page, largest.get(html or "", page))
    expected = sorted(
        (
            page or 0, len((html or "").encode()), m.digest((html or "").encode()),
            *(("response", 0) if page is None or page == largest[html or ""] else ("revisit", largest[html or ""])),
        )
        for page, _, html in rows
    )
    for split in (137, 1000, 1 << 20):  # every range owns the records that start inside
        got = m.read_warc(spark, str(tmp_path / "w"), split).collect()
        assert sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in got) == expected
        whole = {r["page_id"]: r["payload"].decode() for r in got if r["record_type"] == "response" and r["page_id"]}
        assert all(whole[p] == (h or "") for p, _, h in rows if p in whole)


def test_any_cut_finds_each_record_once():
    raws = [m.record(i, f"http://{i}", bytes([31, 139, 8, i]) * (i * 40), None) for i in range(12)]
    data = b"".join(m.member(r) for r in raws)
    for size in (1, 7, 100, 999, len(data)):
        found = []
        for start in range(0, len(data), size):
            found += m.range_records(io.BytesIO(data), start, min(start + size, len(data)), len(data))
        assert found == raws


def test_archives_are_plain_gzip(pages, tmp_path):
    m.write_warc(pages(ROWS), str(tmp_path / "w"))
    data = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").glob("part-*")) if f.stat().st_size)
    assert data.count(b"WARC/1.1\r\nWARC-Type: ") == len(ROWS)


def test_large_record_and_cut_off_archive(monkeypatch):
    big = m.record(1, None, b"x" * (17 << 20), None)
    data = m.member(big) + m.member(m.record(2, None, b"y", None))
    assert data[len(m.member(big)) - 1] == 0
    assert [len(r) for r in m.range_records(io.BytesIO(data), 0, len(data), len(data))][0] == len(big)
    assert len(list(m.range_records(io.BytesIO(data), 0, len(data), len(data)))) == 2
    with pytest.raises(ValueError):
        list(m.range_records(io.BytesIO(data[:2000]), 0, 2000, 2000))


def test_empty_table(pages, spark, tmp_path):
    m.write_warc(pages([]), str(tmp_path / "w"))
    assert m.read_warc(spark, str(tmp_path / "w")).collect() == []
