import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_linededup", "op7_warc", "op10_jaccard"])
def test_query_against_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "pages"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = connection.execute(entry.oracle_sql()[name])
    order = [[d[0] for d in result.description].index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == expected


@pytest.fixture(scope="module")
def kept(spark):
    """The rows that each stage hands on."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF).cache()
        out.append((name, docs))
    return out


def test_stages(spark, kept, brute_components):
    before = spark.read.parquet(f"{SF}/documents.parquet")
    columns = before.columns
    tables = dict(kept)
    for name, df in kept[:-1]:
        assert df.columns == columns, name
    assert tables["language"].count() == before.count()  # these are all clean
    lines = {r["doc_id"]: r for r in tables["lines"].collect()}
    from test_linededup import brute as brute_lines

    rows = [(r["doc_id"], r["text"]) for r in tables["language"].collect()]
    for doc, text, _, _ in brute_lines(rows):
        assert lines[doc]["text"] == text and lines[doc]["n_chars"] == len(text)
    components = brute_components([(d, r["text"]) for d, r in lines.items()])
    assert {r["doc_id"] for r in tables["near_duplicates"].collect()} == {d for d, (_, c) in components.items() if c == d}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {r["doc_id"] for r in tables["near_duplicates"].collect() if any(i in r["text"] for i in items)}
    left = {r["doc_id"] for r in tables["benchmark"].collect()}
    assert left == {r["doc_id"] for r in tables["near_duplicates"].collect()} - held
    assert {r["doc_id"] for r in tables["packing"].collect()} == left


def test_run_is_the_stages(spark, kept):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.drop("sequence_id").collect())) == sorted(map(tuple, dict(kept)["packing"].drop("sequence_id").collect()))


def test_defined_cases(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _gone boolean, row string"
    rows = [
        (1, "the cat and the dog " * 5, "en", None, None, None, None), (None, "the cat and the dog " * 5, "en", "s", 1, True, "x"),
        (3, None, "en", "s", 0, False, "x"), (4, "", None, "s", 0, None, None), (5, "123", "en", "s", 3, None, None),
        (6, "Der Hund und die Katze " * 5, "de", "s", 3, None, None), (6, "Der Hund und die Katze " * 5, "de", "s", 3, None, None),
    ]
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    for part in (rows, []):
        docs = spark.createDataFrame(part, schema)
        for name, step in corpus_pipeline.STAGES:
            after = step(spark, docs, str(tmp_path))
            if name != "packing":
                assert after.columns == docs.columns
            docs = after
        assert sorted({r["doc_id"] or 0 for r in docs.collect()}) == ([0, 1, 6] if part else [])
