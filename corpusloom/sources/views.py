"""Corpora and responses as expressions over the plain tables.

Each view is one SQL text in the dialect that Spark and DuckDB share; ``{name}``
stands for a table. Markers that the tables lack (comments, fences, ignore
files, ...) are put in by replacing common words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.session import spread

# (word, replacement as a SQL expression)
_MARKERS = [
    (" the ", "' // the '"),
    (" and ", "' /* and */ '"),
    (" by ", "' /* by '"),
    (" with ", "' */ with '"),
    (" of ", "' # of '"),
    (" is ", "' \"\"\" '"),
    (" at ", "' ' || chr(39) || chr(39) || chr(39) || ' '"),
    (" de ", "' <!-- de --> '"),
    (" der ", "' <!-- der '"),
    (" for ", "chr(10) || chr(10) || '  ' || chr(10)"),
    (" are ", "chr(13) || chr(10)"),
    (" on ", "chr(10) || chr(160) || chr(10) || '#! '"),
    (" as ", "chr(10) || ' // as ' || chr(10) || '# as '"),
    (" to ", "' ]]> '"),
    (" la ", "chr(10) || '<!-- la -->' || chr(10)"),
]


def _marked(text: str) -> str:
    for word, new in _MARKERS:
        text = f"replace({text}, '{word}', {new})"
    return text


_EXTENSIONS = [
    ".py", ".go", ".js", ".html", ".md", ".yaml", ".sh", ".ts", ".css", ".txt", ".env", ".png",
    ".PY", ".java", "", ".xml", ".tar.gz",
]
_FOLDERS = [
    "src/", "src/core.v2/", "src/core/", "lib/", "", "docs/x.environment/", "docs/api/v1/",
    "node_modules/m/", "lib/bin/", "lib.d/", "logs/2024/", "logs/", "Docs/",
]


def _pick(values: list[str], index: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} {cases} END"


_K = "CAST(floor(doc_id / 20) AS BIGINT)"
# Secret-shaped values, put together at run time.
_UNGATED = "' PASSWD= \"' || repeat('q', 9) || '\" ' || 'AS' || 'IA' || repeat('B', 16)"
_SECRETS = (
    "chr(10) || 'sk' || '-' || repeat('e', 40) || ' https://hooks.sl' || 'ack.com/services/'"
    " || repeat('T', 9) || '/' || repeat('B', 9) || '/' || repeat('c', 24) || ' AK' || 'IA' || repeat('Z', 18)"
    " || ' AWS_' || 'secret_x : ' || repeat('d', 40) || ' Token=' || chr(39) || repeat('f', 8) || chr(39)"
)
# One repo holds more than a third of all rows.
_REPO = "CASE WHEN doc_id % 5 < 2 THEN 'big' ELSE source END"

FILES = f"""
SELECT {_REPO} AS repo,
       {_pick(_FOLDERS, f"{_K} % {len(_FOLDERS)}")} || 'd' || CAST({_K} % 5 AS VARCHAR(9)) || '/'
         || CAST(doc_id AS VARCHAR(20)) || {_pick(_EXTENSIONS, f"doc_id % {len(_EXTENSIONS)}")} AS path,
       CASE WHEN doc_id % 41 = 7 THEN replace({_marked("text")}, ' in ', chr(0))
            WHEN doc_id % 43 = 9 THEN replace({_marked("text")}, ' in ', chr(10) || '```' || chr(10))
            WHEN doc_id % 47 = 5 THEN replace({_marked("text")}, ' in ', {_UNGATED})
            WHEN doc_id % 29 = 3 THEN replace({_marked("text")}, ' in ', {_SECRETS})
            ELSE {_marked("text")} END AS content
FROM {{documents}}
"""

_IGNORE_LINES = [
    "# made by hand", "", "*.tmp", "/src/core/", "!/src/core/d1", "logs/**/*1.txt", "**/d4/*.md",
    "d[02]/*.css", "!d2/?4*.css", "docs/*/v1", "*.ts", "!7*.ts", "lib.d/d3/   ",
]
IGNORE_FILES = f"""
SELECT DISTINCT {_REPO} AS repo, '.gitignore' AS path,
       {" || chr(10) || ".join(f"'{line}'" for line in _IGNORE_LINES)}
         || chr(10) || chr(92) || '#odd' || chr(10) AS content
FROM {{documents}}
WHERE source <> 'src4'
"""

# Files plus a root ignore file in almost every repo.
TREE = f"SELECT repo, path, content FROM ({FILES}) UNION ALL SELECT repo, path, content FROM ({IGNORE_FILES})"

PAGES = """
SELECT split_part(url, '/', 3) AS repo,
       replace(replace(substr(url, length(split_part(url, '://', 1)) + 4), '?', '/'), '#', '/')
         || '/' || CAST(page_id AS VARCHAR(20)) || '.html' AS path,
       replace(html, '><', '>' || chr(10) || '<') AS content
FROM {pages}
"""

_RESPONSE_PATH = """CASE WHEN k % 10 = 3 AND slot = 1 THEN '../' || CAST(doc_id AS VARCHAR(20))
            WHEN k % 10 = 5 AND slot = 1 THEN '/etc/' || CAST(doc_id AS VARCHAR(20))
            WHEN k % 10 = 6 AND slot = 1 THEN 'a/./b/../c//' || CAST(doc_id AS VARCHAR(20))
            WHEN k % 10 = 7 AND slot = 1 THEN '..' || CAST(doc_id AS VARCHAR(20))
            WHEN k % 10 = 8 THEN 'same/d.txt'
            WHEN k % 10 = 9 AND slot = 1 THEN 'a/..'
            ELSE path END"""
# Eight neighbouring documents of a source make one response.
_FILE_BLOCKS = f"""
SELECT doc_id, {_REPO} AS repo, CAST(floor(doc_id / 160) AS BIGINT) AS k,
       CAST(floor(doc_id / 20) AS BIGINT) % 8 AS slot,
       {_pick(_FOLDERS, f"{_K} % {len(_FOLDERS)}")} || 'd' || CAST({_K} % 5 AS VARCHAR(9)) || '/'
         || CAST(doc_id AS VARCHAR(20)) || {_pick(_EXTENSIONS, f"doc_id % {len(_EXTENSIONS)}")} AS path,
       {_marked("text")} AS content,
       source
FROM {{documents}}
"""

RESPONSE_BLOCKS = f"""
SELECT repo, source || '-' || CAST(k AS VARCHAR(20)) AS resp_id, doc_id,
       CASE WHEN doc_id % 2 = 0 THEN
         '<file path="' || p || '" size="1.00 KB">' || chr(10)
           || CASE WHEN slot = 3 THEN '' ELSE '<![CDATA[' || chr(10) END
           || CASE WHEN slot = 4 THEN content ELSE replace(content, ']]>', ']]]]><![CDATA[>') END
           || CASE WHEN slot = 5 THEN ']]>' || chr(10)
                   WHEN slot = 6 THEN chr(10) || ' ]]>  ' || chr(10) || '</file>' || chr(10)
                   WHEN slot = 7 THEN chr(10) || '</file>' || chr(10) || 'tail' || chr(10)
                   ELSE chr(10) || ']]>' || chr(10) || '</file>' || chr(10) || chr(10) END
       ELSE
         '## File: ' || p || ' (Size: 1.00 KB | Tokens: 1)' || chr(10)
           || CASE WHEN slot = 3 THEN '## File: other/' || p || chr(10) ELSE '' END
           || '```text' || chr(10) || content || chr(10)
           || CASE WHEN slot = 4 THEN '```' || chr(10) || 'inner' || chr(10) ELSE '' END
           || '```' || chr(10) || chr(10)
       END AS block
FROM (SELECT doc_id, repo, source, k, slot, content, {_RESPONSE_PATH} AS p FROM ({_FILE_BLOCKS}))
"""

# A document's parity fixes the format, so a response is all XML or all Markdown.
_AGG = {
    "spark": "listagg(block, '') WITHIN GROUP (ORDER BY doc_id)",
    "duckdb": "string_agg(block, '' ORDER BY doc_id)",
}


def responses_sql(engine: str) -> str:
    return f"""
SELECT repo, resp_id, 'Some words first.' || chr(10) || chr(10) || {_AGG[engine]}
         || CASE WHEN min(doc_id) % 3 = 0 THEN '<file path="open.txt">' || chr(10) || 'x' ELSE '' END AS body
FROM ({RESPONSE_BLOCKS})
GROUP BY repo, resp_id
"""


CHAT = """
SELECT 'chat' AS repo, CAST(conv_id AS VARCHAR(20)) || '-' || CAST(turn AS VARCHAR(20)) AS resp_id,
       text AS body
FROM {conversations} WHERE role = 'assistant'
"""

# Table and the column its rows are spread by.
TABLES = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def duckdb_view(sql: str) -> str:
    return sql.format(**{t: t for t in TABLES})


def spark_view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {}
    for name, key in TABLES.items():
        if f"{{{name}}}" in sql:
            table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            # A plain scan of fewer splits than cores, such as one small file.
            few = table.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
            tables[name] = spread(table, key) if few else table
    return spark.sql(sql, **tables)
