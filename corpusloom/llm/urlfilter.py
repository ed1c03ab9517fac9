"""URL filter: host-suffix and path-prefix expressions joined to rules by hash prefix.

A rule is a host, a path and a verdict. It fits a URL whose host is the rule's or ends in
'.' and the rule's, if the URL's path starts with the rule's. Every URL is expanded into
the expressions ``host suffix + path prefix`` that a rule could have: suffixes begin after
a dot or are the whole host, and only lengths that occur among the rules are taken, so a
very long URL has no more expressions than the rules have lengths. Expressions meet the
rules on the first ``PREFIX`` hex digits of their SHA-256; the full digest confirms a
match, and the longest rule wins.

Defined results: the host lies between the first '://' and the next '/', '?', '#' or the
end, A-Z lower-cased, ports and user parts included; the path follows up to '?', '#' or
the end. A null URL or one without '://' has an empty host and path. An empty path does not
start with '/'. Of rules that fit, the one with most characters wins, then the one with the
longer host, then 'block' over 'allow'; a URL without any gets the default verdict. Every
row is judged by itself: repeated rows and null ids are kept as they are. Rules without a
host or a verdict are left out, a null path counts as empty, repeated rules count once. No
rules: everything gets the default. No URLs: no rows. Columns are picked by name at the
start, so others don't matter, whatever their names. URLs and rules are used in whole.
"""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import table
from corpusloom.session import lookup_join

PREFIX = 8  # hex digits of the digest that the join is on
ALLOW, BLOCK = "allow", "block"
# (host, path, verdict) of the registered query. Fixed values.
RULES = [
    ("net", "/", BLOCK),
    ("example.net", "/en/", ALLOW),
    ("example.com", "/de/", BLOCK),
    ("org", "/fr/", ALLOW),
]
RULE_SCHEMA = "host string, path string, verdict string"
# A match as one number that grows with its precedence: characters of the rule, those of
# its host, 1 for 'block'.
_HOST_BITS, _SIZE_BITS = 2, 1 << 31


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"\A[^?#]*", 0)
    return lower_ascii(host), path


def _shapes(rules: DataFrame) -> str:
    """Lengths of the rules' hosts, each with those of its paths. There are no more than
    there are different lengths, however many rules there are."""
    lengths = rules.groupBy(F.length("rule_host").alias("h")).agg(F.sort_array(F.collect_set(F.length("rule_path"))).alias("p"))
    return json.dumps([row.asDict() for row in lengths.orderBy("h").collect()])


def expressions(host: Column, path: Column, shapes: str) -> Column:
    """What a rule that fits could be, by the lengths that rules have."""
    known = F.from_json(F.lit(shapes), "array<struct<h:int,p:array<int>>>")
    size = F.length(host)

    def at_label(shape: Column) -> Column:
        whole = shape["h"] == size
        return whole | ((shape["h"] < size) & (F.substr(host, size - shape["h"], F.lit(1)) == "."))

    def of_host(shape: Column) -> Column:
        suffix = F.substr(host, size - shape["h"] + 1, shape["h"])
        return F.transform(
            F.filter(shape["p"], lambda n: n <= F.length(path)),
            lambda n: F.struct(
                F.concat(suffix, F.substr(path, F.lit(1), n)).alias("text"), shape["h"].alias("host_size")
            ),
        )

    return F.flatten(F.transform(F.filter(known, at_label), of_host))


def judge(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = ALLOW) -> DataFrame:
    """(key, host, path, rule, verdict) of every row of ``urls``. ``rules`` has host, path
    and verdict ('allow' or 'block')."""
    rules = rules.filter("host is not null and verdict is not null").select(
        lower_ascii(F.col("host")).alias("rule_host"),
        F.coalesce("path", F.lit("")).alias("rule_path"),
        (F.col("verdict") == BLOCK).cast("long").alias("bars"),
    )
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("bars").alias("bars"))
    digests = rules.select(F.sha2(F.concat("rule_host", "rule_path"), 256).alias("rule_digest"), "bars")
    # Rules of one prefix share a row, so the lookup side has unique keys.
    by_prefix = digests.groupBy(F.left("rule_digest", F.lit(PREFIX)).alias("prefix")).agg(
        F.collect_list(F.struct("rule_digest", "bars")).alias("listed")
    )
    host, path = split_url(F.col(url))
    rows = urls.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    # The number of a row holds its expressions together. It is fixed by the scan's
    # partitions, also for a task that is run again.
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    found = rows.withColumn("expression", F.explode_outer(expressions(F.col("host"), F.col("path"), _shapes(rules))))
    found = found.withColumn("digest", F.sha2("expression.text", 256))
    found = found.withColumn("prefix", F.left("digest", F.lit(PREFIX)))
    listed = lookup_join(found, by_prefix, ["prefix"])
    bars = F.array_max(F.transform(F.filter("listed", lambda r: r["rule_digest"] == F.col("digest")), lambda r: r["bars"]))
    rank = F.length("expression.text").cast("long") * _SIZE_BITS + F.col("expression.host_size") * _HOST_BITS + bars
    best = listed.groupBy("row", "key", "host", "path").agg(F.max(rank).alias("best"))
    size = F.floor(F.col("best") / _SIZE_BITS).cast("int")
    host_size = F.floor(F.col("best") % _SIZE_BITS / _HOST_BITS).cast("int")
    rule = F.concat(
        F.substr("host", F.length("host") - host_size + 1, host_size), F.substr("path", F.lit(1), size - host_size)
    )
    verdict = F.when(F.col("best") % _HOST_BITS == 1, BLOCK).when(F.col("best").isNotNull(), ALLOW).otherwise(default)
    return best.select(F.col("key").alias(key), "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def op11_urlfilter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, RULE_SCHEMA))


OP11_SQL = r"""
WITH rules(rule_host, rule_path, rule_verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
           ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), cut AS (
    SELECT row_number() OVER () AS r, page_id,
           CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), parts AS (
    SELECT r, page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host,
           regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
    FROM cut
), urls AS (
    SELECT r, page_id, path,
           translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
    FROM parts
), best AS (
    SELECT r, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
           arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
    FROM urls JOIN rules
      ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN best USING (r)
"""
