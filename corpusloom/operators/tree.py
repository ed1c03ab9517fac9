"""Directory rows, ignore rules, selection and hiding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.globs import (
    custom_ignore,
    default_ignore,
    ignore_file_rules,
    ignored_by,
)
from corpusloom.functions.paths import (
    binary_reason,
    depth,
    name,
    self_and_ancestors,
    sort_key,
    span_end,
    span_key,
    strict_ancestors,
)
from corpusloom.session import WINDOW_ROWS, built_once, lookup_join, number_in_order, stage, swept


def directories(files: DataFrame) -> DataFrame:
    """One row (repo, path) per directory above any file."""
    return files.select("repo", F.explode(strict_ancestors(F.col("path"))).alias("path")).distinct()


def tree_nodes(files: DataFrame) -> DataFrame:
    """Files and directories as (repo, path, name, is_dir, depth, size)."""
    rows = files.select(
        "repo", "path", F.lit(False).alias("is_dir"),
        F.octet_length("content").cast("bigint").alias("size"),
    ).unionByName(
        directories(files).select(
            "repo", "path", F.lit(True).alias("is_dir"), F.lit(0).cast("bigint").alias("size")
        )
    )
    return rows.select(
        "repo", "path", name(F.col("path")).alias("name"), "is_dir", depth(F.col("path")).alias("depth"), "size"
    )


@built_once
def _rules() -> Column:
    """Regexes of the root ignore file, on its own row; null on all others."""
    both = ignore_file_rules(F.col("content").cast("string"))
    return F.when(F.col("path") == ".gitignore", both).alias("_both")


def ignore_rules(files: DataFrame) -> DataFrame:
    """(repo, rules, exceptions): the root ignore file of each repo as two regexes."""
    own = files.filter(F.col("path") == ".gitignore")
    return stage(own.select("repo", _rules()).select("repo", "_both.*").filter("rules is not null"))


def _hidden(is_dir: Column) -> Column:
    return ignored_by(F.col("rules"), F.col("exceptions"), F.col("path"), is_dir)


def _with_rules(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Nodes with their repo's rules, repo by repo inside a task: a regex is compiled anew
    whenever it differs from the last one. Catalyst takes a sort away that a later shuffle
    doesn't need, but not from below a filter that knows its partition."""
    met = lookup_join(nodes, rules, ["repo"])
    return met.sortWithinPartitions("repo").filter(F.spark_partition_id() >= 0)


def ignore_reason(nodes: DataFrame, rules: DataFrame, globs: Sequence[str] = ()) -> DataFrame:
    """Add ``reason``: 'custom', 'file', 'default' or null, the first that hides
    the node or a directory above it."""
    return (
        _with_rules(nodes, rules)
        .withColumn(
            "reason",
            F.when(custom_ignore(F.col("path"), list(globs)), "custom")
            .when(_hidden(F.col("is_dir")), "file")
            .when(default_ignore(F.col("path")), "default"),
        )
        .drop("rules", "exceptions")
    )


def walk(
    files: DataFrame,
    globs: Sequence[str] = (),
    text: Column | None = None,
    facts: dict[str, Column] | None = None,
) -> DataFrame:
    """Nodes that survive ignore rules and the binary filter.

    ``facts`` are columns computed from each kept file, such as rendered sizes;
    they are null on directories. They may use ``_text``, which is ``text``
    computed once per file. One pass over the content writes a narrow table with
    everything that is needed from it; the rest works on that table.
    """
    path, content = F.col("path"), F.col("content")
    visible = ~custom_ignore(path, list(globs)) & ~default_ignore(path)
    flagged = files.withColumn("_kept", visible & binary_reason(path, content).isNull())
    if text is not None:
        flagged = flagged.withColumn("_text", F.when(F.col("_kept"), text))
    narrow = stage(
        flagged.select(
            "repo",
            "path",
            F.octet_length("content").cast("bigint").alias("size"),
            "_kept",
            _rules(),
            *[F.when(F.col("_kept"), c).alias(alias) for alias, c in (facts or {}).items()],
        )
    )
    rows = narrow.filter("_kept").drop("_kept", "_both").withColumn("is_dir", F.lit(False))
    above = directories(narrow).filter(visible).select(
        "repo", "path", F.lit(True).alias("is_dir"), F.lit(0).cast("bigint").alias("size")
    )
    nodes = rows.unionByName(above, allowMissingColumns=True)
    rules = narrow.filter("_both is not null").select("repo", "_both.*")
    return (
        _with_rules(nodes, rules)
        .filter(~_hidden(F.col("is_dir")))
        .drop("rules", "exceptions")
        .withColumns({"name": name(path), "depth": depth(path)})
    )


def row_visible(files: DataFrame, globs: Sequence[str] = ()) -> DataFrame:
    """Without the rows that are left out whatever their repo's ignore file says."""
    path = F.col("path")
    visible = ~custom_ignore(path, list(globs)) & ~default_ignore(path)
    return files.filter(visible & binary_reason(path, F.col("content")).isNull())


def kept_files(files: DataFrame, globs: Sequence[str] = ()) -> DataFrame:
    """The rows of ``files`` that ``walk`` keeps, with all their columns. What the row
    tells comes first; an ignore file adds one search per row. No content is shuffled
    unless the rules are too many to be broadcast, and none is sorted: rows of interleaved
    repos compile their regex again, which takes far less than reading their content."""
    return (
        lookup_join(row_visible(files, globs), ignore_rules(files), ["repo"])
        .filter(~_hidden(F.lit(False)))
        .drop("rules", "exceptions")
    )


def hide_descendants(nodes: DataFrame, collapsed: DataFrame, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Drop nodes below a collapsed directory; the directory itself stays.

    A subtree is one interval of keys. Along the keys of a repo, +1 opens the interval of a
    collapsed directory and -1 closes it; nodes in between have a sum above 0. Only the nodes
    themselves and two rows per directory are shuffled."""
    shut = collapsed.select("repo", "path").distinct()
    marks = shut.select(
        "repo",
        F.inline(F.array(
            F.struct(F.concat(span_key(F.col("path")), F.lit("\x00")).alias("_key"), F.lit(1).alias("_open")),
            F.struct(span_end(F.col("path")).alias("_key"), F.lit(-1).alias("_open")),
        )),
    )
    return _inside(nodes, marks, "_open", "sum", window_rows).filter("coalesce(_open_upto, 0) = 0").drop("_open_upto")


def _inside(nodes: DataFrame, marks: DataFrame, value: str, how: str, window_rows: int) -> DataFrame:
    """Nodes with ``<value>_upto`` of the marks (repo, _key, value) up to their own key."""
    keyed = nodes.withColumns({"_key": span_key(F.col("path")), "_mark": F.lit(1)})
    rows = keyed.unionByName(marks.withColumn("_mark", F.lit(0)), allowMissingColumns=True)
    along = swept(rows, ["repo"], ["_key", "_mark"], [value], how, window_rows)
    return along.filter("_mark = 1").drop("_key", "_mark", value)


def _resolved(rules: DataFrame) -> DataFrame:
    """(repo, path, inside, outside): what holds below each rule's path and around it, as the
    last rule of a path and the paths above it. True where no rule is. Works on rules only."""
    latest = rules.groupBy("repo", F.col("path").alias("_rule")).agg(
        F.max("seq").alias("_seq"), F.max_by("selected", "seq").alias("_on")
    )
    reach = latest.select("repo", F.col("_rule").alias("path"), F.explode(self_and_ancestors(F.col("_rule"))).alias("_rule"))
    above = F.when(F.col("_rule") != F.col("path"), F.col("_seq"))
    return (
        lookup_join(reach, latest, ["repo", "_rule"], "inner")
        .groupBy("repo", "path")
        .agg(
            F.max_by("_on", "_seq").alias("inside"),
            F.coalesce(F.max_by("_on", above), F.lit(True)).alias("outside"),
        )
    )


def select_subtree(nodes: DataFrame, rules: DataFrame, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Add ``selected``. A rule (repo, seq, path, selected) sets its path and
    everything below; the last rule that applies wins; true without a rule.

    Along the keys of a repo, a rule's path begins what holds inside it and its end goes
    back to what holds around it; a node takes what was said last. Ancestors are followed for
    rules only, never for nodes."""
    marks = _resolved(rules).select(
        "repo",
        F.inline(F.array(
            F.struct(span_key(F.col("path")).alias("_key"), F.col("inside").alias("_on")),
            F.struct(span_end(F.col("path")).alias("_key"), F.col("outside").alias("_on")),
        )),
    )
    along = _inside(nodes, marks, "_on", "last", window_rows)
    return along.withColumn("selected", F.coalesce("_on_upto", F.lit(True))).drop("_on_upto")


def subtree_totals(nodes: DataFrame, sums: Sequence[str], window_rows: int = WINDOW_ROWS) -> DataFrame:
    """(repo, path, is_dir, n_files, <sums>): files and sums over each node and all below it,
    and over the whole repo under the path ''.

    They are differences of running sums between a directory's key and its end, so rows
    are linear in the nodes, whatever their depth."""
    file = F.when(F.col("is_dir"), 0).otherwise(1).cast("bigint")
    own = {"n_files": file, **{c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in sums}}
    rows = nodes.select("repo", "path", "is_dir", *[c.alias(n) for n, c in own.items()])
    starts = rows.withColumns({"_key": span_key(F.col("path")), "_end": F.lit(0)})
    nothing = {n: F.lit(0).cast("bigint") for n in own}
    ends = rows.filter("is_dir").withColumns({**nothing, "_key": span_end(F.col("path")), "_end": F.lit(1)})
    along = swept(starts.unionByName(ends), ["repo"], ["_key", "_end"], list(own), "sum", window_rows)
    dirs = along.filter("is_dir").groupBy("repo", "path", "is_dir").agg(
        *[(F.sum(F.when(F.col("_end") == 1, F.col(f"{n}_upto")).otherwise(F.col(n) - F.col(f"{n}_upto")))).alias(n) for n in own]
    )
    whole = rows.groupBy("repo").agg(*[F.sum(n).alias(n) for n in own])
    whole = whole.withColumns({"path": F.lit(""), "is_dir": F.lit(True)})
    return rows.filter("not is_dir").unionByName(dirs).unionByName(whole)


def selection_totals(totals: DataFrame, rules: DataFrame, sums: Sequence[str]) -> DataFrame:
    """(repo, selected_files, all_files, selected_<sums>) of a selection, out of the written
    table of ``subtree_totals``. A rule changes the totals by those of its own subtree, if it
    differs from what holds around it; nested rules add up. No node is looked at but those that
    rules name, so another selection costs as much as it has rules."""
    changes = _resolved(rules).filter("inside <> outside").select(
        "repo", "path", F.when(F.col("inside"), 1).otherwise(-1).cast("bigint").alias("_sign")
    )
    names = ["n_files", *sums]
    changed = lookup_join(totals.filter("path <> ''"), changes, ["repo", "path"], "inner").groupBy("repo").agg(
        *[F.sum(F.col(n) * F.col("_sign")).alias(f"_{n}") for n in names]
    )
    whole = lookup_join(totals.filter("path = ''"), changed, ["repo"])
    after = {n: F.col(n) + F.coalesce(f"_{n}", F.lit(0).cast("bigint")) for n in names}
    return whole.select(
        "repo", after["n_files"].alias("selected_files"), F.col("n_files").alias("all_files"),
        *[after[n].alias(f"selected_{n}") for n in sums],
    )


def hierarchical_order(nodes: DataFrame, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Add ``ord``, the 1-based place of each node in its repo's tree order."""
    keyed = nodes.withColumn("_key", sort_key(F.col("path"), F.col("is_dir")))
    return number_in_order(keyed, "repo", "_key", window_rows=window_rows).drop("_key")
