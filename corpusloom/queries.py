"""Registered queries: one per operator, over the tables of one folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.constants import C_EXTENSIONS, ENV_LABEL, HASH_EXTENSIONS, MARKUP_EXTENSIONS
from corpusloom.functions import paths, text
from corpusloom.functions.render import render_markdown, render_xml
from corpusloom.functions.secrets import passes_gate
from corpusloom.operators import counting, tree, unpacking
from corpusloom.plans import pack as plan
from corpusloom.plans import unpack as unplan
from corpusloom.session import filter_made, stage, staging_root
from corpusloom.sources import snapshots, views

GLOBS = ["*.css", "d?", "logs/*/d1", "d.x", "[a-", "lib*/*"]
BUCKETS = 32  # of the snapshot that blocks are committed to
SMALL_GLOBS = ["*.css", "docs/*/d[^0-2]", "[a-"]
LIMIT = 2_000
PIECE_TOKENS, TREE_CHUNK = 300, 7  # small, so that trees and parts come as several rows
PREAMBLE_OF_ONES_OWN = "Files of one repository, in order.\n\n"
ROOT = "src"

Query = Callable[[SparkSession, str], DataFrame]


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return views.spark_view(spark, sf, views.FILES)


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    return views.spark_view(spark, sf, views.TREE)


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return views.spark_view(spark, sf, views.PAGES)


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    return views.spark_view(spark, sf, views.responses_sql("spark"))


def _chat(spark: SparkSession, sf: str) -> DataFrame:
    return views.spark_view(spark, sf, views.CHAT)


def _by_family(extensions: list[str] | None = None) -> Query:
    """Stripped files with these extensions, or all files."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        files = _files(spark, sf)
        if extensions:
            files = files.filter(paths.extension(F.col("path")).isin(extensions))
        return files.select("repo", "path", plan.text(True).alias("stripped"))

    return run


# Sources and sinks ------------------------------------------------------------


def corpus_scan(spark, sf):
    return _tree(spark, sf).select("repo", "path", F.octet_length("content").alias("size"))


def tree_nodes(spark, sf):
    return tree.tree_nodes(_tree(spark, sf))


def part_names(spark, sf):
    return plan.part_names(plan.pack(_tree(spark, sf), LIMIT), "out", ".md")


def _latest_blocks(spark, sf):
    blocks = unpacking.safe_blocks(unpacking.unpack(_responses(spark, sf)))
    return unpacking.latest_block(blocks, ["repo", "clean_path"], ["resp_id", "block_ord"])


def apply_blocks(spark, sf):
    return unpacking.apply_blocks(_files(spark, sf), _latest_blocks(spark, sf))


def commit_blocks(spark, sf):
    root = f"{staging_root(spark)}/snapshot-{uuid.uuid4().hex}"
    snapshots.create_snapshot(_files(spark, sf), root, BUCKETS)
    snapshots.commit_blocks(spark, root, _latest_blocks(spark, sf))
    return snapshots.read_snapshot(spark, root)


# Filters ----------------------------------------------------------------------


def ignore_glob(spark, sf):
    nodes = tree.tree_nodes(_tree(spark, sf))
    return nodes.select(
        "repo", "path", "is_dir", tree.custom_ignore(F.col("path"), GLOBS).alias("ignored")
    )


def ignore_file(spark, sf):
    files = _tree(spark, sf)
    marked = tree.ignore_reason(tree.tree_nodes(files), tree.ignore_rules(files))
    return marked.select(
        "repo", "path", "is_dir", F.coalesce(F.col("reason") == "file", F.lit(False)).alias("ignored")
    )


def ignore_default(spark, sf):
    nodes = tree.tree_nodes(_tree(spark, sf))
    return nodes.select("repo", "path", "is_dir", tree.default_ignore(F.col("path")).alias("ignored"))


def ignore_combined(spark, sf):
    files = _tree(spark, sf)
    marked = tree.ignore_reason(tree.tree_nodes(files), tree.ignore_rules(files), SMALL_GLOBS)
    return marked.select("repo", "path", "is_dir", "reason")


def walk(spark, sf):
    return tree.walk(_tree(spark, sf), SMALL_GLOBS).select(
        "repo", "path", "name", "is_dir", "depth", "size"
    )


def binary_filter(spark, sf):
    return _files(spark, sf).select(
        "repo", "path", paths.binary_reason(F.col("path"), F.col("content")).alias("reason")
    )


def secret_gate_misses(spark, sf):
    files = filter_made(_files(spark, sf), ~passes_gate(F.col("content")))
    return plan.secret_findings(files, strict=True).filter(F.col("rule") != ENV_LABEL)


def hide_descendants(spark, sf):
    nodes = tree.tree_nodes(_tree(spark, sf))
    shut = tree.directories(_tree(spark, sf)).filter(
        paths.name(F.col("path")).isin("d1", "core", "v1") | (F.col("path") == "node_modules")
    )
    return tree.hide_descendants(nodes, shut).select("repo", "path", "is_dir")


def select_subtree(spark, sf):
    nodes = tree.tree_nodes(_tree(spark, sf))
    rules = _selection(spark, sf)
    return tree.select_subtree(nodes, rules).select("repo", "path", "is_dir", "selected")


def subtree_totals(spark, sf):
    return tree.subtree_totals(tree.tree_nodes(_tree(spark, sf)), ["size"])


def _selection(spark, sf):
    """Rules taken from the directories: 'd...' off, below 'src' on again, 'lib' off."""
    name = paths.name(F.col("path"))
    seq = (
        F.when(name.isin("d2", "d3"), 1).when(F.col("path").isin("src", "docs"), 2).when(F.col("path") == "lib", 3)
        .when(name == "d0", 4).otherwise(5)
    )
    return (
        tree.directories(_tree(spark, sf))
        .filter(name.isin("d0", "d2", "d3", "bin") | F.col("path").isin("src", "docs", "lib"))
        .select("repo", seq.alias("seq"), "path", (seq % 2 == 0).alias("selected"))
    )


# Paths and scalars ------------------------------------------------------------


def path_parts(spark, sf):
    return _tree(spark, sf).unionByName(_pages(spark, sf)).select(
        "repo",
        paths.relative_path(F.col("path"), F.lit(ROOT)).alias("path"),
        paths.name(F.col("path")).alias("name"),
        paths.depth(F.col("path")).alias("depth"),
        paths.extension(F.col("path")).alias("ext"),
    )


def lang_label(spark, sf):
    return _files(spark, sf).select("repo", "path", paths.language(F.col("path")).alias("lang"))


def size_kb(spark, sf):
    size = F.octet_length("content")
    return _files(spark, sf).select("repo", "path", text.size_kb(size).alias("kb"))


def compact_number(spark, sf):
    n = F.octet_length("content").cast("bigint")
    return _files(spark, sf).select(
        "repo",
        "path",
        text.compact_number(n).alias("one"),
        text.compact_number(n * 50).alias("fifty"),
        text.compact_number(n * 5000).alias("many"),
    )


def path_safety(spark, sf):
    blocks = unpacking.unpack(_responses(spark, sf))
    return blocks.select("repo", "resp_id", "block_ord", "path", "clean_path", "status")


# Order and packing ------------------------------------------------------------


def hier_order(spark, sf):
    return tree.hierarchical_order(tree.tree_nodes(_tree(spark, sf))).select(
        "repo", "path", "is_dir", F.col("ord").cast("bigint").alias("ord")
    )


def hier_order_ranges(spark, sf):
    """The same order by ranges, as for repos too large for a window."""
    nodes = tree.hierarchical_order(tree.tree_nodes(_tree(spark, sf)), window_rows=5)
    return nodes.select("repo", "path", "is_dir", F.col("ord").cast("bigint").alias("ord"))


def pack_parts(spark, sf):
    return plan.pack(_tree(spark, sf), LIMIT).parts.select("repo", "path", "tokens", "part")


def pack_parts_large(spark, sf):
    packed = plan.pack(_tree(spark, sf), 12_000, strip=False, fmt="xml", chunk=16)
    return packed.parts.select("repo", "path", "tokens", "part")


def pack_parts_unlimited(spark, sf):
    packed = plan.pack(_tree(spark, sf), chunk=16)
    return packed.parts.select("repo", "path", "tokens", "part", "before")


def pack_parts_selected(spark, sf):
    packed = plan.pack(_tree(spark, sf), LIMIT, selection=_selection(spark, sf))
    return packed.parts.select("repo", "path", "tokens", "part")


def count_words(column):
    return F.regexp_count(column, F.lit("[^ \n]+")).cast("bigint")


def pack_parts_counter(spark, sf):
    packed = plan.pack(_tree(spark, sf), LIMIT, counter=count_words, preamble=PREAMBLE_OF_ONES_OWN)
    return packed.parts.select("repo", "path", "tokens", "part")


# Runs of letters, of digits and of anything else: one token for every 4 characters begun.
PIECES = "[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+"


def count_piece(column):
    return F.ceil(F.length(column) / 4)


def pack_parts_pieces(spark, sf):
    packed = plan.pack(_tree(spark, sf), LIMIT, counter=counting.PieceCounter(PIECES, count_piece), preamble=PREAMBLE_OF_ONES_OWN)
    return packed.parts.select("repo", "path", "content_tokens", "tokens", "part")


def repack_parts(spark, sf):
    """Files with a 7 before the extension are edited, those with a 13 there are deleted."""
    files = _tree(spark, sf)
    edited = F.concat("content", F.lit("\nedited\n"))
    changed = files.filter("path not like '%13.%'").withColumn(
        "content", F.when(F.col("path").like("%7.%"), edited).otherwise(F.col("content"))
    )
    packed = plan.repack(plan.pack(files, LIMIT), changed)
    return packed.parts.join(packed.nodes.select("repo", "ord", "rendered"), ["repo", "ord"]).select(
        "repo", "path", "tokens", "part", "rendered"
    )


def pack_totals(spark, sf):
    return plan.pack_totals(plan.pack(_tree(spark, sf), LIMIT, selection=_selection(spark, sf)))


def named_parts(spark, sf):
    return plan.named_parts(plan.pack(_tree(spark, sf), LIMIT), "out", ".md")


def latest_block(spark, sf):
    blocks = unpacking.safe_blocks(unpacking.unpack(_responses(spark, sf)))
    return unpacking.latest_block(blocks, ["repo", "resp_id", "clean_path"], ["block_ord"]).select(
        "repo", "resp_id", "clean_path", "block_ord", "content"
    )


# Text -------------------------------------------------------------------------


def strip_markup(spark, sf):
    files = _files(spark, sf).unionByName(_pages(spark, sf))
    return files.filter(paths.extension(F.col("path")).isin(MARKUP_EXTENSIONS)).select(
        "repo", "path", plan.text(True).alias("stripped")
    )


def line_split(spark, sf):
    ls = text.lines(F.col("content"))
    longest = F.coalesce(F.array_max(F.transform(ls, F.octet_length)), F.lit(0))
    return _files(spark, sf).select(
        "repo", "path", F.size(ls).alias("n_lines"), longest.alias("max_line_bytes"),
        F.array_join(ls, "|").alias("joined"),
    )


def token_estimate(spark, sf):
    return _files(spark, sf).select("repo", "path", text.token_estimate(F.col("content")).alias("token_est"))


def secret_findings(spark, sf):
    return plan.secret_findings(_files(spark, sf))


def cdata_roundtrip(spark, sf):
    escaped = text.cdata_escape(F.col("content"))
    return _files(spark, sf).select(
        "repo", "path", escaped.alias("escaped"),
        (text.cdata_restore(escaped) == F.col("content")).alias("restored"),
    )


def render_xml_q(spark, sf):
    return _files(spark, sf).select("repo", "path", render_xml(F.col("path"), F.col("content")).alias("block"))


def render_md_q(spark, sf):
    return _files(spark, sf).select("repo", "path", render_markdown(F.col("path"), F.col("content")).alias("block"))


def tree_diagram(spark, sf):
    nodes = plan.corpus_nodes(_tree(spark, sf), selection=_selection(spark, sf))
    return plan.tree_text(nodes).select("repo", "piece", "n_pieces", "tree")


def part_body(spark, sf):
    return plan.part_body(plan.pack(_tree(spark, sf), LIMIT))


def tree_diagram_pieces(spark, sf):
    nodes = plan.corpus_nodes(_tree(spark, sf), selection=_selection(spark, sf))
    return plan.tree_text(nodes, TREE_CHUNK).select("repo", "piece", "n_pieces", "tree")


def part_body_pieces(spark, sf):
    return plan.part_body(plan.pack(_tree(spark, sf), LIMIT), PIECE_TOKENS, TREE_CHUNK)


# Reports ----------------------------------------------------------------------


def corpus_summary(spark, sf):
    return plan.corpus_summary(plan.token_nodes(_tree(spark, sf), selection=_selection(spark, sf)))


def selection_totals(spark, sf):
    sums = ["size", "token_count"]
    totals = stage(tree.subtree_totals(plan.token_nodes(_tree(spark, sf)), sums))
    return tree.selection_totals(totals, _selection(spark, sf), sums).select(
        "repo", "selected_files", "all_files", F.col("selected_size").alias("selected_bytes"),
        F.col("selected_token_count").alias("selected_tokens"),
    )


def context_fit(spark, sf):
    return plan.context_fit(corpus_summary(spark, sf)).select("repo", "selected_tokens", "fit")


def secret_findings_packed(spark, sf):
    packed = plan.pack(_tree(spark, sf), LIMIT, selection=_selection(spark, sf))
    return plan.secret_findings(plan.packed_files(packed))


def secret_flag(spark, sf):
    return plan.with_secret_flag(_files(spark, sf)).select("repo", "path", "has_secret")


def secret_rollup(spark, sf):
    return plan.secret_rollup(plan.secret_findings(_files(spark, sf)))


def strip_savings(spark, sf):
    return plan.strip_savings(_files(spark, sf))


def part_summary(spark, sf):
    return plan.part_summary(plan.pack(_tree(spark, sf), LIMIT))


# Unpack -----------------------------------------------------------------------


def _unpack(fmt: str) -> Query:
    def run(spark, sf):
        both = _responses(spark, sf).unionByName(_chat(spark, sf))
        return unpacking.unpack(both, fmt).select(
            "repo", "resp_id", "block_ord", "path", "content"
        )

    return run


def unpack_quarantine(spark, sf):
    blocks = unpacking.unpack(_responses(spark, sf))
    return blocks.filter("status <> 'ok'").select(
        "repo", "resp_id", "block_ord", "path", "status"
    )


def roundtrip_report(spark, sf):
    return unplan.roundtrip_report(_tree(spark, sf))


def roundtrip_parts_xml(spark, sf):
    return unplan.roundtrip_parts(plan.pack(_tree(spark, sf), LIMIT, "xml", strip=False))


def roundtrip_parts_markdown(spark, sf):
    return unplan.roundtrip_parts(plan.pack(_tree(spark, sf), LIMIT, strip=False))


def _wide(query: Query) -> Query:
    """Integers as bigint, the integer type of the SQL texts."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = query(spark, sf)
        narrow = [f.name for f in df.schema.fields if f.dataType.typeName() == "integer"]
        return df.withColumns({c: F.col(c).cast("bigint") for c in narrow}) if narrow else df

    return run


_QUERIES: dict[str, Query] = {
    "corpus_scan": corpus_scan,
    "tree_nodes": tree_nodes,
    "part_names": part_names,
    "apply_blocks": apply_blocks,
    "commit_blocks": commit_blocks,
    "ignore_glob": ignore_glob,
    "ignore_file": ignore_file,
    "ignore_default": ignore_default,
    "ignore_combined": ignore_combined,
    "walk": walk,
    "binary_filter": binary_filter,
    "secret_gate_misses": secret_gate_misses,
    "hide_descendants": hide_descendants,
    "select_subtree": select_subtree,
    "subtree_totals": subtree_totals,
    "path_parts": path_parts,
    "lang_label": lang_label,
    "size_kb": size_kb,
    "compact_number": compact_number,
    "path_safety": path_safety,
    "hier_order": hier_order,
    "hier_order_ranges": hier_order_ranges,
    "pack_parts": pack_parts,
    "pack_parts_large": pack_parts_large,
    "pack_parts_unlimited": pack_parts_unlimited,
    "pack_parts_selected": pack_parts_selected,
    "pack_parts_counter": pack_parts_counter,
    "pack_parts_pieces": pack_parts_pieces,
    "repack_parts": repack_parts,
    "pack_totals": pack_totals,
    "named_parts": named_parts,
    "latest_block": latest_block,
    "strip_c": _by_family(C_EXTENSIONS),
    "strip_hash": _by_family(HASH_EXTENSIONS),
    "strip_markup": strip_markup,
    "blank_collapse": _by_family(),
    "line_split": line_split,
    "token_estimate": token_estimate,
    "secret_findings": secret_findings,
    "cdata_roundtrip": cdata_roundtrip,
    "render_xml": render_xml_q,
    "render_md": render_md_q,
    "tree_diagram": tree_diagram,
    "part_body": part_body,
    "tree_diagram_pieces": tree_diagram_pieces,
    "part_body_pieces": part_body_pieces,
    "secret_findings_packed": secret_findings_packed,
    "secret_flag": secret_flag,
    "corpus_summary": corpus_summary,
    "selection_totals": selection_totals,
    "context_fit": context_fit,
    "secret_rollup": secret_rollup,
    "strip_savings": strip_savings,
    "part_summary": part_summary,
    "unpack_xml": _unpack("xml"),
    "unpack_md": _unpack("markdown"),
    "unpack_auto": _unpack("auto"),
    "unpack_quarantine": unpack_quarantine,
    "roundtrip_report": roundtrip_report,
    "roundtrip_parts_xml": roundtrip_parts_xml,
    "roundtrip_parts_markdown": roundtrip_parts_markdown,
}

QUERIES = {name: _wide(query) for name, query in _QUERIES.items()}
