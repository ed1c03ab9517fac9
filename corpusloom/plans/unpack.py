"""Unpack responses into a snapshot, and check what a round trip keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.render import render
from corpusloom.functions.text import cdata_restore
from corpusloom.operators.tree import kept_files, row_visible
from corpusloom.operators.unpacking import (
    apply_blocks,
    from_first_opening,
    latest_block,
    markdown_blocks,
    safe_blocks,
    unpack,
    xml_blocks,
)
from corpusloom.plans.pack import Packed, part_blocks, text


def unpack_into(
    snapshot: DataFrame, responses: DataFrame, fmt: str = "auto", on_unsafe: str = "quarantine"
) -> DataFrame:
    """The snapshot (repo, path, content) after writing every block of the
    responses (repo, resp_id, body) in (resp_id, block) order."""
    blocks = safe_blocks(unpack(responses, fmt), on_unsafe)
    latest = latest_block(blocks, ["repo", "clean_path"], ["resp_id", "block_ord"])
    return apply_blocks(snapshot, latest)


def roundtrip_report(files: DataFrame) -> DataFrame:
    """Render and unpack every packed file in both formats.

    (repo, path, fmt, fidelity): exact, newline (one final line feed lost),
    changed, renamed (content under another path) or missing.
    """
    source = kept_files(files)
    parsers = {"xml": xml_blocks, "markdown": markdown_blocks}
    for fmt, parse in parsers.items():
        body = render(F.col("path"), F.col("content"), fmt)
        source = source.withColumn(f"_{fmt}", parse(body))
    for fmt in parsers:
        source = source.withColumn(f"_{fmt}_back", _own_content(F.col(f"_{fmt}")))
    results = [
        F.struct(
            F.lit(fmt).alias("fmt"), _fidelity(F.col(f"_{fmt}"), F.col(f"_{fmt}_back")).alias("fidelity")
        )
        for fmt in parsers
    ]
    return source.select("repo", "path", F.inline(F.array(*results)))


def roundtrip_parts(packed: Packed, piece_tokens: int | None = None) -> DataFrame:
    """Unpack the part texts of a pack and follow every block to its file.

    (repo, part, path, fidelity). A file's own block is the first of its path in its part:
    exact, newline, changed or missing as in ``roundtrip_report``, but neighbours count: a lone
    close tag or fence in one file may cut it short or swallow the next. Blocks that belong to
    no file are reported, too: repeated (a later block of a path of the part) or invented (a
    path that isn't in the part). Every row of a part text is unpacked by itself.
    """
    sizes = {} if piece_tokens is None else {"piece_tokens": piece_tokens}
    fmt = "xml" if packed.fmt.lower() == "xml" else "markdown"
    # A tree is read once per repo: its lines matter to its parts from the first one on that
    # may open a block, which takes a file name with such a mark.
    blocks = unpack(part_blocks(packed, lambda tree: from_first_opening(tree, fmt), **sizes), fmt)
    own = Window.partitionBy("repo", "part", "path").orderBy("piece", "block_ord")
    blocks = blocks.select(
        "repo", "part", "path", F.col("content").alias("back"), F.row_number().over(own).alias("nth")
    )
    # The text that was packed, by the part it is in. Only that much is shuffled.
    placed = packed.parts.select("repo", "path", "part")
    sent = row_visible(packed.files, packed.globs).select("repo", "path", "content").join(placed, ["repo", "path"])
    sent = sent.select("repo", "part", "path", text(packed.strip).alias("content"), F.lit(1).alias("nth"))
    sent = sent.withColumn("sent", F.lit(True))
    met = sent.join(blocks, ["repo", "part", "path", "nth"], "full")
    content, back = F.col("content"), F.col("back")
    fidelity = (
        F.when(F.col("sent") & back.isNull(), "missing")
        .when(F.col("sent").isNull(), "repeated")
        .when(back == content, "exact")
        .when(F.concat(back, F.lit("\n")) == content, "newline")
        .otherwise("changed")
    )
    # Texts are compared first, so that they stay out of the window's shuffle.
    met = met.select("repo", "part", "path", "sent", fidelity.alias("_own"))
    # Later blocks of a path that isn't in the part are invented like the first.
    known = F.max("sent").over(Window.partitionBy("repo", "part", "path"))
    met = met.withColumn("_known", known)
    fidelity = F.when(F.col("_known").isNull(), "invented").otherwise(F.col("_own"))
    return met.select("repo", "part", "path", fidelity.alias("fidelity"))


def _own_content(blocks: Column) -> Column:
    """Content that came back under the file's own path."""
    mine = F.filter(blocks, lambda b: b["path"] == F.col("path"))
    return cdata_restore(F.get(mine, F.lit(0))["content"])


def _fidelity(blocks: Column, back: Column) -> Column:
    content = F.col("content")
    return (
        F.when(back == content, "exact")
        .when(F.concat(back, F.lit("\n")) == content, "newline")
        .when(back.isNotNull(), "changed")
        .when(F.size(blocks) > 0, "renamed")
        .otherwise("missing")
    )
