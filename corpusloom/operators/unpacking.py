"""File blocks out of response texts, and their way into a snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.automaton import rewrite
from corpusloom.functions.paths import clean_path, path_status
from corpusloom.functions.text import WS, WS_LINE, cdata_restore, let, preceded
from corpusloom.session import built_once, fits_broadcast, stage

_SPACE = r"\t\n\f\r "
_FILE_TAG = rf"<file[{_SPACE}]+path=[\"']([^\"']+)[\"'][^>]*>"
_CLOSE_TAG = rf"\A[{WS}]*</file>[{WS}]*\z"
_CDATA_OPEN = rf"\A[{WS}]*<!\[CDATA\[[{WS}]*\z"
_CDATA_END = rf"\A[{WS}]*\]\]>[{WS}]*\z"
_ENDS_CDATA = rf"\]\]>[{WS}]*\z"
_HEADER = rf"\A##[{_SPACE}]+File:[{_SPACE}]*([^{_SPACE}()]+)"
_FENCE = rf"\A[{WS}]*```"

# Lines that can matter to the two automata.
_XML_LINE = r"\n[^\n]*?(?:</?file|<!\[CDATA\[|\]\]>)[^\n]*"
_MD_LINE = rf"\n(?:##|[{WS_LINE}]*+```)[^\n]*"

_BLOCKS = "array<struct<path:string,content:string>>"


def _collect(marked: Column) -> Column:
    """Blocks from a text whose lines begin with a mark: '@' path of a new block,
    '+' content, '.' end of the block. Every line has one, so marks and content
    cannot be confused."""
    pieces = F.split(marked, "\n@")
    closed = F.filter(pieces, lambda p, i: (i > 0) & p.endswith("\n."))

    def block(piece: Column) -> Column:
        path = F.substring_index(piece, "\n", 1)
        # Between the path and the closing mark: nothing, or '\n+line' repeated.
        rest = F.length(piece) - F.length(path) - F.lit(4)
        body = F.substr(piece, F.length(path) + F.lit(3), rest)
        content = F.when(rest >= 0, F.replace(body, F.lit("\n+"), F.lit("\n"))).otherwise("")
        return F.struct(path.alias("path"), content.alias("content"))

    return F.transform(closed, block)


def _content_lines(stretch: Column) -> Column:
    return F.replace(stretch, F.lit("\n"), F.lit("\n+"))


def _content_line(line: Column) -> Column:
    return F.concat(F.lit("\n+"), line)


def xml_blocks(body: Column) -> Column:
    """Array of (path, content) from ``file`` tags. States: outside, inside the
    tag, inside its CDATA section."""

    def effect(line: Column) -> Column:
        close = line.rlike(_CLOSE_TAG)
        outside = F.when(line.rlike(_FILE_TAG), "I").otherwise("O")
        inside = F.when(close, "O").when(line.rlike(_CDATA_OPEN), "C").otherwise("I")
        cdata = F.when(close | line.rlike(_ENDS_CDATA), "O").otherwise("C")
        return F.concat(outside, inside, cdata)

    def mark(line: Column, state: Column) -> Column:
        tag = F.concat(F.lit("\n@"), F.regexp_extract(line, _FILE_TAG, 1))
        tail = F.concat(_content_line(F.regexp_replace(line, r"\]\]>\z", "")), F.lit("\n."))
        return (
            F.when(state == "O", F.when(line.rlike(_FILE_TAG), tag))
            .when(line.rlike(_CLOSE_TAG) | ((state == "C") & line.rlike(_CDATA_END)), "\n.")
            .when(line.rlike(_CDATA_OPEN), F.lit(None))
            .when((state == "C") & line.rlike(_ENDS_CDATA), tail)
            .otherwise(_content_line(line))
        )

    def between(stretch: Column, state: Column) -> Column:
        return F.when(state != "O", _content_lines(stretch))

    found = _collect(rewrite(preceded(body), _XML_LINE, "OIC", effect, between, mark))
    return F.when(body.contains("<file"), found).otherwise(F.array().cast(_BLOCKS))


def markdown_blocks(body: Column) -> Column:
    """Array of (path, content) from file headers and the fence after each.
    States: outside, after a header, inside the fence."""

    def effect(line: Column) -> Column:
        fence = line.rlike(_FENCE)
        return F.concat(
            F.when(line.rlike(_HEADER), "H").otherwise("O"),
            F.when(fence, "K").otherwise("H"),
            F.when(fence, "O").otherwise("K"),
        )

    def mark(line: Column, state: Column) -> Column:
        header = F.concat(F.lit("\n@"), F.regexp_extract(line, _HEADER, 1))
        return F.when(state == "O", F.when(line.rlike(_HEADER), header)).when(
            state == "K", F.when(line.rlike(_FENCE), "\n.").otherwise(_content_line(line))
        )

    def between(stretch: Column, state: Column) -> Column:
        return F.when(state == "K", _content_lines(stretch))

    found = _collect(rewrite(preceded(body), _MD_LINE, "OHK", effect, between, mark))
    return F.when(body.contains("File:"), found).otherwise(F.array().cast(_BLOCKS))


def from_first_opening(text: Column, fmt: str) -> Column:
    """``text`` from the first line on that may open a block of ``fmt``, xml or markdown; empty
    without one. The lines before it leave the automata above in the state they begin in, so
    the blocks are the same without them, whatever follows."""
    if fmt == "xml":
        at = F.instr(text, "<file")
        line = F.substring_index(F.left(text, at - 1), "\n", -1)
        return F.when(at > 0, F.concat(line, F.substr(text, at))).otherwise("")
    at = F.instr(F.concat(F.lit("\n"), text), "\n##")
    return F.when(at > 0, F.substr(text, at)).otherwise("")


def auto_blocks(body: Column) -> Column:
    """XML blocks; Markdown blocks only where there is no XML block."""
    return let(
        xml_blocks(body),
        lambda found: F.when(F.size(found) > 0, found).otherwise(markdown_blocks(body)),
    )


@built_once
def _parsed(fmt: str) -> Column:
    parse = {"xml": xml_blocks, "markdown": markdown_blocks, "auto": auto_blocks}[fmt]
    return parse(F.col("body"))


def unpack(responses: DataFrame, fmt: str = "auto") -> DataFrame:
    """One row per block: the key columns of ``responses`` (all but ``body``),
    block_ord from 1, path, clean_path, status, content with CDATA restored."""
    keys = [c for c in responses.columns if c != "body"]
    rows = responses.select(*keys, F.posexplode(_parsed(fmt)).alias("_pos", "_block"))
    path = F.col("_block.path")
    return rows.select(
        *keys,
        (F.col("_pos") + 1).alias("block_ord"),
        path.alias("path"),
        clean_path(path).alias("clean_path"),
        path_status(path).alias("status"),
        cdata_restore(F.col("_block.content")).alias("content"),
    )


def safe_blocks(blocks: DataFrame, on_unsafe: str = "quarantine") -> DataFrame:
    """Blocks that may be written. 'quarantine' leaves the others out (read them
    from ``blocks`` by status); 'fail' stops the job before anything is written."""
    if on_unsafe == "fail":
        return blocks.withColumn(
            "status",
            F.when(F.col("status") == "ok", F.col("status")).otherwise(
                F.raise_error(F.concat(F.lit("path leaves the workspace: "), F.col("path"))).cast("string")
            ),
        ).filter("status = 'ok'")
    return blocks.filter("status = 'ok'")


def latest_block(blocks: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last block per key. The rank filter is applied before the shuffle as
    well, so many copies of one path do not meet in one task."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return blocks.withColumn("_rank", F.row_number().over(last)).filter("_rank = 1").drop("_rank")


def apply_blocks(snapshot: DataFrame, blocks: DataFrame, written: bool = False) -> DataFrame:
    """Write blocks (repo, clean_path, content; one per path) over a snapshot
    (repo, path, content). Adds ``change``: added, replaced, same or kept. ``written``
    says that ``blocks`` are a written table."""
    new = blocks.select(
        "repo", F.col("clean_path").alias("path"), F.col("content").alias("_new"), F.lit(True).alias("_block")
    )
    if not written:
        # Written once, as they are measured, looked up and told from the snapshot's keys.
        new = stage(new)
    snapshot = snapshot.select("repo", "path", "content", F.lit(True).alias("_old"))
    change = (
        F.when(F.col("_block").isNull(), "kept")
        .when(F.col("_old").isNull(), "added")
        .when(F.col("_new") == F.col("content"), "same")
        .otherwise("replaced")
    )
    rows = ["repo", "path", F.coalesce("_new", "content").alias("content"), change.alias("change")]
    if not fits_broadcast(new):
        # Both sides meet by path, once each: blocks are as heavy as files, so they aren't
        # copied to be salted.
        return snapshot.join(new.hint("merge"), ["repo", "path"], "full").select(*rows)
    # Blocks are looked up, so the snapshot's content isn't shuffled; only its keys are needed
    # to tell which blocks are new to it.
    old = snapshot.join(F.broadcast(new), ["repo", "path"], "left")
    added = new.join(snapshot.select("repo", "path"), ["repo", "path"], "left_anti")
    return old.unionByName(added, allowMissingColumns=True).select(*rows)
