"""Pack a corpus: nodes, tree, parts and reports.

Content is read in two places only: once for the sizes of the rendered blocks
and once for the part texts. Everything between works on keys and integers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.constants import CONTEXT_TOKENS, PREAMBLE, TREE_CLOSE, TREE_OPEN
from corpusloom.functions.render import Counter, render, tree_line
from corpusloom.functions.secrets import secret_labels
from corpusloom.functions.strip import strip_comments
from corpusloom.functions.text import token_estimate
from corpusloom.operators.counting import PieceCounter, count_texts
from corpusloom.operators.packing import CHUNK, pack_parts
from corpusloom.operators.tree import hierarchical_order, kept_files, row_visible, select_subtree, walk
from corpusloom.session import (
    BROADCAST_BYTES,
    SALTS,
    built_once,
    check_often,
    fits_broadcast,
    lookup_join,
    one_by_one,
    remove_staged,
    spread,
    stage,
    staged_paths,
)

TREE_CHUNK = 100_000  # nodes per tree text row
PIECE_TOKENS = 4_000_000  # block tokens per part text row
GROUP_NODES = 1_000  # nodes of the tree rows that go to their parts together
PART_BLOCK = 1_024  # parts that a tree row goes to one after the other
STRETCH = 64  # such blocks that meet a copy of a tree row together
LOOKUP_BYTES = 8 * 1024 * 1024  # of trees, or of parts, that are broadcast: the driver holds them several times


def _bytes(text: str) -> int:
    return len(text.encode())


def ordered_listagg(value: str, order: str) -> Column:
    return F.expr(f"listagg({value}, '') within group (order by {order})")


@dataclass(frozen=True)
class Packed:
    """``nodes``: written table of all nodes in order with their block sizes.
    ``parts``: written table of every selected file: repo, ord, path, block_bytes,
    tokens, part, before, first. ``overhead``: written table of the tokens that every
    part of a repo starts with. ``staged`` names the written tables; ``close`` deletes
    them when the results have been read."""

    files: DataFrame
    nodes: DataFrame
    parts: DataFrame
    overhead: DataFrame
    fmt: str
    strip: bool
    globs: tuple[str, ...] = ()
    counter: Counter | PieceCounter = token_estimate
    preamble: str = PREAMBLE
    staged: list[str] = field(default_factory=list)
    max_tokens: int = 0

    def close(self) -> None:
        remove_staged(self.files.sparkSession, self.staged)


@built_once
def text(strip: bool) -> Column:
    """What goes into the block. Rendering refers to it several times, so it is
    always made a column of its own first."""
    content = F.col("content")
    return strip_comments(content, F.col("path")) if strip else content


def corpus_nodes(
    files: DataFrame,
    fmt: str = "markdown",
    strip: bool = True,
    globs: Sequence[str] = (),
    selection: DataFrame | None = None,
    counter: Counter | PieceCounter = token_estimate,
) -> DataFrame:
    """Written table of nodes: repo, path, is_dir, size, name, depth, selected, ord,
    digest, block_bytes, tokens, line_bytes; with a ``PieceCounter`` content_tokens, too."""
    # Written before they are numbered, as numbering counts them first.
    if isinstance(counter, PieceCounter):
        nodes = stage(selected(_counted_nodes(files, fmt, strip, globs, counter), selection))
    else:
        block = render(F.col("path"), F.col("_text"), fmt, counter)
        nodes = stage(selected(walk(files, globs, text(strip), _digest() | _sizes(block, counter)), selection))
    return _numbered(nodes)


def _digest() -> dict[str, Column]:
    return {"digest": F.md5(F.col("content").cast("binary"))}


def _sizes(block: Column, counter: Counter) -> dict[str, Column]:
    return {"block_bytes": F.octet_length(block).cast("bigint"), "tokens": counter(block).cast("bigint")}


def _numbered(nodes: DataFrame) -> DataFrame:
    line = tree_line(F.col("name"), F.col("depth"), F.col("is_dir"))
    return stage(
        hierarchical_order(nodes).withColumn("line_bytes", F.octet_length(line).cast("bigint"))
    )


def _content_tokens(content: Column) -> Column:
    """The counter of rows whose content was counted before."""
    return F.col("content_tokens")


def _kept_texts(files: DataFrame, nodes: DataFrame, strip: bool, globs: Sequence[str]) -> DataFrame:
    """(repo, path, _text) of the files among ``nodes``. Their keys are looked up."""
    keys = nodes.filter("not is_dir").select("repo", "path")
    rows = row_visible(files, globs).select("repo", "path", "content")
    return lookup_join(rows, keys, ["repo", "path"], "left_semi").select("repo", "path", text(strip).alias("_text"))


def _counted_nodes(files: DataFrame, fmt: str, strip: bool, globs: Sequence[str], counter: PieceCounter) -> DataFrame:
    """Nodes with content_tokens, block_bytes and tokens."""
    nodes = stage(walk(files, globs, facts=_digest()))
    return nodes.join(_counted_blocks(files, nodes, fmt, strip, globs, counter), ["repo", "path"], "left")


def _counted_blocks(
    files: DataFrame, nodes: DataFrame, fmt: str, strip: bool, globs: Sequence[str], counter: PieceCounter
) -> DataFrame:
    """(repo, path, content_tokens, block_bytes, tokens) of the files among ``nodes``. A block
    says how many tokens its content has, so contents are counted first, then the blocks."""
    keys = ["repo", "path"]
    # Written once, as each text is cut four times.
    texts = stage(_kept_texts(files, nodes, strip, globs))
    own = stage(count_texts(texts, keys, F.col("_text"), counter, "content_tokens"))
    blocks = lookup_join(texts, own, keys, "inner").select(
        *keys, "content_tokens", render(F.col("path"), F.col("_text"), fmt, _content_tokens).alias("_block")
    )
    sizes = blocks.select(*keys, "content_tokens", F.octet_length("_block").cast("bigint").alias("block_bytes"))
    return sizes.join(count_texts(blocks, keys, F.col("_block"), counter), keys)


def selected(nodes: DataFrame, selection: DataFrame | None) -> DataFrame:
    """Add ``selected``; all nodes without selection rules."""
    if selection is None:
        return nodes.withColumn("selected", F.lit(True))
    return select_subtree(nodes, selection)


def tree_bytes(nodes: DataFrame) -> DataFrame:
    """(repo, tree_bytes): size of each repo's tree text."""
    fixed = _bytes(TREE_OPEN) + _bytes(TREE_CLOSE)
    return nodes.groupBy("repo").agg(
        (F.sum(F.when(F.col("selected"), F.col("line_bytes")).otherwise(0)) + fixed).alias(
            "tree_bytes"
        )
    )


def tree_text(nodes: DataFrame, chunk: int = TREE_CHUNK) -> DataFrame:
    """(repo, piece, n_pieces, tree): the tree of selected nodes. A tree of more
    than ``chunk`` nodes comes as several rows to be read in ``piece`` order."""
    last = nodes.groupBy("repo").agg(
        (F.floor((F.max("ord") - 1) / chunk) + 1).cast("bigint").alias("n_pieces")
    )
    line = F.when(
        F.col("selected"), tree_line(F.col("name"), F.col("depth"), F.col("is_dir"))
    ).otherwise("")
    pieces = (
        nodes.select(
            "repo", "ord", line.alias("line"),
            F.floor((F.col("ord") - 1) / chunk).cast("bigint").alias("piece"),
        )
        .groupBy("repo", "piece")
        .agg(ordered_listagg("line", "ord").alias("tree"))
    )
    return lookup_join(pieces, last, ["repo"]).select(
        "repo",
        "piece",
        "n_pieces",
        F.concat(
            F.when(F.col("piece") == 0, TREE_OPEN).otherwise(""),
            "tree",
            F.when(F.col("piece") == F.col("n_pieces") - 1, TREE_CLOSE).otherwise(""),
        ).alias("tree"),
    )


def part_overhead(nodes: DataFrame, counter: Counter | PieceCounter, preamble: str) -> DataFrame:
    """(repo, overhead): tokens of the tree and of the preamble. The usual counter
    needs sizes only; another one reads the tree texts, piece by piece."""
    if isinstance(counter, PieceCounter):
        # Every tree text has an own row, the preamble one per repo.
        trees = stage(tree_text(nodes).select("repo", "piece", F.col("tree").alias("_text")))
        front = trees.select("repo", F.lit(-1).cast("bigint").alias("piece"), F.lit(preamble).alias("_text")).distinct()
        counts = count_texts(trees.unionByName(front), ["repo", "piece"], F.col("_text"), counter)
        return counts.groupBy("repo").agg(F.sum("tokens").alias("overhead"))
    front = counter(F.lit(preamble))
    if counter is token_estimate:
        return tree_bytes(nodes).select(
            "repo", (F.shiftright("tree_bytes", 2) + front).cast("bigint").alias("overhead")
        )
    trees = tree_text(nodes).groupBy("repo").agg(F.sum(counter(F.col("tree"))).alias("_tree"))
    return trees.select("repo", (F.col("_tree") + front).cast("bigint").alias("overhead"))


def pack(
    files: DataFrame,
    max_tokens: int = 0,
    fmt: str = "markdown",
    strip: bool = True,
    globs: Sequence[str] = (),
    selection: DataFrame | None = None,
    chunk: int = CHUNK,
    counter: Counter | PieceCounter = token_estimate,
    preamble: str = PREAMBLE,
) -> Packed:
    """Pack ``files`` (repo, path, content) into parts of ``max_tokens`` tokens, as
    ``counter`` counts them; 0 sets no limit. Paths are unique in their repo."""
    with staged_paths() as paths:
        nodes = corpus_nodes(files, fmt, strip, globs, selection, counter)
        blocks = nodes.filter("selected and not is_dir").select("repo", "ord", "tokens")
        overhead = stage(part_overhead(nodes, counter, preamble))
        parts = stage(_with_facts(pack_parts(blocks, overhead, max_tokens, chunk), nodes, counter))
    return Packed(files, nodes, parts, overhead, fmt, strip, tuple(globs), counter, preamble, paths, max_tokens)


def _with_facts(parts: DataFrame, nodes: DataFrame, counter: Counter | PieceCounter) -> DataFrame:
    return parts.join(nodes.select("repo", "ord", "path", "digest", "block_bytes", *_known_tokens(counter)), ["repo", "ord"])


def repack(previous: Packed, files: DataFrame, selection: DataFrame | None = None, chunk: int = CHUNK) -> Packed:
    """What ``pack`` gives for ``files`` with the settings of ``previous``, made from it.

    Files whose path and content digest (MD5 of 128 bits) are those of before keep their sizes
    and tokens; only the others are stripped, rendered and counted (``rendered`` in
    ``nodes``). A repo whose blocks and overhead are the same keeps its parts, the others are
    walked again over their numbers. ``selection`` is as in ``pack``; another one renders
    nothing anew. ``previous`` must not be closed before."""
    fmt, strip, globs, counter = previous.fmt, previous.strip, previous.globs, previous.counter
    keys = ["repo", "path"]
    names = ["block_bytes", "tokens", *_known_tokens(counter)]
    with staged_paths() as paths:
        known = previous.nodes.filter("not is_dir").select(*keys, "digest", *names)
        nodes = stage(walk(files, globs, facts=_digest()).join(known, [*keys, "digest"], "left"))
        nodes = nodes.withColumn("rendered", ~F.col("is_dir") & F.col("tokens").isNull())
        new = nodes.filter("rendered").select(*keys, "is_dir")
        if isinstance(counter, PieceCounter):
            made = _counted_blocks(files, new, fmt, strip, globs, counter)
        else:
            block = render(F.col("path"), F.col("_text"), fmt, counter)
            made = _kept_texts(files, new, strip, globs).select(*keys, *[c.alias(n) for n, c in _sizes(block, counter).items()])
        made = stage(made.select(*keys, *[F.col(n).alias(f"_{n}") for n in names]))
        nodes = lookup_join(nodes, made, keys).withColumns({n: F.coalesce(n, f"_{n}") for n in names})
        nodes = _numbered(stage(selected(nodes.drop(*[f"_{n}" for n in names]), selection)))
        blocks = nodes.filter("selected and not is_dir").select("repo", "ord", "tokens")
        overhead = stage(part_overhead(nodes, counter, previous.preamble))
        same = _walks(blocks, overhead).join(_walks(previous.parts, previous.overhead), ["repo", "_n", "_sum", "overhead"]).select("repo")
        same = stage(same)
        kept = lookup_join(previous.parts, same, ["repo"], "left_semi").select("repo", "ord", "tokens", "part", "before", "first")
        again = blocks.join(same, ["repo"], "left_anti")
        walked = pack_parts(again, overhead, previous.max_tokens, chunk)
        parts = stage(_with_facts(kept.unionByName(walked), nodes, counter))
    return Packed(files, nodes, parts, overhead, fmt, strip, globs, counter, previous.preamble, paths, previous.max_tokens)


def _hash_sum(*columns: Column | str) -> Column:
    """A digest of rows in any order."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))


def _walks(blocks: DataFrame, overhead: DataFrame) -> DataFrame:
    """(repo, _n, _sum, overhead): all that the parts of a repo depend on."""
    sums = blocks.groupBy("repo").agg(F.count("*").alias("_n"), _hash_sum("ord", "tokens").alias("_sum"))
    return sums.join(overhead.select("repo", "overhead"), "repo")


def part_changes(previous: Packed, packed: Packed) -> DataFrame:
    """(repo, part, change) of every part text: same, changed, added or gone. Told from
    digests of the tree and of the part's files, no text is built. Settings other than the
    selection must be those of before, as in ``repack``."""

    def digests(of: Packed, name: str) -> DataFrame:
        tree = of.nodes.filter("selected").groupBy("repo").agg(_hash_sum("ord", "path", "is_dir").alias("_tree"))
        parts = of.parts.groupBy("repo", "part").agg(
            F.count("*").alias("_n"), _hash_sum("path", "digest", "before").alias("_files")
        )
        return lookup_join(parts, tree, ["repo"]).select("repo", "part", F.struct("_tree", "_n", "_files").alias(name))

    both = digests(previous, "_old").join(digests(packed, "_new"), ["repo", "part"], "full")
    old, new = F.col("_old"), F.col("_new")
    change = F.when(old.isNull(), "added").when(new.isNull(), "gone").when(old == new, "same").otherwise("changed")
    return both.select("repo", "part", change.alias("change"))


def _known_tokens(counter: Counter | PieceCounter) -> list[str]:
    return ["content_tokens"] if isinstance(counter, PieceCounter) else []


def packed_files(packed: Packed) -> DataFrame:
    """The rows of the files that were packed: kept, selected, no binaries."""
    rows = kept_files(packed.files, packed.globs)
    chosen = packed.parts.select("repo", "path")
    return lookup_join(rows, chosen, ["repo", "path"], "left_semi")


def part_summary(packed: Packed) -> DataFrame:
    """(repo, part, n_files, bytes, tokens) of every part text, from sizes alone. With a
    counter of one's own, tokens are those of the tree, the preamble and the blocks."""
    sums = packed.parts.groupBy("repo", "part").agg(
        F.count("*").alias("n_files"), F.sum("block_bytes").alias("_blocks"), F.sum("tokens").alias("_tokens")
    )
    size = F.col("_blocks") + F.col("tree_bytes") + _bytes(packed.preamble)
    estimated = packed.counter is token_estimate
    tokens = F.shiftright(size, 2) if estimated else F.col("_tokens") + F.col("overhead")
    repos = tree_bytes(packed.nodes).join(packed.overhead, "repo")
    return lookup_join(sums, repos, ["repo"]).select(
        "repo", "part", "n_files", size.alias("bytes"), tokens.alias("tokens")
    )


def pack_totals(packed: Packed) -> DataFrame:
    """(repo, n_nodes_files, n_files, n_parts, bytes, tokens): all file nodes, packed
    files, parts, and the sums over the part texts. A repo without a part has zeros."""
    every = packed.nodes.groupBy("repo").agg(F.count_if(~F.col("is_dir")).alias("all_files"))
    sums = part_summary(packed).groupBy("repo").agg(
        F.sum("n_files").alias("n_files"), F.count("*").alias("n_parts"),
        F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"),
    )
    names = ["n_files", "n_parts", "bytes", "tokens"]
    return every.join(sums, "repo", "left").select(
        "repo", "all_files", *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in names]
    )


def part_names(packed: Packed, base: str, ext: str) -> DataFrame:
    """(repo, part, n_parts, n_files, part_name, marker). One part keeps the plain
    name and has no marker."""
    per_part = packed.parts.groupBy("repo", "part").agg(F.count("*").alias("n_files"))
    return lookup_join(per_part, _part_counts(packed), ["repo"]).select(
        "repo", "part", "n_parts", "n_files", *[c.alias(n) for n, c in _names(base, ext).items()]
    )


def _part_counts(packed: Packed) -> DataFrame:
    return packed.parts.groupBy("repo").agg(F.max("part").alias("n_parts"))


def _names(base: str, ext: str) -> dict[str, Column]:
    """part_name and marker, of part and n_parts."""
    number = F.col("part").cast("string")
    several = F.col("n_parts") > 1
    name = F.when(several, F.concat(F.lit(f"{base}_part"), number, F.lit(ext))).otherwise(base + ext)
    marker = F.concat(F.lit("=== PART "), number, F.lit(" of "), F.col("n_parts").cast("string"), F.lit(" ===\n"))
    return {"part_name": name, "marker": F.when(several, marker).otherwise("")}


def part_body(
    packed: Packed, piece_tokens: int = PIECE_TOKENS, tree_chunk: int = TREE_CHUNK, only: DataFrame | None = None
) -> DataFrame:
    """(repo, part, piece, body): preamble, tree and blocks of each part, or of those in
    ``only`` (repo, part).

    A part is one row unless its tree or its blocks pass the row sizes above;
    then the part is its rows in ``piece`` order.
    """
    chosen = packed.parts
    if only is not None:
        chosen = lookup_join(chosen, only.select("repo", "part").distinct(), ["repo", "part"], "left_semi")
    return _assembled(packed, chosen, piece_tokens, tree_chunk, only is None).select("repo", "part", "piece", "body")


def _assembled(
    packed: Packed, chosen: DataFrame, piece_tokens: int, tree_chunk: int, whole: bool,
    names: dict[str, Column] | None = None, front: Callable[[Column], Column] | None = None, most: int = LOOKUP_BYTES,
) -> DataFrame:
    """(repo, part, piece, body) of the parts of the files in ``chosen``, ``whole`` if these are
    all, with ``names`` of part and n_parts, if given, and the marker among them in front of each
    part. ``front`` is done to each tree row, once per repo; a tree row of its own that is empty
    then is left out.

    A tree is in all parts of its repo, so it is never shuffled with them: blocks are joined to
    rows first, then every row that opens looks its tree up. What a name needs is known per repo
    and comes with the files' places."""
    check_often(chosen.sparkSession)
    preamble = F.when(F.col("piece") == 0, packed.preamble).otherwise("")
    with staged_paths() as paths:
        tree = stage(tree_text(packed.nodes, tree_chunk).withColumn("tree", F.concat(preamble, "tree")))
        if front is not None:
            tree = stage(tree.withColumn("tree", front(F.col("tree"))))
    packed.staged.extend(paths)
    # The last tree row opens the first block row; earlier ones stand alone.
    last = tree.filter("piece = n_pieces - 1").select("repo", F.col("piece").alias("_shift"), F.col("tree").alias("_tree"))
    early = tree.filter("piece < n_pieces - 1").select("repo", "piece", F.col("tree").alias("body"))
    if front is not None:
        early = early.filter("body <> ''")
    parts = chosen.filter("first").select("repo", "part")

    known = _known_tokens(packed.counter)
    counter = _content_tokens if known else packed.counter
    shift, more = last.select("repo", "_shift"), []
    if names is not None:
        counts, more = _part_counts(packed), ["n_parts"]
        shift, early = lookup_join(shift, counts, ["repo"]), lookup_join(early, counts, ["repo"])
    places = lookup_join(chosen, shift, ["repo"]).select(
        "repo", "path", "part", "ord", *known, *more,
        (F.col("_shift") + F.floor(F.col("before") / piece_tokens)).cast("bigint").alias("piece"),
    )
    # Rows that tell by themselves that they aren't packed never meet the join; the
    # others travel as they are and are stripped and rendered behind it.
    raw = row_visible(packed.files, packed.globs).select("repo", "path", "content")
    met = raw.join(places, ["repo", "path"]) if whole else lookup_join(raw, places, ["repo", "path"], "inner")
    met = met.withColumn("_text", text(packed.strip))
    blocks = met.select(
        "repo", "part", "piece", "ord", *more,
        render(F.col("path"), F.col("_text"), packed.fmt, counter).alias("_block"),
    )
    # Every part has the row that its tree opens.
    opening = lookup_join(parts, shift, ["repo"]).select(
        "repo", "part", F.col("_shift").alias("piece"), F.lit(0).cast("bigint").alias("ord"), *more, F.lit("").alias("_block")
    )
    rows = _opened(blocks.unionByName(opening), last, more, most)
    rows = rows.unionByName(_in_every_part(parts, early, tree_chunk, most))
    if names is None:
        return rows
    rows = rows.withColumns(names)
    return rows.withColumn("body", F.when(F.col("piece") == 0, F.concat("marker", "body")).otherwise(F.col("body")))


def _opened(blocks: DataFrame, last: DataFrame, more: list[str], most: int) -> DataFrame:
    """Rows (repo, part, piece, body, and ``more``) of the blocks, joined in their order, with the
    repo's last tree row in front of the row that it opens.

    Trees of up to ``most`` bytes are broadcast. Larger ones come as a copy per salt to where the
    blocks are joined, which takes no other shuffle of these."""
    keys = ["repo", "part", "piece", *more]
    body = ordered_listagg("_block", "ord").alias("body")
    if fits_broadcast(last, most):
        met = blocks.groupBy(*keys).agg(body).join(F.broadcast(last), "repo", "left")
    else:
        partitions = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salts = max(SALTS, partitions // 16)
        salted = blocks.withColumn("_salt", F.pmod(F.xxhash64("part"), F.lit(salts)).cast("int"))
        copies = last.withColumn("_salt", one_by_one(F.sequence(F.lit(0), F.lit(salts - 1))))
        bodies = salted.repartition("repo", "_salt").groupBy("_salt", *keys).agg(body)
        met = bodies.join(copies, ["repo", "_salt"], "left")
    opens = F.col("piece") == F.col("_shift")
    return met.select(*keys, F.when(opens, F.concat("_tree", "body")).otherwise(F.col("body")).alias("body"))


def _in_every_part(parts: DataFrame, trees: DataFrame, tree_chunk: int, most: int = LOOKUP_BYTES) -> DataFrame:
    """Every row of ``trees`` (repo, piece, body, ...) for every row of ``parts`` (repo, part).

    There are parts times tree rows of these, so they come in an order in which they take
    little room when written: a tree row for a block of parts, the next one for the same
    block, and so on. A text lies beside its copies, and few texts are in one task, so column
    files hold each text once and the repeated part numbers nearly for nothing.

    Tree rows come as a copy per stretch of blocks and meet it alone, and what comes of the two
    is made row by row: a task holds one stretch and one group of tree rows."""
    columns = [c for c in trees.columns if c != "repo"]
    group = F.floor(F.col("piece") / max(1, GROUP_NODES // tree_chunk))
    groups = trees.groupBy("repo", group.alias("_group")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_rows"))
    block = F.floor(F.col("part") / PART_BLOCK)
    blocks = parts.groupBy("repo", block.alias("_block")).agg(F.sort_array(F.collect_list("part")).alias("_parts"))
    stretch = F.floor(F.col("_block") / STRETCH)
    stretches = blocks.groupBy("repo", stretch.alias("_stretch")).agg(F.sort_array(F.collect_list(F.struct("_block", "_parts"))).alias("_blocks"))
    groups, stretches = stage(groups.select("repo", "_rows")), stage(stretches)
    through = lookup_join(groups, stretches.groupBy("repo").agg(F.max("_stretch").alias("_most")), ["repo"], "inner")
    copies = through.select("repo", "_rows", one_by_one(F.sequence(F.lit(0).cast("bigint"), "_most")).alias("_stretch"))
    # An array's bytes are not measured, its rows are.
    small = fits_broadcast(parts, most)
    met = lookup_join(spread(copies) if small else copies, stretches, ["repo", "_stretch"], "inner", BROADCAST_BYTES if small else -1)
    met = met.select("repo", "_rows", one_by_one(F.col("_blocks")).alias("_block"))
    met = met.select("repo", one_by_one(F.col("_rows")).alias("_row"), F.col("_block._parts").alias("_parts"))
    met = met.select("repo", "_row", one_by_one(F.col("_parts")).alias("part"))
    return met.select("repo", "part", *[F.col(f"_row.{c}").alias(c) for c in columns])


def part_blocks(packed: Packed, front: Callable[[Column], Column], piece_tokens: int = PIECE_TOKENS) -> DataFrame:
    """The rows of ``part_body`` with ``front`` done to their trees, once per repo. Rows of a
    tree alone that are empty then are left out."""
    return _assembled(packed, packed.parts, piece_tokens, TREE_CHUNK, True, front=front).select(
        "repo", "part", "piece", "body"
    )


def named_parts(
    packed: Packed, base: str, ext: str, piece_tokens: int = PIECE_TOKENS, tree_chunk: int = TREE_CHUNK
) -> DataFrame:
    """(repo, part, part_name, piece, body): every part text under its output name,
    with the marker in front of its first piece."""
    return _assembled(packed, packed.parts, piece_tokens, tree_chunk, True, _names(base, ext)).select(
        "repo", "part", "part_name", "piece", "body"
    )


# Reports ---------------------------------------------------------------------


def secret_findings(files: DataFrame, strict: bool = False) -> DataFrame:
    """(repo, path, match_ord, rule), one row per finding and never its value."""
    labels = secret_labels(F.col("content"), F.col("path"), strict)
    return files.select("repo", "path", F.posexplode(labels).alias("_pos", "rule")).select(
        "repo", "path", (F.col("_pos") + 1).alias("match_ord"), "rule"
    )


def secret_rollup(findings: DataFrame) -> DataFrame:
    """(repo, rule, n_findings, n_files)."""
    per_file = findings.groupBy("repo", "rule", "path").agg(F.count("*").alias("_n"))
    return per_file.groupBy("repo", "rule").agg(
        F.sum("_n").alias("n_findings"), F.count("*").alias("n_files")
    )


def with_secret_flag(files: DataFrame) -> DataFrame:
    """Add ``has_secret``: the file has any finding."""
    return files.withColumn("has_secret", F.size(secret_labels(F.col("content"), F.col("path"))) > 0)


def corpus_summary(nodes: DataFrame) -> DataFrame:
    """Per repo over (is_dir, selected, size, token_count) nodes: selected files,
    all files, bytes and tokens of the selected ones."""
    chosen = F.col("selected") & ~F.col("is_dir")
    return nodes.groupBy("repo").agg(
        F.count_if(chosen).alias("selected_files"),
        F.count_if(~F.col("is_dir")).alias("all_files"),
        F.sum(F.when(chosen, F.col("size")).otherwise(0)).alias("selected_bytes"),
        F.sum(F.when(chosen, F.col("token_count")).otherwise(0)).alias("selected_tokens"),
    )


def context_fit(summary: DataFrame, limit: int = CONTEXT_TOKENS) -> DataFrame:
    """Add ``fit``: share of the context window used, at most 1."""
    return summary.withColumn(
        "fit", F.least(F.lit(1.0), F.col("selected_tokens") / F.lit(float(limit)))
    )


def strip_savings(files: DataFrame) -> DataFrame:
    """Per repo: bytes and tokens before and after stripping, saved percent."""
    sized = files.select(
        "repo",
        F.octet_length("content").cast("bigint").alias("b0"),
        F.octet_length(text(True)).cast("bigint").alias("b1"),
    )
    saved = (F.col("tokens_before") - F.col("tokens_after")) * 100.0 / F.col("tokens_before")
    return sized.groupBy("repo").agg(
        F.sum("b0").alias("bytes_before"),
        F.sum("b1").alias("bytes_after"),
        F.sum(F.shiftright("b0", 2)).alias("tokens_before"),
        F.sum(F.shiftright("b1", 2)).alias("tokens_after"),
    ).withColumn("saved_pct", F.when(F.col("tokens_before") > 0, F.round(saved, 4)).otherwise(0.0))


def token_nodes(
    files: DataFrame, strip: bool = True, selection: DataFrame | None = None,
    counter: Counter | PieceCounter = token_estimate,
) -> DataFrame:
    """Nodes with ``selected`` and ``token_count``, ready for the summaries."""
    if isinstance(counter, PieceCounter):
        nodes = stage(walk(files))
        texts = stage(_kept_texts(files, nodes, strip, ()))
        counts = count_texts(texts, ["repo", "path"], F.col("_text"), counter, "token_count")
        return selected(nodes.join(counts, ["repo", "path"], "left"), selection)
    facts = {"token_count": counter(F.col("_text"))}
    return selected(walk(files, text=text(strip), facts=facts), selection)
