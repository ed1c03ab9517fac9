"""Path pieces, order keys and the safety check for written paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.constants import BINARY_EXTENSIONS, LANGUAGE_LABELS


def relative_path(path: Column, root: Column | None = None, windows: bool = False) -> Column:
    """Path below ``root`` with forward slashes."""
    if windows:
        path = F.translate(path, "\\", "/")
    if root is None:
        return path
    if windows:
        root = F.translate(root, "\\", "/")
    return F.when(
        F.startswith(path, F.concat(root, F.lit("/"))),
        F.substr(path, F.length(root) + F.lit(2)),
    ).otherwise(path)


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def extension(path: Column) -> Column:
    """From the last dot of the last segment, lower-cased; '' without a dot."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))


def language(path: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in LANGUAGE_LABELS.items() for x in pair])
    return F.coalesce(labels[extension(path)], F.lit(""))


def binary_reason(path: Column, content: Column) -> Column:
    """'extension', 'nul' or null for text. ``content`` may be string or binary."""
    # 512 characters hold at least the first 512 bytes; the whole is not copied.
    head = F.substring(F.substring(content, 1, 512).cast("binary"), 1, 512)
    return F.when(extension(path).isin(BINARY_EXTENSIONS), "extension").when(
        F.contains(head, F.lit(b"\x00")), "nul"
    )


def strict_ancestors(path: Column) -> Column:
    """Directories above ``path``, outermost first; empty for a root entry."""
    seg = F.split(path, "/")
    return F.transform(
        F.slice(seg, F.lit(1), F.size(seg) - 1),
        lambda _, i: F.array_join(F.slice(seg, F.lit(1), i + 1), "/"),
    )


def self_and_ancestors(path: Column) -> Column:
    return F.array_append(strict_ancestors(path), path)


def _low_escaped(path: Column) -> Column:
    """The two lowest code points are escaped in an order-keeping way."""
    return F.when(
        path.rlike("[\\x00\\x01]"),
        F.replace(
            F.replace(path, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01")
        ),
    ).otherwise(path)


def span_key(path: Column) -> Column:
    """String whose byte order keeps a subtree together: a path comes first, then all that
    is below it, between the key followed by U+0000 and the key followed by U+0001."""
    return F.replace(_low_escaped(path), F.lit("/"), F.lit("\x00"))


def span_end(path: Column) -> Column:
    """Above the keys of all that is below ``path``, below every key that follows them."""
    return F.concat(span_key(path), F.lit("\x01"))


def sort_key(path: Column, is_dir: Column) -> Column:
    """String whose byte order is the tree order: level by level, directories
    before files, then by name. U+0000 ends a level, so a prefix comes first;
    the two lowest code points are escaped in an order-keeping way."""
    safe = _low_escaped(path)
    dirs = F.concat(F.lit("0"), F.replace(safe, F.lit("/"), F.lit("\x000")))
    leaf = name(safe)
    above = F.substr(safe, F.lit(1), F.length(safe) - F.length(leaf) - 1)
    file_key = F.when(F.contains(safe, F.lit("/")), F.concat(
        F.lit("0"), F.replace(above, F.lit("/"), F.lit("\x000")), F.lit("\x001"), leaf
    )).otherwise(F.concat(F.lit("1"), leaf))
    return F.when(is_dir, dirs).otherwise(file_key)


def clean_path(path: Column) -> Column:
    """Lexical clean-up: '.' and empty segments go, '..' takes the segment before it."""
    rooted = F.startswith(path, F.lit("/"))

    def step(stack: Column, seg: Column) -> Column:
        pop = (F.size(stack) > 0) & (F.coalesce(F.get(stack, F.size(stack) - 1), F.lit("")) != "..")
        return (
            F.when(seg.isin("", "."), stack)
            .when(
                seg == "..",
                F.when(pop, F.slice(stack, F.lit(1), F.size(stack) - 1))
                .when(rooted, stack)
                .otherwise(F.array_append(stack, seg)),
            )
            .otherwise(F.array_append(stack, seg))
        )

    body = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        step,
        lambda stack: F.array_join(stack, "/"),
    )
    return (
        F.when(rooted, F.concat(F.lit("/"), body)).when(body == "", ".").otherwise(body)
    )


def path_status(path: Column) -> Column:
    """'ok', 'traversal' (leaves the workspace) or 'directory' (names no file)."""
    clean = clean_path(path)
    return (
        F.when(F.startswith(clean, F.lit("..")) | F.startswith(clean, F.lit("/")), "traversal")
        .when(clean == ".", "directory")
        .otherwise("ok")
    )
