"""Stateless steps for Structured Streaming.

Ordering and packing need all files of a repo, so they stay batch jobs; what can
be said about one row alone is the same expression on a stream. ``unpack`` works on a
stream as it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.globs import custom_ignore, default_ignore
from corpusloom.functions.paths import binary_reason
from corpusloom.functions.render import render
from corpusloom.functions.secrets import secret_labels
from corpusloom.functions.strip import strip_comments
from corpusloom.functions.text import token_estimate


def stream_blocks(
    files: DataFrame, fmt: str = "markdown", strip: bool = True, globs: Sequence[str] = ()
) -> DataFrame:
    """(repo, path, block, tokens, findings) of each file that is not ignored by
    name or binary."""
    path, content = F.col("path"), F.col("content")
    hidden = custom_ignore(path, list(globs)) | default_ignore(path)
    kept = files.filter(~hidden & binary_reason(path, content).isNull())
    text = strip_comments(content, path) if strip else content
    return (
        kept.withColumn("_text", text)
        .withColumn("block", render(path, F.col("_text"), fmt))
        .select(
            "repo",
            "path",
            "block",
            token_estimate(F.col("block")).alias("tokens"),
            secret_labels(content, path).alias("findings"),
        )
    )
