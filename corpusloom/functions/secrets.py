"""Secret search. Only rule labels leave these functions, never a matched value."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.constants import ENV_LABEL, SECRET_GATE, SECRET_RULES

# The letters a match can begin with; the look-ahead passes over all other places.
_FIRST = r"(?=[saApdcthSPDCT\u017f][kKeEaArRbBoOpPwWtT3GIS\u212a])"
_ANY_RULE = _FIRST + "(?:" + "|".join(f"(?:{pattern})" for _, pattern in SECRET_RULES) + ")"


def passes_gate(content: Column) -> Column:
    return reduce(or_, [content.contains(word) for word in SECRET_GATE])


def is_env_path(path: Column) -> Column:
    return F.lower(path).contains(".env")


def _label(match: Column) -> Column:
    # The patterns look at nothing outside the match, so the first rule that
    # covers the whole match is the one that found it.
    first, *others = SECRET_RULES
    result = F.when(match.rlike(rf"\A(?:{first[1]})\z"), first[0])
    for label, pattern in others:
        result = result.when(match.rlike(rf"\A(?:{pattern})\z"), label)
    return result


def secret_labels(content: Column, path: Column, strict: bool = False) -> Column:
    """Array of labels in text order, the environment-file label first.
    ``strict`` searches also texts without any of the gate words."""
    none = F.array().cast("array<string>")
    found = F.transform(F.regexp_extract_all(content, F.lit(_ANY_RULE), F.lit(0)), _label)
    if not strict:
        found = F.when(passes_gate(content), found).otherwise(none)
    env = F.when(is_env_path(path), F.array(F.lit(ENV_LABEL))).otherwise(none)
    return F.concat(env, found)
