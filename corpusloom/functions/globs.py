"""Glob patterns as Java regexes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.constants import DEFAULT_IGNORED
from corpusloom.functions.text import lines

_END = r"(?:/|\z)"


class _Malformed(Exception):
    pass


def _set_char(glob: str, i: int) -> tuple[str, int]:
    """One character inside [...]; something has to follow it."""
    if i >= len(glob) or glob[i] in "-]":
        raise _Malformed
    if glob[i] == "\\":
        i += 1
    if i + 1 >= len(glob):
        raise _Malformed
    return glob[i], i + 1


def glob_regex(glob: str, within_segment: bool) -> str | None:
    """Regex for a shell glob whose ``*`` and ``?`` stop at '/'; None if it is
    malformed. ``within_segment`` lets nothing match '/'."""
    out, i = [], 0
    try:
        while i < len(glob):
            c = glob[i]
            i += 1
            if c == "*":
                out.append("[^/]*")
            elif c == "?":
                out.append("[^/]")
            elif c == "\\":
                if i >= len(glob):
                    raise _Malformed
                out.append(re.escape(glob[i]))
                i += 1
            elif c == "[":
                negated = glob[i : i + 1] == "^"
                i += negated
                ranges = []
                while not ranges or glob[i : i + 1] != "]":
                    low, i = _set_char(glob, i)
                    high = low
                    if glob[i] == "-":
                        high, i = _set_char(glob, i + 1)
                    ranges.append((low, high))
                i += 1
                members = "".join(
                    rf"\x{{{ord(low):x}}}-\x{{{ord(high):x}}}" for low, high in ranges if low <= high
                )
                if not members:
                    one = "(?s:.)" if negated else "(?!)"
                else:
                    one = f"[{'^' if negated else ''}{members}]"
                out.append(("(?!/)" if within_segment else "") + one)
            elif c == "/" and within_segment:
                out.append("(?!)")
            else:
                out.append(re.escape(c))
    except _Malformed:
        return None
    return "".join(out)


def custom_regex(globs: list[str]) -> str | None:
    """Found in a path if a glob matches it, a directory above it or one segment."""
    names, paths = [], []
    for glob in (g.strip() for g in globs):
        if glob and glob_regex(glob, True) is not None:
            names.append(glob_regex(glob, True))
            paths.append(glob_regex(glob, False))
    if not names:
        return None
    return rf"(?:\A|/)(?:{'|'.join(names)}){_END}|\A(?:{'|'.join(paths)}){_END}"


def custom_ignore(path: Column, globs: list[str]) -> Column:
    """True if a glob matches the path, a directory above it or one segment."""
    regex = custom_regex(globs)
    return path.rlike(regex) if regex else F.lit(False)


_DEFAULT = rf"(?:\A|/)(?:{'|'.join(re.escape(n) for n in DEFAULT_IGNORED)}){_END}"


def default_ignore(path: Column) -> Column:
    return path.rlike(_DEFAULT)


def hidden_in_python(globs: list[str]) -> str:
    """Both of the above for ``re.search``, which writes two things in another way."""
    java = "|".join(f"(?:{r})" for r in (custom_regex(globs), _DEFAULT) if r)

    def other(m: re.Match) -> str:
        if m[1]:
            return rf"\U{int(m[1], 16):08x}"
        return r"\Z" if m[2] == "z" else m[0]

    return re.sub(r"(?s)\\(?:x\{([0-9a-f]+)\}|(.))", other, java)


# Pieces of an ignore-file pattern: word, escape, set, three '**' forms, wildcards.
_PIECES = (
    r"\w+|\\.|\[[!^]?\]?(?:\\.|\[:[a-z]+:\]|[^\]\\])*\]|/\*\*/|\A\*\*/|/\*\*\z|\*+|\?|(?s:.)"
)


# Named sets, as in [[:digit:]].
_NAMED = {
    "alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower",
    "punct": "Punct", "space": "Space", "blank": "Blank", "graph": "Graph", "print": "Print",
    "cntrl": "Cntrl", "xdigit": "XDigit",
}
_MEMBERS = r"\[:[a-z]+:\]|(?s:\\.|.)-(?s:\\.|.)|(?s:\\.|.)"


def _code(member: Column) -> Column:
    """Code point of a character that may be escaped."""
    return F.ascii(F.regexp_replace(member, r"(?s)\A\\(?=.)", ""))


def _set_regex(piece: Column) -> Column:
    """A set in brackets, whatever is in it: members are given by code point, and
    a reversed range or an unknown name has none."""
    negated = piece.rlike(r"\A\[[!^]")
    inside = F.regexp_replace(piece, r"\A\[[!^]?|\]\z", "")
    names = F.create_map(*[F.lit(x) for pair in _NAMED.items() for x in pair])

    def point(code: Column) -> Column:
        return F.concat(F.lit(r"\x{"), F.hex(code), F.lit("}"))

    def member(m: Column) -> Column:
        low = F.regexp_extract(m, r"(?s)\A(\\.|.)", 1)
        high = F.regexp_extract(m, r"(?s)(\\.|.)\z", 1)
        ranged = m.rlike(r"(?s)\A(?:\\.|.)-(?:\\.|.)\z")
        return (
            F.when(
                m.rlike(r"\A\[:[a-z]+:\]\z"),
                F.concat(F.lit(r"\p{"), names[F.regexp_extract(m, "[a-z]+", 0)], F.lit("}")),
            )
            .when(ranged & (_code(low) <= _code(high)), F.concat(point(_code(low)), F.lit("-"), point(_code(high))))
            .when(~ranged, point(_code(m)))
        )

    members = F.array_join(
        F.transform(F.regexp_extract_all(inside, F.lit(_MEMBERS), F.lit(0)), member), ""
    )
    return F.when(
        members != "",
        F.concat(F.lit("(?!/)["), F.when(negated, "^").otherwise(""), members, F.lit("]")),
    ).otherwise(F.when(negated, "[^/]").otherwise("(?!)"))


def _piece_regex(piece: Column) -> Column:
    return (
        F.when(piece.rlike(r"\A\w"), piece)
        .when(piece == "/**/", "/(?:.*/)?")
        .when(piece == "**/", "(?:.*/)?")
        .when(piece == "/**", "/.+")
        .when(piece.startswith("*"), "[^/]*")
        .when(piece == "?", "[^/]")
        # An unclosed set or a lone backslash at the end spoils the pattern.
        .when(piece.isin("[", "\\"), "(?!)")
        .when(piece.startswith("["), _set_regex(piece))
        .otherwise(F.concat(F.lit(r"\Q"), F.regexp_replace(piece, r"(?s)\A\\(?=.)", ""), F.lit(r"\E")))
    )


def ignore_file_rules(content: Column) -> Column:
    """An ignore file as (rules, exceptions), both regexes; null if it hides nothing.

    ``rules`` is searched for in a whole path, which ends in '/' for a directory: it finds
    a rule that hides the path or a directory above it. Rules are put together by where
    they may begin (at the root or at any segment) and end (at a directory or anywhere), so
    the search goes once along the path however many rules there are.

    ``exceptions`` is null unless a rule is negated, as most files' are. Only paths that
    ``rules`` finds need it then: it is tried on a directory as ``a/b/`` and on a file as
    ``a/b``, and a later rule goes before all earlier ones: ``!rule`` becomes a negative
    look-ahead in front of them, any other rule one more alternative.
    """
    text = F.transform(
        lines(content), lambda line: F.regexp_replace(line, r"(?<!\\) +\z", "")
    )
    listed = F.filter(text, lambda line: (line != "") & ~line.startswith("#"))

    def rule(line: Column) -> Column:
        negated = line.startswith("!")
        bare = F.when(negated, F.substr(line, F.lit(2))).otherwise(line)
        dir_only = bare.endswith("/")
        bare = F.when(dir_only, F.regexp_replace(bare, r"/\z", "")).otherwise(bare)
        pieces = F.regexp_extract_all(
            F.regexp_replace(bare, r"\A/", ""), F.lit(_PIECES), F.lit(0)
        )
        return F.struct(
            negated.alias("negated"),
            bare.contains("/").alias("anchored"),
            dir_only.alias("dir_only"),
            F.array_join(F.transform(pieces, _piece_regex), "").alias("body"),
        )

    return F.transform(F.array(F.transform(listed, rule)), _both_regexes)[0]


def _both_regexes(rules: Column) -> Column:
    hiding = F.filter(rules, lambda r: ~r["negated"])
    # A wildcard must not stand for nothing before the final '/'.
    begins = {True: r"\A", False: r"(?:\A|/)"}
    ends = {True: r"(?<!/)/", False: r"(?<!/)(?:/|\z)"}

    def group(anchored: bool, dir_only: bool) -> Column:
        own = F.filter(hiding, lambda r: (r["anchored"] == anchored) & (r["dir_only"] == dir_only))
        bodies = F.array_join(F.transform(own, lambda r: r["body"]), "|")
        whole = F.concat(F.lit(f"{begins[anchored]}(?:"), bodies, F.lit(f"){ends[dir_only]}"))
        return F.when(F.size(own) > 0, whole)

    found = F.concat(F.lit("(?s)"), F.concat_ws("|", *[group(a, d) for a in begins for d in ends]))
    return F.when(
        F.size(hiding) > 0,
        F.struct(
            found.alias("rules"),
            F.when(F.size(hiding) < F.size(rules), _last_rule_wins(rules)).alias("exceptions"),
        ),
    )


def _last_rule_wins(rules: Column) -> Column:
    def whole(r: Column) -> Column:
        return F.concat(
            F.when(r["anchored"], "").otherwise("(?:.*/)?"),
            r["body"],
            F.when(r["dir_only"], r"(?<!/)/\z").otherwise(r"(?<!/)/?\z"),
        )

    def add(acc: Column, r: Column) -> Column:
        barred = F.concat(F.lit("(?!"), whole(r), F.lit(")"))
        return F.when(
            r["negated"],
            F.struct(
                F.when(acc["open"], F.concat(barred, F.lit("(?:"), acc["regex"], F.lit(")")))
                .otherwise(F.concat(barred, acc["regex"]))
                .alias("regex"),
                F.lit(False).alias("open"),
            ),
        ).otherwise(
            F.struct(
                F.concat(whole(r), F.lit("|"), acc["regex"]).alias("regex"),
                F.lit(True).alias("open"),
            )
        )

    return F.aggregate(
        rules,
        F.struct(F.lit("(?!)").alias("regex"), F.lit(False).alias("open")),
        add,
        lambda acc: F.concat(F.lit(r"(?s)\A(?:"), acc["regex"], F.lit(")")),
    )


def ignored_by(rules: Column, exceptions: Column, path: Column, is_dir: Column) -> Column:
    """True if ``path`` or a directory above it is hidden by an ignore file. The search
    keeps the last regex it compiled, so rows of a repo should follow one another."""
    seg = F.split(path, "/")
    candidates = F.transform(
        seg,
        lambda _, i: F.concat(
            F.array_join(F.slice(seg, F.lit(1), i + 1), "/"),
            F.when(is_dir | (i + 1 < F.size(seg)), "/").otherwise(""),
        ),
    )
    found = F.regexp_instr(F.concat(path, F.when(is_dir, "/").otherwise("")), rules) > 0
    kept = exceptions.isNull() | F.exists(candidates, lambda c: F.regexp_instr(c, exceptions) > 0)
    return F.coalesce(found & kept, F.lit(False))
