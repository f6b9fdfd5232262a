"""Wildcards and globs as regular expressions."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def wildcard_regex(pattern: str) -> str:
    """A whole-text regex of a wildcard, in which only `*` is special and also crosses `/`."""
    return "(?s)^" + ".*".join(re.escape(p).replace(r"\-", "-").replace("\\/", "/") for p in pattern.split("*")) + "$"


def glob_regex(pattern: str) -> str:
    """A whole-text regex of a file glob: `*` and `?` stop at `/`, `[...]` and `[^...]` are classes, `\\` quotes; there is no `**`."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out.append("[" + ("^/" if body[:1] in "^!" else "") + body.lstrip("^!").replace("[", "\\[").replace("&", "\\&") + "]")
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def wildcard_match(column: Column, pattern: str) -> Column:
    """Null for null texts."""
    return column == pattern if "*" not in pattern else column.rlike(wildcard_regex(pattern))


def glob_match(column: Column, pattern: str) -> Column:
    return column.rlike(glob_regex(pattern))


def glob_regex_of(column: Column) -> Column:
    """`glob_regex` of a column of globs, of which there are few different ones."""
    return F.pandas_udf(lambda globs: globs.map(lru_cache(glob_regex), na_action="ignore"), "string")(column)
