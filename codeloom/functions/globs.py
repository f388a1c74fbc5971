"""Sets of glob patterns as one regular expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches nothing.
NOTHING = r"(?!)"


def _class(pattern: str, i: int) -> tuple[str, int]:
    end = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] in ("!", "]") else i + 1)
    if pattern[i + 1 : i + 3] == "!]":
        end = pattern.find("]", i + 3)
    if end < 0:
        raise ValueError(f"invalid glob {pattern!r}: '[' is never closed")
    body = pattern[i + 1 : end]
    negate = body.startswith("!")
    body = body[negate:]
    if not body:
        raise ValueError(f"invalid glob {pattern!r}: empty character class")
    for a, b in re.findall(r"(.)-(.)", body):
        if a > b:
            raise ValueError(f"invalid glob {pattern!r}: range {a}-{b} is the wrong way round")
    return "[" + ("^" if negate else "") + re.sub(r"([\\\[\]^&~])", r"\\\1", body) + "]", end + 1


def glob_to_regex(pattern: str) -> str:
    """One glob as an anchored expression. ``?`` and ``*`` match ``/``; ``**/``, ``/**/`` and ``/**`` span directories."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            while pattern.startswith("**/", i):
                i += 3
        elif pattern.startswith("**", i) and i + 2 == len(pattern) and i and pattern[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif c == "*":
            while pattern[i : i + 1] == "*":
                i += 1
            out += ".*"
        elif c == "?":
            out, i = out + ".", i + 1
        elif c == "[":
            part, i = _class(pattern, i)
            out += part
        elif c == "{":
            out, i, depth = out + "(?:", i + 1, depth + 1
        elif c == "}":
            if not depth:
                raise ValueError(f"invalid glob {pattern!r}: '}}' was never opened")
            out, i, depth = out + ")", i + 1, depth - 1
        elif c == "," and depth:
            out, i = out + "|", i + 1
        elif c == "\\":
            if i + 1 == len(pattern):
                raise ValueError(f"invalid glob {pattern!r}: nothing after the last backslash")
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    if depth:
        raise ValueError(f"invalid glob {pattern!r}: '{{' is never closed")
    return out


def compile_globs(patterns: list[str]) -> str:
    """A set of globs; raises ValueError for an invalid one. No pattern matches nothing."""
    return r"(?s)^(?:" + "|".join(glob_to_regex(p) for p in patterns) + r")\z" if patterns else NOTHING


def is_ignored(path: Column, patterns: list[str]) -> Column:
    """Does any pattern match the whole path."""
    return path.rlike(compile_globs(patterns)) if patterns else F.lit(False)
