"""Markers of one source text in plain Python, for single files and SQL table functions; ``operators.lines`` is the form for tables."""

from __future__ import annotations

import re

_COMMENTS = {"Default": ("//", "/*", "*/"), "Python": ("#",), "Ada": ("--",), "Fortran": ("!",), "Lua": ("--", "--[[", "]]")}
#: White space (the Unicode property) for a character class of either regular-expression dialect.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = "".join(chr(c) for c in range(0x3001) if re.match(f"[{WHITE}]", chr(c)))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = re.compile(f'(?:"[^"]*"?|[^{WHITE}"])+')


def ascii_lower(s: str) -> str:
    return s.translate(str.maketrans(UPPER, LOWER))


def comment_text(line: str, mode: str) -> str | None:
    """The inside of a line that is one whole comment."""
    t = line.strip(_SPACES)
    prefix, *block = _COMMENTS[mode]
    if t.startswith(prefix):
        return t[len(prefix) :].strip(_SPACES)
    if block and t.startswith(block[0]) and t.endswith(block[1]) and len(t) >= len(block[0]) + len(block[1]):
        return t[len(block[0]) : len(t) - len(block[1])].strip(_SPACES)
    return None


def _lines(source: str) -> list[str]:
    out = source.split("\n")
    return out[:-1] if out and out[-1] == "" else out


def regions(source: str, mode: str) -> list[tuple[int, int, int, int, list[str] | None]]:
    """(byte_start, byte_end, line_start, line_end, tools)."""
    out, start, at, rows = [], None, 0, _lines(source)
    for k, line in enumerate(rows, 1):
        end = at + len(line.encode())
        m = comment_text(line, mode)
        tools = [t for t in (x.strip(_SPACES) for x in m[10:].split(",")) if t] if m is not None and m.startswith("tools:off ") else None
        if start is None and (m == "tools:off" or tools):
            start = (at, k, tools)
        elif start is not None and m == "tools:on":
            out.append((start[0], end, start[1], k, start[2]))
            start = None
        at = end + 1
    if start is not None:
        out.append((start[0], len(source.encode()), start[1], len(rows), start[2]))
    return out


def suppressions(source: str, mode: str) -> list[tuple[int, int | None, str, str, str | None, str | None]]:
    """(comment_line, target_line, tool, rule, hash, justification)."""
    out, rows = [], [r.removesuffix("\r") for r in _lines(source)]
    for k, line in enumerate(rows, 1):
        m = comment_text(line, mode)
        if m is None or not m.startswith("tools:suppress "):
            continue
        tokens = _TOKEN.findall(m[15:])
        tool, _, rule = tokens[0].partition(":") if tokens else ("", "", "")
        if not tool or not rule:
            continue
        given = {"HASH:": None, "JUSTIFICATION:": None}
        for t in tokens[1:]:
            for p in given:
                if t.startswith(p):
                    given[p] = t[len(p) :]
        why = given["JUSTIFICATION:"]
        target = next((j for j in range(k + 1, len(rows) + 1) if rows[j - 1].strip(_SPACES)), None)
        out.append((k, target, tool, rule, given["HASH:"], None if why is None else why.strip('"')))
    return out
