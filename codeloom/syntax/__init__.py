"""Parsers for the registry's grammars, and the node table's encoding."""

from __future__ import annotations

import sys

from codeloom.syntax.blocks import parse_blocks
from codeloom.syntax.brace import parse_braces
from codeloom.syntax.tree import FIELDS, Node, flatten

GRAMMARS = frozenset("c cpp rust python javascript typescript tsx ada go java csharp kotlin swift php fortran scala lua".split())


def parse(grammar: str, source: str) -> Node:
    """A syntax tree; errors are nodes in it. An unknown grammar raises ValueError."""
    if grammar not in GRAMMARS:
        raise ValueError(f"unknown language key: {grammar}")
    limit = sys.getrecursionlimit()
    # frames of Python functions live on the heap: nesting is bounded by memory alone
    sys.setrecursionlimit(max(limit, 20 * len(source) + 10_000))
    try:
        return (parse_blocks if grammar in ("python", "lua", "ada", "fortran") else parse_braces)(source, grammar)
    finally:
        sys.setrecursionlimit(limit)


__all__ = ["FIELDS", "GRAMMARS", "Node", "flatten", "parse"]
