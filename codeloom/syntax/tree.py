"""Syntax trees and their interval encoding."""

from __future__ import annotations


class Node:
    __slots__ = ("kind", "named", "field", "start", "end", "children", "error")

    def __init__(self, kind, start=0, end=0, named=True, field=None, children=None, error=False):
        self.kind, self.start, self.end, self.named, self.field, self.children, self.error = kind, start, end, named, field, children if children is not None else [], error

    def get(self, field):
        return next((c for c in self.children if c.field == field), None)

    def child(self, *kinds):
        return next((c for c in self.children if c.kind in kinds), None)


def close(node: Node, at: int) -> Node:
    """Span from children; a node without any is empty at ``at``."""
    if node.children:
        node.start, node.end = node.children[0].start, node.children[-1].end
    else:
        node.start = node.end = at
    return node


FIELDS = "node_id parent_id last_desc depth child_index child_count named_index kind is_named field start_byte end_byte start_row end_row text has_error".split()
#: Kinds whose text is kept besides that of leaves.
_TEXT = frozenset(
    """scoped_identifier attribute member_expression selector_expression member_access_expression qualified_identifier field_expression navigation_expression
    scoped_use_list use_list use_as_clause use_wildcard dotted_name relative_import string interpreted_string_literal raw_string_literal string_literal system_lib_string
    qualified_name name identifier type_identifier generic_type primitive_type scoped_type_identifier pointer_type reference_type array_type return_type type
    qualified_identifier alignof_expression selected_component dot_index_expression method_index_expression parameter_list type_annotation nullable_type
    template_type struct_specifier predefined_type integral_type floating_point_type boolean_type void_type sized_type_specifier encapsed_string user_type""".split()
)


def flatten(root: Node, source: str) -> list[tuple]:
    """Rows in pre-order, in the order of FIELDS; offsets in UTF-8 bytes, rows from 0. No recursion."""
    data = source
    if source.isascii():
        byte = None
    else:
        byte, at = [0] * (len(source) + 1), 0
        for i, c in enumerate(source):
            byte[i] = at
            at += 1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4
        byte[len(source)] = at
    breaks = [i for i, c in enumerate(source) if c == "\n"]
    from bisect import bisect_left

    rows: list[list] = []
    stack = [(root, None, 0, 0, None)]
    while stack:
        node, parent, depth, index, named_index = stack.pop()
        if node is None:  # the subtree of row ``parent`` is complete
            rows[parent][2] = len(rows) - 1
            if rows[parent][15] and rows[parent][1] is not None:
                rows[rows[parent][1]][15] = True
            continue
        i = len(rows)
        text = data[node.start : node.end] if not node.children or node.kind in _TEXT else None
        rows.append([i, parent, i, depth, index, len(node.children), named_index, node.kind, node.named, node.field, byte[node.start] if byte else node.start, byte[node.end] if byte else node.end, bisect_left(breaks, node.start), bisect_left(breaks, node.end), text, node.error])
        stack.append((None, i, 0, 0, None))
        named = [None] * len(node.children)
        k = 0
        for j, c in enumerate(node.children):
            if c.named:
                named[j] = k
                k += 1
        for j in range(len(node.children) - 1, -1, -1):
            stack.append((node.children[j], i, depth + 1, j, named[j]))
    return [tuple(r) for r in rows]
