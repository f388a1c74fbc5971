"""What one parsed file says: imports, calls, control flow, fingerprints, standard markers. No recursion over trees."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from codeloom.syntax.tree import Node

FUNCTION_KINDS = frozenset(
    """
    arrow_function constructor_declaration expression_function_declaration func_literal function function_declaration function_definition
    function_expression function_item generator_function generator_function_declaration init_declaration local_function_statement method_declaration
    method_definition module_procedure program subprogram_body subroutine task_body
    """.split()
)
C_KEYWORDS = frozenset("break case continue default do else enum for goto if return sizeof struct switch typedef union while".split())
CPP_ONLY = frozenset(
    """
    access_specifier base_class_clause catch_clause class_specifier concept_definition delete_expression destructor_name field_initializer_list
    friend_declaration lambda_expression namespace_alias_definition namespace_definition new_expression noexcept operator_cast operator_name
    qualified_identifier reference_declarator requires_clause template_declaration template_instantiation throw_statement try_statement
    using_declaration
    """.split()
)
STANDARDS = ("C99", "C11", "C23")


class Tree:
    """A parsed file with parents and subtree errors at hand."""

    def __init__(self, root: Node, source: str, grammar: str):
        self.root, self.source, self.grammar = root, source, grammar
        self.order: list[Node] = []
        self.parent: dict[int, Node | None] = {id(root): None}
        stack = [root]
        while stack:
            n = stack.pop()
            self.order.append(n)
            for c in reversed(n.children):
                self.parent[id(c)] = n
                stack.append(c)
        self.broken: set[int] = set()
        for n in reversed(self.order):
            if n.error or any(id(c) in self.broken for c in n.children):
                self.broken.add(id(n))

    def text(self, n: Node) -> str:
        return self.source[n.start : n.end]

    def inside(self, top: Node, prune: Callable[[Node], bool] | None = None) -> Iterator[Node]:
        """Pre-order, ``top`` first; below a node that ``prune`` picks nothing is visited, nor itself."""
        stack = [top]
        while stack:
            n = stack.pop()
            if prune is not None and n is not top and prune(n):
                continue
            yield n
            stack.extend(reversed(n.children))

    # ---- names

    def is_macro_like(self, n: Node) -> bool:
        """A macro call that reads like a function's head."""
        d = n.get("declarator")
        return n.kind == "function_definition" and d is not None and d.kind == "parenthesized_declarator"

    def function_name(self, n: Node) -> str | None:
        kind = n.kind
        if kind == "init_declaration":
            return "init"
        if kind == "func_literal":
            return None
        named = n.get("name")
        if kind == "arrow_function":
            return self._bound_name(n)
        if kind == "function_expression":
            return self.text(named) if named else self._bound_name(n)
        if kind == "function_definition":
            if named:
                return self.text(named)
            return self._declared_name(n) or self._lua_name(n)
        if kind == "function_declaration" and not named:
            named = n.child("simple_identifier")
        if kind in ("subprogram_body", "expression_function_declaration"):
            spec = n.child("function_specification", "procedure_specification")
            named = spec.get("name") if spec else None
        elif kind == "task_body":
            named = n.child("identifier")
        elif kind in ("function", "subroutine", "module_procedure"):
            head = n.child(kind + "_statement")
            named = head.get("name") if head else None
        elif kind == "program":
            head = n.child("program_statement")
            if head is None:
                return None
            named = next((c for c in head.children if c.named), None)
            return self.text(named) if named else "program"
        return self.text(named) if named else None

    def _declared_name(self, n: Node) -> str | None:
        """C: the function declarator under any pointers, then its own name."""
        found = None
        level = list(n.children)
        while level and found is None:
            c = level.pop(0)
            if c.kind == "function_declarator":
                found = c
            elif c.kind == "pointer_declarator":
                level = list(c.children) + level
        level = list(found.children) if found else []
        while level:
            c = level.pop(0)
            if c.kind in ("identifier", "qualified_identifier", "destructor_name", "operator_name", "field_identifier"):
                return self.text(c)
            if c.kind in ("pointer_declarator", "function_declarator"):
                level = list(c.children) + level
        return None

    def _lua_name(self, n: Node) -> str | None:
        up = self.parent[id(n)]
        if up is None:
            return None
        if up.kind == "field":
            first = next((c for c in up.children if c.named), None)
            return self.text(first) if first is not None and first.kind == "identifier" else None
        above = self.parent[id(up)]
        if up.kind == "expression_list" and above is not None and above.kind == "assignment_statement":
            targets = above.child("variable_list")
            at = [c for c in up.children if c.named].index(n)
            left = [c for c in targets.children if c.named] if targets else []
            if at < len(left) and left[at].kind == "identifier":
                return self.text(left[at])
        return None

    def _bound_name(self, n: Node) -> str | None:
        """JavaScript: what the function is assigned to."""
        up = self.parent[id(n)]
        field = {"variable_declarator": "name", "pair": "key", "public_field_definition": "name"}.get(up.kind if up else "")
        named = up.get(field) if field else None
        return self.text(named) if named else None

    def functions(self) -> list[tuple[Node, str | None]]:
        return [(n, self.function_name(n)) for n in self.order if n.kind in FUNCTION_KINDS]

    def local_names(self) -> set[str]:
        out = {name for _, name in self.functions() if name is not None}
        for n in self.order:
            if n.kind in ("preproc_def", "preproc_function_def") and (m := n.get("name")):
                out.add(self.text(m))
        return out

    # ---- calls

    def _callee(self, call: Node, alias: dict[str, str]) -> str | None:
        kind = call.kind
        if kind in ("call_expression", "call", "invocation_expression"):
            f = call.get("function")
            if f is None:
                if kind != "call_expression":
                    return None
                first = next((c for c in call.children if c.named and c.kind not in ("value_arguments", "type_arguments", "annotated_lambda", "call_suffix")), None)
                return self.text(first) if first else None
            if f.kind == "identifier":
                return alias.get(self.text(f), self.text(f))
            if f.kind in ("scoped_identifier", "attribute", "member_expression", "selector_expression", "member_access_expression"):
                return self.text(f)
            if f.kind == "field_expression":
                m = f.get("field")
                return self.text(m) if m else None
            return None
        field = {"procedure_call_statement": "name", "function_call": "name", "method_invocation": "name", "object_creation_expression": "type"}.get(kind)
        m = call.get(field) if field else None
        return self.text(m) if m else None

    def _aliases(self, function: Node) -> dict[str, str]:
        """Function pointers: variable -> function, the last write in reading order wins."""
        out: dict[str, str] = {}
        for n in self.inside(function):
            if n.kind == "declaration":
                for d in n.children:
                    shape = d.get("declarator") if d.kind == "init_declarator" else None
                    kinds = {x.kind for x in self.inside(shape)} if shape else set()
                    if {"function_declarator", "pointer_declarator"} <= kinds:
                        name, value = self._innermost(shape), d.get("value")
                        target = self._target(value) if value else None
                        if name and target:
                            out[name] = target
            elif n.kind == "assignment_expression":
                left, right = n.get("left"), n.get("right")
                if left is not None and right is not None and left.kind == "identifier" and self.text(left) in out:
                    target = self._target(right)
                    if target:
                        out[self.text(left)] = target
        return out

    def _innermost(self, declarator: Node) -> str | None:
        at = declarator
        while at.kind != "identifier" and (deeper := at.get("declarator")) is not None:
            at = deeper
        return next((self.text(x) for x in self.inside(at) if x.kind == "identifier"), None)

    def _target(self, value: Node) -> str | None:
        at: Node | None = value
        while at is not None and at.kind != "identifier":
            if at.kind == "parenthesized_expression":
                at = next((c for c in at.children if c.named), None)
            elif at.kind in ("cast_expression", "pointer_expression", "unary_expression"):
                at = at.get("value" if at.kind == "cast_expression" else "argument")
            else:
                return None
        return self.text(at) if at is not None else None

    def call_edges(self) -> list[tuple[str, str, bool]]:
        """(caller, callee, is_external) for every call in every named function, in reading order, repeats kept.

        A call in a nested function belongs to all named functions around it; in
        a function that did not parse cleanly, the walk stays out of nested ones.
        """
        local = self.local_names()
        out = []
        for f, name in self.functions():
            if name is None or self.is_macro_like(f):
                continue
            alias = self._aliases(f)
            prune = None
            if id(f) in self.broken:
                prune = lambda n: n.kind in FUNCTION_KINDS and not self.is_macro_like(n) and not (n.kind == "function_definition" and self.function_name(n) in C_KEYWORDS)
            for n in self.inside(f, prune):
                callee = self._callee(n, alias)
                if callee is not None:
                    out.append((name, callee, callee not in local))
        return out

    # ---- imports

    def _unquoted(self, n: Node) -> str:
        t = self.text(n).strip()
        return t[1:-1] if len(t) >= 2 and t[0] + t[-1] in ('""', "''", "<>") else t

    def _joined(self, nodes: list[Node]) -> list[str]:
        return [".".join(self.text(c).strip() for c in nodes)] if nodes else []

    def _import(self, n: Node) -> list[str]:
        g, kind = self.grammar, n.kind
        plain = lambda c: [self.text(c).strip()] if c is not None else []
        quoted = lambda c: [self._unquoted(c)] if c is not None else []
        if g in ("c", "cpp"):
            return quoted(n.get("path")) if kind == "preproc_include" else []
        if g == "rust":
            return plain(n.get("argument")) if kind == "use_declaration" else []
        if g == "python":
            if kind == "import_statement":
                return [self.text(c.get("name") if c.kind == "aliased_import" else c).strip() for c in n.children if c.field == "name"]
            return plain(n.get("module_name")) if kind == "import_from_statement" else []
        if g in ("javascript", "typescript"):
            return quoted(n.get("source")) if kind in ("import_statement", "import_require_clause") else []
        if g == "go":
            return quoted(n.get("path")) if kind == "import_spec" else []
        if g == "java":
            return [self.text(c).strip() for c in n.children if c.kind in ("identifier", "scoped_identifier")] if kind == "import_declaration" else []
        if g == "csharp":
            return plain(n.get("name") or next((c for c in n.children if c.named), None)) if kind == "using_directive" else []
        if g == "kotlin":
            return plain(n.child("identifier", "qualified_identifier")) if kind == "import" else []
        if g == "swift":
            return self._joined([c for c in n.children if c.kind == "identifier"]) if kind == "import_declaration" else []
        if g == "php":
            if kind == "namespace_use_declaration":
                return [self.text(c).strip() for c in n.children if c.kind in ("name", "qualified_name", "namespace_name")]
            if kind == "namespace_use_clause":
                return plain(n.child("name", "qualified_name"))
            if kind in ("include_expression", "include_once_expression", "require_expression", "require_once_expression"):
                return quoted(next((c for c in n.children if c.named), None))
        if g == "fortran":
            if kind == "use_statement":
                return plain(n.child("module_name"))
            return quoted(n.get("path")) if kind == "include_statement" else []
        if g == "scala":
            return self._joined([c for c in n.children if c.named and c.field == "path"]) if kind == "import_declaration" else []
        if g == "lua" and kind == "function_call":
            name, args = n.get("name"), n.get("arguments")
            if name is not None and self.text(name).strip() == "require" and args is not None:
                return quoted(next((c for c in args.children if c.named), None))
        if g == "ada" and kind == "with_clause":
            return [self.text(c).strip() for c in n.children if c.kind in ("identifier", "selected_component")]
        return []

    def imports(self) -> list[str]:
        return [s for n in self.order for s in self._import(n)]

    # ---- C standard and C++

    def _standard(self, n: Node) -> int:
        """1: C99, 2: C11, 3: C23, 0: no marker."""
        kind = n.kind
        if kind == "identifier":
            return 2 * (self.text(n) in ("_Static_assert", "static_assert"))
        if kind in ("generic_expression", "alignas_qualifier"):
            return 2
        if kind == "alignof_expression":
            return 2 * self.text(n).startswith(("_Alignof", "alignof"))
        if kind == "type_qualifier":
            return {"restrict": 1, "_Atomic": 2, "_Noreturn": 2, "noreturn": 2, "constexpr": 3}.get(self.text(n), 0)
        if kind == "initializer_pair":
            return any(c.field == "designator" and c.kind in ("field_designator", "subscript_designator") for c in n.children)
        if kind in ("array_declarator", "abstract_array_declarator"):
            size = n.get("size")
            return size is not None and size.kind == "*" and not size.named
        if kind == "null":
            return 3 * (self.text(n) == "nullptr")
        if kind == "attribute_declaration":
            return 3
        if kind == "preproc_call":
            d = n.get("directive")
            return 3 * (d is not None and self.text(d) == "#embed")
        return 0

    def min_c_standard(self) -> str | None:
        best = 0
        for n in self.order:
            best = max(best, int(self._standard(n)))
            if best == 3:
                break
        return STANDARDS[best - 1] if best else None

    def looks_like_cpp(self) -> bool:
        return any(n.kind in CPP_ONLY for n in self.order)

    # ---- fingerprints

    def structural_hash(self, n: Node) -> tuple[str, int]:
        """md5 over kinds and child counts in pre-order and the declared type's text; number of nodes."""
        parts = [f"{x.kind}/{len(x.children)}" for x in self.inside(n)]
        declared = next((self.text(t) for f in ("return_type", "result", "type") if (t := n.get(f)) is not None), None)
        return hashlib.md5((";".join(parts) + ("" if declared is None else "|" + declared)).encode()).hexdigest(), len(parts)


# ---- control flow

EDGE_KINDS = ("fallthrough", "true_branch", "false_branch", "back_edge", "return", "break", "continue")
_SHAPES = {
    "c": {"if": "if_statement", "while": "while_statement", "for": "for_statement", "loop": None, "do": "do_statement", "return": "return_statement", "break": "break_statement", "continue": "continue_statement", "block": "compound_statement", "wrapper": None},
    "rust": {"if": "if_expression", "while": "while_expression", "for": "for_expression", "loop": "loop_expression", "do": None, "return": "return_expression", "break": "break_expression", "continue": "continue_expression", "block": "block", "wrapper": "expression_statement"},
}
_SHAPES["cpp"] = _SHAPES["c"]


class Cfg:
    """Basic blocks of one function. Nested constructs are coroutines on an explicit stack, so depth is no limit."""

    def __init__(self, grammar: str, body: Node):
        self.role = {kind: role for role, kind in _SHAPES[grammar].items() if kind}
        self.statements: list[list[tuple[int, int]]] = []
        self.span: list[list[int]] = []
        self.condition: list[tuple[int, int] | None] = []
        self.edges: list[tuple[int, int, str]] = []
        self._seen: set[tuple[int, int, str]] = set()
        self.dead: list[bool] = []
        self.loops: list[tuple[int, int]] = []
        self.here = self._block(body.start)
        stack = [self._enter(body)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            else:
                stack.append(self._enter(child))
        returns = {b for _, b, kind in self.edges if kind == "return"}
        last = len(self.span) - 1
        if all(a != last for a, _, _ in self.edges):
            returns.add(last)
        self.exits = sorted(returns)

    def _block(self, at: int) -> int:
        self.statements.append([])
        self.span.append([at, at])
        self.condition.append(None)
        self.dead.append(False)
        return len(self.span) - 1

    def _edge(self, a: int, b: int, kind: str) -> None:
        if (a, b, kind) not in self._seen:
            self._seen.add((a, b, kind))
            self.edges.append((a, b, kind))

    def _flow(self, a: int, b: int, kind: str = "fallthrough") -> None:
        if not self.dead[a]:
            self._edge(a, b, kind)

    def _put(self, n: Node) -> None:
        b = self.here
        if not self.statements[b]:
            self.span[b][0] = n.start
        self.span[b][1] = n.end
        self.statements[b].append((n.start, n.end))

    def _test(self, n: Node, b: int) -> None:
        c = n.get("condition")
        if c is not None:
            self.condition[b] = (c.start, c.end)

    def _enter(self, n: Node) -> Iterator[Node]:
        while self.role.get(n.kind) == "wrapper":
            inner = next((c for c in n.children if c.named), None)
            if inner is None:
                break
            n = inner
        role = self.role.get(n.kind)
        run = getattr(self, "_" + role, None) if role in ("if", "while", "for", "loop", "do") else None
        if role == "block":
            return iter([c for c in n.children if c.named])
        if run is not None:
            return run(n)
        self._put(n)
        if role in ("return", "break", "continue"):
            self._jump(n, role)
        return iter(())

    def _jump(self, n: Node, role: str) -> None:
        a = self.here
        if role != "return" and self.loops:
            self._edge(a, self.loops[-1][role == "break"], role)
        self.here = self._block(n.end)
        if role == "return":
            self._edge(a, self.here, role)
        self.dead[a] = self.dead[self.here] = True

    def _if(self, n: Node) -> Iterator[Node]:
        head = self.here
        self._test(n, head)
        self.here = self._block(n.start)
        self._edge(head, self.here, "true_branch")
        if (c := n.get("consequence")) is not None:
            yield c
        yes = self.here
        self.here = self._block(n.start)
        self._edge(head, self.here, "false_branch")
        other = n.get("alternative")
        while other is not None and other.kind == "else_clause":
            inner = next((c for c in other.children if c.named), None)
            if inner is None:
                break
            other = inner
        if other is not None:
            yield other
        no = self.here
        self.here = self._block(n.end)
        self._flow(yes, self.here)
        self._flow(no, self.here)

    def _pretest(self, n: Node, update: Node | None) -> Iterator[Node]:
        head, before = self._block(n.start), self.here
        self._flow(before, head)
        self._test(n, head)
        after = self._block(n.end)
        self._edge(head, after, "false_branch")
        self.here = self._block(n.start)
        self._edge(head, self.here, "true_branch")
        self.loops.append((head, after))
        if (b := n.get("body")) is not None:
            yield b
        self.loops.pop()
        if update is not None and not self.dead[self.here]:
            self._put(update)
        self._flow(self.here, head, "back_edge")
        self.here = after

    def _while(self, n: Node) -> Iterator[Node]:
        return self._pretest(n, None)

    def _for(self, n: Node) -> Iterator[Node]:
        if (first := n.get("initializer")) is not None:
            self._put(first)
        return self._pretest(n, n.get("update"))

    def _loop(self, n: Node) -> Iterator[Node]:
        head, before = self._block(n.start), self.here
        self._flow(before, head)
        after = self._block(n.end)
        self.here = head
        self.loops.append((head, after))
        if (b := n.get("body")) is not None:
            yield b
        self.loops.pop()
        self._flow(self.here, head, "back_edge")
        self.here = after

    def _do(self, n: Node) -> Iterator[Node]:
        start, before = self._block(n.start), self.here
        self._flow(before, start)
        foot, after = self._block(n.end), self._block(n.end)
        self.here = start
        self.loops.append((foot, after))
        if (b := n.get("body")) is not None:
            yield b
        self.loops.pop()
        self._flow(self.here, foot)
        self._test(n, foot)
        self._edge(foot, start, "back_edge")
        self._edge(foot, after, "false_branch")
        self.here = after


def function_cfg(grammar: str, function: Node) -> Cfg | None:
    """None if the language is not modelled or the function has no body."""
    body = function.get("body")
    return Cfg(grammar, body) if grammar in _SHAPES and body is not None else None
