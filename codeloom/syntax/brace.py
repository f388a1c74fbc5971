"""A tolerant recursive-descent parser for languages with braces.

One grammar with a table of differences per language: C, C++, Rust, Go, Java,
C#, JavaScript, TypeScript, Kotlin, Swift, Scala and PHP.  It models what the
operators look at (functions, calls, imports, control flow, declarators,
standard markers) under the node kinds they expect, and swallows the rest.
It never raises: what does not fit becomes an error node.
"""

from __future__ import annotations

from codeloom.syntax.lexer import Token, tokens
from codeloom.syntax.tree import Node, close

_JS = ("javascript", "typescript", "tsx")
_NEWLINE = frozenset(("go", "kotlin", "swift", "scala") + _JS)  # a line's end may end a statement
_C_TYPES = frozenset("void char short int long float double signed unsigned bool _Bool _Complex size_t ssize_t ptrdiff_t int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t wchar_t auto char8_t char16_t char32_t FILE".split())
_C_QUALIFIERS = frozenset("const volatile restrict __restrict __restrict__ _Atomic _Noreturn noreturn constexpr mutable consteval constinit".split())
_C_STORAGE = frozenset("static extern register inline typedef thread_local _Thread_local __inline __inline__ virtual explicit friend".split())
_C_STATEMENTS = frozenset("break case continue default do else for goto if return sizeof switch while".split())
_MODIFIERS = frozenset(
    """public private protected internal static final abstract synchronized native transient volatile strictfp default sealed partial override virtual async extern unsafe readonly
    open data inner companion lateinit inline tailrec operator infix suspend const expect actual annotation enum external fileprivate mutating nonmutating lazy weak unowned required convenience
    dynamic indirect implicit case export declare accessor var non pub new""".split()
)
_BINARY = {}
for _level, _ops in enumerate(("?? ?:", "||", "&&", "|", "^", "&", "== != === !== ~= <=>", "< > <= >= in instanceof is as !in !is", "..= .. ..< ... until downTo step to", "<< >>", "+ -", "* / %", "**")):
    for _o in _ops.split():
        _BINARY[_o] = _level + 1
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= := ??=".split())
_CLOSE = {"(": ")", "[": "]", "{": "}"}


class Kinds:
    def __init__(self, lang: str):
        js = lang in _JS
        c = lang in ("c", "cpp")
        self.root = {"rust": "source_file", "go": "source_file", "kotlin": "source_file", "swift": "source_file", "c": "translation_unit", "cpp": "translation_unit", "csharp": "compilation_unit", "scala": "compilation_unit"}.get(lang, "program")
        self.block = "statement_block" if js else "compound_statement" if c or lang == "php" else "function_body" if lang == "swift" else "block"
        expr = lang in ("rust", "kotlin", "scala")
        tail = "_expression" if expr else "_statement"
        self.if_, self.while_, self.for_, self.do = "if" + tail, "while" + tail, "for" + tail, "do" + ("_while" if lang in ("kotlin", "scala") else "") + "_statement"
        self.return_, self.break_, self.continue_ = ("return_expression", "break_expression", "continue_expression") if lang in ("rust", "scala") else ("return_statement", "break_statement", "continue_statement")
        self.comment = {"rust": ("line_comment", "block_comment"), "java": ("line_comment", "block_comment"), "kotlin": ("line_comment", "block_comment"), "swift": ("comment", "multiline_comment"), "scala": ("comment", "block_comment")}.get(lang, ("comment", "comment"))
        self.call = {"java": "method_invocation", "csharp": "invocation_expression", "php": "function_call_expression"}.get(lang, "call_expression")
        self.member = {"go": "selector_expression", "java": "field_access", "csharp": "member_access_expression", "kotlin": "navigation_expression", "swift": "navigation_expression", "php": "member_access_expression"}.get(lang, "member_expression" if js else "field_expression")
        self.identifier = {"php": "name", "swift": "simple_identifier"}.get(lang, "identifier")
        self.arguments = {"c": "argument_list", "cpp": "argument_list", "go": "argument_list", "java": "argument_list", "csharp": "argument_list", "kotlin": "value_arguments", "swift": "value_arguments"}.get(lang, "arguments")
        self.string = {"c": "string_literal", "cpp": "string_literal", "rust": "string_literal", "go": "interpreted_string_literal", "java": "string_literal", "csharp": "string_literal", "kotlin": "string_literal", "swift": "line_string_literal"}.get(lang, "string")
        self.number = {"c": "number_literal", "cpp": "number_literal", "go": "int_literal", "java": "decimal_integer_literal", "php": "integer"}.get(lang, "number" if js else "integer_literal")


class Parser:
    def __init__(self, source: str, lang: str):
        self.lang, self.k, self.source = lang, Kinds(lang), source
        self.toks: list[Token] = tokens(source, lang)
        self.i = 0
        self.js = lang in _JS
        self.c = lang in ("c", "cpp")
        self.lines = lang in _NEWLINE
        self.depth = 0  # of parentheses, in which line ends mean nothing
        self.no_struct = False
        self.last_end = 0

    # ---- tokens

    def skim(self, kids: list[Node]) -> Token:
        """Comments become children; the token after them."""
        while (t := self.toks[self.i]).type == "com":
            kids.append(Node(self.k.comment[not t.text.startswith(("//", "#"))], t.start, t.end))
            self.i += 1
        return t

    def peek(self, ahead: int = 0) -> Token:
        i = self.i
        while True:
            while self.toks[i].type == "com":
                i += 1
            if not ahead or self.toks[i].type == "end":
                return self.toks[i]
            ahead -= 1
            i += 1

    def at(self, *texts: str) -> bool:
        return self.peek().text in texts and self.peek().type != "str"

    def take(self, kids: list[Node], field: str | None = None) -> Node:
        """The next token as an anonymous node."""
        t = self.skim(kids)
        n = Node(t.text or "ERROR", t.start, t.end, False, field)
        if t.type != "end":
            self.i += 1
            self.last_end = t.end
            kids.append(n)
        return n

    def leaf(self, kids: list[Node], kind: str, field: str | None = None) -> Node:
        t = self.skim(kids)
        n = Node(kind, t.start, t.end, True, field)
        if t.type != "end":
            self.i += 1
            self.last_end = t.end
            kids.append(n)
        return n

    def expect(self, kids: list[Node], text: str) -> bool:
        if self.at(text):
            self.take(kids)
            return True
        kids.append(Node("MISSING", self.last_end, self.last_end, False, None, None, True))
        return False

    def node(self, kids: list[Node], kind: str, children: list[Node], field: str | None = None, error: bool = False) -> Node:
        n = close(Node(kind, field=field, children=children, error=error), self.last_end)
        kids.append(n)
        return n

    def wrap(self, first: Node | None, kind: str, rest: list[Node], field: str | None = None) -> Node:
        return close(Node(kind, field=field, children=([first] if first else []) + rest), self.last_end)

    def balanced(self, kids: list[Node], kind: str, field: str | None = None) -> Node:
        """Brackets and all in them, as tokens."""
        inner: list[Node] = []
        stack = [_CLOSE[self.take(inner).kind]]
        while stack and self.peek().type != "end":
            t = self.peek()
            if t.type not in ("str", "chr") and t.text in _CLOSE:
                stack.append(_CLOSE[t.text])
            elif t.text == stack[-1] and t.type == "op":
                stack.pop()
            elif t.type == "op" and t.text in ")]}":
                break
            if t.type == "id":
                self.leaf(inner, self.k.identifier)
            elif t.type == "str":
                self.leaf(inner, self.k.string)
            else:
                self.take(inner)
        return self.node(kids, kind, inner, field, error=bool(stack))

    # ---- program

    def parse(self) -> Node:
        kids: list[Node] = []
        while self.peek().type != "end":
            before = self.i
            self.statement(kids)
            if self.i == before:
                err: list[Node] = []
                self.take(err)
                self.node(kids, "ERROR", err, error=True)
        self.skim(kids)
        root = Node(self.k.root, 0, len(self.source), children=kids)
        return root

    def block(self, kids: list[Node], kind: str | None = None, field: str | None = None) -> Node:
        inner: list[Node] = []
        self.take(inner)
        depth, self.depth = self.depth, 0
        loose, self.no_struct = self.no_struct, False
        while not self.at("}") and self.peek().type != "end":
            before = self.i
            self.statement(inner)
            if self.i == before:
                err: list[Node] = []
                self.take(err)
                self.node(inner, "ERROR", err, error=True)
        self.skim(inner)
        done = self.expect(inner, "}")
        self.depth, self.no_struct = depth, loose
        return self.node(kids, kind or self.k.block, inner, field, error=not done)

    def ended(self) -> bool:
        """Is the statement over here."""
        t = self.peek()
        return t.type == "end" or t.text in ("}", ";") or (self.lines and self.depth == 0 and t.nl)

    def semicolon(self, kids: list[Node]) -> None:
        if self.at(";"):
            self.take(kids)
        elif not self.lines and not (self.at("}") or self.peek().type == "end"):
            kids.append(Node("MISSING", self.last_end, self.last_end, False, None, None, True))

    # ---- statements

    def statement(self, kids: list[Node], field: str | None = None) -> Node | None:
        t = self.skim(kids)
        if t.type == "end":
            return None
        if t.type == "pp":
            return self.preprocessor(kids)
        if t.type == "op":
            if t.text == "{":
                return self.block(kids, field=field)
            if t.text == ";":
                self.take(kids)
                return None
            if t.text == "#" and self.lang == "rust":
                inner: list[Node] = []
                self.take(inner)
                if self.at("!"):
                    self.take(inner)
                if self.at("["):
                    self.balanced(inner, "token_tree")
                return self.node(kids, "attribute_item", inner)
            if t.text == "[" and self.lang == "csharp" or t.text == "@" and self.lang in ("java", "kotlin", "swift", "scala", "typescript", "tsx", "javascript"):
                return self.annotation(kids)
            if t.text == "[" and self.c and self.peek(1).text == "[":
                return self.attribute(kids)
            if t.text == "<" and self.lang == "php" and self.peek(1).text == "?":
                inner = []
                self.take(inner), self.take(inner)
                if self.at("php"):
                    self.take(inner)
                return self.node(kids, "php_tag", inner)
            if t.text == "~" and self.lang == "cpp" and not self.in_function and self.peek(2).text == "(":
                return self.declaration(kids)
            if t.text == "}":
                err: list[Node] = []
                self.take(err)
                return self.node(kids, "ERROR", err, error=True)
        if t.type == "id":
            method = getattr(self, "s_" + t.text, None)
            if method is not None and not (self.peek(1).text in ("=", ".", ":=") and t.text not in ("return", "else")):
                done = method(kids)
                if done is not None:
                    if field:
                        done.field = field
                    return done
            if t.type == "id" and self.peek(1).text == ":" and self.peek(2).text != ":" and t.text not in ("default", "case") and self.lang not in ("kotlin", "scala", "swift", "php"):
                inner = []
                self.leaf(inner, "statement_identifier" if not self.js else "statement_identifier", "label")
                self.take(inner)
                if not self.at("}"):
                    self.statement(inner)
                return self.node(kids, "labeled_statement", inner)
            if self.c:
                if self.is_declaration():
                    return self.declaration(kids)
            elif self.lang in ("java", "csharp"):
                done = self.typed_member(kids)
                if done is not None:
                    return done
        return self.expression_statement(kids, field)

    def expression_statement(self, kids: list[Node], field: str | None = None) -> Node:
        inner: list[Node] = []
        self.expression(inner)
        if self.at(",") and self.depth == 0 and (self.c or self.js or self.lang == "go"):
            while self.at(","):
                self.take(inner)
                self.expression(inner)
            if self.peek().text in _ASSIGN:
                self.take(inner)
                self.expression(inner)
                while self.at(","):
                    self.take(inner)
                    self.expression(inner)
        one = inner[0] if len(inner) == 1 else None
        if one is not None and (one.kind in (self.k.if_, self.k.while_, self.k.for_, "loop_expression", "match_expression", self.k.block) and not self.at(";") or self.lang in ("kotlin", "scala", "swift")):
            if self.at(";"):
                self.take(kids)
            kids.append(one)
            one.field = field
            return one
        if self.lang == "rust" and not self.at(";"):  # the block's value
            kids += inner
            return inner[-1] if inner else None
        self.semicolon(inner)
        return self.node(kids, "expression_statement", inner, field)

    def condition(self, kids: list[Node], field: str | None = "condition") -> None:
        """In parentheses where the language has them there."""
        if self.at("(") and self.lang not in ("rust", "go", "swift"):
            inner: list[Node] = []
            self.take(inner)
            self.depth += 1
            if self.js or self.lang not in ("scala",):
                while not self.at(")") and self.peek().type != "end" and not self.at("{", "}"):
                    before = self.i
                    if self.c and self.is_declaration():
                        self.declaration(inner)
                    else:
                        self.expression(inner)
                    if self.at(";", ","):
                        self.take(inner)
                    if self.i == before:
                        break
            self.depth -= 1
            self.expect(inner, ")")
            self.node(kids, "condition_clause" if self.lang == "cpp" else "parenthesized_expression", inner, field)
        else:
            loose, self.no_struct = self.no_struct, True
            if self.at("let", "var") and self.lang in ("rust", "swift"):
                inner = []
                self.take(inner)
                while not self.at("=", "{") and self.peek().type != "end":
                    self.take(inner)
                if self.at("="):
                    self.take(inner)
                    self.expression(inner)
                self.node(kids, "let_condition", inner, field)
            else:
                n = self.expression(kids, statement=True)
                if n is not None:
                    n.field = field
            while self.at(";", ","):
                self.take(kids)
                if self.at("{"):
                    break
                n = self.expression(kids, statement=True)
                if n is not None:
                    n.field = field
            self.no_struct = loose

    def body(self, kids: list[Node], field: str = "body") -> None:
        if self.peek().type == "end":
            return
        if self.at("{"):
            self.block(kids, field=field)
        elif self.at(";"):
            inner: list[Node] = []
            self.take(inner)
            self.node(kids, "expression_statement", inner, field)
        else:
            n = self.statement(kids)
            if n is not None:
                n.field = field

    def s_if(self, kids):
        inner: list[Node] = []
        self.take(inner)
        if self.at("constexpr"):
            self.take(inner)
        self.condition(inner)
        if self.at("then"):
            self.take(inner)
        self.body(inner, "consequence" if self.lang not in ("php",) else "body")
        if self.peek().text == "else" or self.at(";") and self.peek(1).text == "else" and self.lang in ("kotlin", "scala"):
            if self.at(";"):
                self.take(inner)
            if self.c or self.lang in ("rust",) or self.js:
                clause: list[Node] = []
                self.take(clause)
                self.skim(clause)
                n = self.statement(clause)
                del n
                self.node(inner, "else_clause", clause, "alternative")
            else:
                self.take(inner)
                self.body(inner, "alternative")
        return self.node(kids, self.k.if_, inner)

    def s_while(self, kids):
        inner: list[Node] = []
        self.take(inner)
        self.condition(inner)
        self.body(inner)
        return self.node(kids, self.k.while_, inner)

    def s_loop(self, kids):
        if self.lang != "rust" or self.peek(1).text != "{":
            return None
        inner: list[Node] = []
        self.take(inner)
        self.block(inner, field="body")
        return self.node(kids, "loop_expression", inner)

    def s_do(self, kids):
        if self.lang == "rust":
            return None
        inner: list[Node] = []
        self.take(inner)
        self.body(inner)
        if self.at("while"):
            self.take(inner)
            self.condition(inner)
            if self.at(";"):
                self.take(inner)
        return self.node(kids, self.k.do, inner)

    def s_for(self, kids):
        inner: list[Node] = []
        self.take(inner)
        kind = self.k.for_
        if self.at("await", "each"):
            self.take(inner)
        if self.lang == "rust":
            self.pattern(inner, ("in",))
            if self.at("in"):
                self.take(inner)
            loose, self.no_struct = self.no_struct, True
            n = self.expression(inner)
            if n is not None:
                n.field = "value"
            self.no_struct = loose
        elif self.at("("):
            self.take(inner)
            self.depth += 1
            part = 0
            names = ("initializer", "condition", "update")
            while not self.at(")") and self.peek().type != "end" and not self.at("{"):
                before = self.i
                if self.at(";"):
                    self.take(inner)
                    part += 1
                elif self.at(":", "in", "of", "<-", ","):
                    if not self.at(","):
                        kind = {"cpp": "for_range_loop", "java": "enhanced_for_statement", "csharp": "foreach_statement"}.get(self.lang, "for_in_statement" if self.js else kind)
                    self.take(inner)
                elif self.c and part == 0 and self.is_declaration():
                    n = self.declaration(inner, in_for=True)
                    if n is not None:
                        n.field = "initializer"
                        part += n.children[-1].kind == ";"
                elif not self.c and self.at("let", "var", "const", "val") or self.lang in ("java", "csharp") and part == 0 and self.peek().type == "id" and self.peek(1).type == "id":
                    decl: list[Node] = []
                    self.take(decl)
                    while not self.at(";", ")", "in", "of", ":", "=") and self.peek().type != "end":
                        self.take(decl)
                    if self.at("="):
                        self.take(decl)
                        self.expression(decl)
                    self.node(inner, "variable_declaration", decl, "initializer")
                else:
                    n = self.expression(inner, comma=True)
                    if n is not None:
                        n.field = names[min(part, 2)] if kind == self.k.for_ else None
                if self.i == before:
                    self.take(inner)
            self.depth -= 1
            self.expect(inner, ")")
        elif not self.at("{"):  # go, swift, scala
            loose, self.no_struct = self.no_struct, True
            while not self.at("{") and self.peek().type != "end":
                before = self.i
                if self.at(";", "in", "range", ",", ":=", "=", "<-", "yield", "case", "var", "let"):
                    self.take(inner)
                else:
                    self.expression(inner, statement=True)
                if self.i == before:
                    self.take(inner)
            self.no_struct = loose
        if self.at("yield"):
            self.take(inner)
        self.body(inner)
        return self.node(kids, kind, inner)

    def s_foreach(self, kids):
        return self.s_for(kids) if self.lang in ("csharp", "php") else None

    def jump(self, kids, kind, value):
        inner: list[Node] = []
        t = self.take(inner)
        del t
        if not self.ended() and not self.at(")", ",", "]") and value:
            self.expression(inner, comma=self.lang == "go")
        if not self.lang == "rust":
            self.semicolon(inner)
            return self.node(kids, kind, inner)
        n = self.node([], kind, inner)
        if self.at(";"):
            wrapper = [n]
            self.take(wrapper)
            return self.node(kids, "expression_statement", wrapper)
        kids.append(n)
        return n

    def s_return(self, kids):
        return self.jump(kids, self.k.return_, True)

    def s_break(self, kids):
        return self.jump(kids, self.k.break_, True)

    def s_continue(self, kids):
        return self.jump(kids, self.k.continue_, True)

    def s_throw(self, kids):
        return self.jump(kids, "throw_statement", True)

    def s_goto(self, kids):
        return self.jump(kids, "goto_statement", True)

    def s_switch(self, kids):
        inner: list[Node] = []
        self.take(inner)
        self.condition(inner)
        if self.at("{"):
            self.block(inner, field="body")
        return self.node(kids, "switch_statement", inner)

    def s_case(self, kids):
        if self.lang == "scala" and self.peek(1).text in ("class", "object"):
            return self.type_body(kids)
        inner: list[Node] = []
        self.take(inner)
        self.depth += 1
        while not self.at(":", "=>", "->", "{", "}") and self.peek().type != "end":
            before = self.i
            self.expression(inner)
            if self.i == before or self.at(",", "if", "where"):
                self.take(inner)
        self.depth -= 1
        if self.at(":", "=>", "->"):
            self.take(inner)
        while not self.at("case", "default", "}") and self.peek().type != "end":
            before = self.i
            self.statement(inner)
            if self.i == before:
                break
        return self.node(kids, "case_statement", inner)

    def s_default(self, kids):
        return self.s_case(kids) if self.peek(1).text in (":", "->") else None

    def s_try(self, kids):
        if self.lang == "swift" or self.lang == "rust":
            return None
        inner: list[Node] = []
        self.take(inner)
        if self.at("("):
            self.balanced(inner, "resource_specification")
        if self.at("{"):
            self.block(inner, field="body")
        while self.at("catch", "finally"):
            clause: list[Node] = []
            kind = self.take(clause).kind + "_clause"
            if self.at("("):
                self.balanced(clause, "parameter_list", "parameters")
            if self.at("{"):
                self.block(clause, field="body")
            self.node(inner, kind, clause)
        return self.node(kids, "try_statement", inner)

    def s_else(self, kids):
        err: list[Node] = []
        self.take(err)
        return self.node(kids, "ERROR", err, error=True)

    # ---- preprocessor (C, C++, C#)

    def preprocessor(self, kids: list[Node]) -> Node:
        t = self.toks[self.i]
        body = t.text
        word = body[1:].lstrip().split(None, 1)
        name = word[0] if word else ""
        name = next((name[:j] for j, ch in enumerate(name) if not ch.isalpha()), name)
        at = t.start + body.index(name, 1) if name else t.start + 1
        inner = [Node("#" + name, t.start, at + len(name), False)]
        rest = at + len(name)
        kind = "preproc_call"
        text = self.source[rest : t.end]
        lead = rest + len(text) - len(text.lstrip())
        stop = t.start + len(body.rstrip())
        if name == "include" and lead < stop:
            kind = "preproc_include"
            inner.append(Node("system_lib_string" if self.source[lead] == "<" else "string_literal" if self.source[lead] == '"' else "identifier", lead, stop, True, "path"))
            end = self.source.find(">" if self.source[lead] == "<" else '"', lead + 1, stop)
            if inner[-1].kind != "identifier" and end > 0:
                inner[-1].end = end + 1
        elif name == "define" and lead < stop:
            end = lead
            while end < stop and (self.source[end].isalnum() or self.source[end] == "_"):
                end += 1
            inner.append(Node("identifier", lead, end, True, "name"))
            kind = "preproc_def"
            if self.source[end : end + 1] == "(":
                kind = "preproc_function_def"
                to = self.source.find(")", end, stop)
                to = stop if to < 0 else to + 1
                inner.append(Node("preproc_params", end, to, True, "parameters"))
                end = to
            if end < stop:
                inner.append(Node("preproc_arg", end, stop, True, "value"))
        elif name in ("if", "ifdef", "ifndef", "elif", "else", "endif", "elifdef"):
            kind = "preproc_" + name
            if lead < stop:
                inner.append(Node("preproc_arg", lead, stop, True, "condition"))
        else:
            inner = [Node("preproc_directive", t.start, at + len(name), True, "directive")]
            if lead < stop:
                inner.append(Node("preproc_arg", lead, stop, True, "argument"))
        self.i += 1
        self.last_end = t.end
        n = Node(kind, t.start, stop, children=inner)
        kids.append(n)
        return n

    # ---- C and C++ declarations

    def is_declaration(self) -> bool:
        t, u = self.peek(), self.peek(1)
        if t.type != "id" or t.text in _C_STATEMENTS:
            return False
        if t.text in _C_TYPES or t.text in _C_QUALIFIERS or t.text in _C_STORAGE or t.text in ("struct", "union", "enum", "alignas", "_Alignas", "typename", "decltype", "unsigned", "__attribute__", "_Static_assert", "operator"):
            return t.text != "_Static_assert"
        if self.lang == "cpp" and t.text in ("class",):
            return True
        if self.lang == "cpp" and t.text in ("new", "delete", "throw", "this", "co_await", "co_yield", "co_return"):
            return False
        if u.type == "id" and u.text not in ("and", "or", "not", "xor", "instanceof"):
            return True
        j = 1
        if self.lang == "cpp":
            while self.peek(j).text == "::" and self.peek(j + 1).type == "id":
                j += 2
            if self.peek(j).text == "<":
                k = self.skip_angles(j)
                if k is None:
                    return False
                j = k
                while self.peek(j).text == "::" and self.peek(j + 1).type == "id":
                    j += 2
            if j > 1 and self.peek(j).text == "(":
                return self.body_follows(j)
            if self.peek(j).type == "id" and j > 1:
                return True
        k = j
        while self.peek(k).text in ("*", "&", "&&", "const", "restrict", "**"):
            k += 1
        if k > j and self.peek(k).type == "id" and self.peek(k + 1).text in ("=", ";", ",", "[", "(", ")", ":"):
            return not (self.peek(k + 1).text == "(" and not self.body_follows(k + 1) and self.depth == 0 and self.in_function)
        if j == 1 and u.text == "(" and not self.in_function:
            return self.body_follows(1)
        return False

    in_function = 0

    def body_follows(self, j: int) -> bool:
        """Do the parentheses at token ``j`` end before a body."""
        depth, i, n = 0, self.i, 0
        i = self._index(j)
        while i < len(self.toks):
            t = self.toks[i]
            if t.type == "op":
                if t.text == "(":
                    depth += 1
                elif t.text == ")":
                    depth -= 1
                    if depth == 0:
                        break
                elif t.text in "{};":
                    return False
            n += 1
            i += 1
        i += 1
        while i < len(self.toks) and (self.toks[i].type in ("com", "pp") or self.toks[i].text in ("const", "noexcept", "override", "final", "volatile")):
            i += 1
        return i < len(self.toks) and (self.toks[i].text == "{" or self.lang == "cpp" and self.toks[i].text in (":", "->"))

    def _index(self, ahead: int) -> int:
        i = self.i
        while True:
            while self.toks[i].type == "com":
                i += 1
            if not ahead or self.toks[i].type == "end":
                return i
            ahead -= 1
            i += 1

    def skip_angles(self, j: int) -> int | None:
        """Past ``<...>`` at token ``j`` ahead if it holds only what types are made of, else None."""
        depth, i, start = 0, self._index(j), j
        while i < len(self.toks):
            t = self.toks[i]
            if t.type == "com":
                i += 1
                continue
            if t.text == "<":
                depth += 1
            elif t.text == ">":
                depth -= 1
            elif t.text == ">>":
                depth -= 2
            elif t.type == "op" and t.text not in (",", "::", "*", "&", "&&", "[", "]", ".", "?", "(", ")", "=", "->", ":", "|", "..."):
                return None
            elif t.type in ("end", "str", "pp") or t.text in ("return",):
                return None
            i += 1
            start += 1
            if depth <= 0:
                return start
        return None

    def specifiers(self, inner: list[Node]) -> bool:
        """Storage, qualifiers and one type. Did it find a type."""
        found = False
        while True:
            t = self.peek()
            if t.text in _C_QUALIFIERS:
                q: list[Node] = []
                self.take(q)
                self.node(inner, "type_qualifier", q)
                if t.text == "_Atomic" and self.at("("):
                    self.balanced(inner, "type_descriptor")
                    found = True
            elif t.text in _C_STORAGE:
                q = []
                self.take(q)
                self.node(inner, "friend_declaration" if t.text == "friend" else "storage_class_specifier", q)
            elif t.text in ("alignas", "_Alignas"):
                q = []
                self.take(q)
                if self.at("("):
                    self.balanced(q, "argument_list")
                self.node(inner, "alignas_qualifier", q)
            elif t.text in ("__attribute__", "__declspec"):
                q = []
                self.take(q)
                if self.at("("):
                    self.balanced(q, "argument_list")
                self.node(inner, "attribute_specifier", q)
            elif t.text == "[" and self.peek(1).text == "[":
                self.attribute(inner)
            elif t.text in ("struct", "union", "enum", "class") and not found:
                self.aggregate(inner)
                found = True
            elif t.text in ("signed", "unsigned", "long", "short") and (not found or inner[-1].kind == "sized_type_specifier"):
                q = [] if not (found and inner[-1].kind == "sized_type_specifier") else inner.pop().children
                self.take(q)
                while self.at("signed", "unsigned", "long", "short"):
                    self.take(q)
                if self.at("int", "char", "double"):
                    self.leaf(q, "primitive_type", "type")
                self.node(inner, "sized_type_specifier", q, "type")
                found = True
            elif t.text in _C_TYPES and not found:
                self.leaf(inner, "placeholder_type_specifier" if t.text == "auto" and self.lang == "cpp" else "primitive_type", "type")
                found = True
            elif t.text in ("typename", "decltype", "typeof") and not found:
                q = []
                self.take(q)
                if self.at("("):
                    self.balanced(q, "argument_list")
                self.node(inner, "dependent_type", q, "type")
                found = t.text != "typename"
            elif t.type == "id" and not found and t.text not in ("operator",):
                if self.lang == "cpp" and self.peek(1).text == "(" and self.body_follows(1):
                    return found  # constructor
                if self.peek(1).text == "(" and not self.body_follows(1) and self.peek(2).text != "*":
                    return found
                self.type_name(inner)
                found = True
            else:
                return found

    def type_name(self, kids: list[Node], field: str | None = "type") -> Node:
        own: list[Node] = []
        n = self.leaf(own, "type_identifier")
        while True:
            if self.at("<") and self.lang == "cpp" and self.skip_angles(0) is not None:
                self.angles(own)
                n = self.node([], "template_type", own)
                own = [n]
            elif self.at("::") and self.lang == "cpp" and self.peek(1).type == "id":
                n.kind = "namespace_identifier" if n.kind == "type_identifier" else n.kind
                self.take(own)
                self.leaf(own, "type_identifier", "name")
                n = self.node([], "qualified_identifier", own)
                own = [n]
            else:
                break
        n.field = field
        kids += own
        return n

    def angles(self, kids: list[Node], kind: str = "template_argument_list", field: str | None = None) -> None:
        inner: list[Node] = []
        depth = 0
        while self.peek().type != "end":
            t = self.peek()
            if t.text == "<":
                depth += 1
            elif t.text in (">", ">>"):
                depth -= len(t.text)
            if t.type == "id":
                self.leaf(inner, "type_identifier")
            else:
                self.take(inner)
            if depth <= 0:
                break
        self.node(kids, kind, inner, field)

    def aggregate(self, kids: list[Node]) -> None:
        inner: list[Node] = []
        word = self.take(inner).kind
        if word == "enum" and self.at("class", "struct"):
            self.take(inner)
        while self.at("alignas", "_Alignas", "__attribute__"):
            self.take(inner)
            if self.at("("):
                self.balanced(inner, "argument_list")
        if self.at("[") and self.peek(1).text == "[":
            self.attribute(inner)
        if self.peek().type == "id":
            self.type_name(inner, "name")
        if self.at("final"):
            self.take(inner)
        if self.at(":") and word in ("class", "struct") and self.lang == "cpp":
            base: list[Node] = []
            while not self.at("{", ";") and self.peek().type != "end":
                self.take(base)
            self.node(inner, "base_class_clause", base)
        elif self.at(":") and word == "enum":
            self.take(inner)
            self.leaf(inner, "primitive_type")
        if self.at("{"):
            if word == "enum":
                self.balanced(inner, "enumerator_list", "body")
            else:
                was, self.in_function = self.in_function, 0
                self.block(inner, "field_declaration_list", "body")
                self.in_function = was
        self.node(kids, word + "_specifier", inner, "type")

    def attribute(self, kids: list[Node]) -> Node:
        inner: list[Node] = []
        depth = 0
        while self.peek().type != "end":
            depth += {"[": 1, "]": -1}.get(self.peek().text, 0)
            self.take(inner)
            if depth == 0:
                break
        return self.node(kids, "attribute_declaration", inner)

    def declarator(self, kids: list[Node], field: str | None = "declarator", abstract: bool = False) -> Node | None:
        t = self.skim(kids)
        if t.text in ("*", "**", "&", "&&", "^"):
            inner: list[Node] = []
            self.take(inner)
            while self.peek().text in _C_QUALIFIERS:
                q: list[Node] = []
                self.take(q)
                self.node(inner, "type_qualifier", q)
            self.declarator(inner, "declarator" if t.text in ("*", "**") else None, abstract)
            return self.node(kids, ("abstract_" if abstract and not any(self._named(c) for c in inner) else "") + ("pointer_declarator" if t.text in ("*", "**") else "reference_declarator"), inner, field)
        n: Node | None = None
        own: list[Node] = []
        if t.text == "(" and (self.peek(1).text in ("*", "^", "&", "(") or self.peek(1).type == "id" and self.peek(2).text in (")", "::")):
            self.take(own)
            self.declarator(own, None, abstract)
            self.expect(own, ")")
            n = self.wrap(None, "parenthesized_declarator", own)
        elif t.text == "operator" and self.lang == "cpp":
            self.take(own)
            conversion = self.peek().type == "id" and self.peek().text not in ("new", "delete", "co_await")
            while not (self.at("(") and not (self.peek(1).text == ")" and self.peek(2).text == "(")) and self.peek().type != "end" and not self.at(";", "{"):
                if self.at("("):
                    self.take(own)
                self.take(own)
            n = self.wrap(None, "operator_cast" if conversion else "operator_name", own)
        elif t.text == "~" and self.lang == "cpp":
            self.take(own)
            self.leaf(own, "identifier")
            n = self.wrap(None, "destructor_name", own)
        elif t.type == "id":
            n = self.leaf(own, "identifier")
            own.clear()
            while self.lang == "cpp" and (self.at("::") or self.at("<") and self.skip_angles(0) is not None and self.peek(self.skip_angles(0)).text in ("::", "(")):
                part = [n]
                if self.at("<"):
                    self.angles(part)
                    n = self.wrap(None, "template_function", part)
                    continue
                n.kind = "namespace_identifier" if n.kind == "identifier" else n.kind
                self.take(part)
                if self.at("~"):
                    d: list[Node] = []
                    self.take(d)
                    self.leaf(d, "identifier")
                    self.node(part, "destructor_name", d, "name")
                elif self.at("operator"):
                    d = []
                    self.take(d)
                    while not self.at("(") and self.peek().type != "end":
                        self.take(d)
                    self.node(part, "operator_name", d, "name")
                else:
                    self.leaf(part, "identifier", "name")
                n = self.wrap(None, "qualified_identifier", part)
        elif not self.at("[", "("):
            return None
        while True:
            if self.at("("):
                part = [n] if n else []
                if n:
                    n.field = "declarator"
                self.parameters(part)
                while self.at("const", "noexcept", "override", "final", "volatile", "&", "&&"):
                    q = []
                    word = self.take(q).kind
                    if word == "noexcept" and self.at("("):
                        self.balanced(q, "argument_list")
                    self.node(part, word if word == "noexcept" else "type_qualifier" if word in ("const", "volatile") else "virtual_specifier", q)
                if self.at("->") and self.lang == "cpp":
                    q = []
                    self.take(q)
                    self.specifiers(q)
                    self.declarator(q, None, True)
                    self.node(part, "trailing_return_type", q)
                n = self.wrap(None, "function_declarator" if any(c.field == "declarator" for c in part) else "abstract_function_declarator", part)
            elif self.at("[") and self.peek(1).text != "[":
                part = [n] if n else []
                if n:
                    n.field = "declarator"
                self.take(part)
                self.depth += 1
                while self.peek().text in _C_QUALIFIERS or self.at("static"):
                    q = []
                    self.take(q)
                    self.node(part, "type_qualifier", q)
                if self.at("*") and self.peek(1).text == "]":
                    self.take(part, "size")
                elif not self.at("]"):
                    m = self.expression(part)
                    if m is not None:
                        m.field = "size"
                self.depth -= 1
                self.expect(part, "]")
                n = self.wrap(None, "array_declarator" if n else "abstract_array_declarator", part)
            else:
                break
        if n is None:
            return None
        n.field = field
        kids.append(n)
        return n

    def _named(self, n: Node) -> bool:
        stack = [n]
        while stack:
            x = stack.pop()
            if x.kind in ("identifier", "qualified_identifier"):
                return True
            stack += x.children
        return False

    def parameters(self, kids: list[Node]) -> None:
        inner: list[Node] = []
        self.take(inner)
        self.depth += 1
        while not self.at(")", "{", "}", ";") and self.peek().type != "end":
            before = self.i
            if self.at("..."):
                self.leaf(inner, "variadic_parameter")
            elif self.at(","):
                self.take(inner)
            else:
                p: list[Node] = []
                self.specifiers(p)
                self.declarator(p, abstract=True)
                if self.at("="):
                    self.take(p)
                    self.expression(p)
                if p:
                    self.node(inner, "parameter_declaration", p)
            if self.i == before:
                self.take(inner)
        self.depth -= 1
        self.expect(inner, ")")
        self.node(kids, "parameter_list", inner, "parameters")

    def declaration(self, kids: list[Node], in_for: bool = False) -> Node | None:
        inner: list[Node] = []
        typedef = self.at("typedef")
        before = self.i
        self.specifiers(inner)
        first = True
        while True:
            if self.at(";", "}", ")") or self.peek().type == "end":
                break
            item: list[Node] = []
            d = self.declarator(item)
            if d is None:
                if self.at(":"):  # bit field
                    self.take(inner)
                    self.expression(inner)
                    continue
                break
            if first and self._function(d) and (self.at("{") or self.lang == "cpp" and self.at(":", "try") and self._function(d) or self.at("=") and self.peek(1).text in ("default", "delete", "0")):
                inner += item
                if self.at("="):
                    q: list[Node] = []
                    self.take(q)
                    word = self.take(q).kind
                    self.expect(q, ";")
                    self.node(inner, {"default": "default_method_clause", "delete": "delete_method_clause"}.get(word, "pure_virtual_clause"), q)
                    return self.node(kids, "function_definition" if word != "0" else "field_declaration", inner)
                if self.at(":"):
                    q = []
                    self.take(q)
                    while not self.at("{", ";") and self.peek().type != "end":
                        if self.at("("):
                            self.arguments(q)
                        elif self.at(","):
                            self.take(q)
                        elif self.peek().type == "id":
                            self.leaf(q, "field_identifier")
                            if self.at("{"):
                                self.balanced(q, "initializer_list")
                        else:
                            self.take(q)
                    self.node(inner, "field_initializer_list", q)
                self.in_function += 1
                if self.at("{"):
                    self.block(inner, field="body")
                self.in_function -= 1
                return self.node(kids, "function_definition", inner)
            if first and self._function(d) and self.peek().type == "id" and self.lang == "c" and not typedef and not self.in_function and self.is_declaration():
                inner += item  # old-style parameter declarations
                while self.is_declaration() and not self.at("{"):
                    self.declaration(inner)
                if self.at("{"):
                    self.in_function += 1
                    self.block(inner, field="body")
                    self.in_function -= 1
                return self.node(kids, "function_definition", inner)
            first = False
            while self.at("__attribute__", "asm", "__asm__"):
                self.take(item)
                if self.at("("):
                    self.balanced(item, "argument_list")
            if self.at("=") or self.at("{") and self.lang == "cpp":
                if self.at("="):
                    self.take(item)
                v = self.initializer(item)
                if v is not None:
                    v.field = "value"
                self.node(inner, "init_declarator", item, "declarator")
            else:
                inner += item
            if self.at(","):
                self.take(inner)
                continue
            break
        if self.i == before:
            return self.expression_statement(kids)
        self.semicolon(inner)
        return self.node(kids, "type_definition" if typedef else "declaration", inner)

    def _function(self, d: Node) -> bool:
        while d is not None and d.kind in ("pointer_declarator", "reference_declarator"):
            d = d.get("declarator") or next((c for c in d.children if c.kind.endswith("declarator")), None)
        return d is not None and d.kind == "function_declarator"

    def initializer(self, kids: list[Node]) -> Node | None:
        return self.initializer_list(kids) if self.at("{") else self.expression(kids)

    def initializer_list(self, kids: list[Node]) -> Node:
        inner: list[Node] = []
        self.take(inner)
        self.depth += 1
        while not self.at("}") and self.peek().type != "end":
            before = self.i
            if self.peek().type == "pp":
                self.preprocessor(inner)
            elif self.at(","):
                self.take(inner)
            elif self.at(".") or self.at("["):
                pair: list[Node] = []
                while self.at(".", "["):
                    d: list[Node] = []
                    if self.take(d).kind == ".":
                        self.leaf(d, "field_identifier")
                        self.node(pair, "field_designator", d, "designator")
                    else:
                        self.expression(d)
                        self.expect(d, "]")
                        self.node(pair, "subscript_designator", d, "designator")
                if self.at("="):
                    self.take(pair)
                    v = self.initializer(pair)
                    if v is not None:
                        v.field = "value"
                self.node(inner, "initializer_pair", pair)
            else:
                self.initializer(inner)
            if self.i == before:
                self.take(inner)
        self.depth -= 1
        self.expect(inner, "}")
        return self.node(kids, "initializer_list", inner)

    # ---- C++ only

    def cpp_words(self, kids, kind, body="declaration_list"):
        if self.lang != "cpp":
            return None
        inner: list[Node] = []
        self.take(inner)
        while not self.at("{", ";") and self.peek().type != "end":
            if self.peek().type == "id":
                self.leaf(inner, "namespace_identifier", "name")
            else:
                kind = "namespace_alias_definition" if self.at("=") and kind == "namespace_definition" else kind
                self.take(inner)
        if self.at("{"):
            self.block(inner, body, "body")
        elif self.at(";"):
            self.take(inner)
        return self.node(kids, kind, inner)

    def s_namespace(self, kids):
        if self.lang == "cpp":
            return self.cpp_words(kids, "namespace_definition")
        if self.lang in ("csharp", "php"):
            inner: list[Node] = []
            self.take(inner)
            if self.peek().type == "id":
                self.path(inner, "name")
            if self.at("{"):
                self.block(inner, "declaration_list", "body")
            elif self.at(";"):
                self.take(inner)
            return self.node(kids, "namespace_declaration" if self.lang == "csharp" else "namespace_definition", inner)
        return None

    def s_template(self, kids):
        if self.lang != "cpp":
            return None
        inner: list[Node] = []
        self.take(inner)
        kind = "template_instantiation"
        if self.at("<"):
            kind = "template_declaration"
            self.angles(inner, "template_parameter_list", "parameters")
        if self.at("requires"):
            q: list[Node] = []
            self.take(q)
            self.expression(q)
            self.node(inner, "requires_clause", q)
        if self.at("concept"):
            self.cpp_words(inner, "concept_definition")
        else:
            self.statement(inner)
        return self.node(kids, kind, inner)

    def s_friend(self, kids):
        if self.lang != "cpp":
            return None
        inner: list[Node] = []
        self.take(inner)
        self.statement(inner)
        return self.node(kids, "friend_declaration", inner)

    def s_extern(self, kids):
        if not self.c or self.peek(1).type != "str":
            return None
        inner: list[Node] = []
        self.take(inner)
        self.leaf(inner, "string_literal", "value")
        if self.at("{"):
            self.block(inner, "declaration_list", "body")
        else:
            self.statement(inner)
        return self.node(kids, "linkage_specification", inner)

    def access(self, kids):
        if self.lang == "cpp" and self.peek(1).text == ":":
            inner: list[Node] = []
            self.take(inner), self.take(inner)
            return self.node(kids, "access_specifier", inner)
        return self.with_modifiers(kids)

    s_public = s_private = s_protected = lambda self, kids: self.access(kids)

    # ---- imports

    def path(self, kids: list[Node], field: str | None = None) -> Node:
        """A dotted or scoped name as one node."""
        own: list[Node] = []
        kinds = {"csharp": "qualified_name", "kotlin": "qualified_identifier", "php": "qualified_name"}.get(self.lang, "scoped_identifier")
        n = None
        if self.at("\\"):
            self.take(own)
        if self.peek().type == "id":
            n = self.leaf(own, self.k.identifier)
        while self.at(".", "::", "\\") and self.peek(1).type == "id" and not self.peek(1).nl:
            self.take(own)
            n = self.leaf(own, self.k.identifier)
        if len(own) > 1 or n is None:
            return self.node(kids, kinds, own, field)
        n.field = field
        kids.append(n)
        return n

    def s_import(self, kids):
        lang = self.lang
        if self.c:
            return None
        inner: list[Node] = []
        self.take(inner)
        if lang == "go":
            if self.at("("):
                spec_list: list[Node] = []
                self.take(spec_list)
                while not self.at(")") and self.peek().type != "end":
                    self.go_import(spec_list)
                self.expect(spec_list, ")")
                self.node(inner, "import_spec_list", spec_list)
            else:
                self.go_import(inner)
            return self.node(kids, "import_declaration", inner)
        if lang in _JS:
            if self.at("("):  # dynamic import
                self.i -= 1
                return None
            clause: list[Node] = []
            while not self.ended() and self.peek().type != "str" and not self.at("from", "="):
                if self.at("{"):
                    self.balanced(clause, "named_imports")
                elif self.peek().type == "id":
                    self.leaf(clause, "identifier")
                else:
                    self.take(clause)
            if self.at("=") and self.peek(1).text == "require":
                self.take(clause), self.take(clause)
                if self.at("("):
                    self.take(clause)
                    self.leaf(clause, "string", "source")
                    self.expect(clause, ")")
                self.node(inner, "import_require_clause", clause)
            else:
                if clause:
                    self.node(inner, "import_clause", clause)
                if self.at("from"):
                    self.take(inner)
                if self.peek().type == "str":
                    self.leaf(inner, "string", "source")
            self.semicolon(inner)
            return self.node(kids, "import_statement", inner)
        if lang == "java":
            if self.at("static"):
                self.take(inner)
            self.path(inner)
            if self.at("."):
                self.take(inner)
            if self.at("*"):
                self.leaf(inner, "asterisk")
            self.semicolon(inner)
            return self.node(kids, "import_declaration", inner)
        if lang == "kotlin":
            self.path(inner)
            while not self.ended():
                self.take(inner)
            return self.node(kids, "import", inner)
        if lang == "swift":
            if self.at("class", "struct", "func", "enum", "protocol", "var", "let", "typealias"):
                self.take(inner)
            name: list[Node] = []
            while not self.ended():
                if self.peek().type == "id":
                    self.leaf(inner, "identifier")
                else:
                    self.take(inner)
            del name
            return self.node(kids, "import_declaration", inner)
        if lang == "scala":
            while not self.ended():
                if self.at("_", "*"):
                    self.leaf(inner, "namespace_wildcard")
                elif self.peek().type == "id":
                    self.leaf(inner, "identifier", "path")
                elif self.at("{"):
                    self.balanced(inner, "namespace_selectors")
                else:
                    self.take(inner)
            return self.node(kids, "import_declaration", inner)
        self.i -= 1
        return None

    def go_import(self, kids):
        inner: list[Node] = []
        if self.peek().type == "id" or self.at(".", "_"):
            self.leaf(inner, {"_": "blank_identifier", ".": "dot"}.get(self.peek().text, "package_identifier"), "name")
        if self.peek().type == "str":
            self.leaf(inner, "raw_string_literal" if self.peek().text[0] == "`" else "interpreted_string_literal", "path")
        elif self.peek().type != "end" and not self.at(")"):
            self.take(inner)
        if self.at(";"):
            self.take(kids)
        self.node(kids, "import_spec", inner)

    def s_use(self, kids):
        if self.lang == "rust":
            inner: list[Node] = []
            self.take(inner)
            arg: list[Node] = []
            kind = "identifier"
            while not self.at(";") and self.peek().type != "end":
                if self.at("{"):
                    self.balanced(arg, "use_list")
                    kind = "scoped_use_list"
                else:
                    kind = "use_as_clause" if self.at("as") else "use_wildcard" if self.at("*") else "scoped_identifier" if self.at("::") else kind
                    if self.peek().type == "id" and not self.at("as"):
                        self.leaf(arg, "identifier")
                    else:
                        self.take(arg)
            self.node(inner, kind, arg, "argument")
            self.semicolon(inner)
            return self.node(kids, "use_declaration", inner)
        if self.lang == "php":
            inner = []
            self.take(inner)
            if self.at("function", "const"):
                self.take(inner)
            while not self.at(";") and self.peek().type != "end":
                if self.at(","):
                    self.take(inner)
                    continue
                before = self.i
                self.php_clause(inner)
                if self.at("\\"):
                    self.take(inner)
                if self.at("{"):
                    for c in inner[-1 - (inner[-1].kind == "\\") :]:  # what a group shares is its name, no clause
                        if c.kind == "namespace_use_clause":
                            c.kind = "namespace_name"
                    group: list[Node] = []
                    self.take(group)
                    while not self.at("}", ";") and self.peek().type != "end":
                        at = self.i
                        if not self.at(","):
                            if self.at("function", "const"):
                                self.take(group)
                            self.php_clause(group)
                        if self.i == at:
                            self.take(group)
                    if self.at("}"):
                        self.take(group)
                    self.node(inner, "namespace_use_group", group)
                if self.i == before:
                    self.take(inner)
            self.semicolon(inner)
            return self.node(kids, "namespace_use_declaration", inner)
        return None

    def php_clause(self, kids):
        clause: list[Node] = []
        self.path(clause)
        if self.at("as"):
            self.take(clause)
            self.leaf(clause, "name")
        self.node(kids, "namespace_use_clause", clause)

    def s_using(self, kids):
        if self.lang == "cpp":
            inner: list[Node] = []
            self.take(inner)
            while not self.at(";") and self.peek().type != "end":
                if self.peek().type == "id" and not self.at("namespace"):
                    self.type_name(inner, None)
                else:
                    self.take(inner)
            self.semicolon(inner)
            return self.node(kids, "alias_declaration" if any(c.kind == "=" for c in inner) else "using_declaration", inner)
        if self.lang == "csharp":
            inner = []
            self.take(inner)
            if self.at("("):
                self.condition(inner, None)
                self.body(inner)
                return self.node(kids, "using_statement", inner)
            while self.at("static", "unsafe", "var"):
                self.take(inner)
            if self.peek(1).text == "=":
                self.leaf(inner, "identifier", "name")
                self.take(inner)
                self.path(inner)
            else:
                self.path(inner)
            while not self.at(";") and self.peek().type != "end" and not self.at("}"):
                self.take(inner)
            self.semicolon(inner)
            return self.node(kids, "using_directive", inner)
        return None

    def include(self, kids):
        if self.lang != "php":
            return None
        inner: list[Node] = []
        word = self.take(inner).kind
        self.expression(inner)
        n = self.node([], word + "_expression", inner)
        outer = [n]
        self.semicolon(outer)
        return self.node(kids, "expression_statement", outer)

    s_include = s_include_once = s_require = s_require_once = lambda self, kids: self.include(kids)

    # ---- types, functions and variables of the other languages

    def annotation(self, kids):
        inner: list[Node] = []
        if self.at("["):
            return self.balanced(kids, "attribute_list")
        self.take(inner)
        if self.peek().type == "id":
            self.path(inner, "name")
        if self.at("(") and not self.peek().nl:
            self.balanced(inner, "annotation_argument_list")
        return self.node(kids, "annotation", inner)

    def with_modifiers(self, kids):
        """``public static ...``: the modifiers belong to what follows."""
        if self.c:
            return None
        mods: list[Node] = []
        start = self.i
        while self.peek().text in _MODIFIERS and self.peek().type == "id" and (self.peek(1).type == "id" or self.peek(1).text in ("(", "@", "<", "[", "{", "#")):
            if self.peek(1).text == "(" and self.lang not in ("rust", "kotlin", "swift", "scala"):
                break
            if self.at("case", "var", "new", "enum", "default", "const") and self.lang not in ("scala",) or self.at("case") and self.peek(1).text not in ("class", "object"):
                break
            self.take(mods)
            if self.at("(") and self.lang == "rust" or self.at("[") and self.lang == "scala":
                self.balanced(mods, "visibility_scope")
        if not mods:
            return None
        before = self.i
        out: list[Node] = []
        n = self.statement(out)
        if n is None or self.i == before:
            self.i = start
            return None
        m = self.node([], "visibility_modifier" if self.lang == "rust" else "modifiers", mods)
        n.children.insert(0, m)
        n.start = m.start
        kids += out
        return n

    for _m in "static final abstract synchronized native internal override async unsafe readonly open data inner companion inline suspend operator infix sealed partial virtual export pub fileprivate mutating required convenience implicit lazy declare default external tailrec lateinit transient volatile strictfp actual expect annotation indirect weak unowned".split():
        if "s_" + _m not in locals():
            locals()["s_" + _m] = lambda self, kids: self.with_modifiers(kids)

    def s_package(self, kids):
        inner: list[Node] = []
        self.take(inner)
        if self.peek().type == "id":
            self.path(inner)
        if self.at("{"):
            self.block(inner, "template_body", "body")
        elif self.at(";"):
            self.take(inner)
        return self.node(kids, "package_clause", inner)

    def type_body(self, kids):
        """class, interface, trait, object, struct, impl ...: a head and a body of members."""
        if self.c:
            return None
        inner: list[Node] = []
        word = self.take(inner).kind
        if self.at("class", "object", "interface"):
            word = self.take(inner).kind
        named = False
        depth = 0
        while self.peek().type != "end":
            t = self.peek()
            if depth == 0 and (t.text in ("{", ";", "}") or t.nl and self.lines and named and t.text not in (":", "extends", "with", "implements", "where", "(", "derives")):
                break
            depth += t.text in ("<", "(", "[")
            depth -= t.text in (">", ")", "]")
            if t.type == "id" and t.text not in ("extends", "implements", "with", "where", "for"):
                self.leaf(inner, "type_identifier" if self.lang not in ("csharp", "java", "php", "scala") else "identifier", None if named else "name")
                named = True
            elif t.text == "(" and self.lang in ("kotlin", "scala", "swift", "csharp"):
                depth -= 1
                self.balanced(inner, "class_parameters")
            else:
                self.take(inner)
        if self.at("{"):
            body = {"rust": "declaration_list", "java": "class_body", "kotlin": "class_body", "swift": "class_body", "scala": "template_body", "csharp": "declaration_list", "php": "declaration_list"}.get(self.lang, "class_body")
            if word in ("struct", "enum", "union") and self.lang == "rust":
                self.balanced(inner, "field_declaration_list", "body")
            else:
                self.block(inner, body, "body")
        elif self.at(";"):
            self.take(inner)
        kind = {"impl": "impl_item", "trait": "trait_item" if self.lang == "rust" else "trait_definition" if self.lang == "scala" else "trait_declaration", "mod": "mod_item", "object": "object_definition" if self.lang == "scala" else "object_declaration"}.get(word, word + ("_item" if self.lang == "rust" else "_definition" if self.lang == "scala" else "_declaration"))
        return self.node(kids, kind, inner)

    for _m in "class interface trait object impl mod record protocol extension actor".split():
        locals()["s_" + _m] = lambda self, kids: None if self.lang == "cpp" or self.peek(1).type != "id" and self.peek(1).text not in ("<", "{") else self.type_body(kids)

    def s_struct(self, kids):
        return None if self.c or self.lang == "go" else self.type_body(kids)

    def s_enum(self, kids):
        if self.c:
            return None
        if self.lang in ("java", "csharp") or self.js:
            inner: list[Node] = []
            self.take(inner)
            while not self.at("{", ";", "}") and self.peek().type != "end":
                self.take(inner)
            if self.at("{"):
                self.balanced(inner, "enum_body", "body")
            return self.node(kids, "enum_declaration", inner)
        return self.type_body(kids)

    def s_type(self, kids):
        if self.lang not in ("go", "rust", "typescript", "tsx", "scala") or self.peek(1).type != "id" and self.peek(1).text != "(":
            return None
        inner: list[Node] = []
        self.take(inner)
        depth = 0
        while self.peek().type != "end":
            t = self.peek()
            if depth == 0 and inner[1:] and (t.text in (";", "}") or self.lines and t.nl):
                break
            if t.text in _CLOSE:
                self.balanced(inner, "type_body")
            else:
                self.take(inner)
        return self.node(kids, "type_declaration", inner)

    def function_tail(self, inner: list[Node], body_field: str = "body", kind: str | None = None) -> None:
        """Type parameters, parameters, result, body."""
        if self.at("<") or self.at("[") and self.lang in ("scala", "go"):
            if self.at("<"):
                self.angles(inner, "type_parameters", "type_parameters")
            else:
                self.balanced(inner, "type_parameters", "type_parameters")
        while self.at("("):
            self.balanced(inner, {"rust": "parameters", "scala": "parameters", "go": "parameter_list", "kotlin": "function_value_parameters", "csharp": "parameter_list"}.get(self.lang, "formal_parameters"), "parameters")
        while self.at("throws", "rethrows", "async", "suspend"):
            self.take(inner)
            while self.peek().type == "id" and self.lang == "java" or self.at(",", "."):
                self.take(inner)
        if self.at("->", ":") or self.lang == "go" and not self.at("{") and not self.ended():
            if self.lang == "go":
                self.type_until(inner, ("{",), "result")
            else:
                self.take(inner)
                self.type_until(inner, ("{", "=", "where", ";", "=>"), "return_type")
        if self.at("where"):
            clause: list[Node] = []
            while not self.at("{", ";") and self.peek().type != "end":
                self.take(clause)
            self.node(inner, "where_clause", clause)
        was = self.in_function
        self.in_function = was + 1
        if self.at("{"):
            self.block(inner, kind, field=body_field)
        elif self.at("=", "=>") and self.lang in ("kotlin", "scala", "csharp"):
            self.take(inner)
            wrapper: list[Node] = inner if self.lang == "scala" else []
            if self.at("{"):
                self.block(wrapper, field=body_field)
            else:
                n = self.expression(wrapper, statement=True)
                if n is not None:
                    n.field = body_field
            if wrapper is not inner:
                self.node(inner, "function_body" if self.lang == "kotlin" else "arrow_expression_clause", wrapper, body_field)
            if self.at(";"):
                self.take(inner)
        elif self.at(";"):
            self.take(inner)
        self.in_function = was

    def type_until(self, kids: list[Node], stops: tuple[str, ...], field: str) -> None:
        inner: list[Node] = []
        depth = 0
        while self.peek().type != "end":
            t = self.peek()
            if depth == 0 and (t.text in stops or t.text in ("}", ")", ",") or self.lines and t.nl and inner):
                break
            if t.text in ("(", "["):
                self.balanced(inner, "tuple_type")
                continue
            depth += {"<": 1, ">": -1}.get(t.text, 0)
            if t.text == "{" and depth == 0:
                break
            if t.type == "id":
                self.leaf(inner, "type_identifier")
            else:
                self.take(inner)
        if len(inner) == 1:
            inner[0].field = field
            kids += inner
        elif inner:
            self.node(kids, "type", inner, field)

    def s_fn(self, kids):
        if self.lang != "rust" or self.peek(1).type != "id":
            return None
        inner: list[Node] = []
        self.take(inner)
        self.leaf(inner, "identifier", "name")
        self.function_tail(inner)
        return self.node(kids, "function_item" if inner[-1].kind == "block" else "function_signature_item", inner)

    def s_fun(self, kids):
        if self.lang != "kotlin" or self.peek(1).text == "(":
            return None
        inner: list[Node] = []
        self.take(inner)
        if self.at("<"):
            self.angles(inner, "type_parameters")
        if self.at("interface"):
            return self.type_body(kids)
        while self.peek(1).text in (".", "<", "?"):
            if self.at("<"):
                self.angles(inner, "type_arguments")
            else:
                self.take(inner)
        self.leaf(inner, "identifier", "name")
        self.function_tail(inner)
        return self.node(kids, "function_declaration", inner)

    def s_func(self, kids):
        if self.lang not in ("go", "swift"):
            return None
        inner: list[Node] = []
        if self.lang == "swift":
            self.take(inner)
            self.leaf(inner, "simple_identifier", "name")
            self.function_tail(inner)
            return self.node(kids, "function_declaration", inner)
        if self.peek(1).text == "(" and not (self.toks[self._index(0)].nl and self.depth == 0 and not self.in_function):
            return None
        self.take(inner)
        kind = "function_declaration"
        if self.at("("):
            self.balanced(inner, "parameter_list", "receiver")
            kind = "method_declaration"
        if self.peek().type != "id":
            self.function_tail(inner)
            return self.node(kids, "func_literal", inner)
        self.leaf(inner, "identifier" if kind[0] == "f" else "field_identifier", "name")
        self.function_tail(inner)
        return self.node(kids, kind, inner)

    def s_init(self, kids):
        if self.lang != "swift" or self.peek(1).text not in ("(", "?", "!", "<"):
            return None
        inner: list[Node] = []
        self.take(inner, "name")
        if self.at("?", "!"):
            self.take(inner)
        self.function_tail(inner)
        return self.node(kids, "init_declaration", inner)

    def s_def(self, kids):
        if self.lang != "scala":
            return None
        inner: list[Node] = []
        self.take(inner)
        self.leaf(inner, "identifier", "name")
        self.function_tail(inner)
        return self.node(kids, "function_definition", inner)

    def s_function(self, kids):
        if not self.js and self.lang != "php":
            return None
        if self.peek(1).text == "(" or self.lang == "php" and self.peek(1).text == "&" and self.peek(2).text == "(":
            return None
        return self.js_function(kids, statement=True)

    def js_function(self, kids, statement):
        inner: list[Node] = []
        if self.at("async"):
            self.take(inner)
        self.take(inner)
        star = self.at("*")
        if star or self.at("&"):
            self.take(inner)
        if self.peek().type == "id":
            self.leaf(inner, self.k.identifier, "name")
        self.function_tail(inner)
        if self.lang == "php":
            kind = "method_declaration" if statement and self.in_class else "function_definition" if statement else "anonymous_function"
        else:
            kind = ("generator_function" if star else "function") + ("_declaration" if statement else "_expression" if not star else "")
        return self.node(kids, kind, inner)

    @property
    def in_class(self) -> bool:
        return not self.in_function and self.class_depth > 0

    class_depth = 0

    def variable(self, kids):
        """let / var / val / const."""
        if self.c or self.lang in ("java",) and not self.at("var") or self.peek(1).text in (".", "(") and not (self.lang == "swift"):
            return None
        if self.lang == "php" or self.lang == "csharp" and not self.at("var", "const"):
            return None
        if self.lang == "go" and self.peek(1).text == "(":
            return None
        inner: list[Node] = []
        word = self.take(inner).kind
        if self.lang == "rust":
            self.pattern(inner, ("=", ":", ";"))
            if self.at(":"):
                self.take(inner)
                self.type_until(inner, ("=", ";"), "type")
            if self.at("="):
                self.take(inner)
                n = self.expression(inner)
                if n is not None:
                    n.field = "value"
                if self.at("else"):
                    self.take(inner)
                    if self.at("{"):
                        self.block(inner, field="alternative")
            self.semicolon(inner)
            return self.node(kids, "let_declaration" if word == "let" else word + "_item", inner)
        while True:
            d: list[Node] = []
            if self.peek().type == "id":
                self.leaf(d, self.k.identifier, "name")
            elif self.at("{", "[", "("):
                self.balanced(d, "object_pattern" if self.at("{") else "array_pattern", "name")
            while not self.at("=", ",", ";", "}", "{", ":", ")") and not self.ended():
                self.take(d)
            if self.at(":"):
                self.take(d)
                self.type_until(d, ("=", ";", "{"), "type")
            if self.at("="):
                self.take(d)
                n = self.expression(d)
                if n is not None:
                    n.field = "value"
            elif self.at("{") and self.lang == "swift":
                self.block(d, field="computed_value")
            self.node(inner, "variable_declarator", d)
            if self.at(","):
                self.take(inner)
                continue
            break
        self.semicolon(inner)
        return self.node(kids, "lexical_declaration" if self.js and word != "var" else "variable_declaration" if self.js else "property_declaration", inner)

    s_let = s_var = s_val = s_const = lambda self, kids: self.variable(kids)

    def pattern(self, kids: list[Node], stops: tuple[str, ...]) -> None:
        inner: list[Node] = []
        while not self.at(*stops) and self.peek().type != "end" and not self.at("{") or self.at("{") and inner:
            if self.at("(", "[", "{"):
                self.balanced(inner, "tuple_pattern")
            elif self.peek().type == "id":
                self.leaf(inner, "identifier")
            else:
                self.take(inner)
        if len(inner) == 1:
            inner[0].field = "pattern"
            kids += inner
        elif inner:
            self.node(kids, "tuple_struct_pattern", inner, "pattern")

    def typed_member(self, kids) -> Node | None:
        """Java and C#: ``Type name(...) {``, ``Name(...) {``, ``Type name = ...;``; None if it is something else."""
        n = self.with_modifiers(kids)
        if n is not None:
            return n
        j = 0
        if self.peek().text in ("return", "new", "throw", "await", "this", "base", "super", "yield", "else", "case"):
            return None
        if self.peek(j).type == "id" and self.peek(j + 1).text == "(":
            if self.in_function or not self.body_follows_simple(1):
                return None
            inner: list[Node] = []
            self.leaf(inner, "identifier", "name")
            self.function_tail_c(inner)
            return self.node(kids, "constructor_declaration", inner)
        if self.peek(j).text == "<":
            k = self.skip_angles(j)
            if k is None:
                return None
            j = k
        if self.peek(j).type != "id":
            return None
        j += 1
        while self.peek(j).text == "." and self.peek(j + 1).type == "id":
            j += 2
        if self.peek(j).text == "<":
            k = self.skip_angles(j)
            if k is None:
                return None
            j = k
        while self.peek(j).text in ("[", "]", "?", "*"):
            j += 1
        if self.peek(j).type != "id" or self.peek(j).text in ("instanceof", "is", "as", "in", "switch", "with"):
            return None
        after = self.peek(j + 1).text
        if after == "<":
            k = self.skip_angles(j + 1)
            after = self.peek(k).text if k else ""
        if after not in ("(", "=", ";", ",", "{", ":", "=>"):
            return None
        inner = []
        name_at = self._index(j)
        ty: list[Node] = []
        while self._index(0) < name_at:
            if self.peek().type == "id":
                self.leaf(ty, "type_identifier" if self.lang == "java" else "identifier")
            else:
                self.take(ty)
        if len(ty) == 1:
            ty[0].field = "type" if self.lang == "java" else "returns"
            if self.lang == "java" and ty[0].kind == "type_identifier" and self.source[ty[0].start : ty[0].end] == "void":
                ty[0].kind = "void_type"
            inner += ty
        else:
            self.node(inner, "generic_type", ty, "type" if self.lang == "java" else "returns")
        if after == "(":
            self.leaf(inner, "identifier", "name")
            self.function_tail_c(inner)
            return self.node(kids, "local_function_statement" if self.lang == "csharp" and self.in_function else "method_declaration", inner)
        while True:
            d: list[Node] = []
            self.leaf(d, "identifier", "name")
            while self.at("[", "]"):
                self.take(d)
            if self.at("{"):
                self.block(d, "accessor_list")
            if self.at("=", "=>"):
                self.take(d)
                v = self.initializer_list(d) if self.at("{") else self.expression(d)
                if v is not None:
                    v.field = "value"
            self.node(inner, "variable_declarator", d, "declarator")
            if self.at(","):
                self.take(inner)
                if self.peek().type == "id":
                    continue
            break
        if self.at(";"):
            self.take(inner)
        return self.node(kids, "local_variable_declaration" if self.in_function else "field_declaration", inner)

    def body_follows_simple(self, j: int) -> bool:
        depth, i = 0, self._index(j)
        while i < len(self.toks):
            t = self.toks[i].text
            if self.toks[i].type == "op":
                depth += t == "("
                depth -= t == ")"
                if depth == 0:
                    break
            i += 1
        i += 1
        while i < len(self.toks) and (self.toks[i].type == "com" or self.toks[i].text in ("throws", ",", ".") or self.toks[i].type == "id"):
            i += 1
        return i < len(self.toks) and self.toks[i].text in ("{", ":")

    def function_tail_c(self, inner: list[Node]) -> None:
        if self.at("<"):
            self.angles(inner, "type_parameters")
        if self.at("("):
            self.balanced(inner, "formal_parameters" if self.lang == "java" else "parameter_list", "parameters")
        if self.at(":") and self.lang == "csharp":
            self.take(inner)
            self.take(inner)
            if self.at("("):
                self.arguments(inner)
        self.function_tail(inner)

    # ---- expressions

    def expression(self, kids: list[Node], statement: bool = False, comma: bool = False) -> Node | None:
        """One expression, appended to ``kids``; None if there is none here."""
        n = self.binary(kids, 0)
        if n is None:
            return None
        t = self.peek()
        if t.type == "op" and t.text in _ASSIGN and not (self.lines and self.depth == 0 and t.nl):
            rest: list[Node] = []
            kids.pop()
            n.field = "left"
            self.take(rest, "operator")
            r = self.initializer_list(rest) if self.at("{") and self.lang == "cpp" else self.expression(rest)
            if r is not None:
                r.field = "right"
            n = self.wrap(n, "assignment_expression" if not self.lang == "go" else "short_var_declaration" if t.text == ":=" else "assignment_statement", rest)
            kids.append(n)
        elif t.text == "?" and self.lang not in ("rust", "kotlin", "swift", "go") or t.text == "?" and self.lang == "swift":
            rest = []
            kids.pop()
            n.field = "condition"
            self.take(rest)
            self.depth += 1
            if not self.at(":"):
                m = self.expression(rest)
                if m is not None:
                    m.field = "consequence"
            self.depth -= 1
            if self.at(":"):
                self.take(rest)
                m = self.expression(rest)
                if m is not None:
                    m.field = "alternative"
            n = self.wrap(n, "ternary_expression" if self.js else "conditional_expression", rest)
            kids.append(n)
        if comma:
            while self.at(","):
                rest = []
                kids.pop()
                self.take(rest)
                self.expression(rest)
                n = self.wrap(n, "comma_expression", rest)
                kids.append(n)
        return n

    def binary(self, kids: list[Node], least: int) -> Node | None:
        n = self.unary(kids)
        while n is not None:
            t = self.peek()
            p = _BINARY.get(t.text) if t.type in ("op", "id") else None
            if p is None or p <= least or t.type == "id" and t.text in ("is", "as", "in", "to", "until", "step", "downTo", "instanceof") and not self.word_operator(t.text):
                break
            if self.lines and self.depth == 0 and t.nl and t.text not in ("&&", "||", "??", "?:"):
                break
            if t.text in ("..", "...") and self.lang not in ("rust", "kotlin", "swift"):
                break
            rest: list[Node] = []
            kids.pop()
            n.field = "left"
            self.take(rest, "operator")
            if t.text in ("as", "is", "!is") or t.text == "instanceof":
                m = self.unary(rest)
            else:
                m = self.binary(rest, p if t.text != "**" else p - 1)
            if m is not None:
                m.field = "right"
            n = self.wrap(n, "binary_expression" if t.text != "as" else "type_cast_expression" if self.lang == "rust" else "as_expression", rest)
            kids.append(n)
        return n

    def word_operator(self, word: str) -> bool:
        if word == "in":
            return self.lang in ("kotlin",) + _JS and not self.no_in
        return {"is": self.lang in ("csharp", "kotlin", "swift"), "as": self.lang in ("rust", "kotlin", "swift", "csharp", "typescript", "tsx"), "instanceof": self.js or self.lang in ("java", "php")}.get(word, self.lang in ("kotlin", "scala"))

    no_in = False

    def unary(self, kids: list[Node]) -> Node | None:
        t = self.skim(kids)
        if t.type == "op" and t.text in ("!", "-", "+", "~", "*", "&", "&&", "++", "--", "^", "<-", "...", "@"):
            if t.text == "<-" and self.lang != "go" or t.text == "@" and self.lang != "php":
                return None
            inner: list[Node] = []
            self.take(inner, "operator")
            if t.text in ("&", "&&") and self.at("mut", "raw"):
                self.take(inner)
            n = self.unary(inner)
            if n is not None:
                n.field = "argument"
            kind = "unary_expression"
            if self.c and t.text in ("*", "&"):
                kind = "pointer_expression"
            elif t.text in ("++", "--"):
                kind = "update_expression"
            elif self.lang == "rust" and t.text in ("&", "&&"):
                kind = "reference_expression"
            return self.node(kids, kind, inner)
        if t.type == "id":
            if t.text in ("await", "typeof", "void", "delete", "yield", "throw", "co_await", "try", "defer", "go", "ref", "out", "clone", "print", "echo") and (self.peek(1).type in ("id", "str", "num", "chr") or self.peek(1).text in ("(", "[", "*", "{", "!", "?", "-", "new", "$")) and self.prefix_word(t.text):
                inner = []
                self.take(inner)
                if self.at("?", "!", "*") or self.at("[") and self.lang == "cpp":
                    self.take(inner)
                    if self.at("]"):
                        self.take(inner)
                if not self.ended():
                    n = self.unary(inner)
                    if n is not None:
                        n.field = "argument"
                kind = {"delete": "delete_expression" if self.lang == "cpp" else "unary_expression", "await": "await_expression", "throw": "throw_statement" if self.lang == "cpp" else "throw_expression", "try": "try_expression", "go": "go_statement", "defer": "defer_statement"}.get(t.text, "unary_expression")
                return self.node(kids, kind, inner)
            if t.text == "sizeof" and self.c:
                inner = []
                self.take(inner)
                self.sizeof_argument(inner)
                return self.node(kids, "sizeof_expression", inner)
            if self.c and t.text in ("_Alignof", "alignof", "__alignof__", "__alignof", "_alignof"):
                inner = []
                self.take(inner)
                self.sizeof_argument(inner)
                return self.node(kids, "alignof_expression", inner)
        if self.c and t.text == "(" and self.is_cast():
            inner = []
            self.take(inner)
            d: list[Node] = []
            self.specifiers(d)
            self.declarator(d, abstract=True)
            self.node(inner, "type_descriptor", d, "type")
            self.expect(inner, ")")
            if self.at("{"):
                v = self.initializer_list(inner)
                v.field = "value"
                return self.postfix(kids, self.wrap(None, "compound_literal_expression", inner))
            n = self.unary(inner)
            if n is not None:
                n.field = "value"
            return self.node(kids, "cast_expression", inner)
        if self.lang in ("java", "csharp") and t.text == "(" and self.peek(1).type == "id" and self.is_java_cast():
            inner = []
            self.balanced(inner, "cast_type", "type")
            n = self.unary(inner)
            if n is not None:
                n.field = "value"
            return self.node(kids, "cast_expression", inner)
        return self.primary(kids)

    def prefix_word(self, word: str) -> bool:
        ok = {
            "await": _JS + ("csharp", "swift"),
            "typeof": _JS,
            "void": _JS,
            "delete": _JS + ("cpp",),
            "yield": _JS + ("php", "csharp"),
            "throw": _JS + ("cpp", "kotlin", "swift", "scala", "csharp", "php"),
            "co_await": ("cpp",),
            "try": ("swift",),
            "go": ("go",),
            "defer": ("go",),
            "ref": ("csharp",),
            "out": ("csharp",),
            "clone": ("php",),
            "print": ("php",),
            "echo": ("php",),
        }[word]
        return self.lang in ok and not (self.peek(1).text == "(" and word in ("print", "out", "ref"))

    def sizeof_argument(self, inner: list[Node]) -> None:
        if self.at("(") and self.is_cast():
            self.take(inner)
            d: list[Node] = []
            self.specifiers(d)
            self.declarator(d, abstract=True)
            self.node(inner, "type_descriptor", d, "type")
            self.expect(inner, ")")
        else:
            self.unary(inner)

    def is_cast(self) -> bool:
        """``(type)`` before something that an operator may stand before."""
        j = 1
        first = self.peek(j)
        if first.type != "id":
            return False
        sure = first.text in _C_TYPES or first.text in _C_QUALIFIERS or first.text in ("struct", "union", "enum", "unsigned", "signed", "long", "short")
        stars = 0
        while self.peek(j).type == "id" and self.peek(j).text not in ("sizeof",) or self.peek(j).text in ("*", "::", "**"):
            stars += self.peek(j).text in ("*", "**")
            if self.peek(j).type == "id" and stars and self.peek(j).text not in _C_QUALIFIERS:
                return False
            j += 1
        if sure and self.peek(j).text in ("(", "["):
            return True
        if self.peek(j).text != ")":
            return False
        after = self.peek(j + 1)
        if sure or stars:
            return True
        return j == 2 and (after.type in ("id", "num", "str", "chr") and after.text not in ("and", "or") and first.text.endswith("_t") or after.text == "{")

    def is_java_cast(self) -> bool:
        j = 1
        while self.peek(j).type == "id" or self.peek(j).text in (".", "[", "]", "<", ">", ",", "?"):
            j += 1
        if self.peek(j).text != ")" or self.peek(j + 1).type not in ("id", "str", "num", "chr") and self.peek(j + 1).text != "(":
            return False
        return self.peek(j + 1).text not in ("instanceof", "is", "as", "in") and (self.peek(j + 1).text != "(" or self.peek(1).text in ("int", "long", "double", "float", "byte", "short", "char", "boolean"))

    def primary(self, kids: list[Node]) -> Node | None:
        t = self.skim(kids)
        own: list[Node] = []
        k = self.k
        if t.type == "num":
            n = self.leaf(own, k.number)
        elif t.type == "str":
            n = self.leaf(own, "raw_string_literal" if self.lang == "go" and t.text[0] == "`" else "template_string" if self.js and t.text[0] == "`" else "encapsed_string" if self.lang == "php" and t.text[0] == '"' else k.string)
            while self.c and self.peek().type == "str":
                own = [n]
                self.leaf(own, k.string)
                n = self.wrap(None, "concatenated_string", own)
        elif t.type == "chr":
            n = self.leaf(own, {"rust": "char_literal", "c": "char_literal", "cpp": "char_literal", "go": "rune_literal"}.get(self.lang, "character_literal"))
        elif t.type == "life":
            self.take(own)
            if self.at(":"):
                self.take(own)
                inner: list[Node] = []
                n = self.primary(inner)
                kids += inner
                return n
            n = self.wrap(None, "lifetime", own)
        elif t.text == "(":
            n = self.parenthesized()
            if n is None:
                return None
        elif t.text == "[" and not self.c:
            n = self.array()
        elif t.text == "[" and self.lang == "cpp":
            self.balanced(own, "lambda_capture_specifier", "captures")
            if self.at("("):
                self.parameters(own)
            while not self.at("{") and self.peek().type != "end" and not self.at(";", ")"):
                self.take(own)
            if self.at("{"):
                self.block(own, field="body")
            n = self.wrap(None, "lambda_expression", own)
        elif t.text == "{":
            if self.no_struct and self.lang in ("rust", "go", "swift", "scala"):
                return None
            if self.js:
                n = self.js_object()
            elif self.lang in ("kotlin", "swift"):
                n = self.closure()
            elif self.lang in ("rust", "scala"):
                n = self.block(own, field=None)
            elif self.c or self.lang in ("go", "csharp", "java"):
                n = self.initializer_list(own)
            else:
                return None
        elif t.text in ("|", "||") and self.lang == "rust":
            n = self.rust_closure()
        elif t.text == "." and self.lang in ("swift",):
            self.take(own)
            self.leaf(own, "simple_identifier")
            n = self.wrap(None, "prefix_expression", own)
        elif t.text == "\\" and self.lang == "php":
            n = self.path(own)
        elif t.text in ("..", "..=") and self.lang == "rust":
            self.take(own)
            if not self.ended() and not self.at(")", "]", "{", ","):
                self.binary(own, 9)
            n = self.wrap(None, "range_expression", own)
        elif t.text == "::" and self.lang in ("cpp", "rust"):
            self.take(own)
            self.leaf(own, "identifier", "name")
            n = self.wrap(None, "qualified_identifier" if self.lang == "cpp" else "scoped_identifier", own)
        elif t.text == "<" and self.lang in ("rust", "tsx", "javascript") or t.text == "$" and self.lang == "php":
            if self.lang == "rust" and self.skip_angles(0) is not None:
                self.angles(own, "bracketed_type")
                n = self.wrap(None, "bracketed_type", own)
            else:
                return None
        elif t.type == "id":
            n = self.name_or_keyword(kids)
            if n is None:
                return None
        else:
            return None
        return self.postfix(kids, n)

    def parenthesized(self) -> Node | None:
        if self.js or self.lang in ("csharp", "java", "scala"):
            j, depth = self._index(0), 0
            i = j
            while i < len(self.toks):
                x = self.toks[i]
                if x.type == "op":
                    depth += x.text == "("
                    depth -= x.text == ")"
                    if depth == 0:
                        break
                i += 1
            i += 1
            while i < len(self.toks) and self.toks[i].type == "com":
                i += 1
            after = self.toks[i].text if i < len(self.toks) else ""
            if after in ("=>", "->") and not (after == "->" and self.lang != "java") or after == ":" and self.lang in ("typescript", "tsx") and self.arrow_after_type(i):
                own: list[Node] = []
                self.balanced(own, "formal_parameters", "parameters")
                if self.at(":"):
                    self.take(own)
                    self.type_until(own, ("=>",), "return_type")
                return self.arrow_tail(own)
        own = []
        self.take(own)
        self.depth += 1
        loose, self.no_struct = self.no_struct, False
        while not self.at(")") and self.peek().type != "end" and not self.at("}", ";"):
            before = self.i
            if self.expression(own, comma=self.c) is None and not self.at(","):
                if self.at("{") and self.c:
                    self.block(own)
            if self.at(",", ":"):
                self.take(own)
            if self.i == before:
                self.take(own)
        self.no_struct = loose
        self.depth -= 1
        self.expect(own, ")")
        named = sum(c.named for c in own)
        return self.wrap(None, "parenthesized_expression" if named == 1 and not any(c.kind == "," for c in own) or self.c else "tuple_expression", own)

    def arrow_after_type(self, i: int) -> bool:
        while i < len(self.toks) and self.toks[i].text not in (";", "{", "}", ")", ","):
            if self.toks[i].text == "=>":
                return True
            i += 1
        return False

    def arrow_tail(self, own: list[Node]) -> Node:
        self.take(own)
        was, self.in_function = self.in_function, self.in_function + 1
        depth = self.depth
        if self.at("{"):
            self.block(own, field="body")
        else:
            n = self.expression(own)
            if n is not None:
                n.field = "body"
        self.depth, self.in_function = depth, was
        return self.wrap(None, "arrow_function" if self.js else "lambda_expression", own)

    def array(self) -> Node:
        own: list[Node] = []
        self.take(own)
        self.depth += 1
        loose, self.no_struct = self.no_struct, False
        while not self.at("]") and self.peek().type != "end" and not self.at("}"):
            before = self.i
            self.expression(own)
            if self.at(",", ";", ":", "=>"):
                self.take(own)
            if self.i == before:
                self.take(own)
        self.no_struct = loose
        self.depth -= 1
        self.expect(own, "]")
        return self.wrap(None, "array" if self.js else "array_expression", own)

    def js_object(self) -> Node:
        own: list[Node] = []
        self.take(own)
        self.depth += 1
        while not self.at("}") and self.peek().type != "end":
            before = self.i
            if self.at(","):
                self.take(own)
            elif self.at("..."):
                self.expression(own)
            elif self.js_method(own) is not None:
                pass
            else:
                pair: list[Node] = []
                if self.at("["):
                    self.balanced(pair, "computed_property_name", "key")
                elif self.peek().type == "id":
                    self.leaf(pair, "property_identifier", "key")
                elif self.peek().type in ("str", "num"):
                    self.leaf(pair, "string" if self.peek().type == "str" else "number", "key")
                if self.at(":"):
                    self.take(pair)
                    v = self.expression(pair)
                    if v is not None:
                        v.field = "value"
                    self.node(own, "pair", pair)
                elif pair:
                    pair[0].field = None
                    own += pair
            if self.i == before:
                self.take(own)
        self.depth -= 1
        self.expect(own, "}")
        return self.wrap(None, "object", own)

    def js_method(self, kids: list[Node]) -> Node | None:
        """``name(...) {`` and the like in a class or object."""
        j = 0
        while self.peek(j).text in ("async", "get", "set", "static", "*", "public", "private", "protected", "readonly", "override", "abstract") and (self.peek(j + 1).type in ("id", "str") or self.peek(j + 1).text in ("[", "*")):
            j += 1
        if self.peek(j).type not in ("id", "str", "num") or self.peek(j).text in ("function", "if", "for", "while", "switch", "return"):
            return None
        after = j + 1
        if self.peek(after).text in ("?", "!"):
            after += 1
        if self.peek(after).text == "<":
            after = self.skip_angles(after) or after
        if self.peek(after).text != "(":
            return None
        i, depth = self._index(after), 0
        while i < len(self.toks):
            x = self.toks[i]
            if x.type == "op":
                depth += x.text == "("
                depth -= x.text == ")"
                if depth == 0:
                    break
            i += 1
        nxt = self.toks[min(i + 1, len(self.toks) - 1)].text
        if nxt != "{" and not (nxt == ":" and self.lang != "javascript"):
            return None
        inner: list[Node] = []
        for _ in range(j):
            self.take(inner)
        self.leaf(inner, "property_identifier", "name")
        if self.at("?", "!"):
            self.take(inner)
        depth, self.depth = self.depth, 0
        self.function_tail(inner)
        self.depth = depth
        return self.node(kids, "method_definition" if inner[-1].kind == "statement_block" else "method_signature", inner)

    def closure(self) -> Node:
        own: list[Node] = []
        self.block(own, "lambda_literal")
        return own[0]

    def rust_closure(self) -> Node:
        own: list[Node] = []
        params: list[Node] = []
        if self.at("||"):
            self.take(params)
        else:
            self.take(params)
            while not self.at("|") and self.peek().type != "end":
                self.take(params)
            self.expect(params, "|")
        self.node(own, "closure_parameters", params, "parameters")
        if self.at("->"):
            self.take(own)
            self.type_until(own, ("{",), "return_type")
        n = self.expression(own)
        if n is not None:
            n.field = "body"
        return self.wrap(None, "closure_expression", own)

    def name_or_keyword(self, kids: list[Node]) -> Node | None:
        t = self.peek()
        own: list[Node] = []
        k = self.k
        lang = self.lang
        if lang in ("rust", "kotlin", "scala", "swift") and t.text in ("if", "while", "for", "loop", "return", "break", "continue") and not (t.text == "loop" and lang != "rust"):
            n = {"if": self.s_if, "while": self.s_while, "for": self.s_for, "loop": self.s_loop}.get(t.text)
            if n is not None:
                got = n(own)
                if got is not None:
                    return got
            else:
                self.take(own)
                if not self.ended() and not self.at(")", ",", "]", "=>"):
                    self.expression(own)
                return self.wrap(None, {"return": k.return_, "break": k.break_, "continue": k.continue_}[t.text], own)
        if t.text in ("match", "when", "switch") and (lang in ("rust", "scala", "kotlin", "swift", "php") or lang in ("java", "csharp")) and self.peek(1).text in ("(", "{") or t.text == "match" and lang == "rust":
            self.take(own)
            if self.at("("):
                self.condition(own, "value")
            elif not self.at("{"):
                loose, self.no_struct = self.no_struct, True
                self.expression(own)
                self.no_struct = loose
            if self.at("{"):
                self.match_arms(own)
            return self.wrap(None, "match_expression" if lang in ("rust", "scala", "php") else t.text + "_expression", own)
        if t.text in ("unsafe", "async", "const", "do") and lang in ("rust", "swift") and self.peek(1).text in ("{", "move"):
            self.take(own)
            if self.at("move"):
                self.take(own)
            if self.at("{"):
                self.block(own)
            return self.wrap(None, t.text + "_block", own)
        if t.text == "move" and lang == "rust" and self.peek(1).text in ("|", "||"):
            self.take(own)
            c = self.rust_closure()
            return self.wrap(None, "closure_expression", own + c.children)
        if t.text == "async" and self.js and self.peek(1).text in ("function", "("):
            if self.peek(1).text == "function":
                return self.js_function(own, False)
            self.take(own)
            n = self.parenthesized()
            if n is not None and n.kind == "arrow_function":
                return self.wrap(None, "arrow_function", own + n.children)
            return n
        if t.text in ("function", "fn") and (self.js or lang == "php"):
            if t.text == "fn" and lang == "php":
                self.take(own)
                if self.at("("):
                    self.balanced(own, "formal_parameters")
                if self.at("=>"):
                    self.take(own)
                    self.expression(own)
                return self.wrap(None, "arrow_function", own)
            return self.js_function(own, False)
        if t.text == "func" and lang == "go":
            self.take(own)
            self.function_tail(own)
            return self.wrap(None, "func_literal", own)
        if t.text == "fun" and lang == "kotlin":
            self.take(own)
            self.function_tail(own)
            return self.wrap(None, "anonymous_function", own)
        if t.text == "class" and self.js:
            return self.type_body(own)
        if t.text == "new" and (lang in ("cpp", "java", "csharp", "php") or self.js or lang == "scala"):
            self.take(own)
            ty: list[Node] = []
            if self.peek().type == "id" or self.at("\\"):
                self.type_reference(ty)
                if ty:
                    ty[0].field = "type" if not self.js else "constructor"
                    own += ty
            while self.at("["):
                self.balanced(own, "array_rank")
            if self.at("("):
                self.arguments(own)
            if self.at("{") and lang in ("java", "csharp", "php", "scala"):
                if lang == "java" and own[-1].kind != "array_rank":
                    was, self.in_function = self.in_function, 0
                    self.block(own, "class_body")
                    self.in_function = was
                else:
                    self.initializer_list(own)
            return self.wrap(None, "new_expression" if lang == "cpp" or self.js else "instance_expression" if lang == "scala" else "object_creation_expression", own)
        if t.text == "_Generic" and self.c:
            self.take(own)
            if self.at("("):
                self.balanced(own, "generic_associations")
            return self.wrap(None, "generic_expression", own)
        if t.text in ("nullptr", "NULL") and self.c:
            n = self.leaf(own, "null")
            return n
        if self.js and self.peek(1).text == "=>":
            self.leaf(own, "identifier", "parameter")
            return self.arrow_tail(own)
        if lang in ("csharp", "java") and self.peek(1).text in ("=>", "->") and not (lang == "csharp" and self.peek(1).text == "->"):
            self.leaf(own, "identifier", "parameters")
            return self.arrow_tail(own)
        if t.text in ("else", "in", "of", "case", "then", "until", "is", "as") and t.type == "id" and not self.js and lang not in ("go", "csharp", "java", "c", "cpp", "php"):
            return None
        if t.text == "else":
            return None
        if t.text in ("this", "self", "super", "base", "true", "false", "null", "nil"):
            n = self.leaf(own, {"this": "this", "self": "self", "super": "super"}.get(t.text, t.text if t.text in ("true", "false", "null", "nil") else "base"))
            if lang == "rust" and t.text == "self" and self.at("::"):
                n.kind = "identifier"
            return n
        if lang == "php" and t.text.startswith("$"):
            return self.leaf(own, "variable_name")
        n = self.leaf(own, k.identifier)
        if lang == "rust" and self.at("!") and self.peek(1).text in ("(", "[", "{") and not self.peek(1).nl:
            own = [n]
            self.take(own)
            self.balanced(own, "token_tree")
            return self.wrap(None, "macro_invocation", own)
        if lang == "rust" and self.at("{") and not self.no_struct and t.text[:1].isupper():
            return self.rust_struct(n)
        if lang == "go" and self.at("{") and not self.no_struct and not self.peek().nl:
            own = [n]
            self.initializer_list(own)
            return self.wrap(None, "composite_literal", own)
        return n

    def rust_struct(self, n: Node) -> Node:
        own = [n]
        inner: list[Node] = []
        self.take(inner)
        self.depth += 1
        while not self.at("}") and self.peek().type != "end":
            before = self.i
            self.expression(inner)
            if self.at(":", ",", ".."):
                self.take(inner)
            if self.i == before:
                self.take(inner)
        self.depth -= 1
        self.expect(inner, "}")
        self.node(own, "field_initializer_list_", inner, "body")
        own[-1].kind = "struct_fields"
        return self.wrap(None, "struct_expression", own)

    def type_reference(self, kids: list[Node]) -> None:
        """The type after ``new``."""
        own: list[Node] = []
        if self.lang == "cpp":
            self.specifiers(own) if self.peek(1).text != "(" else self.type_name(own, None)
            kids += own[:1]
            return
        if self.lang == "php":
            self.path(kids) if not self.peek().text.startswith("$") else self.leaf(kids, "variable_name")
            return
        n = self.leaf(own, "type_identifier" if self.lang == "java" else "identifier")
        while self.at(".", "::") and self.peek(1).type == "id":
            self.take(own)
            self.leaf(own, "type_identifier" if self.lang == "java" else "identifier")
        if len(own) > 1:
            n = self.wrap(None, {"java": "scoped_type_identifier", "csharp": "qualified_name"}.get(self.lang, "member_expression"), own)
        if self.at("<") and self.skip_angles(0) is not None:
            own = [n]
            self.angles(own, "type_arguments")
            n = self.wrap(None, "generic_type" if self.lang == "java" else "generic_name", own)
        kids.append(n)

    def match_arms(self, kids: list[Node]) -> None:
        inner: list[Node] = []
        self.take(inner)
        depth, self.depth = self.depth, 0
        while not self.at("}") and self.peek().type != "end":
            before = self.i
            arm: list[Node] = []
            stops = ("=>", "->", ":") if self.lang != "kotlin" else ("->",)
            while not self.at(*stops) and not self.at("}") and self.peek().type != "end":
                if self.at("(", "[", "{"):
                    self.balanced(arm, "pattern")
                elif self.at("if"):
                    self.take(arm)
                    loose, self.no_struct = self.no_struct, True
                    self.expression(arm)
                    self.no_struct = loose
                elif self.peek().type == "id":
                    self.leaf(arm, "identifier")
                else:
                    self.take(arm)
            if self.at(*stops):
                self.take(arm)
                if self.at("{"):
                    self.block(arm, field="value")
                elif not self.at("}", "case"):
                    if self.lang in ("scala", "swift"):
                        while not self.at("case", "default", "}") and self.peek().type != "end":
                            was = self.i
                            self.statement(arm)
                            if self.i == was:
                                break
                    else:
                        n = self.expression(arm) if self.lang != "java" else self.statement(arm)
                        if n is not None:
                            n.field = "value"
            if self.at(",", ";"):
                self.take(arm)
            if arm:
                self.node(inner, "match_arm", arm)
            if self.i == before:
                self.take(inner)
        self.depth = depth
        self.expect(inner, "}")
        self.node(kids, "match_block", inner, "body")

    def arguments(self, kids: list[Node]) -> Node:
        inner: list[Node] = []
        self.take(inner)
        self.depth += 1
        loose, self.no_struct = self.no_struct, False
        while not self.at(")") and self.peek().type != "end" and not (self.at("}", ";")):
            before = self.i
            if self.at(","):
                self.take(inner)
                continue
            if self.peek(1).text == ":" and self.peek().type == "id" and self.lang in ("swift", "csharp", "php") or self.peek(1).text == "=" and self.lang in ("kotlin", "scala"):
                self.leaf(inner, "argument_label")
                self.take(inner)
            if self.peek().type == "pp":
                self.preprocessor(inner)
            elif self.c and self.peek().text in ("struct", "unsigned") or self.c and self.peek().text in _C_TYPES and self.peek(1).text in ("*", ",", ")"):
                d: list[Node] = []
                self.specifiers(d)
                self.declarator(d, abstract=True)
                self.node(inner, "type_descriptor", d)
            else:
                self.expression(inner)
            if self.i == before:
                self.take(inner)
        self.no_struct = loose
        self.depth -= 1
        self.expect(inner, ")")
        return self.node(kids, self.k.arguments, inner, "arguments")

    def postfix(self, kids: list[Node], n: Node) -> Node:
        lang, k = self.lang, self.k
        while True:
            t = self.peek()
            if t.type not in ("op",) or self.lines and self.depth == 0 and t.nl and t.text not in (".", "?."):
                break
            own = [n]
            if t.text == "(" and n.kind not in (k.number,):
                if lang == "java":
                    if n.kind in ("identifier", "this", "super"):
                        n.field = "name"
                        self.arguments(own)
                        n = self.wrap(None, "method_invocation", own)
                    elif n.kind == "field_access":
                        obj = n.children
                        name = obj[-1]
                        name.field, name.kind = "name", "identifier"
                        obj[0].field = "object"
                        self.arguments(obj)
                        n = self.wrap(None, "method_invocation", obj)
                    else:
                        self.arguments(own)
                        n = self.wrap(None, "method_invocation", own)
                    continue
                if lang == "php" and n.kind in ("member_access_expression", "class_constant_access_expression"):
                    self.arguments(n.children)
                    n = self.wrap(None, "member_call_expression" if n.kind[0] == "m" else "scoped_call_expression", n.children)
                    continue
                if lang not in ("kotlin", "swift"):
                    n.field = "function"
                    if lang == "php" and n.kind == "name":
                        pass
                self.call_suffix(own)
                n = self.wrap(None, k.call, own)
            elif t.text == "{" and lang in ("kotlin", "swift") and not self.no_struct and not t.nl and n.kind in (k.identifier, k.call, k.member):
                lam = self.closure()
                if n.kind == k.call and lang == "kotlin":
                    n.children.append(self.wrap(None, "annotated_lambda", [lam]))
                    n.end = lam.end
                else:
                    n = self.wrap(n, k.call, [self.wrap(None, "annotated_lambda" if lang == "kotlin" else "call_suffix", [lam])])
            elif t.text in (".", "->", "?.", "::") or t.text == "?" and self.peek(1).text == "." and lang == "swift":
                if t.text == "->" and not (self.c or lang == "php"):
                    break
                if t.text == "::" and lang in ("rust", "cpp"):
                    if self.peek(1).text == "<":
                        self.take(own)
                        self.angles(own, "type_arguments", "type_arguments")
                        n.field = "function"
                        n = self.wrap(None, "generic_function", own)
                        continue
                    if lang == "cpp" and n.kind == "identifier":
                        n.kind = "namespace_identifier"
                    n.field = "path" if lang == "rust" else "scope"
                    self.take(own)
                    if self.peek().type == "id":
                        self.leaf(own, "identifier", "name")
                    elif self.at("~"):
                        self.take(own)
                    n = self.wrap(None, "scoped_identifier" if lang == "rust" else "qualified_identifier", own)
                    if lang == "rust" and self.at("{") and not self.no_struct and self.source[own[-1].start : own[-1].start + 1].isupper():
                        n = self.rust_struct(n)
                    continue
                if t.text == "::" and lang not in ("php", "kotlin", "java"):
                    break
                if t.text == "?" :
                    self.take(own)
                self.take(own)
                if self.at("?") and lang == "csharp":
                    self.take(own)
                n.field = {"c": "argument", "cpp": "argument", "rust": "value", "go": "operand", "scala": "value", "csharp": "expression", "swift": "target"}.get(lang, "object")
                if self.peek().type in ("id", "num"):
                    if lang == "rust" and self.at("await"):
                        self.take(own)
                        n = self.wrap(None, "await_expression", own)
                        continue
                    self.leaf(own, {"c": "field_identifier", "cpp": "field_identifier", "rust": "field_identifier", "go": "field_identifier", "php": "name"}.get(lang, "property_identifier" if self.js else "simple_identifier" if lang == "swift" else "identifier"), "field" if k.member == "field_expression" or lang in ("go",) else "property" if self.js else "name")
                elif self.at("(") and lang == "go":
                    self.balanced(own, "type_assertion")
                elif self.at("{") and lang == "php":
                    self.balanced(own, "name_expression")
                elif self.at("(") and self.js:
                    n.field = "function"
                    self.arguments(own)
                    n = self.wrap(None, k.call, own)
                    continue
                elif self.at("[") and self.js:
                    continue
                n = self.wrap(None, "class_constant_access_expression" if t.text == "::" and lang == "php" else "method_reference" if t.text == "::" and lang == "java" else "callable_reference" if t.text == "::" and lang == "kotlin" else k.member, own)
            elif t.text == "[" and not (lang == "cpp" and self.peek(1).text == "["):
                if self.no_struct and False:
                    break
                n.field = "argument"
                self.take(own)
                self.depth += 1
                while not self.at("]") and self.peek().type != "end" and not self.at("}", ";"):
                    before = self.i
                    self.expression(own)
                    if self.at(",", ":"):
                        self.take(own)
                    if self.i == before:
                        self.take(own)
                self.depth -= 1
                self.expect(own, "]")
                n = self.wrap(None, {"rust": "index_expression", "go": "index_expression", "java": "array_access", "csharp": "element_access_expression"}.get(lang, "subscript_expression"), own)
                if lang == "scala":
                    n.kind = "generic_function"
            elif t.text in ("++", "--") and not t.nl:
                n.field = "argument"
                self.take(own)
                n = self.wrap(None, "update_expression" if self.c or self.js or lang == "java" else "postfix_expression", own)
            elif t.text == "?" and lang == "rust":
                self.take(own)
                n = self.wrap(None, "try_expression", own)
            elif t.text in ("!", "!!") and lang in ("kotlin", "swift", "typescript", "tsx") and not self.peek(1).text == "=" and (self.peek(1).type == "op"):
                self.take(own)
                if lang == "kotlin" and self.at("!"):
                    self.take(own)
                n = self.wrap(None, "postfix_expression" if lang in ("kotlin", "swift") else "non_null_expression", own)
            elif t.text == "<" and lang in ("cpp", "java", "csharp", "kotlin", "swift", "typescript", "tsx") and n.kind in (k.identifier, k.member, "qualified_identifier") and (j := self.skip_angles(0)) is not None and self.peek(j).text in ("(", "{") + (("::",) if lang == "cpp" else ()):
                if self.peek(j).text == "{" and lang not in ("cpp",):
                    break
                self.angles(own, "type_arguments" if lang != "cpp" else "template_argument_list", "type_arguments")
                if lang == "cpp":
                    n = self.wrap(None, "template_function", own)
                elif lang == "csharp":
                    n = self.wrap(None, "generic_name", own)
                else:
                    rest = own[1:]
                    if lang not in ("kotlin", "swift"):
                        n.field = "function"
                    own = [n] + rest
                    if self.at("("):
                        if lang == "java":
                            n.field = "name"
                        self.call_suffix(own)
                    n = self.wrap(None, k.call, own)
            elif t.text == "{" and self.lang == "go" and not self.no_struct and n.kind == "selector_expression" and not t.nl:
                self.initializer_list(own)
                n = self.wrap(None, "composite_literal", own)
            else:
                break
        kids.append(n)
        return n

    def call_suffix(self, own: list[Node]) -> None:
        if self.lang == "swift":
            inner: list[Node] = []
            self.arguments(inner)
            self.node(own, "call_suffix", inner)
        else:
            self.arguments(own)


def _class_bodies(p: Parser) -> None:
    """Members of classes in JavaScript and PHP are told from statements by where they stand."""
    plain = p.type_body

    def type_body(kids):
        p.class_depth += 1
        was, p.in_function = p.in_function, 0
        out = plain(kids)
        p.in_function = was
        p.class_depth -= 1
        return out

    p.type_body = type_body
    statement = p.statement

    def member(kids, field=None):
        if p.js and p.in_class and p.depth == 0:
            p.skim(kids)
            n = p.js_method(kids)
            if n is not None:
                return n
            if p.peek().type == "id" and p.peek(1).text in ("=", ":", ";", "?") or p.at("static", "private", "public", "protected", "readonly") and p.peek(1).type == "id":
                inner: list[Node] = []
                while p.at("static", "private", "public", "protected", "readonly", "declare", "override") and p.peek(1).type == "id":
                    p.take(inner)
                p.leaf(inner, "property_identifier", "name" if p.lang != "javascript" else "property")
                if p.at("?", "!"):
                    p.take(inner)
                if p.at(":"):
                    p.take(inner)
                    p.type_until(inner, ("=", ";"), "type")
                if p.at("="):
                    p.take(inner)
                    v = p.expression(inner)
                    if v is not None:
                        v.field = "value"
                p.semicolon(inner)
                return p.node(kids, "public_field_definition" if p.lang != "javascript" else "field_definition", inner)
        return statement(kids, field)

    if p.js:
        p.statement = member


def parse_braces(source: str, lang: str) -> Node:
    p = Parser(source, lang)
    if p.js or lang == "php":
        _class_bodies(p)
    return p.parse()
