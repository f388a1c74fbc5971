"""Python by indentation; Lua, Ada and Fortran by keywords. Expressions are sequences of operands and operator tokens."""

from __future__ import annotations

from codeloom.syntax.lexer import tokens
from codeloom.syntax.tree import Node, close

_CLOSE = {"(": ")", "[": "]", "{": "}"}


class Base:
    fold = False  # keywords in any case
    identifier = "identifier"

    def __init__(self, source: str, lang: str):
        self.source, self.lang = source, lang
        self.toks = tokens(source, lang)
        self.i = 0
        self.last = 0

    def skim(self, kids):
        while self.toks[self.i].type == "com":
            t = self.toks[self.i]
            kids.append(Node("comment", t.start, t.end))
            self.i += 1
        return self.toks[self.i]

    def peek(self, ahead=0):
        i = self.i
        while True:
            while self.toks[i].type == "com":
                i += 1
            if not ahead or self.toks[i].type == "end":
                return self.toks[i]
            ahead -= 1
            i += 1

    def word(self, ahead=0):
        t = self.peek(ahead)
        return "" if t.type in ("str", "chr", "end") else t.text.lower() if self.fold else t.text

    def at(self, *texts):
        return self.word() in texts

    def over(self):
        return self.peek().type == "end"

    def leaf(self, kids, kind=None, field=None):
        t = self.skim(kids)
        n = Node(kind or (t.text.lower() if self.fold else t.text) or "ERROR", t.start, t.end, kind is not None, field)
        if t.type != "end":
            self.i += 1
            self.last = t.end
            kids.append(n)
        return n

    def node(self, kids, kind, children, field=None, error=False):
        n = close(Node(kind, field=field, children=children, error=error), self.last)
        kids.append(n)
        return n

    def literal(self, kids, field=None):
        t = self.peek()
        return self.leaf(kids, {"num": "number", "str": "string", "chr": "character_literal"}.get(t.type), field)


class Python(Base):
    """Statements are lines; a deeper column opens a block."""

    def column(self, t):
        begin = self.source.rfind("\n", 0, t.start) + 1
        return len(self.source[begin : t.start].expandtabs(8))

    def parse(self):
        kids = []
        while not self.over():
            before = self.i
            self.statement(kids)
            if self.i == before:
                self.node(kids, "ERROR", [self.leaf([])], error=True)
        self.skim(kids)
        return Node("module", 0, len(self.source), children=kids)

    def ended(self):
        t = self.peek()
        return t.type == "end" or t.text == ";" or t.nl

    def suite(self, kids, indent):
        """After a colon: the rest of the line, or the deeper lines."""
        inner = []
        if not self.ended():
            self.simple_line(inner)
        else:
            t = self.peek()
            own = self.column(t)
            if t.type != "end" and own > indent:
                while not self.over() and self.column(self.peek()) >= own:
                    before = self.i
                    self.statement(inner)
                    if self.i == before:
                        break
        return self.node(kids, "block", inner, "body")

    def statement(self, kids):
        t = self.skim(kids)
        if t.type == "end":
            return
        indent = self.column(t)
        w = self.word()
        if w == "async" and self.word(1) in ("def", "for", "with"):
            w = self.word(1)
        if w == "@":
            inner = []
            while self.at("@"):
                d = []
                self.leaf(d)
                self.line(d)
                self.node(inner, "decorator", d)
            self.statement(inner)
            self.node(kids, "decorated_definition", inner)
        elif w in ("def", "class"):
            inner = []
            if self.at("async"):
                self.leaf(inner)
            self.leaf(inner)
            if self.peek().type == "id":
                self.leaf(inner, "identifier", "name")
            if self.at("["):
                self.group(inner, "type_parameter")
            if self.at("("):
                self.group(inner, "parameters" if w == "def" else "argument_list", "parameters")
            if self.at("->"):
                self.leaf(inner)
                ty = []
                while not self.at(":") and not self.ended():
                    self.operand(ty)
                self.node(inner, "type", ty, "return_type")
            if self.at(":"):
                self.leaf(inner)
            self.suite(inner, indent)
            self.node(kids, "function_definition" if w == "def" else "class_definition", inner)
        elif w in ("if", "while", "for", "try", "with", "match") and self.compound(w):
            inner = []
            self.clause(inner, indent)
            while self.at("elif", "else", "except", "finally") and not self.over() and self.column(self.peek()) == indent and self.peek().nl:
                c = []
                k = self.word()
                self.clause(c, indent)
                self.node(inner, k + "_clause", c, "alternative" if k in ("elif", "else") else None)
            self.node(kids, w + "_statement", inner)
        elif w == "case" and self.compound(w):
            inner = []
            self.clause(inner, indent)
            self.node(kids, "case_clause", inner)
        else:
            self.simple_line(kids)

    def compound(self, w):
        """``match`` and ``case`` are names too: a line that ends with a colon makes them keywords."""
        if w not in ("match", "case"):
            return True
        i, depth, last = self.i + 1, 0, None
        while self.toks[i].type != "end" and not (self.toks[i].nl and depth == 0):
            depth += self.toks[i].text in _CLOSE
            depth -= self.toks[i].text in (")", "]", "}")
            last = self.toks[i].text if self.toks[i].type != "com" else last
            i += 1
        return last == ":" or w == "case" and last is not None

    def clause(self, inner, indent):
        if self.at("async"):
            self.leaf(inner)
        self.leaf(inner)
        n = len(inner)
        while not self.at(":") and not self.ended():
            self.operand(inner)
        if len(inner) == n + 1:
            inner[n].field = "condition"
        if self.at(":"):
            self.leaf(inner)
        self.suite(inner, indent)

    def simple_line(self, kids):
        while True:
            self.simple(kids)
            if self.at(";"):
                self.leaf(kids)
                if not self.ended():
                    continue
            return

    def simple(self, kids):
        w = self.word()
        inner = []
        if w == "import":
            self.leaf(inner)
            while not self.ended():
                if self.peek().type == "id":
                    self.import_name(inner)
                else:
                    self.leaf(inner)
            self.node(kids, "import_statement", inner)
        elif w == "from" and self.word(1) != "":
            self.leaf(inner)
            if self.at(".", "..", "..."):
                r = []
                while self.at(".", "..", "..."):
                    self.leaf(r)
                if self.peek().type == "id" and not self.at("import"):
                    self.dotted(r)
                self.node(inner, "relative_import", r, "module_name")
                kind = "import_from_statement"
            else:
                n = self.dotted(inner, "module_name")
                kind = "future_import_statement" if self.source[n.start : n.end] == "__future__" else "import_from_statement"
            if self.at("import"):
                self.leaf(inner)
            closer = self.at("(")
            while not self.over() and (closer or not self.ended()):
                if self.peek().type == "id":
                    self.import_name(inner)
                else:
                    closer = closer and not self.at(")")
                    self.leaf(inner, "wildcard_import" if self.at("*") else None)
            self.node(kids, kind, inner)
        else:
            kind = {"return": "return_statement", "break": "break_statement", "continue": "continue_statement", "raise": "raise_statement", "pass": "pass_statement", "assert": "assert_statement", "del": "delete_statement", "global": "global_statement", "nonlocal": "nonlocal_statement"}.get(w, "expression_statement")
            self.line(inner)
            self.node(kids, kind, inner)

    def import_name(self, kids):
        n = []
        self.dotted(n)
        if self.at("as"):
            n[0].field = "name"
            self.leaf(n)
            self.leaf(n, "identifier", "alias")
            self.node(kids, "aliased_import", n, "name")
        else:
            n[0].field = "name"
            kids += n

    def dotted(self, kids, field=None):
        d = []
        self.leaf(d, "identifier")
        while self.at(".") and self.peek(1).type == "id":
            self.leaf(d)
            self.leaf(d, "identifier")
        return self.node(kids, "dotted_name", d, field)

    def line(self, kids):
        self.operand(kids)
        while not self.ended():
            self.operand(kids)

    def operand(self, kids):
        t = self.skim(kids)
        w = self.word()
        own = []
        if t.type in ("num", "str"):
            n = self.literal(own)
        elif t.text in _CLOSE:
            n = self.group(own, {"(": "parenthesized_expression", "[": "list", "{": "dictionary"}[t.text])
        elif t.type == "id" and w == "lambda":
            self.leaf(own)
            p = []
            while not self.at(":") and not self.over():
                self.leaf(p, "identifier" if self.peek().type == "id" else None)
            self.node(own, "lambda_parameters", p, "parameters")
            if self.at(":"):
                self.leaf(own)
            self.operand(own)
            n = self.node([], "lambda", own)
        elif t.type == "id" and w not in ("and", "or", "not", "in", "is", "if", "else", "for", "return", "raise", "yield", "await", "assert", "del", "global", "nonlocal", "pass", "break", "continue", "as", "from", "async", "import"):
            n = self.leaf(own, "identifier")
        else:
            self.leaf(kids)
            return
        while True:
            t = self.peek()
            if t.nl and not self.depth:
                break
            own = [n]
            if t.text == "(" and t.type == "op":
                n.field = "function"
                self.group(own, "argument_list", "arguments")
                n = self.node([], "call", own)
            elif t.text == "." and self.peek(1).type == "id":
                n.field = "object"
                self.leaf(own)
                self.leaf(own, "identifier", "attribute")
                n = self.node([], "attribute", own)
            elif t.text == "[" and t.type == "op":
                n.field = "value"
                self.group(own, "subscript_index")
                n = self.node([], "subscript", own)
            else:
                break
        kids.append(n)

    depth = 0

    def group(self, kids, kind, field=None):
        inner = []
        stop = _CLOSE[self.leaf(inner).kind]
        self.depth += 1
        while not self.at(stop) and not self.over():
            before = self.i
            self.operand(inner)
            if self.i == before:
                self.leaf(inner)
        self.depth -= 1
        ok = self.at(stop)
        self.leaf(inner)
        return self.node(kids, kind, inner, field, error=not ok)


class Lua(Base):
    def parse(self):
        kids = []
        self.statements(kids, ())
        while not self.over():
            self.node(kids, "ERROR", [self.leaf([])], error=True)
            self.statements(kids, ())
        self.skim(kids)
        return Node("chunk", 0, len(self.source), children=kids)

    def statements(self, kids, stops):
        while not self.over() and not self.at(*stops, "end", "until", "else", "elseif"):
            before = self.i
            self.statement(kids)
            if self.i == before:
                self.leaf(kids)

    def block(self, kids, *stops):
        inner = []
        self.skim(inner)
        self.statements(inner, stops)
        if inner:
            self.node(kids, "block", inner, "body")

    def function(self, kids, kind, named):
        self.leaf(kids)
        if named and self.peek().type == "id":
            own = []
            n = self.leaf(own, "identifier")
            while self.at(".", ":") and self.peek(1).type == "id":
                method = self.at(":")
                n.field = "table"
                self.leaf(own)
                self.leaf(own, "identifier", "method" if method else "field")
                n = self.node([], "method_index_expression" if method else "dot_index_expression", own)
                own = [n]
            n.field = "name"
            kids.append(n)
        if self.at("("):
            self.group(kids, "parameters", "parameters")
        self.block(kids)
        ok = self.at("end")
        if ok:
            self.leaf(kids)
        return self.node([], kind, kids, error=not ok)

    def statement(self, kids):
        self.skim(kids)
        w, inner = self.word(), []
        if w == ";":
            self.leaf(kids)
        elif w == "local" and self.word(1) == "function":
            self.leaf(inner)
            kids.append(self.function(inner, "function_declaration", True))
        elif w == "function":
            kids.append(self.function(inner, "function_declaration", True))
        elif w in ("if", "while", "for"):
            self.leaf(inner)
            while not self.at("then", "do", "end") and not self.over():
                self.operand(inner)
            if self.at("then", "do"):
                self.leaf(inner)
            self.block(inner)
            while w == "if" and self.at("elseif", "else"):
                c = []
                k = self.leaf(c).kind
                while k == "elseif" and not self.at("then", "end") and not self.over():
                    self.operand(c)
                if self.at("then"):
                    self.leaf(c)
                self.block(c)
                self.node(inner, k + "_statement", c, "alternative")
            self.leaf(inner) if self.at("end") else None
            self.node(kids, w + "_statement", inner)
        elif w in ("do", "repeat"):
            self.leaf(inner)
            self.block(inner)
            if self.at("until"):
                self.leaf(inner)
                self.expression(inner)
            elif self.at("end"):
                self.leaf(inner)
            self.node(kids, w + "_statement", inner)
        elif w == "return":
            self.leaf(inner)
            if not self.at("end", "else", "elseif", "until", ";") and not self.over():
                self.expressions(inner, "expression_list")
            self.node(kids, "return_statement", inner)
        elif w in ("break", "goto"):
            self.leaf(inner)
            if w == "goto":
                self.leaf(inner, "identifier")
            self.node(kids, w + "_statement", inner)
        elif w == "local" or self.peek().type == "id" or w == "(":
            local = w == "local"
            if local:
                self.leaf(inner)
            left = []
            self.expression(left)
            while self.at(","):
                self.leaf(left)
                self.expression(left)
            if self.at("="):
                for c in left:
                    if c.named:
                        c.field = "name"
                a = []
                self.node(a, "variable_list", left)
                self.leaf(a)
                self.expressions(a, "expression_list")
                n = self.node([], "assignment_statement", a)
                if local:
                    inner.append(n)
                    self.node(kids, "variable_declaration", inner)
                else:
                    kids.append(n)
            elif local:
                self.node(inner, "variable_list", left)
                self.node(kids, "variable_declaration", inner)
            else:
                kids += left

    def expressions(self, kids, kind):
        inner = []
        self.expression(inner)
        while self.at(","):
            self.leaf(inner)
            self.expression(inner)
        for c in inner:
            if c.named:
                c.field = "value"
        self.node(kids, kind, inner)

    def expression(self, kids):
        parts = []
        self.operand(parts)
        while self.at("+", "-", "*", "/", "//", "%", "^", "..", "==", "~=", "<", ">", "<=", ">=", "and", "or", "&", "|", "~", "<<", ">>") and not self.over():
            self.leaf(parts)
            self.operand(parts)
        if len(parts) == 1:
            kids += parts
        elif parts:
            self.node(kids, "binary_expression", parts)

    def operand(self, kids):
        t = self.skim(kids)
        w, own = self.word(), []
        if t.type in ("num", "str"):
            n = self.literal(own)
        elif w == "function":
            n = self.function(own, "function_definition", False)
        elif w in ("not", "-", "#", "~"):
            self.leaf(own)
            self.operand(own)
            self.node(kids, "unary_expression", own)
            return
        elif w == "{":
            self.leaf(own)
            while not self.at("}") and not self.over():
                f, before = [], self.i
                if self.at("["):
                    self.group(f, "bracket_index", "name")
                elif self.peek().type == "id" and self.word(1) == "=":
                    self.leaf(f, "identifier", "name")
                if f and self.at("="):
                    self.leaf(f)
                v = []
                self.expression(v)
                for c in v:
                    c.field = "value"
                f += v
                if f:
                    self.node(own, "field", f)
                if self.at(",", ";"):
                    self.leaf(own)
                if self.i == before:
                    self.leaf(own)
            self.leaf(own)
            n = self.node([], "table_constructor", own)
        elif w == "(":
            n = self.group(own, "parenthesized_expression")
        elif t.type == "id" and w not in ("end", "then", "do", "else", "elseif", "until", "and", "or", "return", "local", "if", "while", "for", "in", "repeat"):
            n = self.leaf(own, "identifier")
        else:
            if not self.at("end", "then", "do", "else", "elseif", "until"):
                self.leaf(kids)
            return
        while True:
            t, own = self.peek(), [n]
            if t.text in (".", ":") and t.type == "op" and self.peek(1).type == "id":
                n.field = "table"
                self.leaf(own)
                self.leaf(own, "identifier", "field" if t.text == "." else "method")
                n = self.node([], "dot_index_expression" if t.text == "." else "method_index_expression", own)
            elif t.text == "[" and t.type == "op":
                self.group(own, "bracket_index")
                n = self.node([], "bracket_index_expression", own)
            elif (t.text in ("(", "{") and t.type == "op" or t.type == "str") and n.kind not in ("number", "string", "table_constructor", "function_definition"):
                n.field = "name"
                if t.text == "(" and t.type == "op":
                    self.group(own, "arguments", "arguments")
                else:
                    a = []
                    self.literal(a) if t.type == "str" else self.operand(a)
                    self.node(own, "arguments", a, "arguments")
                n = self.node([], "function_call", own)
            else:
                break
        kids.append(n)

    def group(self, kids, kind, field=None):
        inner = []
        stop = _CLOSE[self.leaf(inner).kind]
        while not self.at(stop) and not self.over():
            before = self.i
            self.expression(inner)
            if self.at(",", ";", "="):
                self.leaf(inner)
            if self.i == before:
                self.leaf(inner)
        ok = self.at(stop)
        self.leaf(inner) if ok else None
        return self.node(kids, kind, inner, field, error=not ok)


class Ada(Base):
    fold = True
    _OPENERS = ("if", "case", "loop", "declare", "begin", "select", "accept", "record")

    def parse(self):
        kids = []
        while not self.over():
            before = self.i
            self.item(kids)
            if self.i == before:
                self.node(kids, "ERROR", [self.leaf([])], error=True)
        self.skim(kids)
        return Node("compilation", 0, len(self.source), children=kids)

    def name(self, kids, field=None):
        own = []
        n = self.leaf(own, "identifier")
        while self.at(".") and self.peek(1).type == "id":
            self.leaf(own)
            self.leaf(own, "identifier")
            n = self.node([], "selected_component", own)
            own = [n]
        n.field = field
        kids.append(n)
        return n

    def until(self, kids, *stops):
        while not self.at(*stops) and not self.over():
            self.operand(kids)

    def item(self, kids):
        self.skim(kids)
        w, inner = self.word(), []
        if w in ("with", "use") or w in ("limited", "private") and self.word(1) == "with":
            while self.at("limited", "private"):
                self.leaf(inner)
            kind = "with_clause" if self.at("with") else "use_clause"
            self.leaf(inner)
            while not self.at(";") and not self.over():
                self.name(inner) if self.peek().type == "id" and not self.at("type", "all") else self.leaf(inner)
            self.leaf(inner)
            self.node(kids, kind, inner)
        elif w in ("procedure", "function", "overriding"):
            self.subprogram(kids)
        elif w == "task" and self.word(1) == "body":
            self.leaf(inner), self.leaf(inner)
            self.leaf(inner, "identifier")
            self.leaf(inner) if self.at("is") else None
            self.body(inner)
            self.node(kids, "task_body", inner)
        elif w == "package":
            self.leaf(inner)
            body = self.at("body")
            self.leaf(inner) if body else None
            self.name(inner, "name") if self.peek().type == "id" else None
            self.until(inner, "is", ";")
            if self.at("is") and self.word(1) != "new":
                self.leaf(inner)
                while not self.at("end", "begin") and not self.over():
                    before = self.i
                    self.item(inner)
                    if self.i == before:
                        self.leaf(inner)
                if self.at("begin"):
                    self.sequence(inner)
                self.end(inner)
            else:
                self.until(inner, ";")
                self.leaf(inner)
            self.node(kids, "package_body" if body else "package_declaration", inner)
        elif w == "begin":
            self.sequence(kids)
            self.end(kids)
        elif self.over():
            return
        else:
            depth = 0
            while not self.over() and not (self.at(";") and depth == 0):
                depth += self.at("record") and self.word(1) != ";" and not (inner and inner[-1].kind == "end")
                depth -= self.at("end")
                self.operand(inner)
            self.leaf(inner) if not self.over() else None
            self.node(kids, "object_declaration", inner)

    def end(self, kids):
        if self.at("end"):
            while not self.at(";") and not self.over():
                self.leaf(kids, "identifier" if self.peek().type == "id" and not self.at("end") else None)
            self.leaf(kids) if self.at(";") else None

    def subprogram(self, kids):
        inner, spec = [], []
        self.leaf(inner) if self.at("overriding") else None
        word = self.leaf(spec).kind
        self.name(spec, "name") if self.peek().type == "id" else self.leaf(spec, "string", "name")
        if self.at("("):
            self.group(spec, "formal_part")
        if self.at("return"):
            self.leaf(spec)
            r = []
            while not self.at("is", ";") and not self.over():
                self.operand(r)
            self.node(spec, "result_profile", r)
        self.node(inner, word + "_specification", spec)
        if self.at("is"):
            self.leaf(inner)
            if self.at("("):
                self.group(inner, "expression")
                self.until(inner, ";")
                self.leaf(inner)
                self.node(kids, "expression_function_declaration", inner)
                return
            if self.at("separate", "new", "abstract", "null"):
                self.until(inner, ";")
                self.leaf(inner)
                self.node(kids, "subprogram_declaration", inner)
                return
            self.body(inner)
            self.node(kids, "subprogram_body", inner)
        else:
            self.until(inner, ";")
            self.leaf(inner)
            self.node(kids, "subprogram_declaration", inner)

    def body(self, inner):
        decl = []
        while not self.at("begin", "end") and not self.over():
            before = self.i
            self.item(decl)
            if self.i == before:
                self.leaf(decl)
        if decl:
            self.node(inner, "non_empty_declarative_part", decl)
        if self.at("begin"):
            self.sequence(inner)
        self.end(inner)

    def sequence(self, inner):
        self.leaf(inner)
        body = []
        self.statements(body)
        self.node(inner, "handled_sequence_of_statements", body)

    def statements(self, kids):
        while not self.at("end", "elsif", "else", "exception", "or") and not self.over():
            before = self.i
            self.statement(kids)
            if self.i == before:
                self.leaf(kids)
        if self.at("exception"):
            self.leaf(kids)
            self.statements(kids)

    def statement(self, kids):
        self.skim(kids)
        w, inner = self.word(), []
        if w in ("if", "while", "for", "loop", "case", "declare", "begin", "select"):
            if w not in ("loop", "declare", "begin", "select"):
                self.leaf(inner)
                c = []
                self.until(c, "then", "loop", "is", ";")
                self.node(inner, "condition", c, "condition")
            if w == "declare":
                self.leaf(inner)
                self.body(inner)
                self.node(kids, "block_statement", inner)
                return
            self.leaf(inner)
            self.statements(inner)
            while self.at("elsif", "else", "or"):
                part = []
                k = self.leaf(part).kind
                if k == "elsif":
                    self.until(part, "then", ";")
                    self.leaf(part)
                self.statements(part)
                self.node(inner, "elsif_statement_item" if k == "elsif" else "else_part", part)
            self.end(inner)
            self.node(kids, {"if": "if_statement", "case": "case_statement", "begin": "block_statement", "select": "selective_accept"}.get(w, "loop_statement"), inner)
        elif w == "when":
            self.leaf(inner)
            self.until(inner, "=>", ";")
            self.leaf(inner)
            self.node(kids, "case_alternative", inner)
        elif w in ("return", "exit", "raise", "goto", "delay", "null", "pragma", "accept", "abort", "requeue"):
            self.until(inner, ";")
            self.leaf(inner)
            self.node(kids, {"return": "simple_return_statement", "null": "null_statement", "exit": "exit_statement"}.get(w, w + "_statement"), inner)
        elif self.peek().type == "id":
            n = self.name(inner)
            if self.at(";"):
                n.field = "name"
                self.leaf(inner)
                self.node(kids, "procedure_call_statement", inner)
                return
            if self.at("("):
                self.group(inner, "actual_parameter_part")
                if self.at(";"):
                    n.field = "name"
                    self.leaf(inner)
                    self.node(kids, "procedure_call_statement", inner)
                    return
            if self.at(":") and self.word(1) in ("loop", "while", "for", "declare", "begin"):
                self.leaf(inner)
                self.statement(inner)
                self.node(kids, "label", inner)
                return
            self.until(inner, ";")
            self.leaf(inner)
            self.node(kids, "assignment_statement", inner)
        else:
            self.leaf(kids)

    def operand(self, kids):
        t = self.skim(kids)
        if t.type in ("num", "str", "chr"):
            self.literal(kids)
        elif t.text == "(":
            self.group(kids, "expression")
        elif t.type == "id" and self.word() not in ("and", "or", "not", "xor", "mod", "rem", "abs", "in", "then", "else", "null", "others", "is", "of", "array", "range", "access", "constant", "new", "record", "end", "return", "when", "exit", "raise", "type", "subtype", "if", "case"):
            own = []
            n = self.name(own)
            if self.at("("):
                n.field = "name"
                self.group(own, "actual_parameter_part")
                self.node(kids, "function_call", own)
            else:
                kids += own
        else:
            self.leaf(kids)

    def group(self, kids, kind):
        inner = []
        self.leaf(inner)
        while not self.at(")") and not self.over():
            self.operand(inner)
        self.leaf(inner) if self.at(")") else None
        return self.node(kids, kind, inner)


class Fortran(Base):
    fold = True
    _UNITS = {"program": "program", "subroutine": "subroutine", "function": "function", "module": "module", "submodule": "submodule"}

    def parse(self):
        kids = []
        while not self.over():
            before = self.i
            self.line(kids)
            if self.i == before:
                self.node(kids, "ERROR", [self.leaf([])], error=True)
        self.skim(kids)
        return Node("translation_unit", 0, len(self.source), children=kids)

    def ended(self):
        t = self.peek()
        return t.type == "end" or t.text == ";" or t.nl and not self.joined and self.i != self.begin

    begin = -1  # the token that this line begins with

    @property
    def joined(self):
        return self.i > 0 and self.toks[self.i - 1].text == "&"

    def rest(self, kids):
        while not self.ended():
            self.operand(kids)
        if self.at(";"):
            self.leaf(kids)

    def unit_word(self):
        """The keyword if this line opens a program unit."""
        i = 0
        while self.word(i) in ("pure", "elemental", "recursive", "impure", "module", "integer", "real", "logical", "character", "complex", "double", "precision", "type") and not (i and self.peek(i).nl):
            if self.word(i) == "module":
                nxt = self.word(i + 1)
                if nxt == "procedure":
                    return "module_procedure"
                if nxt not in ("subroutine", "function", "pure", "elemental", "recursive"):
                    return "module" if self.peek(i + 1).type == "id" and i == 0 else None
            i += 1
            if self.word(i) == "(":
                depth = 0
                while self.peek(i).type != "end":
                    depth += self.word(i) == "("
                    depth -= self.word(i) == ")"
                    i += 1
                    if depth == 0:
                        break
        w = self.word(i)
        if w in self._UNITS and (i == 0 or not self.peek(i).nl) and self.peek(i + 1).type in ("id",) and self.word(i + 1) not in ("=",) and not self.peek(i + 1).nl:
            return w
        return None

    def line(self, kids):
        self.skim(kids)
        self.begin = self.i
        w = self.word()
        unit = self.unit_word()
        if unit and w != "end":
            inner, st = [], []
            named = False
            while not self.ended():
                if self.word() in ("program", "subroutine", "function", "module", "submodule", "procedure") and not named:
                    self.leaf(st)
                    if not self.at("subroutine", "function", "procedure", "pure", "elemental", "recursive") and self.peek().type == "id":
                        self.leaf(st, "name", "name")
                        named = True
                elif self.at("(") and named:
                    self.group(st, "parameters")
                else:
                    self.operand(st)
            self.node(inner, unit + "_statement", st)
            while not self.over():
                self.skim(inner)
                self.begin = self.i
                if self.at("end") and self.word(1) in ("", unit.replace("module_", ""), unit.split("_")[0]) or self.at("end") and self.peek(1).nl or self.at("end" + unit, "end" + unit.replace("module_", "")):
                    e = []
                    self.rest(e)
                    self.node(inner, "end_" + unit + "_statement", e)
                    break
                if self.at("contains"):
                    c = []
                    self.rest(c)
                    self.node(inner, "contains_statement", c)
                    continue
                before = self.i
                self.line(inner)
                if self.i == before:
                    self.leaf(inner)
            self.node(kids, unit, inner)
            return
        inner = []
        if w == "use" and self.word(1) != "=":
            self.leaf(inner)
            while self.at(",", "intrinsic", "non_intrinsic", "::"):
                self.leaf(inner)
            self.leaf(inner, "module_name") if self.peek().type == "id" else None
            self.rest(inner)
            self.node(kids, "use_statement", inner)
        elif w == "include" and self.peek(1).type == "str":
            self.leaf(inner)
            self.leaf(inner, "filename", "path")
            self.node(kids, "include_statement", inner)
        elif w == "call" and self.peek(1).type == "id":
            self.leaf(inner)
            own = []
            self.leaf(own, "identifier", "subroutine")
            inner += own
            if self.at("(") and not self.ended():
                self.group(inner, "argument_list")
            self.rest(inner)
            self.node(kids, "subroutine_call", inner)
        else:
            self.rest(inner)
            if not inner:
                self.leaf(inner)
            kind = {"if": "if_statement", "do": "do_loop_statement", "end": "end_statement", "return": "keyword_statement", "print": "print_statement", "write": "write_statement", "implicit": "implicit_statement"}.get(w, "assignment_statement" if any(c.kind == "=" for c in inner) and not any(c.kind == "::" for c in inner) else "variable_declaration" if any(c.kind == "::" for c in inner) else "statement")
            self.node(kids, kind, inner)

    def operand(self, kids):
        t = self.skim(kids)
        if t.type in ("num", "str"):
            self.literal(kids)
        elif t.text == "(":
            self.group(kids, "parenthesized_expression")
        elif t.type == "id":
            own = []
            w = self.word()
            n = self.leaf(own, "identifier")
            while self.at("%") and self.peek(1).type == "id":
                self.leaf(own)
                self.leaf(own, "type_member")
                n = self.node([], "derived_type_member_expression", own)
                own = [n]
            if self.at("(") and not self.ended() and w not in ("if", "while", "integer", "real", "logical", "character", "complex", "type", "class", "case", "select", "write", "read", "dimension", "intent", "allocate", "deallocate", "open", "close", "kind", "do"):
                self.group(own, "argument_list")
                self.node(kids, "call_expression", own)
            else:
                kids += own
        else:
            self.leaf(kids)

    def group(self, kids, kind):
        inner = []
        self.leaf(inner)
        while not self.at(")") and not self.over():
            self.operand(inner)
        self.leaf(inner) if self.at(")") else None
        return self.node(kids, kind, inner)


def parse_blocks(source: str, lang: str) -> Node:
    return {"python": Python, "lua": Lua, "ada": Ada, "fortran": Fortran}[lang](source, lang).parse()
