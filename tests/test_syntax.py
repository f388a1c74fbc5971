import pytest

from codeloom.operators.facts import file_facts
from codeloom.syntax import FIELDS, flatten, parse
from codeloom.syntax.analysis import Tree, function_cfg

SAMPLES = {
    "c": "int f(int a) { return a; }\n",
    "cpp": "class A { public: A() : x(1) {} ~A() {} int f() const { return g(x); } int x; };\n",
    "rust": "fn f(a: i32) -> i32 { match a { 1 => g(a), _ => a + 1 } }\n",
    "python": "def f(a):\n    if a:\n        return [x for x in a]\n    else:\n        pass\n",
    "javascript": "const f = async (a) => { await g(a ? 1 : 2); };\nclass B { m() { return `x`; } }\n",
    "typescript": "export function f(a: Map<string, number>): void { a.get('x')!.toString(); }\n",
    "ada": "procedure F is\nbegin\n   null;\nend F;\n",
    "go": "package p\n\nfunc f(a int) (int, error) {\n\tif a := g(); a > 1 {\n\t\treturn a, nil\n\t}\n\treturn 1, nil\n}\n",
    "java": "class A { List<String> f(int a) throws X { for (int i = 0; i < a; i++) { g(i); } return null; } }\n",
    "csharp": "class A { public int F(int a) { foreach (var x in b) { G(x); } return a; } }\n",
    "kotlin": "fun f(a: Int): Int {\n    val b = a.map { it + 1 }\n    return b\n}\n",
    "swift": "func f(a: Int) -> Int {\n    let b = a + 1\n    return b\n}\n",
    "php": "<?php\nfunction f($a) { return $a + 1; }\n",
    "fortran": "subroutine f(a)\n  integer :: a\n  a = a + 1\nend subroutine f\n",
    "scala": "object A {\n  def f(a: Int): Int = {\n    a + 1\n  }\n}\n",
    "lua": "local function f(a) if a then return a end end\n",
}
FN = {"php": "name"}


@pytest.mark.parametrize("lang", SAMPLES)
def test_smoke_every_language_parses_without_error(lang):
    t = Tree(parse(lang, SAMPLES[lang]), SAMPLES[lang], lang)
    assert not t.broken, [(n.kind, t.text(n)) for n in t.order if n.error]
    assert any(name and name.lower().startswith(("f", "m", "a")) for _, name in t.functions())


@pytest.mark.parametrize("lang", SAMPLES)
@pytest.mark.parametrize("junk", ["", "}", "(((", "é {{ ]", "\x00 if while ", '"open', "/* open", "fn fn class def function"])
def test_never_raises_and_intervals_nest(lang, junk):
    source = SAMPLES[lang] + junk
    rows = [dict(zip(FIELDS, r)) for r in flatten(parse(lang, source), source)]
    children = {}
    for r in rows:
        assert r["node_id"] <= r["last_desc"] < len(rows)
        if r["parent_id"] is not None:
            up = rows[r["parent_id"]]
            assert up["node_id"] < r["node_id"] <= r["last_desc"] <= up["last_desc"]
            assert up["start_byte"] <= r["start_byte"] <= r["end_byte"] <= up["end_byte"]
            children[r["parent_id"]] = children.get(r["parent_id"], 0) + 1
    assert all(children.get(r["node_id"], 0) == r["child_count"] for r in rows)
    assert rows[0]["end_byte"] == len(source.encode())


def calls(lang, source):
    return [r[2:4] + r[5:6] for r in file_facts(lang, source, ("calls",))]


IMPORTS = [
    ("c", '#include <a.h>\n#include "b.h"\n', ["a.h", "b.h"]),
    ("cpp", '#include <a>\n#include "b.hpp"\n', ["a", "b.hpp"]),
    ("rust", "use a::b;\nuse c::{d, e};\n", ["a::b", "c::{d, e}"]),
    ("python", "import a, b\nfrom c import D\nimport e as f\nfrom . import g\nfrom __future__ import h\n", ["a", "b", "c", "e", "."]),
    ("javascript", "import a from 'x';\nimport { b } from \"y\";\n", ["x", "y"]),
    ("typescript", "import a from 'x';\nimport b = require(\"y\");\n", ["x", "y"]),
    ("tsx", "import a from 'x';\n", []),
    ("go", 'package p\nimport (\n\t"a/b"\n\t_ "c"\n)\n', ["a/b", "c"]),
    ("java", "import a.B;\nimport static c.D.*;\n", ["a.B", "c.D"]),
    ("csharp", "using A.B;\nusing C;\nusing X = D.E;\n", ["A.B", "C", "X"]),
    ("kotlin", "import a.b.*\n", ["a.b"]),
    ("swift", "import Foundation\n", ["Foundation"]),
    ("php", "<?php\nuse A\\B;\nrequire_once 'c.php';\n", ["A\\B", "c.php"]),
    ("fortran", "program p\n  use iso\n  include 'x.inc'\nend program p\n", ["iso", "x.inc"]),
    ("scala", "import a.b.{C, D}\n", ["a.b"]),
    ("lua", 'local m = require("a.b")\nfoo.require("c")\n', ["a.b"]),
    ("ada", "with A, B.C;\nuse A;\nprocedure P is begin null; end P;\n", ["A", "B.C"]),
]


@pytest.mark.parametrize("lang, source, expected", IMPORTS)
def test_imports(lang, source, expected):
    assert [r[2] for r in file_facts(lang, source, ("imports",))] == expected


@pytest.mark.parametrize(
    "lang, source, expected",
    [
        ("rust", 'fn aid() {}\nfn start() { aid(); std::fs::read("x"); println!("{}", other()); }', [("start", "aid", False), ("start", "std::fs::read", True)]),
        ("rust", "fn main() { v.iter::<T>(); x.y(); f::<T>(1); }", [("main", "y", True)]),
        ("python", "def h(): pass\ndef m():\n    h()\n    os.path.join(1)\n", [("m", "h", False), ("m", "os.path.join", True)]),
        ("go", "package p\nfunc h() {}\nfunc m() { h(); fmt.Println(1) }", [("m", "h", False), ("m", "fmt.Println", True)]),
        ("java", "class A { void h() {} void m() { h(); a.b().c(); new Foo(1); } }", [("m", "h", False), ("m", "c", True), ("m", "b", True), ("m", "Foo", True)]),
        ("c", "void t(int x) {}\nvoid f() { t(1); printf(\"x\"); (*p)(2); }", [("f", "t", False), ("f", "printf", True)]),
        ("c", "void t(int x) {}\nvoid f() { void (*p)(int) = t; p(1); }", [("f", "t", False)]),
        ("c", "void t(int x) {}\nvoid f() { void (*p)(int) = &t; p(1); }", [("f", "t", False)]),
        ("c", "void f() { int *p = &x; p(1); }", [("f", "p", True)]),
        ("c", "void t(int x) {}\nvoid f() { void (*p)(int); p = t; p(1); }", [("f", "p", True)]),
        ("c", "void a(int x) {}\nvoid b(int x) {}\nvoid f() { void (*p)(int) = a; p = b; p(1); }", [("f", "b", False)]),
        ("c", "#define M(x) g(x)\nvoid f() { M(1); }", [("f", "M", False)]),
        ("cpp", "void h() {}\nvoid m() { h(); std::f(); a.b(); p->c(); }", [("m", "h", False), ("m", "b", True), ("m", "c", True)]),
        ("javascript", "function o() { function i() { g(); } i(); }", [("o", "g", True), ("o", "i", False), ("i", "g", True)]),
        ("javascript", "const m = () => { a.b(() => c()); };", [("m", "a.b", True), ("m", "c", True)]),
        ("csharp", "class A { void H() {} void M() { H(); X.Y(); } }", [("M", "H", False), ("M", "X.Y", True)]),
        ("kotlin", "fun h() {}\nfun m() {\n  h()\n  x.y(1)\n}\n", [("m", "h", False), ("m", "x.y", True)]),
        ("swift", "func h() {}\nfunc m() {\n  h()\n  x.y(1)\n}\n", [("m", "h", False), ("m", "x.y", True)]),
        ("lua", "function h() end\nlocal t = { f = function() h() end }\nlocal k = function() a.b() end\n", [("f", "h", False), ("k", "a.b", True)]),
        ("ada", "procedure M is\n procedure H is begin null; end H;\nbegin\n H;\n Put(F(1));\nend M;\n", [("M", "H", False), ("M", "Put", True), ("M", "F", True)]),
        ("php", "<?php function h() {} function m() { h(); }", []),
        ("c", "int x;", []),
    ],
)
def test_calls(lang, source, expected):
    assert calls(lang, source) == expected


def test_broken_outer_function_does_not_swallow_the_next():
    source = "int first(int a) {\n#ifdef X\n  if (a) {\n#else\n  if (a > 1) {\n#endif\n    one();\n  }\n  return 1;\n}\nint second(int b) {\n  first(b);\n  two();\n  return 0;\n}\n"
    got = calls("c", source)
    assert ("second", "first", False) in got
    assert ("first", "first", False) not in got and ("first", "two", True) not in got


def cfg(lang, body):
    source = f"fn f() {{ {body} }}" if lang == "rust" else f"int f() {{ {body} }}"
    t = Tree(parse(lang, source), source, lang)
    g = function_cfg(lang, next(f for f, n in t.functions() if n == "f"))
    short = {"fallthrough": "ft", "true_branch": "T", "false_branch": "F", "back_edge": "B", "return": "R", "break": "K", "continue": "C"}
    return len(g.span), [(a, b, short[k]) for a, b, k in g.edges], g.exits


@pytest.mark.parametrize(
    "lang, body, blocks, edges, exits",
    [
        ("c", "int a; int b;", 1, [], [0]),
        ("c", "{ { a(); } }", 1, [], [0]),
        ("c", "if (x) { a(); } else { b(); }", 4, [(0, 1, "T"), (0, 2, "F"), (1, 3, "ft"), (2, 3, "ft")], [3]),
        ("c", "if (x) { return 1; } x = 2;", 5, [(0, 1, "T"), (1, 2, "R"), (0, 3, "F"), (3, 4, "ft")], [2, 4]),
        ("c", "while (x) { y(); }", 4, [(0, 1, "ft"), (1, 2, "F"), (1, 3, "T"), (3, 1, "B")], []),
        ("c", "for (i = 0; i < 3; i++) { continue; }", 5, [(0, 1, "ft"), (1, 2, "F"), (1, 3, "T"), (3, 1, "C")], [4]),
        ("c", "do a(); while (x);", 4, [(0, 1, "ft"), (1, 2, "ft"), (2, 1, "B"), (2, 3, "F")], [3]),
        ("rust", "loop { if c { break; } s(); }", 7, None, []),
        ("rust", "loop { return; }", 4, [(0, 1, "ft"), (1, 3, "R")], [3]),
        ("rust", "if a { return 1; } else { return 2; }", 6, None, [2, 4, 5]),
        ("cpp", "if (a) { return 1; } else { while (b) { break; } } return 2;", 10, None, None),
        ("c", "switch (x) { case 1: y(); break; default: z(); }", 1, [], [0]),
    ],
)
def test_cfg(lang, body, blocks, edges, exits):
    n, e, x = cfg(lang, body)
    assert n == blocks
    assert edges is None or e == edges
    assert exits is None or x == exits


def test_python_has_no_cfg():
    source = "def f():\n    pass\n"
    t = Tree(parse("python", source), source, "python")
    assert function_cfg("python", t.functions()[0][0]) is None


def test_depth():
    source = "void f() {" + "if (a) {" * 20000 + "x();" + "}" * 20000 + "}"
    t = Tree(parse("c", source), source, "c")
    assert sum(n.kind == "if_statement" for n in t.order) == 20000
    g = function_cfg("c", t.functions()[0][0])
    assert len(g.span) == 60001 and sum(k == "true_branch" for *_, k in g.edges) == 20000


@pytest.mark.parametrize(
    "source, expected",
    [
        ("int f(void) { return __alignof__(int); }", None),
        ("#include <stdbool.h>\nbool b = true;", None),
        ("void f(int *restrict p);", "C99"),
        ("struct s a = { .x = 1 };", "C99"),
        ("int a[] = { [2] = 1 };", "C99"),
        ("void f(int n, int a[*]);", "C99"),
        ("int f(void) { return _Generic(1, int: 2, default: 3); }", "C11"),
        ("_Alignas(16) int x;", "C11"),
        ("int f(void) { return _Alignof(int); }", "C11"),
        ("_Atomic int x;", "C11"),
        ("_Noreturn void f(void);", "C11"),
        ('_Static_assert(1, "x");', "C11"),
        ('#if 0\n_Static_assert(1, "x");\n#endif', "C11"),
        ("int *p = nullptr;", "C23"),
        ("constexpr int x = 1;", "C23"),
        ("[[nodiscard]] int f(void);", "C23"),
        ('#embed "x.bin"', "C23"),
        ("void f(int *restrict p);\n_Atomic int x;", "C11"),
    ],
)
def test_c_standard(source, expected):
    assert [r[2] for r in file_facts("c", source, ("c_standard",))] == [expected]


@pytest.mark.parametrize(
    "source, expected",
    [("#ifndef A\n#define A\nstruct s { int x; };\nint f(struct s *p);\n#endif\n", False), ('static_assert(1, "x");', False), ("", False), ("class A {};", True), ("namespace n { int x; }", True), ("template <class T> T f(T a);", True), ("int x = n::y;", True), ("void f(int &a);", True), ("void f() { try { g(); } catch (...) { } }", True), ("using a = b;\nusing n::x;", True)],
)
def test_header_language(source, expected):
    assert [r[5] for r in file_facts("c", source, ("cpp",))] == [expected]


def hashes(lang, source):
    return [r[4] for r in file_facts(lang, source, ("fingerprints",)) if r[5]]


def test_fingerprints():
    a, b = hashes("c", "int f(int a) { return a + 1; }\nint g(int b) { return b + 2; }")
    assert a == b == hashes("c", "int f(int a) { return a + 1; }")[0]
    (c,) = hashes("c", "int f(int a) { return a - 1; }")
    (d,) = hashes("c", "long f(int a) { return a + 1; }")
    assert len({a, c, d}) == 3
    assert len(hashes("rust", "fn a() { fn b() {} }")) == 2
