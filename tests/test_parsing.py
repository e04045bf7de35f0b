"""Front ends, without Spark."""

import pytest

from lodestone.errors import ChunkDecodeError, MalformedSourceError, UnregisteredLanguageError
from lodestone.languages import BY_EXTENSION, REGISTRY, front_end
from lodestone.operators.parse import parse_one


def parsed(language, source):
    return front_end(language)(source.encode()).finish()


def definition(row, name):
    return next(d for d in row["defs"] if d["name"] == name)


@pytest.mark.parametrize(
    ("language", "source", "name", "expected"),
    [
        ("python", "class A:\n    def f(self):\n        pass\n", "f", "A"),
        ("python", "def o():\n    def f():\n        pass\n", "f", None),
        ("python", "class A:\n    class B:\n        async def f(self):\n            pass\n", "f", "B"),
        ("python", "class A:\n    @staticmethod\n    def f():\n        pass\n", "f", "A"),
        ("go", "package p\ntype A struct{}\nfunc (a *A) F() {}\n", "F", "A"),
        ("go", "package p\ntype A struct{}\nfunc (a A) F() {}\n", "F", "A"),
        ("go", "package p\nfunc (A) F() {}\n", "F", "A"),
        ("go", "package p\nfunc (s *Stack[T]) F(x T) {}\n", "F", None),
        ("go", "package p\nfunc F() {}\n", "F", None),
        ("javascript", "class A { f() {} }", "f", "A"),
        ("javascript", "const o = { f() {} };", "f", None),
        ("javascript", "class A { f = () => {}; }", "f", "A"),
        ("javascript", "const o = class A { f() {} };", "f", None),
        ("typescript", "class A { f(): void {} }", "f", "A"),
        ("typescript", "class A { private f = (): void => {} }", "f", "A"),
        ("typescript", "class A implements B { f(): number { return 1; } }", "f", "A"),
        ("typescript", "abstract class A { f(): number { return 1; } }", "f", None),
    ],
)
def test_enclosing_class(language, source, name, expected):
    assert definition(parsed(language, source), name)["enclosing_class"] == expected


@pytest.mark.parametrize(
    ("language", "source", "names"),
    [
        ("javascript", "const f = x => x; const g = (x) => x; function* h() {} function k() {}", ["g", "k"]),
        ("javascript", "const f = function () {}; class A { #p() {} q() {} 'r'() {} }", ["A", "q"]),
        ("typescript", "enum E { A } type T = { m(): void }; interface I { m(): void }\nexport const f = async <T,>(x: T): Promise<T> => x;", ["I", "f"]),
        ("typescript", "class A { m(x: string): void; m(x: any) { return x } }", ["A", "m"]),
        ("go", "package p\ntype A = B\ntype C int\ntype D interface { M() }\ntype (\n\tE struct{}\n\tF interface{}\n)\nfunc f() { func() {}() }\n", ["D", "E", "f"]),
        ("python", "f = lambda x: x\nif True:\n    def g():\n        pass\n", ["g"]),
    ],
)
def test_what_is_a_definition(language, source, names):
    assert [d["name"] for d in parsed(language, source)["defs"]] == names


@pytest.mark.parametrize(
    ("language", "source", "refs"),
    [
        ("python", "a(b.c(1)).d()\nclass X(P, q.R, m=K):\n    pass\n", [("a", "call"), ("a(b.c(1)).d", "call"), ("b.c", "call"), ("P", "inheritance"), ("q.R", "inheritance")]),
        ("python", "(a or b).f()\n@d(1)\ndef g(x=h()): pass\n", [("d", "call"), ("h", "call"), ("(a or b).f", "call")]),
        ("python", "f'{x(1)} {y.z()}'\n", [("x", "call"), ("y.z", "call")]),
        ("javascript", "new A(1); new b.C(); d?.e(); f`${g(1)}`; if (h) {} class X extends Y {} import('z');", [("A", "call"), ("g", "call"), ("d.e", "call"), ("Y", "inheritance")]),
        ("javascript", "const r = /a(b)/.test(s); x = y / z(1) / 2;", [("z", "call"), ("/a(b)/.test", "call")]),
        ("typescript", "f<T>(1); class X extends n.Y<T> implements Z { m(): void { super.m(); this.k() } }", [("f", "call"), ("super.m", "call"), ("this.k", "call"), ("n.Y", "inheritance")]),
        ("go", "package p\ntype A struct {\n\tB\n\t*C\n\tx int\n}\nfunc f() { g(1); h.i.J(); x := []int{1} }\n", [("g", "call"), ("h.i.J", "call"), ("B", "inheritance"), ("C", "inheritance")]),
    ],
)
def test_references(language, source, refs):
    assert [(r["text"], r["kind"]) for r in parsed(language, source)["raw_refs"]] == refs


@pytest.mark.parametrize(
    ("language", "source", "expected"),
    [
        ("python", "import a.b.c, d as e", [("direct", "a.b.c", "a", 2), ("direct", "d", "e", 0)]),
        ("python", "from ..m import n as k, o\nfrom . import *", [("named", "..m", "k", 0), ("named", "..m", "o", 0), ("wildcard", ".", None, 0)]),
        ("python", "from __future__ import annotations", []),
        ("javascript", "import a, { b as c, d } from 'm';\nimport * as n from \"x\"\nimport 's';", [("named", "'m'", "a", 0), ("named", "'m'", "c", 0), ("named", "'m'", "d", 0), ("named", '"x"', "n", 0), ("none", "'s'", None, 0)]),
        ("go", 'package p\nimport "os/exec"\nimport (\n\tj "encoding/json"\n\t_ "x/y"\n)\n', [("module", '"os/exec"', "exec", 0), ("module", '"encoding/json"', "j", 0), ("module", '"x/y"', "y", 0)]),
    ],
)
def test_imports(language, source, expected):
    assert [(i["form"], i["module"], i["alias"], i["extra"]) for i in parsed(language, source)["raw_imports"]] == expected


@pytest.mark.parametrize(("language", "source"), [("python", "def f(:\n"), ("javascript", "function f( {"), ("javascript", "x = `a${"), ("go", "func f() { /* "), ("typescript", "x = 'a\n'")])
def test_errors_have_a_name(language, source):
    with pytest.raises(MalformedSourceError):
        parsed(language, source)
    assert parse_one(language, source.encode()) == {"parse_error": "MalformedSourceError"}


def test_bytes_and_languages_that_are_none():
    with pytest.raises(ChunkDecodeError):
        front_end("python")(b"x = '\xff'")
    with pytest.raises(UnregisteredLanguageError):
        front_end("cobol")
    assert {x.extension for x in REGISTRY} == set(BY_EXTENSION) == {".py", ".ts", ".js", ".go"}


def test_offsets_are_bytes_and_lines_start_at_one():
    row = parsed("python", "# ü\n\n@d\ndef f():\n    'ä'\n")
    d = definition(row, "f")
    assert (d["start"], d["end"], d["start_line"], d["end_line"]) == (6, 26, 3, 5)
    assert d["sig"] == "@d\ndef f():"
    assert row["end_line"] == 6


def test_script_skeletons_print_braces_and_stubs():
    d = definition(parsed("javascript", "class A {\n  x = 1;\n  // c\n  f() { return 1; }\n}"), "A")
    assert [p["sig"] or p["text"] for p in d["body"]] == ["{", "x = 1", ";", "// c", "f()...", "}"]


def test_a_registry_that_breaks_the_contract_is_refused():
    from dataclasses import replace

    from lodestone import languages

    languages.check()
    for broken in (replace(REGISTRY[0], name="go"), replace(REGISTRY[0], extension="py"), replace(REGISTRY[1], extension=".go")):
        with pytest.raises(ImportError):
            languages.check((broken, *REGISTRY[2:]))


@pytest.mark.parametrize(
    ("language", "source"),
    [
        ("javascript", "foo bar baz(1)"),
        ("javascript", "let x = ;;; function ( ) y"),
        ("javascript", "function () { return 1 }"),
        ("javascript", "a = = b"),
        ("javascript", "f(a +)"),
        ("javascript", "const;"),
        ("javascript", "x = [1 2]"),
        ("javascript", "a.;"),
        ("typescript", "let x: string = ;"),
        ("typescript", "class A { m() { return 1 2 } }"),
        ("typescript", "type T = A |;"),
        ("typescript", 'const a = "x" "y"'),
        ("go", "package p\nfunc f() {\n\tx = = 1\n}\n"),
        ("go", "package p\nfunc f() {\n\tfoo bar\n}\n"),
        ("go", "package p\nfunc f() { return 1 + }\n"),
        ("go", "package p\nfunc f() {\n\tx := := 1\n}\n"),
        ("go", "package p\nfunc f() { a.) }\n"),
        ("python", "def f(:\n    pass\n"),
    ],
)
def test_broken_sources(language, source):
    assert parse_one(language, source.encode())["parse_error"] == MalformedSourceError.__name__


@pytest.mark.parametrize(
    ("language", "source"),
    [
        ("javascript", "#!/usr/bin/env node\nfor (const a of b) if (c) d; else e\nlabel: while (1) break label\nx = y => ({ *g() {}, get a() { return 1 }, async b() {} })"),
        ("javascript", "import a, * as b from 'c' with { type: 'json' }\nexport * as d from 'e'; export { f as default } from 'g'\nclass A { static #p = 1; static { } get [x]() {} 'q'() {} }"),
        ("javascript", "const r = a / b / c, s = /x y/g.test(d), t = `a ${b} c d`, u = a?.[0]?.b ?? 1; do x++\nwhile (y); if (a) function f() {}"),
        ("javascript", "const e = <div className='a b'>it is text {x} here</div>"),
        ("typescript", "abstract class A<in out T> extends B<T> implements C { @Input() declare readonly x?: string; @Dec y!: number; constructor(private a?, public b = 1) { super() } }"),
        ("typescript", "declare module 'm' { export type T = | A | B; function f(this: X, a?): asserts a is string; const z: unique symbol }\nlet v = <const T,>(x: T) => x as const; type M = { -readonly [K in keyof T]-?: T[K] }"),
        ("typescript", "export default abstract class {}\nenum E { A = 1, B }\nnamespace N.M { export import a = b.c }\nlet w = x satisfies Y; type F = typeof import('x'); let y = <T>z;"),
        ("go", "package p\nimport (\n\tx \"a/b\"\n\t. \"c\"\n)\ntype S[T any] struct {\n\ta, b int\n\t*E `json:\"x\"`\n}\ntype I interface {\n\tM(a int, b ...string) (c chan<- int, err error)\n\t~int | ~string\n}\n"),
        ("go", "package p\nfunc (s *S[T]) f(a, b int, c ...T) (n int, err error) {\n\tvar x, y int = 1, 2\n\tconst z = iota\nL:\n\tfor i := range a[1:] {\n\t\tif x := -y; x <= 1 && !(z != 2) { continue L }\n\t\tch <- *p\n\t\tv, ok := <-ch\n\t\tg(c...)\n\t}\n\tswitch t := a.(type) {\n\tcase int, string:\n\tdefault:\n\t}\n\treturn func(q int) int { return q << 1 &^ 2 }(1), nil\n}\n"),
        ("go", "package p\nvar m = map[string][]T{\n\t\"a\": {1, 2},\n\tb: {},\n}\nfunc g[K comparable, V any](x map[K]V) {\n\tdefer func() { recover() }()\n\tgo h(x)\n\tselect {\n\tcase c <- 1:\n\t}\n\tx[k], y = 1, struct{ a int }{2}\n}\n"),
    ],
)
def test_valid_sources(language, source):
    assert parse_one(language, source.encode())["parse_error"] is None
