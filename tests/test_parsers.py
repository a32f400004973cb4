"""The parsers against small programs and, for Python, the interpreter's grammar."""

import ast
import glob
import os
import warnings

import pytest

from graphlens import parse
from graphlens.parse import dart, python, rust

GOOD_RUST = [
    "fn main() { let v: Vec<Vec<u8>> = vec![]; for (i, x) in v.iter().enumerate() { if let Some(y) = x.get(i) { drop(y); } } }",
    "pub(crate) async unsafe extern \"C\" fn f<'a, T: Fn(&'a str) -> u8 + 'a, const N: usize>(x: &'a mut [T; N]) -> impl Iterator<Item = T> + 'a where T: Clone { loop { break 'x'; } }",
    "impl<T> Trait<T> for S<T> where T: Copy { const A: u8 = 1; type B = u8; fn g(&self) -> Self { Self { a: 1, ..*self } } }",
    "fn f() { let Some(x) = g() else { return; }; match x { 1..=5 | 7 => {} n @ 8.. if n > 9 => (), _ => unreachable!() } }",
    "struct P(pub u8, u8); enum E { A, B(u8), C { x: u8 } = 3 } union U { a: u8 } trait T: Sized { fn d(&self) {} fn e(); }",
    "fn f() { let c = |x: u32| -> u32 { x + 1 }; let r = 1..; let s = ..=3; a.b.0.c()?.await[1] as u64 as f32; x = y = z; }",
    "macro_rules! m { ($x:expr) => { $x }; } m!{ a b c } use a::{b as c, d::*}; extern crate e; static mut X: u8 = b'\\n';",
    "fn f() { /* a /* nested */ b */ let s = r#\"x \" y\"#; let t = \"a\\\n b\"; let l: &'static str = \"\\u{1F600}\"; }",
    "fn f(x: u8) -> u8 { if x < 3 && y > (4) { 1 } else if a == b { 2 } else { 3 } }",
    "fn f() { let x = a < b; let y = (a as usize) < b; S::<u8>::new::<T>(1); <T as U>::v(); let [a, .., b] = c; }",
]
BAD_RUST = ["fn f( {", "fn f() { let = 3; }", "fn f(x: u32 -> u32 { x }", "fn f() { if { } }", "struct S { a u8 }", "fn f() { \"abc }", "/* open", "fn f() } {", "<<<<<<< HEAD\nfn f() {}\n", "fn f() { a == b == c; }", "pub fn g()\n    let x = 1;\n}", "import 'x';", "fn f() { /// doc\n }", "impl S { fn <%= x %>() {} }"]
GOOD_DART = [
    "import 'a.dart' as b show c, d; class A<T extends B> extends C<T> with D implements E { final int x; static const y = 1; A(this.x, {required super.z}) : w = 1, super(); factory A.of() => A(1); int get g => x; set s(int v) { x = v; } bool operator ==(Object o) => true; }",
    "sealed class S {} enum E { a, b(1); const E([this.n]); final int? n; } extension X on String { int f() => 1; } typedef F<T> = void Function(T x, {int? y}); mixin M on A {}",
    "Future<void> f() async { await for (final x in y) { if (x case [int a, var b] when a > b) print('$a ${b + {1: '}'}[1]!}'); } try { throw 'e'; } on E catch (e, s) { rethrow; } finally {} }",
    "void f() { var (a, b) = (1, 2); final {'k': v} = m; final r = switch (x) { > 3 && < 5 => 'a', A(:final b) => 'c', _ => 'd' }; a..b()..c = 1; List<Map<String, int>> l = <Map<String, int>>[]; for (var i = 0, j = 1; i < 3; i++) {} }",
    "int f(int x, [int y = 1]) => x > 3 ? y : x is int ? 1 : 2; var g = (int x) async => await x; final h = const [1, if (a) 2 else 3, for (var x in y) x, ...?z];",
    "void f() { switch (x) { case 1: break; case A(b: 2): default: return; } do { x?.y?[1]; } while (x ?? true); late final int q; assert(x, 'm'); label: while (true) { continue label; } }",
    "Stream<int> g() async* { yield 1; yield* h(); } @override\nString toString() => r'raw $x' '''multi\nline''' \"a\";",
]
BAD_DART = ["class A {", "int f(int x { return x; }", "void f() { if () { } }", "void f() { var x = ; }", "int f()\n  return 1;\n}", "}", "void f() { 'abc; }", "use std::x;", "# heading\n", "int {% block %}() {}", "void f((int a) => 1;"]
GOOD_PY = ["def f(a, /, b=1, *c, d, **e) -> int:\n    return a\n", "x = [i for i in y if i if j]\nmatch = 3\nmatch x:\n    case {'a': [1, *_], **r} if r:\n        pass\n    case A(b=1) | None as z:\n        pass\n", "with (a as b, c):\n    async def g():\n        await x\n", "print(f'{a!r:>{w}} {{}} {b=} {f\"{c}\"}')\n", "try:\n    pass\nexcept* E as e:\n    pass\nfinally:\n    pass\n", "type A[T] = list[T]\nclass B[T](C, k=1):\n    x: int = 1\n", "if (n := 10) > 5: pass\nelse: pass\n", ""]
BAD_PY = ["def f(:\n", "print 'x'\n", "x = (1\n", "if a:\nb\n", "f(a=1, 2)\n", "1 = x\n", "def f(a=1, b): pass\n", "  x = 1\n", "x = 'abc\n", "class A\n    pass\n", "f'{}'\n", "a b\n", "0777\n", "try:\n    pass\n", "return = 1\n", "x = 1 +\n"]


@pytest.mark.parametrize("text", GOOD_RUST)
def test_rust_accepts(text):
    assert not rust.parse(text).errors


@pytest.mark.parametrize("text", BAD_RUST)
def test_rust_rejects(text):
    assert rust.parse(text).errors


@pytest.mark.parametrize("text", GOOD_DART)
def test_dart_accepts(text):
    assert not dart.parse(text).errors


@pytest.mark.parametrize("text", BAD_DART)
def test_dart_rejects(text):
    assert dart.parse(text).errors


@pytest.mark.parametrize("text", GOOD_PY + BAD_PY)
def test_python_agrees_with_the_interpreter(text):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        ok = True
    except SyntaxError:
        ok = False
    assert (not python.parse(text).errors) == ok
    assert ok == (text in GOOD_PY)


def test_python_accepts_the_standard_library():
    for f in sorted(glob.glob(os.path.join(os.path.dirname(ast.__file__), "*.py")))[:40]:
        assert not python.parse(open(f, encoding="utf-8").read()).errors, f


def test_every_error_and_every_readable_item_is_kept():
    u = rust.parse("fn a() { let = 1; }\nfn b() {}\nfn c( {}\nfn d() {}\n")
    assert len(u.errors) >= 2
    assert {"a", "b", "d"} <= {i.name for i in u.items}


def test_deep_nesting_is_an_error_and_no_crash():
    for text, p in (("fn f() { " + "(" * 5000, rust), ("x = " + "(" * 5000, python), ("var x = " + "[" * 5000, dart)):
        assert p.parse(text).errors


def test_encodings():
    assert parse.parse_file("a.rs", "﻿fn f() {}\r\nfn g() {}\r".encode())[0].errors == []
    assert parse.parse_file("a.rs", b"// \xff")[0].errors[0][1] == "not UTF-8"
    assert parse.parse_file("a.py", None)[0].errors == []
    assert parse.parse_file(None, b"x")[0].items == []
    assert parse.extension("a\\b.d\\x.RS") == "rs"


@pytest.mark.parametrize(
    "path, text",
    [
        ("a.dart", "/// Picks one.\nvoid f(int x) {\n" + "if (x == 0) { g(); } else " * 3000 + "{ h(); }\n}\n"), ("a.dart", "void f() { x = " + "[" * 3000 + "]" * 3000 + "; }\n"), ("a.rs", "fn f() { let x = " + "(" * 3000 + "1" + ")" * 3000 + "; }\n"),
        ("a.rs", "fn f() " + "{" * 3000 + "}" * 3000), ("a.py", "def f():\n    return " + "(" * 3000 + "1" + ")" * 3000 + "\n"),
    ],
)
def test_nesting_decides_nothing(path, text):
    unit, _ = parse.parse_file(path, text.encode())
    assert not unit.errors and [i.name for i in unit.items if i.kind == "function"] == ["f"]
    assert parse.parse_file(path, text.encode() + b")\n")[0].errors
