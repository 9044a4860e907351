import pytest

from codeloupe.parsing.registry import EXTENSIONS, parse, parsers, unique_imports

SOURCES = {
    "go": (
        'package main\nimport (\n\t"fmt"\n\tstr "strings"\n)\ntype Server struct {\n\tname string\n}\ntype Runner interface { Run() error }\ntype ID int\nconst (\n\tA = iota\n\tB\n)\nvar limit = 3\nfunc main() {\n\th := handler\n\tfmt.Println(str.ToUpper("x"))\n}\nfunc (s *Server) Serve(n int) (err error) {\n\treturn help(n)\n}\n',
        [("Server", "class", 6, 8, ""), ("Runner", "interface", 9, 9, ""), ("ID", "type_alias", 10, 10, ""), ("A", "enum", 12, 12, ""), ("limit", "variable", 15, 15, ""), ("main", "function", 16, 19, ""), ("Serve", "method", 20, 22, "")],
        [("Println", 18), ("ToUpper", 18), ("help", 21), ("handler", 17)],
        [("fmt", "", 3), ("strings", "str", 4)],
    ),
    "javascript": (
        "import { a } from './m';\nfunction f() { return g(1); }\nfunction* gen() {}\nclass C {\n  constructor() { this.go(); }\n  go() { const cb = handler; }\n}\nconst arrow = (x) => x.map(f);\nvar old = function () {};\nmod.thing = function () {};\n",
        [("f", "function", 2, 2, ""), ("gen", "function", 3, 3, ""), ("C", "class", 4, 7, ""), ("constructor", "method", 5, 5, "C"), ("go", "method", 6, 6, "C"), ("arrow", "function", 8, 8, ""), ("old", "function", 9, 9, ""), ("thing", "function", 10, 10, "")],
        [("g", 2), ("go", 5), ("map", 8), ("handler", 6)],
        [("./m", "", 1)],
    ),
    "tsx": (
        "export function App() {\n  return (\n    <Layout><div/><Button onClick={() => go()} /></Layout>\n  );\n}\n",
        [("App", "function", 1, 5, "")],
        [("go", 3), ("Layout", 3), ("Button", 3)],
        [],
    ),
    "typescript": (
        "export interface Foo { x: number }\nexport type Bar = { y: string };\nexport enum Color { Red }\nnamespace NS {\n  export function inner(a: number): void { run(a); }\n}\nexport abstract class Base<T> {\n  abstract area(): number;\n  static async make<K>(k: K): Promise<void> { await doIt<K>(k); }\n}\n",
        [("Foo", "interface", 1, 1, ""), ("Bar", "type_alias", 2, 2, ""), ("Color", "enum", 3, 3, ""), ("NS", "namespace", 4, 6, ""), ("inner", "function", 5, 5, ""), ("Base", "class", 7, 10, ""), ("area", "method", 8, 8, "Base"), ("make", "method", 9, 9, "Base")],
        [("run", 5), ("doIt", 9)],
        [],
    ),
    "python": (
        "import os, numpy as np\nfrom a.b import c\nfrom . import d\n@deco\nclass A:\n    def m(self):\n        return helper(x=val)\nasync def f(a):\n    g = a\n    return os.path.join('p', {1: g})\n",
        [("A", "class", 4, 7, ""), ("m", "method", 6, 7, "A"), ("f", "function", 8, 10, "")],
        [("helper", 7), ("join", 10), ("val", 7), ("a", 9), ("g", 10)],
        [("os", "", 1), ("numpy", "np", 1), ("a.b", "", 2), (".", "", 3)],
    ),
    "csharp": (
        "using System;\nusing IO = System.IO;\nnamespace Outer { namespace Inner {\nclass Foo {\n  private int count = 3;\n  public string Name { get; set; } = \"x\";\n  public Foo(int a) : base(a) { Init(); }\n  public int Run(int x) => svc.Call<int>(x);\n}\ninterface IThing { void Do(); }\nenum E { A }\nrecord Point(int X);\ndelegate void Cb(int a);\n} }\n",
        [("Outer", "namespace", 3, 14, ""), ("Inner", "namespace", 3, 14, "Outer"), ("Foo", "class", 4, 9, "Outer.Inner"), ("count", "variable", 5, 5, "Foo"), ("Name", "variable", 6, 6, "Foo"), ("Foo", "function", 7, 7, ""), ("Run", "method", 8, 8, "Foo"), ("IThing", "interface", 10, 10, "Outer.Inner"), ("Do", "method", 10, 10, "IThing"), ("E", "enum", 11, 11, "Outer.Inner"), ("Point", "class", 12, 12, "Outer.Inner"), ("Cb", "type_alias", 13, 13, "")],
        [("Init", 7)],
        [("System", "", 1), ("System.IO", "IO", 2)],
    ),
    "rust": (
        "pub struct S { a: i32 }\npub enum E { A }\npub trait T { fn go(&self); }\nimpl T for S {\n  fn go(&self) { helper::<i32>(1); println!(\"hi {}\", x); }\n}\ntype Alias = Vec<u8>;\nconst MAX: usize = 3;\nmod inner {\n  pub fn f<'a>(x: &'a str) -> char { g(x) }\n}\nfn main() { let f = handler; Foo::new(); }\nmacro_rules! mac { ($x:expr) => { $x } }\n",
        [("S", "class", 1, 1, ""), ("E", "enum", 2, 2, ""), ("T", "interface", 3, 3, ""), ("go", "method", 3, 3, "T"), ("go", "method", 5, 5, ""), ("Alias", "type_alias", 7, 7, ""), ("MAX", "variable", 8, 8, ""), ("inner", "namespace", 9, 11, ""), ("f", "function", 10, 10, ""), ("main", "function", 12, 12, ""), ("mac", "function", 13, 13, "")],
        [("helper", 5), ("g", 10), ("new", 12), ("println", 5), ("handler", 12)],
        [],
    ),
    "swift": (
        "import Foundation.Sub\npublic class A: B {\n  var x = 1\n  init(a: Int) { setup(a) }\n  func go(_ n: Int) -> Int { return help(n) }\n}\nstruct P {}\nenum K { case a }\nextension A { func more() {} }\nprotocol Q { func need() }\ntypealias T = Int\nfunc top() { let v = handler; obj.call(1) }\nlet g = 3\n",
        [("A", "class", 2, 6, ""), ("init", "method", 4, 4, "A"), ("go", "method", 5, 5, "A"), ("P", "class", 7, 7, ""), ("K", "enum", 8, 8, ""), ("A", "namespace", 9, 9, ""), ("more", "method", 9, 9, "A"), ("Q", "interface", 10, 10, ""), ("need", "method", 10, 10, "Q"), ("T", "type_alias", 11, 11, ""), ("top", "function", 12, 12, ""), ("g", "variable", 13, 13, "")],
        [("setup", 4), ("help", 5), ("call", 12), ("handler", 12)],
        [("Foundation.Sub", "", 1)],
    ),
}


@pytest.mark.parametrize("language", SOURCES)
def test_languages(language):
    text, symbols, calls, imports = SOURCES[language]
    found = parse(language, text)
    assert [(s.name, s.type, s.start_line, s.end_line, s.parent) for s in found.symbols] == symbols
    assert found.calls == calls
    assert found.imports == imports


def test_body_tokens():
    found = parse("go", 'package p\n// says hello\nfunc f() {\n\t// inner note\n\tlog("cannot open %s")\n}\n')
    assert {"f", "log", "cannot", "open", "// inner note"} <= set(found.symbols[0].tokens)


def test_a_file_scoped_namespace_reaches_the_end():
    found = parse("csharp", "namespace A.B;\nclass C {}\n\nclass D {}\n")
    assert [(s.name, s.end_line, s.parent) for s in found.symbols] == [("A.B", 4, ""), ("C", 2, "A.B"), ("D", 4, "A.B")]


def test_imports_are_distinct():
    assert unique_imports([("b", "", 2), ("a", "", 1), ("b", "x", 2), ("b", "y", 2)]) == [("a", "", 1), ("b", "x", 2)]


def test_all_extensions_have_parsers():
    assert set(EXTENSIONS.values()) <= set(parsers()) and len(EXTENSIONS) == 14


@pytest.mark.parametrize("language", SOURCES)
def test_broken_sources_do_not_hang(language):
    text = SOURCES[language][0]
    for cut in range(0, len(text), 17):
        parse(language, text[:cut])


def test_csharp_generic_members():
    text = """class C<T> where T : new() {
  public List<T> All<K>(Dictionary<string, List<K>> d) where K : class, new() { return Make<K>(d); }
  public static async Task<Dictionary<K, V>> Load<K, V>(K key) where K : notnull => await svc.Get(key);
  public Dictionary<string, List<T>> Map { get; set; } = new();
  private readonly Func<int, List<T>> make = Build;
  public (int, T) Pair<U>(U u) { return help(u); }
  public static C<T> operator +(C<T> a, C<T> b) => a;
  public static implicit operator string(C<T> c) => show(c);
  ~C() { close(); }
  T IThing<T>.Do<X>(X x) { run(x); }
}
"""
    found = parse("csharp", text)
    assert [(s.name, s.type, s.start_line, s.parent) for s in found.symbols] == [("C", "class", 1, ""), ("All", "method", 2, "C"), ("Load", "method", 3, "C"), ("Map", "variable", 4, "C"), ("make", "variable", 5, "C"), ("Pair", "method", 6, "C"), ("Do", "method", 10, "C")]
    # A call with type arguments has no plain name, and so is none here.
    assert [c for c in found.calls if c[0] != "Build"] == [("Get", 3), ("help", 6), ("show", 8), ("close", 9), ("run", 10)]


def test_go_generic_calls():
    found = parse("go", "package p\nfunc h[T any](x T) T { return x }\nfunc f() {\n\th[int](1)\n\tmaps.Keys[string, []int](m)\n\ta[0](2)\n\tb[i+1](3)\n}\n")
    assert found.calls == [("h", 4), ("Keys", 5)]


def test_broken_python_keeps_the_rest():
    found = parse("python", "def good():\n    return a(1)\n\ndef (:\n    x = 1\n\nclass A:\n    def m(self):\n        return b(]\n    def n(self):\n        c()\nd()\n")
    assert [(s.name, s.start_line, s.parent) for s in found.symbols] == [("good", 1, ""), ("A", 7, ""), ("m", 8, "A"), ("n", 10, "A")]
    assert [c[0] for c in found.calls] == ["a", "c", "d"]
    assert parse("python", "def (:\n").symbols == [] and parse("python", "\ufeffdef f():\n").symbols[0].name == "f"
