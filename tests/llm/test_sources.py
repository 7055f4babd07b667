"""Source files: syntax, documented functions, provenance."""

import pytest

from declarium.llm import documented, parsing, provenance
from declarium.syntax import lexers
from declarium.syntax.derive import Grammar

FILES = "file_id bigint, project string, file string, language string, content string, loaded_at timestamp_ntz, name string, doc string"

VALID = {
    "python": ["", "x = 1", "def f(a, *b, c=1, **d) -> int:\n    '''doc'''\n    return [i for i in a if i] + (yield)\n", "class A(B, metaclass=C):\n  @d\n  async def f(self): ...\n", "try:\n  pass\nexcept (A, B) as e:\n  raise X from e\nelse:\n  pass\nfinally:\n  del x[1:2, ::3]\n", "match p:\n  case {'a': [1, *r], **k} if r: pass\n  case A(b=1) | None: pass\n", "lambda *a, b=1: (a, b)\nx: int = 3; y += 1\n", "if x:\n\tpass\n# end", "with open(a) as b, c:\n  print(f'{b!r}', end='')\n", "a = not b in c\nb = x if y else z\n"],
    "go": ["package a\n", 'package a\n\nimport (\n\t"os"\n\tx "y"\n)\n\ntype T struct {\n\tA, B int `json:"a"`\n\tU\n}\n\nfunc (t *T) F(a int, b ...string) (int, error) {\n\tfor i, v := range b {\n\t\tif v == "x" && i > 0 {\n\t\t\tcontinue\n\t\t}\n\t}\n\tswitch x := a.(type) {\n\tcase int:\n\t\treturn 1, nil\n\tdefault:\n\t\tgo func() { <-c }()\n\t}\n\tm := map[string][]int{"a": {1, 2}}\n\treturn len(m), nil\n}\n'],
    "rust": ["#![a]\nuse a::{b, c::*};\n#[d(e)]\npub(crate) fn f<'a, T: X + 'a>(x: &'a mut T, y: Vec<Vec<u8>>) -> Result<(), E> where T: Y {\n    let z = if x.a() { 1..2 } else { 3..4 };\n    match z { A::B(c) | A::D { c, .. } if c > 1 => {} _ => return Ok(()), }\n    for i in 0..n { println!(\"{}\", i?); }\n    let k = |a: i32, b| a + b;\n    S { x: 1, ..Default::default() };\n    Ok(())\n}\nimpl<T> P for Q<T> { const A: u8 = 1; fn g(&self) {} }\n"],
    "java": ["package a.b;\nimport java.util.*;\n/** d */\npublic final class A<T extends B> extends C implements D {\n  private static final int[] X = {1, 2};\n  @Override public <U> List<U> f(final U u, String... v) throws E {\n    for (var x : v) { if (x == null || u instanceof String s && s.isEmpty()) continue; else y = (int) z + a[0]++; }\n    try (var r = g()) { return v.map(q -> q + 1).toList(); } catch (E | F e) { throw new G(\"x\"); } finally { }\n  }\n  enum K { P, Q(1) { void m() {} }; int z; }\n  A() { this(1); }\n}\n"],
    "javascript": ["import a, {b as c} from 'd'\nexport default function f({x, y = 1}, ...z) { return x?.[y] ?? z }\nclass A extends B { static #p = 1; get v() { return this.#p } async *g() { yield* h } }\nconst q = async (a, b) => ({a, ...b})\nfor (const k of l) { if (k) continue; else break }\nlabel: while (1) { x = y ? `t${u}v` : /re[/]x/g.test(z) }\n!function(){}()\nreturn_ = a\n++b\n", "#!/usr/bin/env node\nvar a = 1, b\nlet c = function () {}\nswitch (a) { case 1: default: d() }\ndo x(); while (y)\ntry { z } catch { } finally { }"],
    "typescript": ["interface A<T = any> extends B { readonly a?: string; [k: string]: unknown; m(x: number): void }\ntype C = { [K in keyof A]: A[K] } | null\nexport abstract class D<T> implements E { private constructor(public x: number, y?: T) { super() } abstract f(): Promise<Map<string, Array<T>>>; }\nenum F { G = 1, H }\nconst i = <T,>(a: T): a is string => a as unknown as boolean\nlet j: (a: number) => void = k!\nfunction l<T extends object>(this: Window, m: T[]): asserts m is T[] { return n<string>(o) }\ndeclare module 'p' { }\n"],
    "bash": ["#!/bin/bash\n# c\nset -e\nf() {\n  local a=\"${1:-x}\" b=$((a + 1))\n  if [ \"$a\" -lt 3 ] && [[ $b == *x* ]]; then\n    for i in \"${c[@]}\"; do echo \"$(g \"$i\" | wc -l)\" > /dev/null 2>&1; done\n  elif true; then :; else return 1; fi\n  case $a in x|y) z ;; *) w;; esac\n}\nfunction h { while read -r l; do arr=(1 2); done < file; }\ncat <<'EOF'\nif (((\nEOF\nh &\n"],
}
BROKEN = {
    "python": ["def f(:\n", "if x\n    pass\n", "x = (1,\n", "print 'a'\n", "<<<<<<< HEAD\nx = 1\n=======\n", "x = 'a\n", "def f():\nreturn 1\n", "  x = 1\n", "x = 012\n", "if a:\n        b\n    c\n", "package main\n", "a +\n"],
    "go": ["package a\nfunc f( {}\n", "package a\nfunc f() {\n", "package a\nvar x = \"a\n", "import \"a\"\n", "package a\nx := 1\n", "package a\nfunc f() { if x { }\n}\n}\n", "def f():\n    pass\n"],
    "rust": ["fn f( {}\n", "fn f() { let = 1; }\n", "fn f() {\n", "fn f() { a(\"x); }\n", "fn f() { a b }\n", "<<<<<<< HEAD\nfn f() {}\n"],
    "java": ["class A {", "class A { int f( { } }", "class A { int x = 1 }", "class A { String s = \"a; }", "class A { void f() { x(; } }", "def f():\n  pass\n"],
    "javascript": ["function f( {}", "const x = ;", "a b", "let x = 'a\n", "class A {", "const x: number = 1", "if (x {", "}", "<<<<<<< a\nx\n=======\n"],
    "typescript": ["let x: = 1", "function f(a: number {}", "class A { f( }", "interface {", "a b"],
    "bash": ["if x; then\n", "f() {\n", "echo \"a\n", "for i in a; echo\n", "x; }\n", "<<<<<<< HEAD\n", "foo(a, b)\n", "case x in\n"],
}


@pytest.mark.parametrize(("language", "text"), [(lang, t) for lang, texts in VALID.items() for t in texts])
def test_valid(language, text):
    assert parsing.failure(language, text) is None
    assert parsing.failure(language, "﻿" + text.replace("\n", "\r\n")) is None


@pytest.mark.parametrize(("language", "text"), [(lang, t) for lang, texts in BROKEN.items() for t in texts])
def test_broken(language, text):
    assert parsing.failure(language, text) is not None


def test_derivatives_name_the_token():
    g = Grammar("s = { 'a' } 'b' [ '(' s ')' ] ;", "s")
    assert g.run(["a", "a", "b"]) == -1
    assert g.run(["a", "c", "b"]) == 1
    assert g.run(["a", "b", "(", "b"]) == 4
    assert g.run(["b", "(", "b", ")"]) == -1
    small = Grammar("s = { 'a' } 'b' [ '(' s ')' ] ;", "s", most=1)
    assert [small.run(["b"] + ["(", "b"] * n + [")"] * n) for n in range(30)] == [-1] * 30  # a dropped memo changes nothing


def test_memo_agrees_with_the_own_parser():
    import ast
    import random

    rng = random.Random(7)
    pieces = ["x", "=", "1", "(", ")", "[", "]", ":", ",", "if", "else", "+", "lambda", "for", "in", "not", ".", "*", "return", "def"]
    for _ in range(3000):
        text = " ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 7))) + "\n"
        try:
            ast.parse(text)
        except SyntaxError:
            continue
        assert parsing.failure("python", text) is None, text


def files(spark, rows):
    return spark.createDataFrame([(k, "p", f, None, t, None, "clash", "clash") for k, f, t in rows], FILES)


DOCUMENTED = [
    (1, "a.py", 'class A:\n    def get(self):\n        """Return the next open ledger entry."""\n        def inner():\n            """This nested one does not count here."""\n\n    def put(self):\n        """Put."""\n\nasync def run():\n    """TODO: describe all of this one day soon."""\n', [("get", 2)]),
    (2, "a.go", "package a\n\n// Load reads every open entry of a ledger.\n//go:noinline\nfunc Load(a int) int {\n\treturn 1\n}\n\n// Far away from any of the functions below.\n\nfunc Near() {}\n\ntype T struct{}\n\n/* Close ends what was opened before it. */\nfunc (t *T) Close() {\n}\n\n// No body but a very fine comment here.\nfunc Ext(a int)\n", [("Load", 5), ("Close", 16)]),
    (3, "a.rs", "/// Adds one more entry to the book.\n#[inline]\npub fn add(x: i64) -> i64 { x }\n\nimpl A {\n    /**\n     * Takes the last entry out again.\n     */\n    fn take(&self) {}\n}\n\ntrait B {\n    /// Says what the thing really is.\n    fn says(&self);\n}\n", [("add", 3), ("take", 9)]),
    (4, "A.java", "package a;\npublic class A {\n    /**\n     * Sends every open entry to the archive.\n     * @param x this text is of a tag and is left out\n     */\n    @Override\n    public void send(int x) { }\n\n    /** send me */\n    void send(long me) { }\n\n    /** An abstract one has no body at all. */\n    abstract void none();\n}\n", [("send", 8)]),
    (5, "a.ts", "/** Finds the first entry that is still open. */\nexport const find = async (a: string): Promise<void> => {\n}\n\nclass B {\n  // Keeps the entry until somebody asks for it.\n  keep(x: number): number { return x }\n}\n// x = f(1)\nfunction code() {}\n\nfunction outer() {\n  // An inner function is no case at all.\n  function inner() {}\n}\n", [("find", 2), ("keep", 7)]),
    (6, "a.sh", "#!/bin/bash\n# Copies all open entries to another place.\ncopy_all() {\n  echo \"}\"\n}\n\n# shellcheck disable=SC2086\nfunction other {\n  :\n}\n", [("copy_all", 3)]),
    (7, "b.go", "package a\n\n// Load reads every open entry of a ledger.\nfunc Load( {\n}\n", []),
    (8, "c.txt", "# Load reads every open entry of a ledger.\nf() { :; }\n", []),
]


def test_documented_functions(spark):
    rows = [(k, f, t) for k, f, t, _ in DOCUMENTED] + [(9, "x.py", None), (10, "y.py", ""), (11, None, "def f(): pass"), (None, "z.py", DOCUMENTED[0][2])]
    expected = {(k, line, name) for k, _, _, found in DOCUMENTED for name, line in found}
    got = [tuple(r) for r in documented.found(files(spark, rows + rows[:2])).collect()]
    assert len(got) == len(set(got))
    assert set(got) == expected
    pairs = {(r.file_id, r.name): r for r in documented.pairs(files(spark, rows)).collect()}
    assert pairs[4, "send"].doc == "Sends every open entry to the archive."
    assert pairs[2, "Close"].body_text == "func (t *T) Close() {\n}"
    assert documented.found(files(spark, [])).collect() == []


def test_syntax_of_files(spark):
    rows = [(1, "a.py", "x = ("), (2, "./b.JS", "let x = 1"), (3, "c.md", "x = ("), (4, None, "x"), (5, "d.go", None), (6, "e.go", ""), (7, "f.sh", "if x"), (1, "a.py", "x = ("), (None, "g.py", "(")]
    assert sorted(r.file_id for r in parsing.found(files(spark, rows)).collect()) == [1, 7]
    rates = {(r.language, r.files, r.broken, r.rate) for r in parsing.rates(files(spark, rows)).collect()}
    assert rates == {("python", 1, 1, 1.0), ("javascript", 1, 0, 0.0), ("go", 2, 0, 0.0), ("bash", 1, 1, 1.0)}
    assert parsing.found(files(spark, [])).collect() == []
    assert lexers.language_of("a/b.MJS") == "javascript"


def test_provenance(spark):
    minified = "!function(a){" + "a.b(1,2);a.c=3;" * 60 + "}(window);\n"
    data = "X = [\n" + "    1, 2, 3, 4, 5, 6, 7,\n" * 60 + "]\n"
    cases = {
        1: ("a.py", "#!/x\n# Code generated by protoc; DO NOT EDIT.\nx = 1\n", True),
        2: ("a.go", "// Copied unchanged from zlib, release 1.2.\npackage a\n", True),
        3: ("vendor/x/a.py", "x = f(1)\n", True),
        4: ("src/vendors/a.py", "x = f(1)\n", False),
        5: ("lib/a.js", minified, True),
        6: ("a_pb2.py", "x = f(1)\n", True),
        7: ("t.py", data, True),
        8: ("b.py", "import re\n\n# the writer emits a DO NOT EDIT line\nBANNER = 'Code generated by x; DO NOT EDIT.'\n", False),
        9: ("c.py", "# This module writes generated files; do look at them.\nx = f(1)\n", False),
        10: ("d.py", None, False),
        11: ("vendor/e.py", "", False),
        12: (None, "# @generated by x\n", True),
        13: ("f.ts", "/* @generated */\nlet x = 1\n", True),
        14: ("vendor/g.py", None, True),
    }
    rows = [(k, f, t) for k, (f, t, _) in cases.items()] + [(1, *cases[1][:2]), (None, *cases[1][:2])]
    got = [r.file_id for r in provenance.found(files(spark, rows)).collect()]
    assert sorted(got) == [k for k, (_, _, case) in cases.items() if case]
    assert provenance.found(files(spark, [])).collect() == []


@pytest.mark.parametrize(
    ("text", "case"),
    [
        ("# Licence terms.\n" * 60 + "# Code generated by x. DO NOT EDIT.\nx = 1\n", True),
        ("# Code generated by x, which emits stubs; DO NOT EDIT.\nx = 1\n", True),
        ("# Looks for 'code generated by' lines that say do not edit.\nx = 1\n", False),
    ],
)
def test_header_notices(text, case):
    assert (provenance.kind_of("a.py", text) is not None) == case


@pytest.mark.parametrize("line", ["delete the stale rows before a run.", "return nothing when the list is empty.", "for every row of a batch (see the notes)", "maps each key -> its owner for later use", "use the older of both values here."])
def test_prose_is_no_code(line):
    assert documented.telling(line, "f")


@pytest.mark.parametrize("line", ["return self.rows(key)", "import os", "delete rows[key]", "if rows == key:", "for (const a of rows) {", "let total = first + second", "use std::collections::HashMap;", "rows.append(key, value, other, more)"])
def test_code_is_no_prose(line):
    assert documented.telling(line + "\n" + line, "f") is None


def test_python_functions_in_match_and_try_star():
    text = 'match x:\n  case 1:\n    def f():\n      """Keeps the rows that are still needed."""\ntry:\n  pass\nexcept* A:\n  def g():\n    """Drops the rows that nobody has asked for."""\n'
    assert [d.name for d, _ in documented.documented("python", text)] == ["f", "g"]


def test_notices_and_folders():
    assert provenance.kind_of("a/b.go", "// Code generated by x, which emits tables. DO NOT EDIT.\npackage b\n") == ("generated", "notice")
    assert provenance.kind_of("a/b.go", "// " + "licence\n// " * 200 + "\n// Code generated by x. DO NOT EDIT.\npackage b\n") == ("generated", "notice")
    assert provenance.kind_of("external/a.py", "def f():\n    return g(1)\n") is None
    assert provenance.kind_of("external/lib/a.py", "def f():\n    return g(1)\n") == ("copied", "path")
    assert provenance.kind_of("a.py", "# looks for files that say do not edit\ndef f():\n    return g(1)\n") is None


def test_the_latest_delivery_decides(spark):
    """A later delivery that is valid, written by hand, or without functions takes the place of an earlier one."""
    from datetime import datetime

    early, late = datetime(2024, 1, 1), datetime(2024, 1, 2)
    good = 'def f():\n    """Keeps the rows that are still needed."""\n    return keep(rows, limit) or fallback(rows, limit)\n'
    made = "# Code generated by a tool. DO NOT EDIT.\nx = 1\n"
    rows = [(1, "p", "a.py", "python", "def (:\n", early, None, None), (1, "p", "a.py", "python", good, late, None, None), (2, "p", "b.py", "python", good, early, None, None), (2, "p", "b.py", "python", made, late, None, None), (3, "p", "c.py", "python", made, late, None, None), (3, "p", "c.py", "python", "y = (\n", early, None, None), (3, "p", "c.py", "python", "y = g(1)\n", datetime(2024, 1, 3), None, None)]
    df = spark.createDataFrame(rows, FILES)
    assert [r.file_id for r in parsing.found(df).collect()] == []
    assert [tuple(r) for r in documented.found(df).collect()] == [(1, 1, "f")]
    assert [r.name for r in documented.pairs(df).collect()] == ["f"]
    assert [r.file_id for r in provenance.found(df).collect()] == [2]


def test_documentation_is_no_data():
    assert provenance.kind_of("a.py", 'def f():\n    """Keeps the rows that are still needed, and drops the others at once."""\n') is None
    assert provenance.kind_of("a.py", "ROWS = [" + ", ".join(f'"row {i}"' for i in range(40)) + "]\n") == ("data", "content")
