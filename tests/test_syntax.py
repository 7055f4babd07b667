"""Grammars against texts that their languages take or reject."""

import pytest

from declarium.syntax import exact, lexers, parsing

GOOD = [
    ("typescript","let x = y as const"),
    ("typescript","const a = [1] as const;"),
    ("typescript","let m: typeof import('x');"),
    ("typescript","type A = typeof import('x').foo"),
    ("javascript","if (x) /re/.test(y)"),
    ("javascript","const a = <div className=\"x\" {...p}>hi {name} <b/> {list.map(i => <li key={i}>{i}</li>)}</div>;"),
    ("javascript","function A() { return (<><p>it's</p></>); }"),
    ("typescript","const a = <div>{x as string}</div>;"),
    ("typescript","const f = <T,>(x: T) => x;"),
    ("typescript","const f = <T>(x: T): T => x;"),
    ("typescript","let y = <any>x;"),
    ("javascript","`${xs.map(x => { if (x) { y(`a${b}`) } })}`"),
    ("javascript","a = b / c / d; e = (f) / g / 2"),
    ("javascript","x = a++ / 2; y = [1] / 3"),
    ("java","sealed interface S permits A, B {}"),
    ("java","non-sealed class B implements S {}"),
    ("java","class A { int f(Object o) { return switch (o) { case Integer i when i > 0 -> 1; case String s -> 2; default -> 3; }; } }"),
    ("java","class A { int when = 1; int permits(int record) { return when; } }"),
    ("rust","/* a /* b /* c */ */ */ fn f() { let s = r###\"a\"##b\"###; }"),
    ("bash","[[ $a =~ ^(b|c)$ ]] && echo x"),
    ("bash","coproc foo { cat; }\necho"),
    ("bash","a=$(echo $(echo $(echo $(echo \"$(echo x)\"))))"),
    ("bash","if ! [ -f x ]; then echo; fi"),
    ("bash","x=\"$(( $(cmd \"x\") ))\""),
    ("bash","{ echo a; } > \"$f\" <<EOF\nhi\nEOF\necho b"),
    ("bash","case $x in\n a|\\\n b) echo;;\nesac"),
    ("bash","a |\\\n b"),
    ("bash","x=$(case y in y) echo 1;; esac)"),
    ("bash","for ((i=0; i<3; i++)); do echo $i; done"),
    ("bash","arr=(a b\nc # comment\n d)"),
    ("bash","cat <<-'E' | grep x\n\tq\n\tE\n"),
    ("python","def f(a, /, b=1, *c, d, e=2, **k): pass"),
    ("python","f(*a, b, *c, d=1, *e, **g)"),
    ("python","f(x for x in y)"),
    ("python","if (a := b): pass"),
    ("python","[y := 1, y**2]"),
    ("python","x[a:=1]"),
    ("python","lambda a, b=1, *c: 0"),
    ("python","lambda *, k: 0"),
    ("python","print(a := 3)"),
    ("python","async def f():\n async with a as b, c: pass\n"),
    ("python","x: int = yield"),
    ("python","for x in *a, b: pass"),
    ("python","return_ = 1\ndef f():\n return *a, b\n"),
    ("python","class A(B, metaclass=C): pass"),
    ("python","@a\ndef f(*, a: int = 1, **kw: str) -> None: ..."),
]
BAD = [
    ("python","a = b := c"),
    ("python","def f(a=1, b): pass"),
    ("python","f(**a, *b)"),
    ("python","f(a for a in b, c)"),
    ("javascript","if (x) {"),
    ("javascript","const a = <div>;"),
    ("typescript","let x: = 3"),
    ("bash","if x; then"),
    ("bash","echo \"abc"),
    ("java","class A {"),
    ("rust","/* a /* b */ fn f() {}"),
    ("rust","fn f( {}"),
    ("python","f(a=1, b)"),
    ("python","def f(**k, a): pass"),
    ("bash","case x in a) echo"),
    ("bash","x=$(echo"),
    ("javascript","`${a"),
    ("go","package a\nfunc f( {}")]


@pytest.mark.parametrize(("language", "text"), GOOD)
def test_valid(language, text):
    assert parsing.failure(language, text) is None
    assert language == "python" or parsing.source(language, text) is not None


@pytest.mark.parametrize(("language", "text"), BAD)
def test_broken(language, text):
    assert parsing.failure(language, text)
    assert language == "python" or parsing.source(language, text) is None


def test_scanners_agree_with_patterns():
    """Where no literal nests deeply both cut a text into the same classes."""
    texts = {
        "bash": "#!/bin/sh\n# c\nf() {\n  local a=\"$1 ${b:-x}\"\n  if [ -n \"$a\" ]; then echo $a | grep x > /dev/null 2>&1; fi\n}\ncase $1 in a|b) f;; *) exit 1;; esac\n",
        "javascript": "// c\nconst f = async (a, {b}) => { return a / b; };\nclass A extends B { static #x = 1; get y() { return `a${1}`; } }\n",
        "rust": "/// d\nfn f<'a>(x: &'a str) -> Option<char> { let c = '\\n'; Some(c) }\n",
    }
    for language, text in texts.items():
        assert [c for c, _, _ in exact.tokens(language, text) if c is not lexers.COMMENT] == lexers.tokens(language, text)


def test_shell_scripts_of_this_machine():
    """Scripts that the shell itself takes are valid."""
    import pathlib
    import shutil
    import subprocess

    if not shutil.which("bash"):
        pytest.skip("no shell here")
    wrong = []
    for path in sorted(pathlib.Path("/usr/bin").iterdir()):
        try:
            head = path.open("rb").read(40).split(b"\n")[0]
        except OSError:
            continue
        if head.startswith((b"#!/bin/sh", b"#!/bin/bash", b"#!/usr/bin/bash")) and not subprocess.run(["bash", "-n", path], capture_output=True, check=False).returncode:
            text = path.read_text(errors="replace")
            if parsing.failure("bash", text):
                wrong.append(path.name)
    assert wrong == []
