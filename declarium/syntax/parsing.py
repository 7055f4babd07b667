"""Judging texts by the grammar of their language, and the token sources that syntax trees are read from."""

from __future__ import annotations

import ast
import sys
import warnings

from declarium.syntax import exact, grammars, lexers, trees
from declarium.syntax.derive import Grammar, rules

#: Tokens after which a line break ends the statement.
RESTRICTED = frozenset(["return", "break", "continue", "throw"])
_GRAMMARS: dict[str, Grammar] = {}


def grammar(language: str) -> Grammar:
    """The language's grammar with its memo, one per process."""
    if language not in _GRAMMARS:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
        texts = {"python": grammars.PYTHON, "go": grammars.GO, "rust": grammars.RUST, "java": grammars.JAVA, "bash": grammars.SHELL}
        text = texts.get(language) or grammars.script(language == "typescript")
        _GRAMMARS[language] = Grammar(text, "file")
    return _GRAMMARS[language]


def _run(language: str, classes: list[str]) -> int:
    g = grammar(language)
    return g.run_inserting(classes, RESTRICTED) if language in ("javascript", "typescript") else g.run(classes)


def failure(language: str, text: str) -> tuple[str, int, int] | None:
    """None for a valid text; else (``token`` or ``truncated``, place of the token, number of tokens).

    A text whose tokens do not parse is read again by the exact scanner of its language, if it has one.
    For Python, a text that the grammar rejects is tried by the language's own parser, which can only acquit.
    """
    text = lexers.plain(text)
    found = lexers.tokens(language, text)
    at = _run(language, found)
    if at >= 0 and (again := exact.tokens(language, text)) is not None:
        found = [c for c, _, _ in again if c is not lexers.COMMENT]
        at = _run(language, found)
    if at < 0 or (language == "python" and own_parser_takes(text)):
        return None
    return ("truncated" if at >= len(found) else "token"), at, len(found)


def own_parser_takes(text: str) -> bool:
    """Whether Python's own parser takes a ``plain`` text."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
    return True


def source(language: str, text: str) -> trees.Source | None:
    """The tokens of a ``plain`` text with their places, or None if it is not valid; for languages other than Python."""
    out = trees.shell_cut(text) if language == "bash" else trees.cut(language, text)
    if _run(language, trees.stream(language, out)) < 0:
        return out
    again = exact.tokens(language, text)
    if again is None:
        return None
    out = trees.of_tokens(text, again)
    return out if _run(language, trees.stream(language, out)) < 0 else None


def terminals(text: str) -> list[str]:
    """The token classes that a grammar's text names, sorted."""
    found: set[str] = set()

    def visit(tree: tuple) -> None:
        if tree[0] == "tok":
            found.add(tree[1])
        elif tree[0] in ("alt", "seq"):
            for x in tree[1]:
                visit(x)
        elif tree[0] == "star":
            visit(tree[1])

    for tree in rules(text).values():
        visit(tree)
    return sorted(found)
