"""Declaration trees: what a source file declares, with exact ranges and the comments above.

A tree has a node for each container (class, implementation block, module, namespace) and each
function or method with a body; a function's inside is one range, as nothing in it counts. Python's
tree is the language's own; shells are read here, languages with braces in ``nodes``.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

from declarium.syntax import lexers


@dataclass
class Declaration:
    """A function node: its name, the offset of the name, its range, and its documentation comment."""

    name: str
    name_at: int
    start: int
    end: int
    doc: str | None = None


@dataclass
class Source:
    """A text cut into tokens: classes, offsets and ends; comments as (offset, end); bracket partners."""

    text: str
    classes: list[str] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    comments: list[tuple[int, int]] = field(default_factory=list)

    def word(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]]

    def lines(self) -> list[int]:
        """Offset of each line's beginning."""
        return [0, *[m.end() for m in re.finditer("\n", self.text)]]

    def partners(self) -> dict[int, int]:
        """Place of the closing token of each opening one; a text that parses has all."""
        out: dict[int, int] = {}
        stack: list[int] = []
        for i, c in enumerate(self.classes):
            if c in ("(", "[", "{"):
                stack.append(i)
            elif c in (")", "]", "}") and stack:
                out[stack.pop()] = i
        return out


def cut(language: str, text: str) -> Source:
    """The tokens of a ``plain`` text with their offsets; comments apart."""
    classes, found = lexers.pieces(language, text)
    rows = [x for x in zip(classes, accumulate(map(len, found), initial=0), found, strict=False) if x[0]]
    out = Source(text)
    out.comments = [(at, at + len(p.rstrip())) for c, at, p in rows if c is lexers.COMMENT]
    if out.comments:
        rows = [x for x in rows if x[0] is not lexers.COMMENT]
    out.classes = [x[0] for x in rows]
    out.starts = [x[1] for x in rows]
    out.ends = [at + len(p.rstrip() or p) for _, at, p in rows]
    return out


def of_tokens(text: str, found: list[tuple[str, int, int]]) -> Source:
    """The tokens of a text from (class, start, end) of each; comments apart."""
    out = Source(text)
    out.comments = [(a, b) for c, a, b in found if c is lexers.COMMENT]
    rows = [x for x in found if x[0] is not lexers.COMMENT]
    out.classes, out.starts, out.ends = ([x[k] for x in rows] for k in range(3))
    return out


def stream(language: str, source: Source) -> list[str]:
    """The token classes as the grammar takes them, from an already cut text."""
    return lexers.go_semicolons(source.classes) if language == "go" else source.classes


def shell_cut(text: str) -> Source:
    """The tokens of a ``plain`` shell text with their offsets; comments that stand alone apart."""
    out = Source(text)
    bare = lexers.blank_heredocs(text)
    if bare[:2] == "#!":
        end = bare.find("\n")
        bare = " " * (len(bare) if end < 0 else end) + ("" if end < 0 else bare[end:])
    for m in lexers.SHELL.finditer(bare):
        at, end = m.span(1)
        if at >= 0:
            out.classes.append(lexers.shell_class(bare[at:end]))
            out.starts.append(at)
            out.ends.append(end)
        elif bare[m.start()] == "#":
            out.comments.append(m.span())
    return out


def comment_above(source: Source, lines: list[int], covered: dict[int, tuple[int, int]], first: int, header: int, floor: int) -> str | None:
    """Comments directly above the line of offset ``header``; lines from ``first`` on hold annotations."""
    text = source.text
    at = bisect_right(lines, header) - 1
    top = bisect_right(lines, first) - 1
    parts: list[str] = []
    at -= 1
    while at >= 0:
        span = covered.get(at)
        if span is not None:
            if span[0] < floor:
                break
            parts.append(text[span[0] : span[1]])
            at = bisect_right(lines, span[0]) - 2
        elif at >= top and text[lines[at] : lines[at + 1]].strip():
            at -= 1
        else:
            break
    return "\n".join(reversed(parts)) if parts else None


def comments_by_line(text: str, lines: list[int], comments: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """Comment by its last line, of the comments that stand alone on their lines."""
    out: dict[int, tuple[int, int]] = {}
    for a, b in comments:
        first = bisect_right(lines, a) - 1
        last = bisect_right(lines, max(a, b - 1)) - 1
        end = lines[last + 1] if last + 1 < len(lines) else len(text)
        if not text[lines[first] : a].strip() and not text[b:end].strip():
            out[last] = (a, b)
    return out


def python_tree(text: str) -> list[Declaration] | None:
    """Functions and methods of a ``plain`` Python text with their docstrings; None if it has no tree."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None
    lines = [0, *[m.end() for m in re.finditer("\n", text)]]
    out: list[Declaration] = []
    offset_cache: dict[int, str] = {}

    def offset(line: int, column: int) -> int:
        """Offset in characters of a place that the tree gives in bytes."""
        start = lines[line - 1]
        if line not in offset_cache:
            offset_cache[line] = text[start : lines[line] if line < len(lines) else len(text)]
        row = offset_cache[line]
        return start + (column if row.isascii() else len(row.encode()[:column].decode(errors="ignore")))

    def visit(body: list[ast.stmt]) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                start = offset(node.lineno, node.col_offset)
                at = max(text.find(node.name, text.find("def", start) + 3), start)
                doc = node.body[0].value.value if node.body and isinstance(node.body[0], ast.Expr) and isinstance(node.body[0].value, ast.Constant) and isinstance(node.body[0].value.value, str) else None
                out.append(Declaration(node.name, at, start, offset(node.end_lineno, node.end_col_offset), doc))
            elif isinstance(node, ast.ClassDef):
                visit(node.body)
            elif isinstance(node, (ast.If, ast.For, ast.While, ast.With, ast.AsyncWith, ast.AsyncFor)):
                visit(node.body)
                visit(getattr(node, "orelse", []))
            elif isinstance(node, (ast.Try, ast.TryStar)):
                visit(node.body)
                for h in node.handlers:
                    visit(h.body)
                visit(node.orelse)
                visit(node.finalbody)
            elif isinstance(node, ast.Match):
                for case in node.cases:
                    visit(case.body)

    visit(tree.body)
    return out



SHELL_COMMAND = frozenset(["NL", ";", "&", "&&", "||", "|", "then", "do", "else", "elif", "{", "(", "!", "DSEMI"])


def shell_tree(source: Source) -> list[Declaration]:
    """Functions of a cut shell text, with the comments above."""
    c = source.classes
    lines = source.lines()
    covered = comments_by_line(source.text, lines, source.comments)
    out: list[Declaration] = []
    command, i, floor = True, 0, 0
    while i < len(c):
        name = body = -1
        if command and c[i] == "function" and i + 1 < len(c) and c[i + 1] != "NL":
            name, body = i + 1, i + 2
            if c[body : body + 2] == ["(", ")"]:
                body += 2
        elif command and c[i + 1 : i + 3] == ["(", ")"] and c[i] in ("NAME", "WORD"):
            name, body = i, i + 3
        if name < 0:
            command = c[i] in SHELL_COMMAND
            i += 1
            continue
        while body < len(c) and c[body] == "NL":
            body += 1
        end, level, command = body, 0, True
        while end < len(c):
            if command and c[end] in ("{", "("):
                level += 1
            elif (command and c[end] == "}") or c[end] == ")":
                level -= 1
                if level <= 0:
                    break
            command = c[end] in SHELL_COMMAND or c[end] == ")"
            end += 1
        start, last = source.starts[i], source.ends[min(end, len(c) - 1)]
        doc = comment_above(source, lines, covered, start, start, floor) if covered else None
        out.append(Declaration(source.word(name), source.starts[name], start, last, doc))
        floor, i, command = last, end + 1, True
    return out
