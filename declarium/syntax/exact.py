"""Tokens of texts whose literals nest without end, by scanners with a stack.

The patterns of ``lexers`` see a few levels of nesting and look behind a slash by a few characters;
they are fast and right for nearly every text. Where their tokens do not parse, these scanners read
the text again: quotes and substitutions of shells inside each other, templates inside templates,
expression literals after a closing bracket, mark-up, nested comments and raw strings with any number
of marks. Both give (class, start, end) of each token and comment.
"""

from __future__ import annotations

import re

from declarium.syntax import lexers

Token = tuple[str, int, int]


class _Unended(Exception):
    """A literal or group that never ends."""


# Shell -------------------------------------------------------------------------------------------

_REDIRECT = re.compile(r"\d*(?:<<<|<<-|<<|<>|>>|>\||<&|>&|<|>)|&>>?")
_OPERATOR = re.compile(r";;&|;;|;&|;|&&|&|\|\||\|&|\|")
_NAMED = re.compile(r"[A-Za-z_]\w*\+?=\(")
_SUBSCRIPT = re.compile(r"[A-Za-z_]\w*\[")
#: Words after which a command begins.
_BEGINS = frozenset(["", "\n", ";", "&", "&&", "||", "|", "|&", "(", "{", "!", "if", "then", "elif", "else", "while", "until", "do", "time", "DSEMI"])


class _Shell:
    def __init__(self, text: str):
        self.text, self.n = text, len(text)

    def skip_quoted(self, i: int) -> int:
        """The place after the double quote that ends the text from ``i``, which is inside it."""
        t = self.text
        while i < self.n:
            c = t[i]
            if c == '"':
                return i + 1
            i = self.skip_part(i) if c in "\\$`" else i + 1
        raise _Unended

    def skip_part(self, i: int) -> int:
        """The place after the escape, quote or substitution that begins at ``i``."""
        t = self.text
        c = t[i]
        if c == "\\":
            return i + 2
        if c == "'":
            return self.find("'", i + 1)
        if c == '"':
            return self.skip_quoted(i + 1)
        if c == "`":
            i += 1
            while i < self.n and t[i] != "`":
                i += 2 if t[i] == "\\" else 1
            if i >= self.n:
                raise _Unended
            return i + 1
        if c == "$":
            if t.startswith("$((", i):
                try:
                    return self.skip_arithmetic(i + 1)
                except _Unended:
                    pass
            if t.startswith("$(", i):
                return self.tokens(i + 2, True)[1]
            if t.startswith("${", i):
                return self.skip_braces(i + 2)
            if t.startswith("$'", i):
                i += 2
                while i < self.n and t[i] != "'":
                    i += 2 if t[i] == "\\" else 1
                if i >= self.n:
                    raise _Unended
                return i + 1
            return i + 1
        return i + 1

    def find(self, mark: str, i: int) -> int:
        at = self.text.find(mark, i)
        if at < 0:
            raise _Unended
        return at + 1

    def skip_braces(self, i: int) -> int:
        while i < self.n:
            c = self.text[i]
            if c == "}":
                return i + 1
            i = self.skip_part(i) if c in "\\'\"`$" else i + 1
        raise _Unended

    def skip_arithmetic(self, i: int) -> int:
        """The place after ``))`` of the ``((`` at ``i``."""
        depth = 0
        while i < self.n:
            c = self.text[i]
            if c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
                if depth == 0:
                    if self.text[i - 1] != ")":
                        raise _Unended
                    return i + 1
            if c in "\\\"`$":
                i = self.skip_part(i)
            else:
                i += 1
        raise _Unended

    def skip_group(self, i: int) -> int:
        """The place after the bracket that closes the one at ``i``; quotes and substitutions inside count as one."""
        depth = 0
        while i < self.n:
            c = self.text[i]
            if c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
                if depth == 0:
                    return i + 1
            i = self.skip_part(i) if c in "\\'\"`$" else i + 1
        raise _Unended

    def skip_word(self, i: int) -> int:
        t = self.text
        start = i
        if m := _SUBSCRIPT.match(t, i):
            at = t.find("]", m.end())
            while 0 <= at < self.n - 1 and "\n" not in t[m.end() : at]:
                if t.startswith(("=", "+="), at + 1):
                    i = at + 1
                    break
                at = t.find("]", at + 1)
        while i < self.n:
            c = t[i]
            if c in " \t\n;&|<>()":
                if c == "(" and i > start and t[i - 1] in "?*+@!" and (t[i - 1] != "!" or i - 1 > start):
                    i = self.skip_group(i)
                    continue
                if c in "<>" and t.startswith("(", i + 1):
                    i = self.tokens(i + 2, True)[1]
                    continue
                break
            if c == "\\" and t.startswith("\n", i + 1):
                i += 2
                continue
            i = self.skip_part(i) if c in "\\'\"`$" else i + 1
        return min(i, self.n)

    def tokens(self, i: int, inner: bool) -> tuple[list[Token], int]:
        """The tokens from ``i`` to the end, or, if ``inner``, to the bracket that closes what ``i`` is in."""
        t, n = self.text, self.n
        out: list[Token] = []
        waiting: list[tuple[str, str]] = []
        depth, cases, last, test = 0, 0, "", False
        in_case: list[bool] = []  # whether a pattern is read, for each case that is open
        while i < n:
            c = t[i]
            if c in " \t":
                i += 1
                continue
            if c == "\\" and t.startswith("\n", i + 1):
                i += 2
                continue
            if c == "#" and (i == 0 or t[i - 1] in " \t\n;&|()"):
                end = t.find("\n", i)
                end = n if end < 0 else end
                out.append((lexers.COMMENT, i, end))
                i = end
                continue
            if c == "\n":
                out.append(("NL", i, i + 1))
                i += 1
                for dash, word in waiting:
                    while True:
                        end = t.find("\n", i)
                        line = t[i : n if end < 0 else end]
                        i = n if end < 0 else end + 1
                        if (line.lstrip("\t") if dash else line) == word or end < 0:
                            break
                waiting.clear()
                last = "\n"
                continue
            if c in "<>&" or c.isdigit():
                m = _REDIRECT.match(t, i)
                if m and not (t[m.end() - 1] in "<>" and t.startswith("(", m.end()) and len(m.group().lstrip("0123456789")) == 1):
                    if m.group().lstrip("0123456789") in ("<<", "<<-") and not test:
                        i = m.end()
                        while i < n and t[i] in " \t":
                            i += 1
                        end = self.skip_word(i)
                        word = t[i:end]
                        waiting.append(("-" if m.group().endswith("-") else "", re.sub(r"\\(.)|['\"]", lambda x: x.group(1) or "", word)))
                        out.append(("HEREDOC", m.start(), end))
                        i = end
                    else:
                        out.append(("REDIRECT", m.start(), m.end()))
                        i = m.end()
                    last = "REDIRECT"
                    continue
            m = _OPERATOR.match(t, i)
            if m:
                kind = lexers.shell_class(m.group())
                out.append((kind, i, m.end()))
                if kind == "DSEMI" and in_case:
                    in_case[-1] = True
                i, last = m.end(), kind
                continue
            if c == "(":
                if t.startswith("((", i) and (last in _BEGINS or last == "for"):
                    try:
                        end = self.skip_arithmetic(i)
                        out.append(("ARITH", i, end))
                        i, last = end, "ARITH"
                        continue
                    except _Unended:
                        pass
                out.append(("(", i, i + 1))
                if not (in_case and in_case[-1]):
                    depth += 1
                i, last = i + 1, "("
                continue
            if c == ")":
                if in_case and in_case[-1]:
                    in_case[-1] = False
                elif depth == 0 and inner:
                    return out, i + 1
                else:
                    depth = max(0, depth - 1)
                out.append((")", i, i + 1))
                i, last = i + 1, "\n"
                continue
            if m := _NAMED.match(t, i):
                out.append(("ARRAY", i, m.end()))
                i, last = m.end(), "WORD"
                depth += 1
                continue
            end = self.skip_word(i)
            if end == i:
                end = i + 1
            word = t[i:end]
            kind = lexers.shell_class(word) if len(word) > 1 or word not in "$'\"`" else "WORD"
            begins = last in _BEGINS
            if word == "[[" and begins:
                test = True
            elif word == "]]":
                test = False
            if kind == "case" and begins:
                cases += 1
                last = "case"
            elif kind == "in" and cases > len(in_case):
                in_case.append(True)
                last = "\n"
            elif kind == "esac" and in_case and (begins or in_case[-1]):
                in_case.pop()
                cases -= 1
                last = "WORD"
            else:
                last = kind if kind in _BEGINS or kind == "for" else "WORD"
            out.append((kind, i, end))
            i = end
        if inner:
            raise _Unended
        return out, i


def shell(text: str) -> list[Token]:
    start = 0
    if text[:2] == "#!":
        start = text.find("\n")
        if start < 0:
            return []
    try:
        return _Shell(text).tokens(start, False)[0]
    except (_Unended, IndexError, RecursionError):
        return [("BAD", start, len(text))]


# Scripts -----------------------------------------------------------------------------------------

_SCRIPT = re.compile(
    rf"(?:[A-Za-z_$]|[^\W\d])[\w$]*|\#[A-Za-z_$][\w$]*|{lexers.JS_NUMBER}|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\""
    r"|=>|\.\.\.|===?|!==?|\*\*=?|&&=?|\|\|=?|\?\?=?|\?\.(?!\d)|\+\+|--|<<=?|<=|[-+*/%&|^]=|\S",
    re.S,
)
_EXPRESSION = re.compile(r"/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_TAG = re.compile(r"<\s*(/?)\s*([A-Za-z_$][\w$.:-]*)?")
_ATTRIBUTE = re.compile(r"\s*[A-Za-z_$][\w$:.-]*")
_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")
_BLANK = re.compile(r"\s*")
#: After these a slash divides and ``<`` compares.
_VALUES = frozenset(["ID", "NUM", "STR", "TEMPLATE", "REGEX", "CONST", "this", "super", "]", "}", "++", "--", "PRIVATE", "JSX", *lexers.JS_SOFT, "of", "get", "set", "from", "async", "static", "let"])


class _Script:
    def __init__(self, text: str, typed: bool):
        self.text, self.n = text, len(text)
        self.classify = lexers.SCRIPT[typed].__getitem__

    def template(self, i: int) -> int:
        """The place after the template that begins at ``i``."""
        t = self.text
        i += 1
        while i < self.n:
            c = t[i]
            if c == "`":
                return i + 1
            if c == "\\":
                i += 2
            elif t.startswith("${", i):
                i = self.tokens(i + 2, True)[1]
            else:
                i += 1
        raise _Unended

    def markup(self, i: int, out: list[Token]) -> int:
        """The place after the mark-up element at ``i``; its embedded expressions' tokens go to ``out``."""
        t = self.text
        m = _TAG.match(t, i)
        if not m or m.group(1):
            raise _Unended
        name, i = m.group(2) or "", m.end()
        if not name and not t.startswith(">", i):
            raise _Unended
        while True:
            i = _BLANK.match(t, i).end()
            if t.startswith("/>", i):
                return i + 2
            if t.startswith(">", i):
                i += 1
                break
            if t.startswith("{", i):
                i = self.embedded(i, out)
                continue
            a = _ATTRIBUTE.match(t, i)
            if not a:
                raise _Unended
            i = _BLANK.match(t, a.end()).end()
            if t.startswith("=", i):
                i = _BLANK.match(t, i + 1).end()
                if s := _STRING.match(t, i):
                    i = s.end()
                elif t.startswith("{", i):
                    i = self.embedded(i, out)
                else:
                    i = self.markup(i, out)
        while i < self.n:
            if t[i] == "{":
                i = self.embedded(i, out)
            elif t[i] == "<":
                m = _TAG.match(t, i)
                if m.group(1):
                    if (m.group(2) or "") != name or not t.startswith(">", end := _BLANK.match(t, m.end()).end()):
                        raise _Unended
                    return end + 1
                i = self.markup(i, out)
            else:
                i += 1
        raise _Unended

    def embedded(self, i: int, out: list[Token]) -> int:
        inside, end = self.tokens(i + 1, True)
        out.append(("{", i, i + 1))
        out += inside
        out.append(("}", end - 1, end))
        return end

    def tokens(self, i: int, inner: bool) -> tuple[list[Token], int]:
        t, n = self.text, self.n
        out: list[Token] = []
        open_: list[tuple[str, bool]] = []  # brackets, and whether a statement's head is in them
        last, value, before = "", False, ""  # the class before, whether a value ends there, the class before a bracket
        while i < n:
            c = t[i]
            if c == "\n":
                out.append(("NL", i, i + 1))
                i += 1
                continue
            if c.isspace():
                i += 1
                continue
            if t.startswith("//", i) or (i == 0 and t.startswith("#!")):
                end = t.find("\n", i)
                end = n if end < 0 else end
                out.append((lexers.COMMENT, i, end))
                i = end
                continue
            if t.startswith("/*", i):
                end = t.find("*/", i + 2)
                if end < 0:
                    raise _Unended
                out.append((lexers.COMMENT, i, end + 2))
                i = end + 2
                continue
            if c == "`":
                end = self.template(i)
                out.append(("TEMPLATE", i, end))
                i, last, value = end, "TEMPLATE", True
                continue
            if c == "/" and (not value or (last == "}" and out and out[-1][0] == "NL")) and (m := _EXPRESSION.match(t, i)):
                out.append(("REGEX", i, m.end()))
                i, last, value = m.end(), "REGEX", True
                continue
            if c == "<" and not value:
                inside: list[Token] = []
                try:
                    end = self.markup(i, inside)
                    out.append(("JSX", i, inside[0][1] if inside else end))
                    out += inside
                    i, last, value = end, "JSX", True
                    continue
                except (_Unended, AttributeError):
                    pass
            m = _SCRIPT.match(t, i)
            kind = self.classify(m.group())
            if kind in ("(", "[", "{"):
                open_.append((kind, kind == "(" and last in ("if", "while", "for", "with")))
                value = False
            elif kind in (")", "]", "}"):
                if not open_:
                    if inner and kind == "}":
                        return out, i + 1
                    value = kind != "}"
                else:
                    value = not open_.pop()[1]
            else:
                value = kind in _VALUES or (kind in lexers.JS_KEY and before == ".")
            out.append((kind, i, m.end()))
            before, last = kind, kind
            i = m.end()
        if inner:
            raise _Unended
        return out, i


def script(text: str, typed: bool) -> list[Token]:
    try:
        return _Script(text, typed).tokens(0, False)[0]
    except (_Unended, RecursionError):
        return [("BAD", 0, len(text))]


# Rust --------------------------------------------------------------------------------------------

_RAW = re.compile(r"[bc]?r(#*)\"")


def rust(text: str) -> list[Token]:
    out: list[Token] = []
    i, n = 0, len(text)
    while i < n:
        if text[i].isspace():
            i += 1
            continue
        if text.startswith("/*", i):
            depth, at = 1, i + 2
            while depth and at < n:
                if text.startswith("/*", at):
                    depth, at = depth + 1, at + 2
                elif text.startswith("*/", at):
                    depth, at = depth - 1, at + 2
                else:
                    at += 1
            out.append(("BAD" if depth else lexers.COMMENT, i, at))
            i = at
            continue
        if m := _RAW.match(text, i):
            end = text.find('"' + m.group(1), m.end())
            if end < 0:
                return [("BAD", i, n)]
            end += 1 + len(m.group(1))
            out.append(("STR", i, end))
            i = end
            continue
        m = lexers.RUST.match(text, i)
        piece = m.group()
        kind = lexers.rust_class(piece)
        if kind:
            out.append((kind, i, i + len(piece.rstrip() or piece)))
        i = m.end()
    return out


def tokens(language: str, text: str) -> list[Token] | None:
    """The tokens and comments of a ``plain`` text; None for languages whose patterns are exact."""
    if language == "bash":
        return shell(text)
    if language in ("javascript", "typescript"):
        return script(text, language == "typescript")
    return rust(text) if language == "rust" else None
