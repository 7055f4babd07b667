"""Syntax trees of source files in languages with braces: containers, functions, what functions do.

A walker reads the tokens of a file once. It descends into containers (classes, implementations,
modules, namespaces) and functions, nested ones included, and notes for each function its own calls,
the names it declares, reads and writes, and what it does to its instance. Where only declarations
matter, bodies of functions stay closed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from declarium.syntax.trees import Declaration, Source, comment_above, comments_by_line

CONTAINERS = ("file", "class", "module")


@dataclass
class Param:
    """A parameter as it is written; ``kind`` as in the catalog."""

    name: str
    raw_type: str | None = None
    default: str | None = None
    kind: str = "positional"


@dataclass(eq=False)
class Node:
    """A container or function; places are indices of tokens, ``last`` is its last one."""

    kind: str
    name: str = ""
    name_at: int = -1
    first: int = 0
    header: int = 0
    last: int = 0
    body: tuple[int, int] | None = None
    parent: Node | None = None
    params: list[Param] = field(default_factory=list)
    returns: str | None = None
    is_async: bool = False
    receiver: str | None = None
    within: bool = False  # whether it is a part of an expression, bound to no name of its own
    holds: str | None = None  # how the receiver, or a moving closure, holds what it has
    children: list[Node] = field(default_factory=list)
    calls: dict[str, None] = field(default_factory=dict)
    declared: set[str] = field(default_factory=set)
    reads: set[str] = field(default_factory=set)
    writes: set[str] = field(default_factory=set)
    reads_instance: bool = False
    writes_instance: bool = False

    def above(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def walk(self) -> Iterator[Node]:
        for child in self.children:
            yield child
            yield from child.walk()

    @property
    def is_function(self) -> bool:
        return self.kind not in CONTAINERS

    def state(self) -> str:
        """What the function captures, in the catalog's words."""
        if self.kind == "method":
            return self.holds or ("mutates_instance" if self.writes_instance else "reads_instance" if self.reads_instance else "pure")
        if self.holds:
            return self.holds
        outside: set[str] = set()
        for node in self.above():
            if node.is_function:
                outside |= node.declared
        outside -= self.declared
        return "mutates_captured" if self.writes & outside else "reads_captured" if (self.reads | self.writes) & outside else "pure"


class Walker:
    """Builds the tree of one file. A language says where something begins (``head``) and what a token does."""

    names = frozenset(["ID"])
    #: Tokens between the parts of a called name; tokens that write the name before them.
    joints = frozenset(["."])
    assigns = frozenset(["=", "OPASSIGN", "++", "--"])
    instance = frozenset(["this"])

    def __init__(self, source: Source, deep: bool = True):
        self.s, self.c, self.deep = source, source.classes, deep
        self.partner = source.partners()
        self.n = len(self.c)

    def tree(self) -> Node:
        root = Node("file", last=max(self.n - 1, 0), body=(0, self.n))
        self.block(0, self.n, root)
        return root

    # tokens
    def at(self, i: int) -> str:
        return self.c[i] if 0 <= i < self.n else ""

    def word(self, i: int) -> str:
        return self.s.word(i)

    def text(self, a: int, b: int) -> str | None:
        """The text of tokens ``a`` to ``b``, the last one excluded, on one line; None if there are none."""
        if a >= b:
            return None
        return " ".join(self.s.text[self.s.starts[a] : self.s.ends[b - 1]].split())

    def after(self, i: int) -> int:
        """The token after ``i`` or after the group that it opens."""
        return self.partner.get(i, i) + 1

    def until(self, i: int, end: int, stops: tuple[str, ...]) -> int:
        while i < end and self.c[i] not in stops:
            i = self.after(i)
        return min(i, end)

    def parts(self, opening: int) -> list[tuple[int, int]]:
        """The ranges between commas of the group that begins at ``opening``; angle brackets count as groups."""
        out, i, depth = [], opening + 1, 0
        end = self.partner.get(opening, opening)
        start = i
        while i < end:
            k = self.c[i]
            if k == "<":
                depth += 1
            elif k == ">" and self.at(i - 1) != "=":
                depth = max(0, depth - 1)
            if k == "," and not depth:
                out.append((start, i))
                start = i + 1
            i = self.after(i)
        if start < end:
            out.append((start, end))
        return [(a, b) for a, b in out if a < b]

    def before_lines(self, i: int) -> int:
        """The token before ``i`` that is no line break."""
        i -= 1
        while i >= 0 and self.c[i] == "NL":
            i -= 1
        return i

    def next_lines(self, i: int) -> int:
        while i < self.n and self.c[i] == "NL":
            i += 1
        return i

    # tree
    def head(self, i: int, end: int, scope: Node) -> Node | None:
        raise NotImplementedError

    def block(self, i: int, end: int, scope: Node) -> None:
        while i < end:
            node = self.head(i, end, scope)
            if node is None:
                if scope.is_function:
                    self.note(i, scope)
                i += 1
                continue
            self.enter(node, scope)
            i = max(node.last, i) + 1

    def enter(self, node: Node, scope: Node) -> None:
        node.parent = scope
        scope.children.append(node)
        if not node.body:
            return
        if node.is_function:
            node.declared |= {p.name for p in node.params}
            if self.deep:
                self.block(*node.body, node)
        elif node.kind == "class":
            self.members(*node.body, node)
        else:
            self.block(*node.body, node)

    def members(self, i: int, end: int, scope: Node) -> None:
        self.block(i, end, scope)

    # what a function does
    def note(self, i: int, scope: Node) -> None:
        k = self.c[i]
        if k in self.instance:
            self.instance_use(i, scope)
        if k not in self.names:
            return
        name, before = self.word(i), self.at(i - 1)
        if scope.receiver == name and before not in self.joints:
            self.instance_use(i, scope)
        if self.called(i) and not self.declares(i, scope):
            chain, j = [name], i
            while self.at(j - 1) in self.joints and (self.at(j - 2) in self.names or self.at(j - 2) in self.instance or self.at(j - 2) in ("self", "Self", "super", "crate")):
                j -= 2
                chain.append(self.word(j))
            scope.calls.setdefault(".".join(reversed(chain)))
        if before in self.joints:
            return
        if self.declares(i, scope):
            scope.declared.add(name)
        elif self.assigned(i + 1) or before in ("++", "--"):
            scope.writes.add(name)
        else:
            scope.reads.add(name)

    def called(self, i: int) -> bool:
        return self.at(i + 1) == "("

    def declares(self, i: int, scope: Node) -> bool:
        return False

    def instance_use(self, i: int, scope: Node) -> None:
        scope.reads_instance = True
        j = i + 1
        while self.at(j) in self.joints or self.at(j) == "[":
            j = self.after(j) if self.at(j) == "[" else j + 2
        if j > i + 1 and self.assigned(j):
            scope.writes_instance = True

    def assigned(self, i: int) -> bool:
        """Whether the token writes what stands before it."""
        return self.at(i) in self.assigns

    def function(self, scope: Node, name_at: int, first: int, header: int, last: int, **given) -> Node:
        name = self.word(name_at) if name_at >= 0 else given.pop("name", "<closure>")
        given.pop("name", None)
        kind = given.pop("kind", None) or ("method" if scope.kind == "class" else "closure" if scope.is_function else "function")
        return Node(kind, name, name_at, first, header, last, **given)

    # imports
    def imports(self) -> list[str]:
        return []


def _unquoted(text: str) -> str:
    return text.strip("\"'`")


class Go(Walker):
    assigns = frozenset(["=", "OPASSIGN", "++", "--"])
    instance = frozenset()

    def head(self, i: int, end: int, scope: Node) -> Node | None:
        if self.c[i] != "func":
            return None
        j, receiver, name_at, classes = i + 1, None, -1, None
        if self.at(j) == "(" and self.at(self.after(j)) == "ID" and self.at(self.after(j) + 1) in ("(", "["):
            owner = self.params(j)
            receiver = owner[0] if owner else None
            classes = (receiver.raw_type or "").lstrip("*& ").split("[")[0] if receiver else None
            j = self.after(j)
        if self.at(j) == "ID":
            name_at, j = j, j + 1
            if self.at(j) == "[":
                j = self.after(j)
        if self.at(j) != "(":
            return None
        params, j = self.params(j), self.after(j)
        opening = j
        while opening < end and self.c[opening] not in ("{", "NL", ";", ",", ")", "=", "}"):
            opening = self.after(opening + 1) if self.c[opening] in ("interface", "struct") and self.at(opening + 1) == "{" else self.after(opening)
        if self.at(opening) != "{":
            return None
        last = self.partner.get(opening, opening)
        node = self.function(scope, name_at, i, i, last, params=params, returns=self.text(j, opening), body=(opening + 1, last))
        if receiver:
            node.kind, node.receiver = "method", receiver.name
            node.params = [Param(receiver.name, receiver.raw_type, None, "receiver"), *params]
            node.holds_class = classes  # type: ignore[attr-defined]
        elif name_at < 0:
            node.kind = "closure" if scope.is_function else "function"
            node.within = True
            at = self.before_lines(i)
            if scope.kind == "file" and self.at(at) == "=" and self.at(at - 1) == "ID" and self.at(at - 2) == "var":
                node.name_at, node.name, node.first, node.header, node.within = at - 1, self.word(at - 1), at - 2, at - 2, False
        return node

    def params(self, opening: int) -> list[Param]:
        parts = [(a, b) for a, b in self.parts(opening)]
        out: list[Param] = []
        named = any(self.c[a] == "ID" and b - a > 1 and self.c[a + 1] not in (".", "[") or self.c[a] == "ID" and b - a > 2 and self.c[a + 1] == "[" and self.after(a + 1) < b for a, b in parts)
        waiting: list[str] = []
        for a, b in parts:
            if not named:
                kind = "variadic" if self.c[a] == "..." else "positional"
                out.append(Param(f"arg{len(out)}", self.text(a + (kind == "variadic"), b), None, kind))
            elif b - a == 1:
                waiting.append(self.word(a))
            else:
                variadic = self.c[a + 1] == "..."
                text = self.text(a + 1 + variadic, b)
                out += [Param(w, text) for w in waiting] + [Param(self.word(a), text, None, "variadic" if variadic else "positional")]
                waiting = []
        return out

    def declares(self, i: int, scope: Node) -> bool:
        if self.at(i - 1) in ("var", "const"):
            return True
        j = i
        while self.at(j + 1) == "," and self.at(j + 2) == "ID":
            j += 2
        if self.at(j + 1) != ":=":
            return False
        while self.at(i - 1) == "," and self.at(i - 2) == "ID":
            i -= 2
        return self.at(i - 1) in ("", "NL", ";", "{", "}", "for", "if", "switch", "case", ":")

    def imports(self) -> list[str]:
        out, i = [], 0
        while i < self.n:
            if self.c[i] == "import":
                stop = self.after(i + 1) if self.at(i + 1) == "(" else self.until(i, self.n, ("NL", ";"))
                out += [_unquoted(self.word(k)) for k in range(i, min(stop, self.n)) if self.c[k] == "STR"]
                i = stop
            elif self.c[i] in ("func", "type", "var", "const"):
                break
            i += 1
        return out


class Rust(Walker):
    joints = frozenset([".", "::"])
    instance = frozenset(["self"])
    names = frozenset(["ID"])

    def attributes(self, i: int, scope: Node) -> int:
        """The first token of the attributes before ``i``."""
        while True:
            j = i - 1
            if self.at(j) == "]" and (opening := next((k for k in range(j, max(-1, j - 400), -1) if self.partner.get(k) == j), -1)) > 0 and self.at(opening - 1) == "#":
                i = opening - 1
            else:
                return i

    def start(self, i: int) -> tuple[int, int]:
        """(first token with attributes, first of the header) of what the keyword at ``i`` declares."""
        while self.at(i - 1) in ("async", "unsafe", "extern", "const", "default", "pub") or (self.at(i - 1) == "STR" and self.at(i - 2) == "extern") or (self.at(i - 1) == ")" and self.is_visibility(i - 1)):
            if self.at(i - 1) == ")":
                i -= 1
                while self.at(i) != "(":
                    i -= 1
            i -= 1
        return self.attributes(i, None), i

    def is_visibility(self, i: int) -> bool:
        k = i
        while k >= 0 and self.c[k] != "(":
            k -= 1
        return self.at(k - 1) == "pub" and i - k < 6

    def head(self, i: int, end: int, scope: Node) -> Node | None:
        k = self.c[i]
        if k == "fn" and self.at(i + 1) == "ID":
            j = self.until(i + 2, end, ("(",)) if self.at(i + 2) != "<" else self.generic(i + 2, end)
            if self.at(j) != "(":
                return None
            params, close = self.params(j), self.after(j)
            opening = self.until(close, end, ("{", ";"))
            if self.at(opening) != "{":
                return None
            last = self.partner.get(opening, opening)
            where = next((x for x in range(close, opening) if self.c[x] == "where"), opening)
            first, header = self.start(i)
            node = self.function(scope, i + 1, first, header, last, params=params, returns=self.text(close + 1, where) if self.at(close) == "->" else None, body=(opening + 1, last), is_async="async" in self.c[header:i])
            if params and params[0].kind == "receiver":
                node.kind = "method"
                text = params[0].raw_type or ""
                node.holds = "mutates_instance" if "mut" in text and text.startswith("&") else "reads_instance" if text.startswith("&") else "consumes"
            elif node.kind == "method":
                node.kind = "function"
            return node
        if k in ("impl", "trait", "mod") and self.at(i - 1) not in ("->", ":", "<", ",", "(", "&", "=", "dyn"):
            opening = self.until(i + 1, end, ("{", ";"))
            if self.at(opening) != "{":
                return None
            last = self.partner.get(opening, opening)
            name_at = i + 1
            if k == "impl":
                j = self.generic(i + 1, opening) if self.at(i + 1) == "<" else i + 1
                owner = next((x + 1 for x in range(j, opening) if self.c[x] == "for" and self.at(x + 1) != "<"), j)
                while owner < opening and self.c[owner] in ("&", "LIFETIME", "mut", "!", "(", "dyn", "::"):
                    owner += 1
                while self.at(owner + 1) == "::" and self.at(owner + 2) in ("ID", "Self"):
                    owner += 2
                name_at = owner
            return Node("module" if k == "mod" else "class", self.word(name_at) if name_at < self.n else "", name_at, i, i, last, (opening + 1, last))
        if k in ("|", "||") and self.at(i - 1) in ("(", ",", "=", "{", ";", "move", "=>", "return", "else", "async", "static", "", "}", "[", ":"):
            close = i if k == "||" else next((x for x in range(i + 1, end) if self.c[x] == "|"), end)
            if close >= end:
                return None
            params = [self.pattern(a, b) for a, b in self.between(i + 1, close)] if k == "|" else []
            j = close + 1
            returns = None
            if self.at(j) == "->":
                opening = self.until(j, end, ("{",))
                returns, j = self.text(j + 1, opening), opening
            if self.at(j) == "{":
                last = self.partner.get(j, j)
                body = (j + 1, last)
            else:
                stop = self.until(j, end, (",", ";", ")", "]", "}"))
                last, body = max(stop - 1, close), (j, stop)
            moving = self.at(i - 1) == "move"
            first = i - 1 if moving else i
            node = self.function(scope, -1, first, first, last, name="<closure>", kind="closure", params=params, returns=returns, body=body)
            node.holds, node.within = "consumes" if moving else None, True
            before = self.at(first - 1)
            if before == "=" and not scope.is_function:
                at = next((x for x in range(first - 2, max(-1, first - 60), -1) if self.c[x] in ("const", "static")), -1)
                if at >= 0:
                    node.kind, node.within = "function", False
                    node.name_at = at + 2 if self.at(at + 1) == "mut" else at + 1
                    node.name = self.word(node.name_at)
                    node.first, node.header = self.start(at)
            return node
        return None

    def generic(self, i: int, end: int) -> int:
        """The token after the angle brackets at ``i``."""
        depth = 0
        while i < end:
            if self.c[i] == "<":
                depth += 1
            elif self.c[i] == ">":
                depth -= 1
                if not depth:
                    return i + 1
            i = self.after(i) if self.c[i] in ("(", "[", "{") else i + 1
        return end

    def between(self, a: int, b: int) -> list[tuple[int, int]]:
        out, start, i = [], a, a
        while i < b:
            if self.c[i] == ",":
                out.append((start, i))
                start = i + 1
            i = self.after(i)
        return [(x, y) for x, y in [*out, (start, b)] if x < y]

    def pattern(self, a: int, b: int) -> Param:
        colon = self.until(a, b, (":",))
        names = [self.word(x) for x in range(a, colon) if self.c[x] == "ID"]
        return Param(names[0] if len(names) == 1 else "_".join(names) or "_", self.text(colon + 1, b))

    def params(self, opening: int) -> list[Param]:
        out = []
        for a, b in self.parts(opening):
            while self.c[a] == "#":
                a = self.after(a + 1)
            colon = self.until(a, b, (":",))
            if "self" in self.c[a:colon]:
                out.append(Param("self", self.text(a, b), None, "receiver"))
            elif self.c[a] != "...":
                out.append(self.pattern(a, b))
        return out

    def assigned(self, i: int) -> bool:
        k = self.at(i)
        return k == "=" or (k == "BINARY" and self.word(i) not in ("==", "!=", "<=") and self.word(i)[-1] == "=") or (k in ("+", "-", "*", "&", "|") and self.at(i + 1) == "=" and self.s.ends[i] == self.s.starts[i + 1])

    def declares(self, i: int, scope: Node) -> bool:
        j = i - 1
        while self.at(j) in ("mut", "ref", "(", ",", "ID", "&") and j > i - 12:
            if self.at(j) in ("ID",) and self.at(j + 1) not in (",", ")"):
                return False
            j -= 1
        return self.at(j) == "let" or (self.at(j) == "for" and self.at(i + 1) in ("in", ",", ")"))

    def imports(self) -> list[str]:
        out = []
        for i, k in enumerate(self.c):
            if k == "use" and self.at(i - 1) in ("", ";", "}", "pub", ")", "]", "{"):
                out.append((self.text(i + 1, self.until(i, self.n, (";",))) or "").replace(" ", "").split("{")[0].rstrip(":"))
            elif k == "extern" and self.at(i + 1) == "crate":
                out.append(self.word(i + 2))
        return out


class Java(Walker):
    names = frozenset(["ID", "record", "var", "yield", "sealed", "permits", "when"])
    joints = frozenset([".", "::"])
    kinds = frozenset(["class", "interface", "enum", "record"])

    def head(self, i: int, end: int, scope: Node) -> Node | None:
        k = self.c[i]
        if k in self.kinds and self.at(i + 1) in self.names and self.at(i - 1) not in (".", "::") and (k != "record" or self.at(i + 2) in ("(", "<")):
            opening = self.until(i + 2, end, ("{", ";", "="))
            if self.at(opening) != "{":
                return None
            last = self.partner.get(opening, opening)
            node = Node("class", self.word(i + 1), i + 1, i, i, last, (opening + 1, last))
            node.is_enum = k == "enum"  # type: ignore[attr-defined]
            return node
        if k == "->" and self.at(i - 1) in (*self.names, ")") and self.before_case(i):
            return None
        if k in self.names and self.at(i + 1) == "->" and not self.before_case(i + 1):
            return self.lambda_(i, i + 1, [Param(self.word(i))], end, scope)
        if k == "(" and self.at(self.after(i)) == "->" and not self.before_case(self.after(i)):
            return self.lambda_(i, self.after(i), self.params(i, True), end, scope)
        return None

    def before_case(self, arrow: int) -> bool:
        """Whether the arrow belongs to a case of a switch."""
        i = arrow - 1
        while i >= 0 and self.c[i] not in (";", "{", "}", "->", "(", ","):
            if self.c[i] in ("case", "default"):
                return True
            if self.c[i] == ")":
                i = next((x for x in range(i, -1, -1) if self.partner.get(x) == i), 0)
            i -= 1
        while i >= 0 and self.c[i] == ",":
            i -= 1
            while i >= 0 and self.c[i] not in (";", "{", "}", "->", "(", ","):
                if self.c[i] == "case":
                    return True
                i -= 1
        return False

    def lambda_(self, first: int, arrow: int, params: list[Param], end: int, scope: Node) -> Node:
        j = arrow + 1
        if self.at(j) == "{":
            last = self.partner.get(j, j)
            body = (j + 1, last)
        else:
            stop = self.until(j, end, (",", ";", ")", "]", "}"))
            last, body = max(stop - 1, arrow), (j, stop)
        node = self.function(scope, -1, first, first, last, name="<lambda>", kind="lambda", params=params, body=body)
        node.within = True
        return node

    def members(self, i: int, end: int, scope: Node) -> None:
        if getattr(scope, "is_enum", False):
            stop = self.until(i, end, (";",))
            self.block(i, stop, scope)
            i = min(stop + 1, end)
        first, header, name, begin = i, -1, -1, -1
        while i < end:
            k = self.c[i]
            if k == "@" and self.at(i + 1) != "interface":
                i += 2
                while self.at(i) == "." and i < end:
                    i += 2
                if self.at(i) == "(":
                    i = self.after(i)
                continue
            if header < 0 and k != ";":
                header = i
            if (k in self.kinds and self.at(i + 1) in self.names) or (k == "@" and self.at(i + 1) == "interface"):
                node = self.head(i + (k == "@"), end, scope)
                if node is None:
                    i += 1
                    continue
                node.first, node.header = first, header
                self.enter(node, scope)
                i = node.last + 1
            elif k == ";":
                i += 1
            elif k == "{":
                if name >= 0 and self.at(i - 1) in self.names:  # a compact constructor
                    self.method(scope, name, begin, first, header, -1, i)
                elif self.deep:  # an initializer: what it holds belongs to the class
                    self.block(i + 1, self.partner.get(i, i), scope)
                i = self.after(i)
            elif k == "=":
                stop = self.until(i, end, (";",))
                if self.deep:
                    self.block(i + 1, stop, scope)
                i = stop + 1
            elif k == "(" and name >= 0:
                stop = self.until(self.after(i), end, ("{", ";", "default"))
                if self.at(stop) == "{":
                    self.method(scope, name, begin, first, header, i, stop)
                    i = self.after(stop)
                else:
                    stop = self.until(stop, end, (";",))
                    self.method(scope, name, begin, first, header, i, -1, stop)
                    i = stop + 1
            else:
                if k in self.names:
                    name = i
                    begin = header if begin < 0 else begin
                else:
                    name = -1
                i = self.after(i)
                continue
            first, header, name, begin = i, -1, -1, -1

    def method(self, scope: Node, name: int, begin: int, first: int, header: int, opening: int, brace: int, stop: int = -1) -> None:
        last = self.partner.get(brace, brace) if brace >= 0 else stop
        a = header
        while a < name and self.c[a] in ("MODIFIER", "static", "final", "default", "synchronized", "sealed", "@"):
            if self.c[a] == "@":
                a += 2
                while self.at(a) == ".":
                    a += 2
                if self.at(a) == "(":
                    a = self.after(a)
            else:
                a += 1
        if self.at(a) == "<":
            depth = 0
            while a < name:
                depth += {"<": 1, ">": -1}.get(self.c[a], 0)
                a += 1
                if not depth:
                    break
        params = self.params(opening, False) if opening >= 0 else []
        node = self.function(scope, name, first, header, last, kind="method", params=params, returns=self.text(a, name), body=(brace + 1, last) if brace >= 0 else None)
        self.enter(node, scope)

    def params(self, opening: int, bare: bool) -> list[Param]:
        out = []
        for a, b in self.parts(opening):
            while a < b and self.c[a] in ("final", "@"):
                if self.c[a] == "@":
                    a += 2
                    if self.at(a) == "(":
                        a = self.after(a)
                else:
                    a += 1
            at = b - 1
            while at > a and self.c[at] in ("]", "["):
                at -= 1
            if self.c[at] == "this":
                continue
            variadic = "..." in self.c[a:at]
            text = self.text(a, at - variadic) if at > a else None
            out.append(Param(self.word(at), text, None, "variadic" if variadic else "positional"))
        return out

    def declares(self, i: int, scope: Node) -> bool:
        before = self.at(i - 1)
        return (before in self.names or before in ("PRIM", ">", "]", "var")) and self.at(i + 1) in ("=", ";", ":", ",", ")", "[")

    def imports(self) -> list[str]:
        out = []
        for i, k in enumerate(self.c):
            if k == "import" and self.at(i - 1) in ("", ";"):
                a = i + 2 if self.at(i + 1) == "static" else i + 1
                out.append((self.text(a, self.until(a, self.n, (";",))) or "").replace(" ", ""))
            elif k in self.kinds:
                break
        return out


class Script(Walker):
    names = frozenset(["ID", "async", "of", "get", "set", "from", "as", "static", "let", "await", "yield", "type", "interface", "enum", "namespace", "module", "declare", "abstract", "implements", "readonly", "override", "keyof", "unique", "infer", "is", "asserts", "satisfies", "global"])
    joints = frozenset([".", "?."])

    def head(self, i: int, end: int, scope: Node) -> Node | None:
        k = self.c[i]
        if k == "function" and self.at(i - 1) not in self.joints:
            name = self.next_lines(i + 1)
            if self.at(name) == "*":
                name = self.next_lines(name + 1)
            opening = self.until(name, end, ("(",))
            brace = self.body(self.after(opening), end)
            if brace < 0:
                return None
            is_async = self.at(self.before_lines(i)) == "async"
            own = self.at(name) in self.names
            node = self.made(scope, name if own else -1, i - 1 if is_async else i, opening, brace, is_async, end)
            if own and self.begins(node.first):
                return self.statement(node)
            return self.bound(node, scope)
        if k == "class" and self.at(i - 1) not in self.joints:
            opening = self.until(i + 1, end, ("{",))
            if self.at(opening) != "{":
                return None
            last = self.partner.get(opening, opening)
            name = i + 1 if self.at(i + 1) in self.names and self.at(i + 1) not in ("extends", "implements") else -1
            return Node("class", self.word(name) if name >= 0 else "", name, i, i, last, (opening + 1, last))
        if k in ("namespace", "module") and self.at(i + 1) in ("ID", "STR") and self.at(self.until(i + 1, end, ("{", "NL", ";", "="))) == "{":
            opening = self.until(i + 1, end, ("{",))
            last = self.partner.get(opening, opening)
            return Node("module", _unquoted(self.word(i + 1)), i + 1, i, i, last, (opening + 1, last))
        if k in ("interface", "enum") and self.at(i + 1) in self.names and self.begins(i):
            opening = self.until(i + 1, end, ("{",))
            return Node("class", self.word(i + 1), i + 1, i, i, self.partner.get(opening, opening)) if self.at(opening) == "{" else None
        if k in self.names and self.at(i + 1) == "=>":
            return self.arrow(i, i + 1, -1, scope, end)
        if k == "(":
            arrow = self.after(i)
            if self.at(arrow) == ":":
                arrow = self.type_end(arrow, end, ("=>", "NL", ";", ",", ")", "?", "=", "}"))
            if self.at(arrow) == "=>":
                return self.arrow(i, arrow, i, scope, end)
            if self.at(i - 1) in (*self.names, "STR") and self.at(self.before_lines(i - 1)) in ("{", ",") and scope.kind != "class":
                brace = self.body(self.after(i), end)
                if brace >= 0 and self.at(self.after(i)) in ("{", ":"):
                    node = self.made(scope, i - 1, i - 1, i, brace, False, end)
                    node.within = True
                    return node
        return None

    def type_end(self, i: int, end: int, stops: tuple[str, ...]) -> int:
        """As ``until``, over a type: what stands in angle brackets is passed."""
        angles = 0
        while i < end and (angles > 0 or self.c[i] not in stops):
            angles += {"<": 1, ">": -1}.get(self.c[i], 0)
            i = self.after(i)
        return min(i, end)

    def begins(self, i: int) -> bool:
        return self.at(i - 1) in ("", "NL", ";", "{", "}", "export", "declare", "default", "const")

    def statement(self, node: Node) -> Node:
        """A declaration begins with the words before it."""
        first = node.first
        while self.at(first - 1) in ("export", "default", "declare", "async"):
            first -= 1
        node.first = node.header = first
        return node

    def bound(self, node: Node, scope: Node) -> Node:
        """A function value has the name that it is bound to."""
        node.within = True
        at = self.before_lines(node.first)
        if self.at(at) == "<" or self.at(at) == ">":
            while at > 0 and self.c[at] != "<":
                at -= 1
            at -= 1
        if self.at(at) not in ("=", ":"):
            return node
        name = self.before_lines(at)
        if self.at(at) == "=":
            back, angles = name, 0
            while back > 0 and self.c[back] not in ("NL", ";", "{", "}", "const", "let", "var", "=") and (angles or self.c[back] != ","):
                angles += {">": 1, "<": -1}.get(self.c[back], 0)
                back -= 1
            if self.at(back) in ("const", "let", "var"):
                name = back + 1
                first = back
                while self.at(first - 1) in ("export", "declare", "default"):
                    first -= 1
                node.first = node.header = first
                node.within = False
        if self.at(name) in (*self.names, "STR"):
            node.name_at, node.name = name, _unquoted(self.word(name))
        return node

    def made(self, scope: Node, name_at: int, first: int, opening: int, brace: int, is_async: bool, end: int) -> Node:
        last = self.partner.get(brace, brace)
        after = self.after(opening)
        returns = self.text(after + 1, brace) if self.at(after) == ":" else None
        return self.function(scope, name_at, first, first, last, name="<function>", params=self.params(opening), returns=returns, body=(brace + 1, last), is_async=is_async)

    def arrow(self, first: int, arrow: int, opening: int, scope: Node, end: int) -> Node:
        params = self.params(opening) if opening >= 0 else [Param(self.word(first))]
        j = self.next_lines(arrow + 1)
        if self.at(j) == "{":
            last = self.partner.get(j, j)
            body = (j + 1, last)
        else:
            stop = j
            while stop < end and self.c[stop] not in (",", ";", ")", "]", "}"):
                if self.c[stop] == "NL" and not (self.at(self.next_lines(stop)) in (".", "?.", "?", ":", "BINARY", "+", "*", "&", "|") or self.at(stop - 1) in ("=>", "BINARY", "+", "?", ":", "(", ",", "=")):
                    break
                stop = self.after(stop)
            last, body = max(stop - 1, arrow), (j, stop)
        is_async = self.at(first - 1) == "async"
        returns = self.text(self.after(opening) + 1, arrow) if opening >= 0 and self.at(self.after(opening)) == ":" else None
        node = self.function(scope, -1, first - is_async, first - is_async, last, name="<lambda>", params=params, returns=returns, body=body, is_async=is_async)
        self.bound(node, scope)
        if node.name_at < 0:
            node.kind = "lambda"
        return node

    def body(self, i: int, end: int) -> int:
        """The opening brace of the body after the parameters that end before ``i``, or -1."""
        if self.at(i) == ":":
            i += 1
            while i < end and self.c[i] not in ("{", ";", "NL", "}"):
                i = self.after(i)
            if self.at(i) == "{" and self.at(self.after(i)) in ("{", "|", "&", "["):
                i = self.until(self.after(i), end, ("{", ";", "NL"))
        i = self.next_lines(i)
        return i if i < end and self.at(i) == "{" else -1

    def params(self, opening: int) -> list[Param]:
        out = []
        for a, b in self.parts(opening):
            while a < b and (self.c[a] in ("NL", "ACCESS", "@") or (self.c[a] in ("readonly", "override") and self.at(a + 1) in self.names)):
                a += 2 if self.c[a] == "@" else 1
            while b > a and self.c[b - 1] == "NL":
                b -= 1
            if a >= b:
                continue
            rest = self.c[a] == "..."
            a += rest
            colon = self.until(a, b, (":", "=", "?"))
            value = self.until(a, b, ("=",))
            kind = self.until(colon, value, (":",))
            if self.c[a] == "this":
                continue
            name = self.word(a) if self.c[a] in self.names else f"arg{len(out)}"
            out.append(Param(name, self.text(kind + 1, value), self.text(value + 1, b), "variadic" if rest else "positional"))
        return out

    def members(self, i: int, end: int, scope: Node) -> None:
        while i < end:
            if self.c[i] in ("NL", ";", ","):
                i += 1
                continue
            first = header = i
            while self.at(i) == "@":
                i += 2
                while self.at(i) == ".":
                    i += 2
                if self.at(i) == "(":
                    i = self.after(i)
                i = self.next_lines(i)
                header = i
            is_async = False
            while i + 1 < end and self.c[i] in ("static", "async", "get", "set", "*", "ACCESS", "readonly", "abstract", "override", "declare") and self.c[i + 1] not in ("(", "=", ";", ":", "NL", "<", "?"):
                is_async |= self.c[i] == "async"
                i += 1
            if self.at(i) == "{":
                if self.deep:
                    self.block(i + 1, self.partner.get(i, i), scope)
                i = self.after(i)
                continue
            name = i
            i = self.after(i)
            if self.at(i) in ("?", "!"):
                i += 1
            if self.at(i) == "<":
                i = self.until(i, end, ("(", "NL"))
            if self.at(i) == "(":
                brace = self.body(self.after(i), end)
                if brace >= 0:
                    node = self.made(scope, name, first, i, brace, is_async, end)
                    node.header = header
                    self.enter(node, scope)
                    i = node.last + 1
                    continue
            value = self.until(i, end, ("=", ";", "NL"))
            stop = value
            if self.at(value) == "=":
                j = self.next_lines(value + 1)
                j += self.at(j) == "async"
                node = self.head(j, end, scope) if self.deep else None
                if node is not None and node.is_function:
                    node.kind = "method"
                    node.name_at, node.name, node.first, node.header = name, self.word(name), first, header
                    self.enter(node, scope)
                    i = node.last + 1
                    continue
                stop = self.until(value, end, (";", "NL"))
            i = stop if stop > i else i + 1

    def declares(self, i: int, scope: Node) -> bool:
        if self.at(i - 1) in ("const", "let", "var"):
            return True
        j = i - 1
        while self.at(j) in (*self.names, ",", "{", "[", ":") and j > i - 30:
            j -= 1
        return self.at(j) in ("const", "let", "var") and self.at(j + 1) in ("{", "[")

    def imports(self) -> list[str]:
        out = []
        for i, k in enumerate(self.c):
            if k == "STR" and (self.at(i - 1) in ("from", "import") or (self.at(i - 1) == "(" and (self.at(i - 2) == "import" or (self.at(i - 2) == "ID" and self.word(i - 2) == "require")))):
                out.append(_unquoted(self.word(i)))
        return list(dict.fromkeys(out))


WALKERS: dict[str, type[Walker]] = {"go": Go, "rust": Rust, "java": Java, "javascript": Script, "typescript": Script}


def tree(language: str, source: Source, deep: bool = True) -> Node:
    """The tree of a file; not ``deep``, functions' bodies stay closed."""
    return WALKERS[language](source, deep).tree()


def declarations(language: str, source: Source) -> list[Declaration]:
    """Functions and methods with a body that are in no function and bound to a name, with the comments above them."""
    lines = source.lines()
    covered = comments_by_line(source.text, lines, source.comments)
    out: list[Declaration] = []
    floor = 0
    for node in tree(language, source, deep=False).walk():
        if not node.is_function or not node.body or node.within or node.name_at < 0:
            continue
        start, end = source.starts[node.first], source.ends[min(node.last, len(source.ends) - 1)]
        doc = comment_above(source, lines, covered, start, source.starts[node.header], floor) if covered else None
        out.append(Declaration(node.name, source.starts[node.name_at], start, end, doc))
        floor = end
    return out
