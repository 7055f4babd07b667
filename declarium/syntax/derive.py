"""Parsing with derivatives, memoised.

A language is an expression over token classes. Its derivative by a token is the language of what may
follow that token; a text is a sentence if the derivative by all its tokens can be empty. Expressions
are shared: equal ones are one object, which keeps its derivatives. So a context that was met once,
in this file or another, costs one look-up per token afterwards: the memo is an automaton that grows
as far as the texts need it, nested contexts included. An empty derivative names the first token that
fits nowhere; a derivative by all tokens that cannot be empty tells that the text stops too early.
"""

from __future__ import annotations

import re

#: Tokens that end an operand, so that ``++`` on the next line belongs to what follows.
_OPERANDS = frozenset(["ID", ")", "]", "NUM", "STR", "TEMPLATE", "REGEX", "CONST", "this"])
_EMPTY, _EPS, _TOKEN, _SEQ, _ALT, _REF, _STAR, _ANY = range(8)


class Node:
    """One expression; ``d`` keeps its derivatives by token class."""

    __slots__ = ("a", "b", "d", "kind", "nullable")

    def __init__(self, kind: int, a: object, b: object, nullable: bool):
        self.kind, self.a, self.b, self.nullable = kind, a, b, nullable
        self.d: dict[str, Node] = {}


_LEX = re.compile(r"\s+|#[^\n]*\n|([A-Za-z_]\w*|'[^'\s]+'|~\(|[=;|()\[\]{}])")


class Grammar:
    """Rules in the usual notation: ``name = a 'x' | [ maybe ] { any number } ;``

    ``'x'`` and names in capitals are token classes, ``~( 'a' 'b' )`` is any class but those. No rule
    may begin with itself.
    """

    def __init__(self, text: str, start: str, most: int = 300_000):
        self.text, self.start_name, self.most = text, start, most
        self._rules = rules(text)
        self._null = _nullable(self._rules)
        self._build()

    def _build(self) -> None:
        self.empty, self.eps = Node(_EMPTY, None, None, False), Node(_EPS, None, None, True)
        self._known: dict[tuple, Node] = {}
        self._refs = {name: Node(_REF, None, None, self._null[name]) for name in self._rules}
        for name, tree in self._rules.items():
            self._refs[name].a = self._node(tree)
        self.start = self._refs[self.start_name]

    def fresh(self) -> Node:
        """The start expression; drops the memo first if it has grown too large."""
        if len(self._known) > self.most:
            self._build()
        return self.start

    def _node(self, tree: tuple) -> Node:
        kind = tree[0]
        if kind == "tok":
            return self._one((_TOKEN, tree[1]), tree[1], None, False)
        if kind == "ref":
            return self._refs[tree[1]]
        if kind == "any":
            return self._one((_ANY, tree[1]), tree[1], None, False)
        if kind == "star":
            inner = self._node(tree[1])
            return self._one((_STAR, id(inner)), inner, None, True)
        if kind == "alt":
            return self.alt([self._node(x) for x in tree[1]])
        out = self.eps
        for x in reversed(tree[1]):
            out = self.seq(self._node(x), out)
        return out

    def _one(self, key: tuple, a: object, b: object, nullable: bool) -> Node:
        node = self._known.get(key)
        if node is None:
            node = self._known[key] = Node(key[0], a, b, nullable)
        return node

    def seq(self, a: Node, b: Node) -> Node:
        if a.kind == _EMPTY or b.kind == _EMPTY:
            return self.empty
        if a.kind == _EPS:
            return b
        if b.kind == _EPS:
            return a
        if a.kind == _SEQ:
            return self.seq(a.a, self.seq(a.b, b))
        return self._one((_SEQ, id(a), id(b)), a, b, a.nullable and b.nullable)

    def alt(self, nodes: list[Node]) -> Node:
        flat: dict[int, Node] = {}
        for n in nodes:
            for x in n.a if n.kind == _ALT else (n,):
                if x.kind != _EMPTY:
                    flat[id(x)] = x
        if not flat:
            return self.empty
        if len(flat) == 1:
            return next(iter(flat.values()))
        return self._one((_ALT, frozenset(flat)), tuple(flat.values()), None, any(x.nullable for x in flat.values()))

    def derive(self, n: Node, t: str) -> Node:
        """The derivative of ``n`` by a token of class ``t``."""
        found = n.d.get(t)
        if found is not None:
            return found
        kind = n.kind
        if kind == _TOKEN:
            out = self.eps if n.a == t else self.empty
        elif kind == _SEQ:
            out = self.seq(self.derive(n.a, t), n.b)
            if n.a.nullable:
                out = self.alt([out, self.derive(n.b, t)])
        elif kind == _ALT:
            out = self.alt([self.derive(x, t) for x in n.a])
        elif kind == _REF:
            out = self.derive(n.a, t)
        elif kind == _STAR:
            out = self.seq(self.derive(n.a, t), n)
        elif kind == _ANY:
            out = self.empty if t in n.a or t == "BAD" else self.eps
        else:
            out = self.empty
        n.d[t] = out
        return out

    def run(self, tokens: list[str]) -> int:
        """-1 for a sentence, the place of the token that fits nowhere, or ``len(tokens)`` if it stops too early."""
        state, empty, derive = self.fresh(), self.empty, self.derive
        for i, t in enumerate(tokens):
            state = state.d.get(t) or derive(state, t)
            if state is empty:
                return i
        return -1 if state.nullable else len(tokens)

    def run_inserting(self, tokens: list[str], restricted: frozenset[str]) -> int:
        """As ``run``, over tokens with line breaks ``NL``, where a semicolon may be inserted.

        As the language defines it: before a token that fits nowhere, if a line break or ``}`` comes
        before it or it is ``}``; after a ``restricted`` token at a line's end; at the end.
        """
        state, empty, derive = self.fresh(), self.empty, self.derive
        broken, last = False, ""
        for i, t in enumerate(tokens):
            if t == "NL":
                broken = True
                continue
            if broken and (last in restricted or (t in ("++", "--") and last in _OPERANDS)):
                ended = derive(state, ";")
                if ended is not empty:
                    state = ended
            following = state.d.get(t) or derive(state, t)
            if following is empty:
                if not (broken or t == "}"):
                    return i
                ended = derive(state, ";")
                following = derive(ended, t)
                if following is empty:
                    return i
            state, broken, last = following, False, t
        if state.nullable or derive(state, ";").nullable:
            return -1
        return len(tokens)


def rules(text: str) -> dict[str, tuple]:
    tokens = [t for t in _LEX.findall(text + "\n") if t]
    at = 0
    rules: dict[str, tuple] = {}

    def choice(closing: str) -> tuple:
        nonlocal at
        options = [sequence(closing)]
        while tokens[at] == "|":
            at += 1
            options.append(sequence(closing))
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(closing: str) -> tuple:
        nonlocal at
        parts: list[tuple] = []
        while tokens[at] not in ("|", closing):
            t = tokens[at]
            at += 1
            if t == "(":
                parts.append(choice(")"))
                at += 1
            elif t == "[":
                parts.append(("alt", [choice("]"), ("seq", [])]))
                at += 1
            elif t == "{":
                parts.append(("star", choice("}")))
                at += 1
            elif t == "~(":
                end = tokens.index(")", at)
                parts.append(("any", frozenset(x.strip("'") for x in tokens[at:end])))
                at = end + 1
            elif t[0] == "'":
                parts.append(("tok", t[1:-1]))
            else:
                parts.append(("tok", t) if t.isupper() else ("ref", t))
        return parts[0] if len(parts) == 1 else ("seq", parts)

    while at < len(tokens):
        name = tokens[at]
        at += 2
        rules[name] = choice(";")
        at += 1
    return rules


def _nullable(rules: dict[str, tuple]) -> dict[str, bool]:
    known = dict.fromkeys(rules, False)

    def null(tree: tuple) -> bool:
        kind, a = tree[0], tree[1]
        if kind == "ref":
            return known[a]
        if kind == "alt":
            return any(map(null, a))
        if kind == "seq":
            return all(map(null, a))
        return kind == "star"

    changed = True
    while changed:
        changed = False
        for name, tree in rules.items():
            if not known[name] and null(tree):
                known[name] = changed = True
    return known
