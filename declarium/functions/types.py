"""Types of seven languages in one vocabulary.

The vocabulary: ``str bytes bool i64 f64 unit any error fn``, ``list<T> map<K,V> set<T> option<T>
result<T,E> tuple<...> iter<T>`` and ``obj:<Name>``. A written type is parsed into a small tree, and
one walk renders any language's tree by that language's table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

_CLEAN = re.compile(r"[A-Za-z0-9_<>,:]*")


@dataclass(frozen=True)
class Tree:
    """A written type: a name with arguments; ``|`` joins alternatives, ``[]`` and ``()`` are names too."""

    head: str
    args: tuple[Tree, ...] = ()


@dataclass(frozen=True)
class Table:
    """How a language spells the vocabulary. Fixed values, from the languages' own type names."""

    missing: str
    open: str
    scalars: dict[str, str]
    kinds: dict[str, str] = field(default_factory=dict)
    nothing: frozenset[str] = frozenset()
    separator: str = "."
    bare: bool = False


def _kinds(names: dict[str, list[str]]) -> dict[str, str]:
    """The kind of each name."""
    return {n: kind for kind, held in names.items() for n in held}


PYTHON = Table(
    "any",
    "[",
    {"str": "str", "int": "i64", "float": "f64", "bool": "bool", "bytes": "bytes", "bytearray": "bytes", "None": "unit", "NoneType": "unit", "Any": "any", "object": "any", "any": "any", "list": "list<any>", "dict": "map<any,any>", "set": "set<any>", "tuple": "tuple<>", "Callable": "fn", "callable": "fn"},
    _kinds({"list": ["list", "List", "Sequence", "MutableSequence"], "map": ["dict", "Dict", "Mapping", "MutableMapping", "OrderedDict", "defaultdict"], "set": ["set", "Set", "frozenset", "FrozenSet", "MutableSet"], "tuple": ["tuple", "Tuple"], "option": ["Optional"], "union": ["Union"], "iter": ["Iterator", "Iterable", "Generator", "AsyncIterator", "AsyncIterable", "AsyncGenerator"], "fn": ["Callable"], "last": ["Awaitable", "Coroutine"]}),
    frozenset(["None", "NoneType"]),
)
SCRIPT = Table(
    "any",
    "<",
    {"string": "str", "number": "f64", "boolean": "bool", "void": "unit", "undefined": "unit", "null": "unit", "any": "any", "unknown": "any", "never": "any", "object": "any", "bigint": "i64", "symbol": "any", "Function": "fn"},
    _kinds({"list": ["Array", "ReadonlyArray", "[]"], "map": ["Record", "Map", "ReadonlyMap"], "set": ["Set", "ReadonlySet"], "first": ["Promise", "Partial", "Required", "Readonly"]}),
    frozenset(["null", "undefined"]),
    separator="",
)
GO = Table(
    "unit",
    "",
    {"string": "str", "error": "error", "bool": "bool", "float32": "f64", "float64": "f64", "any": "any", "interface{}": "any", "func": "fn", **dict.fromkeys("int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr byte rune".split(), "i64")},
    _kinds({"list": ["[]"], "map": ["map"]}),
    separator="",
)
RUST = Table(
    "unit",
    "<",
    {"String": "str", "str": "str", "char": "str", "bool": "bool", "f32": "f64", "f64": "f64", "()": "unit", "fn": "fn", **dict.fromkeys("i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize".split(), "i64")},
    _kinds({"list": ["Vec", "VecDeque"], "map": ["HashMap", "BTreeMap"], "set": ["HashSet", "BTreeSet"], "option": ["Option"], "result": ["Result"], "first": ["Box", "Rc", "Arc", "Cell", "RefCell", "Mutex", "RwLock", "Pin", "Cow"]}),
    separator="",
)
JAVA = Table(
    "unit",
    "<",
    {
        **dict.fromkeys("String char Character CharSequence StringBuilder StringBuffer".split(), "str"),
        **dict.fromkeys("int long short byte Integer Long Short Byte BigInteger".split(), "i64"),
        **dict.fromkeys("float double Float Double BigDecimal".split(), "f64"),
        **dict.fromkeys("Exception Throwable Error RuntimeException IOException".split(), "error"),
        "boolean": "bool", "Boolean": "bool", "void": "unit", "Void": "unit", "Object": "any", "byte[]": "bytes", "ByteBuffer": "bytes", "Runnable": "fn",
    },
    _kinds({"list": ["List", "ArrayList", "LinkedList", "Collection", "Vector", "Queue", "Deque", "ArrayDeque", "[]"], "map": ["Map", "HashMap", "TreeMap", "LinkedHashMap", "Hashtable", "ConcurrentMap", "ConcurrentHashMap", "SortedMap", "NavigableMap"], "set": ["Set", "HashSet", "TreeSet", "LinkedHashSet", "EnumSet", "SortedSet", "NavigableSet"], "option": ["Optional", "OptionalInt", "OptionalLong", "OptionalDouble"], "iter": ["Iterator", "Iterable", "Stream", "IntStream", "LongStream", "DoubleStream", "Enumeration"], "fn": ["Function", "BiFunction", "Supplier", "Consumer", "BiConsumer", "Predicate", "BiPredicate", "UnaryOperator", "BinaryOperator", "Callable"], "first": ["CompletableFuture", "Future", "AtomicReference"]}),
    bare=True,
)
TABLES = {"python": PYTHON, "javascript": SCRIPT, "typescript": SCRIPT, "go": GO, "rust": RUST, "java": JAVA}

_TOKEN = re.compile(r"'\w+(?!')|\.\.\.|->|=>|[\w$.:?]+|\S")
_CLOSE = {"[": "]", "<": ">", "(": ")", "{": "}"}


class _Unreadable(ValueError):
    """The text is no type of its language."""


class _Reader:
    """Recursive descent over the tokens of one type."""

    def __init__(self, text: str, table: Table):
        self.tokens = _TOKEN.findall(text)
        self.table = table
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, expected: str | None = None) -> str:
        t = self.peek()
        if not t or (expected is not None and t != expected):
            raise _Unreadable(t)
        self.at += 1
        return t

    def whole(self) -> Tree:
        out = self.alternatives()
        if self.peek():
            raise _Unreadable(self.peek())
        return out

    def alternatives(self) -> Tree:
        options = [self.term()]
        while self.peek() == "|":
            self.take()
            options.append(self.term())
        return options[0] if len(options) == 1 else Tree("|", tuple(options))

    def arguments(self, opening: str) -> tuple[Tree, ...]:
        self.take(opening)
        out = []
        while self.peek() != _CLOSE[opening]:
            out.append(self.alternatives())
            if self.peek() == "=":  # a named argument
                self.take()
                self.alternatives()
            if self.peek() == ",":
                self.take()
            elif self.peek() != _CLOSE[opening]:
                raise _Unreadable(self.peek())
        self.take()
        return tuple(out)

    def skip_group(self, opening: str) -> None:
        self.take(opening)
        while self.peek() != _CLOSE[opening]:
            if self.peek() in _CLOSE:
                self.skip_group(self.peek())
            else:
                self.take()
        self.take()

    def term(self) -> Tree:
        out = {"[": self.python_term, "<": self.angled_term, "": self.go_term}[self.table.open]()
        while self.peek() == "[" and self.table.kinds.get("[]") and self.table.open == "<":
            self.take()
            self.take("]")
            out = Tree("[]", (out,))
        return out

    def python_term(self) -> Tree:
        if self.peek() == "[":
            return Tree("[", self.arguments("["))
        name = self.take()
        return Tree(name, self.arguments("[")) if self.peek() == "[" else Tree(name)

    def angled_term(self) -> Tree:
        while self.table is RUST and (self.peek() in ("&", "mut") or self.peek()[:1] == "'"):
            lifetime = self.take()
            if lifetime[0] == "'" and self.peek() in ("", ",", ">"):
                return Tree("'")
        t = self.take()
        if t in ("dyn", "impl") and self.table is RUST:
            named = self.angled_term()
            return Tree(named.head if named.head == "fn" else "dyn " + named.head)
        if t == "(":
            self.at -= 1
            inner = self.arguments("(")
            if self.peek() in ("=>", "->"):
                raise _Unreadable(t)
            return Tree("()", inner)
        if not re.match(r"[\w$]", t):
            raise _Unreadable(t)
        if self.table is RUST and t in ("Fn", "FnMut", "FnOnce", "fn") and self.peek() == "(":
            self.skip_group("(")
            if self.peek() == "->":
                self.take()
                self.angled_term()
            return Tree("fn")
        return Tree(t, self.arguments("<")) if self.peek() == "<" else Tree(t)

    def go_term(self) -> Tree:
        t = self.take()
        if t == "*":
            return self.go_term()
        if t == "...":
            return Tree("[]", (self.go_term(),))
        if t.startswith("...") and len(t) > 3:
            return Tree("[]", (Tree(t[3:]),))
        if t == "[":
            self.take("]")
            return Tree("[]", (self.go_term(),))
        if t == "map" and self.peek() == "[":
            self.take()
            key = self.go_term()
            self.take("]")
            return Tree("map", (key, self.go_term()))
        if t == "interface" and self.tokens[self.at : self.at + 2] == ["{", "}"]:
            self.at += 2
            return Tree("interface{}")
        if t == "func":
            self.at = len(self.tokens)
        return Tree(t)


def _render(t: Tree, table: Table) -> str:
    if t.head == "|" or table.kinds.get(t.head) == "union":
        rest = [a for a in t.args if not (a.head in table.nothing and not a.args)]
        if not rest and table is SCRIPT:
            return "unit"
        lone = len(rest) == 1 and (len(t.args) == 2 or (table is SCRIPT and len(t.args) > 1))
        return f"option<{_render(rest[0], table)}>" if lone else "any"
    if t.head == "[]" and t.args:
        spelled = f"{t.args[0].head}[]" if table is JAVA else f"[]{t.args[0].head}"
        if not t.args[0].args and spelled in ("byte[]", "[]byte"):
            return "bytes"
    args = [a for a in t.args if a.head != "'"]
    name = t.head.removeprefix("typing.") if table is PYTHON else t.head
    if table.bare:
        name = name.rsplit(".", 1)[-1]
    kind = table.kinds.get(name)
    if not args and name in table.scalars:
        return table.scalars[name]
    if name.startswith("dyn "):
        return f"obj:{name[4:]}"
    if kind and (args or table.bare):
        return _container(kind, args, table)
    return f"obj:{name.rsplit(table.separator, 1)[-1] if table.separator else name}"


def _container(kind: str, args: list[Tree], table: Table) -> str:
    def nth(i: int, otherwise: str = "any") -> str:
        return _render(args[i], table) if i < len(args) else otherwise

    if kind == "fn":
        return "fn"
    if kind == "map":
        return f"map<{nth(0)},{nth(1)}>"
    if kind == "result":
        return f"result<{nth(0)},{nth(1, 'error')}>"
    if kind == "tuple":
        return "tuple<" + ",".join(_render(a, table) for a in args) + ">"
    if kind == "first":
        return nth(0)
    if kind == "last":
        return nth(len(args) - 1)
    return f"{kind}<{nth(0)}>"


_REGISTERED: dict[str, Table] = {}


def register(language: str, scalars: dict[str, str], kinds: dict[str, list[str]], missing: str = "any", brackets: str = "<") -> None:
    """Adds or replaces a language's types: scalars by name, and the names of each kind of container."""
    _adopt({language: Table(missing, brackets, scalars, _kinds(kinds))})


def _adopt(tables: dict[str, Table]) -> None:
    """Makes registered tables known in this process."""
    if any(TABLES.get(k) != v for k, v in tables.items()):
        _REGISTERED.update(tables)
        TABLES.update(tables)
        normalize.cache_clear()


@lru_cache(maxsize=100_000)
def normalize(raw: str | None, language: str | None) -> str:
    """A written type in the vocabulary; what cannot be read, or names what no name may hold, is ``any``."""
    if language == "bash":
        return "str"
    table = TABLES.get(language or "")
    if table is None:
        return "any"
    if raw is None:
        return table.missing
    text = " ".join(raw.split())
    if table is PYTHON:
        text = text.strip("\"'")
    if not text:
        return table.missing
    try:
        out = _render(_Reader(text, table).whole(), table)
    except _Unreadable:
        return "any"
    return out if _CLEAN.fullmatch(out) else "any"


def go_return(types: list[str]) -> str:
    """Several results as one type: a last ``error`` makes a result, else they are a tuple. No guard."""
    if not types:
        return "unit"

    def one(text: str) -> str:
        try:
            return _render(_Reader(" ".join(text.split()), GO).whole(), GO)
        except _Unreadable:
            return f"obj:{text.strip()}"

    found = [one(t) for t in types]
    if len(found) == 1:
        return found[0]
    if types[-1].strip() == "error":
        held = found[:-1]
        return f"result<{held[0] if len(held) == 1 else 'tuple<' + ','.join(held) + '>'},error>"
    return "tuple<" + ",".join(found) + ">"


def parameter(raw: str | None, kind: str | None, language: str | None) -> str:
    """A parameter's type: a variadic is a list, a keyword variadic a map of texts."""
    if kind == "variadic":
        return f"list<{normalize(raw, language) if raw or language == 'bash' else 'any'}>"
    if kind == "kwvariadic":
        return "map<str,any>"
    if kind == "receiver" and not raw:
        return "any"
    return normalize(raw, language)


_OUT = StructType([StructField("params", ArrayType(StringType())), StructField("returns", StringType())])


def _signature_types():
    """The function that types signatures; registered tables go to the workers with it."""
    known_tables = dict(_REGISTERED)

    @F.pandas_udf(_OUT)
    def typed(raws: pd.Series, kinds: pd.Series, language: pd.Series, returns: pd.Series, known: pd.Series) -> pd.DataFrame:
        _adopt(known_tables)
        params = [[parameter(r, k, lang) for r, k in zip(rs, ks, strict=True)] for rs, ks, lang in zip(raws, kinds, language, strict=True)]
        back = [n if n else normalize(r, lang) for r, lang, n in zip(returns, language, known, strict=True)]
        return pd.DataFrame({"params": params, "returns": back})

    return typed


def normalized(decls: DataFrame) -> DataFrame:
    """Adds ``signature`` to declarations: parameters and return with raw and normalized types.

    The types of a row are normalized together, each distinct one once per worker (it is remembered),
    so nothing is shuffled.
    """
    raw = F.coalesce(F.col("params"), F.array().cast("array<struct<name:string,raw_type:string,default_value:string,kind:string>>"))
    types = _signature_types()(F.transform(raw, lambda p: p["raw_type"]), F.transform(raw, lambda p: F.coalesce(p["kind"], F.lit("positional"))), F.col("language"), F.col("returns_raw"), F.col("returns_norm"))
    out = decls.withColumn("_raw", raw).withColumn("_types", types)
    joined = F.transform(F.arrays_zip("_raw", F.col("_types.params").alias("norm")), lambda z: F.struct(z["_raw"]["name"].alias("name"), z["_raw"]["raw_type"].alias("raw_type"), z["norm"].alias("norm_type"), z["_raw"]["default_value"].alias("default_value"), z["_raw"]["kind"].alias("kind")))
    returns = F.struct(F.col("returns_raw").alias("raw_type"), F.col("_types.returns").alias("norm_type"))
    return out.withColumn("signature", F.struct(joined.alias("params"), returns.alias("returns"), F.col("is_async").alias("is_async"))).drop("_raw", "_types")
