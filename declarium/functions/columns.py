"""Scalar functions of the catalog as column expressions: all run inside the JVM."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names and prefixes of items that something outside the catalog calls.
ENTRY_NAMES = ("main", "__init__", "__main__", "setup")
ENTRY_PREFIXES = ("cmd_", "test_", "handle_")
#: How a callable may be held, by what it captures.
TRAITS = {"pure": "fn", "reads_captured": "Fn", "reads_instance": "Fn", "mutates_captured": "FnMut", "mutates_instance": "FnMut", "consumes": "FnOnce"}
SEVERITIES = {"high": 0, "medium": 1, "low": 2}
#: How a language's code names an environment variable: by a call, in brackets, as a member,
#: after a dollar sign, in a dollar sign's braces.
ENV_ACCESS = {
    "python": {"call": ["os.environ.get", "os.getenv"], "bracket": ["os.environ"]},
    "javascript": {"call": ["Deno.env.get"], "bracket": ["process.env"], "member": ["process.env"]},
    "typescript": {"call": ["Deno.env.get"], "bracket": ["process.env"], "member": ["process.env"]},
    "go": {"call": ["os.Getenv", "os.LookupEnv"]},
    "rust": {"call": ["env::var", "env::var_os", "env!", "option_env!"]},
    "java": {"call": ["System.getenv"]},
    "bash": {"dollar": [""], "braces": [""]},
}
#: Spellings of language names that mean a language.
ALIASES = {"py": "python", "python": "python", "js": "javascript", "javascript": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "typescript": "typescript", "tsx": "typescript", "go": "go", "golang": "go", "rs": "rust", "rust": "rust", "java": "java", "sh": "bash", "shell": "bash", "bash": "bash"}


def _lookup(key: Column, values: dict) -> Column:
    """``values[key]``, null for other keys."""
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def language(raw: Column) -> Column:
    """The language that a spelling means, else null."""
    return _lookup(F.lower(F.trim(raw)), ALIASES)


def params(signature: str = "signature") -> Column:
    """Parameters of a signature, none for null."""
    return F.coalesce(F.col(f"{signature}.params"), F.expr(f"slice({signature}.params, 1, 0)"), F.array().cast("array<struct<name:string,raw_type:string,norm_type:string,default_value:string,kind:string>>"))


def typed(raw: Column) -> Column:
    """A normalized type; a missing one is ``any``."""
    return F.coalesce(raw, F.lit("any"))


def list_of(values: Column) -> Column:
    """A list of texts, none for null."""
    return F.coalesce(values, F.array().cast("array<string>"))


def sig_class() -> Column:
    """The id of an item's signature class: parameter types without receivers, and the return type."""
    counted = F.filter(params(), lambda p: ~F.coalesce(p["kind"], F.lit("positional")).isin("receiver", "kwvariadic"))
    parts = F.transform(counted, lambda p: F.concat(F.when(p["kind"] == "variadic", "*").otherwise(""), typed(p["norm_type"])))
    return F.concat(F.lit("sig:"), F.array_join(parts, ","), F.lit("->"), typed(F.col("signature.returns.norm_type")))


def class_params(sig: Column) -> Column:
    """The parameter types of a signature class' id: cut at the commas outside angle brackets.

    A comma inside is known by the brackets before it: parts are put together until their brackets balance.
    """
    inside = F.regexp_replace(F.regexp_replace(sig, "^sig:", ""), "->(?!.*->).*$", "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def balance(x: Column) -> Column:
        return F.length(F.replace(x, F.lit("<"), F.lit(""))) == F.length(F.replace(x, F.lit(">"), F.lit("")))

    def grow(acc: Column, part: Column) -> Column:
        now = F.when(acc["open"] == "", part).otherwise(F.concat(acc["open"], F.lit(","), part))
        whole = balance(now)
        return F.struct(F.when(whole, F.array_append(acc["done"], now)).otherwise(acc["done"]).alias("done"), F.when(whole, F.lit("")).otherwise(now).alias("open"))

    parts = F.aggregate(F.split(inside, ","), empty, grow, lambda acc: acc["done"])
    return F.when(inside == "", F.array().cast("array<string>")).otherwise(parts)


def class_returns(sig: Column) -> Column:
    """The return type of a signature class' id: what follows its last arrow."""
    return F.regexp_extract(sig, "^.*->(.*)$", 1)


def is_untyped(norm_type: Column) -> Column:
    """Whether ``any`` stands in a type, as a whole or as a part of a word."""
    return typed(norm_type).contains("any")


def untyped_names() -> Column:
    """Names of the untyped slots of an item, ``<return>`` for its return, in order."""
    names = F.transform(F.filter(params(), lambda p: is_untyped(p["norm_type"])), lambda p: F.coalesce(p["name"], F.lit("")))
    return F.when(is_untyped(F.col("signature.returns.norm_type")), F.array_append(names, F.lit("<return>"))).otherwise(names)


def module_parts(file: Column) -> Column:
    """Parts of a file's path that name its module: no ending, no ``.`` and no ``__init__``; dots become ``_``."""
    bare = F.when(file.rlike(r"(?:^|/)\.[^./]*$"), file).otherwise(F.regexp_replace(file, r"\.[^./]*$", ""))
    kept = F.filter(F.split(bare, "/"), lambda p: ~p.isin("", ".", "__init__"))
    return F.transform(kept, lambda p: F.replace(p, F.lit("."), F.lit("_")))


def address(file: Column, scopes: Column, name: Column, line: Column) -> Column:
    """The dotted path of a declaration; an anonymous one is named by its line."""
    scope = F.array_join(F.concat(module_parts(file), list_of(scopes)), ".")
    return F.when(name.startswith("<"), F.concat(scope, F.lit("#"), line.cast("string"))).otherwise(F.concat_ws(".", F.nullif(scope, F.lit("")), name))


def body_hash(body: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(body, 256), 1, 16))


def env_patterns(lang: str) -> list[str]:
    """One pattern for each way in which ``lang`` names an environment variable; group 1 is the name."""
    quote = "['\"]" if lang in ("python", "javascript", "typescript") else '"'
    name, shouted = "([A-Za-z_][0-9A-Za-z_]*)", "([A-Z][0-9A-Z_]+)"
    forms = {
        "call": lambda at: rf"{at}\(\s*{quote}{name}{quote}",
        "bracket": lambda at: rf"{at}\[\s*{quote}{name}{quote}\s*\]",
        "member": lambda at: rf"{at}\.{name}",
        "dollar": lambda at: rf"\${shouted}",
        "braces": lambda at: rf"\$\{{{shouted}[-:}}]",
    }
    return [forms[form](at.replace(".", r"\.")) for form, places in ENV_ACCESS[lang].items() for at in places]


def env_vars(body: Column, lang: Column) -> Column:
    """Environment variables that a body reads, sorted."""
    out = F.array().cast("array<string>")
    for name in ENV_ACCESS:
        hits = F.flatten(F.array(*[F.regexp_extract_all(body, F.lit(p), F.lit(1)) for p in env_patterns(name)]))
        out = F.when(lang == name, hits).otherwise(out)
    return F.array_sort(F.array_distinct(list_of(out)))


def context_key(raw: Column) -> Column:
    """A name as a key of the shared context."""
    bare = F.regexp_replace(raw, "[^A-Za-z0-9_]", "_")
    return F.when((bare == "") | bare.rlike("^[0-9]"), F.concat(F.lit("_"), bare)).otherwise(bare)


#: Where words of a name begin or end: blanks go around a capital with small letters after it and around digits,
#: and between a small letter and a capital; other characters part words too.
NAME_CUTS = (("([A-Z][a-z]+)", r" $1 "), ("([a-z])([A-Z])", r"$1 $2"), ("([0-9]+)", r" $1 "))


def name_tokens(name: Column) -> Column:
    """Different words of a name of two letters or more, in lower case."""
    for pattern, spaced in NAME_CUTS:
        name = F.regexp_replace(name, pattern, spaced)
    return F.array_distinct(F.transform(F.filter(F.split(name, "[^A-Za-z0-9]+"), lambda t: F.length(t) > 1), F.lower))


def name_key(name: Column) -> Column:
    """What two spellings of a name have in common."""
    return F.replace(F.lower(name), F.lit("_"), F.lit(""))


def is_entry_point() -> Column:
    """Whether something outside the catalog is expected to call an item."""
    name = F.col("name")
    by_prefix = F.lit(False)
    for p in ENTRY_PREFIXES:
        by_prefix = by_prefix | name.startswith(p)
    return F.coalesce(name.isin(*ENTRY_NAMES) | by_prefix, F.lit(False)) | F.coalesce(F.lower("file").contains("test"), F.lit(False)) | F.coalesce(F.col("kind") == "script_main", F.lit(False))


def trait(state: Column) -> Column:
    return _lookup(state, TRAITS)


def severity_rank(severity: Column) -> Column:
    return F.coalesce(_lookup(severity, SEVERITIES), F.lit(3))


def same_subtree(a: Column, b: Column) -> Column:
    """Whether one group is the other or encloses it."""
    return (a == b) | F.startswith(a, F.concat(b, F.lit("."))) | F.startswith(b, F.concat(a, F.lit(".")))


def search_score(query: str) -> Column:
    """3 if the query is the name, 2 if it is in the name, 1 if in the address or documentation, else 0; case does not matter."""
    q = F.lit(query.lower())
    rest = F.contains(F.lower("address"), q) | F.contains(F.lower(F.coalesce("doc", F.lit(""))), q)
    return F.when(F.lower("name") == q, 3).when(F.contains(F.lower("name"), q), 2).when(rest, 1).otherwise(0)


def glob(name: Column, pattern: str) -> Column:
    """Whether a name matches a shell pattern, case included."""
    return name.rlike("^" + fnmatch.translate(pattern).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z") + "$")


def parse_selector(text: str) -> list[tuple[int, int]] | str:
    """Ordinal ranges of ``12-14,55``, or the text itself if it is a path.

    A range that goes down is an error.
    """
    parts = [p.strip().split("-") for p in text.split(",")]
    if not all(len(p) in (1, 2) and all(x.strip().isdigit() for x in p) for p in parts):
        return text
    ranges = [(int(p[0]), int(p[-1])) for p in parts]
    if any(a > b for a, b in ranges):
        raise ValueError(f"descending range in {text!r}")
    return ranges
