"""Scalar functions and types against known values."""

import pytest
from pyspark.sql import functions as F

from declarium.functions import columns as C
from declarium.functions.types import go_return, normalize, parameter

TYPES = {
    "python": [("int", "i64"), ("float", "f64"), (None, "any"), ("  ", "any"), ("None", "unit"), ("'bytes'", "bytes"), ("frozenset[bool]", "set<bool>"), ("typing.Sequence[float]", "list<f64>"), ("bytes | None", "option<bytes>"), ("int | bytes", "any"), ("Awaitable[bool]", "bool"), ("Mapping[str, list[bool]]", "map<str,list<bool>>"), ("Crate", "obj:Crate"), ("Callable[[int], str]", "fn"), ("tuple[bool, Crate]", "tuple<bool,obj:Crate>")],
    "typescript": [("boolean", "bool"), ("bigint", "i64"), ("number", "f64"), (None, "any"), ("Set<string>", "set<str>"), ("bigint[][]", "list<list<i64>>"), ("Promise<Map<string, bigint>>", "map<str,i64>"), ("boolean | undefined", "option<bool>"), ("Readonly<Crate>", "obj:Crate"), ("void", "unit"), ("(a: string) => void", "any")],
    "go": [("uint16", "i64"), ("float32", "f64"), ("*Crate", "obj:Crate"), ("[]bool", "list<bool>"), ("map[string][]int", "map<str,list<i64>>"), ("...string", "list<str>"), ("error", "error"), (None, "unit"), ("func(a int) bool", "fn"), ("[]byte", "bytes"), ("any", "any")],
    "rust": [("u64", "i64"), ("f32", "f64"), ("&'a mut str", "str"), ("Option<Vec<bool>>", "option<list<bool>>"), ("HashMap<String, u8>", "map<str,i64>"), ("Result<bool, String>", "result<bool,str>"), ("Arc<Crate>", "obj:Crate"), ("Box<dyn Fn(u8) -> u8>", "fn"), (None, "unit"), ("(u8, bool)", "any")],
    "java": [("int", "i64"), ("double", "f64"), ("boolean[]", "list<bool>"), ("java.util.Set<Long>", "set<i64>"), ("Optional<Crate>", "option<obj:Crate>"), ("Supplier<String>", "fn"), ("Map<String, List<Integer>>", "map<str,list<i64>>"), ("void", "unit")],
    "bash": [("whatever", "str"), (None, "str")],
    "fortran": [("REAL", "any")],
}


@pytest.mark.parametrize(("language", "raw", "expected"), [(lang, r, e) for lang, cases in TYPES.items() for r, e in cases])
def test_types(language, raw, expected):
    assert normalize(raw, language) == expected


def test_results_and_parameters():
    assert go_return([]) == "unit"
    assert go_return(["bool"]) == "bool"
    assert go_return(["[]byte", "error"]) == "result<bytes,error>"
    assert go_return(["bool", "float64", "error"]) == "result<tuple<bool,f64>,error>"
    assert go_return(["bool", "uint8"]) == "tuple<bool,i64>"
    assert parameter("bool", "variadic", "python") == "list<bool>"
    assert parameter(None, "kwvariadic", "python") == "map<str,any>"
    assert parameter(None, "receiver", "go") == "any"
    assert parameter(None, "variadic", "bash") == "list<str>"


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).head().x


def splits(name):
    """Words of a name by reading it letter by letter."""
    words, word = [], ""
    for i, ch in enumerate(name):
        kind = "d" if ch in "0123456789" else "u" if "A" <= ch <= "Z" else "l" if "a" <= ch <= "z" else ""
        last = "" if not word else "d" if word[-1].isdigit() else "u" if word[-1].isupper() else "l"
        nxt = name[i + 1 : i + 2]
        starts = not kind or (last and (kind != last and not (last == "u" and kind == "l" and len(word) == 1))) or (kind == "u" and last == "u" and "a" <= nxt <= "z")
        if starts:
            words.append(word)
            word = ""
        word += ch if kind else ""
    return {w.lower() for w in [*words, word] if len(w) > 1}


def test_names(spark):
    for name in ("weighCrate2Dock", "HTTPServerPort", "a_bc__d9", "XMLio", "éclairÉtat_x12y", "", "ABc", "loadJSON2map", "__init__", "x1"):
        assert set(one(spark, C.name_tokens(F.col("n")), n=name)) == splits(name), name
    assert one(spark, C.name_key(F.col("n")), n="Weigh_It") == "weighit"
    assert one(spark, C.context_key(F.col("n")), n="7 crates") == "_7_crates"
    assert one(spark, C.context_key(F.col("n")), n="") == "_"
    assert one(spark, C.module_parts(F.col("n")), n="./yard/dock.v2/__init__.py") == ["yard", "dock_v2"]
    assert one(spark, C.module_parts(F.col("n")), n="home/.profile") == ["home", "_profile"]
    assert one(spark, C.trait(F.col("n")), n="mutates_instance") == "FnMut"
    assert one(spark, C.severity_rank(F.col("n")), n="odd") == 3
    assert one(spark, C.body_hash(F.col("n")), n="") == "sha256:e3b0c44298fc1c14"
    assert one(spark, C.language(F.col("n")), n=" GoLang ") == "go"
    assert one(spark, C.glob(F.col("n"), "we[a-z]*_?"), n="weigh_x") is True
    assert one(spark, C.same_subtree(F.col("a"), F.col("b")), a="x.y", b="x") is True
    assert one(spark, C.same_subtree(F.col("a"), F.col("b")), a="xy", b="x") is False
    assert one(spark, C.class_params(F.col("n")), n="sig:map<str,list<i64>>,*list<str>,fn->tuple<str,i64>") == ["map<str,list<i64>>", "*list<str>", "fn"]
    assert one(spark, C.class_params(F.col("n")), n="sig:->unit") == []
    assert one(spark, C.class_returns(F.col("n")), n="sig:str->result<str,error>") == "result<str,error>"


def test_environment(spark):
    assert one(spark, C.env_vars(F.col("b"), F.lit("python")), b="os.getenv('B') os.environ[\"A\"] os.environ.get('B')") == ["A", "B"]
    assert one(spark, C.env_vars(F.col("b"), F.lit("bash")), b="echo ${HOME:-x} $PATH $lower") == ["HOME", "PATH"]
    assert one(spark, C.env_vars(F.col("b"), F.lit("nothing")), b="$PATH") == []


def test_selectors():
    assert C.parse_selector("12-14,55") == [(12, 14), (55, 55)]
    assert C.parse_selector("pkg.mod") == "pkg.mod"
    with pytest.raises(ValueError, match="descending"):
        C.parse_selector("9-3")


def test_registered_types(spark):
    """A language's types can be added; workers know them too."""
    from declarium.functions import types

    types.register("kotlin", {"Int": "i64", "String": "str"}, {"list": ["List", "MutableList"], "option": ["Maybe"]})
    assert normalize("List<Maybe<Int>>", "kotlin") == "list<option<i64>>"
    param = "struct<name:string,raw_type:string,default_value:string,kind:string>"
    df = spark.createDataFrame([([("a", "MutableList<String>", None, "positional")], "kotlin", "Int", None, False)], f"params array<{param}>, language string, returns_raw string, returns_norm string, is_async boolean")
    row = types.normalized(df).head().signature
    assert (row.params[0].norm_type, row.returns.norm_type) == ("list<str>", "i64")


def test_written_tables_can_be_released(spark):
    from declarium.sources import materialize, release

    held = materialize(spark.range(3).toDF("x"), "some")
    path = held.inputFiles()[0].removeprefix("file://")
    assert held.count() == 3 and __import__("os").path.exists(path)
    assert release(spark) >= 1
    assert not __import__("os").path.exists(path)
    assert release(spark) == 0
