"""Skeleton code of a catalog: a typed context, a tree of groups with a stub per item, arrays per class, pipelines.

How a language spells all that is data: a profile names its words, types and templates; the shape of
the output is the same for all. A project's skeleton is one group of names, types and ordinals; texts
never reach it.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declarium.functions import columns as C

FILES = "project string, backend string, path string, content string, items int, error string"
PROFILES = Path(__file__).parent.parent / "plans" / "emit"


@dataclass(frozen=True)
class Backend:
    """How a language is written; ``indent`` is the depth of groups inside the file."""

    name: str
    reserved: frozenset[str]
    remap: dict[str, str]
    members: frozenset[str]
    scalars: dict[str, str]
    containers: dict[str, str]
    unknown: str
    fallback: str
    templates: dict[str, str]
    files: list[list[str]]
    join: str = "."
    root: str = ""
    reference: str = ""
    indent: int = 0

    @classmethod
    def load(cls, data: dict) -> Backend:
        """From a profile's JSON object; a profile without a name, types or files is an error."""
        lacking = [k for k in ("name", "types", "templates", "files") if not data.get(k)]
        if lacking:
            raise ValueError(f"profile lacks {', '.join(lacking)}")
        types = data["types"]
        return cls(
            data["name"], frozenset(data.get("reserved", ())), dict(data.get("remap", {})), frozenset(data.get("members", ())), types["scalars"], types["containers"], types["unknown"], types["fallback"],
            data["templates"], data["files"], data.get("join", "."), data.get("root", ""), data.get("references", {}).get("group", ""), data.get("indent", 0),
        )


def profiles(folder: str | Path = PROFILES) -> dict[str, Backend]:
    """The backends of a folder's profiles by name."""
    found = [Backend.load(json.loads(p.read_text())) for p in sorted(Path(folder).glob("*.json"))]
    return {b.name: b for b in found}


BACKENDS = profiles()


def register(backend: Backend) -> None:
    """Adds a backend, or replaces the one of its name."""
    BACKENDS[backend.name] = backend


def identifier(name: str, b: Backend, used: set[str] | None = None, ordinal: int | None = None) -> str:
    """A name as an identifier: other characters become ``_``, and then a short hash keeps it apart from others.

    Remapped words have their own spelling, reserved ones and taken members an underscore more. A taken
    name gets ``_o`` and its ordinal, or ``_2`` and on.
    """
    bare = re.sub(r"[^0-9A-Za-z_]", "_", name) or "_"
    if bare != name and name:
        bare += "_" + hashlib.sha256(name.encode()).hexdigest()[:6]
    if bare[0].isdigit():
        bare = "_" + bare
    bare = b.remap.get(bare, bare)
    if bare in b.reserved or bare in b.members:
        bare += "_"
    if used is None:
        return bare
    options = [bare] + ([f"{bare}_o{ordinal}"] if ordinal is not None else [])
    n = 2
    while options[0] in used:
        options = options[1:] or [f"{bare}_{n}"]
        n += options[0] == f"{bare}_{n}"
    used.add(options[0])
    return options[0]


def split_type(text: str) -> tuple[str, list[str]]:
    """Head and arguments of a type of the vocabulary."""
    if "<" not in text or not text.endswith(">"):
        return text, []
    head, rest = text[:-1].split("<", 1)
    args, depth, last = [], 0, 0
    for i, ch in enumerate(rest):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            args.append(rest[last:i])
            last = i + 1
    return head, [a for a in [*args, rest[last:]] if a]


def spell(text: str, b: Backend) -> str:
    """A type of the vocabulary in the target's spelling."""
    head, args = split_type(text)
    if head in b.scalars:
        return b.scalars[head]
    inner = [spell(a, b) for a in args]
    if head == "tuple":
        return b.containers["tuple"].format(", ".join(inner)) if inner else b.unknown
    pattern = b.containers.get(head)
    if pattern is None:
        return b.unknown
    need = pattern.count("{}")
    return pattern.format(*[*inner, *[b.fallback] * need][:need])


def flat(text: str) -> str:
    """Blocks on one line each: a body is drawn up to the line that opens it."""
    return re.sub(r"\{\n\s*([^{}\n]*?)\n\s*\}", r"{ \1 }", text)


def squeezed(text: str) -> str:
    """No two blank lines in a row, no blanks at line ends, one line break at the end."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip("\n") + "\n"


@dataclass
class _Group:
    name: str = ""
    path: str = ""
    items: list[dict] = field(default_factory=list)
    children: dict[str, _Group] = field(default_factory=dict)


class _Emitter:
    """One project in one language."""

    def __init__(self, b: Backend, project: str, items: list[dict], context: dict[str, str], pipelines: list[dict], pretty: bool):
        self.b, self.project, self.items, self.context, self.pipelines, self.pretty = b, project, items, context, pipelines, pretty
        self.refs: dict[int, str] = {}
        self.root = _Group()
        for i in items:
            at = self.root
            for part in filter(None, (i["group_path"] or "").split(".")):
                at = at.children.setdefault(part, _Group(part, f"{at.path}.{part}".strip(".")))
            at.items.append(i)

    def t(self, template: str, /, **values: object) -> str:
        return self.b.templates[template].format(**values)

    def alias(self, sig: str) -> str:
        return "Sig" + hashlib.sha256(sig.encode()).hexdigest()[:10]

    def fields(self) -> str:
        used: set[str] = set()
        return "".join(self.t("field", key=k, name=identifier(k, self.b, used), type=spell(v, self.b)) for k, v in sorted(self.context.items()))

    def group(self, g: _Group, depth: int, owner: str) -> str:
        pad = "    " * (depth + self.b.indent)
        used: set[str] = set()
        out = []
        for i in g.items:
            i["ident"] = identifier(i["name"], self.b, used, i["ordinal"])
            op = i["ident"] + "__op"
            used.add(op)
            names: set[str] = set()
            params = ", ".join(self.t("param", name=identifier(p["name"], self.b, names), type=spell(p["type"], self.b)) for p in i["slots"])
            out.append(self.t("stub", pad=pad, ordinal=i["ordinal"], address=i["address"], ident=i["ident"], op=op, params=params, returns=spell(i["returns"], self.b)))
            self.refs[i["ordinal"]] = (self.b.reference or "{owner}" + self.b.join + "{name}").format(owner=owner, name=op)
        by_class: dict[str, list[dict]] = {}
        for i in g.items:
            by_class.setdefault(i["sig_class"], []).append(i)
        for sig, held in sorted(by_class.items()):
            out.append(self.t("array", pad=pad, sig=sig, name=self.alias(sig).upper(), count=len(held), refs=", ".join(self.refs[i["ordinal"]] for i in held)))
        for name, child in sorted(g.children.items()):
            own = identifier(name, self.b, used)
            kind = "group" if child.children else "leaf"
            out.append(self.t("open", pad=pad, path=child.path, name=own, kind=kind) + self.group(child, depth + 1, owner + self.b.join + own) + self.t("close", pad=pad))
        return "".join(out)

    def pipeline(self, p: dict, used: set[str]) -> str:
        call = self.refs
        steps = []
        for o in p["stages"]:
            if o in call:
                steps.append(self.t("pipeline_step", ref=call[o].replace("::", self.b.join)))
                steps += [self.t("edge", after=e["after"], **{"from": e["from_key"], "to": e["to_key"]}) for e in p.get("edges") or () if e["after"] == o]
        return self.t("pipeline", name=identifier("run_" + p["name"], self.b, used), stages=" -> ".join(map(str, p["stages"])), steps="".join(steps))

    def emit(self) -> list[tuple[str, str]]:
        groups = self.group(self.root, 0, self.b.root)
        used: set[str] = set()
        values = {
            "project": self.project, "crate": re.sub(r"[^a-z0-9_]", "_", self.project.lower()) or "project", "context": self.t("context", fields=self.fields()),
            "aliases": "".join(self.t("alias", sig=s, alias=self.alias(s)) for s in sorted({i["sig_class"] for i in self.items})), "groups": groups,
            "pipelines": "".join(self.pipeline(p, used) for p in self.pipelines),
            "master": self.t("master", count=len(self.items), refs=", ".join(self.t("master_item", ordinal=i["ordinal"], ref=self.refs[i["ordinal"]]) for i in self.items)),
        }
        out = [(path, squeezed(content.format(**values))) for path, content in self.b.files]
        return out if self.pretty else [(path, flat(content)) for path, content in out]


def _slots() -> Column:
    counted = F.filter(C.params(), lambda p: ~F.coalesce(p["kind"], F.lit("positional")).isin("receiver", "kwvariadic"))
    return F.transform(counted, lambda p: F.struct(F.coalesce(p["name"], F.lit("arg")).alias("name"), C.typed(p["norm_type"]).alias("type")))


def skeletons(catalog: DataFrame, backend: str, group: str | None = None, pretty: bool = False, pipelines: DataFrame | None = None) -> DataFrame:
    """(project, backend, path, content, items, error): the files of each project's skeleton.

    ``group`` keeps the items of one group and those below it; the context stays whole. ``pipelines``
    (project, name, stages, edges) become functions. Unless ``pretty``, a body stands on one line. A
    project that cannot be written gives one row with ``error`` set, and the others theirs.
    """
    b = BACKENDS.get(backend)
    if b is None:
        raise ValueError(f"no backend for {backend!r} (known: {', '.join(sorted(BACKENDS))})")
    adapters = [F.col(f"ctx_adapter.{s}") for s in ("requires", "provides")] if "ctx_adapter" in catalog.columns else []
    keys = F.flatten(F.array(*[F.coalesce(a, F.array().cast("array<struct<key:string,value:string>>")) for a in adapters])) if adapters else F.array().cast("array<struct<key:string,value:string>>")
    chosen = F.lit(True) if group is None else (F.col("group_path") == group) | F.col("group_path").startswith(group + ".")
    rows = catalog.where("name IS NOT NULL AND ordinal IS NOT NULL").select(
        "project", "ordinal", F.coalesce("address", F.lit("")).alias("address"), "name", F.coalesce("group_path", F.lit("")).alias("group_path"), F.coalesce("sig_class", F.lit("sig:->any")).alias("sig_class"),
        _slots().alias("slots"), C.typed(F.col("signature.returns.norm_type")).alias("returns"), keys.alias("keys"), F.coalesce(chosen, F.lit(False)).alias("chosen"), F.lit(None).cast("array<int>").alias("stages"), F.lit(None).cast("string").alias("edges"),
    )
    if pipelines is not None:
        edges = F.to_json("edges") if "edges" in pipelines.columns else F.lit(None).cast("string")
        made = pipelines.select("project", F.lit(-1).alias("ordinal"), F.lit("").alias("address"), "name", F.lit("").alias("group_path"), F.lit("").alias("sig_class"), F.array().cast("array<struct<name:string,type:string>>").alias("slots"), F.lit("unit").alias("returns"), F.array().cast("array<struct<key:string,value:string>>").alias("keys"), F.lit(False).alias("chosen"), "stages", edges.alias("edges"))
        rows = rows.unionByName(made)

    def emit(part: pd.DataFrame) -> pd.DataFrame:
        project = part["project"].iloc[0]
        try:
            context: dict[str, str] = {}
            for held in part.sort_values("ordinal")["keys"]:
                for e in held:
                    context.setdefault(e["key"], e["value"] or "any")
            items = part[part["chosen"]].sort_values(["ordinal", "address"]).to_dict("records")
            lines = [{"name": r.name_, "stages": [int(o) for o in r.stages], "edges": json.loads(r.edges) if r.edges else []} for r in part[part["stages"].notna()].rename(columns={"name": "name_"}).sort_values("name_").itertuples()]
            files = _Emitter(b, project, items, context, lines, pretty).emit()
            out = [(project, b.name, path, content, len(items), None) for path, content in files]
        except Exception as e:  # one project's failure is a row, not the end of the job
            out = [(project, b.name, None, None, None, f"{type(e).__name__}: {e}")]
        return pd.DataFrame(out, columns=["project", "backend", "path", "content", "items", "error"])

    return rows.groupBy("project").applyInPandas(emit, FILES)


def write(files: DataFrame, root: str) -> None:
    """Writes skeleton files below ``root``/project/backend, on any file system that Spark knows.

    Files are code of small projects' size, so they pass the driver one by one.
    """
    spark = files.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for r in files.where("error IS NULL").toLocalIterator():
        target = path("/".join([root.rstrip("/"), re.sub(r"[^\w.-]", "_", r.project), r.backend, r.path]))
        stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
        try:
            stream.write(bytearray(r.content.encode()))
        finally:
            stream.close()


def matrix(catalog: DataFrame) -> DataFrame:
    """(project, backend, items, lines, error) of each project in each target; a failure fills its own row alone."""
    out = None
    for name in sorted(BACKENDS):
        lines = skeletons(catalog, name).groupBy("project", "backend").agg(F.max("items").alias("items"), F.sum(F.size(F.split("content", "\n")) - 1).alias("lines"), F.max("error").alias("error"))
        out = lines if out is None else out.unionByName(lines)
    return out


def matrix_table(catalog: DataFrame) -> DataFrame:
    """One row per project, by name: its items and, for each target, lines or the error."""
    cells = matrix(catalog).withColumn("cell", F.coalesce(F.concat(F.lit("error: "), "error"), F.concat(F.col("lines").cast("string"), F.lit(" lines"))))
    return cells.groupBy("project").pivot("backend", sorted(BACKENDS)).agg(F.first("cell")).join(cells.groupBy("project").agg(F.max("items").alias("items")), "project").select("project", "items", *sorted(BACKENDS)).orderBy("project")
