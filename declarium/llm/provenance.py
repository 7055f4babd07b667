"""Files that nobody wrote by hand for their project: tool output, minified scripts, copies, data.

One automaton finds all notices in a file's header in a single walk over it; rules over the path
know the folders and names that tools and copies use; two measures of the whole text tell minified
scripts and literal data that carry neither.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declarium.sources import columns

#: Notices by kind; a line of the header that scores 2 or more is one. What only talks about notices
#: cancels the weak ones, those of 1, and the strong ones that follow it.
NOTICES = {
    "generated": {
        2: ["@generated", "<auto-generated", "autogenerated by", "auto-generated by", "auto-generated file", "autogenerated file", "automatically generated", "generated automatically", "code generated by", "generated code", "do not modify by hand", "do not edit by hand", "do not edit manually", "machine written", "machine-written", "machine generated", "machine-generated", "hand edits are overwritten", "edits will be overwritten", "changes will be lost", "changes will be overwritten", "this is a generated file", "this file is generated", "this file was generated", "this file is auto-generated", "file generated by", "regenerate with", "generated by the protocol buffer compiler"],
        1: ["do not edit", "do not modify", "generated by", "generated from", "produced by", "written by a tool", "autogenerated", "auto-generated"],
    },
    "copied": {
        2: ["vendored from", "vendored copy", "copied unchanged from", "third-party file", "third party file", "bundled copy", "local patches are not allowed", "keep in step with upstream", "upstream fixes go to", "redistributed under", "imported as is", "copied verbatim from"],
        1: ["third-party", "upstream", "copied from", "bundled with", "imported from"],
    },
    "": {-4: ["emits", "into its", "talks about", "looks for", "a chat about", "notices such as", "files that say"]},
}
_FOLDERS = {
    "copied": "vendor|_vendor|third_party|third-party|thirdparty|node_modules|bower_components|site-packages",
    "generated": "generated|__generated__|_generated|gen|autogen",
}
_PATHS = [
    ("copied", re.compile(rf"(?:^|/)(?:{_FOLDERS['copied']})/")),
    # folders with these names hold copies where each has a folder of its own
    ("copied", re.compile(r"(?:^|/)(?:deps|extern|external)/[^/]+/")),
    ("generated", re.compile(rf"(?:^|/)(?:{_FOLDERS['generated']})/")),
    ("minified", re.compile(r"[.-](?:min|bundle)\.[cm]?jsx?$|\.chunk\.[cm]?js$")),
    ("generated", re.compile(r"(?:_pb2|_pb2_grpc|_generated|\.pb|\.generated|\.gen|\.g|\.designer)\.\w+$")),
    ("data", re.compile(r"(?:^|/)(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|cargo\.lock|poetry\.lock|go\.sum|gemfile\.lock|composer\.lock)$")),
]
#: Literals; a text in three quotes (group 1) is documentation as a rule, and counts as neither literal nor code.
_LITERAL = re.compile(r"(\"{3}(?s:.*?)\"{3}|'{3}(?s:.*?)'{3})|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|-?\b(?:0[xX][0-9a-fA-F_]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)\b")
#: Share of a text's solid characters in literals and what parts them from which it is data; mean
#: length of its lines, weighed by their characters, and share of blanks of a minified script.
DATA_SHARE, MINIFIED_LINE, MINIFIED_BLANKS = 0.65, 400, 0.08


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, weights in NOTICES.items():
        for weight, phrases in weights.items():
            for p in phrases:
                found.add_word(p, (kind, weight))
    found.make_automaton()
    return found


_NOTICES = _automaton()


def header(text: str) -> list[str]:
    """The comment lines before the first line of code, in lower case."""
    out: list[str] = []
    inside = ""
    at = 1 if text[:1] == "﻿" else 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end].strip().lower()
        at = end + 1
        if inside:
            out.append(line)
            if inside in line:
                inside = ""
        elif line.startswith(("#", "//", "--", ";;")):
            out.append(line)
        elif line.startswith("/*"):
            out.append(line)
            inside = "" if "*/" in line[2:] else "*/"
        elif line.startswith(('"""', "'''")):
            out.append(line)
            inside = "" if line[:3] in line[3:] else line[:3]
        elif line:
            break
    return out


def _notice(text: str) -> str | None:
    for line in header(text):
        hits = list(_NOTICES.iter(line))
        talk = min((end for end, (kind, _) in hits if not kind), default=None)
        score: dict[str, int] = {"": 0}
        for end, (kind, weight) in hits:
            if kind and (talk is None or weight > 1 and end < talk):
                score[kind] = score.get(kind, 0) + weight
        best = max(score, key=lambda k: (score[k], k))
        if best and score[best] >= 2:
            return best
    return None


def kind_of(file: str | None, text: str | None) -> tuple[str, str] | None:
    """(kind, evidence) of a file that is not written by hand, else None.

    Kinds are ``generated``, ``copied``, ``minified`` and ``data``; evidence is ``notice``, ``path`` or
    ``content``, the first that holds. A null text is judged by its path alone, a null path by its
    text alone; an empty text is nobody's work and never a case.
    """
    path = (file or "").strip().replace("\\", "/").lower()
    while path.startswith("./"):
        path = path[2:]
    if text is not None:
        if not text.strip("﻿ \t\r\n"):
            return None
        if kind := _notice(text):
            return kind, "notice"
    for kind, rule in _PATHS:
        if rule.search(path):
            return kind, "path"
    if not text:
        return None
    lines = text.split("\n")
    longest = max(map(len, lines))
    if longest >= MINIFIED_LINE and re.search(r"\.[cm]?jsx?$|\.tsx?$", path):
        weighed = sum(len(x) ** 2 for x in lines) / max(len(text), 1)
        blanks = text.count(" ") + text.count("\n") + text.count("\t")
        if weighed >= MINIFIED_LINE and blanks <= MINIFIED_BLANKS * len(text):
            return "minified", "content"
    solid = len("".join(text.split()))
    # a text that is mainly literals has one at least on every other line or is one line
    literals = separators = 0
    for m in _LITERAL.finditer(text):
        if m.group(1):
            solid -= len("".join(m.group(1).split()))
            continue
        literals += m.end() - m.start()
        separators += text[m.end() : m.end() + 1] in ",;:"
    if solid > 0 and literals + separators >= DATA_SHARE * solid:
        return "data", "content"
    return None


def report(files: DataFrame) -> DataFrame:
    """(file_id bigint, project, kind, evidence string) of each file that is not written by hand.

    Each file comes out once, judged by its latest delivery (the greatest kind and evidence among
    ties); rows without an id are left out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [kind_of(file, text) or (None, None) for file, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            kinds, evidence = ([f[k] for f in found] for k in range(2))
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(4), pa.array(kinds, pa.string()), pa.array(evidence, pa.string())], ["file_id", "project", "stamp", "kind", "evidence"])

    rows = columns(files, "file_id", "project", "file", "content", "loaded_at").where("file_id IS NOT NULL").withColumn("loaded_at", F.col("loaded_at").cast("timestamp_ntz"))
    found = rows.mapInArrow(run, "file_id bigint, project string, stamp timestamp_ntz, kind string, evidence string")
    return found.groupBy("file_id").agg(F.max(F.struct("stamp", "kind", "evidence", "project")).alias("r")).where("r.kind IS NOT NULL").select("file_id", "r.project", "r.kind", "r.evidence")


def found(files: DataFrame) -> DataFrame:
    """(file_id bigint): the files of ``report``."""
    return report(files).select("file_id")
