"""Functions and methods paired with their documentation comment.

Every file that parses becomes a declaration tree; its function nodes are visited, each with the
comment attached to it and its exact range, and those whose comment is missing or says nothing are
left out.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from declarium.sources import columns
from declarium.syntax import lexers, nodes, parsing, trees

#: Words that documentation must hold besides those of the function's own name.
TELLING = 4

_MARKS = re.compile(r"^\s*(?:/\*+!?|\*+/|\*+(?!\w)|///?!?|//+|#+!?(?!\w)|\*)?\s?")
_WORD = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|[A-Z]+")
#: Lines that tell nothing: tags, directives to tools, notes of unfinished work.
_TAG = re.compile(r"\s*(?:[@\\][A-Za-z]|:\w+(?:\s+[^:\n]*)?:|<(?:param|returns?|summary|exception|remarks)\b|</)")
_DIRECTIVE = re.compile(
    r"\s*(?:eslint\b|tslint:|prettier-ignore|jshint\b|jslint\b|istanbul\b|c8 ignore|v8 ignore|webpack\w*:|@?ts-(?:ignore|expect-error|nocheck|check)|noqa\b|type:\s*ignore|pylint:|flake8:|mypy:|pyright:|ruff:|yapf:|isort:|fmt:\s*(?:off|on|skip)|pragma\b|nosec\b|nolint\b|go:\w+|\+build\b|lint:|nosonar\b|noinspection\b|checkstyle[: ]|spotless:|formatter:|clang-format|clippy::|rustfmt|shellcheck\b|vim?:|-\*-|SPDX-|coverage:|codecov|region\b|endregion\b|sourceMappingURL|export \w+$|cspell:|biome-ignore|deno-lint|oxlint|gofmt|golint|sonar\w*:|suppress\w*:)",
    re.I,
)
_UNFINISHED = re.compile(r"\s*[\[(*-]*\s*(?:TODO|FIXME|XXX|HACK|TBD|WIP|BUG|OPTIMIZE|UNDONE|REVIEW)\b", re.I)
_CODE = re.compile(
    r"""\s*(?:
      .*[;{}]\s*$
    | (?:\w[\w.\[\]"']*|\$\w+)\s*(?:=|:=|\+=|-=|\*=|/=|\|=)\s*\S.*
    | (?:return|await|yield|throw|raise|assert|del|delete|import|from\s+[\w.]+\s+import|package|use|let|const|var|val|mut|local|export|echo|print|println!?|printf|defer|go|goto)\b(?=\s*[\w"'$({\[])(?:.*(?:\w!?\(|\s:?=\s|;\s*$|["'`$]|\w\.\w|::|[\[\]{}]).*|\s+[\w.]+\s*)$
    | (?:if|while|for|switch|match|elif|else\s+if|with|try|except|catch|def|fn|func|function|class|struct|impl|public|private|protected|static|async)\b.*(?:[:{]|\w\([\w\s,:&<>]*+\)?)\s*$
    | [\w.:>\-]+\(.*\)\s*[;,:]?\s*$
    | (?:\}|\)|\]|else\b\s*[:{]?|end|fi|done|esac|pass|break|continue)\s*[;,]?\s*$
    | .*(?:=>|&&|\|\||==|!=)\s*\S+.*$
    )""",
    re.X,
)


def name_words(name: str) -> frozenset[str]:
    """The words of a name, in lower case: parts between marks and changes of case."""
    return frozenset(w.lower() for part in _WORD.findall(name) for w in [part, *_PARTS.findall(part)])


def description(doc: str | None) -> list[str]:
    """The lines of a comment or docstring that can describe, without comment marks."""
    out = []
    for line in (doc or "").splitlines():
        bare = _MARKS.sub("", line, count=1)
        bare = re.sub(r"\s*\*+/\s*$", "", bare)
        if bare.strip() and not (_TAG.match(bare) or _DIRECTIVE.match(bare) or _UNFINISHED.match(bare) or _CODE.match(bare)):
            out.append(bare.strip())
    return out


def telling(doc: str | None, name: str, least: int = TELLING) -> str | None:
    """What a comment says, or None if fewer than ``least`` words beside the name's own remain."""
    lines = description(doc)
    own = name_words(name)
    n = 0
    for line in lines:
        for word in _WORD.findall(line):
            parts = [p.lower() for p in _PARTS.findall(word)] or [word.lower()]
            if word.lower() not in own and not all(p in own for p in parts):
                n += 1
    return "\n".join(lines) if n >= least else None


def documented(language: str, text: str) -> list[tuple[trees.Declaration, str]]:
    """Function nodes of a ``plain`` text with what their comments say; none if it does not parse."""
    if language == "python":
        found = trees.python_tree(text) or []
        return [(d, says) for d in found if d.doc and (says := telling(d.doc, d.name))]
    source = parsing.source(language, text)
    if source is None or not source.comments:
        return []
    found = trees.shell_tree(source) if language == "bash" else nodes.declarations(language, source)
    return [(d, says) for d in found if d.doc and (says := telling(d.doc, d.name))]


_KINDS = {"file_id": "bigint", "stamp": "timestamp_ntz", "name": "string", "start_line": "int", "project": "string", "language": "string", "end_line": "int", "doc": "string", "body_text": "string"}


def _rows(files: DataFrame, texts: bool = True) -> DataFrame:
    """The rows of ``pairs`` for each delivery, and one without a name for each, which tells that there was one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, project, file, content, stamp in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                rows.append((key, stamp, None, None, None, None, None, None, None))
                language = lexers.language_of(file)
                if language is None or not content:
                    continue
                text = lexers.plain(content)
                found = documented(language, text)
                if not found:
                    continue
                lines = [0, *[m.end() for m in re.finditer("\n", text)]]
                for d, says in found:
                    rows.append((key, stamp, d.name, bisect_right(lines, d.name_at), project, language, bisect_right(lines, max(d.start, d.end - 1)), says, text[d.start : d.end]) if texts else (key, stamp, d.name, bisect_right(lines, d.name_at), None, None, None, None, None))
                if len(rows) > 2_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    rows = columns(files, "file_id", "project", "file", "content", "loaded_at").where("file_id IS NOT NULL").withColumn("loaded_at", F.coalesce(F.col("loaded_at").cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz")))
    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in _KINDS.items()))


def _latest(rows: DataFrame) -> DataFrame:
    """The rows of each file's latest delivery."""
    last = F.max("stamp").over(Window.partitionBy("file_id"))
    return rows.withColumn("last", last).where("stamp = last AND name IS NOT NULL").drop("last", "stamp")


def pairs(files: DataFrame) -> DataFrame:
    """(file_id bigint, start_line int, name, project, language string, end_line int, doc, body_text string).

    One row per function or method with a body and telling documentation, in files that parse.
    ``start_line`` is the line on which the name stands, from 1. A file that is delivered more than
    once counts by its latest ``loaded_at``. Null and empty texts, endings of no known language and
    rows without an id give no rows.
    """
    best = F.max(F.struct("project", "language", "end_line", "doc", "body_text")).alias("r")
    return _latest(_rows(files)).groupBy("file_id", "start_line", "name").agg(best).select("file_id", "start_line", "name", "r.*")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "timestamp_ntz": pa.timestamp("us")}
    cols = list(zip(*rows, strict=True)) or [()] * len(_KINDS)
    return pa.record_batch([pa.array(c, arrow[k]) for c, k in zip(cols, _KINDS.values(), strict=True)], list(_KINDS))


def found(files: DataFrame) -> DataFrame:
    """(file_id bigint, start_line int, name string) of ``pairs``."""
    return _latest(_rows(files, texts=False)).select("file_id", "start_line", "name").distinct()
