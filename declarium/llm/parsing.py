"""Source files that break the syntax of their language, and their rates.

A file's token stream is parsed with derivatives against the grammar of the language its ending
says. An empty derivative marks the exact token that fits nowhere; a file all of whose tokens fit but
whose last derivative cannot be empty is cut off. A Python file that the grammar rejects is tried by
the language's own parser, which can only acquit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declarium.sources import columns
from declarium.syntax import lexers
from declarium.syntax.parsing import failure


def judged(files: DataFrame) -> DataFrame:
    """(file_id bigint, project, language string, broken boolean, failure string, token int, tokens int).

    One row per file whose ending is of a known language, by its latest delivery. ``failure`` is
    ``token`` or ``truncated`` for a broken file, ``token`` the place of the failing token from 0. Null
    and empty texts are valid. Rows without an id are left out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, project, file, text, stamp in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                language = lexers.language_of(file)
                found = failure(language, text) if text and language else None
                kind, at, n = found or (None, None, None)
                out.append((key, stamp, project, language, found is not None, kind, at, n))
            cols = list(zip(*out, strict=True)) or [()] * 8
            kinds = (pa.int64(), pa.timestamp("us"), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int32())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["file_id", "stamp", "project", "language", "broken", "failure", "token", "tokens"])

    rows = columns(files, "file_id", "project", "file", "content", "loaded_at").where("file_id IS NOT NULL").withColumn("loaded_at", F.col("loaded_at").cast("timestamp_ntz"))
    found = rows.mapInArrow(run, "file_id bigint, stamp timestamp_ntz, project string, language string, broken boolean, failure string, token int, tokens int")
    best = F.max(F.struct("stamp", "broken", "project", "language", "failure", "token", "tokens")).alias("r")
    return found.groupBy("file_id").agg(best).where("r.language IS NOT NULL").select("file_id", "r.project", "r.language", "r.broken", "r.failure", "r.token", "r.tokens")


def found(files: DataFrame) -> DataFrame:
    """(file_id bigint): the files that break the syntax of their language."""
    return judged(files).where("broken").select("file_id")


def rates(files: DataFrame) -> DataFrame:
    """(project, language string, files, broken bigint, rate double) of each project and language."""
    out = judged(files).groupBy("project", "language").agg(F.count("*").alias("files"), F.count_if("broken").alias("broken"))
    return out.withColumn("rate", F.col("broken") / F.col("files"))
