"""Source files that do not parse, by the recursive-descent parsers of ``syntax``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OUT = pa.schema([("id", pa.string()), ("repo", pa.string()), ("path", pa.string()), ("language", pa.string()), ("errors", pa.list_(pa.struct([("line", pa.int64()), ("message", pa.string())])))])
_DDL = "id string, repo string, path string, language string, errors array<struct<line: long, message: string>>"


def parsed(files: DataFrame) -> DataFrame:
    """``(id, repo, path, language, errors)`` of each row of ``files`` (id, repo, path, code) whose path has a known language.

    ``errors`` is empty for a text that parses, empty texts included; rows with
    a null code or path are left out. Texts are parsed row by row where they
    lie: nothing is shuffled and no task holds more than a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomgraph.llm.operators.syntax import check, language

        for b in batches:
            rows = []
            for key, repo, path, code in zip(*(b.column(i).to_pylist() for i in range(4))):
                errors = check(code, path)
                if errors is not None:
                    rows.append((key, repo, path, language(path), [{"line": n, "message": m} for n, m in errors]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_OUT), _OUT)], schema=_OUT)

    return files.select("id", "repo", "path", "code").where(F.col("code").isNotNull() & F.col("path").isNotNull()).mapInArrow(run, _DDL)


def rates(files: DataFrame) -> DataFrame:
    """``(repo, language, files, broken, rate)`` over distinct files."""
    one = parsed(files).select("id", "repo", "language", (F.size("errors") > 0).alias("bad")).groupBy("id", "repo", "language").agg(F.max("bad").alias("bad"))
    out = one.groupBy("repo", "language").agg(F.count("*").alias("files"), F.sum(F.col("bad").cast("bigint")).alias("broken"))
    return out.withColumn("rate", F.round(F.col("broken") / F.col("files"), 6))
