"""p3: source files that do not parse in the language of their extension."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from . import syntax

ERROR = pa.struct([("line", pa.int32()), ("cause", pa.string())])


def extension(path: Column) -> Column:
    """Lower-case extension of a path of either slash; null if there is none."""
    e = F.lower(F.regexp_extract(F.trim(path), r"\.([A-Za-z0-9]+)$", 1))
    return F.when(e != "", e)


def syntax_errors(df: DataFrame, key: str, path: str, code: str, keep: list[str] | None = None) -> DataFrame:
    """(key, keep..., language, errors ARRAY<STRUCT<line, cause>>, first_cause) of every row.

    errors is empty for a valid file and null where nothing was checked: no
    text (null or empty) or an extension without a parser (language null).
    Repeated rows come out as often as they come in; other columns are dropped.
    No shuffle.
    """
    ship(df.sparkSession)
    keep = keep or []
    kinds = dict(df.dtypes)
    names = [f"k{i}" for i in range(1 + len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, errors, first = [], [], []
            for e, t in zip(b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist()):
                lang = syntax.LANGUAGES.get(e)
                langs.append(lang)
                got = syntax.check(lang, t) if lang and t else None
                errors.append(None if got is None else [{"line": x.line, "cause": x.cause} for x in got])
                first.append(got[0].cause if got else None)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(langs, pa.string()), pa.array(errors, pa.list_(ERROR)), pa.array(first, pa.string())], names=[*names, "language", "errors", "first_cause"])

    schema = ", ".join(f"{n} {kinds[c]}" for n, c in zip(names, [key, *keep])) + ", language string, errors array<struct<line:int,cause:string>>, first_cause string"
    rows = df.select(*[F.col(c).alias(n) for n, c in zip(names, [key, *keep])], extension(F.col(path)).alias("e"), F.col(code).alias("t"))
    return rows.mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, [key, *keep])))


def acceptance(checked: DataFrame, by: list[str]) -> DataFrame:
    """(by..., files, invalid, acceptance) over the checked rows."""
    return checked.where(F.col("errors").isNotNull()).groupBy(*by).agg(F.count("*").alias("files"), F.count_if(F.size("errors") > 0).alias("invalid")).withColumn("acceptance", 1 - F.col("invalid") / F.col("files"))
