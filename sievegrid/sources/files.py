"""File scans and sinks: JSON lines with an audit, notebooks, workspaces, dual and byte-stable sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Folders and endings that a workspace scan leaves out.
IGNORED_FOLDERS = [".git", "__pycache__", "node_modules", ".venv", "venv", "dist", "build"]
IGNORED_ENDINGS = ["png", "jpg", "jpeg", "gif", "zip", "gz", "exe", "dll", "so", "pyc", "bin"]
MAX_BYTES = 1_500_000


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Objects of a JSON-lines file; blank, malformed and other lines are dropped."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def json_lines_audit(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line, error) of every line; error is null, empty_line, invalid_json or row_not_object.

    Line numbers count within a file: places within a split of it, which is
    bounded, and the counts of the splits before, so a large file is no one task.
    """
    from pyspark.sql.window import Window

    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    split = Window.partitionBy("file", "block")
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("file", "block", before.alias("before"))
    t = F.trim("line")
    value = F.try_parse_json("line")
    error = F.when(t == "", "empty_line").when(value.isNull(), "invalid_json").when(~t.startswith("{"), "row_not_object")
    placed = rows.withColumn("i", F.row_number().over(split.orderBy("at"))).join(offsets, ["file", "block"])
    return placed.select("file", (F.col("before") + F.col("i")).cast("int").alias("line_no"), "line", error.alias("error"))


def workspace(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size, modified, sha1, is_text, content): files under a folder, without ignored folders and endings and beyond MAX_BYTES.

    A file is no text if its first 2 KB hold a zero byte or more than 40 in 100 other control bytes.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    keep = (F.col("length") <= MAX_BYTES) & ~F.lower("path").rlike(r"\.(" + "|".join(IGNORED_ENDINGS) + ")$") & ~F.col("path").rlike("/(" + "|".join(x.replace(".", r"\.") for x in IGNORED_FOLDERS) + ")/")
    return f.where(keep).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.substring(F.sha1("content"), 1, 8).alias("sha1"), is_text("content").alias("is_text"), "content")


@F.pandas_udf(BooleanType())
def is_text(s: pd.Series) -> pd.Series:
    def one(b) -> bool:
        head = bytes(b[:2048]) if b is not None else b""
        if b"\0" in head:
            return False
        odd = sum(c < 32 and c not in (7, 8, 9, 10, 12, 13, 27) or c == 127 for c in head)
        return odd <= 0.4 * max(1, len(head))

    return s.map(one)


CELL = "path string, cell_index int, cell_type string, source string, traceback string, execution_count int"


def notebook_cells(files: DataFrame) -> DataFrame:
    """One row per cell of notebooks (path, content); a broken notebook gives one row of type 'invalid'."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, raw in zip(b["path"], b["content"]):
                rows.extend(_cells(path, raw))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CELL.split(", ")]).astype({"cell_index": "int32", "execution_count": "Int32"})

    return files.select("path", "content").mapInPandas(run, CELL)


def _cells(path: str, raw) -> list[tuple]:
    import re

    try:
        doc = json.loads(bytes(raw).decode("utf-8", "replace") if not isinstance(raw, str) else raw)
        cells = doc["cells"]
    except (ValueError, KeyError, TypeError):
        return [(path, 0, "invalid", None, None, None)]
    out = []
    for i, c in enumerate(cells):
        src = c.get("source") or ""
        trace = ""
        for o in c.get("outputs") or []:
            if o.get("output_type") == "error":
                trace += "\n".join(o.get("traceback") or [f"{o.get('ename')}: {o.get('evalue')}"])
            elif o.get("name") == "stderr":
                t = o.get("text") or ""
                t = "".join(t) if isinstance(t, list) else t
                if "Traceback" in t or "Error" in t:
                    trace += t
        out.append((path, i, c.get("cell_type"), "".join(src) if isinstance(src, list) else src, re.sub(r"\x1b\[[0-9;]*m", "", trace) or None, c.get("execution_count")))
    return out


def write_dual(df: DataFrame, reason: str, path: str) -> None:
    """Accepted rows (null reason) and rejected rows as JSON lines in two folders; one pass, partitioned by status."""
    df.withColumn("status", F.when(F.col(reason).isNull(), "accepted").otherwise("rejected")).write.mode("append").partitionBy("status").json(path)


def canonical(df: DataFrame) -> DataFrame:
    """(line): each row as JSON with its columns in the order of their names, sorted: the same rows give the same bytes."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("line")).orderBy("line")


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, digest): a digest of a table whatever the order of its rows; two sums of row hashes, no collection of rows."""
    row = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    h = F.sha2(row, 256)
    part = lambda k: F.sum(F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)"))
    sums = df.agg(F.count("*").alias("rows"), *[part(k).alias(f"s{k}") for k in range(4)])
    return sums.select("rows", F.sha2(F.concat_ws("|", "rows", *[F.coalesce(F.col(f"s{k}"), F.lit(0)).cast("string") for k in range(4)]), 256).alias("digest"))
