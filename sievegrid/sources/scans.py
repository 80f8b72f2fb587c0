"""Scans of folders of JSON and YAML, nested wrappers, streamed list items, link manifests, audits and mix-ins."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import MAX_BYTES, workspace

try:
    import yaml
except ImportError:  # YAML files then give one row of error 'yaml_not_available'
    yaml = None

RECORD = "path string, at int, kind string, record string, error string"
#: Keys under which records lie, by the kind of record.
WRAPPERS = {"validated_nodes": "validated", "rejected_nodes": "rejected", "compiled_skills": "skill"}


def records_of(value) -> list[tuple[str, dict]]:
    """(kind, record) of a document, whatever its shape: a list, lists in a list, wrapped lists at any depth, or one object."""
    if isinstance(value, list):
        return [x for v in value for x in (records_of(v) if isinstance(v, list) else [("plain", v)] if isinstance(v, dict) else [])]
    if not isinstance(value, dict):
        return []
    found = []
    todo = [value]
    while todo:
        v = todo.pop(0)
        for key, kind in WRAPPERS.items():
            if isinstance(v.get(key), list):
                found += [(kind, r) for r in v[key] if isinstance(r, dict)]
        todo += [x for k, x in v.items() if isinstance(x, dict)]
    return found or [("plain", value)]


def parse(path: str, raw) -> tuple[list[tuple[str, dict]], str | None]:
    text = raw if isinstance(raw, str) else bytes(raw).decode("utf-8", "replace")
    try:
        if path.lower().endswith((".yaml", ".yml")):
            if yaml is None:
                return [], "yaml_not_available"
            return records_of(yaml.safe_load(text)), None
        if path.lower().endswith(".jsonl"):
            out = []
            for line in text.split("\n"):
                try:
                    out += records_of(json.loads(line)) if line.strip() else []
                except ValueError:
                    continue
            return out, None
        return records_of(json.loads(text)), None
    except Exception as e:  # noqa: BLE001 - a broken file is a row, not the end of the scan
        return [], type(e).__name__


def folder_records(spark: SparkSession, path: str, skip: str = ".rejected.yaml") -> DataFrame:
    """(path, at, kind, record, error): the records of all JSON, JSON-lines and YAML files of a folder, record as JSON, in the order of
    the file's name and place. Files that end in `skip` are left out; a broken file gives one row with its error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(F.lower("path").rlike("\\.(jsonl?|ya?ml)$") & ~F.col("path").endswith(skip)).select("path", "content")
    return flattened(files).orderBy("path", "at")


def flattened(files: DataFrame) -> DataFrame:
    """The same of files (path, content), unordered."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, raw in zip(b["path"], b["content"]):
                got, error = parse(path, raw)
                rows += [(path, i, kind, json.dumps(r, sort_keys=True, default=str), None) for i, (kind, r) in enumerate(got)]
                if error:
                    rows.append((path, 0, "broken", None, error))
            yield pd.DataFrame(rows, columns=["path", "at", "kind", "record", "error"]).astype({"at": "int32"})

    return files.select("path", "content").mapInPandas(run, RECORD)


def block_items(spark: SparkSession, path: str, key: str = "validated_nodes") -> DataFrame:
    """(path, item): the items of one block list of YAML files, cut where a line begins with '- ', so no file is parsed as one document."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    block = F.regexp_extract("value", f"(?m)^{key}:[ \\t]*\\n((?:[ \\t]*-[^\\n]*(?:\\n|\\z)|[ \\t]+[^\\n]+(?:\\n|\\z)|[ \\t]*\\n)*)", 1)
    items = F.split(F.regexp_replace(block, "^[ \\t]*- ", ""), "\\n[ \\t]{0,2}- ")
    return text.select("path", F.explode(items).alias("item")).where(F.trim("item") != "")


def discover(spark: SparkSession, path: str) -> DataFrame:
    """(path, stream): input files by name: failure matrices feed 'failure', others 'knowledge'; files whose first record has a
    `_mode` are this engine's own outputs and come as 'own'."""
    first = spark.read.text(f"{path}/*.jsonl", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", "\n", 2)[0].alias("first"))
    return first.select("path", F.when(F.array_contains(F.json_object_keys("first"), "_mode"), "own").when(F.lower("path").contains("failure_matrix"), "failure").otherwise("knowledge").alias("stream"))


def link_manifest(lines: DataFrame, text: str, manifest: DataFrame | None = None) -> DataFrame:
    """(url, project, status): repository links in texts, each once, with the status that a manifest (url, status) has for it, else
    'Pending'; sorted by project."""
    urls = lines.select(F.explode(F.regexp_extract_all(text, F.lit("(https?://github\\.com/[A-Za-z0-9._-]+/[A-Za-z0-9._-]+)"), 1)).alias("url"))
    urls = urls.select(F.regexp_replace("url", "(\\.git)?[.]*$", "").alias("url")).distinct()
    out = urls.withColumn("project", F.element_at(F.split("url", "/"), -1))
    if manifest is None:
        return out.withColumn("status", F.lit("Pending")).orderBy("project", "url")
    done = manifest.groupBy("url").agg(F.max("status").alias("status"))
    return out.join(done, "url", "left").select("url", "project", F.coalesce("status", F.lit("Pending")).alias("status")).orderBy("project", "url")


def pending(manifest: DataFrame, most: int = 5) -> DataFrame:
    """The circuit breaker: the first pending links, so many at a time."""
    return manifest.where("status = 'Pending'").orderBy("project", "url").limit(most)


def landing_pad(spark: SparkSession, path: str, deny: list[str]) -> DataFrame:
    """(name, files, bytes): the first folders under a path but those denied, with what they hold."""
    root = path.rstrip("/").split("://")[-1]
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    name = F.regexp_extract("path", f"{root}/([^/]+)/", 1)
    return f.select(name.alias("name"), "length").where((F.col("name") != "") & ~F.lower("name").isin(*[d.lower() for d in deny])).groupBy("name").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def audits(rows: DataFrame) -> DataFrame:
    """(frozen_node, audits): audit rows (frozen_node, branch, node, cause, recommendation) by node, sorted."""
    return rows.where("frozen_node is not null").groupBy("frozen_node").agg(F.sort_array(F.collect_set(F.struct("branch", "node", "cause", "recommendation"))).alias("audits"))


def mixed_in(records: DataFrame, extra: DataFrame, order: str, share: float = 0.2) -> DataFrame:
    """The records and the first floor(share x records) rows of another set by an order; the share is counted, not collected."""
    n = int(records.count() * share)
    return records.unionByName(extra.orderBy(order).limit(n), allowMissingColumns=True)


def chunks(spark: SparkSession, path: str, size: int = 3500) -> DataFrame:
    """(chunk, path, size): a workspace's text files in chunks of so many, in the order of their paths within each folder of the
    first level."""
    from pyspark.sql.window import Window

    f = workspace(spark, path).where("is_text").select("path", "size", F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("folder"))
    i = F.row_number().over(Window.partitionBy("folder").orderBy("path")) - 1
    return f.select(F.concat_ws("#", "folder", F.floor(i / size).cast("string")).alias("chunk"), "path", "size")


def pages(files: DataFrame) -> DataFrame:
    """(path, text) of PDF files (path, content) with a [PAGE n] mark before every page; text is null without a PDF library."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            from pypdf import PdfReader
        except ImportError:
            PdfReader = None  # noqa: N806
        import io

        for b in batches:
            texts = []
            for raw in b["content"]:
                if PdfReader is None or raw is None or len(raw) > 20 * MAX_BYTES:
                    texts.append(None)
                    continue
                try:
                    texts.append("\n".join(f"[PAGE {i}]\n{p.extract_text() or ''}" for i, p in enumerate(PdfReader(io.BytesIO(bytes(raw))).pages, 1)))
                except Exception:  # noqa: BLE001 - a broken file has no text
                    texts.append(None)
            yield pd.DataFrame({"path": b["path"], "text": texts})

    return files.select("path", "content").mapInPandas(run, "path string, text string")
