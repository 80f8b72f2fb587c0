"""Sinks: canonical JSON, sealed nodes, code bundles, run manifests, telemetry and reports."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical_json(c: Column, ascii_only: bool = True) -> Column:
    """JSON text with the keys of every object in order, compact, other characters as \\u escapes; null for what is no JSON."""
    return _canonical_ascii(c) if ascii_only else _canonical(c)


def _text(s: str | None, ascii_only: bool) -> str | None:
    if s is None:
        return None
    try:
        return json.dumps(json.loads(s), sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only)
    except ValueError:
        return None


@F.pandas_udf(StringType())
def _canonical_ascii(s):
    return s.map(lambda x: _text(x, True))


@F.pandas_udf(StringType())
def _canonical(s):
    return s.map(lambda x: _text(x, False))


def strip_keys(c: Column, keys: list[str], prefix: str | None = None) -> Column:
    """JSON text without the keys, at any depth, and without those that begin with the prefix; canonical."""
    drop = set(keys)

    @F.pandas_udf(StringType())
    def run(s):
        def clean(v):
            if isinstance(v, dict):
                return {k: clean(x) for k, x in v.items() if k not in drop and not (prefix and k.startswith(prefix))}
            return [clean(x) for x in v] if isinstance(v, list) else v

        def one(x):
            try:
                return None if x is None else json.dumps(clean(json.loads(x)), sort_keys=True, separators=(",", ":"))
            except ValueError:
                return None

        return s.map(one)

    return run(c)


def stable_hash(df: DataFrame) -> DataFrame:
    """df with `stable_hash`, the sha256 of the row's JSON with columns in the order of their names."""
    row = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    return df.withColumn("stable_hash", F.sha2(row, 256))


def sealed(df: DataFrame, key: str, operators: str, dependencies: str) -> DataFrame:
    """(key, sid, complexity): the hash of the chain of operators, and one and a half per dependency."""
    n = F.greatest(F.coalesce(F.size(dependencies), F.lit(0)), F.lit(0))
    return df.select(key, F.sha2(F.array_join(F.coalesce(operators, F.array().cast("array<string>")), "->"), 256).alias("sid"), (1.5 * n).alias("complexity"))


def bundle_hash(df: DataFrame, path: str, content: str) -> DataFrame:
    """(files, digest): sixteen digits over the sorted digests of all files, in 256 parts, so no list holds them all."""
    h = df.select(F.sha2(F.concat_ws("\u0001", path, content), 256).alias("h"))
    parts = h.groupBy(F.substring("h", 1, 2).alias("p")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("d"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.substring(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), ""), 256), 1, 16).alias("digest"))


def write_bundle(df: DataFrame, path: str, content: str, to: str) -> None:
    """Files as text with a line of their path before each, in the order of their paths."""
    df.select(F.col(path).alias("_p"), F.concat(F.lit("### FILE: "), path, F.lit("\n"), F.coalesce(content, F.lit(""))).alias("value")).orderBy("_p").select("value").write.mode("overwrite").text(to)


def write_dossier(df: DataFrame, reason: str, to: str) -> None:
    """Validated and rejected records as two YAML lists (each item a JSON object, which is YAML), written by the tasks."""
    for kind, cond in (("validated", F.col(reason).isNull()), ("rejected", F.col(reason).isNotNull())):
        df.where(cond).select(F.concat(F.lit("- "), F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))).alias("value")).write.mode("overwrite").text(f"{to}/{kind}_nodes.yaml")


def write_json_atomically(spark: SparkSession, value: dict, to: str) -> None:
    """A small JSON file that is there whole or not at all: written beside, then renamed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, beside = jvm.org.apache.hadoop.fs.Path(to), jvm.org.apache.hadoop.fs.Path(to + ".tmp")
    fs = target.getFileSystem(conf)
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(value, sort_keys=True, indent=1, default=str).encode()))
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    fs.rename(beside, target)


def run_manifest(steps: dict[str, bool], outputs: dict[str, tuple[int, str]]) -> dict:
    """A run's steps and its outputs (rows, digest), with whether all went well and a digest over them."""
    body = {"steps": steps, "outputs": {k: {"rows": n, "sha256": d} for k, (n, d) in outputs.items()}}
    return body | {"passed": all(steps.values()), "digest": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()}


def file_manifest(files: DataFrame) -> DataFrame:
    """(path, size, sha256, empty) of files (path, content)."""
    return files.select("path", F.length("content").alias("size"), F.sha2("content", 256).alias("sha256"), (F.length("content") == 0).alias("empty"))


def write_telemetry(events: DataFrame, summary: DataFrame, to: str) -> None:
    """Events as JSON lines, and after them the rows of their summary, told apart by `kind`."""
    events.withColumn("kind", F.lit("event")).unionByName(summary.withColumn("kind", F.lit("summary")), allowMissingColumns=True).write.mode("overwrite").json(to)


def report(df: DataFrame, group: str, key: str, text: str, each: int = 3) -> str:
    """Markdown with a few rows of every group, drawn by the hash of their key; fences are longer than any in the text.

    A report is small by its nature: `each` rows of a group reach the driver.
    """
    h = F.md5(F.col(key).cast("string"))
    rows = df.groupBy(group).agg(F.slice(F.sort_array(F.collect_set(F.when(h < _cut(df, group, each), F.struct(h.alias("h"), F.col(key).cast("string").alias("k"), F.col(text).alias("t"))))), 1, each).alias("r")).orderBy(group).collect()
    out = ["# Samples"]
    for r in rows:
        out.append(f"\n## {r[group] if r[group] is not None else '(none)'}")
        for x in r["r"]:
            t = x["t"] or ""
            fence = "```"
            while fence in t:
                fence += "`"
            out.append(f"\n**{x['k']}**\n\n{fence}\n{t}\n{fence}")
    return "\n".join(out) + "\n"


def _cut(df: DataFrame, group: str, each: int) -> Column:
    """A hash under which every group has enough rows, and a large one not many more: from the size of the smallest."""
    least = df.groupBy(group).count().agg(F.min("count")).first()[0] or 1
    part = min(1.0, 20.0 * each / least)
    return F.lit("g" if part >= 1 else f"{int(part * 0xFFFFFFFF):08x}")


def artifact_contract(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """(lines, broken, passed): whether a JSON-lines file has enough lines, each of them JSON."""
    t = spark.read.text(path).where(F.trim("value") != "")
    return t.agg(F.count("*").alias("lines"), F.count_if(F.try_parse_json("value").isNull()).alias("broken")).select("lines", "broken", ((F.col("broken") == 0) & (F.col("lines") >= least)).alias("passed"))
