"""The pN_ queries over the tables of a folder, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load
from . import credentials, encoding, generated, neardup, packing, pairs, scanned, sourcecheck, toxicity

CAPACITY = 2048


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_texts(load(spark, d, "documents"), "doc_id", "text")


def p9_sequences(spark: SparkSession, d: str) -> DataFrame:
    sizes = encoding.count_tokens(load(spark, d, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and fill of the packing, and of the length buckets for comparison."""
    seq = p9_sequences(spark, d)
    hist = {r["rest"]: r["c"] for r in seq.groupBy((F.col("n_tokens") % CAPACITY).alias("rest")).agg(F.count("*").alias("c")).collect()}
    full = seq.agg(F.sum(F.floor(F.col("n_tokens") / CAPACITY))).first()[0] or 0
    _, bins = packing.pack_histogram(hist, CAPACITY)
    bounds, buckets = packing.length_buckets(hist, CAPACITY)
    tokens = sum(k * v for k, v in hist.items()) + full * CAPACITY
    rows = [("best_fit", bins + full, tokens, tokens / max(1, (bins + full) * CAPACITY)), ("length_buckets", buckets["containers"] + full, tokens, tokens / max(1, (buckets["containers"] + full) * CAPACITY))]
    return spark.createDataFrame(rows, "method string, containers bigint, tokens bigint, fill double")


def p4_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = encoding.budget_input(*(load(spark, d, t) for t in ("chatml", "documents", "score_request")))
    return encoding.with_domain(encoding.token_budget(rows, ["tbl", "source", "lang", "mode"], "text"), load(spark, d, "project"))


def p4_documents(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each document and each chat."""
    return encoding.record_tokens(load(spark, d, "chatml"), load(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    membership, links = neardup.near_duplicates(load(spark, d, "aletheia_skill"), "node_id", {"code_snippet": neardup.CODE_BANDS, "source_context": neardup.PROSE_BANDS})
    return neardup.expand(membership, links).select(F.col("id_a").alias("node_id_a"), F.col("id_b").alias("node_id_b"), "field")


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    membership, links = neardup.near_duplicates(load(spark, d, "aletheia_skill"), "node_id", {"code_snippet": neardup.CODE_BANDS, "source_context": neardup.PROSE_BANDS})
    return neardup.groups(membership, links).withColumnRenamed("id", "node_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    checked = sourcecheck.syntax_errors(load(spark, d, "aletheia_skill"), "node_id", "file", "code_snippet")
    return checked.where(F.size("errors") > 0).select("node_id").distinct()


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    checked = sourcecheck.syntax_errors(load(spark, d, "aletheia_skill"), "node_id", "file", "code_snippet", ["project_name"])
    once = checked.groupBy("node_id", "project_name", "language").agg(F.first("errors").alias("errors"))
    return sourcecheck.acceptance(once, ["project_name", "language"])


def p3_errors(spark: SparkSession, d: str) -> DataFrame:
    checked = sourcecheck.syntax_errors(load(spark, d, "aletheia_skill"), "node_id", "file", "code_snippet")
    return checked.where(F.size("errors") > 0).dropDuplicates(["node_id"])


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.score(load(spark, d, "documents"), load(spark, d, "labels")).where("harmful").select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.score(load(spark, d, "documents"), load(spark, d, "labels"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    source = docs.select("doc_id", encoding.normal_source(F.col("source")).alias("source"))
    return p10_scores(spark, d).join(source, "doc_id").groupBy("source").agg(F.count("*").alias("documents"), F.count_if("harmful").alias("harmful"), F.round(F.avg(F.col("harmful").cast("int")), 6).alias("rate"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    got = credentials.scan(load(spark, d, "aletheia_skill"), "node_id", "file", "code_snippet")
    return got.select("node_id", F.explode("found.line_no").alias("line_no")).distinct()


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """node_id and the redacted snippet of every node, once."""
    got = credentials.scan(load(spark, d, "aletheia_skill"), "node_id", "file", "code_snippet")
    return got.groupBy("node_id").agg(F.first("redacted").alias("redacted"), F.max(F.size("found")).alias("credentials"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_classes(spark, d).where(F.size("classes") > 0).select("node_id")


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    return generated.classify(load(spark, d, "aletheia_skill"), "node_id", "file", "code_snippet", "project_name")


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return p6_classes(spark, d).groupBy("repository").agg(F.count("*").alias("files"), F.count_if(F.size("classes") == 0).alias("hand_written"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    texts = scanned.texts_of(load(spark, d, "advocate_payload"), load(spark, d, "aletheia_skill"))
    return scanned.analyse(texts)[1]


def p5_text(spark: SparkSession, d: str) -> DataFrame:
    texts = scanned.texts_of(load(spark, d, "advocate_payload"), load(spark, d, "aletheia_skill"))
    return scanned.repaired(texts, *scanned.analyse(texts))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(pairs.pairs_of(load(spark, d, "chatml"), load(spark, d, "payload")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_redacted": p2_redacted, "p3_found": p3_found, "p3_rates": p3_rates, "p3_errors": p3_errors, "p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates, "p4_tokens": p4_tokens, "p4_documents": p4_documents, "p5_found": p5_found, "p5_text": p5_text, "p6_found": p6_found, "p6_classes": p6_classes, "p6_rates": p6_rates, "p7_found": p7_found, "p7_groups": p7_groups, "p8_ids": p8_ids, "p9_sequences": p9_sequences, "p9_fill": p9_fill}


#: All pairs by brute force over the words' occurrences.
_PAIRS_SQL = """
WITH t AS (SELECT DISTINCT node_id, 'code_snippet' AS field, code_snippet AS x FROM aletheia_skill UNION ALL SELECT DISTINCT node_id, 'source_context', source_context FROM aletheia_skill),
w AS (SELECT node_id, field, lower(unnest(regexp_extract_all(x, '[A-Za-z0-9_]+'))) AS w FROM t),
n AS (SELECT node_id, field, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 20),
e AS (SELECT node_id, field, w, row_number() OVER (PARTITION BY node_id, field, w) AS k FROM w SEMI JOIN n USING (node_id, field)),
c AS (SELECT a.node_id AS node_id_a, b.node_id AS node_id_b, field, count(*) AS c FROM e a JOIN e b USING (field, w, k) WHERE a.node_id < b.node_id GROUP BY ALL)
SELECT node_id_a, node_id_b, field FROM c JOIN n x ON x.node_id = node_id_a AND x.field = c.field JOIN n y ON y.node_id = node_id_b AND y.field = c.field WHERE 2 * c.c >= 0.8 * (x.n + y.n)
"""


def oracle_sql() -> dict[str, str]:
    return {"p7_found": _PAIRS_SQL.replace("SELECT node_id_a, node_id_b, field FROM c", "SELECT node_id_a, node_id_b, c.field FROM c")}
