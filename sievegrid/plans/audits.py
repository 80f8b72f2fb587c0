"""Queries that audit: penalties, chat structure, corpus metrics, pruned branches, trends, enforcement, weighted vectors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import gates as G
from ..functions import scoring as S
from ..functions import text as T
from ..functions import vector as V
from ..operators import records
from ..sources.tables import load
from ..streaming import telemetry
from .registry import query
from .texts import _DENSITY

# Calls that reach outside.
UNSAFE = "\\b(?:eval|exec|os\\.system|subprocess\\.(?:call|run|Popen)|pickle\\.loads?|__import__)\\s*\\("


def _pen(c: str, factor: str, cond: str) -> str:
    return f"CASE WHEN {cond} THEN CASE WHEN {c} > 0.2e0 THEN greatest({c} * {factor}, 0.2e0) ELSE {c} * {factor} END ELSE {c} END"


_STEPS = "a AS (SELECT *, " + _pen("c", "0.7e0", "unsafe") + " AS c1 FROM s), b AS (SELECT *, " + _pen("c1", "0.4e0", "flattery") + " AS c2 FROM a), z AS (SELECT *, " + _pen("c2", "0.7e0", "thin") + " AS c3 FROM b)"


@query(f"WITH n AS (SELECT DISTINCT node_id, coalesce(epistemic.c_node, 0.0e0) AS c, coalesce(code_snippet, '') AS code, source_context AS t FROM aletheia_skill), s AS (SELECT node_id, c, regexp_matches(code, '{UNSAFE}') AS unsafe, coalesce(regexp_matches(lower(t), 'as an ai|you are absolutely right|i completely agree|you''re correct'), false) AS flattery, coalesce({_DENSITY}, 0) < 0.1e0 AS thin FROM n), {_STEPS} SELECT node_id, unsafe, flattery, thin, floor(c3 * 10000 + 0.5) / 10000 AS c_final FROM z")
def audited_scores(spark, d):
    """Confidence after the penalties for calls that reach outside, flattery and thin text, none of which takes it under the floor."""
    s = records.once(load(spark, d, "aletheia_skill").select("node_id", F.coalesce("epistemic.c_node", F.lit(0.0)).alias("c"), F.coalesce("code_snippet", F.lit("")).alias("code"), F.col("source_context").alias("t")), "node_id")
    s = s.select("node_id", "c", F.col("code").rlike(UNSAFE).alias("unsafe"), F.coalesce(T.any_of(F.lower("t"), T.SYCOPHANCY), F.lit(False)).alias("flattery"), (F.coalesce(G.prose_density(F.col("t")), F.lit(0.0)) < 0.1).alias("thin"))
    for flag, factor in (("unsafe", S.PENALTY["unsafe"]), ("flattery", S.PENALTY["flattery"]), ("thin", 0.7)):
        s = s.withColumn("c", F.when(F.col(flag), S.penalised(F.col("c"), F.lit(factor))).otherwise(F.col("c")))
    return s.select("node_id", "unsafe", "flattery", "thin", S.r4(F.col("c")).alias("c_final"))


_INK = "regexp_matches(coalesce(m.content, ''), '[^ \\t\\n\\r\\f]')"


@query(f"WITH c AS (SELECT DISTINCT chat_id, schema_version, messages FROM chatml), r AS (SELECT *, array_to_string(list_transform(messages, lambda m: m.role), '>') AS roles FROM c) SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN messages IS NULL OR len(messages) = 0 THEN 'no_messages' WHEN len(list_filter(messages, lambda m: NOT {_INK})) > 0 THEN 'empty_content' WHEN roles = 'system>user>assistant' THEN 'ok' WHEN roles = 'user>assistant' THEN CASE WHEN schema_version IS NULL THEN 'ok_legacy' ELSE 'missing_system' END ELSE 'role_sequence' END AS verdict FROM r) GROUP BY verdict")
def chat_structure(spark, d):
    """Chats by whether they are of the three turns that training takes; two are allowed where no schema is named."""
    m = records.once(load(spark, d, "chatml").select("chat_id", "schema_version", "messages"), "chat_id")
    roles = F.array_join(F.transform("messages", lambda x: x["role"]), ">")
    blank = F.exists("messages", lambda x: ~F.coalesce(x["content"], F.lit("")).rlike("[^ \\t\\n\\r\\f]"))
    v = F.when(F.col("messages").isNull() | (F.size("messages") == 0), "no_messages").when(blank, "empty_content").when(roles == "system>user>assistant", "ok").when(roles == "user>assistant", F.when(F.col("schema_version").isNull(), "ok_legacy").otherwise("missing_system")).otherwise("role_sequence")
    return m.groupBy(v.alias("verdict")).agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT DISTINCT chat_id, _mode, schema_version, branch_count, messages FROM chatml), s AS (SELECT *, list_filter(messages, lambda m: m.role = 'assistant')[1].content AS a, list_filter(messages, lambda m: m.role = 'user')[1].content AS q FROM c), k AS (SELECT *, md5(trim(regexp_replace(lower(coalesce(q, '')), '[^a-z0-9]+', ' ', 'g'))) AS key FROM s), e AS (SELECT *, ('0x' || substr(md5(key), 1, 8))::BIGINT % 100 < 10 AS held FROM k) SELECT count(*) AS chats, count(*) FILTER (schema_version IN ('2.0', '2.1')) AS v2, round(avg(coalesce(contains(a, '<think>'), false)::INT), 4) AS think_coverage, count(*) FILTER (coalesce(branch_count, 0) <= 1) AS abstentions, count(*) FILTER (held) AS held_out, (SELECT count(*) FROM (SELECT DISTINCT key FROM e WHERE held) x SEMI JOIN (SELECT DISTINCT key FROM e WHERE NOT held) y USING (key)) AS overlap, count(*) FILTER (regexp_matches(coalesce(a, ''), '(?i)evidence refs?[ \\t]*:[ \\t]*(none|\\[[ \\t]*\\])')) AS bare_evidence FROM e")
def corpus_metrics(spark, d):
    """The corpus in one row: schemas, think blocks, abstentions, and whether a question stands on both sides of the split."""
    m = records.once(load(spark, d, "chatml").select("chat_id", "schema_version", "branch_count", "messages"), "chat_id")
    first = lambda role: F.get(F.filter("messages", lambda x: x["role"] == role), F.lit(0))["content"]
    e = m.select("schema_version", F.coalesce("branch_count", F.lit(0)).alias("b"), first("assistant").alias("a"), F.md5(T.normal_key(F.coalesce(first("user"), F.lit("")))).alias("key"))
    e = e.withColumn("held", F.conv(F.substring(F.md5("key"), 1, 8), 16, 10).cast("bigint") % 100 < 10)
    both = e.groupBy("key").agg(F.bool_or("held").alias("h"), F.bool_and("held").alias("only")).where("h and not only").agg(F.count("*").alias("overlap"))
    r = e.agg(F.count("*").alias("chats"), F.count_if(F.col("schema_version").isin("2.0", "2.1")).alias("v2"), F.round(F.avg(F.coalesce(F.col("a").contains("<think>"), F.lit(False)).cast("int")), 4).alias("think_coverage"), F.count_if(F.col("b") <= 1).alias("abstentions"), F.count_if("held").alias("held_out"), F.count_if(F.coalesce("a", F.lit("")).rlike("(?i)evidence refs?[ \\t]*:[ \\t]*(none|\\[[ \\t]*\\])")).alias("bare_evidence"))
    return r.join(both)


@query("WITH s AS (SELECT DISTINCT node_id, epistemic.branch_id AS branch, epistemic.c_node AS c FROM aletheia_skill), m AS (SELECT branch, max(c) AS best FROM s GROUP BY branch) SELECT s.node_id FROM s LEFT JOIN m USING (branch) WHERE coalesce(branch, 'root') = 'root' OR coalesce(best, 0) >= 0.35e0")
def kept_branches(spark, d):
    """Nodes that are left when branches without a confident node are cut off; the root stays."""
    s = records.once(load(spark, d, "aletheia_skill").select("node_id", F.col("epistemic.branch_id").alias("branch"), F.col("epistemic.c_node").alias("c")), "node_id")
    m = s.groupBy("branch").agg(F.max("c").alias("best"))
    return s.join(m, "branch", "left").where((F.coalesce("branch", F.lit("root")) == "root") | (F.coalesce("best", F.lit(0.0)) >= S.PRUNE)).select("node_id")


@query("WITH e AS (SELECT user_id, CAST(round(value * 100) AS BIGINT) AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events), k AS (SELECT *, least(n, 10) AS m FROM e WHERE r <= 10) SELECT user_id, (coalesce(sum(c) FILTER (r <= 3), 0) - coalesce(sum(c) FILTER (r > m - 3), 0))::BIGINT AS trend FROM k GROUP BY user_id")
def reward_trend(spark, d):
    """The sum of a user's last three values, in hundredths, less that of the first three of the last ten."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = load(spark, d, "events").select("user_id", F.round(F.col("value") * 100).cast("bigint").alias("c"), F.row_number().over(w).alias("r")).where("r <= 10")
    n = e.groupBy("user_id").agg(F.max("r").alias("m"))
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0))
    return e.join(n, "user_id").groupBy("user_id").agg((part(F.col("r") <= 3) - part(F.col("r") > F.col("m") - 3)).alias("trend"))


@query("WITH b AS (SELECT user_id, coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER (round(value * 100) >= 5000), 0) / 500000.0e0 AS drift FROM events GROUP BY user_id) SELECT e.event_type, CASE WHEN b.drift > 0.3e0 THEN 'reject' WHEN b.drift > 0.15e0 THEN 'reroll' ELSE 'pass' END AS action, count(*) AS n FROM events e JOIN b USING (user_id) GROUP BY ALL")
def identity_enforcement(spark, d):
    """What becomes of events of identities that have drifted too far."""
    e = load(spark, d, "events").select("user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("c"))
    b = e.groupBy("user_id").agg((F.coalesce(F.sum(F.when(F.col("c") >= 5000, F.col("c"))), F.lit(0)) / 500000.0).alias("drift"))
    action = F.when(F.col("drift") > 0.3, "reject").when(F.col("drift") > 0.15, "reroll").otherwise("pass")
    return e.join(b, "user_id").groupBy("event_type", action.alias("action")).agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) FILTER (round(value * 100) >= 5000) AS breaches, coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER (round(value * 100) >= 5000), 0)::BIGINT AS cents FROM events GROUP BY user_id")
def stream_drift(spark, d):
    """Breaches and what they add up to per user, kept as a stream's state."""
    c = F.round(F.col("value") * 100).cast("bigint")
    s = telemetry.stream(spark, d, "events.parquet").select("user_id", c.alias("c"))
    return telemetry.drain(s.groupBy("user_id").agg(F.count_if(F.col("c") >= 5000).alias("breaches"), F.coalesce(F.sum(F.when(F.col("c") >= 5000, F.col("c"))), F.lit(0)).alias("cents")), "drift", "complete")


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(embedding) >= 8), w AS (SELECT vec_id, list_concat(list_transform(v[1:4], lambda x: x * 0.5e0), list_transform(v[5:8], lambda x: x * 1.0e0)) AS w, v[1:8] AS u FROM e) SELECT vec_id, floor((1.0e0 - greatest(0.0e0, least(1.0e0, list_dot_product(w, u) / (greatest(0.15e0, sqrt(list_dot_product(w, w))) * greatest(0.15e0, sqrt(list_dot_product(u, u))))))) * 1000 + 0.5) / 1000 AS drift FROM w")
def temporal_drift(spark, d):
    """Drift of a matrix of two rows whose older one weighs half from the same with equal rows; three digits."""
    e = load(spark, d, "embeddings").where("size(embedding) >= 8").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = F.array(F.slice("v", 1, 4), F.slice("v", 5, 4))
    return e.select("vec_id", (F.floor((1.0 - S.floored_cosine(V.temporal_weights(rows), F.slice("v", 1, 8))) * 1000 + 0.5) / 1000).alias("drift"))
