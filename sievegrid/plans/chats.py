"""Queries that make training rows: routed chats, strict chats, flashcards, failures, and the summaries of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gates as G
from ..functions import text as T
from ..operators import formats, records
from ..sources.tables import load
from .registry import query

_USER = "CASE WHEN tb IS NOT NULL AND df IS NOT NULL THEN 'veteran' WHEN th IS NOT NULL AND im IS NOT NULL THEN 'advocate' WHEN cd IS NOT NULL AND nm IS NOT NULL THEN 'coding_assistant' WHEN ch IS NOT NULL THEN 'theorist' END"


@query("WITH p AS (SELECT 'payload:' || payload_id AS id, theory_text AS th, implementation_code AS im, NULL AS nm, NULL AS cd, NULL AS ch FROM (SELECT DISTINCT payload_id, theory_text, implementation_code FROM advocate_payload) UNION ALL SELECT 'node:' || node_id, NULL, NULL, name, code_snippet, NULL FROM (SELECT DISTINCT node_id, name, code_snippet FROM aletheia_skill) UNION ALL SELECT 'request:' || request_id || ':' || i, NULL, NULL, NULL, NULL, payloads[i + 1].chunk_text FROM (SELECT request_id, payloads, unnest(range(len(payloads))) AS i FROM (SELECT DISTINCT request_id, payloads FROM score_request))) SELECT id, CASE WHEN th IS NOT NULL AND im IS NOT NULL THEN 'advocate' WHEN cd IS NOT NULL AND nm IS NOT NULL THEN 'coding_assistant' WHEN ch IS NOT NULL THEN 'theorist' END AS mode, CASE WHEN th IS NOT NULL AND im IS NOT NULL THEN md5('Please provide the architectural reasoning and the implementation code for this component.' || chr(1) || '### Architectural Theory' || chr(10) || th || chr(10) || chr(10) || '### Implementation Code' || chr(10) || '```python' || chr(10) || im || chr(10) || '```') WHEN cd IS NOT NULL AND nm IS NOT NULL THEN md5('Implement the function `' || nm || '`.' || chr(1) || '```python' || chr(10) || cd || chr(10) || '```') WHEN ch IS NOT NULL THEN md5('Please provide the theoretical context.' || chr(1) || ch) END AS digest FROM p")
def routed_chats(spark, d):
    """Payloads of all kinds as chats of two turns, routed by what they hold; null where nothing fits."""
    none = F.lit(None).cast("string")
    parts = {"traceback": none, "diff": none, "attempt": none, "analysis": none, "resolved": none, "theory": none, "implementation": none, "name": none, "code": none, "chunk": none}

    def rows(df, id_, **has):
        return df.select(id_.alias("id"), *[has.get(k, v).alias(k) for k, v in parts.items()])

    a = records.once(load(spark, d, "advocate_payload").select("payload_id", "theory_text", "implementation_code"), "payload_id")
    n = records.once(load(spark, d, "aletheia_skill").select("node_id", "name", "code_snippet"), "node_id")
    q = records.once(load(spark, d, "score_request").select("request_id", "payloads"), "request_id").select("request_id", F.posexplode("payloads").alias("i", "p"))
    u = rows(a, F.concat(F.lit("payload:"), F.col("payload_id").cast("string")), theory=F.col("theory_text"), implementation=F.col("implementation_code"))
    u = u.unionByName(rows(n, F.concat(F.lit("node:"), "node_id"), name=F.col("name"), code=F.col("code_snippet")))
    u = u.unionByName(rows(q, F.concat(F.lit("request:"), F.col("request_id").cast("string"), F.lit(":"), F.col("i").cast("string")), chunk=F.col("p.chunk_text")))
    r = u.select("id", formats.route({k: F.col(k) for k in parts}).alias("r"))
    return r.select("id", F.col("r.mode").alias("mode"), F.md5(F.array_join(F.transform("r.messages", lambda m: m["content"]), "\u0001")).alias("digest"))


def _strip(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')"


SYSTEM = "Answer from the given context only, briefly and in a fixed form."


@query(f"WITH p AS (SELECT DISTINCT payload_id, node_id, instruction, input, output FROM payload), c AS (SELECT node_id, max(code_snippet) AS code FROM aletheia_skill GROUP BY node_id), t AS (SELECT payload_id, {_strip('instruction')} AS i, {_strip('input')} AS x, {_strip('output')} AS o, {_strip('code')} AS k FROM p LEFT JOIN c USING (node_id)), j AS (SELECT payload_id, i, x, CASE WHEN o IN ('', 'Generated_via_Procedural_Mapping', 'generated_via_procedural_mapping') THEN CASE WHEN k <> '' THEN '```python' || chr(10) || k || chr(10) || '```' ELSE '' END ELSE o END AS o FROM t) SELECT payload_id, md5(concat_ws(chr(1), '{SYSTEM}', CASE WHEN x = '' THEN i ELSE i || chr(10) || chr(10) || 'Context:' || chr(10) || x END, o)) AS digest FROM j WHERE i <> '' AND o <> ''")
def strict_chats(spark, d):
    """Knowledge rows as chats of three turns; an output that is only a placeholder gives way to the node's code."""
    p = records.once(load(spark, d, "payload").select("payload_id", "node_id", "instruction", "input", "output"), "payload_id")
    code = load(spark, d, "aletheia_skill").groupBy("node_id").agg(F.max("code_snippet").alias("code"))
    j = p.join(code, "node_id", "left")
    m = formats.strict(SYSTEM, F.col("instruction"), F.col("input"), F.col("output"), F.col("code"))
    return j.select("payload_id", m.alias("m")).where("m is not null").select("payload_id", F.md5(F.array_join(F.transform("m", lambda x: x["content"]), "\u0001")).alias("digest"))


_JSON_IDS = "'[' || coalesce(array_to_string(list_transform({}, lambda x: '\"' || x || '\"'), ','), '') || ']'"
_INTENT = "teaching_layer.reasoning_vectors.intent"
_CARD = f"WITH s AS (SELECT DISTINCT node_id, coalesce(teaching_layer.skill_identity['category'], 'unknown') AS cat, coalesce(teaching_layer.skill_identity['canonical_id'], 'UNKNOWN') AS cid, operator_type AS op, coalesce(epistemic.c_node, 0) AS c, {_INTENT} AS intent, dependencies.downstream_calls AS down, dependencies.upstream_callers AS up, code_snippet AS code FROM aletheia_skill), k AS (SELECT node_id, op, down, up, code, CASE WHEN intent <> '' THEN 'Synthesize an optimized execution method for' ELSE 'Extract and formalize the structural execution pattern for' END || ' Category: ' || cat || ' | Canonical ID: ' || cid || ' | Pipeline Signature: ' || coalesce(op, '') || ' | System Prior Confidence: ' || printf('%.3f', floor(c * 1000 + 0.5) / 1000) AS instruction, '{{\"constraints\":{{\"heuristic_conditions\":{{}},\"mutation_tracking\":[],\"operator_types\":[' || CASE WHEN op IS NULL THEN '' ELSE '\"' || op || '\"' END || ']}},\"graph\":{{\"downstream_calls\":' || {_JSON_IDS.format('down')} || ',\"upstream_callers\":' || {_JSON_IDS.format('list_sort(up)')} || '}}}}' AS input FROM s)"


@query(f"{_CARD} SELECT node_id, md5(instruction || chr(1) || input) AS digest, CASE WHEN coalesce(len(down), 0) + coalesce(len(up), 0) > 50 THEN 'graph_complexity_exceeded' WHEN op IS NULL THEN 'zero_density_ast' WHEN regexp_matches(code, '\\{{[a-z_]+\\}}') THEN 'template_code_placeholder' ELSE 'accepted' END AS verdict FROM k")
def flashcards(spark, d):
    """Instruction cards of the nodes, and what the strict filter says of them."""
    s = records.once(load(spark, d, "aletheia_skill").select("node_id", "teaching_layer", "operator_type", "epistemic", "dependencies", "code_snippet"), "node_id")
    tl, dep = F.col("teaching_layer"), F.col("dependencies")
    card = formats.flashcard(tl["skill_identity"]["category"], tl["skill_identity"]["canonical_id"], F.when(F.col("operator_type").isNotNull(), F.array("operator_type")), F.col("epistemic.c_node"), tl["reasoning_vectors"]["intent"], dep["downstream_calls"], dep["upstream_callers"], F.col("code_snippet"))
    c = s.select("node_id", card.alias("c"), dep["downstream_calls"].alias("down"), dep["upstream_callers"].alias("up"), F.when(F.col("operator_type").isNotNull(), F.array("operator_type")).alias("ops"), "code_snippet")
    return c.select("node_id", F.md5(F.concat("c.instruction", F.lit("\u0001"), "c.input")).alias("digest"), formats.card_verdict(F.col("c.input"), F.col("c.output"), F.col("down"), F.col("up"), F.col("ops"), F.col("code_snippet")).alias("verdict"))


_ORCH = "depth_limit|below_instability_band|omega_orphan_state|topological_cycle_break|cycle_quarantine_emptied_graph|parent_chain_failed|cascade_rejection"


@query(f"WITH l AS (SELECT DISTINCT ledger_id, node_id, to_state, lower(trim(coalesce(trigger_name, ''))) AS t, lower(trim(coalesce(reason, ''))) AS r FROM ledger WHERE to_state = 'REJECTED') SELECT ledger_id, regexp_matches(t, '{_ORCH}') OR regexp_matches(r, '{_ORCH}') OR starts_with(r, 'cascade_from_') AS internal, md5('{{\"failure_type\":\"' || t || '\",\"node_id\":\"' || node_id || '\",\"rejection_reason\":\"' || CASE WHEN r = '' THEN 'unknown_rejection' ELSE r END || '\"}}') AS digest FROM l")
def failure_chats(spark, d):
    """Rejections as the user's turn of a diagnostic chat, and whether they say nothing but how the pipeline works."""
    l = load(spark, d, "ledger").where("to_state = 'REJECTED'").select("ledger_id", "node_id", F.lower(F.trim(F.coalesce("trigger_name", F.lit("")))).alias("t"), F.lower(F.trim(F.coalesce("reason", F.lit("")))).alias("r")).distinct()
    content = F.to_json(F.struct(F.col("t").alias("failure_type"), "node_id", F.when(F.col("r") == "", "unknown_rejection").otherwise(F.col("r")).alias("rejection_reason")))
    return l.select("ledger_id", formats.internal_failure(F.col("t"), F.col("r")).alias("internal"), F.md5(content).alias("digest"))


@query("WITH s AS (SELECT DISTINCT node_id, file, epistemic.state AS state, epistemic.c_node AS c FROM aletheia_skill) SELECT node_id, md5('{\"_failure_type\":\"state\",\"_rejection_reason\":\"' || state || '\",\"node_id\":\"' || node_id || '\"}') AS digest FROM s WHERE state IN ('REJECTED', 'low', 'unresolved')")
def compact_rejections(spark, d):
    """The least that a rejected node leaves behind, as canonical JSON."""
    s = records.once(load(spark, d, "aletheia_skill").select("node_id", F.col("epistemic.state").alias("state")), "node_id").where(F.col("state").isin("REJECTED", "low", "unresolved"))
    return s.select("node_id", F.md5(F.to_json(F.struct(F.lit("state").alias("_failure_type"), F.col("state").alias("_rejection_reason"), "node_id"))).alias("digest"))


@query("WITH c AS (SELECT DISTINCT chat_id, _mode FROM chatml), n AS (SELECT coalesce(_mode, 'none') AS typology, count(*) AS n FROM c GROUP BY 1), t AS (SELECT sum(n) AS s, max(n) AS m, count(*) AS k FROM n) SELECT typology, n, round(n / s, 6) AS share, round(m / s, 6) AS dominant, s <= 10 OR k >= 2 AND m * 100 <= 85 * s AS passed FROM n, t")
def typology_dominance(spark, d):
    """How many chats are of each kind, and whether one kind dominates."""
    n = records.once(load(spark, d, "chatml").select("chat_id", "_mode"), "chat_id").groupBy(F.coalesce("_mode", F.lit("none")).alias("typology")).agg(F.count("*").alias("n"))
    t = n.agg(F.sum("n").alias("s"), F.max("n").alias("m"), F.count("*").alias("k"))
    return n.join(t).select("typology", "n", F.round(F.col("n") / F.col("s"), 6).alias("share"), F.round(F.col("m") / F.col("s"), 6).alias("dominant"), ((F.col("s") <= 10) | (F.col("k") >= 2) & (F.col("m") * 100 <= 85 * F.col("s"))).alias("passed"))


_PICK = "least(greatest(CAST(floor(n * {}) AS BIGINT) - 1, 0), n - 1)"


@query(f"WITH c AS (SELECT DISTINCT chat_id, schema_version, branch_count, messages FROM chatml), s AS (SELECT coalesce(schema_version, '1.0') AS schema_version, coalesce(branch_count, 0) AS b, contains(list_filter(messages, lambda m: m.role = 'assistant')[1].content, '<think>') AS think FROM c), a AS (SELECT schema_version, count(*) AS n, round(avg(coalesce(think, false)::INT), 4) AS think_coverage, list_sort(list(b)) AS l FROM s GROUP BY schema_version) SELECT schema_version, n, think_coverage, l[{_PICK.format('0.1')} + 1] AS branch_p10, l[{_PICK.format('0.5')} + 1] AS branch_p50 FROM a")
def branch_summary(spark, d):
    """Rows, think blocks and branch counts of each schema; the percentiles are picked from a histogram, not from a list."""
    m = records.once(load(spark, d, "chatml").select("chat_id", "schema_version", "branch_count", "messages"), "chat_id")
    think = F.coalesce(F.get(F.filter("messages", lambda x: x["role"] == "assistant"), F.lit(0))["content"].contains("<think>"), F.lit(False))
    s = m.select(F.coalesce("schema_version", F.lit("1.0")).alias("schema_version"), F.coalesce("branch_count", F.lit(0)).alias("b"), think.alias("think"))
    return records.picked(s, "schema_version", "b", {"branch_p10": 0.1, "branch_p50": 0.5}).join(s.groupBy("schema_version").agg(F.count("*").alias("n"), F.round(F.avg(F.col("think").cast("int")), 4).alias("think_coverage")), "schema_version").select("schema_version", "n", "think_coverage", "branch_p10", "branch_p50")


_NK = "trim(regexp_replace(regexp_replace(lower(trim(coalesce(text, ''))), '[^\\p{L}\\p{N}_ \\t\\n\\r\\f-]', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'), '- ')"


@query("WITH t AS (SELECT DISTINCT text FROM documents WHERE text <> ''), bad AS (SELECT DISTINCT d.text FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1 OR l.quality <= 2), short AS (SELECT text FROM documents WHERE length(text) < 40) SELECT count(*) AS kept, count(DISTINCT md5(text)) AS digests FROM (SELECT text FROM t EXCEPT SELECT text FROM bad EXCEPT SELECT text FROM short)")
def kept_texts(spark, d):
    """Texts without those marked down and those too short."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    bad = load(spark, d, "labels").where("toxic = 1 or quality <= 2").select("doc_id").distinct().join(docs, "doc_id").select("text")
    h = docs.where("text <> ''").select(F.md5("text").alias("h"), F.length("text").alias("n")).distinct().where("n >= 40")
    return h.join(bad.select(F.md5("text").alias("h")), "h", "left_anti").agg(F.count("*").alias("kept"), F.count_distinct("h").alias("digests"))


@query("WITH u AS (SELECT 'chat' AS kind, _mode AS mode, lang FROM (SELECT DISTINCT chat_id, _mode, lang FROM chatml) UNION ALL SELECT 'payload', NULL, lang FROM (SELECT DISTINCT payload_id, lang FROM payload) UNION ALL SELECT 'document', mode, lang FROM documents) SELECT kind, count(*) AS n, count(mode) AS with_mode, count(DISTINCT lang) AS langs FROM u GROUP BY kind")
def merged_records(spark, d):
    """Records of all kinds in one table; columns that a kind lacks are null."""
    a = records.once(load(spark, d, "chatml").select("chat_id", F.col("_mode").alias("mode"), "lang"), "chat_id").drop("chat_id").withColumn("kind", F.lit("chat"))
    b = records.once(load(spark, d, "payload").select("payload_id", "lang"), "payload_id").drop("payload_id").withColumn("kind", F.lit("payload"))
    c = load(spark, d, "documents").select("mode", "lang").withColumn("kind", F.lit("document"))
    u = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    return u.groupBy("kind").agg(F.count("*").alias("n"), F.count("mode").alias("with_mode"), F.count_distinct("lang").alias("langs"))


@query("WITH s AS (SELECT DISTINCT node_id, project_name, name FROM aletheia_skill), r AS (SELECT *, row_number() OVER (PARTITION BY project_name ORDER BY md5(node_id), node_id) - 1 AS i FROM s WHERE project_name IS NOT NULL) SELECT project_name, count(*) AS contrastive FROM r WHERE i % 7 = 0 GROUP BY 1")
def contrastive_schedule(spark, d):
    """Every seventh node of a project, in the order of their hashes."""
    s = records.once(load(spark, d, "aletheia_skill").select("node_id", "project_name"), "node_id")
    return records.ranked(s, "project_name", "node_id").where((F.col("_r") - 1) % 7 == 0).groupBy("project_name").agg(F.count("*").alias("contrastive"))


@query("WITH e AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) SELECT CASE WHEN prev = event_type THEN 'equivalent' WHEN prev = 'view' AND event_type = 'click' THEN 'tests' WHEN prev = 'click' AND event_type = 'purchase' THEN 'validates' ELSE 'none' END AS relation, count(*) AS n FROM e WHERE prev IS NOT NULL GROUP BY 1")
def previous_edges(spark, d):
    """How each event follows the one before it of the same user: the first rule that holds."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, d, "events").select("event_type", F.lag("event_type").over(w).alias("prev")).where("prev is not null")
    r = F.when(F.col("prev") == F.col("event_type"), "equivalent").when((F.col("prev") == "view") & (F.col("event_type") == "click"), "tests").when((F.col("prev") == "click") & (F.col("event_type") == "purchase"), "validates").otherwise("none")
    return e.groupBy(r.alias("relation")).agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT DISTINCT doc_id, annotator, quality, toxic FROM labels), g AS (SELECT CASE WHEN toxic = 1 THEN 'toxic' WHEN quality <= 2 THEN 'low_quality' WHEN quality IS NULL THEN 'unrated' ELSE 'accepted' END AS reason, doc_id FROM l) SELECT reason, count(*) AS n, round(avg(coalesce((length(d.text) + 3) // 4, 0)), 2) AS mean_tokens FROM g JOIN documents d USING (doc_id) GROUP BY reason")
def run_summary(spark, d):
    """Reviews by what they decided, with the mean tokens of the texts."""
    l = load(spark, d, "labels").select("doc_id", "annotator", "quality", "toxic").distinct()
    r = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") <= 2, "low_quality").when(F.col("quality").isNull(), "unrated").otherwise("accepted")
    j = l.select("doc_id", r.alias("reason")).join(load(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("t")), "doc_id")
    return j.groupBy("reason").agg(F.count("*").alias("n"), F.round(F.avg("t"), 2).alias("mean_tokens"))
