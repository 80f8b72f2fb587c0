"""Every query of the core by name, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import vector as V
from ..operators import extract, formats, graph, records, similar
from ..sources import files
from ..sources.tables import load
from ..streaming import telemetry
from .registry import oracle_sql, queries, query

__all__ = ["oracle_sql", "queries"]

def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _contains(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '" + w.replace("'", "''") + "')" for w in words) + ")"


# Conversations.
PAIRS_SQL = """
chats AS (SELECT DISTINCT chat_id, _mode, messages FROM chatml),
turns AS (SELECT chat_id, _mode, unnest(range(1, len(messages))) AS turn, messages FROM chats WHERE len(messages) > 1),
pairs AS (SELECT chat_id, _mode, turn, messages[turn].content AS question, messages[turn + 1].content AS answer FROM turns
          WHERE messages[turn].role = 'user' AND messages[turn + 1].role = 'assistant')
"""


def chat_turns(spark: SparkSession, d: str) -> DataFrame:
    """(chat_id, _mode, turn, question, answer) of each user message that an assistant answers."""
    m = records.once(load(spark, d, "chatml").select("chat_id", "_mode", "messages"), "chat_id")
    turns = F.expr("filter(sequence(1, greatest(size(messages) - 1, 1)), i -> i < size(messages) and messages[i].role = 'assistant' and messages[i - 1].role = 'user')")
    return m.select("chat_id", "_mode", "messages", F.explode(turns).alias("turn")).select("chat_id", "_mode", "turn", F.expr("messages[turn - 1].content").alias("question"), F.expr("messages[turn].content").alias("answer"))


@query(f"WITH {PAIRS_SQL} SELECT chat_id, CAST(turn AS INT) AS turn, _mode, coalesce(length(question), -1) AS question_chars, coalesce(length(answer), -1) AS answer_chars FROM pairs")
def chat_pairs(spark, d):
    return chat_turns(spark, d).select("chat_id", "turn", "_mode", F.coalesce(F.length("question"), F.lit(-1)).cast("bigint").alias("question_chars"), F.coalesce(F.length("answer"), F.lit(-1)).cast("bigint").alias("answer_chars"))


VERDICT = "CASE WHEN question IS NULL OR answer IS NULL THEN 'missing' WHEN length(question) < 10 OR length(answer) < 5 THEN 'too_short' WHEN length(answer) > 20 AND contains(question, answer) THEN 'parrot' ELSE 'ok' END"


def verdict(pairs: DataFrame) -> DataFrame:
    q, a = F.col("question"), F.col("answer")
    return pairs.withColumn("verdict", F.when(q.isNull() | a.isNull(), "missing").when((F.length(q) < 10) | (F.length(a) < 5), "too_short").when((F.length(a) > 20) & q.contains(a), "parrot").otherwise("ok"))


@query(f"WITH {PAIRS_SQL} SELECT _mode, {VERDICT} AS verdict, count(*) AS n FROM pairs GROUP BY ALL")
def parrot_gate(spark, d):
    return verdict(chat_turns(spark, d)).groupBy("_mode", "verdict").agg(F.count("*").alias("n"))


@query(f"WITH {PAIRS_SQL}, v AS (SELECT _mode, {VERDICT} AS verdict FROM pairs) SELECT count(*) AS pairs, count(*) FILTER (verdict <> 'ok') AS rejected, count(DISTINCT _mode) AS modes, count(*) FILTER (verdict <> 'ok') * 10 <= count(*) AS passed FROM v")
def quality_gate_summary(spark, d):
    v = verdict(chat_turns(spark, d))
    bad = F.count_if(F.col("verdict") != "ok")
    return v.agg(F.count("*").alias("pairs"), bad.alias("rejected"), F.count_distinct("_mode").alias("modes"), (bad * 10 <= F.count("*")).alias("passed"))


@query("WITH c AS (SELECT DISTINCT chat_id, messages FROM chatml), t AS (SELECT chat_id, unnest(range(1, len(messages) + 1)) AS i, messages FROM c) SELECT chat_id, CAST(i - 1 AS INT) AS turn, messages[i].role AS role, messages[i].role = 'assistant' AS train_loss FROM t")
def loss_mask(spark, d):
    """Training loss on the assistant's turns only."""
    m = records.once(load(spark, d, "chatml").select("chat_id", "messages"), "chat_id")
    return m.select("chat_id", F.posexplode("messages").alias("turn", "m")).select("chat_id", "turn", F.col("m.role").alias("role"), (F.col("m.role") == "assistant").alias("train_loss"))


@query("WITH c AS (SELECT DISTINCT chat_id, messages FROM chatml) SELECT coalesce(array_to_string(list_transform(messages, lambda m: m.role), '>'), 'none') AS roles, count(*) AS n, count(*) FILTER (len(list_filter(messages, lambda m: m.content IS NULL OR regexp_matches(m.content, '^[ \t\n\r\f]*$'))) > 0) AS with_blank FROM c GROUP BY ALL")
def role_sequence_audit(spark, d):
    m = records.once(load(spark, d, "chatml").select("chat_id", "messages"), "chat_id")
    roles = F.coalesce(F.array_join(F.transform("messages", lambda x: x["role"]), ">"), F.lit("none"))
    blank = F.exists("messages", lambda x: x["content"].isNull() | x["content"].rlike("^[ \\t\\n\\r\\f]*$"))
    return m.groupBy(roles.alias("roles")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(blank, F.lit(False))).alias("with_blank"))


@query("WITH p AS (SELECT DISTINCT payload_id, instruction, output FROM payload) SELECT CASE WHEN output IS NULL THEN 'missing' WHEN length(instruction) < 10 THEN 'short_instruction' WHEN length(output) < 5 THEN 'short_output' ELSE 'ok' END AS verdict, count(*) AS n FROM p GROUP BY ALL")
def behavioural_gate(spark, d):
    p = records.once(load(spark, d, "payload").select("payload_id", "instruction", "output"), "payload_id")
    v = F.when(F.col("output").isNull(), "missing").when(F.length("instruction") < 10, "short_instruction").when(F.length("output") < 5, "short_output").otherwise("ok")
    return p.groupBy(v.alias("verdict")).agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT DISTINCT payload_id, instruction, input, output FROM payload) SELECT payload_id, md5(concat_ws(chr(10), '<|user|>', instruction, input, '<|assistant|>', output)) AS digest, 2 + 4 * 2 + (length(concat_ws(chr(10), instruction, input, output)) + 3) // 4 AS est_tokens FROM p")
def alpaca_rows(spark, d):
    """Instruction rows as one chat text: its digest and estimated tokens."""
    p = records.once(load(spark, d, "payload").select("payload_id", "instruction", "input", "output"), "payload_id")
    whole = F.concat_ws("\n", F.lit("<|user|>"), "instruction", "input", F.lit("<|assistant|>"), "output")
    return p.select("payload_id", F.md5(whole).alias("digest"), (F.lit(10) + T.token_estimate(F.concat_ws("\n", "instruction", "input", "output"))).alias("est_tokens"))


# Texts.
@query("SELECT doc_id, token FROM (SELECT doc_id, CASE WHEN contains(lower(text), 'irer') THEN 'IRER' WHEN contains(lower(text), 'resonance field') THEN 'resonance field' WHEN contains(lower(text), 'sse 0.00087') THEN 'SSE 0.00087' WHEN contains(lower(text), 'nura physics') THEN 'nura physics' WHEN contains(lower(text), 'omega handshake') THEN 'omega handshake' WHEN contains(lower(text), 'bounded inevitability') THEN 'bounded inevitability' END AS token FROM documents) WHERE token IS NOT NULL")
def firewall_scan(spark, d):
    return load(spark, d, "documents").select("doc_id", T.firewall(F.col("text")).alias("token")).where("token is not null")


@query("SELECT node_id, CAST(i AS INT) AS pattern FROM (SELECT DISTINCT node_id, code_snippet FROM aletheia_skill) s, (VALUES " + ", ".join(f"({i}, '" + p.replace("'", "''") + "')" for i, p in enumerate(T.DETECT)) + ") p(i, re) WHERE regexp_matches(code_snippet, re)")
def secret_scan(spark, d):
    s = records.once(load(spark, d, "aletheia_skill").select("node_id", "code_snippet"), "node_id")
    return s.select("node_id", F.explode(T.secret_hits(F.col("code_snippet"))).alias("pattern"))


def _nested(c: str, patterns: list[str], to: str) -> str:
    for p in patterns:
        c = f"regexp_replace({c}, '" + p.replace("'", "''") + f"', '{to}', 'g')"
    return c


def _hide_sql(c: str) -> str:
    """Line by line, quoted values of more than 4.8 bits on lines that name a secret."""
    case = "l"
    for q in ('"', "''"):
        m = f"(?s)^([ \\t]*(?:[0-9]+[ \\t]*\\|[ \\t]*)?[A-Za-z0-9_]+[ \\t]*[:=][ \\t]*{q})([^{q}]*)({q}.*)$"
        case = f"CASE WHEN regexp_matches(l, '{m}') AND coalesce(list_aggregate(list_filter(string_split(regexp_extract(l, '{m}', 2), ''), lambda x: x <> ''), 'entropy'), 0) > 4.8 THEN concat(regexp_extract(l, '{m}', 1), '[REDACTED_HIGH_ENTROPY]', regexp_extract(l, '{m}', 3)) ELSE {case} END"
    words = "api_key|secret_key|auth_token|access_token|password|bearer|client_secret|private_key|token|pwd"
    lines = f"regexp_split_to_array(regexp_replace({c}, '(\\r\\n|\\n|\\r)\\z', ''), '\\r\\n|\\n|\\r')"
    return f"array_to_string(list_transform({lines}, lambda l: CASE WHEN regexp_matches(lower(l), '{words}') THEN {case} ELSE l END), chr(10))"


@query("SELECT node_id, CASE WHEN code_snippet IS NOT NULL THEN md5(" + _hide_sql(_nested(_nested("code_snippet", T.SENSITIVE, "[REDACTED_SENSITIVE_PATTERN]"), T.VENDOR, "[REDACTED_VENDOR_SECRET]")) + ") END AS digest FROM (SELECT DISTINCT node_id, code_snippet FROM aletheia_skill)")
def secret_redact(spark, d):
    s = records.once(load(spark, d, "aletheia_skill").select("node_id", "code_snippet"), "node_id")
    return s.select("node_id", F.md5(T.redact(F.col("code_snippet"))).alias("digest"))


@query("WITH b AS (SELECT doc_id, substr(h, 2 * i - 1, 2) AS x, count(*) AS c FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 + 1)) AS i FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text <> '')) GROUP BY ALL), t AS (SELECT *, sum(c) OVER (PARTITION BY doc_id) AS s FROM b) SELECT doc_id, round(abs(sum(c / s * log2(c / s))), 4) AS entropy FROM t GROUP BY doc_id")
def char_entropy(spark, d):
    return load(spark, d, "documents").where("text <> ''").select("doc_id", F.round(F.abs(T.byte_entropy("text")), 4).alias("entropy"))


WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '')"


@query(f"WITH w AS (SELECT lang, unnest({WORDS}) AS w FROM documents), c AS (SELECT lang, w, count(*) AS c FROM w GROUP BY ALL), t AS (SELECT *, sum(c) OVER (PARTITION BY lang) AS s FROM c) SELECT lang, round(-sum(c / s * log2(c / s)), 4) AS entropy, CAST(sum(c) AS BIGINT) AS words FROM t GROUP BY lang")
def word_entropy(spark, d):
    """Entropy of the words of each language's texts; -sum(p log p) from two sums, so no window over a language."""
    w = load(spark, d, "documents").select("lang", F.explode(T.ascii_words(F.col("text"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("c"))
    return w.groupBy("lang").agg(F.sum("c").alias("words"), F.sum(F.col("c") * F.log2("c")).alias("x")).select("lang", F.round(F.log2("words") - F.col("x") / F.col("words"), 4).alias("entropy"), "words")


@query(f"SELECT doc_id, len(w) AS words, len(list_distinct(w)) AS distinct_words FROM (SELECT doc_id, {WORDS} AS w FROM documents WHERE text IS NOT NULL)")
def lexical_density(spark, d):
    w = T.ascii_words(F.col("text"))
    return load(spark, d, "documents").where("text is not null").select("doc_id", F.size(w).cast("bigint").alias("words"), F.size(F.array_distinct(w)).cast("bigint").alias("distinct_words"))


SPACED = "list_filter(regexp_split_to_array(trim(text), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')"


@query(
    f"WITH d AS (SELECT doc_id, text, lower(text) AS low, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w, len({SPACED}) AS n FROM documents) SELECT reason, count(*) AS n FROM (SELECT CASE WHEN text IS NULL OR n < 20 THEN 'short_output' WHEN {_contains('low', T.SYCOPHANCY)} THEN 'sycophancy_detected' WHEN len(w) > 50 AND len(list_distinct(w)) / len(w) < 0.4 THEN 'low_lexical_density' WHEN NOT ({_contains('low', T.CAUSAL)} AND {_contains('low', T.TRANSFORM)}) THEN 'missing_causal_structure' ELSE 'pass' END AS reason FROM d) GROUP BY reason"
)
def quality_stack(spark, d):
    t = load(spark, d, "documents").select("text", F.lower("text").alias("low"))
    t = t.select("text", "low", T.any_words(F.col("low")).alias("w"))
    return t.groupBy(T.quality_reason(F.col("text"), F.col("low"), F.col("w")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN {_contains('lower(text)', k)} THEN '{n}'" for n, k in T.LENSES) + " ELSE 'theoretical' END AS lens FROM documents WHERE text IS NOT NULL")
def lens_label(spark, d):
    return load(spark, d, "documents").where("text is not null").select("doc_id", T.lens(F.col("text")).alias("lens"))


@query(
    f"WITH s AS (SELECT DISTINCT node_id, lower(trim(name)) AS n, lower(trim(source_context)) AS t FROM aletheia_skill) SELECT node_id, coalesce(n <> '' AND t <> '' AND NOT regexp_matches(n, '^[0-9. ,+()%-]+$') AND regexp_matches(n, '[a-z]{{3,}}') AND NOT regexp_matches(n, '\\b(table|fig|figure|page|edu)\\b') AND NOT regexp_matches(n, '^(?:{T.DANGLING})\\b') AND NOT regexp_matches(n, '\\b(descriptive|example|term|see also|listed in)\\b') AND len(list_filter(regexp_split_to_array(trim(t), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) >= 15 AND (len(regexp_extract_all(n, '[a-z]{{4,}}')) = 0 OR len(list_filter(regexp_extract_all(n, '[a-z]{{4,}}'), lambda x: contains(t, x))) > 0), false) AS ok FROM s"
)
def concept_quality_gate(spark, d):
    s = records.once(load(spark, d, "aletheia_skill").select("node_id", "name", "source_context"), "node_id")
    return s.select("node_id", T.concept_ok(F.col("name"), F.col("source_context")).alias("ok"))


@query("SELECT source_kind, count(*) FILTER (coalesce(length(trim(text)) >= 80 AND NOT regexp_matches(lower(text), '\\b(table|fig\\.?|figure) [0-9]'), false)) AS usable, count(*) AS n FROM documents GROUP BY ALL")
def usable_content(spark, d):
    return load(spark, d, "documents").groupBy("source_kind").agg(F.count_if(T.usable(F.col("text"))).alias("usable"), F.count("*").alias("n"))


_LETTERS = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda x: x <> ''))"
_MODE_SQL = {m: f"len(list_intersect({_LETTERS}, [{_quoted(k)}]))" for m, k in T.MODE_WORDS.items()}


@query(f"SELECT mode, count(*) AS n FROM (SELECT CASE WHEN {_MODE_SQL['veteran']} >= 2 THEN 'veteran' WHEN {_MODE_SQL['advocate']} >= 1 THEN 'advocate' WHEN {_MODE_SQL['theorist']} >= 1 THEN 'theorist' WHEN strpos('02468ace', substr(md5(coalesce(text, '')), 1, 1)) > 0 THEN 'theorist' ELSE 'advocate' END AS mode FROM documents) GROUP BY mode")
def mode_detect_keywords(spark, d):
    return load(spark, d, "documents").groupBy(T.mode_of(F.col("text")).alias("mode")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN m IN ('coder', 'coding', 'coding_assistant', 'software_tech') THEN 'software_tech' WHEN m IN ('theorist', 'scholar') THEN 'scholar' WHEN m IN ('advocate', 'project_manager', 'project_reviewer') THEN 'project_reviewer' WHEN m IN ('veteran', 'experienced', 'matured') THEN 'matured' END AS mode, count(*) AS n FROM (SELECT DISTINCT request_id, lower(trim(mode)) AS m FROM score_request) GROUP BY 1")
def mode_aliases(spark, d):
    r = records.once(load(spark, d, "score_request").select("request_id", "mode"), "request_id")
    return r.groupBy(T.canonical_mode(F.col("mode")).alias("mode")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, round(least(0.55, len({SPACED}) / 50.0 * 0.4 + least(0.15, 0.025 * ({' + '.join('contains(text, ' + chr(39) + p + chr(39) + ')::INT' for p in '.,:;!?()')}))), 4) AS density FROM documents WHERE text IS NOT NULL")
def content_density_text(spark, d):
    return load(spark, d, "documents").where("text is not null").select("doc_id", F.round(T.density_text(F.col("text")), 4).alias("density"))


@query("SELECT DISTINCT payload_id, round(length(theory_text) / (length(theory_text) + length(implementation_code)), 3) AS ratio FROM advocate_payload WHERE length(theory_text) + length(implementation_code) > 0")
def text_to_code_ratio(spark, d):
    p = load(spark, d, "advocate_payload").where(F.length("theory_text") + F.length("implementation_code") > 0)
    return p.select("payload_id", F.round(F.length("theory_text") / (F.length("theory_text") + F.length("implementation_code")), 3).alias("ratio")).distinct()


@query("SELECT node_id FROM (SELECT DISTINCT node_id FROM aletheia_skill) WHERE list_reduce(list_prepend(0::BIGINT, list_transform(string_split(md5(node_id), ''), lambda c: (strpos('0123456789abcdef', c) - 1)::BIGINT)), lambda a, x: (a * 16 + x) % 100) < 15")
def hash_sample(spark, d):
    """A repeatable sample of 15 in 100 by the key's hash."""
    return load(spark, d, "aletheia_skill").select("node_id").distinct().where(T.hash_percent(F.col("node_id")) < 15)


@query("SELECT doc_id, md5(replace(regexp_replace(regexp_replace(text, '```[a-z]*\\n?', '', 'g'), '(?m)^#{1,6}[ \\t]+', '', 'g'), '**', '')) AS digest FROM documents WHERE text IS NOT NULL")
def strip_markdown(spark, d):
    return load(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.strip_markdown(F.col("text"))).alias("digest"))


# Keys, duplicates, splits, balance.
@query("SELECT md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS key, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def normalised_key_dedupe(spark, d):
    docs = load(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return records.first_per_key(docs, F.md5(T.normal_key(F.col("text"))), "doc_id")


@query("SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, d):
    return load(spark, d, "documents").where("text is not null").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n > 1")


@query("SELECT node_id, max(ingested_at) AS ingested_at, arg_max(project_name, ingested_at) AS project_name, count(*) AS deliveries FROM aletheia_skill GROUP BY node_id")
def latest_nodes(spark, d):
    s = load(spark, d, "aletheia_skill").select("node_id", "project_name", "ingested_at")
    return s.groupBy("node_id").agg(F.max("ingested_at").alias("ingested_at"), F.max_by("project_name", "ingested_at").alias("project_name"), F.count("*").alias("deliveries"))


@query("WITH q AS (SELECT l.doc_id, d.source, max(quality) AS quality FROM labels l JOIN documents d USING (doc_id) WHERE quality IS NOT NULL AND d.source IS NOT NULL GROUP BY ALL) SELECT source, doc_id, quality, next_quality FROM (SELECT *, row_number() OVER w AS r, lead(quality) OVER w AS next_quality FROM q WINDOW w AS (PARTITION BY source ORDER BY quality DESC, doc_id)) WHERE r = 1")
def best_row_per_key(spark, d):
    """The best rated document of each source and the runner-up's rating: two aggregates, no window over a source."""
    q = load(spark, d, "labels").where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    q = q.join(load(spark, d, "documents").where("source is not null").select("doc_id", "source"), "doc_id")
    best = q.groupBy("source").agg(F.min(F.struct((-F.col("quality")).alias("q"), "doc_id")).alias("b"))
    rest = q.join(best, "source").where("doc_id <> b.doc_id").groupBy("source").agg(F.max("quality").alias("next_quality"))
    return best.join(rest, "source", "left").select("source", F.col("b.doc_id").alias("doc_id"), (-F.col("b.q")).alias("quality"), "next_quality")


_EVAL = "('0x' || substr(md5(coalesce(source, '')), 1, 8))::BIGINT % 100 < 10"


@query(f"SELECT CASE WHEN {_EVAL} THEN 'eval' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def group_split(spark, d):
    return records.split_by_group(load(spark, d, "documents").select("doc_id", "source"), "source").groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query(f"WITH s AS (SELECT md5(text) AS t, CASE WHEN {_EVAL} THEN 'eval' ELSE 'train' END AS split FROM documents WHERE text <> '') SELECT count(DISTINCT a.t) AS texts FROM s a SEMI JOIN s b ON a.t = b.t AND b.split = 'train' WHERE a.split = 'eval'")
def split_overlap(spark, d):
    """Texts of the evaluation side that also stand in training."""
    s = records.split_by_group(load(spark, d, "documents").where("text <> ''").select("text", "source"), "source").select(F.md5("text").alias("t"), "split")
    return s.where("split = 'eval'").select("t").distinct().join(s.where("split = 'train'").select("t"), "t", "left_semi").agg(F.count("*").alias("texts"))


_CHATS = "SELECT DISTINCT chat_id, _mode, _sample_weight, len(messages) AS n_messages FROM chatml"
_FACTORS = f"c AS ({_CHATS}), n AS (SELECT _mode, count(*) AS n FROM c WHERE _mode IS NOT NULL GROUP BY 1), f AS (SELECT _mode, n, round(greatest(0.75, least(1.25, (sum(n) OVER () / count(*) OVER ()) / n)), 6) AS factor FROM n)"


@query(f"WITH {_FACTORS} SELECT * FROM f")
def mode_balance_factors(spark, d):
    return records.balance_factors(records.once(load(spark, d, "chatml").select("chat_id", "_mode"), "chat_id"), "_mode")


@query(f"WITH {_FACTORS} SELECT chat_id, round(greatest(0.01, _sample_weight * least(1.0, coalesce(n_messages, 0) / 4) * factor), 6) AS weight FROM c JOIN f USING (_mode) WHERE _sample_weight IS NOT NULL")
def sample_weights(spark, d):
    c = records.once(load(spark, d, "chatml").select("chat_id", "_mode", "_sample_weight", F.size("messages").alias("n")), "chat_id").where("_sample_weight is not null")
    f = records.balance_factors(records.once(load(spark, d, "chatml").select("chat_id", "_mode"), "chat_id"), "_mode").drop("n")
    size = F.greatest(F.coalesce("n", F.lit(0)), F.lit(0))
    return c.join(f, "_mode").select("chat_id", F.round(F.greatest(F.lit(0.01), F.col("_sample_weight") * F.least(F.lit(1.0), size / 4) * F.col("factor")), 6).alias("weight"))


@query("WITH c AS (SELECT DISTINCT chat_id, _mode FROM chatml WHERE _mode IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY _mode ORDER BY md5(chat_id::VARCHAR), chat_id) AS i, count(*) OVER (PARTITION BY _mode) AS m FROM c), t AS (SELECT min(n) AS t FROM (SELECT count(*) AS n FROM c GROUP BY _mode)) SELECT chat_id, _mode FROM r, t WHERE floor(i * t / m) > floor((i - 1) * t / m)")
def systematic_balance(spark, d):
    """Chats thinned so that each mode has as many as the rarest."""
    c = records.once(load(spark, d, "chatml").select("chat_id", "_mode"), "chat_id")
    return records.systematic(c, "_mode", "chat_id")


@query(f"WITH c AS (SELECT DISTINCT chat_id, _mode FROM chatml), o AS (SELECT count(*) AS n FROM c WHERE _mode IS DISTINCT FROM 'theorist'), t AS (SELECT *, row_number() OVER (ORDER BY md5(chat_id::VARCHAR), chat_id) AS r FROM c WHERE _mode = 'theorist') SELECT chat_id, _mode FROM c WHERE _mode IS DISTINCT FROM 'theorist' UNION ALL SELECT chat_id, _mode FROM t, o WHERE r <= floor(0.25 * n)")
def seeded_cap(spark, d):
    return records.cap_mode(records.once(load(spark, d, "chatml").select("chat_id", "_mode"), "chat_id"), "_mode", "theorist", "chat_id", 0.25)


@query("WITH c AS (SELECT DISTINCT chat_id, _mode FROM chatml WHERE _mode IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY _mode ORDER BY md5(chat_id::VARCHAR), chat_id) AS i FROM c) SELECT chat_id, _mode FROM r WHERE i <= (SELECT min(n) FROM (SELECT count(*) AS n FROM c GROUP BY _mode))")
def equal_modes(spark, d):
    """As many chats of each mode as the rarest has, drawn by their hash."""
    return records.equalise(records.once(load(spark, d, "chatml").select("chat_id", "_mode"), "chat_id"), "_mode", "chat_id")


# Token report.
LIMITS = [256, 512, 1024, 2048, 4096, 8192, 12288, 16384, 32768]
_EST = "coalesce((length(text) + 3) // 4, 0)"


@query(f"SELECT CASE {' '.join(f'WHEN {_EST} <= {x} THEN {x}' for x in LIMITS)} ELSE -1 END AS up_to, count(*) AS n FROM documents GROUP BY 1")
def token_histogram(spark, d):
    t = T.token_estimate(F.col("text"))
    b = F
    for x in LIMITS:
        b = b.when(t <= x, x)
    return load(spark, d, "documents").groupBy(b.otherwise(-1).alias("up_to")).agg(F.count("*").alias("n"))


@query(f"SELECT mode, min({_EST}) AS least, round(avg({_EST}), 2) AS mean, round(quantile_cont({_EST}, 0.5), 2) AS p50, round(quantile_cont({_EST}, 0.95), 2) AS p95, max({_EST}) AS most FROM documents GROUP BY mode")
def token_percentiles(spark, d):
    t = load(spark, d, "documents").select("mode", T.token_estimate(F.col("text")).alias("t"))
    return t.groupBy("mode").agg(F.min("t").alias("least"), F.round(F.avg("t"), 2).alias("mean"), F.round(F.percentile("t", 0.5), 2).alias("p50"), F.round(F.percentile("t", 0.95), 2).alias("p95"), F.max("t").alias("most"))


@query(f"SELECT doc_id, {_EST} AS est_tokens FROM documents ORDER BY est_tokens DESC, doc_id LIMIT 20")
def longest_rows(spark, d):
    """Report: the twenty longest texts."""
    return load(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("est_tokens")).orderBy(F.desc("est_tokens"), "doc_id").limit(20)


@query("SELECT project_name, CASE WHEN e = '' THEN NULL ELSE e END AS ext, count(*) AS files, count(*) FILTER (code_snippet IS NULL OR code_snippet = '') AS empty FROM (SELECT DISTINCT node_id, project_name, lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)) AS e, code_snippet FROM aletheia_skill) GROUP BY ROLLUP (project_name, CASE WHEN e = '' THEN NULL ELSE e END)")
def scan_stats(spark, d):
    s = records.once(load(spark, d, "aletheia_skill").select("node_id", "project_name", "file", "code_snippet"), "node_id")
    e = F.lower(F.regexp_extract("file", "\\.([A-Za-z0-9]+)$", 1))
    return s.withColumn("ext", F.when(e != "", e)).rollup("project_name", "ext").agg(F.count("*").alias("files"), F.count_if(F.coalesce(F.col("code_snippet"), F.lit("")) == "").alias("empty"))


# Joins of labels, documents and projects.
@query("SELECT d.source_kind, l.toxic, count(DISTINCT d.doc_id) AS docs, round(avg(l.quality), 4) AS quality FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL")
def rejection_breakdown(spark, d):
    j = load(spark, d, "documents").select("doc_id", "source_kind").join(load(spark, d, "labels"), "doc_id")
    return j.groupBy("source_kind", "toxic").agg(F.count_distinct("doc_id").alias("docs"), F.round(F.avg("quality"), 4).alias("quality"))


@query("SELECT substr(sha256(concat_ws('|', doc_id::VARCHAR, annotator, coalesce(quality, 0)::VARCHAR)), 1, 16) AS failure_id, doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'low_quality' END AS reason FROM (SELECT DISTINCT doc_id, annotator, quality, toxic FROM labels) WHERE toxic = 1 OR quality <= 2")
def failure_matrix(spark, d):
    l = load(spark, d, "labels").select("doc_id", "annotator", "quality", "toxic").distinct().where("toxic = 1 or quality <= 2")
    return l.select(F.substring(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "annotator", F.coalesce("quality", F.lit(0)).cast("string")), 256), 1, 16).alias("failure_id"), "doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("low_quality").alias("reason"))


@query("WITH q AS (SELECT d.node_id, d.doc_id, avg(l.quality) AS q FROM documents d JOIN labels l USING (doc_id) WHERE d.node_id IS NOT NULL AND l.quality IS NOT NULL GROUP BY ALL) SELECT node_id, arg_max(doc_id, (q, -doc_id)) AS chosen, arg_min(doc_id, (q, doc_id)) AS rejected FROM q GROUP BY node_id HAVING max(q) > min(q)")
def dpo_pairs(spark, d):
    """Per node the best and the worst rated document, where they differ."""
    j = load(spark, d, "documents").where("node_id is not null").select("doc_id", "node_id").join(load(spark, d, "labels").where("quality is not null"), "doc_id")
    q = j.groupBy("node_id", "doc_id").agg(F.avg("quality").alias("q"))
    g = q.groupBy("node_id").agg(F.max(F.struct("q", (-F.col("doc_id")).alias("d"))).alias("hi"), F.min(F.struct("q", "doc_id")).alias("lo"))
    return g.where("hi.q > lo.q").select("node_id", (-F.col("hi.d")).alias("chosen"), F.col("lo.doc_id").alias("rejected"))


@query("SELECT p.domain, count(*) AS docs, count(*) FILTER (p.project_name IS NULL) AS unknown FROM documents d LEFT JOIN project p ON lower(trim(d.source)) = lower(trim(p.project_name)) GROUP BY p.domain")
def domain_coverage(spark, d):
    p = load(spark, d, "project").select(F.lower(F.trim("project_name")).alias("k"), "domain")
    j = load(spark, d, "documents").select(F.lower(F.trim("source")).alias("k")).join(p.withColumn("known", F.lit(1)), "k", "left")
    return j.groupBy("domain").agg(F.count("*").alias("docs"), F.count_if(F.col("known").isNull()).alias("unknown"))


@query("WITH s AS (SELECT DISTINCT node_id, project_name FROM aletheia_skill) SELECT p.project_name, count(*) AS payloads, count(*) FILTER (s.node_id IS NULL) AS orphans FROM (SELECT DISTINCT payload_id, project_name, node_id FROM advocate_payload) p LEFT JOIN s USING (node_id) GROUP BY 1")
def payload_orphans(spark, d):
    s = load(spark, d, "aletheia_skill").select("node_id", F.lit(1).alias("known")).distinct()
    p = load(spark, d, "advocate_payload").select("payload_id", "project_name", "node_id").distinct()
    return p.join(s, "node_id", "left").groupBy("project_name").agg(F.count("*").alias("payloads"), F.count_if(F.col("known").isNull()).alias("orphans"))


@query("SELECT project_name, count(*) AS rows, count(*) FILTER (ingested_at > created_at + INTERVAL 1 DAY) AS late FROM aletheia_skill GROUP BY 1")
def late_rows(spark, d):
    s = load(spark, d, "aletheia_skill")
    return s.groupBy("project_name").agg(F.count("*").alias("rows"), F.count_if(F.col("ingested_at") > F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("late"))


# Structured text.
@query("WITH s AS (SELECT DISTINCT node_id, source_context AS t FROM aletheia_skill) SELECT CASE WHEN t IS NULL THEN 'null' WHEN trim(t) = '' THEN 'empty_line' WHEN NOT starts_with(trim(t), '{') THEN 'text' WHEN json_valid(t) THEN 'object' ELSE 'invalid_json' END AS kind, count(*) AS n FROM s GROUP BY 1")
def json_audit(spark, d):
    """Rows by what their context is; bad JSON is reported, not dropped."""
    s = records.once(load(spark, d, "aletheia_skill").select("node_id", F.col("source_context").alias("t")), "node_id")
    t = F.col("t")
    k = F.when(t.isNull(), "null").when(F.trim(t) == "", "empty_line").when(~F.trim(t).startswith("{"), "text").when(F.json_object_keys(t).isNotNull(), "object").otherwise("invalid_json")
    return s.groupBy(k.alias("kind")).agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT DISTINCT payload_id, input FROM payload WHERE input IS NOT NULL AND json_valid(input)) SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(input)) AS key FROM p) GROUP BY key")
def json_key_sketch(spark, d):
    p = load(spark, d, "payload").where("input is not null").select("payload_id", "input").distinct()
    return p.select(F.explode(F.json_object_keys("input")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT project_name, array_to_string(list_sort(list_distinct(list(regexp_extract(replace(file, chr(92), '/'), '^(?:\\./)?[^/]+/([^/]+)/', 1)))), ',') AS folders FROM aletheia_skill GROUP BY 1")
def tree_map(spark, d):
    """Top folders of each project."""
    s = load(spark, d, "aletheia_skill")
    f = F.regexp_extract(F.replace(F.col("file"), F.lit("\\"), F.lit("/")), "^(?:\\./)?[^/]+/([^/]+)/", 1)
    return s.select("project_name", f.alias("f")).distinct().groupBy("project_name").agg(F.array_join(F.sort_array(F.collect_set("f")), ",").alias("folders"))


@query("WITH s AS (SELECT DISTINCT node_id, imports FROM aletheia_skill) SELECT module, count(*) AS nodes FROM (SELECT unnest(imports) AS module FROM s) GROUP BY module")
def import_counts(spark, d):
    s = records.once(load(spark, d, "aletheia_skill").select("node_id", "imports"), "node_id")
    return s.select(F.explode("imports").alias("module")).groupBy("module").agg(F.count("*").alias("nodes"))


# Vectors.
@query("WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL), dn AS (SELECT e.vec_id, e.label, c.label AS centre, sum(e.x * c.m) / sqrt(sum(e.x * e.x) * sum(c.m * c.m)) AS cos FROM e JOIN c USING (i) GROUP BY ALL) SELECT vec_id, label, arg_max(centre, (round(cos, 9), -centre)) AS nearest, round(max(cos), 4) AS cos FROM dn GROUP BY vec_id, label")
def nearest_centroid(spark, d):
    """The class whose mean vector is nearest by cosine. There is one mean per class: a table bounded by the number of classes."""
    e = load(spark, d, "embeddings")
    c = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = c.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v")).select("label", F.transform("v", lambda s: s["m"]).alias("v"))
    all_ = c.agg(F.collect_list(F.struct(F.col("label").alias("l"), "v")).alias("cs"))
    best = F.array_max(F.transform("cs", lambda k: F.struct(F.round(V.cosine(F.col("embedding"), k["v"]), 9).alias("r"), (-k["l"]).alias("o"), V.cosine(F.col("embedding"), k["v"]).alias("c"))))
    return e.join(F.broadcast(all_)).withColumn("b", best).select("vec_id", "label", (-F.col("b.o")).alias("nearest"), F.round("b.c", 4).alias("cos"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm FROM embeddings")
def vector_norms(spark, d):
    return load(spark, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 4).alias("norm"))


@query("SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 4) AS cos FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.95")
def cosine_redundancy(spark, d):
    return similar.every_pair(load(spark, d, "embeddings"), "vec_id", "embedding").withColumn("cos", F.round("cos", 4))


# Graph of calls between nodes.
_EDGES = "n AS (SELECT DISTINCT node_id, dependencies.downstream_calls AS calls FROM aletheia_skill), e AS (SELECT DISTINCT node_id AS src, c AS dst FROM (SELECT node_id, unnest(calls) AS c FROM n) WHERE c <> node_id AND c IN (SELECT node_id FROM n))"


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "aletheia_skill").select("node_id", F.col("dependencies.downstream_calls").alias("calls"))
    return graph.edges_of(n, "node_id", F.col("calls"))


@query(f"WITH {_EDGES}, x AS (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) SELECT node, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM x GROUP BY node")
def degree_risk(spark, d):
    return graph.degrees(call_edges(spark, d))


@query(f"WITH {_EDGES} SELECT count(*) AS calls, count(*) FILTER (c NOT IN (SELECT node_id FROM n)) AS unresolved FROM (SELECT DISTINCT node_id, unnest(calls) AS c FROM n)")
def call_resolution(spark, d):
    s = load(spark, d, "aletheia_skill")
    known = s.select(F.col("node_id").alias("c"), F.lit(1).alias("known")).distinct()
    calls = s.select("node_id", F.explode("dependencies.downstream_calls").alias("c")).distinct()
    return calls.join(known, "c", "left").agg(F.count("*").alias("calls"), F.count_if(F.col("known").isNull()).alias("unresolved"))


_STARTS = "(SELECT src AS node FROM e EXCEPT SELECT dst FROM e)"


@query(f"WITH RECURSIVE {_EDGES}, r(node, depth) AS (SELECT node, 0 FROM {_STARTS} UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 6) SELECT node, min(depth)::INT AS depth FROM r GROUP BY node")
def bfs_depth6(spark, d):
    """Steps from the nodes that nobody calls, up to six."""
    e = call_edges(spark, d)
    starts = e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    return graph.reach(e, starts, 6)


@query(f"WITH {_EDGES}, k AS (SELECT src AS node, dst AS nb FROM e UNION SELECT dst, src FROM e) SELECT node, count(*) AS neighbours FROM k GROUP BY node")
def ego_cluster(spark, d):
    e = call_edges(spark, d)
    both = e.select(F.col("src").alias("node"), F.col("dst").alias("nb")).unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("nb"))).distinct()
    return both.groupBy("node").agg(F.count("*").alias("neighbours"))


# Ledger and events.
_ROW = "sha256(concat_ws('|', ledger_id::VARCHAR, node_id, coalesce(from_state, ''), to_state, coalesce(trigger_name, '')))"


_BLOCKS = f"l AS (SELECT DISTINCT ledger_id, project_name, CAST(event_ts AS DATE) AS day, {_ROW} AS h FROM ledger), p AS (SELECT project_name, day, substr(h, 1, 2) AS p, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS d FROM l GROUP BY ALL), b AS (SELECT project_name, day, sum(n)::BIGINT AS entries, sha256(string_agg(d, '' ORDER BY p)) AS block FROM p GROUP BY ALL)"


def _entries(spark, d):
    h = F.sha2(F.concat_ws("|", F.col("ledger_id").cast("string"), "node_id", F.coalesce("from_state", F.lit("")), "to_state", F.coalesce("trigger_name", F.lit(""))), 256)
    return load(spark, d, "ledger").select("ledger_id", "project_name", F.to_date("event_ts").alias("day"), h.alias("h")).distinct()


@query(f"WITH {_BLOCKS} SELECT * FROM b")
def ledger_blocks(spark, d):
    """A digest per project and day; a changed, lost or added entry changes it."""
    return records.block_digests(_entries(spark, d), ["project_name", "day"], "h")


_CHAIN = f"{_BLOCKS}, q AS (SELECT *, row_number() OVER (PARTITION BY project_name ORDER BY day) AS seq FROM b), c(project_name, day, seq, entries, block, prev_hash, this_hash) AS (SELECT project_name, day, seq, entries, block, 'GENESIS', sha256(concat_ws('|', 'GENESIS', project_name, day::VARCHAR, block, seq::VARCHAR)) FROM q WHERE seq = 1 UNION ALL SELECT q.project_name, q.day, q.seq, q.entries, q.block, c.this_hash, sha256(concat_ws('|', c.this_hash, q.project_name, q.day::VARCHAR, q.block, q.seq::VARCHAR)) FROM c JOIN q ON q.project_name = c.project_name AND q.seq = c.seq + 1)"


@query(f"WITH RECURSIVE {_CHAIN} SELECT project_name, day::VARCHAR AS day, seq, entries, block, prev_hash, this_hash FROM c")
def ledger_chain(spark, d):
    """The blocks of each project sealed one after the other."""
    return records.chained(ledger_blocks(spark, d), "project_name", "day")


@query(f"WITH RECURSIVE {_CHAIN}, f AS (SELECT project_name, min(ledger_id) AS ledger_id FROM l GROUP BY project_name), k AS (SELECT f.project_name, min(c.seq) AS seq FROM f JOIN l USING (project_name, ledger_id) JOIN q c ON c.project_name = l.project_name AND c.day = l.day GROUP BY 1) SELECT q.project_name, count(*) AS blocks, any_value(k.seq) AS broken_at FROM q JOIN k USING (project_name) GROUP BY 1")
def ledger_tampering(spark, d):
    """One entry of each project altered after the sealing: the block at which the chain is seen to break."""
    e = _entries(spark, d)
    sealed = records.chained(records.block_digests(e, ["project_name", "day"], "h"), "project_name", "day")
    first = e.groupBy("project_name").agg(F.min("ledger_id").alias("first"))
    altered = e.join(first, "project_name").withColumn("h", F.when(F.col("ledger_id") == F.col("first"), F.sha2(F.concat("h", F.lit("!")), 256)).otherwise(F.col("h"))).drop("first")
    return records.verify(sealed, records.block_digests(altered, ["project_name", "day"], "h"), "project_name", "day")


@query("SELECT coalesce(from_state, '-') AS from_state, to_state, count(DISTINCT ledger_id) AS n FROM ledger GROUP BY ALL")
def transition_counts(spark, d):
    l = load(spark, d, "ledger").select("ledger_id", F.coalesce("from_state", F.lit("-")).alias("from_state"), "to_state").distinct()
    return l.groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS cents50, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)")
def rolling_mean_50(spark, d):
    """Sum (in hundredths, so that no order of adding shows) and number of a user's last fifty values: the rolling mean's two parts."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-49, 0)
    return load(spark, d, "events").select("event_id", F.sum(F.round(F.col("value") * 100).cast("bigint")).over(w).alias("cents50"), F.count("*").over(w).alias("n"))


@query("WITH l AS (SELECT user_id, ts, event_id, value, max(CASE WHEN value < 50 THEN (ts, event_id) END) OVER (PARTITION BY user_id) AS last_low FROM events) SELECT user_id, count(*) FILTER (last_low IS NULL OR (ts, event_id) > last_low) AS run FROM l GROUP BY user_id")
def trailing_run(spark, d):
    """How many of a user's latest events in a row are at or over the limit: two aggregates."""
    e = load(spark, d, "events").select("user_id", "value", F.struct("ts", "event_id").alias("k"))
    low = e.where("value < 50").groupBy("user_id").agg(F.max("k").alias("last"))
    return e.join(low, "user_id", "left").groupBy("user_id").agg(F.count_if(F.col("last").isNull() | (F.col("k") > F.col("last"))).alias("run"))


@query("SELECT event_id, greatest(3, 10 - 2 * count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)) / 10 AS novelty FROM events")
def fingerprint_novelty(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(-200, -1)
    return load(spark, d, "events").select("event_id", (F.greatest(F.lit(3), 10 - 2 * F.count("*").over(w)) / 10).alias("novelty"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(max(value), 4) AS most, round(min(value), 4) AS least, round(stddev_samp(value), 4) AS deviation FROM events GROUP BY event_type")
def telemetry_snapshot(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.max("value"), 4).alias("most"), F.round(F.min("value"), 4).alias("least"), F.round(F.stddev_samp("value"), 4).alias("deviation"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), u AS (SELECT user_id, sum(c) AS s FROM c GROUP BY 1), g AS (SELECT event_type, count(*) / (SELECT count(*) FROM events) AS q FROM events GROUP BY 1) SELECT user_id, round(sum(c / s * ln((c / s + 1e-10) / (q + 1e-10))), 4) AS kl FROM c JOIN u USING (user_id) JOIN g USING (event_type) GROUP BY user_id")
def kl_divergence(spark, d):
    """How far each user's mix of events is from everybody's."""
    c = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("c"))
    u = c.groupBy("user_id").agg(F.sum("c").alias("s"))
    g = c.groupBy("event_type").agg(F.sum("c").alias("g"))
    total = g.agg(F.sum("g").alias("t"))
    q = g.join(total).select("event_type", (F.col("g") / F.col("t")).alias("q"))
    p = F.col("c") / F.col("s")
    return c.join(u, "user_id").join(q, "event_type").groupBy("user_id").agg(F.round(F.sum(p * F.log((p + 1e-10) / (F.col("q") + 1e-10))), 4).alias("kl"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def telemetry_windows(spark, d):
    return telemetry.windows(load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_telemetry_windows(spark, d):
    """The same windows from a stream over the table's files, checkpointed."""
    s = telemetry.stream(spark, d, "events.parquet")
    return telemetry.drain(telemetry.windows(s), "windows", "complete")


@query("SELECT DISTINCT event_id, event_type FROM events")
def stream_dedupe(spark, d):
    s = telemetry.stream(spark, d, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return telemetry.drain(telemetry.fresh(s).select("event_id", "event_type"), "fresh")


# Star schema.
@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem GROUP BY ALL")
def lineitem_summary(spark, d):
    return load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count("*").alias("n"))


@query("SELECT n_name, count(DISTINCT o_orderkey) AS orders, count(*) AS items FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def items_by_nation(spark, d):
    items = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("items"))
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    c = load(spark, d, "customer").select("c_custkey", "c_nationkey").join(load(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.count("*").alias("orders"), F.sum("items").alias("items"))


# Extraction and formats.
@query()
def python_slices(spark, d):
    """Functions and classes of the Python nodes."""
    s = records.once(load(spark, d, "aletheia_skill").where(F.lower("file").endswith(".py")).select("node_id", "code_snippet"), "node_id")
    return extract.python_slices(s, "node_id", "code_snippet")


@query("WITH p AS (SELECT DISTINCT payload_id, instruction, output FROM payload) SELECT payload_id, 2 AS turns, md5(instruction || '>' || output) AS digest FROM p WHERE regexp_matches(instruction, '[^ \t\n\r\f]') AND regexp_matches(output, '[^ \t\n\r\f]')")
def payload_chats(spark, d):
    p = records.once(load(spark, d, "payload").select("payload_id", "instruction", "output"), "payload_id")
    c = p.select("payload_id", formats.chat(F.col("instruction"), F.col("output")).alias("m")).where("m is not null")
    return c.select("payload_id", F.size("m").alias("turns"), F.md5(F.array_join(F.transform("m", lambda x: x["content"]), ">")).alias("digest"))


@query("WITH c AS (SELECT DISTINCT chat_id, list_filter(messages, lambda m: m.role IN ('system', 'user', 'assistant') AND regexp_matches(m.content, '[^ \t\n\r\f]')) AS m FROM chatml) SELECT chat_id, CAST(len(m) + CASE WHEN len(list_filter(m, lambda x: x.role = 'system')) = 0 THEN 1 ELSE 0 END AS INT) AS turns FROM c WHERE len(list_filter(m, lambda x: x.role = 'user')) > 0 AND len(list_filter(m, lambda x: x.role = 'assistant')) > 0")
def cleaned_chats(spark, d):
    m = records.once(load(spark, d, "chatml").select("chat_id", "messages"), "chat_id")
    return m.select("chat_id", formats.clean_messages(F.col("messages"), "You are a helpful assistant.").alias("m")).where("m is not null").select("chat_id", F.size("m").alias("turns"))


@query()
def documents_fingerprint(spark, d):
    """A digest of the documents whatever their order."""
    return files.fingerprint(load(spark, d, "documents"))


@query("SELECT md5(line) AS digest FROM (SELECT DISTINCT json_object('mode', mode, 'project_name', project_name, 'request_id', request_id)::VARCHAR AS line FROM score_request)")
def canonical_lines(spark, d):
    """Requests as JSON with columns in the order of their names."""
    r = load(spark, d, "score_request").select("request_id", "project_name", "mode").distinct()
    return files.canonical(r).select(F.md5("line").alias("digest"))


_COUNTS = " + ".join(f"CAST((length(low) - length(replace(low, '{m}', ''))) / {len(m)} AS INT)" for m in ("assert", "self.assert", "pytest", "raises", "expect", "raise ", " error"))


@query(f"WITH s AS (SELECT DISTINCT node_id, lower(file) AS f, code_snippet, lower(code_snippet) AS low FROM aletheia_skill WHERE code_snippet <> '') SELECT node_id, {_COUNTS} AS assertion_count, concat_ws(',', CASE WHEN {_COUNTS} > 0 THEN 'behavioral_contract' END, CASE WHEN contains(low, 'edge') OR contains(low, 'boundary') THEN 'edge_case' END, CASE WHEN contains(low, 'raise') OR contains(low, 'error') OR contains(low, 'exception') THEN 'error_handling' END) AS coverage_scope, concat_ws(',', CASE WHEN contains(low, 'assert') THEN 'asserted output or state invariant' END, CASE WHEN contains(low, 'raises') OR contains(low, 'exception') THEN 'expected failure path is exercised' END) AS invariant_hints, CASE WHEN regexp_matches(f, 'test|spec|fixture|mock') OR regexp_matches(code_snippet, 'assert|raise ') THEN 'validation' ELSE 'execution' END AS skill FROM s")
def validation_profile(spark, d):
    s = records.once(load(spark, d, "aletheia_skill").where("code_snippet <> ''").select("node_id", "file", "code_snippet"), "node_id")
    s = s.withColumn("low", F.lower("code_snippet")).withColumn("n", T.marker_counts(F.col("code_snippet")))
    low = F.col("low")
    scope = F.concat_ws(",", F.when(F.col("n") > 0, "behavioral_contract"), F.when(low.rlike("edge|boundary"), "edge_case"), F.when(low.rlike("raise|error|exception"), "error_handling"))
    hints = F.concat_ws(",", F.when(low.contains("assert"), "asserted output or state invariant"), F.when(low.rlike("raises|exception"), "expected failure path is exercised"))
    skill = F.when(F.lower("file").rlike("test|spec|fixture|mock") | F.col("code_snippet").rlike("assert|raise "), "validation").otherwise("execution")
    return s.select("node_id", F.col("n").alias("assertion_count"), scope.alias("coverage_scope"), hints.alias("invariant_hints"), skill.alias("skill"))


@query("SELECT module, CASE WHEN regexp_matches(lower(module), 'cuda|gpu|tensor|cufft|torch|jax') THEN 'compute.accelerated' WHEN regexp_matches(lower(module), 'sql|db|mongo|redis|query') THEN 'io.database' WHEN regexp_matches(lower(module), 'http|request|fetch|socket') THEN 'io.network' ELSE 'compute.generic' END AS class FROM (SELECT DISTINCT unnest(imports) AS module FROM aletheia_skill)")
def operation_classes(spark, d):
    m = load(spark, d, "aletheia_skill").select(F.explode("imports").alias("module")).distinct()
    low = F.lower("module")
    return m.select("module", F.when(low.rlike("cuda|gpu|tensor|cufft|torch|jax"), "compute.accelerated").when(low.rlike("sql|db|mongo|redis|query"), "io.database").when(low.rlike("http|request|fetch|socket"), "io.network").otherwise("compute.generic").alias("class"))


@query("WITH l AS (SELECT DISTINCT ledger_id, project_name, event_ts, ingest_ts FROM ledger) SELECT project_name, count(*) AS entries, count(*) FILTER (ingest_ts > event_ts + INTERVAL 1 DAY) AS late, min(event_ts) AS first_ts, max(event_ts) AS last_ts FROM l GROUP BY 1")
def ledger_lateness(spark, d):
    l = load(spark, d, "ledger").select("ledger_id", "project_name", "event_ts", "ingest_ts").distinct()
    return l.groupBy("project_name").agg(F.count("*").alias("entries"), F.count_if(F.col("ingest_ts") > F.col("event_ts") + F.expr("INTERVAL 1 DAY")).alias("late"), F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"))


@query("WITH s AS (SELECT DISTINCT node_id, project_name, imports FROM aletheia_skill WHERE imports IS NOT NULL), e AS (SELECT node_id, project_name, unnest(imports) AS m FROM s) SELECT a.m AS left_module, b.m AS right_module, count(*) AS n FROM (SELECT DISTINCT node_id, m FROM e) a JOIN (SELECT DISTINCT node_id, m FROM e) b USING (node_id) WHERE a.m < b.m GROUP BY ALL")
def import_pairs(spark, d):
    """How often two modules are imported together: pairs within a node's own list, which is short by nature."""
    s = records.once(load(spark, d, "aletheia_skill").where("imports is not null").select("node_id", "imports"), "node_id")
    m = F.array_sort(F.array_distinct("imports"))
    p = s.select(F.explode(F.flatten(F.transform(m, lambda a: F.transform(F.filter(m, lambda b: b > a), lambda b: F.struct(a.alias("left_module"), b.alias("right_module")))))).alias("p"))
    return p.groupBy("p.left_module", "p.right_module").agg(F.count("*").alias("n"))


@query("SELECT doc_id, md5(replace(replace(replace(replace(replace(text, 'pig/mL', 'µg/mL'), 'pig/ml', 'µg/mL'), chr(8212) || '-', '-'), chr(8212), '-'), chr(8211), '-')) AS digest FROM documents WHERE text IS NOT NULL")
def ocr_pairs(spark, d):
    """Units and dashes of scanned text put right."""
    return load(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.fix_ocr(F.col("text"))).alias("digest"))


from . import audits, chats, graphs, nodes, sentences, shapes, texts  # noqa: E402, F401 - they add their queries
