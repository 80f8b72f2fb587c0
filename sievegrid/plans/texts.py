"""Queries on texts, concepts, answers and code: the gates, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gates as G
from ..functions import text as T
from ..operators import records
from ..sources.tables import load
from .registry import query


def _w(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')"


def _list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def nodes(spark, d, *columns):
    return records.once(load(spark, d, "aletheia_skill").select("node_id", *columns), "node_id")


_SKILL = "(SELECT DISTINCT node_id, {} FROM aletheia_skill)"
_CHATS = "(SELECT DISTINCT chat_id, {} FROM chatml)"
_HIDDEN = ["_bridge_risk", "_cluster_compression_risk", "_identity_scope_verdict", "_lens_diagnostics", "_task_scope_verdict", "_thought_action_violation", "control_nodes", "identity_scope", "lens_coordinates", "source_provenance", "task_scope", "thought_action_boundary", "training_visibility_policy"]


@query(f"WITH t AS (SELECT chat_id, generate_subscripts(messages, 1) - 1 AS turn, unnest(messages).content AS c FROM {_CHATS.format('messages')}) SELECT chat_id, CAST(turn AS INT) AS turn, CASE {' '.join(f'WHEN contains(c, {chr(39)}{k}{chr(39)}) THEN {chr(39)}{k}{chr(39)}' for k in _HIDDEN)} END AS leaked FROM t WHERE {' OR '.join(f'contains(c, {chr(39)}{k}{chr(39)})' for k in _HIDDEN)}")
def hidden_key_leaks(spark, d):
    """Messages that show a key of hidden metadata."""
    m = records.once(load(spark, d, "chatml").select("chat_id", "messages"), "chat_id").select("chat_id", F.posexplode("messages").alias("turn", "m"))
    return m.select("chat_id", "turn", G.hidden_key(F.col("m.content")).alias("leaked")).where("leaked is not null")


_BAD = "(?i)^\\s*(this|that|these|those|than|and|or|of|from|to|a|an|the|such|similar|with|without|in|on|at|by|for|as|some|many|all|other|their|its|any|most|another|they|which|who|what|after|before|highly|large|small|high|low|very|quite|millions?|thousands?|hundreds?)\\b|^edu\\s+[0-9]+\\b"


@query(f"SELECT node_id, coalesce(n <> '' AND NOT regexp_matches(n, '{_BAD}') AND regexp_matches(n, '[A-Za-z]{{3,}}') AND NOT regexp_matches(n, '(?i)^[0-9][0-9\\s.\\-]*\\b(kJ|kcal|mol|moles?|mL|kg|kPa|MPa|bar|atm)\\b') AND NOT coalesce(regexp_matches(n, '^[0-9]') AND list_max(list_transform(regexp_extract_all(n, '[A-Za-z]+'), lambda x: length(x))) <= 3, false) AND len({_w('t')}) >= 10, false) AS ok FROM (SELECT node_id, trim(replace(name, '_', ' ')) AS n, source_context AS t FROM {_SKILL.format('name, source_context')})")
def concept_prefilter(spark, d):
    s = nodes(spark, d, "name", "source_context")
    return s.select("node_id", G.valid_concept(F.replace(F.col("name"), F.lit("_"), F.lit(" ")), F.col("source_context")).alias("ok"))


_VAGUE = ["one", "agents", "groves", "approaches", "much", "and", "the", "of", "in", "for", "to", "a", "an", "is", "are", "was", "be", "properties", "conditions", "process", "system", "material", "controls", "parameters", "results", "effects", "behavior", "data", "information", "analysis", "method", "methods", "values", "products", "solutions", "preparation", "applications", "performance", "stability", "activity", "efficiency", "quality", "characteristics", "features", "aspects", "factors", "variables"]
_PARTS = "under these conditions|much of such|because of|much effort|astm specifications|gevaert and fabelta|groves|40 different paper grades|6 000 000|20 000 acres|1990 sales|10 per annum|about 16|about 90|clinsol"
_LOW = "^[0-9][0-9\\s.,]*$|(?i)^[0-9][0-9\\s.,]*\\s*(per\\s+annum|acres|tons|patients|moles|million|billion|km|ml|g|kg|l\\b)|^(about|approximately)\\s+[0-9]|^(because|since)\\s+of\\s+favorable|^controls\\s+clinical|^autoscaling$|^about\\s+[0-9]+\\s+of\\s+these"
_TRIAGE = f"CASE WHEN len(w) = 0 OR length(c) < 2 OR regexp_matches(c, '{_LOW}') THEN 'remove_low_value' WHEN regexp_matches(c, '(?i)\\bqv\\b|\\bcf\\b|\\bhoc\\b|\\bc1\\s+o\\b|\\bc1\\b') OR (len(w) = 1 AND lower(c) IN ({_list(_VAGUE)})) OR regexp_matches(lower(c), '{_PARTS}') OR (len(w) = 1 AND upper(c) = c AND lower(c) <> c AND length(c) > 2 AND upper(c) NOT IN ({_list(G.ACRONYMS)})) OR (regexp_matches(w[1], '^[0-9]') AND len(w) <= 3 AND (len(w) = 1 OR length(w[2]) < 4)) OR (len(w) <= 4 AND lower(w[len(w)]) IN ('and', 'the', 'of', 'in', 'to', 'a', 'an', 'for', 'with', 'by', 'or')) THEN 'ambiguous_needs_uncertainty_target' ELSE 'valid_reasoning' END"


@query(f"SELECT class, count(*) AS n FROM (SELECT {_TRIAGE} AS class FROM (SELECT c, {_w('c')} AS w FROM (SELECT {_trim('coalesce(x, ' + chr(39) * 2 + ')')} AS c FROM (SELECT name AS x FROM {_SKILL.format('name')} UNION ALL SELECT replace(name, '_', ' ') FROM {_SKILL.format('name')} UNION ALL SELECT split_part(text, ' ', 1) FROM documents UNION ALL SELECT array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') FROM documents)))) GROUP BY class")
def concept_triage(spark, d):
    """Names, and the first words of documents, by whether they are concepts that one can reason about."""
    s, docs = nodes(spark, d, "name"), load(spark, d, "documents")
    x = s.select(F.col("name").alias("x")).unionByName(s.select(F.replace(F.col("name"), F.lit("_"), F.lit(" ")).alias("x")))
    first = F.split("text", " ")
    x = x.unionByName(docs.select(F.get(first, F.lit(0)).alias("x"))).unionByName(docs.select(F.array_join(F.slice(first, 1, 3), " ").alias("x")))
    return x.groupBy(G.triage(F.col("x")).alias("class")).agg(F.count("*").alias("n"))


_GENERIC = "(?i)" + "|".join(f"(?:{p})" for p in G.GENERIC_BOUNDARIES)


@query(f"SELECT node_id, CAST(len(c) AS INT) AS total, CAST(len(list_filter(c, lambda x: x IS NULL OR len({_w('x')}) < 7 OR regexp_matches(x, '{_GENERIC}'))) AS INT) AS generic FROM (SELECT DISTINCT node_id, teaching_layer.reasoning_vectors.constraints AS c FROM aletheia_skill) WHERE len(c) > 0")
def boundary_quality(spark, d):
    """How many of a node's constraints say nothing of their own."""
    s = nodes(spark, d, F.col("teaching_layer.reasoning_vectors.constraints").alias("c")).where("size(c) > 0")
    return s.select("node_id", F.size("c").alias("total"), F.size(F.filter("c", G.generic_boundary)).alias("generic"))


_ANSWER = "list_filter(messages, lambda m: m.role = 'assistant')[1].content"
_FINAL = f"CASE WHEN contains(a, '</think>') THEN trim(substr(a, strpos(a, '</think>') + 8)) ELSE trim(a) END"


@query(f"WITH c AS (SELECT chat_id, branch_count, {_ANSWER} AS a FROM {_CHATS.format('branch_count, messages')}) SELECT chat_id, round(10.0 * coalesce(branch_count, 0) - 3.0 * coalesce(len(list_filter(list_filter(list_transform(string_split(a, chr(10)), lambda x: trim(x)), lambda x: starts_with(x, 'Failure boundary:')), lambda x: len({_w('trim(substr(x, 18))')}) < 7 OR regexp_matches(x, '{_GENERIC}'))), 0) + coalesce(CASE WHEN contains(a, '</think>') THEN least(5.0, len({_w(_FINAL)}) / 20) ELSE 0 END, 0), 4) AS quality, CASE WHEN coalesce(branch_count, 0) <= 1 THEN 'uncertainty_abstention' WHEN branch_count = 2 THEN 'binary_regime' WHEN branch_count = 3 THEN 'ternary_regime' ELSE 'multi_regime' END AS cardinality FROM c")
def chat_row_quality(spark, d):
    m = records.once(load(spark, d, "chatml").select("chat_id", "branch_count", "messages"), "chat_id")
    a = m.select("chat_id", "branch_count", F.get(F.filter("messages", lambda x: x["role"] == "assistant"), F.lit(0))["content"].alias("a"))
    none = F.lit(None).cast("double")
    return a.select("chat_id", F.round(G.row_quality(F.col("branch_count"), none, none, F.col("a")), 4).alias("quality"), G.cardinality(F.col("branch_count")).alias("cardinality"))


_OR = lambda words: "|".join(words)


@query(f"SELECT doc_id, CASE WHEN regexp_matches(low, '{_OR(G.FAILING)}') OR regexp_matches(low, '{_OR(G.BRANCHING)}') THEN 'divergent' WHEN regexp_matches(low, '{_OR(G.CONDITIONAL)}') THEN 'conditional' ELSE 'linear' END AS structure, regexp_matches(low, '{_OR(G.CHANGING)}') AS transforms, round(len(list_distinct({_w('low')})) / greatest(len({_w('low')}), 1), 4) AS diversity FROM (SELECT doc_id, lower(text) AS low FROM documents WHERE text IS NOT NULL)")
def reasoning_structure(spark, d):
    t = load(spark, d, "documents").where("text is not null").select("doc_id", F.lower("text").alias("low"))
    low = F.col("low")
    return t.select("doc_id", G.structure(low).alias("structure"), T.any_of(low, G.CHANGING).alias("transforms"), F.round(G.diversity(low), 4).alias("diversity"))


_STEPS = "list_filter(string_split(text, '. '), lambda x: x <> '')"
_TW = _w("array_to_string(s, ' ')")


@query(f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN text IS NULL THEN 'missing_keys' WHEN len(s) < 3 OR len(s) > 8 THEN 'invalid_reasoning_length' WHEN len(list_filter(s, lambda x: regexp_matches(x, '[<>]'))) > 0 THEN 'unsafe_characters' WHEN len(list_filter(s, lambda x: len({_w('x')}) < 6)) > 0 THEN 'low_density_step' WHEN len({_w('text')}) < 40 THEN 'short_answer' WHEN NOT regexp_matches(text, '(?i)\\b(because|therefore|leads?\\s+to|results?\\s+in|consequently|due\\s+to)\\b') THEN 'weak_causal_signal' WHEN len(list_distinct({_TW})) / len({_TW}) < 0.5 THEN 'low_reasoning_entropy' WHEN len(list_distinct(s)) < len(s) * 0.7 THEN 'duplicate_steps' ELSE 'pass' END AS reason FROM (SELECT text, {_STEPS} AS s FROM documents)) GROUP BY reason")
def trace_gate(spark, d):
    """Documents as reasoning traces (their sentences) with an answer (themselves)."""
    t = load(spark, d, "documents").select("text", F.filter(F.split("text", "\\. "), lambda x: x != "").alias("s"))
    return t.groupBy(G.trace_reason(F.col("s"), F.col("text")).alias("reason")).agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT DISTINCT payload_id, output FROM payload) SELECT CASE WHEN output IS NULL OR NOT json_valid(output) OR json_type(output) <> 'OBJECT' THEN 'json_parse_fail' WHEN NOT json_exists(output, '$.reasoning_trace') OR NOT json_exists(output, '$.final_answer') THEN 'missing_keys' ELSE 'other' END AS reason, count(*) AS n FROM p GROUP BY 1")
def raw_answer_gate(spark, d):
    """Raw outputs that should be JSON with a trace and an answer: what is wrong with them first."""
    p = records.once(load(spark, d, "payload").select("payload_id", "output"), "payload_id")
    return p.groupBy(G.json_trace_reason(F.col("output")).alias("reason")).agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT DISTINCT payload_id, output FROM payload) SELECT CASE WHEN output IS NULL OR NOT json_valid(output) OR json_type(output) <> 'OBJECT' THEN 'json_parse_fail' WHEN json_extract_string(output, '$.error') = 'cannot_generate' THEN 'model_declined' WHEN coalesce(json_array_length(output, '$.branches'), 0) < 2 THEN 'insufficient_branches' ELSE 'other' END AS reason, count(*) AS n FROM p GROUP BY 1")
def raw_branch_gate(spark, d):
    p = records.once(load(spark, d, "payload").select("payload_id", "output"), "payload_id")
    return p.groupBy(G.json_branch_reason(F.col("output")).alias("reason")).agg(F.count("*").alias("n"))


_BARE = "lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(code_snippet, '#[^\\n]*', ' ', 'g'), '//[^\\n]*', ' ', 'g'), '(?s)/\\*.*?\\*/', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')))"
_TIGHT = "lower(regexp_replace(regexp_replace(code_snippet, '#[^\\n]*', '', 'g'), '[ \\t\\n\\r\\f]+', '', 'g'))"
_SAME = "regexp_matches(i, '^def[a-z0-9_]+\\(([a-z0-9_]+)\\)(?:->[a-z0-9_]+)?:return{}$') AND regexp_extract(i, '^def[a-z0-9_]+\\(([a-z0-9_]+)\\)', 1) = regexp_extract(i, 'return{}$', 1)"


@query(f"SELECT node_id, {' OR '.join(f'ends_with(b, {chr(39)}{e}{chr(39)})' for e in (': pass', ': ...', ': return none', ': raise notimplementederror', '{ }', '{ return ; }', '{ return null ; }'))} AS stub, ({_SAME.format('([a-z0-9_]+)', '([a-z0-9_]+)')}) OR regexp_matches(i, '^def[a-z0-9_]+\\(.*\\)(?:->[a-z0-9_]+)?:(?:pass|return|returnnone)$') OR ({_SAME.format('[a-z0-9_]+\\(([a-z0-9_]+)\\)', '[a-z0-9_]+\\(([a-z0-9_]+)\\)')}) AS identity FROM (SELECT node_id, {_BARE} AS b, {_TIGHT} AS i FROM {_SKILL.format('code_snippet')} WHERE code_snippet IS NOT NULL)")
def code_traps(spark, d):
    """Snippets that are stubs, or functions that do nothing with their argument."""
    s = nodes(spark, d, "code_snippet").where("code_snippet is not null")
    return s.select("node_id", G.trivial_stub(F.col("code_snippet")).alias("stub"), G.identity_function(F.col("code_snippet")).alias("identity"))


@query(f"SELECT source_kind, count(*) FILTER (coalesce(len(w) <= 500 AND regexp_matches(lower(text), 'index|contents|volume|edited by|bibliography') AND (length(text) - length(replace(text, chr(10), '')) > 3 OR len(w) > 200), false)) AS index_blocks, count(*) AS n FROM (SELECT source_kind, text, {_w('text')} AS w FROM documents) GROUP BY source_kind")
def index_blocks(spark, d):
    return load(spark, d, "documents").groupBy("source_kind").agg(F.count_if(G.index_block(F.col("text"))).alias("index_blocks"), F.count("*").alias("n"))


_R4 = "floor(({}) * 10000 + 0.5) / 10000"
_MARKS = " + ".join(f"contains(lower(t), '{w}')::INT" for w in ("because", "therefore", "constraint", "invariant", "however", "specifically", "requires", "implies"))
_DENSITY = f"CASE WHEN len({_w('t')}) > 0 THEN least(1.0::DOUBLE, least(len({_w('t')}) / 200.0::DOUBLE, 1.0::DOUBLE) * 0.5::DOUBLE + least(({_MARKS}) / 3.0::DOUBLE, 1.0::DOUBLE) * 0.3::DOUBLE + 0.2::DOUBLE) ELSE 0.0 END"


def r4(c):
    """Four digits, halves up; the same arithmetic in every engine."""
    return F.floor(c * 10000 + 0.5) / 10000


@query(f"SELECT node_id, {_R4.format(_DENSITY)} AS density FROM (SELECT node_id, source_context AS t FROM {_SKILL.format('source_context')} WHERE source_context IS NOT NULL)")
def prose_density(spark, d):
    s = nodes(spark, d, "source_context").where("source_context is not null")
    return s.select("node_id", r4(G.prose_density(F.col("source_context"))).alias("density"))


@query("WITH s AS (SELECT name, trim(regexp_replace(regexp_replace(name, '[^a-zA-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS c, lower(name) AS low FROM (SELECT DISTINCT node_id, name FROM aletheia_skill)) SELECT CASE WHEN length(c) BETWEEN 3 AND 40 AND regexp_matches(c, '[a-zA-Z]{3,}') THEN c ELSE 'this physical chemistry concept' END AS plain, CASE WHEN regexp_matches(low, 'process|synthesis|reaction|mechanism|pathway|cycle') THEN 'Explain the chemical mechanism and pathway of ' || name || '.' WHEN regexp_matches(low, 'law|theory|effect|principle|model|theorem') THEN 'Describe the theoretical framework and implications of ' || name || '.' WHEN regexp_matches(low, 'acid|base|metal|polymer|catalyst|oxide|isotope') THEN 'Describe the chemical properties and physical characteristics of ' || name || '.' ELSE 'Analyze the following chemical concept and explain its properties:' || chr(10) || chr(10) || name END AS prompt, count(*) AS n FROM s GROUP BY ALL")
def concept_prompts(spark, d):
    """Names made plain, and how each is asked for."""
    s = nodes(spark, d, "name")
    return s.groupBy(G.plain_name(F.col("name")).alias("plain"), G.prompt_for(F.col("name")).alias("prompt")).agg(F.count("*").alias("n"))


@query(f"SELECT node_id, md5({_trim('array_to_string(list_transform(regexp_split_to_array(regexp_replace(code_snippet, ' + chr(39) + '(' + chr(92) + 'r' + chr(92) + 'n|' + chr(92) + 'n|' + chr(92) + 'r)' + chr(92) + 'z' + chr(39) + ', ' + chr(39) * 2 + '), ' + chr(39) + chr(92) + 'r' + chr(92) + 'n|' + chr(92) + 'n|' + chr(92) + 'r' + chr(39) + '), lambda x: regexp_replace(regexp_replace(x, ' + chr(39) + '[ ' + chr(92) + 't' + chr(92) + 'f]+$' + chr(39) + ', ' + chr(39) * 2 + '), ' + chr(39) + '^[ ' + chr(92) + 't' + chr(92) + 'f]*[0-9]+[ ' + chr(92) + 't' + chr(92) + 'f]*' + chr(92) + '|[ ' + chr(92) + 't' + chr(92) + 'f]?' + chr(39) + ', ' + chr(39) * 2 + ')), chr(10))')}) AS digest FROM {_SKILL.format('code_snippet')} WHERE code_snippet IS NOT NULL")
def line_numbers_stripped(spark, d):
    s = nodes(spark, d, "code_snippet").where("code_snippet is not null")
    return s.select("node_id", F.md5(G.strip_line_numbers(F.col("code_snippet"))).alias("digest"))


_SENT = "string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g'), chr(1))"
_PCT = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(md5(text), ''), lambda c: (strpos('0123456789abcdef', c) - 1)::BIGINT)), lambda a, x: (a * 16 + x) % 100)"
_HAS = lambda c, words: "regexp_matches(lower(" + c + "), '" + "|".join(words) + "')"


@query(f"SELECT doc_id, md5(CASE WHEN p < 15 AND len(s) >= 4 AND {_HAS('r', T.CAUSAL)} AND {_HAS('r', T.TRANSFORM)} THEN r ELSE text END) AS digest FROM (SELECT *, array_to_string(list_concat(s[1:len(s) // 2], s[len(s) // 2 + 2:]), ' ') AS r FROM (SELECT doc_id, text, {_PCT} AS p, {_SENT} AS s FROM documents WHERE text IS NOT NULL))")
def masked_reasoning(spark, d):
    """Texts with the middle sentence left out of 15 in 100 of them."""
    return load(spark, d, "documents").where("text is not null").select("doc_id", F.md5(G.mask_middle(F.col("text"))).alias("digest"))


@query(f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN {_trim('lower(coalesce(source_context, ' + chr(39) * 2 + '))')} IN ('', 'pending analysis', 'unknown', 'unspecified', 'tbd') THEN 'placeholder' ELSE 'text' END AS kind FROM {_SKILL.format('source_context')}) GROUP BY kind")
def placeholder_texts(spark, d):
    s = nodes(spark, d, "source_context")
    return s.groupBy(F.when(G.clean_field(F.col("source_context")) == "", "placeholder").otherwise("text").alias("kind")).agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT DISTINCT chat_id, messages FROM chatml) SELECT chat_id, CASE WHEN len(messages) > 0 THEN (length(array_to_string(list_transform(messages, lambda m: concat('<|', coalesce(m.role, 'unknown'), '|>', chr(10), coalesce(m.content, ''), chr(10))), chr(10))) + 3) // 4 + 2 + 4 * len(messages) ELSE 0 END AS est_tokens FROM c")
def chat_token_estimate(spark, d):
    m = records.once(load(spark, d, "chatml").select("chat_id", "messages"), "chat_id")
    return m.select("chat_id", G.chat_tokens(F.col("messages")).alias("est_tokens"))


_RV = "teaching_layer.reasoning_vectors"


@query(f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN i IS NULL AND s IS NULL AND c IS NULL THEN 'missing_epistemic_core' WHEN i IS NULL OR i IN ('', 'unknown') OR s IS NULL OR s IN ('', 'unknown') OR c IS NULL OR len(c) = 0 OR len(list_filter(c, lambda x: x <> 'unknown')) = 0 THEN 'incomplete_epistemic_core' WHEN (coalesce(length(code_snippet), 0) + 3) // 4 >= 2048 THEN 'token_limit_exceeded' WHEN regexp_matches(code_snippet, '\\[REDACTED\\]|<insert_key>|TODO:|pass\\b|FIXME:') THEN 'placeholder_detected' ELSE 'all_invariants_passed' END AS reason FROM (SELECT DISTINCT node_id, {_RV}.intent AS i, {_RV}.strategy AS s, {_RV}.constraints AS c, code_snippet FROM aletheia_skill)) GROUP BY reason")
def skill_validation(spark, d):
    """Skills by the first reason that rejects them."""
    s = nodes(spark, d, F.col(f"{_RV}.intent").alias("i"), F.col(f"{_RV}.strategy").alias("s"), F.col(f"{_RV}.constraints").alias("c"), "code_snippet")
    r = G.skill_reason(F.col("i"), F.col("s"), F.col("c"), F.col("code_snippet"), T.token_estimate(F.col("code_snippet")))
    return s.groupBy(r.alias("reason")).agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT DISTINCT payload_id, node_id, instruction FROM payload) SELECT CASE WHEN node_id <> '' THEN node_id ELSE 'line:' || payload_id || ':sha:' || substr(sha256(instruction), 1, 12) END AS identity, count(*) AS n FROM p GROUP BY 1")
def record_identity(spark, d):
    """What names a record: its node, else a digest."""
    p = records.once(load(spark, d, "payload").select("payload_id", "node_id", "instruction"), "payload_id")
    line = F.concat(F.lit("line:"), F.col("payload_id").cast("string"), F.lit(":sha:"), F.substring(F.sha2("instruction", 256), 1, 12))
    return p.groupBy(F.when(F.col("node_id") != "", F.col("node_id")).otherwise(line).alias("identity")).agg(F.count("*").alias("n"))


@query("SELECT node_id, array_to_string(list_sort(list_distinct(imports)), ',') AS modules FROM (SELECT DISTINCT node_id, imports FROM aletheia_skill) WHERE imports IS NOT NULL")
def stable_lists(spark, d):
    """Lists without repeats, in order."""
    return nodes(spark, d, "imports").where("imports is not null").select("node_id", F.array_join(F.array_sort(F.array_distinct("imports")), ",").alias("modules"))
