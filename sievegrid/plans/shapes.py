"""Queries that reshape nodes and payloads: identities, lineage, contracts, signatures, prompts, chunks and overlaps."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import gates as G
from ..functions import scoring as S
from ..functions import text as T
from ..operators import lineage as L
from ..operators import records, similar
from ..sources.tables import load
from . import nodes as N
from .registry import query
from .texts import _w


def nodes(spark, d, *columns):
    return records.once(load(spark, d, "aletheia_skill").select("node_id", *columns), "node_id")


@query("WITH c AS (SELECT lower(trim(source)) AS source, mode, count(*) AS n FROM documents WHERE mode IS NOT NULL AND trim(source) <> '' GROUP BY ALL) SELECT source, arg_min(mode, (-n, mode)) AS mode, max(n) AS n FROM c GROUP BY source")
def dominant_mode(spark, d):
    """The commonest mode of each source; the first of the alphabet where several are."""
    c = load(spark, d, "documents").where("mode is not null and trim(source) <> ''").groupBy(F.lower(F.trim("source")).alias("source"), "mode").agg(F.count("*").alias("n"))
    return c.groupBy("source").agg(F.min_by("mode", F.struct((-F.col("n")).alias("k"), "mode")).alias("mode"), F.max("n").alias("n"))


_CLASS = "CASE WHEN regexp_matches(lower({0}), 'cuda|gpu|tensor|cufft|torch|jax') THEN 'compute.accelerated' WHEN regexp_matches(lower({0}), 'sql|db|mongo|redis|query') THEN 'io.database' WHEN regexp_matches(lower({0}), 'http|request|fetch|socket') THEN 'io.network' ELSE 'compute.generic' END"


def operation_class(c):
    low = F.lower(c)
    return F.when(low.rlike("cuda|gpu|tensor|cufft|torch|jax"), "compute.accelerated").when(low.rlike("sql|db|mongo|redis|query"), "io.database").when(low.rlike("http|request|fetch|socket"), "io.network").otherwise("compute.generic")


def lineage(calls, mutations):
    """Steps (step, operation_class, raw_call, input, output) of calls in order; the last writes the first mutation, if any."""
    n = F.size(calls)
    return F.transform(
        calls,
        lambda c, i: F.struct(
            (i + 1).alias("step"), operation_class(c).alias("operation_class"), c.alias("raw_call"),
            F.when(i == 0, "args").otherwise(F.concat(F.lit("internal_state_"), (i - 1).cast("string"))).alias("input"),
            F.when((i == n - 1) & (F.size(mutations) > 0), F.get(mutations, F.lit(0))).otherwise(F.concat(F.lit("internal_state_"), i.cast("string"))).alias("output"),
        ),
    )


@query(f"WITH s AS (SELECT DISTINCT node_id, imports AS c, dependencies.downstream_calls AS m FROM aletheia_skill), t AS (SELECT *, unnest(range(len(c))) AS i FROM s) SELECT node_id, CAST(i + 1 AS INT) AS step, {_CLASS.format('c[i + 1]')} AS operation_class, c[i + 1] AS raw_call, CASE WHEN i = 0 THEN 'args' ELSE 'internal_state_' || (i - 1) END AS input, CASE WHEN i = len(c) - 1 AND len(m) > 0 THEN m[1] ELSE 'internal_state_' || i END AS output FROM t")
def call_lineage(spark, d):
    """What each node uses, as steps that hand their state on."""
    s = nodes(spark, d, F.col("imports").alias("c"), F.col("dependencies.downstream_calls").alias("m")).where("size(c) > 0")
    return s.select("node_id", F.explode(lineage(F.col("c"), F.col("m"))).alias("x")).select("node_id", "x.*")


_CAN = "'SKILL_' || upper(coalesce(cat, 'unknown')) || '_' || substr(sha256(concat_ws('|', coalesce(op, ''), array_to_string(list_sort(coalesce(imports, [])), ','), sha256(coalesce(code, '')), sha256(regexp_replace(coalesce(code, ''), '[ \\t\\n\\r\\f]+', '', 'g')), coalesce(len(calls), 0)::VARCHAR)), 1, 10)"


@query(f"WITH s AS (SELECT DISTINCT node_id, teaching_layer.skill_identity['category'] AS cat, operator_type AS op, imports, code_snippet AS code, dependencies.downstream_calls AS calls, file, name FROM aletheia_skill), k AS (SELECT node_id, file, name, {_CAN} AS canonical_id FROM s) SELECT node_id, canonical_id, substr(sha256(concat_ws('|', canonical_id, coalesce(file, ''), coalesce(name, ''))), 1, 12) AS instance_id FROM k")
def dual_identity(spark, d):
    """What a node does, whoever holds it, and the one place where it stands."""
    s = nodes(spark, d, F.col("teaching_layer.skill_identity").getItem("category").alias("cat"), "operator_type", "imports", F.coalesce("code_snippet", F.lit("")).alias("code"), F.col("dependencies.downstream_calls").alias("calls"), "file", "name")
    n = F.greatest(F.coalesce(F.size("calls"), F.lit(0)), F.lit(0)).cast("string")
    body = F.concat_ws("|", F.coalesce("operator_type", F.lit("")), F.array_join(F.array_sort(F.coalesce("imports", F.array().cast("array<string>"))), ","), F.sha2("code", 256), F.sha2(F.regexp_replace("code", "[ \\t\\n\\r\\f]+", ""), 256), n)
    k = s.select("node_id", "file", "name", F.concat(F.lit("SKILL_"), F.upper(F.coalesce("cat", F.lit("unknown"))), F.lit("_"), F.substring(F.sha2(body, 256), 1, 10)).alias("canonical_id"))
    return k.select("node_id", "canonical_id", F.substring(F.sha2(F.concat_ws("|", "canonical_id", F.coalesce("file", F.lit("")), F.coalesce("name", F.lit(""))), 256), 1, 12).alias("instance_id"))


_DRIFT = "irer|resonance field|sse 0\\.00087|nura physics|omega handshake|bounded inevitability"


def contract_reason(*required):
    """Why an output breaks its mode's contract, or 'valid': a required part missing or empty, or a forbidden token in any."""
    bad = F.lit(False)
    drift = F.lit(False)
    for c in required:
        bad = bad | F.coalesce(c, F.lit("")).isin("")
        drift = drift | F.coalesce(T.firewall(c).isNotNull(), F.lit(False))
    return F.when(bad, "missing_field").when(drift, "drift_violation").otherwise("valid")


@query(f"WITH u AS (SELECT 'advocate' AS mode, coalesce(theory_text, '') = '' OR coalesce(implementation_code, '') = '' AS bad, lower(concat(theory_text, ' ', implementation_code)) AS low FROM (SELECT DISTINCT payload_id, theory_text, implementation_code FROM advocate_payload) UNION ALL SELECT 'coding_assistant', coalesce(code_snippet, '') = '', lower(code_snippet) FROM (SELECT DISTINCT node_id, code_snippet FROM aletheia_skill) UNION ALL SELECT 'theorist', coalesce(x, '') = '', lower(x) FROM (SELECT unnest(payloads).chunk_text AS x FROM (SELECT DISTINCT request_id, payloads FROM score_request))) SELECT mode, CASE WHEN bad THEN 'missing_field' WHEN regexp_matches(low, '{_DRIFT}') THEN 'drift_violation' ELSE 'valid' END AS reason, count(*) AS n FROM u GROUP BY ALL")
def mode_contracts(spark, d):
    """Outputs of each mode by what their contract says."""
    a = records.once(load(spark, d, "advocate_payload").select("payload_id", "theory_text", "implementation_code"), "payload_id").select(F.lit("advocate").alias("mode"), contract_reason(F.col("theory_text"), F.col("implementation_code")).alias("reason"))
    c = nodes(spark, d, "code_snippet").select(F.lit("coding_assistant").alias("mode"), contract_reason(F.col("code_snippet")).alias("reason"))
    t = records.once(load(spark, d, "score_request").select("request_id", "payloads"), "request_id").select(F.explode("payloads").alias("p")).select(F.lit("theorist").alias("mode"), contract_reason(F.col("p.chunk_text")).alias("reason"))
    return a.unionByName(c).unionByName(t).groupBy("mode", "reason").agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT DISTINCT node_id, name, epistemic AS e, code_snippet AS c FROM aletheia_skill) SELECT node_id, CASE WHEN e IS NULL THEN 'REJECTED' WHEN name = '' OR name IS NULL THEN 'REJECTED' WHEN e.c_node IS NULL OR e.c_node < 0 OR e.c_node > 1 THEN 'REJECTED' ELSE coalesce(e.state, 'CREATED') END AS state, CASE WHEN e IS NULL THEN 'missing_epistemic' WHEN name = '' OR name IS NULL THEN 'missing_name' WHEN e.c_node IS NULL OR e.c_node < 0 OR e.c_node > 1 THEN 'confidence_out_of_range' ELSE 'ok' END AS contained FROM s")
def ingress_contract(spark, d):
    """Nodes that break the contract at the door are kept, as rejected ones with their reason."""
    s = nodes(spark, d, "name", "epistemic")
    e = F.col("epistemic")
    why = F.when(e.isNull(), "missing_epistemic").when(F.col("name").isNull() | (F.col("name") == ""), "missing_name").when(e["c_node"].isNull() | ~e["c_node"].between(0, 1), "confidence_out_of_range").otherwise("ok")
    s = s.withColumn("contained", why)
    return s.select("node_id", F.when(F.col("contained") != "ok", "REJECTED").otherwise(F.coalesce(e["state"], F.lit("CREATED"))).alias("state"), "contained")


@query("WITH r AS (SELECT DISTINCT request_id, mode FROM score_request) SELECT coalesce(lower(trim(mode)) IN ('theorist', 'coding_assistant', 'advocate', 'veteran'), false) AS valid, count(*) AS n FROM r GROUP BY 1")
def phase_contract(spark, d):
    """Requests whose mode is one that can be run."""
    r = records.once(load(spark, d, "score_request").select("request_id", "mode"), "request_id")
    return r.groupBy(F.coalesce(F.lower(F.trim("mode")).isin(*S.SCALE), F.lit(False)).alias("valid")).agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT DISTINCT node_id, epistemic.state AS state, name, code_snippet AS c FROM aletheia_skill) SELECT coalesce(state IN ('ACCEPTED', 'terminal'), false) AS survives, name IS NOT NULL AND c IS NOT NULL AS routable, count(*) AS n FROM s GROUP BY ALL")
def survival_gate(spark, d):
    """Nodes that live on, and whether a chat could be made of them."""
    s = nodes(spark, d, F.col("epistemic.state").alias("state"), "name", "code_snippet")
    return s.groupBy(F.coalesce(F.col("state").isin("ACCEPTED", "terminal"), F.lit(False)).alias("survives"), (F.col("name").isNotNull() & F.col("code_snippet").isNotNull()).alias("routable")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS todo FROM (SELECT DISTINCT node_id FROM aletheia_skill) WHERE substr(md5(node_id), 1, 12) NOT IN (SELECT substr(md5(node_id), 1, 12) FROM advocate_payload WHERE node_id IS NOT NULL)")
def resume_filter(spark, d):
    """What is still to be done: nodes whose short digest no payload has."""
    done = load(spark, d, "advocate_payload").where("node_id is not null").select(F.substring(F.md5("node_id"), 1, 12).alias("h")).distinct()
    return load(spark, d, "aletheia_skill").select("node_id").distinct().select(F.substring(F.md5("node_id"), 1, 12).alias("h")).join(done, "h", "left_anti").agg(F.count("*").alias("todo"))


@query("WITH p AS (SELECT x.vec_id AS a, y.vec_id AS b, x.label AS la, y.label AS lb FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.95) SELECT DISTINCT CASE WHEN la >= lb THEN b ELSE a END AS loser FROM p")
def redundancy_losers(spark, d):
    """Of two vectors that say the same, the one with the lower label goes; of equals the later."""
    e = load(spark, d, "embeddings")
    p = similar.every_pair(e, "vec_id", "embedding")
    x, y = e.select(F.col("vec_id").alias("a"), F.col("label").alias("la")), e.select(F.col("vec_id").alias("b"), F.col("label").alias("lb"))
    return p.join(x, "a").join(y, "b").select(F.when(F.col("la") >= F.col("lb"), F.col("b")).otherwise(F.col("a")).alias("loser")).distinct()


_GRAMS = "list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]))"
_WORDS5 = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9_]+'), lambda x: x <> '')"


def five_grams(df, key, text):
    """(key, h): the hashes of every five words in a row."""
    w = T.ascii_words(F.col(text))
    n = F.size("_w") - 4
    grams = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice("_w", i + 1, F.lit(5)), " "))))
    return df.select(key, w.alias("_w")).select(key, F.explode(grams).alias("h"))


@query(f"WITH d AS (SELECT doc_id, unnest({_GRAMS}) AS g FROM (SELECT doc_id, {_WORDS5.format('text')} AS w FROM documents) WHERE len(w) >= 5), q AS (SELECT DISTINCT unnest({_GRAMS}) AS g FROM (SELECT {_WORDS5.format('output')} AS w FROM payload) WHERE len(w) >= 5) SELECT doc_id, count(*) AS shared FROM d SEMI JOIN q USING (g) GROUP BY doc_id")
def reference_overlap(spark, d):
    """Documents that share five words in a row with an output, and how many such."""
    docs = five_grams(load(spark, d, "documents"), "doc_id", "text").distinct()
    refs = five_grams(load(spark, d, "payload"), "payload_id", "output").select("h").distinct()
    return docs.join(refs, "h", "left_semi").groupBy("doc_id").agg(F.count("*").alias("shared"))


@query("WITH n AS (SELECT DISTINCT node_id, project_name, epistemic.c_node AS c, dependencies.downstream_calls AS calls FROM aletheia_skill), k AS (SELECT project_name, count(*) AS nodes, sum(coalesce(len(calls), 0))::BIGINT AS calls FROM n GROUP BY 1) SELECT project_name, nodes, calls, nodes < 5 OR calls = 0 AS sparse FROM k")
def sparsity_counts(spark, d):
    s = nodes(spark, d, "project_name", F.col("dependencies.downstream_calls").alias("calls"))
    k = s.groupBy("project_name").agg(F.count("*").alias("nodes"), F.sum(F.greatest(F.coalesce(F.size("calls"), F.lit(0)), F.lit(0))).alias("calls"))
    return k.select("project_name", "nodes", "calls", ((F.col("nodes") < 5) | (F.col("calls") == 0)).alias("sparse"))


@query("WITH n AS (SELECT DISTINCT node_id, skill_type, epistemic.state AS state, epistemic.c_node AS c, imports FROM aletheia_skill WHERE epistemic.state IN ('ACCEPTED', 'VALIDATED')) SELECT CASE WHEN state = 'ACCEPTED' THEN 'axiom' ELSE 'pattern' END AS kind, coalesce(skill_type, '-') AS skill_type, count(*) AS nodes, round(avg(c), 4) AS confidence, array_to_string(list_sort(list_distinct(flatten(list(coalesce(imports, []))))), ',') AS evidence FROM n GROUP BY ALL")
def collapsed_axioms(spark, d):
    """Nodes that hold, as axioms and patterns, with their mean confidence and all they rest on."""
    n = nodes(spark, d, "skill_type", F.col("epistemic.state").alias("state"), F.col("epistemic.c_node").alias("c"), "imports").where(F.col("state").isin("ACCEPTED", "VALIDATED"))
    n = n.withColumn("kind", F.when(F.col("state") == "ACCEPTED", "axiom").otherwise("pattern")).withColumn("skill_type", F.coalesce("skill_type", F.lit("-")))
    mean = n.groupBy("kind", "skill_type").agg(F.count("*").alias("nodes"), F.round(F.avg("c"), 4).alias("confidence"))
    # Modules are few; each group's set is made of partial sets.
    ev = n.select("kind", "skill_type", F.explode("imports").alias("m")).distinct().groupBy("kind", "skill_type").agg(F.array_join(F.sort_array(F.collect_set("m")), ",").alias("evidence"))
    return mean.join(ev, ["kind", "skill_type"], "left").withColumn("evidence", F.coalesce("evidence", F.lit("")))


@query(f"WITH l AS (SELECT text FROM documents WHERE text <> '' ORDER BY added_at DESC NULLS LAST, doc_id LIMIT 5000), w AS (SELECT unnest({_w('text')}) AS w FROM l), c AS (SELECT w, count(*) AS c FROM w GROUP BY w), t AS (SELECT sum(c) AS s FROM c) SELECT round(-sum(c / s * log2(c / s)), 4) AS entropy, round(-sum(c / s * log2(c / s)), 4) >= 3.5 OR (SELECT count(*) FROM l) <= 10 AS kept FROM c, t")
def window_entropy(spark, d):
    """Entropy of the words of the last five thousand texts: the feature is the window; a dull one fails."""
    last = load(spark, d, "documents").where("text <> ''").orderBy(F.desc_nulls_last("added_at"), "doc_id").limit(5000).select("text")
    c = last.select(F.explode(T.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    e = c.agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.log2("c")).alias("x")).select(F.round(F.log2("s") - F.col("x") / F.col("s"), 4).alias("entropy"))
    return e.join(last.agg(F.count("*").alias("n"))).select("entropy", ((F.col("entropy") >= 3.5) | (F.col("n") <= 10)).alias("kept"))


_CALLERS = "coalesce(len(dependencies.upstream_callers), 0)"


@query(f"WITH s AS (SELECT DISTINCT node_id, {_CALLERS} AS callers FROM aletheia_skill), r AS (SELECT *, row_number() OVER (ORDER BY callers, node_id) - 1 AS i FROM s) SELECT node_id, i // 500 AS chunk FROM r")
def dependency_chunks(spark, d):
    """Nodes in the order of their callers' number and their key, in chunks of five hundred."""
    s = nodes(spark, d, F.greatest(F.coalesce(F.size("dependencies.upstream_callers"), F.lit(0)), F.lit(0)).alias("callers"))
    # Shares follow the order of the keys, so ranks are counts before a share and a place inside it.
    s = s.withColumn("_s", F.expr("substring(node_id, 1, length(node_id) - 3)"))
    share = s.groupBy("callers", "_s").agg(F.count("*").alias("_c"))
    before = Window.orderBy("callers", "_s").rowsBetween(Window.unboundedPreceding, -1)
    share = share.withColumn("_o", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    r = s.withColumn("_n", F.row_number().over(Window.partitionBy("callers", "_s").orderBy("node_id"))).join(share, ["callers", "_s"])
    return r.select("node_id", F.floor((F.col("_o") + F.col("_n") - 1) / 500).alias("chunk"))


@query("WITH c AS (SELECT DISTINCT chat_id, messages FROM chatml) SELECT chat_id, md5(array_to_string(list_transform(messages, lambda m: '<|im_start|>' || coalesce(m.role, '') || chr(10) || coalesce(m.content, '') || '<|im_end|>'), chr(10))) AS digest FROM c WHERE len(messages) > 0")
def chat_texts(spark, d):
    """Chats as one text by the template that training reads."""
    m = records.once(load(spark, d, "chatml").select("chat_id", "messages"), "chat_id").where("size(messages) > 0")
    turn = lambda x: F.concat(F.lit("<|im_start|>"), F.coalesce(x["role"], F.lit("")), F.lit("\n"), F.coalesce(x["content"], F.lit("")), F.lit("<|im_end|>"))
    return m.select("chat_id", F.md5(F.array_join(F.transform("messages", turn), "\n")).alias("digest"))


@query("WITH s AS (SELECT DISTINCT node_id, name, code_snippet AS c, source_context AS t, epistemic.state AS state FROM aletheia_skill WHERE epistemic.state IN ('ACCEPTED', 'VALIDATED')), k AS (SELECT node_id, trim(regexp_replace(regexp_replace(name, '[^a-zA-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS p, replace(replace(c, '\\n', chr(10)), '\\t', chr(9)) AS u, coalesce(length(trim(t)) >= 80 AND NOT regexp_matches(lower(t), '\\b(table|fig\\.?|figure) [0-9]'), false) AS usable FROM s) SELECT node_id, CASE WHEN length(p) BETWEEN 3 AND 40 AND regexp_matches(p, '[a-zA-Z]{3,}') THEN p ELSE 'this physical chemistry concept' END AS concept, md5(u) AS digest, usable FROM k")
def bridged_nodes(spark, d):
    """Validated nodes as rows to write about: plain names, snippets with real line ends, and whether their context can be used."""
    s = nodes(spark, d, "name", "code_snippet", "source_context", F.col("epistemic.state").alias("state")).where(F.col("state").isin("ACCEPTED", "VALIDATED"))
    return s.select("node_id", G.plain_name(F.col("name")).alias("concept"), F.md5(G.unescape(F.col("code_snippet"))).alias("digest"), T.usable(F.col("source_context")).alias("usable"))


@query("WITH s AS (SELECT DISTINCT node_id, lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)) AS e FROM aletheia_skill) SELECT CASE WHEN e = 'py' THEN 'python_ast' WHEN e IN ('c', 'h', 'cpp', 'hpp', 'cc', 'rs', 'java', 'rb', 'cs', 'cu', 'js', 'mjs', 'ts', 'tsx') THEN 'polyglot' WHEN e = 'sql' THEN 'sql_lineage' WHEN e IN ('json', 'yaml', 'yml', 'toml') THEN 'key_sketch' WHEN e IN ('md', 'txt', 'rst') THEN 'text' ELSE 'none' END AS analyzer, count(*) AS nodes FROM s GROUP BY 1")
def analyzer_routes(spark, d):
    """Which analyzer a file goes to, by its ending."""
    e = F.lower(F.regexp_extract("file", "\\.([A-Za-z0-9]+)$", 1))
    r = F.when(e == "py", "python_ast").when(e.isin("c", "h", "cpp", "hpp", "cc", "rs", "java", "rb", "cs", "cu", "js", "mjs", "ts", "tsx"), "polyglot").when(e == "sql", "sql_lineage").when(e.isin("json", "yaml", "yml", "toml"), "key_sketch").when(e.isin("md", "txt", "rst"), "text").otherwise("none")
    return nodes(spark, d, "file").groupBy(r.alias("analyzer")).agg(F.count("*").alias("nodes"))


_SET = "array_to_string(list_sort(list_distinct(list_concat(string_split(coalesce(i, ''), ' '), string_split(coalesce(s, ''), ' ')))), ' ')"


@query(f"WITH n AS (SELECT DISTINCT node_id, project_name, created_at, teaching_layer.reasoning_vectors.intent AS i, teaching_layer.reasoning_vectors.strategy AS s, teaching_layer.reasoning_vectors.constraints AS c FROM aletheia_skill), h AS (SELECT *, sha256(concat_ws('|', {_SET}, coalesce(len(c), 0)::VARCHAR)) AS sig FROM n) SELECT node_id, sig AS signature, substr(sha256(concat_ws('|', coalesce(lag(sig, 1) OVER w, ''), coalesce(lag(sig, 2) OVER w, ''), coalesce(lag(sig, 3) OVER w, ''))), 1, 16) AS context FROM h WINDOW w AS (PARTITION BY project_name ORDER BY created_at, node_id)")
def semantic_signatures(spark, d):
    """A digest of what a node says and of the three before it in its project."""
    rv = F.col("teaching_layer.reasoning_vectors")
    n = nodes(spark, d, "project_name", "created_at", rv.alias("rv"))
    words = F.array_join(F.array_sort(F.array_distinct(F.concat(F.split(F.coalesce("rv.intent", F.lit("")), " "), F.split(F.coalesce("rv.strategy", F.lit("")), " ")))), " ")
    arity = F.greatest(F.coalesce(F.size("rv.constraints"), F.lit(0)), F.lit(0)).cast("string")
    h = n.select("node_id", "project_name", "created_at", F.sha2(F.concat_ws("|", words, arity), 256).alias("sig"))
    w = Window.partitionBy("project_name").orderBy("created_at", "node_id")
    before = [F.coalesce(F.lag("sig", k).over(w), F.lit("")) for k in (1, 2, 3)]
    return h.select("node_id", F.col("sig").alias("signature"), F.substring(F.sha2(F.concat_ws("|", *before), 256), 1, 16).alias("context"))


@query(f"WITH RECURSIVE {N._NODES}, {N._EDGES}, k AS (SELECT src AS node, dst AS nb FROM e UNION SELECT dst, src FROM e), deg AS (SELECT node, count(*) AS deg FROM k GROUP BY node), r AS (SELECT k.node, k.nb, row_number() OVER (PARTITION BY k.node ORDER BY deg.deg DESC, k.nb) AS i FROM k JOIN deg ON deg.node = k.nb) SELECT node, nb FROM r WHERE i <= 2")
def pruned_clusters(spark, d):
    """The two best linked neighbours of each node: the cut is the feature."""
    e = N.edges(nodes(spark, d, F.col("dependencies.downstream_calls").alias("calls")))
    k = e.select(F.col("src").alias("node"), F.col("dst").alias("nb")).unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("nb"))).distinct()
    deg = k.groupBy(F.col("node").alias("nb")).agg(F.count("*").alias("deg"))
    # The best two by partial sorts within the aggregate, so that a hub's neighbours do not meet in a window.
    top = k.join(deg, "nb").groupBy("node").agg(F.min(F.struct((-F.col("deg")).alias("k"), "nb")).alias("a"))
    rest = k.join(deg, "nb").join(top, "node").where(F.struct((-F.col("deg")).alias("k"), F.col("nb")) > F.col("a")).groupBy("node").agg(F.min(F.struct((-F.col("deg")).alias("k"), "nb")).alias("a"))
    return top.select("node", "a.nb").unionByName(rest.select("node", "a.nb"))


@query(f"WITH {N._BASE}, x AS (SELECT dst, bool_and(coalesce(len(p.cons), 0) > 0) AS ok FROM e JOIN n p ON p.node_id = e.src GROUP BY dst) SELECT s.node_id, CASE WHEN coalesce(x.ok, true) THEN coalesce(c, 0) ELSE 0 END AS c_final, CASE WHEN coalesce(x.ok, true) THEN sie ELSE 0 END AS flow FROM s LEFT JOIN x ON x.dst = s.node_id")
def cognitive_overlay(spark, d):
    """Confidence and flow of information, nothing where a caller has no constraint that holds."""
    n = N.base(spark, d)
    p = n.select(F.col("node_id").alias("src"), (F.coalesce(F.size("cons"), F.lit(0)) > 0).alias("has"))
    ok = N.edges(n).join(p, "src").groupBy(F.col("dst").alias("node_id")).agg(F.bool_and("has").alias("ok"))
    j = n.join(ok, "node_id", "left").withColumn("ok", F.coalesce("ok", F.lit(True)))
    return j.select("node_id", F.when(F.col("ok"), F.coalesce("c", F.lit(0.0))).otherwise(0.0).alias("c_final"), F.when(F.col("ok"), F.col("sie")).otherwise(0.0).alias("flow"))


@query("WITH s AS (SELECT DISTINCT node_id, source_context AS t, operator_type AS op FROM aletheia_skill) SELECT CASE WHEN t IS NULL THEN 'null' WHEN json_valid(t) AND json_type(t) = 'OBJECT' THEN 'object' ELSE 'text' END AS context, coalesce(op, '') <> '' AS typed, count(*) AS n FROM s GROUP BY ALL")
def context_coercion(spark, d):
    """Contexts that are objects, texts or nothing, and whether their node names an operator."""
    s = nodes(spark, d, F.col("source_context").alias("t"), F.col("operator_type").alias("op"))
    k = F.when(F.col("t").isNull(), "null").when(F.json_object_keys("t").isNotNull(), "object").otherwise("text")
    return s.groupBy(k.alias("context"), (F.coalesce("op", F.lit("")) != "").alias("typed")).agg(F.count("*").alias("n"))


@query(f"WITH {N._BASE}, {N._SCORED}, q AS (SELECT node_id, budget, CASE WHEN c_final >= 0.4e0 AND broken THEN 'parent_chain_failed' WHEN c_final >= 0.4e0 AND after < 0.4e0 THEN 'soft_parent_cascade' WHEN c_final >= 0.25e0 AND c_final < 0.4e0 THEN 'instability_band' END AS reason, after FROM h) SELECT node_id, reason, budget - 1 AS budget_left, md5(concat_ws('|', node_id, reason, budget::VARCHAR)) AS fingerprint FROM q WHERE budget > 0 AND reason IN ('soft_parent_cascade', 'instability_band') AND (reason = 'instability_band' OR after >= 0.25e0)")
def reroll_contexts(spark, d):
    """What a node that is tried again is told: why it failed, and how often it may still try."""
    h = N.scored(spark, d).withColumn("decision", S.decision(F.col("c_final"), F.col("after"), ~F.col("broken"), F.col("budget"))).where(F.col("decision").startswith("REROLL"))
    reason = F.substring("decision", 9, 99)
    return h.select("node_id", reason.alias("reason"), (F.col("budget") - 1).alias("budget_left"), F.md5(F.concat_ws("|", "node_id", reason, F.col("budget").cast("string"))).alias("fingerprint"))


@query()
def polyglot_slices(spark, d):
    """Functions and types of the nodes in languages with braces."""
    s = nodes(spark, d, "file", "code_snippet").where(F.lower("file").rlike("\\.(js|mjs|ts|java|c|h|cpp|cs|rs)$"))
    return L.polyglot_slices(s, "node_id", "code_snippet").select("key", "name", "kind", "first", "last", F.size("calls").alias("calls"))


@query()
def reasoning_vectors(spark, d):
    """What the Python nodes say, assert, catch and do, by their syntax."""
    s = nodes(spark, d, "file", "code_snippet").where(F.lower("file").endswith(".py"))
    v = L.reasoning_vectors(s, "node_id", "code_snippet")
    return v.groupBy("strategy").agg(F.count("*").alias("nodes"), F.count_if(F.size("constraints") > 0).alias("asserting"), F.count_if(F.size("failure_modes") > 0).alias("catching"))
