"""Queries on sentences, capabilities and identities: classes by verbs, signals, drift, clusters.

There is no dependency parser here: the first word of a sentence that is a form
of a known verb stands for its root, and every such word for a frame.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import records
from ..sources.tables import load
from .registry import query

# Verbs of the discourse labels and of the pipeline types, in the order in which they are asked.
DISCOURSE = {"hypothesis": ["propose", "suggest", "assume"], "evidence": ["show", "demonstrate", "find"], "method": ["apply", "use", "compute"], "summary": ["conclude", "summarize"], "claim": ["state", "argue"]}
TYPES = {"procedural": ["method", "apply", "compute"], "analytical": ["analyze", "evaluate", "compare"], "descriptive": ["describe", "define", "explain"], "causal": ["cause", "lead", "result"], "evidential": ["show", "demonstrate", "find"], "hypothetical": ["propose", "suggest", "assume"], "instructional": ["step", "process", "guide"], "diagnostic": ["detect", "identify", "measure"]}
EXECUTION = ["apply", "compute", "implement"]
#: Endings of a verb's forms; those that end in e take them without it, too.
ENDINGS = ["", "s", "es", "d", "ed", "ing"]
VERBS = sorted({w for d in (DISCOURSE, TYPES) for ws in d.values() for w in ws} | set(EXECUTION))


def forms(verb: str) -> list[str]:
    stems = [verb] + ([verb[:-1]] if verb.endswith("e") else [])
    return sorted({s + e for s in stems for e in ENDINGS if s == verb or e in ("ing", "ed", "es")})


LEMMA = {f: v for v in VERBS for f in forms(v)}


def lemmas(words):
    """The known verbs among words, in order."""
    table = F.create_map(*[F.lit(x) for kv in LEMMA.items() for x in kv])
    return F.filter(F.transform(words, lambda w: F.try_element_at(table, w)), lambda v: v.isNotNull())


def discourse(root):
    out = F
    for label, verbs in DISCOURSE.items():
        out = out.when(root.isin(*verbs), label)
    return out.otherwise("background")


def pipeline_type(verbs, label):
    """The type of the first verb that has one; else by the label."""
    table = F.create_map(*[F.lit(x) for v in VERBS for t in [next((t for t, ws in TYPES.items() if v in ws), None)] if t for x in (v, t)])
    first = F.get(F.filter(F.transform(verbs, lambda v: F.try_element_at(table, v)), lambda t: t.isNotNull()), F.lit(0))
    fallback = F.when(label == "method", "procedural").when(label == "evidence", "evidential").when(label == "hypothesis", "hypothetical").when(label == "summary", "analytical").otherwise("descriptive")
    return F.coalesce(first, fallback)


def intent(verbs, label):
    return F.when(F.arrays_overlap(verbs, F.array(*[F.lit(v) for v in EXECUTION])), "execution").when(label == "hypothesis", "exploration").when(label == "evidence", "validation").otherwise("analysis")


def sentences(df, key, text):
    """(key, idx, sentence) of the pieces between full stops and blanks; those of blanks only are left out."""
    return df.select(key, F.posexplode(F.split(text, "\\. ")).alias("idx", "sentence")).where(F.trim("sentence") != "")


_LEMMAS = "MAP {" + ", ".join(f"'{f}': '{v}'" for f, v in LEMMA.items()) + "}"
_TYPES = "MAP {" + ", ".join(f"'{v}': '{t}'" for v in VERBS for t in [next((t for t, ws in TYPES.items() if v in ws), None)] if t) + "}"
_SENT = f"p AS (SELECT doc_id, string_split(text, '. ') AS l FROM documents WHERE text IS NOT NULL), q AS (SELECT doc_id, CAST(i AS INT) AS idx, l[i + 1] AS sentence FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM p) WHERE trim(l[i + 1]) <> ''), v AS (SELECT doc_id, idx, sentence, list_filter(list_transform(list_filter(regexp_split_to_array(lower(sentence), '[^a-z0-9_]+'), lambda w: w <> ''), lambda w: {_LEMMAS}[w]), lambda x: x IS NOT NULL) AS verbs FROM q), s AS (SELECT *, CASE WHEN verbs[1] IN ('propose', 'suggest', 'assume') THEN 'hypothesis' WHEN verbs[1] IN ('show', 'demonstrate', 'find') THEN 'evidence' WHEN verbs[1] IN ('apply', 'use', 'compute') THEN 'method' WHEN verbs[1] IN ('conclude', 'summarize') THEN 'summary' WHEN verbs[1] IN ('state', 'argue') THEN 'claim' ELSE 'background' END AS label FROM v), t AS (SELECT *, coalesce(list_filter(list_transform(verbs, lambda x: {_TYPES}[x]), lambda x: x IS NOT NULL)[1], CASE label WHEN 'method' THEN 'procedural' WHEN 'evidence' THEN 'evidential' WHEN 'hypothesis' THEN 'hypothetical' WHEN 'summary' THEN 'analytical' ELSE 'descriptive' END) AS type, CASE WHEN len(list_intersect(verbs, ['apply', 'compute', 'implement'])) > 0 THEN 'execution' WHEN label = 'hypothesis' THEN 'exploration' WHEN label = 'evidence' THEN 'validation' ELSE 'analysis' END AS intent FROM s)"


def classified(spark, d):
    s = sentences(load(spark, d, "documents").where("text is not null"), "doc_id", "text")
    s = s.withColumn("verbs", lemmas(T.ascii_words(F.col("sentence"))))
    s = s.withColumn("label", discourse(F.get("verbs", F.lit(0))))
    return s.withColumn("type", pipeline_type(F.col("verbs"), F.col("label"))).withColumn("intent", intent(F.col("verbs"), F.col("label")))


@query(f"WITH {_SENT} SELECT label, type, intent, CASE WHEN type = 'analytical' THEN 'AnalystLens' WHEN type = 'procedural' THEN 'ExecutorLens' WHEN label = 'hypothesis' THEN 'ResearchLens' ELSE 'GeneralLens' END AS lens, CASE WHEN label IN ('method', 'evidence') THEN 'high' WHEN label = 'hypothesis' THEN 'low' ELSE 'medium' END AS verifiability, CASE label WHEN 'hypothesis' THEN 'input' WHEN 'method' THEN 'transform' WHEN 'evidence' THEN 'validation' WHEN 'summary' THEN 'output' ELSE 'input' END AS role, CASE WHEN contains(lower(sentence), 'introduction') THEN 'introduction' WHEN regexp_matches(lower(sentence), 'method|approach') THEN 'method' WHEN contains(lower(sentence), 'result') THEN 'result' WHEN contains(lower(sentence), 'conclusion') THEN 'summary' ELSE 'body' END AS section, count(*) AS n FROM t GROUP BY ALL")
def sentence_classes(spark, d):
    """Sentences by discourse, type, intent, lens, verifiability, role and section."""
    t = classified(spark, d)
    label, low = F.col("label"), F.lower("sentence")
    return t.groupBy(
        "label", "type", "intent",
        F.when(F.col("type") == "analytical", "AnalystLens").when(F.col("type") == "procedural", "ExecutorLens").when(label == "hypothesis", "ResearchLens").otherwise("GeneralLens").alias("lens"),
        F.when(label.isin("method", "evidence"), "high").when(label == "hypothesis", "low").otherwise("medium").alias("verifiability"),
        F.when(label == "method", "transform").when(label == "evidence", "validation").when(label == "summary", "output").otherwise("input").alias("role"),
        F.when(low.contains("introduction"), "introduction").when(low.rlike("method|approach"), "method").when(low.contains("result"), "result").when(low.contains("conclusion"), "summary").otherwise("body").alias("section"),
    ).agg(F.count("*").alias("n"))


_R = "floor(({}) * 10000 + 0.5) / 10000"
_FRAMES = "len(verbs)::DOUBLE"
_DECAY = f"greatest(0.7e0, 1.0e0 - {_FRAMES} * 0.02e0)"
_CONF = "CASE WHEN label = 'background' THEN 0.4e0 ELSE 0.85e0 END"
_CONTENT = f"0.55e0 * (({_FRAMES} / ({_FRAMES} + 4.0e0) + least(1.0e0, args / greatest(1.0e0, {_FRAMES} * 3.0e0))) / 3.0e0) + 0.45e0 * ((0.75e0 + 1.0e0) / 2.0e0)"
_COV = f"{_FRAMES} / greatest(3.0e0, {_FRAMES} + 2.0e0)"
_NOV = f"len(list_distinct(verbs)) / greatest(1.0e0, {_FRAMES})"


@query(f"WITH {_SENT}, a AS (SELECT *, greatest(len(list_filter(regexp_split_to_array(lower(sentence), '[^a-z0-9_]+'), lambda w: w <> '')) - len(verbs), 0)::DOUBLE AS args, {_CONF} * {_DECAY} AS epistemic FROM t), b AS (SELECT *, {_CONTENT} AS density, {_COV} AS coverage, {_NOV} AS novelty, epistemic AS consistency FROM a) SELECT doc_id, idx, {_R.format('epistemic')} AS epistemic, {_R.format(f'{_FRAMES} + args * 0.5e0')} AS complexity, {_R.format('density')} AS density, {_R.format('density * (0.6e0 * sqrt(coverage * coverage + novelty * novelty + consistency * consistency))')} AS quality FROM b WHERE len(verbs) > 0")
def sentence_signals(spark, d):
    """Confidence, complexity, density and quality of the sentences that have a frame; words that are no verbs count as arguments,
    and risk as medium."""
    t = classified(spark, d).where(F.size("verbs") > 0)
    n = F.size("verbs").cast("double")
    args = F.greatest(F.size(T.ascii_words(F.col("sentence"))) - F.size("verbs"), F.lit(0)).cast("double")
    epistemic = F.when(F.col("label") == "background", 0.4).otherwise(0.85) * F.greatest(F.lit(0.7), 1.0 - n * 0.02)
    t = t.select("doc_id", "idx", n.alias("n"), args.alias("args"), epistemic.alias("e"), F.size(F.array_distinct("verbs")).alias("u"))
    n, args, e = F.col("n"), F.col("args"), F.col("e")
    density = 0.55 * ((n / (n + 4.0) + F.least(F.lit(1.0), args / F.greatest(F.lit(1.0), n * 3.0))) / 3.0) + 0.45 * F.lit((0.75 + 1.0) / 2.0)
    cov, nov = n / F.greatest(F.lit(3.0), n + 2.0), F.col("u") / F.greatest(F.lit(1.0), n)
    t = t.select("doc_id", "idx", "n", "args", "e", density.alias("density"), cov.alias("cov"), nov.alias("nov"))
    length = F.sqrt(F.col("cov") * F.col("cov") + F.col("nov") * F.col("nov") + F.col("e") * F.col("e"))
    return t.select("doc_id", "idx", S.r4(F.col("e")).alias("epistemic"), S.r4(F.col("n") + F.col("args") * 0.5).alias("complexity"), S.r4(F.col("density")).alias("density"), S.r4(F.col("density") * (0.6 * length)).alias("quality"))


@query("WITH s AS (SELECT DISTINCT node_id, project_name, imports, skill_type, lower(coalesce(code_snippet, '')) AS low FROM aletheia_skill) SELECT project_name, count(*) FILTER (len(imports) > 0) AS dependency_resolution, count(*) FILTER (contains(low, 'def ') OR contains(low, 'class ')) AS code_generation, count(*) FILTER (regexp_matches(low, 'assert|test|raises|expect')) + count(*) FILTER (skill_type = 'validation') AS validation, count(*) FILTER (regexp_matches(low, 'type|annotation|hint|-> ')) AS type_safety FROM s GROUP BY 1")
def capability_counts(spark, d):
    """What the code of each project shows that it can do."""
    s = records.once(load(spark, d, "aletheia_skill").select("node_id", "project_name", "imports", "skill_type", F.lower(F.coalesce("code_snippet", F.lit(""))).alias("low")), "node_id")
    low = F.col("low")
    return s.groupBy("project_name").agg(F.count_if(F.size("imports") > 0).alias("dependency_resolution"), F.count_if(low.rlike("def |class ")).alias("code_generation"), (F.count_if(low.rlike("assert|test|raises|expect")) + F.count_if(F.col("skill_type") == "validation")).alias("validation"), F.count_if(low.rlike("type|annotation|hint|-> ")).alias("type_safety"))


@query("WITH e AS (SELECT user_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events), b AS (SELECT user_id, count(*) FILTER (cents >= 5000) AS breaches, coalesce(sum(cents) FILTER (cents >= 5000), 0)::BIGINT AS total, coalesce(sum(ln(1 + 0.05e0 * (cents / 50000.0e0))) FILTER (cents >= 5000), 0) AS logs FROM e GROUP BY user_id) SELECT user_id, breaches, floor(total / 500000.0e0 * 10000 + 0.5) / 10000 AS drift, round(1.0e0 - 0.75e0 * exp(-logs), 5) AS veteran_weight, total / 500000.0e0 > 0.3e0 AS frozen, round(total / 500000.0e0 * (1.0e0 - 0.05e0 / (1.0e0 + total / 500000.0e0)), 5) AS after_tick FROM b")
def identity_drift(spark, d):
    """Drift from a user's strong events: a tenth of each adds up; the veteran's share grows by a twentieth of each and all are
    scaled to one, which is a product, so no order is needed; and what one tick of recovery leaves."""
    e = load(spark, d, "events").select("user_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    strong = F.col("cents") >= 5000
    b = e.groupBy("user_id").agg(F.count_if(strong).alias("breaches"), F.coalesce(F.sum(F.when(strong, F.col("cents"))), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(strong, F.log(1 + 0.05 * (F.col("cents") / 50000.0)))), F.lit(0.0)).alias("logs"))
    drift = F.col("total") / 500000.0
    return b.select("user_id", "breaches", S.r4(drift).alias("drift"), F.round(1.0 - 0.75 * F.exp(-F.col("logs")), 5).alias("veteran_weight"), (drift > 0.3).alias("frozen"), F.round(drift * (1.0 - 0.05 / (1.0 + drift)), 5).alias("after_tick"))


def cluster_policy(stage, basis, conf, terms):
    """'action: reason' for a cluster that asks for promotion."""
    return (
        F.when(basis == "lexical", "quarantine: cluster compression cannot use lexical merge basis")
        .when((stage == "compressed_invariant") & (F.coalesce(conf, F.lit(0.0)) < 0.75), "quarantine: compressed invariant below merge confidence threshold")
        .when((stage == "compressed_invariant") & (F.coalesce(terms, F.lit(0)) == 0), "quarantine: compressed invariant requires preserved contrast terms")
        .otherwise("observe: cluster governance passed")
    )


_KIDS = "k AS (SELECT DISTINCT node_id, name, unnest(topology_cluster.child_ids) AS kid FROM aletheia_skill), m AS (SELECT node_id, max(epistemic.c_node) AS c, max(name) AS name, max(operator_type) AS op FROM aletheia_skill GROUP BY node_id), g AS (SELECT k.node_id, count(*) AS kids, max(m.c) AS conf, count(DISTINCT m.op) AS terms, bool_or(lower(m.name) = lower(k.name)) AS lexical FROM k JOIN m ON m.node_id = k.kid GROUP BY k.node_id)"


@query(f"WITH {_KIDS} SELECT CASE WHEN lexical THEN 'quarantine: cluster compression cannot use lexical merge basis' WHEN kids >= 2 AND coalesce(conf, 0) < 0.75e0 THEN 'quarantine: compressed invariant below merge confidence threshold' WHEN kids >= 2 AND terms = 0 THEN 'quarantine: compressed invariant requires preserved contrast terms' ELSE 'observe: cluster governance passed' END AS policy, count(*) AS clusters FROM g GROUP BY 1")
def cluster_governance(spark, d):
    """Clusters of children: two and more ask to be compressed; their confidence, kinds and names decide."""
    s = load(spark, d, "aletheia_skill")
    k = s.select("node_id", "name", F.explode("topology_cluster.child_ids").alias("kid")).distinct()
    m = s.groupBy(F.col("node_id").alias("kid")).agg(F.max("epistemic.c_node").alias("c"), F.max("name").alias("kid_name"), F.max("operator_type").alias("op"))
    g = k.join(m, "kid").groupBy("node_id").agg(F.count("*").alias("kids"), F.max("c").alias("conf"), F.count_distinct("op").alias("terms"), F.bool_or(F.lower("kid_name") == F.lower("name")).alias("lexical"))
    p = cluster_policy(F.when(F.col("kids") >= 2, "compressed_invariant").otherwise("seed"), F.when(F.col("lexical"), "lexical").otherwise("structural"), F.col("conf"), F.col("terms"))
    return g.groupBy(p.alias("policy")).agg(F.count("*").alias("clusters"))


_STAMP = "Generated_via_"


@query("WITH p AS (SELECT DISTINCT payload_id, output, instruction FROM payload) SELECT payload_id, md5(coalesce(output, 'Generated_via_' || CASE WHEN regexp_matches(lower(instruction), 'why|failure|breakdown|error') THEN 'diagnostic' WHEN regexp_matches(lower(instruction), 'compare|difference|ratio') THEN 'comparative' WHEN regexp_matches(lower(instruction), 'mechanism|process|step') THEN 'mechanistic' ELSE 'theoretical' END)) AS digest, output IS NULL AS stamped FROM p WHERE instruction IS NOT NULL")
def stamped_outputs(spark, d):
    """Outputs, and where there is none the stamp of the lens that would have made it."""
    p = records.once(load(spark, d, "payload").select("payload_id", "output", "instruction"), "payload_id").where("instruction is not null")
    return p.select("payload_id", F.md5(F.coalesce("output", F.concat(F.lit(_STAMP), T.lens(F.col("instruction"))))).alias("digest"), F.col("output").isNull().alias("stamped"))

