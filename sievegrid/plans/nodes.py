"""Queries on nodes and the edges between them: quality, confidence, decisions, governance, failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import gates as G
from ..functions import scoring as S
from ..functions import text as T
from ..operators import graph, records
from ..sources.tables import load
from .registry import query
from .texts import _DENSITY

_R = "floor(({}) * 10000 + 0.5) / 10000"
_COUNT = " + ".join(f"coalesce(CAST((length(low) - length(replace(low, '{m}', ''))) / {len(m)} AS INT), 0)" for m in ("assert", "self.assert", "pytest", "raises", "expect", "raise ", " error"))
_RV = "teaching_layer.reasoning_vectors"
_NODES = f"n AS (SELECT DISTINCT node_id, project_name, skill_type, source_type, v_score, epistemic.c_node AS c, epistemic.state AS state, epistemic.depth AS depth, epistemic.retry_budget AS budget, epistemic.branch_id AS branch, lower(code_snippet) AS low, source_context AS t, {_RV}.intent AS intent, {_RV}.strategy AS strategy, {_RV}.constraints AS cons, dependencies.downstream_calls AS calls, imports FROM aletheia_skill)"
_VECTOR = f"v AS (SELECT *, coalesce({_DENSITY}, 0) AS density, least(1.0e0, ({_COUNT}) / 5.0e0) AS a, CASE WHEN skill_type IN ('validation', 'theoretical_reasoning') THEN 0.7e0 ELSE 0.5e0 END AS b, (coalesce((intent <> '')::INT, 0) + coalesce((strategy <> '')::INT, 0) + coalesce((len(cons) > 0)::INT, 0)) / 5.0e0 AS k FROM n), s AS (SELECT *, sqrt(a * a + b * b + k * k) AS len, {_R.format('1.8e0 * density * sqrt(a * a + b * b + k * k)')} AS sie FROM v)"
_EDGES = "e AS (SELECT DISTINCT node_id AS src, x AS dst FROM (SELECT node_id, unnest(calls) AS x FROM n) WHERE x <> node_id AND x IN (SELECT node_id FROM n))"
_COS = "(p.a * q.a + p.b * q.b + p.k * q.k) / (p.len * q.len)"
_PAIR = f"w AS (SELECT e.src, e.dst, p.state AS parent_state, p.c AS parent_c, {_COS} AS cos, {_R.format(f'1.0e0 - greatest(0.0e0, least(1.0e0, {_COS}))')} AS slr FROM e JOIN s p ON p.node_id = e.src JOIN s q ON q.node_id = e.dst)"
_BASE = f"{_NODES}, {_VECTOR}, {_EDGES}, {_PAIR}"


def base(spark: SparkSession, d: str) -> DataFrame:
    """Nodes once, with what the scores are made of."""
    s = records.once(load(spark, d, "aletheia_skill").select("node_id", "project_name", "skill_type", "source_type", "v_score", "epistemic", "code_snippet", "source_context", F.col(_RV).alias("rv"), F.col("dependencies.downstream_calls").alias("calls"), "imports"), "node_id")
    v = S.alignment(T.marker_counts(F.col("code_snippet")), F.col("skill_type"), S.filled(F.col("rv.intent") != "", F.col("rv.strategy") != "", F.size("rv.constraints") > 0))
    s = s.select("node_id", "project_name", "skill_type", "source_type", "v_score", "imports", F.col("epistemic.c_node").alias("c"), F.col("epistemic.state").alias("state"), F.col("epistemic.depth").alias("depth"), F.col("epistemic.retry_budget").alias("budget"), F.col("epistemic.branch_id").alias("branch"), F.coalesce(G.prose_density(F.col("source_context")), F.lit(0.0)).alias("density"), v.alias("v"), F.col("rv.strategy").alias("strategy"), F.col("rv.constraints").alias("cons"), "calls")
    return s.withColumn("sie", S.quality(F.col("density"), F.col("v"), "theorist"))


def edges(nodes: DataFrame) -> DataFrame:
    return graph.edges_of(nodes, "node_id", F.col("calls"))


def pairs(nodes: DataFrame) -> DataFrame:
    """(src, dst, parent_state, parent_c, cos, slr) of each edge from a caller, the parent, to what it calls."""
    p = nodes.select(F.col("node_id").alias("src"), F.col("state").alias("parent_state"), F.col("c").alias("parent_c"), F.col("v").alias("pv"))
    q = nodes.select(F.col("node_id").alias("dst"), F.col("v").alias("qv"))
    return edges(nodes).join(p, "src").join(q, "dst").select("src", "dst", "parent_state", "parent_c", S.cosine3(F.col("pv"), F.col("qv")).alias("cos"), S.slr(F.col("pv"), F.col("qv")).alias("slr"))


@query(f"WITH {_NODES}, {_VECTOR} SELECT node_id, {_R.format('density')} AS density, {_R.format('a')} AS coverage, b AS novelty, {_R.format('k')} AS consistency, sie AS theorist, {_R.format('1.0e0 * density * len')} AS coding_assistant, {_R.format('0.9e0 * density * len')} AS advocate, {_R.format('1.1e0 * density * len')} AS veteran, density > 0 AND sie >= 0.1e0 AS passed FROM s")
def quality_scores(spark, d):
    """Density, alignment and quality of each node in the four modes, and whether it holds information."""
    n = base(spark, d)
    v, den = F.col("v"), F.col("density")
    return n.select("node_id", S.r4(den).alias("density"), S.r4(v[0]).alias("coverage"), v[1].alias("novelty"), S.r4(v[2]).alias("consistency"), *[S.quality(den, v, m).alias(m) for m in S.SCALE], ((den > 0) & (F.col("sie") >= S.QUALITY_FLOOR)).alias("passed"))


@query(f"WITH {_BASE} SELECT dst AS node_id, count(*) AS parents, max(slr) AS max_slr, {_R.format('min(cos)')} AS min_coherence, count(*) FILTER (parent_state IS DISTINCT FROM 'ACCEPTED') AS unaccepted FROM w GROUP BY dst")
def parent_links(spark, d):
    """What each node's parents say: their number, the largest drift, the least coherence, those not accepted."""
    w = pairs(base(spark, d))
    return w.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("parents"), F.max("slr").alias("max_slr"), S.r4(F.min("cos")).alias("min_coherence"), F.count_if(~F.col("parent_state").eqNullSafe("ACCEPTED")).alias("unaccepted"))


@query(f"WITH {_BASE} SELECT CASE WHEN slr >= 0.8e0 THEN 'collapse' WHEN slr >= 0.7e0 THEN 'reroll' WHEN slr >= 0.6e0 THEN 'warning' WHEN slr >= 0.3e0 THEN 'elevated' ELSE 'safe' END AS tier, count(*) AS edges FROM w GROUP BY 1")
def drift_tiers(spark, d):
    return pairs(base(spark, d)).groupBy(S.tier(F.col("slr")).alias("tier")).agg(F.count("*").alias("edges"))


_SCORED = f"ok AS (SELECT node_id FROM n WHERE c >= 0.4e0 AND v_score >= 0.7e0), topo AS (SELECT node_id, len(calls) AS calls, (SELECT count(*) FROM (SELECT unnest(calls) AS x) WHERE x IN (SELECT node_id FROM ok)) AS satisfied FROM n), par AS (SELECT dst, max(slr) AS max_slr, count(*) FILTER (parent_state IS DISTINCT FROM 'ACCEPTED') AS unaccepted, coalesce(bool_or(parent_state = 'ACCEPTED' AND (cos < 0.3e0 OR slr >= 0.7e0)), false) AS broken FROM w GROUP BY dst), ev AS (SELECT DISTINCT node_id FROM advocate_payload WHERE node_id IS NOT NULL), f AS (SELECT s.node_id, s.budget, s.depth, coalesce(par.max_slr, 0) AS max_slr, coalesce(par.unaccepted, 0) AS unaccepted, coalesce(par.broken, false) AS broken, {_R.format('least(1.0e0, 0.4e0 * least(1.0e0, sie) + 0.3e0 * least(1.0e0, coalesce(s.c, 0.0e0)) + 0.2e0 * CASE WHEN topo.calls > 0 THEN (topo.satisfied + 1) / (topo.calls + 1) ELSE 0.8e0 END + 0.1e0 * CASE WHEN lower(s.source_type) IN (' + chr(39) + 'ast_code' + chr(39) + ', ' + chr(39) + 'macro_skill' + chr(39) + ') THEN 1.0e0 WHEN ev.node_id IS NOT NULL THEN 0.85e0 ELSE 0.75e0 END)')} AS c0 FROM s JOIN topo USING (node_id) LEFT JOIN par ON par.dst = s.node_id LEFT JOIN ev ON ev.node_id = s.node_id), g AS (SELECT *, {_R.format(_R.format('c0 * (1.0e0 - max_slr)') + ' * (1.0e0 - least(0.3e0, coalesce(depth, 0) * 0.05e0))')} AS c_final FROM f), h AS (SELECT *, CASE WHEN unaccepted > 0 THEN list_reduce(list_prepend(c_final, list_transform(range(unaccepted), lambda x: x::DOUBLE)), lambda a, x: floor(a * 0.5e0 * 10000 + 0.5) / 10000) ELSE c_final END AS after FROM g)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, budget, c_final, after, broken): the confidence of each node, and what its parents leave of it."""
    n = base(spark, d)
    ok = n.where((F.col("c") >= S.ACCEPT) & (F.col("v_score") >= 0.7)).select(F.col("node_id").alias("x"), F.lit(1).alias("ok"))
    topo = n.select("node_id", F.explode("calls").alias("x")).join(ok, "x", "left").groupBy("node_id").agg(F.count("*").alias("n_calls"), F.count("ok").alias("satisfied"))
    w = pairs(n)
    bad = (F.col("parent_state") == "ACCEPTED") & ((F.col("cos") < S.COHERENCE) | (F.col("slr") >= S.TIERS["reroll"]))
    par = w.groupBy(F.col("dst").alias("node_id")).agg(F.max("slr").alias("max_slr"), F.count_if(~F.col("parent_state").eqNullSafe("ACCEPTED")).alias("unaccepted"), F.coalesce(F.bool_or(bad), F.lit(False)).alias("broken"))
    ev = load(spark, d, "advocate_payload").where("node_id is not null").select("node_id", F.lit(True).alias("ev")).distinct()
    j = n.join(topo, "node_id", "left").join(par, "node_id", "left").join(ev, "node_id", "left")
    c = S.confidence(F.col("sie"), F.col("c"), S.topology(F.lit(None).cast("double"), F.col("n_calls"), F.col("satisfied")), S.evidence(F.col("source_type"), F.col("ev")), F.col("max_slr"), F.col("depth"))
    out = j.select("node_id", "budget", c.alias("c_final"), F.coalesce("unaccepted", F.lit(0)).alias("unaccepted"), F.coalesce("broken", F.lit(False)).alias("broken"))
    return out.withColumn("after", S.cascade(F.col("c_final"), F.col("unaccepted")))


@query(f"WITH {_BASE}, {_SCORED} SELECT node_id, c_final, after, broken FROM h")
def unified_confidence(spark, d):
    return scored(spark, d).select("node_id", "c_final", "after", "broken")


def _route(why: str) -> str:
    return f"CASE WHEN coalesce(budget, 0) > 0 THEN 'REROLL: {why}' ELSE 'REJECTED: budget_exhausted | {why}' END"


@query(f"WITH {_BASE}, {_SCORED} SELECT node_id, CASE WHEN c_final >= 0.4e0 THEN CASE WHEN broken THEN 'REJECTED: parent_chain_failed' WHEN after >= 0.4e0 THEN 'ACCEPTED: validated' WHEN after >= 0.25e0 THEN {_route('soft_parent_cascade')} ELSE 'REJECTED: soft_parent_cascade_below_band' END WHEN c_final >= 0.25e0 THEN {_route('instability_band')} ELSE 'REJECTED: below_instability_band' END AS decision FROM h")
def terminal_decision(spark, d):
    """Accepted, sent back or rejected, and why."""
    h = scored(spark, d)
    return h.select("node_id", S.decision(F.col("c_final"), F.col("after"), ~F.col("broken"), F.col("budget")).alias("decision"))


@query(f"WITH {_BASE}, a AS (SELECT * FROM s WHERE branch <> 'root' AND coalesce(state, '') NOT IN ('ACCEPTED', 'REJECTED')), m AS (SELECT branch, count(*) AS nodes, avg(c) AS mean_c, max(c) AS max_c FROM a GROUP BY branch), i AS (SELECT p.branch, max(w.slr) AS max_slr FROM w JOIN a p ON p.node_id = w.src JOIN a q ON q.node_id = w.dst AND q.branch = p.branch GROUP BY p.branch) SELECT branch, nodes, {_R.format('mean_c * (1.0e0 - coalesce(max_slr, 0))')} AS stability, mean_c * (1.0e0 - coalesce(max_slr, 0)) < 0.4e0 AS degraded, max_c < 0.35e0 AS pruned FROM m LEFT JOIN i USING (branch)")
def branch_stability(spark, d):
    """Branches by the mean confidence of their open nodes, less the largest drift inside."""
    n = base(spark, d)
    a = n.where((F.col("branch") != "root") & ~F.coalesce("state", F.lit("")).isin("ACCEPTED", "REJECTED"))
    m = a.groupBy("branch").agg(F.count("*").alias("nodes"), F.avg("c").alias("mean_c"), F.max("c").alias("max_c"))
    own = a.select("node_id", "branch")
    inside = pairs(n).join(own.select(F.col("node_id").alias("src"), "branch"), "src").join(own.select(F.col("node_id").alias("dst"), "branch"), ["dst", "branch"]).groupBy("branch").agg(F.max("slr").alias("max_slr"))
    st = F.col("mean_c") * (1.0 - F.coalesce("max_slr", F.lit(0.0)))
    return m.join(inside, "branch", "left").select("branch", "nodes", S.r4(st).alias("stability"), (st < S.BRANCH_STABLE).alias("degraded"), (F.col("max_c") < S.PRUNE).alias("pruned"))


_ADV = f"x AS (SELECT node_id, c, least(1.0e0, {_R.format('sie / greatest(1.0e0, log2(greatest(coalesce(len(imports), 0), 1) + 1))')}) AS parsimony, least(1.0e0, {_R.format('coalesce(len(cons), 0) / 6.0e0')}) AS boundary, md5(concat(array_to_string(list_sort(coalesce(imports, [])), ','), coalesce(strategy, ''))) AS fp, substr(node_id, 3)::BIGINT AS i FROM s), y AS (SELECT *, greatest(3, 10 - 2 * count(*) OVER (PARTITION BY fp ORDER BY i RANGE BETWEEN 200 PRECEDING AND 1 PRECEDING)) / 10 AS novelty FROM x), z AS (SELECT *, {_R.format('parsimony * 0.4e0 + boundary * 0.35e0 + novelty * 0.25e0')} AS score FROM y)"


@query(f"WITH {_NODES}, {_VECTOR}, {_ADV} SELECT node_id, score, CASE WHEN abs(coalesce(c, 0) - score) < 0.15e0 THEN 'agreement' WHEN abs(coalesce(c, 0) - score) < 0.3e0 THEN 'minor_conflict' ELSE 'major_conflict' END AS class, concat_ws(',', CASE WHEN abs(coalesce(c, 0) - score) >= 0.3e0 THEN CASE WHEN coalesce(c, 0) > score THEN 'primary_overscoring' ELSE 'adversarial_overscoring' END END, CASE WHEN novelty < 0.5 THEN 'low_novelty_repeat_structure' END, CASE WHEN parsimony < 0.3e0 THEN 'complexity_without_coherence' END) AS flags FROM z")
def adversarial_lens(spark, d):
    """A second opinion on each node by its parsimony, its limits and how new its structure is among the 200 before it."""
    n = base(spark, d)
    ops = F.greatest(F.coalesce(F.size("imports"), F.lit(0)), F.lit(1))
    fp = F.md5(F.concat(F.array_join(F.array_sort(F.coalesce("imports", F.array().cast("array<string>"))), ","), F.coalesce("strategy", F.lit(""))))
    x = n.select("node_id", F.coalesce("c", F.lit(0.0)).alias("c"), F.least(F.lit(1.0), S.r4(F.col("sie") / F.greatest(F.lit(1.0), F.log2((ops + 1).cast("double"))))).alias("parsimony"), F.least(F.lit(1.0), S.r4(F.greatest(F.coalesce(F.size("cons"), F.lit(0)), F.lit(0)) / 6.0)).alias("boundary"), fp.alias("fp"), F.substring("node_id", 3, 99).cast("bigint").alias("i"))
    w = Window.partitionBy("fp").orderBy("i").rangeBetween(-200, -1)
    y = x.withColumn("novelty", F.greatest(F.lit(3), 10 - 2 * F.count("*").over(w)) / 10)
    y = y.withColumn("score", S.r4(F.col("parsimony") * 0.4 + F.col("boundary") * 0.35 + F.col("novelty") * 0.25))
    far = F.abs(F.col("c") - F.col("score")) >= 0.3
    flags = F.concat_ws(",", F.when(far, F.when(F.col("c") > F.col("score"), "primary_overscoring").otherwise("adversarial_overscoring")), F.when(F.col("novelty") < 0.5, "low_novelty_repeat_structure"), F.when(F.col("parsimony") < 0.3, "complexity_without_coherence"))
    return y.select("node_id", "score", S.conflict(F.col("c"), F.col("score")).alias("class"), flags.alias("flags"))


@query(f"WITH {_NODES} SELECT project_name, count(*) AS nodes, round(avg((state IS DISTINCT FROM 'REJECTED')::INT), 6) AS kept, count(*) FILTER (coalesce(state, '') NOT IN ('ACCEPTED', 'REJECTED')) AS orphans, count(*) FILTER (coalesce(state, '') NOT IN ('ACCEPTED', 'REJECTED')) >= 3 OR count(*) FILTER (coalesce(state, '') NOT IN ('ACCEPTED', 'REJECTED')) > 0.01 * count(*) AS failed FROM n GROUP BY project_name")
def orphan_ratio(spark, d):
    """Nodes that never came to an end, by project."""
    s = records.once(load(spark, d, "aletheia_skill").select("node_id", "project_name", F.col("epistemic.state").alias("state")), "node_id")
    open_ = ~F.coalesce("state", F.lit("")).isin("ACCEPTED", "REJECTED")
    n = F.count_if(open_)
    return s.groupBy("project_name").agg(F.count("*").alias("nodes"), F.round(F.avg((~F.col("state").eqNullSafe("REJECTED")).cast("int")), 6).alias("kept"), n.alias("orphans"), ((n >= 3) | (n > 0.01 * F.count("*"))).alias("failed"))


@query(f"WITH {_NODES} SELECT node_id FROM n WHERE (v_score >= 0.7e0 AND c >= 0.4e0) OR state = 'ACCEPTED'")
def accepted_set(spark, d):
    s = records.once(load(spark, d, "aletheia_skill").select("node_id", "v_score", "epistemic"), "node_id")
    return s.where(((F.col("v_score") >= 0.7) & (F.col("epistemic.c_node") >= S.ACCEPT)) | (F.col("epistemic.state") == "ACCEPTED")).select("node_id")


@query(f"WITH {_NODES} SELECT view, count(*) AS nodes FROM (SELECT unnest(list_filter([CASE WHEN coalesce(state, '') NOT IN ('ACCEPTED', 'REJECTED') THEN 'active' END, CASE WHEN state IN ('CREATED', 'REROLL') THEN 'ready' END, CASE WHEN c >= 0.4e0 AND v_score >= 0.7e0 THEN 'validated' END, CASE WHEN branch <> 'root' THEN 'branch' END], lambda x: x IS NOT NULL)) AS view FROM n) GROUP BY view")
def store_views(spark, d):
    """How many nodes each view of the store holds."""
    s = records.once(load(spark, d, "aletheia_skill").select("node_id", "v_score", "epistemic"), "node_id")
    e = F.col("epistemic")
    views = F.array_compact(F.array(F.when(~F.coalesce(e["state"], F.lit("")).isin("ACCEPTED", "REJECTED"), "active"), F.when(e["state"].isin("CREATED", "REROLL"), "ready"), F.when((e["c_node"] >= S.ACCEPT) & (F.col("v_score") >= 0.7), "validated"), F.when(e["branch_id"] != "root", "branch")))
    return s.select(F.explode(views).alias("view")).groupBy("view").agg(F.count("*").alias("nodes"))


@query(f"WITH {_NODES}, {_VECTOR} SELECT node_id, f.metric, f.value FROM (SELECT node_id, unnest([{{'metric': 'c_node', 'value': {_R.format('coalesce(c, 0)')}}}, {{'metric': 'depth', 'value': coalesce(depth, 0)::DOUBLE}}, {{'metric': 'v_score', 'value': {_R.format('coalesce(v_score, 0)')}}}, {{'metric': 'constraint_count', 'value': coalesce(len(cons), 0)::DOUBLE}}, {{'metric': 'content_density', 'value': {_R.format('density')}}}, {{'metric': 's_sie', 'value': sie}}, {{'metric': 'alignment_vector_norm', 'value': {_R.format('len')}}}]) AS f FROM s)")
def metric_projection(spark, d):
    """The metrics of each node in long form; what is missing is 0."""
    n = base(spark, d)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    m = {"c_node": S.r4(zero(F.col("c"))), "depth": zero(F.col("depth")), "v_score": S.r4(zero(F.col("v_score"))), "constraint_count": F.greatest(F.lit(0.0), zero(F.size("cons"))), "content_density": S.r4(F.col("density")), "s_sie": F.col("sie"), "alignment_vector_norm": S.r4(S.length(F.col("v")))}
    return n.select("node_id", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in m.items()])).alias("f")).select("node_id", "f.metric", "f.value")


INVARIANT = r"(?i)^\s*([a-z_][a-z0-9_]*)\s*(>=|<=|!=|==|>|<)\s*(-?[0-9]+(?:\.[0-9]+)?)\s*$"
#: Invariants of the query below: two that hold often, one of an unknown field, one that is none.
RULES = ["c_node >= 0.4", "depth <= 3", "V_SCORE > 0.25", "constraint_count == 1", "charm >= 1", "c_node is high"]


def invariant_failures(rules: list[str], fields: dict) -> F:
    """Those of the rules 'field op number' that do not hold, as an array; what cannot be read, or names no field, fails."""
    import re

    out = []
    for rule in rules:
        m = re.match(INVARIANT, rule)
        if not m or m[1].lower() not in fields:
            out.append(F.lit(rule))
            continue
        c, x = F.coalesce(fields[m[1].lower()].cast("double"), F.lit(0.0)), float(m[3])
        near = F.abs(c - x) < 1e-9
        holds = {">=": c >= x, "<=": c <= x, ">": c > x, "<": c < x, "==": near, "!=": ~near}[m[2]]
        out.append(F.when(~holds, F.lit(rule)))
    return F.array_compact(F.array(*out))


@query(f"WITH {_NODES} SELECT node_id, concat_ws('; ', CASE WHEN NOT coalesce(c, 0) >= 0.4e0 THEN 'c_node >= 0.4' END, CASE WHEN NOT coalesce(depth, 0) <= 3 THEN 'depth <= 3' END, CASE WHEN NOT coalesce(v_score, 0) > 0.25e0 THEN 'V_SCORE > 0.25' END, CASE WHEN coalesce(len(cons), 0) <> 1 THEN 'constraint_count == 1' END, 'charm >= 1', 'c_node is high') AS failed FROM n")
def declared_invariants(spark, d):
    s = records.once(load(spark, d, "aletheia_skill").select("node_id", "v_score", "epistemic", F.col(f"{_RV}.constraints").alias("cons")), "node_id")
    fields = {"c_node": F.col("epistemic.c_node"), "depth": F.col("epistemic.depth"), "v_score": F.col("v_score"), "constraint_count": F.greatest(F.coalesce(F.size("cons"), F.lit(0)), F.lit(0))}
    return s.select("node_id", F.array_join(invariant_failures(RULES, fields), "; ").alias("failed"))


@query(f"WITH {_NODES} SELECT p.op AS op, count(*) AS n FROM (SELECT regexp_extract(x, '(?i)^\\s*([a-z_][a-z0-9_ ]*)\\s*(>=|<=|!=|==|>|<)\\s*(-?[0-9]+(?:\\.[0-9]+)?)\\s*$', ['field', 'op', 'value']) AS p FROM (SELECT unnest(cons) AS x FROM n)) GROUP BY 1")
def constraint_operators(spark, d):
    """The nodes' own constraints by their comparison; '' where they are none."""
    s = records.once(load(spark, d, "aletheia_skill").select("node_id", F.col(f"{_RV}.constraints").alias("cons")), "node_id").select(F.explode("cons").alias("x"))
    return s.groupBy(F.regexp_extract("x", r"(?i)^\s*([a-z_][a-z0-9_ ]*)\s*(>=|<=|!=|==|>|<)\s*(-?[0-9]+(?:\.[0-9]+)?)\s*$", 2).alias("op")).agg(F.count("*").alias("n"))


_GOV = "g AS (SELECT e.src, e.dst, CASE WHEN lower(p.name) = lower(q.name) THEN 'lexical_similarity' WHEN dp.domain IS DISTINCT FROM dq.domain THEN 'domain_bridge' ELSE 'calls' END AS relation, dp.domain IS DISTINCT FROM dq.domain AS crossing, least(p.c, q.c) AS conf, e.src IN (SELECT node_id FROM advocate_payload WHERE node_id IS NOT NULL) AS evidence FROM e JOIN m p ON p.node_id = e.src JOIN m q ON q.node_id = e.dst LEFT JOIN project dp ON dp.project_name = p.project_name LEFT JOIN project dq ON dq.project_name = q.project_name)"


def edge_policy(relation, control, has_evidence, crossing, conf):
    """'action: reason' for an edge of governed relations."""
    return (
        F.when(relation == "lexical_similarity", "quarantine: lexical similarity edges quarantine by default")
        .when((relation == "domain_bridge") & control, "reject: control or lens nodes cannot create domain bridges")
        .when((relation == "domain_bridge") & ~has_evidence, "quarantine: domain bridge missing evidence_basis")
        .when(crossing & (F.coalesce(conf, F.lit(0.0)) < 0.70), "quarantine: cross-domain edge below confidence threshold")
        .otherwise("observe: edge governance passed")
    )


def control_end(c):
    return F.lower(c).rlike("^(control:|lens:|boundary:|bridge:)")


@query(f"WITH {_NODES}, {_EDGES}, m AS (SELECT DISTINCT node_id, name, project_name, epistemic.c_node AS c FROM aletheia_skill), {_GOV} SELECT CASE WHEN relation = 'lexical_similarity' THEN 'quarantine: lexical similarity edges quarantine by default' WHEN relation = 'domain_bridge' AND NOT evidence THEN 'quarantine: domain bridge missing evidence_basis' WHEN crossing AND coalesce(conf, 0) < 0.7e0 THEN 'quarantine: cross-domain edge below confidence threshold' ELSE 'observe: edge governance passed' END AS policy, count(*) AS edges FROM g GROUP BY 1")
def edge_governance(spark, d):
    """Calls as governed edges: equal names, bridges between domains, evidence and confidence."""
    s = records.once(load(spark, d, "aletheia_skill").select("node_id", "name", "project_name", F.col("epistemic.c_node").alias("c"), F.col("dependencies.downstream_calls").alias("calls")), "node_id")
    dom = load(spark, d, "project").groupBy("project_name").agg(F.max("domain").alias("domain"))
    m = s.join(dom, "project_name", "left").select("node_id", F.lower("name").alias("name"), "domain", "c")
    ev = load(spark, d, "advocate_payload").where("node_id is not null").select(F.col("node_id").alias("src"), F.lit(True).alias("ev")).distinct()
    e = edges(s).join(m.select(*[F.col(c).alias(a) for c, a in zip(m.columns, ("src", "n1", "d1", "c1"))]), "src").join(m.select(*[F.col(c).alias(a) for c, a in zip(m.columns, ("dst", "n2", "d2", "c2"))]), "dst").join(ev, "src", "left")
    crossing = ~F.col("d1").eqNullSafe(F.col("d2"))
    relation = F.when(F.col("n1") == F.col("n2"), "lexical_similarity").when(crossing, "domain_bridge").otherwise("calls")
    policy = edge_policy(relation, control_end(F.col("src")) | control_end(F.col("dst")), F.coalesce("ev", F.lit(False)), crossing, F.least("c1", "c2"))
    return e.groupBy(policy.alias("policy")).agg(F.count("*").alias("edges"))


@query("WITH r AS (SELECT DISTINCT node_id FROM aletheia_skill WHERE epistemic.state = 'REJECTED'), l AS (SELECT DISTINCT ledger_id, node_id, to_state, trigger_name, event_ts FROM ledger), a AS (SELECT node_id, arg_max(coalesce(trigger_name, ''), (event_ts, ledger_id)) AS cause, max(event_ts) AS last_ts, bool_or(to_state = 'REROLL') AS rerolled FROM l GROUP BY node_id) SELECT r.node_id, substr(sha256(concat_ws('|', r.node_id, 'REJECTED', coalesce(a.cause, 'unknown'))), 1, 16) AS failure_id, coalesce(a.cause, 'unknown') AS cause, a.last_ts, CASE WHEN coalesce(a.rerolled, false) THEN 'rerolled' ELSE 'abandoned' END AS remediation FROM r LEFT JOIN a USING (node_id)")
def failure_rows(spark, d):
    """Rejected nodes with their last transition, and whether they were ever tried again."""
    r = load(spark, d, "aletheia_skill").where("epistemic.state = 'REJECTED'").select("node_id").distinct()
    l = load(spark, d, "ledger")
    a = l.groupBy("node_id").agg(F.max_by(F.coalesce("trigger_name", F.lit("")), F.struct("event_ts", "ledger_id")).alias("cause"), F.max("event_ts").alias("last_ts"), F.bool_or(F.col("to_state") == "REROLL").alias("rerolled"))
    j = r.join(a, "node_id", "left").withColumn("cause", F.coalesce("cause", F.lit("unknown")))
    return j.select("node_id", F.substring(F.sha2(F.concat_ws("|", "node_id", F.lit("REJECTED"), "cause"), 256), 1, 16).alias("failure_id"), "cause", "last_ts", F.when(F.coalesce("rerolled", F.lit(False)), "rerolled").otherwise("abandoned").alias("remediation"))


@query(f"WITH {_NODES}, u AS (SELECT DISTINCT node_id, unnest(dependencies.upstream_callers) AS caller FROM aletheia_skill) SELECT u.node_id, count(*) AS rejected_callers FROM u WHERE caller IN (SELECT node_id FROM n WHERE state = 'REJECTED') GROUP BY 1")
def ghost_rejects(spark, d):
    """Nodes that a rejected node calls."""
    s = load(spark, d, "aletheia_skill")
    bad = s.where("epistemic.state = 'REJECTED'").select(F.col("node_id").alias("caller")).distinct()
    return s.select("node_id", F.explode("dependencies.upstream_callers").alias("caller")).distinct().join(bad, "caller", "left_semi").groupBy("node_id").agg(F.count("*").alias("rejected_callers"))


@query("WITH c AS (SELECT DISTINCT node_id, project_name, teaching_layer.reasoning_vectors AS rv FROM aletheia_skill), k AS (SELECT project_name, node_id, floor((coalesce(least(1.0e0, length(rv.intent) / 100.0e0), 0) + coalesce(least(1.0e0, length(rv.strategy) / 100.0e0), 0) + CASE WHEN len(rv.constraints) > 0 THEN 0.5e0 ELSE 0 END) * CASE WHEN count(*) OVER (PARTITION BY coalesce(rv.intent, ''), coalesce(rv.strategy, '')) > 1 THEN 0.15e0 ELSE 1.0e0 END * 10000 + 0.5) / 10000 AS score FROM c) SELECT project_name, arg_min(node_id, (-score, node_id)) AS node_id, max(score) AS score FROM k GROUP BY project_name")
def best_candidates(spark, d):
    """Per project the node whose reasoning says most; what was said before counts 0.15 of it."""
    s = records.once(load(spark, d, "aletheia_skill").select("node_id", "project_name", F.col(_RV).alias("rv")), "node_id")
    s = s.select("node_id", "project_name", F.col("rv.intent").alias("a"), F.col("rv.strategy").alias("b"), F.col("rv.constraints").alias("c"), F.md5(F.concat_ws("\u0001", F.coalesce("rv.intent", F.lit("")), F.coalesce("rv.strategy", F.lit("")))).alias("fp"))
    seen = s.groupBy("fp").agg(F.count("*").alias("times"))
    raw = F.coalesce(F.least(F.lit(1.0), F.length("a") / 100.0), F.lit(0.0)) + F.coalesce(F.least(F.lit(1.0), F.length("b") / 100.0), F.lit(0.0)) + F.when(F.size("c") > 0, 0.5).otherwise(0.0)
    k = s.join(seen, "fp").select("project_name", "node_id", S.r4(raw * F.when(F.col("times") > 1, 0.15).otherwise(1.0)).alias("score"))
    return k.groupBy("project_name").agg(F.min_by("node_id", F.struct((-F.col("score")).alias("s"), "node_id")).alias("node_id"), F.max("score").alias("score"))


_POLICY = "CASE WHEN n >= 3 AND mean > 0.65e0 THEN 'drift_push' ELSE '-' END AS slr_action, CASE WHEN spread > 0.2e0 THEN 'freeze' ELSE '-' END AS drift_action, CASE WHEN least_ < 0.1e0 THEN 'quality_alert' ELSE '-' END AS quality_action"


@query(f"WITH a AS (SELECT event_type, count(*) AS n, floor(avg(value) / 500 * 10000 + 0.5) / 10000 AS mean, floor(stddev_samp(value) / 500 * 10000 + 0.5) / 10000 AS spread, floor(min(value) / 500 * 10000 + 0.5) / 10000 AS least_ FROM events GROUP BY event_type) SELECT event_type, n, mean, {_POLICY}, floor(greatest(0.0e0, least(0.2e0, 1.0e0 - least(1.0e0, mean * (1.0e0 - spread / 0.2e0) * 0.5e0))) * 10000 + 0.5) / 10000 AS pressure FROM a")
def telemetry_policy(spark, d):
    """What the aggregates of each kind of event ask for, and the pressure they put on the system."""
    a = load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), S.r4(F.avg("value") / 500).alias("mean"), S.r4(F.stddev_samp("value") / 500).alias("spread"), S.r4(F.min("value") / 500).alias("least"))
    pressure = S.clip(1.0 - F.least(F.lit(1.0), F.col("mean") * (1.0 - F.col("spread") / 0.2) * 0.5), 0.0, 0.2)
    say = lambda c, what: F.when(c, what).otherwise("-")
    return a.select("event_type", "n", "mean", say((F.col("n") >= 3) & (F.col("mean") > 0.65), "drift_push").alias("slr_action"), say(F.col("spread") > 0.2, "freeze").alias("drift_action"), say(F.col("least") < 0.1, "quality_alert").alias("quality_action"), S.r4(pressure).alias("pressure"))


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, lead(embedding::DOUBLE[]) OVER (ORDER BY vec_id) AS u FROM embeddings) SELECT a.vec_id, floor((1.0e0 - greatest(0.0e0, least(1.0e0, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (greatest(0.15e0, sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))) * greatest(0.15e0, sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))))))) * 1000 + 0.5) / 1000 AS slr FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def floored_drift(spark, d):
    """Drift from each vector to the next by a cosine whose norms have a floor; three digits."""
    e = load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u")), "vec_id")
    return j.select("vec_id", (F.floor((1.0 - S.floored_cosine(F.col("v"), F.col("u"))) * 1000 + 0.5) / 1000).alias("slr"))


@query("WITH p AS (SELECT DISTINCT payload_id, theory_text AS t, implementation_code AS c, text_to_code_ratio AS r FROM advocate_payload), s AS (SELECT payload_id, (coalesce(length(t), 0) > 0)::INT::DOUBLE AS tb, (coalesce(length(c), 0) > 0)::INT::DOUBLE AS df, (coalesce(r, 0) > 0)::INT::DOUBLE AS rs FROM p) SELECT payload_id, concat_ws(';', concat_ws(',', tb, 0.0e0, 0.0e0, 0.0e0), concat_ws(',', tb, 0.0e0, 0.0e0, 0.5e0), concat_ws(',', tb, df, rs, 1.0e0), concat_ws(',', 0.0e0, 0.0e0, 0.0e0, 0.5e0)) AS matrix, '0.0,0.0,1.0,0.0' AS response FROM s")
def step_matrix(spark, d):
    """The rows and responses of the steps error, Diagnosis, fix and wait, for payloads as debugging loops."""
    p = records.once(load(spark, d, "advocate_payload").select("payload_id", "theory_text", "implementation_code", "text_to_code_ratio"), "payload_id")
    labels = F.array(*[F.lit(x) for x in ("error", "Diagnosis", "fix", "wait")])
    t = S.trajectory(labels, F.col("theory_text"), F.col("implementation_code"), F.when(F.col("text_to_code_ratio") > 0, "x"))
    row = lambda x: F.array_join(F.transform(x["row"], lambda v: v.cast("string")), ",")
    return p.select("payload_id", F.array_join(F.transform(t, row), ";").alias("matrix"), F.array_join(F.transform(t, lambda x: x["response"].cast("string")), ",").alias("response"))


@query()
def code_density(spark, d):
    """Depth, docstrings and type hints of the Python nodes."""
    s = records.once(load(spark, d, "aletheia_skill").where(F.lower("file").endswith(".py")).select("node_id", "code_snippet"), "node_id")
    m = s.select("node_id", S.code_measures("code_snippet").alias("m"))
    return m.select("node_id", F.round(F.col("m")[0], 4).alias("density"), F.col("m")[1].cast("int").alias("depth"), (F.col("m")[2] > 0).alias("documented"), F.round(F.col("m")[3], 4).alias("hinted"))
