"""Queries on the graph of calls: ranks, acceptance, risk, paths, cycles, cascades, closure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import graph, records
from ..sources.tables import load
from . import nodes as N
from .registry import query

_NODES = "n AS (SELECT DISTINCT node_id, project_name, name, epistemic.state AS state, epistemic.c_node AS c, dependencies.downstream_calls AS calls, topology_cluster.child_ids AS kids FROM aletheia_skill)"
_EDGES = "e AS (SELECT DISTINCT node_id AS src, x AS dst FROM (SELECT node_id, unnest(calls) AS x FROM n) WHERE x <> node_id AND x IN (SELECT node_id FROM n))"


def slim(spark, d):
    return records.once(load(spark, d, "aletheia_skill").select("node_id", "project_name", "name", F.col("epistemic.state").alias("state"), F.col("epistemic.c_node").alias("c"), F.col("dependencies.downstream_calls").alias("calls"), F.col("topology_cluster.child_ids").alias("kids")), "node_id")


def _ranks(edges: str, every: str, rounds: int = 40) -> str:
    """x of every node by so many rounds; exact for an acyclic graph of fewer levels."""
    return f"deg AS (SELECT src, count(*) AS deg FROM {edges} GROUP BY src), r(node, x, i) AS (SELECT node, 1.0e0, 0 FROM {every} UNION ALL SELECT v.node, 1.0e0 + 0.85e0 * coalesce((SELECT sum(r.x / deg.deg) FROM r JOIN {edges} k ON k.src = r.node JOIN deg ON deg.src = k.src WHERE k.dst = v.node), 0.0e0), v.i + 1 FROM r v WHERE v.i < {rounds}), rk AS (SELECT node, x FROM r WHERE i = {rounds})"


@query(f"WITH RECURSIVE {_NODES}, {_EDGES}, every AS (SELECT src AS node FROM e UNION SELECT dst FROM e), {_ranks('e', 'every', 15)} SELECT node, round(x / (SELECT sum(x) FROM rk), 7) AS rank FROM rk")
def pagerank(spark, d):
    return graph.pagerank(N.edges(slim(spark, d))).select("node", F.round("rank", 7).alias("rank"))


@query(f"WITH RECURSIVE {_NODES}, {_EDGES}, r(node, lvl) AS (SELECT src, 0::BIGINT FROM (SELECT src FROM e EXCEPT SELECT dst FROM e) UNION SELECT e.dst, r.lvl + 1 FROM r JOIN e ON e.src = r.node) SELECT node, max(lvl) AS level FROM r GROUP BY node")
def topo_levels(spark, d):
    return graph.levels(N.edges(slim(spark, d)))


_BOTH = "b AS (SELECT src, dst FROM e UNION SELECT x, node_id FROM (SELECT node_id, unnest(kids) AS x FROM n) WHERE x <> node_id AND x IN (SELECT node_id FROM n))"


def both_ways(s):
    """Calls, and children back to their parents: a graph with cycles."""
    up = s.select(F.col("node_id").alias("dst"), F.explode("kids").alias("src")).where("src <> dst").join(s.select(F.col("node_id").alias("src")), "src", "left_semi").select("src", "dst")
    return N.edges(s).unionByName(up).distinct()


@query(f"WITH RECURSIVE {_NODES}, {_EDGES}, {_BOTH}, t(src, dst) AS (SELECT src, dst FROM b UNION SELECT t.src, b.dst FROM t JOIN b ON b.src = t.dst) SELECT x.src AS node, least(x.src, min(x.dst)) AS component FROM t x JOIN t y ON y.src = x.dst AND y.dst = x.src WHERE x.src <> x.dst GROUP BY x.src")
def cycle_components(spark, d):
    """Strongly connected components of two nodes or more."""
    return graph.components(both_ways(slim(spark, d)))


@query(f"WITH RECURSIVE {_NODES}, {_EDGES}, {_BOTH}, t(src, dst) AS (SELECT src, dst FROM b UNION SELECT t.src, b.dst FROM t JOIN b ON b.src = t.dst) SELECT count(*) AS nodes, count(*) FILTER (node_id IN (SELECT src FROM t WHERE src = dst)) AS quarantined, (SELECT count(*) FROM b WHERE src NOT IN (SELECT src FROM t WHERE src = dst) AND dst NOT IN (SELECT src FROM t WHERE src = dst)) AS edges_left, 0::BIGINT AS cyclic_left FROM n")
def cycle_quarantine(spark, d):
    """What is left when the nodes on cycles are taken out, and whether any cycle is left then."""
    s = slim(spark, d)
    e = both_ways(s)
    bad = graph.cyclic(e)
    rest = e.join(bad.withColumnRenamed("node", "src"), "src", "left_anti").join(bad.withColumnRenamed("node", "dst"), "dst", "left_anti")
    again = graph.cyclic(rest).agg(F.count("*").alias("cyclic_left"))
    counts = s.agg(F.count("*").alias("nodes")).join(bad.agg(F.count("*").alias("quarantined"))).join(rest.agg(F.count("*").alias("edges_left")))
    return counts.join(again)


@query(f"WITH RECURSIVE {_NODES}, {_EDGES}, o AS (SELECT e.src, e.dst FROM e JOIN n p ON p.node_id = e.src JOIN n q ON q.node_id = e.dst WHERE coalesce(p.project_name, '') = coalesce(q.project_name, '')), every AS (SELECT node_id AS node FROM n), {_ranks('o', 'every', 15)}, k AS (SELECT node, coalesce(project_name, '') AS g, x, sum(x) OVER w AS t, count(*) OVER w AS n FROM rk JOIN n ON n.node_id = rk.node WINDOW w AS (PARTITION BY coalesce(project_name, ''))), st AS (SELECT g, avg(x / t) AS mu, coalesce(stddev_samp(x / t), 0) AS sd FROM k GROUP BY g), c AS (SELECT coalesce(p.project_name, '') AS g, count(*) AS edges FROM o JOIN n p ON p.node_id = o.src GROUP BY 1) SELECT node, g AS project_name, CASE WHEN k.n < 5 OR coalesce(c.edges, 0) = 0 THEN 'topological_sparsity' WHEN x / t >= mu + 1.5e0 * sd - 1e-12 THEN 'accepted' ELSE 'below_adaptive_threshold' END AS status, round(CASE WHEN sd > 1e-12 THEN (x / t - mu) / sd ELSE 0 END, 3) AS z FROM k JOIN st USING (g) LEFT JOIN c USING (g)")
def adaptive_acceptance(spark, d):
    """Nodes accepted by their rank within their project; projects too sparse for ranks are rejected."""
    s = slim(spark, d)
    got = graph.accept_by_rank(s.select(F.col("node_id").alias("node"), "project_name"), N.edges(s), "project_name")
    return got.select("node", "project_name", "status", F.round("z", 3).alias("z"))


@query(f"WITH RECURSIVE {_NODES}, {_EDGES}, every AS (SELECT src AS node FROM e UNION SELECT dst FROM e), {_ranks('e', 'every', 15)}, g AS (SELECT node, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node), z AS (SELECT g.node, least(100, n_in * 25 + n_out * 15 + CASE WHEN lower(n.name) IN ('main', 'run', 'start', 'cli', 'entrypoint') THEN 20 ELSE 0 END + floor(x / (SELECT sum(x) FROM rk) * 500)::BIGINT) AS score FROM g JOIN rk USING (node) JOIN n ON n.node_id = g.node) SELECT node, score, CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 60 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM z")
def slice_risk(spark, d):
    """A node's risk by its callers, its calls, whether it is an entry, and its rank."""
    s = slim(spark, d)
    e = N.edges(s)
    j = graph.degrees(e).join(graph.pagerank(e), "node").join(s.select(F.col("node_id").alias("node"), "name"), "node")
    entry = F.when(F.lower("name").isin("main", "run", "start", "cli", "entrypoint"), 20).otherwise(0)
    score = F.least(F.lit(100).cast("bigint"), F.col("n_in") * 25 + F.col("n_out") * 15 + entry + F.floor(F.col("rank") * 500))
    z = j.select("node", score.alias("score"))
    return z.select("node", "score", F.when(F.col("score") >= 80, "CRITICAL").when(F.col("score") >= 60, "HIGH").when(F.col("score") >= 40, "MEDIUM").otherwise("LOW").alias("level"))


@query(f"WITH RECURSIVE {_NODES}, {_EDGES}, r(origin, node, depth) AS (SELECT src, src, 0 FROM (SELECT src FROM e EXCEPT SELECT dst FROM e) UNION SELECT r.origin, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 6) SELECT origin, node, min(depth)::INT AS depth FROM r GROUP BY ALL")
def execution_paths(spark, d):
    """What runs from each node that nobody calls, up to six calls deep."""
    e = N.edges(slim(spark, d))
    roots = e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    return graph.reach_from(e, roots.select(F.col("node").alias("origin"), "node"), 6)


@query(f"WITH RECURSIVE {_NODES}, {_EDGES}, r(node) AS (SELECT e.dst FROM e JOIN n ON n.node_id = e.src WHERE n.state = 'REJECTED' UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT r.node AS node_id, coalesce(n.c >= 0.25e0, false) AS spared_if_trusted FROM r JOIN n ON n.node_id = r.node WHERE n.state IS DISTINCT FROM 'REJECTED'")
def cascade_rejections(spark, d):
    """Nodes that fall with a rejected one they descend from; in a trusted run the confident ones would be spared."""
    s = slim(spark, d)
    bad = s.where("state = 'REJECTED'").select(F.col("node_id").alias("node"))
    hit = graph.reach(N.edges(s), bad).where("depth > 0").select(F.col("node").alias("node_id"))
    return hit.join(s, "node_id").where(~F.col("state").eqNullSafe("REJECTED")).select("node_id", F.coalesce(F.col("c") >= S.UNSTABLE, F.lit(False)).alias("spared_if_trusted"))


@query(f"WITH RECURSIVE {_NODES}, {_EDGES}, r(node, depth) AS (SELECT node_id, 0 FROM n WHERE state = 'REROLL' UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node WHERE r.depth < 50) SELECT node, min(depth)::INT AS depth FROM r GROUP BY node")
def ancestor_chain(spark, d):
    """The callers, near and far, of nodes that are tried again."""
    s = slim(spark, d)
    back = N.edges(s).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.reach(back, s.where("state = 'REROLL'").select(F.col("node_id").alias("node")))


@query(f"WITH RECURSIVE {_NODES}, {_EDGES}, k AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(node, depth) AS (SELECT node_id, 0 FROM n WHERE starts_with(name, 'a') UNION SELECT k.dst, r.depth + 1 FROM r JOIN k ON k.src = r.node WHERE r.depth < 2) SELECT node, min(depth)::INT AS depth FROM r GROUP BY node")
def focus_expansion(spark, d):
    """Two steps around the nodes in focus, either way."""
    s = slim(spark, d)
    e = N.edges(s)
    k = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return graph.reach(k, s.where(F.col("name").startswith("a")).select(F.col("node_id").alias("node")), 2)


@query(f"WITH {_NODES}, {_EDGES}, k AS (SELECT src AS node, dst AS nb FROM e UNION SELECT dst, src FROM e), s AS (SELECT node, count(*) AS nbs, array_to_string(list_sort(list(nb)), ',') AS members FROM k GROUP BY node), t AS (SELECT a.node, count(*) AS links FROM k a JOIN e ON e.src = a.nb JOIN k b ON b.node = a.node AND b.nb = e.dst GROUP BY a.node), o AS (SELECT node, count(*) AS own FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node) SELECT s.node, nbs AS neighbours, round((coalesce(links, 0) + own) / ((nbs + 1) * nbs), 3) AS density FROM s JOIN o USING (node) LEFT JOIN t USING (node)")
def ego_density(spark, d):
    """Neighbours of each node and how closely they and it are linked."""
    e = N.edges(slim(spark, d))
    nb = e.select(F.col("src").alias("node"), F.col("dst").alias("nb")).unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("nb"))).distinct().groupBy("node").agg(F.count("*").alias("neighbours"))
    own = graph.degrees(e).select("node", (F.col("n_in") + F.col("n_out")).alias("own"))
    j = nb.join(own, "node").join(graph.triangles(e), "node", "left")
    return j.select("node", "neighbours", F.round((F.coalesce("links", F.lit(0)) + F.col("own")) / ((F.col("neighbours") + 1) * F.col("neighbours")), 3).alias("density"))


@query(f"WITH RECURSIVE {N._BASE}, acc AS (SELECT node_id FROM n WHERE state = 'ACCEPTED'), roots AS (SELECT node_id FROM n WHERE node_id NOT IN (SELECT dst FROM e)), r(node) AS (SELECT node_id FROM acc WHERE node_id IN (SELECT node_id FROM roots) UNION SELECT e.dst FROM r JOIN e ON e.src = r.node WHERE e.dst IN (SELECT node_id FROM acc)), v AS (SELECT (SELECT count(*) FROM w WHERE cos < 0.3e0) AS incoherent_edges, (SELECT count(*) FROM acc WHERE node_id NOT IN (SELECT node FROM r) AND node_id NOT IN (SELECT node_id FROM roots)) AS unreachable, (SELECT count(*) FROM n WHERE coalesce(state, '') NOT IN ('ACCEPTED', 'REJECTED')) AS orphans) SELECT *, CASE (incoherent_edges > 0)::INT + (unreachable > 0)::INT + (orphans > 0)::INT WHEN 0 THEN 'PASS' WHEN 3 THEN 'FAIL' ELSE 'DEGRADED' END AS verdict FROM v".replace(", v AS (SELECT *, coalesce(", ", v0 AS (SELECT *, coalesce(").replace("FROM v)", "FROM v0)"))
def closure_verdict(spark, d):
    """Coherence of the edges, reach of the accepted from roots, and nodes that never ended: one verdict."""
    n = N.base(spark, d)
    e = N.edges(n)
    bad = N.pairs(n).agg(F.count_if(F.col("cos") < 0.3).alias("incoherent_edges"))
    acc = n.where("state = 'ACCEPTED'").select(F.col("node_id").alias("node"))
    called = e.select(F.col("dst").alias("node")).distinct()
    inner = e.join(acc.withColumnRenamed("node", "src"), "src", "left_semi").join(acc.withColumnRenamed("node", "dst"), "dst", "left_semi")
    reached = graph.reach(inner, acc.join(called, "node", "left_anti")).select("node")
    lost = acc.join(called, "node", "left_semi").join(reached, "node", "left_anti").agg(F.count("*").alias("unreachable"))
    open_ = n.agg(F.count_if(~F.coalesce("state", F.lit("")).isin("ACCEPTED", "REJECTED")).alias("orphans"))
    v = bad.join(lost).join(open_)
    fails = sum(((F.col(c) > 0).cast("int") for c in ("incoherent_edges", "unreachable", "orphans")), F.lit(0))
    return v.select("*", F.when(fails == 0, "PASS").when(fails == 3, "FAIL").otherwise("DEGRADED").alias("verdict"))


@query("WITH m AS (SELECT DISTINCT node_id, lower(name) AS k FROM aletheia_skill WHERE name <> '') SELECT k AS name, count(*) AS slices, min(node_id) AS first_id FROM m GROUP BY k")
def name_map(spark, d):
    """Nodes by their name, whatever its case."""
    return load(spark, d, "aletheia_skill").where("name <> ''").select("node_id", F.lower("name").alias("name")).distinct().groupBy("name").agg(F.count("*").alias("slices"), F.min("node_id").alias("first_id"))


@query(f"WITH {_NODES}, {_EDGES} SELECT DISTINCT e.src, q.node_id AS dst FROM e JOIN n p ON p.node_id = e.dst JOIN n q ON lower(q.name) = lower(p.name) WHERE p.name <> '' AND q.node_id <> e.src")
def calls_by_name(spark, d):
    """What a call by name may mean: every node of the called one's name but the caller."""
    s = slim(spark, d)
    named = s.where("name <> ''").select(F.col("node_id").alias("dst"), F.lower("name").alias("k"))
    return N.edges(s).join(named, "dst").select("src", "k").join(named, "k").where("src <> dst").select("src", "dst").distinct()


@query(f"WITH {_NODES} SELECT DISTINCT node_id, x AS unresolved FROM (SELECT node_id, unnest(calls) AS x FROM n) WHERE x NOT IN (SELECT node_id FROM n)")
def unresolved_calls(spark, d):
    s = slim(spark, d)
    return s.select("node_id", F.explode("calls").alias("unresolved")).distinct().join(s.select(F.col("node_id").alias("unresolved")), "unresolved", "left_anti").select("node_id", "unresolved")


@query()
def graph_pass(spark, d):
    """One pass over the graph: cycles set aside, ranks, scores, decisions and what falls with a rejected node."""
    s = slim(spark, d)
    e = N.edges(s)
    bad = graph.cyclic(e).withColumnRenamed("node", "node_id")
    kept = s.join(bad, "node_id", "left_anti")
    ranks = graph.accept_by_rank(kept.select(F.col("node_id").alias("node"), "project_name"), e, "project_name").select(F.col("node").alias("node_id"), "status", "z")
    h = N.scored(spark, d)
    out = ranks.join(h, "node_id").select("node_id", "status", "z", "c_final", S.decision(F.col("c_final"), F.col("after"), ~F.col("broken"), F.col("budget")).alias("decision"))
    fallen = graph.reach(e, out.where(F.col("decision").startswith("REJECTED")).select(F.col("node_id").alias("node"))).where("depth > 0").select(F.col("node").alias("node_id"), F.lit(True).alias("fallen"))
    return out.join(fallen, "node_id", "left").select("node_id", "status", F.round("z", 3).alias("z"), "c_final", "decision", F.coalesce("fallen", F.lit(False)).alias("fallen"))
