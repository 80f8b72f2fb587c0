"""Graphs as edge tables (src, dst): degrees, rank, reach, levels, components. Every loop cuts its lineage by a written table and
runs until nothing changes; chains are folded by pointer jumping first, so a long chain costs rounds as its logarithm."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize


class NotConverged(RuntimeError):
    """An iteration did not settle within its rounds."""


def edges_of(nodes: DataFrame, key: str, calls) -> DataFrame:
    """Distinct edges without loops to known nodes."""
    e = nodes.select(F.col(key).alias("src"), F.explode(calls).alias("dst")).where("src <> dst and dst is not null").distinct()
    return e.join(nodes.select(F.col(key).alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out)."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


#: Rounds within which ranks must settle.
LIMIT = 200


def influence(edges: DataFrame, nodes: DataFrame | None = None, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-9, limit: int = LIMIT) -> DataFrame:
    """(node, x): one and damped shares of the callers', until no x moves by more than the tolerance.

    Sharing the rank of nodes without exits evenly only scales all ranks, so
    the ranks of a graph are x over the sum of x, and no total is needed in
    the rounds. nodes adds such without edges. Raises NotConverged if `limit`
    rounds do not do; an acyclic graph needs as many as it has levels. Where
    rounds are given, the x after so many is asked for, settled or not.
    """
    e = edges.select("src", "dst").distinct()
    e = materialize(e.join(e.groupBy("src").agg(F.count("*").alias("deg")), "src"), "weighted")
    every = e.select(F.explode(F.array("src", "dst")).alias("node"))
    if nodes is not None:
        every = every.unionByName(nodes.select("node"))
    x = materialize(every.distinct().withColumn("x", F.lit(1.0)), "influence")
    moved = None
    for _ in range(limit if rounds is None else rounds):
        got = e.join(x.select(F.col("node").alias("src"), "x"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("x") / F.col("deg")).alias("s"))
        new = materialize(x.join(got, "node", "left").select("node", F.col("x").alias("old"), (1.0 + damping * F.coalesce("s", F.lit(0.0))).alias("x")), "influence")
        moved = new.agg(F.max(F.abs(F.col("x") - F.col("old")))).first()[0]
        x = new.drop("old")
        if moved is None or moved <= tolerance:
            return x
    if rounds is None:
        raise NotConverged(f"ranks still moved by {moved} after {limit} rounds")
    return x


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-9, limit: int = LIMIT) -> DataFrame:
    """(node, rank), adding up to 1; ranks of nodes without exits are shared evenly. An empty graph has no ranks."""
    x = influence(edges, None, damping, rounds, tolerance, limit)
    return x.join(F.broadcast(x.agg(F.sum("x").alias("t")))).select("node", (F.col("x") / F.col("t")).alias("rank"))


def reach(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, depth): the least number of steps from any start, up to `depth`, without it as far as edges go."""
    return reach_from(edges, starts.select(F.lit(0).alias("origin"), "node"), depth).select("node", "depth")


def reach_from(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(origin, node, depth) for starts (origin, node): the least number of steps from any of the origin's starts."""
    seen = materialize(starts.select("origin", "node").distinct().withColumn("depth", F.lit(0)), "reach")
    front = seen
    for k in count(1):
        if depth is not None and k > depth:
            break
        step = edges.join(front.select("origin", F.col("node").alias("src")), "src").select("origin", F.col("dst").alias("node")).distinct().join(seen, ["origin", "node"], "left_anti")
        front = materialize(step.withColumn("depth", F.lit(k)), "front")
        if front.isEmpty():
            break
        seen = materialize(seen.unionByName(front), "reach")
    return seen


def _follow(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, end, steps, least) of nodes whose single link leads, by others of the table, to an end outside of it; and
    (node, least) of those on rings, least the least node of the ring. Pointer jumping: rounds as the logarithm of the length."""
    p = materialize(links.select("node", F.col("next").alias("end"), F.lit(1).cast("bigint").alias("steps"), F.least("node", "next").alias("least")), "pointers")
    n = p.count()
    reached = 1
    while reached <= 2 * n:
        q = p.select(F.col("node").alias("end"), F.col("end").alias("e2"), F.col("steps").alias("s2"), F.col("least").alias("l2"))
        p = materialize(p.join(q, "end", "left").select("node", F.coalesce("e2", "end").alias("end"), (F.col("steps") + F.coalesce("s2", F.lit(0))).alias("steps"), F.least("least", F.coalesce("l2", "least")).alias("least")), "pointers")
        reached *= 2
        if p.join(p.select(F.col("node").alias("end")), "end", "left_semi").isEmpty():
            break
    ring = p.join(p.select(F.col("node").alias("end")), "end", "left_semi")
    return p.join(ring.select("node"), "node", "left_anti"), ring.select("node", "least")


class Folded:
    """A graph whose chains (nodes with one way in and one way out) are single edges.

    edges: (src, dst, w), w the longest of the parallel ways. inside: (node,
    head, tail, at) of each chain's node, at its steps behind head. rings:
    (node, least), the cycles that no other node touches.
    """

    def __init__(self, edges: DataFrame):
        e = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "graph")
        d = degrees(e)
        inner = materialize(d.where("n_in = 1 and n_out = 1").select("node"), "inner")
        ahead, rings = _follow(e.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("next")))
        rings = materialize(rings, "rings")
        back, _ = _follow(e.join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi").join(rings.select(F.col("node").alias("dst")), "dst", "left_anti").select(F.col("dst").alias("node"), F.col("src").alias("next")))
        to = ahead.select("node", F.col("end").alias("tail"), "steps")
        self.inside = materialize(to.select("node", "tail").join(back.select("node", F.col("end").alias("head"), F.col("steps").alias("at")), "node").select("node", "head", "tail", "at"), "inside")
        outer = e.join(inner.withColumnRenamed("node", "src"), "src", "left_anti")
        ways = outer.join(to.withColumnRenamed("node", "dst"), "dst", "left").select("src", F.coalesce("tail", "dst").alias("dst"), (1 + F.coalesce("steps", F.lit(0))).alias("w"))
        self.edges = materialize(ways.groupBy("src", "dst").agg(F.max("w").alias("w")), "folded")
        self.rings = rings


def levels(edges: DataFrame) -> DataFrame:
    """(node, level BIGINT): the longest path to each node; nodes on or behind a cycle have level -1."""
    g = Folded(edges)
    left = g.edges
    nodes = materialize(left.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "nodes")
    rest = materialize(nodes.withColumn("level", F.lit(0).cast("bigint")), "rest")
    parts = []
    while True:  # every round takes a node or is the last
        free = materialize(rest.join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"), "free")
        if free.isEmpty():
            break
        parts.append(free)
        out = left.join(free.select(F.col("node").alias("src"), "level"), "src").groupBy(F.col("dst").alias("node")).agg(F.max(F.col("level") + F.col("w")).alias("l2"))
        rest = materialize(rest.join(free.select("node"), "node", "left_anti").join(out, "node", "left").select("node", F.greatest("level", F.coalesce("l2", "level")).alias("level")), "rest")
        left = materialize(left.join(free.select(F.col("node").alias("src")), "src", "left_anti"), "left")
    known = rest.withColumn("level", F.lit(-1).cast("bigint"))
    for part in parts:
        known = known.unionByName(part)
    known = materialize(known, "levels")
    head = known.select(F.col("node").alias("head"), "level")
    chains = g.inside.join(head, "head").select("node", F.when(F.col("level") >= 0, F.col("level") + F.col("at")).otherwise(-1).alias("level"))
    return known.unionByName(chains).unionByName(g.rings.select("node", F.lit(-1).cast("bigint").alias("level")))


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the connected components, ways either way, named by their least node.

    Each round takes the least label among the neighbours and then the label of
    that label, so rounds are as the logarithm of the longest way.
    """
    both = materialize(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "both")
    label = materialize(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("label")), "labels")
    while True:  # every round lowers a label or is the last
        low = both.join(label.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("l2"))
        new = label.join(low, "node").select("node", "label", F.least("label", "l2").alias("m"))
        new = new.join(label.select(F.col("node").alias("m"), F.col("label").alias("l3")), "m").select("node", F.least("m", "l3").alias("label"), (F.least("m", "l3") < F.col("label")).alias("moved"))
        new = materialize(new, "labels")
        label = new.select("node", "label")
        if new.where("moved").isEmpty():
            return label


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the members of the strongly connected components of two nodes or more, named by their least node.

    A few rounds take off what has no way in or out, which is all of a shallow
    graph without cycles. Nodes that call each other are merged, until no two
    do; what is left is searched as a folded graph.
    """
    e = _peel(edges.select("src", "dst").where("src <> dst").distinct(), TRIMS)
    if e.isEmpty():
        return e.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    merged = None
    while True:  # every round merges nodes or is the last
        mutual = materialize(e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi"), "mutual")
        if mutual.isEmpty():
            break
        c = connected(mutual)
        if merged is None:
            merged = c
        else:
            later = merged.join(c.select(F.col("node").alias("label"), F.col("label").alias("l2")), "label", "left").select("node", F.coalesce("l2", "label").alias("label"))
            merged = materialize(later.unionByName(c.join(merged.select("node"), "node", "left_anti")), "merged")
        a, b = c.select(F.col("node").alias("src"), F.col("label").alias("a")), c.select(F.col("node").alias("dst"), F.col("label").alias("b"))
        e = materialize(e.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst")).where("src <> dst").distinct(), "graph")
    inner = materialize(_without_mutual(e), "components")
    if merged is None:
        return inner
    whole = merged.join(inner.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("component", "label").alias("g"))
    whole = materialize(whole.unionByName(inner.join(merged.select("node"), "node", "left_anti").select("node", F.col("component").alias("g"))), "whole")
    return whole.join(whole.groupBy("g").agg(F.min("node").alias("component")), "g").select("node", "component")


def _without_mutual(edges: DataFrame) -> DataFrame:
    """The components of a graph in which no two nodes call each other.

    Rings come from the pointers. The folded rest is peeled of nodes without a
    way in or out; the largest name that reaches a node spreads along the
    edges, and what leads back to its owner under that name is a component.
    """
    g = Folded(edges)
    found = [g.rings.select("node", F.col("least").alias("component"))]
    # A fold that leads back to its own head is a component by itself.
    left = _peel(g.edges.select("src", "dst").where("src <> dst"))
    own = g.edges.where("src = dst").select(F.col("src").alias("node"))
    cores = []
    while not left.isEmpty():
        name = materialize(left.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("name", F.col("node")), "names")
        while True:
            up = left.join(name.select(F.col("node").alias("src"), "name"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("name").alias("n2"))
            new = materialize(name.join(up, "node", "left").select("node", F.greatest("name", F.coalesce("n2", "name")).alias("name"), (F.col("n2") > F.col("name")).alias("moved")), "names")
            name = new.select("node", "name")
            if new.where("moved").isEmpty():
                break
        s, t = name.select(F.col("node").alias("src"), F.col("name").alias("a")), name.select(F.col("node").alias("dst"), F.col("name").alias("b"))
        same = materialize(left.join(s, "src").join(t, "dst").where("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("a").alias("name")), "same")
        core = reach(same.select("src", "dst"), name.where("node = name").select("node")).select("node").join(name, "node")
        core = materialize(core, "core")
        cores.append(core)
        left = _peel(left.join(core.select(F.col("node").alias("src")), "src", "left_anti").join(core.select(F.col("node").alias("dst")), "dst", "left_anti"))
    if cores:
        named = cores[0]
        for c in cores[1:]:
            named = named.unionByName(c)
        # Nodes that stand alone under their name are no component, unless a fold leads back to them.
        named = named.unionByName(own.join(named.select("node"), "node", "left_anti").select("node", F.col("node").alias("name")))
    else:
        named = own.select("node", F.col("node").alias("name"))
    named = materialize(named, "named")
    h, t = named.select(F.col("node").alias("head"), "name"), named.select(F.col("node").alias("tail"), F.col("name").alias("n2"))
    chains = g.inside.join(h, "head").join(t, "tail").where("name = n2").select("node", "name")
    whole = materialize(named.unionByName(chains), "whole")
    least = whole.groupBy("name").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
    found.append(whole.join(least, "name").select("node", "component"))
    return found[0].unionByName(found[1])


#: Rounds of peeling before a graph is folded.
TRIMS = 6


def _peel(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """The edges that are left when nodes without a way in or without a way out are taken off, so many times or as often as it helps."""
    e = materialize(edges, "peel")
    size = e.count()
    for k in count():  # every round takes an edge or is the last
        if not size or k == rounds:
            break
        e2 = materialize(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "peel")
        new = e2.count()
        e = e2
        if new == size:
            break
        size = new
    return e


def cyclic(edges: DataFrame) -> DataFrame:
    """(node): the nodes on cycles, those that call themselves included."""
    own = edges.where("src = dst").select(F.col("src").alias("node"))
    return components(edges).select("node").unionByName(own).distinct()


def triangles(edges: DataFrame) -> DataFrame:
    """(node, links): how many directed edges run between the neighbours of each node.

    Each edge asks the neighbours of its end with fewer of them, so a hub is
    not opened for every one of its edges.
    """
    nb = edges.select(F.col("src").alias("node"), F.col("dst").alias("nb")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("nb"))).distinct()
    deg = nb.groupBy("node").agg(F.count("*").alias("deg"))
    e = edges.join(deg.select(F.col("node").alias("src"), F.col("deg").alias("d1")), "src").join(deg.select(F.col("node").alias("dst"), F.col("deg").alias("d2")), "dst")
    e = e.select(F.when(F.col("d1") <= F.col("d2"), F.col("src")).otherwise(F.col("dst")).alias("few"), F.when(F.col("d1") <= F.col("d2"), F.col("dst")).otherwise(F.col("src")).alias("many"))
    asked = e.join(nb.select(F.col("node").alias("few"), F.col("nb").alias("centre")), "few").where("centre <> many")
    met = asked.join(nb.select(F.col("node").alias("many"), F.col("nb").alias("centre")), ["many", "centre"])
    return met.groupBy(F.col("centre").alias("node")).agg(F.count("*").alias("links"))


def accept_by_rank(nodes: DataFrame, edges: DataFrame, group: str, least: int = 5, sigmas: float = 1.5) -> DataFrame:
    """(node, group, status, rank, z) of nodes (node, group): per group, sparse ones are rejected as a whole; else a node is accepted
    whose rank in its group's own graph is at least the mean and `sigmas` sample deviations. A null group is one, too."""
    own = nodes.select("node", F.coalesce(F.col(group), F.lit("")).alias("g")).distinct()
    e = edges.join(own.select(F.col("node").alias("src"), F.col("g").alias("gs")), "src").join(own.select(F.col("node").alias("dst"), F.col("g").alias("gd")), "dst").where("gs = gd").select("src", "dst", F.col("gs").alias("g"))
    e = materialize(e, "own-edges")
    x = influence(e.select("src", "dst"), own).join(own, "node")
    total = x.groupBy("g").agg(F.sum("x").alias("t"), F.count("*").alias("n"))
    total = total.join(e.groupBy("g").agg(F.count("*").alias("edges")), "g", "left")
    r = x.join(total, "g").select("node", "g", "n", F.coalesce("edges", F.lit(0)).alias("edges"), (F.col("x") / F.col("t")).alias("rank"))
    stats = r.groupBy("g").agg(F.avg("rank").alias("mu"), F.coalesce(F.stddev_samp("rank"), F.lit(0.0)).alias("sd"))
    j = r.join(stats, "g")
    sparse = (F.col("n") < least) | (F.col("edges") == 0)
    # A hair is given, so that equal ranks are not told apart by the order of their sums.
    status = F.when(sparse, "topological_sparsity").when(F.col("rank") >= F.col("mu") + sigmas * F.col("sd") - 1e-12, "accepted").otherwise("below_adaptive_threshold")
    return j.select("node", F.col("g").alias(group), status.alias("status"), "rank", F.when(F.col("sd") > 1e-12, (F.col("rank") - F.col("mu")) / F.col("sd")).otherwise(0.0).alias("z"))
