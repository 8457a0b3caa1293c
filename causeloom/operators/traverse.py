"""Questions about reachability: breadth-first, level by level, first visitor wins.

A level is one join of the frontier with the edges and one anti-join with what was
visited.  The edges are aggregated and checkpointed once for a question.  The order in
which a queue would visit is kept without a global sort: a node's rank is the list of
choices that led to it, compared like a word, so the winner among several visitors is a
``min_by`` in the shuffle by node.  Each level is a table of its own; runs of levels of
like size are merged, so a level is rewritten a few times at most and the plan of a
deep search stays short.  A search ends when a frontier is empty or holds what was
asked for; there is no limit on its depth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph, NoPath, cut

#: Levels of one size that are merged into the next.
MERGE = 8
_HOP = ("relation", "confidence", "gap_min", "gap_max", "negated")


def _steps(graph: Graph, forward: bool) -> DataFrame:
    """(at, to, newest, ...): one row for each pair, the first edge's values, the newest edge's place."""
    e = graph.valid_edges().select("src", "dst", "edge_idx", "relation", "confidence", "gap_min", "gap_max", graph.edge("negated").alias("negated"))
    first = F.min_by(F.struct("edge_idx", *_HOP), "edge_idx").alias("first")
    pairs = e.groupBy("src", "dst").agg(first, F.max("edge_idx").alias("newest"))
    at, to = ("src", "dst") if forward else ("dst", "src")
    return cut(pairs.select(F.col(at).alias("at"), F.col(to).alias("to"), "newest", "first.*"))


class _Levels:
    """Tables of levels, merged like the digits of a counter."""

    def __init__(self, first: DataFrame):
        self.runs = [(1, first)]

    def add(self, level: DataFrame) -> None:
        self.runs.append((1, level))
        while len(self.runs) >= MERGE and len({n for n, _ in self.runs[-MERGE:]}) == 1:
            last = self.runs[-MERGE:]
            self.runs[-MERGE:] = [(sum(n for n, _ in last), cut(reduce(DataFrame.unionByName, [d for _, d in last])))]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [d for _, d in self.runs])


def search(steps: DataFrame, starts: DataFrame, blocked: DataFrame | None = None, stop=None, paths: bool = False) -> DataFrame:
    """Every node reached over ``steps`` from ``starts`` (node_id, and ``turn`` if some start comes first): node_id, depth, via, confidence along the way, rank.

    Nodes of ``blocked`` are neither entered nor left.  With ``stop`` the search ends at the
    level on which that node is found.  ``paths`` adds the hops that led to a node.
    """
    kind = starts.schema["node_id"].dataType.simpleString()
    hop = f"array<struct<src:{kind},dst:{kind},relation:string,confidence:double,gap_min:bigint,gap_max:bigint,negated:boolean>>"
    hops = [F.array().cast(hop).alias("hops")] if paths else []
    frontier = cut(starts.select(
        "node_id", F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("via"), F.lit(1.0).alias("confidence"),
        F.array(F.col("turn").cast("bigint") if "turn" in starts.columns else F.lit(0).cast("bigint")).alias("rank"), *hops,
    ))
    if blocked is not None:
        blocked = cut(blocked.select(F.col("node_id").alias("to")).distinct())
        frontier = frontier.join(blocked.withColumnRenamed("to", "node_id"), "node_id", "left_anti")
    seen, depth = _Levels(frontier), 0
    while frontier.take(1):
        if stop is not None and frontier.where(F.col("node_id") == F.lit(stop)).take(1):
            break
        depth += 1
        found = (
            frontier.select("node_id", F.col("confidence").alias("so_far"), "rank", *["hops"] * paths)
            .join(steps, F.col("node_id") == F.col("at")).join(seen.all().select(F.col("node_id").alias("to")), "to", "left_anti")
        )
        if blocked is not None:
            found = found.join(blocked, "to", "left_anti")
        step = [F.concat("hops", F.array(F.struct(F.col("node_id").alias("src"), F.col("to").alias("dst"), *_HOP)).cast(hop)).alias("hops")] if paths else []
        visit = F.struct(
            F.concat("rank", F.array(-F.col("newest"))).alias("rank"), F.col("node_id").alias("via"),
            F.least("so_far", "confidence").alias("confidence"), *step,
        ).alias("visit")
        won = found.select("to", visit).groupBy("to").agg(F.min_by("visit", "visit.rank").alias("v"))
        frontier = cut(won.select(
            F.col("to").alias("node_id"), F.lit(depth).alias("depth"), "v.via", "v.confidence", "v.rank", *["v.hops"] * paths
        ))
        seen.add(frontier)
    return seen.all()


def _one(graph: Graph, node) -> DataFrame:
    kind = graph.nodes.schema["node_id"].dataType.simpleString()
    return graph.nodes.sparkSession.createDataFrame([(node,)], f"node_id {kind}")


def reach(graph: Graph, label: str, forward: bool = True) -> DataFrame:
    """Every node reached from a label: node_id, depth, via (the node it was found from), confidence along the way."""
    start = graph.best(label)
    return search(_steps(graph, forward), _one(graph, start)).where("depth > 0")


def why(graph: Graph, label: str) -> DataFrame:
    """All causes."""
    return reach(graph, label, forward=False)


def what(graph: Graph, label: str) -> DataFrame:
    """All effects."""
    return reach(graph, label, forward=True)


def explain(graph: Graph, label: str) -> DataFrame:
    """Causes by how well they explain: least confidence on the way over 1 + depth."""
    found = why(graph, label).join(graph.nodes.select("node_id", "label"), "node_id")
    return found.select(
        "label", "depth", F.round("confidence", 6).alias("confidence"), F.round(F.col("confidence") / (1 + F.col("depth")), 6).alias("score")
    ).orderBy(F.desc("score"), "label")


def intervene(graph: Graph, label: str) -> DataFrame:
    """(part, label): edges into a node that an intervention severs, and its effects."""
    node = graph.best(label)
    names = graph.nodes.select("node_id", "label")
    severed = graph.edges.where(F.col("dst") == node).join(names, F.col("src") == F.col("node_id"), "left").select(
        F.lit("severed").alias("part"), F.coalesce("label", F.concat(F.lit("node_"), "src")).alias("label")
    )
    effects = what(graph, label).join(names, "node_id").select(F.lit("effect").alias("part"), "label")
    return severed.union(effects)


def roots(graph: Graph) -> DataFrame:
    """Nodes that no walkable edge enters."""
    return graph.nodes.select("node_id").join(graph.valid_edges().select(F.col("dst").alias("node_id")), "node_id", "left_anti")


def counterfactual(graph: Graph, label: str) -> DataFrame:
    """(node_id, label, depth, unique): all effects; ``unique`` are those that would not be there without the node.

    That is, those that no root of the whole graph reaches around the node.  Two rules
    take more away: the target of a joint group that the node is a source of, and the
    mediator of any mediated cause from which no edge of another node goes out.  What
    lies behind these stays reachable, as they are taken away afterwards.
    """
    node = graph.best(label)
    steps = _steps(graph, True)
    effects = search(steps, _one(graph, node)).where("depth > 0")
    around = search(steps, roots(graph), blocked=_one(graph, node)).select("node_id")
    e = graph.edges.select(
        "src", "dst", "relation", "edge_idx", graph.edge("joint_group").alias("joint_group"), graph.edge("third_node").alias("third_node")
    )
    groups = e.where("joint_group is not null")
    mine = groups.where(F.col("src") == F.lit(node)).select("joint_group").distinct()
    joint = groups.join(mine, "joint_group").groupBy("joint_group").agg(F.min_by("dst", "edge_idx").alias("node_id")).select("node_id")
    # an edge counts for a mediator if it leaves it, or if the mediated edge itself ends there and any other plain edge exists
    mediated = e.where("relation = 'mediated_cause' AND third_node is not null").select(F.col("third_node").alias("node_id"), F.col("dst").alias("end")).distinct()
    others = e.where(F.col("src") != F.lit(node))
    leaving = others.select(F.col("src").alias("node_id")).distinct()
    plain = others.where("relation <> 'mediated_cause'").limit(1).select(F.lit(True).alias("plain"))
    lone = mediated.join(leaving, "node_id", "left_anti").join(F.broadcast(plain), F.col("end") == F.col("node_id"), "left").where("plain is null").select("node_id")
    left = around.join(joint.union(lone).distinct(), "node_id", "left_anti").select("node_id", F.lit(True).alias("stays"))
    return effects.join(left, "node_id", "left").join(graph.nodes.select("node_id", "label"), "node_id").select(
        "node_id", "label", "depth", F.col("stays").isNull().alias("unique")
    )


def path(graph: Graph, a: str, b: str, strict: bool = False) -> DataFrame:
    """One row (found, hops): a shortest path, whose hops are none from a node to itself; not found: false and null."""
    start, end = graph.best(a), graph.best(b)
    hit = search(_steps(graph, True), _one(graph, start), stop=end, paths=True).where(F.col("node_id") == F.lit(end)).select("hops")
    if strict and not hit.take(1):
        raise NoPath(f"{a} -> {b}")
    one = graph.nodes.sparkSession.range(1).select(F.lit(1).alias("k"))
    return one.join(hit.withColumn("k", F.lit(1)), "k", "left").select(F.col("hops").isNotNull().alias("found"), "hops")


def _hops(graph: Graph, a: str, b: str) -> DataFrame:
    """The path's hops with their labels and by how much the temporal index grows."""
    times = graph.nodes.select("node_id", F.col("temporal_index").alias("t"))
    long = path(graph, a, b).where("found").select(F.posexplode("hops").alias("k", "h")).select((F.col("k") + 1).alias("hop"), "h.*")
    return (
        long.join(times.toDF("src", "t_src"), "src", "left").join(times.toDF("dst", "t_dst"), "dst", "left")
        .withColumn("index_delta", F.col("t_dst") - F.col("t_src")).drop("t_src", "t_dst")
    )


def chain(graph: Graph, a: str, b: str, strict: bool = False) -> DataFrame:
    """The hops of a shortest path: hop, src, dst, relation, confidence, gap_min, gap_max; ``path`` tells no path from no hop."""
    long = path(graph, a, b, strict).where("found").select(F.posexplode("hops").alias("k", "h"))
    return long.select((F.col("k") + 1).alias("hop"), "h.src", "h.dst", "h.relation", "h.confidence", "h.gap_min", "h.gap_max")


def _over_path(graph: Graph, a: str, b: str, *values) -> DataFrame:
    """(found, hops, values...): aggregates over the hops of one path; the row is there without a path too."""
    found = path(graph, a, b).select("found", F.size("hops").alias("n"))
    hops = _hops(graph, a, b).agg(*values)
    return found.crossJoin(F.broadcast(hops))  # one row each


def temporal_chain(graph: Graph, a: str, b: str) -> DataFrame:
    """One row (found, ordered, links): a path with gaps and index steps; ordered if some step is known and none goes back."""
    link = F.struct("hop", "src", "dst", "relation", "confidence", "negated", "gap_min", "gap_max", "index_delta")
    row = _over_path(graph, a, b, F.array_sort(F.collect_list(link)).alias("links"), F.min("index_delta").alias("least"))
    return row.select("found", (F.col("found") & F.coalesce(F.col("least") >= 0, F.lit(False))).alias("ordered"), "links")


def before(graph: Graph, a: str, b: str) -> DataFrame:
    """One row (a_index, b_index, path_exists, a_before_b): a path, and the smaller index where both are known."""
    ends = graph.nodes.sparkSession.range(1)
    for name, label in (("a", a), ("b", b)):
        one = graph.nodes.where(F.col("node_id") == F.lit(graph.best(label))).select(F.col("temporal_index").alias(f"{name}_index"))
        ends = ends.crossJoin(F.broadcast(one))  # one row
    row = ends.crossJoin(F.broadcast(path(graph, a, b).select(F.col("found").alias("path_exists"))))
    return row.select("a_index", "b_index", "path_exists", (F.coalesce(F.col("a_index") < F.col("b_index"), F.lit(True)) & F.col("path_exists")).alias("a_before_b"))


def delay(graph: Graph, a: str, b: str) -> DataFrame:
    """One row (found, hops, gap_min, gap_max, index_delta): sums over a path; a gap's is null if any hop lacks it, the index steps that are known are summed."""
    whole = lambda c: F.when(F.count(F.lit(1)) == F.count(c), F.coalesce(F.sum(c), F.lit(0))).alias(c)
    row = _over_path(graph, a, b, F.count(F.lit(1)).alias("hops"), whole("gap_min"), whole("gap_max"), F.sum("index_delta").alias("index_delta"))
    known = lambda c: F.when(F.col("found"), F.col(c)).alias(c)
    return row.select("found", "hops", known("gap_min"), known("gap_max"), known("index_delta"))


def difference(graph: Graph, a: str, b: str) -> DataFrame:
    """One row (path_exists, observed, gap): the normative gap is 1 less the least confidence on a shortest path, 1 without a hop."""
    row = _over_path(graph, a, b, F.min("confidence").alias("least"))
    seen = F.coalesce("least", F.lit(0.0))
    return row.select(F.col("found").alias("path_exists"), F.round(seen, 6).alias("observed"), F.round(1 - seen, 6).alias("gap"))
