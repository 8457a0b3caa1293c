"""What runs over a graph before it is asked: cycles, gaps, validation, structural loss, counts.

Strongly connected components are found in one of two ways: if the distinct links are at
most ``LOCAL_LINKS``, by one depth-first pass on the driver; beyond that by rounds of
colouring over checkpointed tables, whose every step is a join or an aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import DuplicateNode, Graph, TooLarge, cut
from .reports import diagnostics

#: Distinct links that are read by the driver at most (a pair of ids each).
LOCAL_LINKS = 200_000
#: Nodes of a graph whose single points of failure are asked for, at most.
SPOF_NODES = 500
# Relations that say that a cause is missing, and those that make a cycle dampen.
OPEN = ("concession", "opposition")
AGAINST = ("prevent", "opposition")


def _strong_local(links: list[tuple]) -> list[tuple]:
    """(node, component): components of more than one node, by depth-first search with an explicit stack."""
    out: dict = {}
    for a, b in links:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    number, low, path, on_path, found = {}, {}, [], set(), []
    for first in sorted(out):
        if first in number:
            continue
        work = [(first, iter(out[first]))]
        number[first] = low[first] = len(number)
        path.append(first)
        on_path.add(first)
        while work:
            node, rest = work[-1]
            for to in rest:
                if to not in number:
                    number[to] = low[to] = len(number)
                    path.append(to)
                    on_path.add(to)
                    work.append((to, iter(out[to])))
                    break
                if to in on_path:
                    low[node] = min(low[node], number[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    at = len(path) - 1
                    while path[at] != node:
                        at -= 1
                    own, path[at:] = path[at:], []
                    on_path.difference_update(own)
                    if len(own) > 1:
                        found += [(x, min(own)) for x in own]
    return found


def _spread(links: DataFrame, colours: DataFrame) -> DataFrame:
    """The greatest colour that reaches each node over links (a, b), by rounds until none changes."""
    while True:
        sent = links.join(colours.select(F.col("node").alias("a"), "colour"), "a").select(F.col("b").alias("node"), "colour")
        grown = cut(colours.unionByName(sent).groupBy("node").agg(F.max("colour").alias("colour")))
        if not grown.join(colours.withColumnRenamed("colour", "was"), "node").where("colour <> was").take(1):
            return grown
        colours = grown


def _strong_spread(links: DataFrame) -> DataFrame:
    """(node, component) as ``_strong_local``: nodes without a way in or out are peeled off; then the nodes that their own
    colour's owner reaches and is reached from are its component, and the rest goes on to the next round."""
    links, done = cut(links), []
    while True:
        ends = links.select(F.col("a").alias("x")).intersect(links.select(F.col("b").alias("x")))
        kept = cut(links.join(ends.withColumnRenamed("x", "a"), "a", "left_semi").join(ends.withColumnRenamed("x", "b"), "b", "left_semi").select("a", "b"))
        if kept.count() != links.count():
            links = kept
            continue
        if not links.take(1):
            break
        nodes = links.select(F.col("a").alias("node")).distinct()
        colour = _spread(links, nodes.withColumn("colour", F.col("node")))
        # back from each colour's owner, over links inside one colour
        inside = links.join(colour.toDF("a", "ca"), "a").join(colour.toDF("b", "cb"), "b").where("ca = cb")
        back = cut(inside.select(F.col("b").alias("a"), F.col("a").alias("b")))
        owners = colour.where("node = colour")
        reached = owners
        while True:
            more = back.join(reached.select(F.col("node").alias("a"), "colour"), "a").select(F.col("b").alias("node"), "colour").distinct()
            fresh = cut(more.join(reached.select("node"), "node", "left_anti"))
            if not fresh.take(1):
                break
            reached = cut(reached.unionByName(fresh))
        done.append(reached)
        gone = reached.select("node")
        links = cut(links.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti"))
    if not done:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    lowest = every.groupBy("colour").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return every.join(lowest, "colour").select("node", "component")


def strong_components(graph: Graph, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(node, component): nodes on cycles; a component is named by its smallest node, one node counts if it has a self-loop."""
    pairs = cut(graph.valid_edges().select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    links, loops = pairs.where("a <> b"), pairs.where("a = b").select(F.col("a").alias("node"))
    if links.limit(local_links + 1).count() <= local_links:
        kind = graph.nodes.schema["node_id"].dataType.simpleString()
        rows = _strong_local([tuple(r) for r in links.collect()])  # at most ``local_links`` pairs
        strong = graph.nodes.sparkSession.createDataFrame(rows, f"node {kind}, component {kind}")
    else:
        strong = cut(_strong_spread(links))
    alone = loops.join(strong.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return strong.unionByName(alone)


def cycles(graph: Graph, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(cycle_id, path, labels, cycle_type): one for each strongly connected component, its nodes in order of their ids.

    ``cycle_id`` counts from 0 in the order of the smallest node.  All edges between a component's
    nodes vote: any concession makes an oscillation, else any negated, preventing or opposing one a
    negative feedback.
    """
    strong = cut(strong_components(graph, local_links))
    votes = _inside(graph, strong).groupBy("component").agg(
        F.bool_or(F.col("relation") == "concession").alias("swings"), F.bool_or(F.col("negated") | F.col("relation").isin(*AGAINST)).alias("against")
    )
    kind = F.when(F.col("swings"), "oscillation").when(F.col("against"), "feedback_negative").otherwise("feedback_positive")
    named = strong.join(graph.nodes.select(F.col("node_id").alias("node"), "label"), "node")
    # a component's path is as long as the component, which is what is asked for
    path = F.array_sort(F.collect_list(F.struct("node", "label")))
    return (
        named.groupBy("component").agg(path.alias("p")).join(votes, "component").join(_numbered(strong), "component")
        .select("cycle_id", F.col("p.node").alias("path"), F.col("p.label").alias("labels"), kind.alias("cycle_type"))
    )


def _inside(graph: Graph, strong: DataFrame) -> DataFrame:
    """Edges with both ends in one component."""
    e = graph.edges.select("edge_idx", "src", "dst", "relation", graph.edge("negated").alias("negated"))
    return e.join(strong.toDF("src", "component"), "src").join(strong.toDF("dst", "other"), "dst").where("component = other")


def _numbered(strong: DataFrame) -> DataFrame:
    """(component, cycle_id): numbered within sorted ranges, whose offsets are one row for each task."""
    ranged = cut(strong.select("component").distinct().repartitionByRange("component").sortWithinPartitions("component").select(
        "component", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")
    ))
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    offsets = counts.select("part", "first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranged.join(F.broadcast(offsets), "part").select("component", (F.col("before") + F.col("at") - F.col("first")).alias("cycle_id"))


def back_edge_cycles(graph: Graph, most: int = LOCAL_LINKS) -> DataFrame:
    """(path): the cycles that a depth-first walk closes, each set of nodes once; the walk takes nodes by id and edges by place.

    It depends on that order, so it is one walk on the driver, over ``most`` distinct links.
    """
    pairs = graph.valid_edges().groupBy("src", "dst").agg(F.min("edge_idx").alias("i"))
    rows = sorted((tuple(r) for r in pairs.limit(most + 1).collect()), key=lambda r: r[2])  # at most ``most``, else refused
    if len(rows) > most:
        raise TooLarge(f"more than {most} links")
    out: dict = {}
    for a, b, _ in rows:
        out.setdefault(a, []).append(b)
    done, found, seen = set(), [], set()
    for first in sorted(out):
        if first in done:
            continue
        path, place, work = [first], {first: 0}, [iter(out[first])]
        while work:
            for to in work[-1]:
                if to in place:
                    cycle = path[place[to] :]
                    if frozenset(cycle) not in seen:
                        seen.add(frozenset(cycle))
                        found.append((cycle,))
                elif to not in done:
                    place[to] = len(path)
                    path.append(to)
                    work.append(iter(out.get(to, [])))
                    break
            else:
                work.pop()
                gone = path.pop()
                done.add(gone)
                del place[gone]
    kind = graph.nodes.schema["node_id"].dataType.simpleString()
    return graph.nodes.sparkSession.createDataFrame(found, f"path array<{kind}>")


def mark_cycles(graph: Graph, local_links: int = LOCAL_LINKS) -> Graph:
    """The graph with the cycle's id on each edge inside one."""
    strong = cut(strong_components(graph, local_links))
    marked = _inside(graph, strong).select("edge_idx", "component").join(_numbered(strong), "component").select("edge_idx", F.col("cycle_id").alias("in_cycle"))
    return Graph(graph.nodes, graph.edges.drop("in_cycle").join(marked, "edge_idx", "left"))


def open_gaps(graph: Graph) -> Graph:
    """Concessions and oppositions without a gap get an open, deferred one."""
    nature = F.when(F.col("relation").isin(*OPEN) & ~graph.with_gap(), "deferred").otherwise(graph.edge("gap_nature"))
    return Graph(graph.nodes, graph.edges.withColumn("gap_nature", nature))


def process(graph: Graph, local_links: int = LOCAL_LINKS) -> tuple[Graph, DataFrame, DataFrame]:
    """(graph, cycles, diagnostics): refuses repeated node ids, finds cycles, opens gaps, validates."""
    twice = graph.nodes.groupBy("node_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise DuplicateNode(twice[0][0])
    done = open_gaps(mark_cycles(graph, local_links))
    return done, cycles(done, local_links), diagnostics(done)


def counters(graph: Graph, local_links: int = LOCAL_LINKS) -> DataFrame:
    """One row (node_count, edge_count, has_cycles, has_gaps)."""
    nodes = graph.nodes.agg(F.count(F.lit(1)).alias("node_count"))
    edges = graph.edges.agg(F.count(F.lit(1)).alias("edge_count"), F.coalesce(F.bool_or(graph.with_gap()), F.lit(False)).alias("has_gaps"))
    some = strong_components(graph, local_links).limit(1).agg((F.count(F.lit(1)) > 0).alias("has_cycles"))
    return nodes.crossJoin(F.broadcast(edges)).crossJoin(F.broadcast(some)).select("node_count", "edge_count", "has_cycles", "has_gaps")  # one row each


def _pairs(follows: np.ndarray) -> int:
    """Ordered pairs (s, d), s other than d, with a way from s to d; rows of bits, closed by squaring."""
    reach = follows.copy()
    np.fill_diagonal(reach, True)
    while True:
        # row i becomes the union of the rows it reaches
        further = (reach.astype(np.float32) @ reach.astype(np.float32)) > 0
        if (further == reach).all():
            return int(reach.sum()) - len(reach)
        reach = further


def spof(graph: Graph, most: int = SPOF_NODES) -> DataFrame:
    """(node_id, label, score, total_pairs, ratio, is_super): the reachable ordered pairs that are lost without a node.

    Each task takes some nodes and closes the graph without each of them; the graph itself, at
    most ``most`` nodes, is sent to the tasks.  ``is_super`` marks sources of joint groups.
    """
    ids = [r[0] for r in graph.nodes.select("node_id").limit(most + 1).collect()]  # at most ``most``, else refused
    if len(ids) > most:
        raise TooLarge(f"more than {most} nodes")
    place = {x: k for k, x in enumerate(ids)}
    follows = np.zeros((len(ids), len(ids)), bool)
    for a, b in graph.valid_edges().select("src", "dst").distinct().collect():  # at most ``most`` squared
        follows[place[a], place[b]] = True
    total = _pairs(follows) if ids else 0
    spark = graph.nodes.sparkSession
    sent = spark.sparkContext.broadcast(follows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1).to_pylist()
            left = [_pairs(np.delete(np.delete(sent.value, k, 0), k, 1)) for k in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([total - x for x in left], pa.int64())], names=["node_id", "score"])

    kind = graph.nodes.schema["node_id"].dataType.simpleString()
    places = spark.createDataFrame(list(place.items()), f"node_id {kind}, at int").repartition(max(1, min(len(ids), 64)), "at")
    lost = places.mapInArrow(run, f"node_id {kind}, score long")
    joint = graph.edges.where(graph.edge("joint_group").isNotNull()).select(F.col("src").alias("node_id"), F.lit(True).alias("joint")).distinct()
    ratio = F.when(F.lit(total) > 0, F.col("score") / F.lit(total)).otherwise(0.0)
    return graph.nodes.select("node_id", "label").join(lost, "node_id").join(joint, "node_id", "left").select(
        "node_id", "label", "score", F.lit(total).cast("long").alias("total_pairs"), F.round(ratio, 6).alias("ratio"), F.coalesce("joint", F.lit(False)).alias("is_super")
    ).orderBy(F.desc("score"), "label")
