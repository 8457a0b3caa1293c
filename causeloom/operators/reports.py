"""Graph questions that need no traversal, in all-node form where that is natural."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import normalize_label
from ..plans.graph import Graph


def _incident(graph: Graph) -> DataFrame:
    """(node_id, edge_idx, confidence, provenance): every edge at each of its ends, a self-loop once."""
    e = graph.edges
    out = e.select(F.col("src").alias("node_id"), "edge_idx", "confidence", "provenance")
    into = e.where("src <> dst").select(F.col("dst").alias("node_id"), "edge_idx", "confidence", "provenance")
    return out.unionByName(into)


def centrality(graph: Graph, ids: bool = False) -> DataFrame:
    """Degrees in and out, their confidences, and (weighted in + out) / (in + out)."""
    e = graph.edges
    ends = e.select(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i"), "confidence").unionByName(
        e.select(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i"), "confidence")
    )
    sums = ends.groupBy("node_id").agg(
        F.sum("i").alias("degree_in"), F.sum("o").alias("degree_out"),
        F.sum(F.col("i") * F.col("confidence")).alias("w_in"), F.sum(F.col("o") * F.col("confidence")).alias("w_out"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return graph.nodes.join(sums, "node_id", "left").select(
        *["node_id"] * ids, "label", zero("degree_in").alias("degree_in"), zero("degree_out").alias("degree_out"),
        F.round(zero("w_in"), 6).alias("weighted_in"), F.round(zero("w_out"), 6).alias("weighted_out"),
        F.round(F.when(zero("degree_in") + zero("degree_out") > 0, (zero("w_in") + zero("w_out")) / (zero("degree_in") + zero("degree_out"))).otherwise(0.0), 6).alias("score"),
    )


def _counts(graph: Graph) -> DataFrame:
    return graph.nodes.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(graph.edges.agg(F.count(F.lit(1)).alias("n_edges")))  # one row each


def density(graph: Graph, ids: bool = False) -> DataFrame:
    """E / (N (N-1)), and every node's degree over 2 (N-1)."""
    degree = _incident(graph).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
    many = F.col("n_nodes") > 1
    return graph.nodes.join(degree, "node_id", "left").crossJoin(F.broadcast(_counts(graph))).select(
        *["node_id"] * ids, "label", "n_nodes", "n_edges",
        F.round(F.when(many, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0), 6).alias("density"),
        F.coalesce("degree", F.lit(0)).alias("degree"),
        F.round(F.when(many, F.coalesce("degree", F.lit(0)) / (2 * (F.col("n_nodes") - 1))).otherwise(0.0), 6).alias("local_density"),
    )


def coverage(graph: Graph, ids: bool = False) -> DataFrame:
    """Share of all edges that touch a node, and how many of those have provenance (1 if none)."""
    own = _incident(graph).groupBy("node_id").agg(F.count(F.lit(1)).alias("d"), F.count("provenance").alias("p"))
    d, p = F.coalesce("d", F.lit(0)), F.coalesce("p", F.lit(0))
    return graph.nodes.join(own, "node_id", "left").crossJoin(F.broadcast(_counts(graph))).select(
        *["node_id"] * ids, "label", d.alias("degree"),
        F.round(F.when(F.col("n_edges") > 0, d / F.col("n_edges")).otherwise(0.0), 6).alias("coverage"),
        F.round(F.when(d > 0, p / d).otherwise(1.0), 6).alias("provenance_ratio"),
    )


def reliability(graph: Graph, ids: bool = False) -> DataFrame:
    """Least and mean confidence at a node, and the mean times the provenance ratio."""
    own = _incident(graph).groupBy("node_id").agg(
        F.min("confidence").alias("least"), F.avg("confidence").alias("mean"),
        (F.count("provenance") / F.count(F.lit(1))).alias("ratio"),
    )
    mean, ratio = F.coalesce("mean", F.lit(0.0)), F.coalesce("ratio", F.lit(1.0))
    return graph.nodes.join(own, "node_id", "left").select(
        *["node_id"] * ids, "label", F.coalesce("least", F.lit(0.0)).alias("min_confidence"), F.round(mean, 6).alias("mean_confidence"),
        F.round(ratio, 6).alias("provenance_ratio"), F.round(mean * ratio, 6).alias("reliability"),
    )


def gaps(graph: Graph) -> DataFrame:
    """Edges with a temporal gap, an open one included, by labels."""
    names = graph.nodes.select("node_id", "label")
    return (
        graph.edges.where(graph.with_gap())
        .join(names.select(F.col("node_id").alias("src"), F.col("label").alias("from_label")), "src", "left")
        .join(names.select(F.col("node_id").alias("dst"), F.col("label").alias("to_label")), "dst", "left")
        .select(F.coalesce("from_label", F.concat(F.lit("node_"), "src")).alias("from_label"),
                F.coalesce("to_label", F.concat(F.lit("node_"), "dst")).alias("to_label"), "relation", "gap_min", "gap_max")
    )


def zoom_in(graph: Graph, label: str) -> DataFrame:
    node = graph.best(label)
    return graph.nodes.where(F.col("parent") == node).select("node_id", "label", "node_type")


def zoom_out(graph: Graph, ids: bool = False) -> DataFrame:
    """Every node with its direct parent, or null."""
    up = graph.nodes.select(F.col("node_id").alias("parent"), F.col("label").alias("parent_label"))
    return graph.nodes.join(up, "parent", "left").select("node_id", "label", "parent_label")


def aggregate(graph: Graph) -> DataFrame:
    """For every node with children: how many, and the edges that leave them (count, mean confidence or 0)."""
    child = graph.nodes.where("parent is not null").select("node_id", "parent")
    leaving = (
        graph.edges.join(child.select(F.col("node_id").alias("src"), "parent"), "src")
        .join(child.select(F.col("node_id").alias("dst"), F.col("parent").alias("other")), "dst", "left")
        .where("other is null or other <> parent").groupBy("parent")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean"))
    )
    return child.groupBy("parent").agg(F.count(F.lit(1)).alias("children")).join(leaving, "parent", "left").select(
        "parent", "children", F.coalesce("n", F.lit(0)).alias("edges_out"), F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("mean_confidence")
    )


# Relations of one family are partly alike, and so are the two states.
FAMILIES = [("cause", "enable", "condition"), ("data_dep", "control_dep", "sequence")]
STATES = ("etat_local", "etat_global")


def analogy(graph: Graph, a: str, b: str, least: float = 0.3) -> DataFrame:
    """Edges like the edge between two labels: relation, node types, confidence and degrees."""
    out = graph.edges.groupBy("src").agg(F.count(F.lit(1)).alias("d_out"))
    into = graph.edges.groupBy("dst").agg(F.count(F.lit(1)).alias("d_in"))
    name = graph.nodes.select("node_id", "label", "node_type")
    signed = (
        graph.edges.join(name.toDF("src", "from_label", "from_type"), "src").join(name.toDF("dst", "to_label", "to_type"), "dst")
        .join(out, "src").join(into, "dst")
    )
    asked = [normalize_label(F.lit(x)) for x in (a, b)]
    pattern = signed.where((normalize_label(F.col("from_label")) == asked[0]) & (normalize_label(F.col("to_label")) == asked[1])).orderBy("edge_idx").limit(1)
    p = pattern.select(*[F.col(c).alias("p_" + c) for c in ("src", "dst", "relation", "confidence", "from_type", "to_type", "d_out", "d_in")])
    kin = F.lit(0.0)
    for family in FAMILIES:
        kin = F.when(F.col("relation").isin(*family) & F.col("p_relation").isin(*family), 0.6).otherwise(kin)
    relation = F.when(F.col("relation") == F.col("p_relation"), 1.0).otherwise(kin)
    alike = lambda x, y: F.when(F.col(x) == F.col(y), 1.0).when(F.col(x).isin(*STATES) & F.col(y).isin(*STATES), 0.5).otherwise(0.0)
    score = (
        0.4 * relation + 0.3 * (alike("from_type", "p_from_type") + alike("to_type", "p_to_type")) / 2
        + 0.2 * (1 - F.least(F.lit(1.0), F.abs(F.col("confidence") - F.col("p_confidence"))))
        + 0.1 / (1 + F.abs(F.col("d_out") - F.col("p_d_out")) + F.abs(F.col("d_in") - F.col("p_d_in")))
    )
    return (
        signed.crossJoin(F.broadcast(p))  # the one row of the pattern
        .where("not (src = p_src and dst = p_dst)").withColumn("score", F.round(score, 6)).where(F.col("score") >= least)
        .select("from_label", "to_label", "relation", "score")
    )


def unresolved(ambiguities: DataFrame) -> DataFrame:
    """One row (unresolved_nodes): how many ambiguities the text left, as it stands beside the gaps."""
    return ambiguities.agg(F.count(F.lit(1)).alias("unresolved_nodes"))


def diagnostics(graph: Graph, low: float = 0.3) -> DataFrame:
    """(severity, kind, subject, node_id, src, dst): what validation finds, with the ids concerned."""
    e, nodes = graph.edges, graph.nodes.select("node_id", "label", "node_type", "temporal_index")
    kind = graph.nodes.schema["node_id"].dataType
    known = graph.valid_edges().select("edge_idx")
    repeat = F.row_number().over(Window.partitionBy("src", "dst").orderBy("edge_idx"))
    touched = e.select(F.col("src").alias("node_id")).union(e.select("dst"))
    several = nodes.agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(True).alias("several"))  # one row or none
    times = nodes.select("node_id", F.col("temporal_index").alias("t"))
    late = e.where("relation = 'sequence'").join(times.toDF("src", "t_src"), "src").join(times.toDF("dst", "t_dst"), "dst").where("t_src > t_dst")

    def of_edge(df: DataFrame, severity: str, name: str) -> DataFrame:
        return df.select(
            F.lit(severity).alias("severity"), F.lit(name).alias("kind"), F.concat_ws("->", "src", "dst").alias("subject"),
            F.col("src").alias("node_id"), "src", "dst",
        )

    def of_node(df: DataFrame, severity: str, name: str) -> DataFrame:
        none = F.lit(None).cast(kind)
        return df.select(
            F.lit(severity).alias("severity"), F.lit(name).alias("kind"), F.col("node_id").cast("string").alias("subject"),
            "node_id", none.alias("src"), none.alias("dst"),
        )

    return (
        of_edge(e.join(known, "edge_idx", "left_anti"), "error", "dangling_edge")
        .union(of_edge(e.where("src = dst"), "error", "self_loop"))
        .union(of_node(nodes.join(touched, "node_id", "left_anti").join(F.broadcast(several)), "warning", "orphaned_node"))
        .union(of_edge(e.where(F.isnan("confidence") | (F.col("confidence") < low)), "warning", "low_confidence_edge"))
        .union(of_node(nodes.where("node_type = 'condition'").join(e.select(F.col("src").alias("node_id")), "node_id", "left_anti"), "warning", "dangling_condition"))
        .union(of_node(nodes.where("trim(label) = ''"), "error", "empty_label"))
        .union(of_edge(e.withColumn("k", repeat).where("k > 1"), "warning", "duplicate_edge"))
        .union(of_edge(e.where("provenance is null"), "warning", "missing_provenance"))
        .union(of_edge(late, "warning", "temporal_order_violation"))
    )
