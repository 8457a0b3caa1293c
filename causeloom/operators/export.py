"""Graphs as JSON and as DOT, line by line, and back from JSON.

A graph of any size is written as rows of text in order; only a caller who wants one
string gathers them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import pascal_case
from ..plans.graph import OPTIONAL, Graph, TooLarge

#: Bytes of a file that is loaded as one graph, at most.
MOST_BYTES = 50 << 20
# Colours of relations, and shapes of node types, in DOT.
COLOURS = {
    "cause": "#2ecc71", "enable": "#3498db", "prevent": "#e74c3c", "condition": "#f39c12", "concession": "#9b59b6",
    "opposition": "#9b59b6", "sequence": "#1abc9c", "motivation": "#e67e22",
}
OTHER_COLOUR = "#95a5a6"
SHAPES = {"condition": "diamond", "etat_global": "ellipse"}
# Characters that DOT labels escape, in the order in which they are.
ESCAPED = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("{", "\\{"), ("}", "\\}"), ("<", "\\<"), (">", "\\>")]
_HEAD = ["digraph CausalGraph {", "  rankdir=LR;", "  node [shape=box, style=filled, fillcolor=lightblue];", ""]


def escaped(label: Column) -> Column:
    for old, new in ESCAPED:
        label = F.replace(label, F.lit(old), F.lit(new))
    return label


def _among(value: Column, choices: dict[str, str], other: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in choices.items() for x in pair])[value], F.lit(other))


def to_dot(graph: Graph) -> DataFrame:
    """(part, size, key, line): the lines of a DOT file in order; nodes and edges by their numbers."""
    spark = graph.nodes.sparkSession
    fixed = [(0, k, line) for k, line in enumerate(_HEAD)] + [(2, 0, ""), (4, 0, "}")]
    nodes = graph.nodes.select(F.lit(1).alias("part"), F.col("node_id").cast("string").alias("key"), F.format_string(
        "  n%s [label=\"%s\", shape=%s, tooltip=\"%s\"];", F.col("node_id").cast("string"), escaped(F.col("label")),
        _among(F.col("node_type"), SHAPES, "box"), pascal_case(F.col("node_type")),
    ).alias("line"))
    edges = graph.edges.select(F.lit(3).alias("part"), F.col("edge_idx").cast("string").alias("key"), F.format_string(
        "  n%s -> n%s [label=\"%s (%.2f)\" color=\"%s\" style=\"%s\"];", F.col("src").cast("string"), F.col("dst").cast("string"),
        pascal_case(F.col("relation")), F.col("confidence"), _among(F.col("relation"), COLOURS, OTHER_COLOUR),
        F.when(graph.edge("negated"), "dashed").otherwise("solid"),
    ).alias("line"))
    frame = spark.createDataFrame([(p, str(k), line) for p, k, line in fixed], "part int, key string, line string")
    return frame.unionByName(nodes).unionByName(edges).select("part", F.length("key").alias("size"), "key", "line").orderBy("part", "size", "key")


def to_json(graph: Graph) -> DataFrame:
    """(part, key, line): one JSON object for each node and edge; null fields are left out."""
    nodes = graph.nodes.select(F.lit("node").alias("part"), F.col("node_id").cast("string").alias("key"), F.to_json(F.struct(*graph.nodes.columns)).alias("line"))
    edges = graph.edges.select(F.lit("edge").alias("part"), F.col("edge_idx").cast("string").alias("key"), F.to_json(F.struct(*graph.edges.columns)).alias("line"))
    return nodes.unionByName(edges)


_NODE = "node_id: bigint, label: string, node_type: string, parent: bigint, temporal_index: int, scope: string, origin: string"
_EDGE = (
    "src: bigint, dst: bigint, relation: string, confidence: double, gap_min: bigint, gap_max: bigint, gap_nature: string, "
    "provenance: string, negated: boolean, joint_group: string, third_role: string, third_node: bigint, explicit: boolean, in_cycle: bigint"
)


def load(spark: SparkSession, path: str, most: int = MOST_BYTES) -> Graph:
    """The graph of one JSON file {"nodes": [...], "edges": [...]}; larger files are refused before they are read."""
    size = spark.read.format("binaryFile").load(path).select("length").head()
    if size and size[0] > most:
        raise TooLarge(f"{path}: {size[0]} bytes")
    schema = f"nodes array<struct<{_NODE}>>, edges array<struct<{_EDGE}>>"
    whole = spark.read.schema(schema).json(path, multiLine=True)
    edges = whole.select(F.posexplode("edges").alias("edge_idx", "e")).select(F.col("edge_idx").cast("long").alias("edge_idx"), "e.*")
    assert set(OPTIONAL) <= {*edges.columns, "scope", "origin"}
    return Graph(whole.select(F.inline("nodes")), edges)


def as_document(graph: Graph) -> DataFrame:
    """One row (json): the whole graph as a document that ``load`` reads; for graphs that fit a row."""
    nodes = graph.nodes.agg(F.array_sort(F.collect_list(F.struct(*graph.nodes.columns))).alias("nodes"))
    ordered = ["edge_idx", *[c for c in graph.edges.columns if c != "edge_idx"]]
    edges = graph.edges.agg(F.array_sort(F.collect_list(F.struct(*ordered))).alias("edges"))
    return nodes.crossJoin(F.broadcast(edges)).select(F.to_json(F.struct("nodes", "edges"), {"pretty": "true"}).alias("json"))  # one row each
