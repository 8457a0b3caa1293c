"""A causal graph as two tables, and how a query may cut its lineage."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import match_score


class NodeNotFound(LookupError):
    """No label matches the question."""


class NoPath(LookupError):
    """The strict form of a path question found none."""


class DuplicateNode(ValueError):
    """Two nodes of one graph have the same id."""


class TooLarge(ValueError):
    """A graph or file is beyond a documented limit."""


#: Columns that edges and nodes may have beside the ones every graph has.
OPTIONAL = {
    "negated": "boolean", "joint_group": "string", "third_role": "string", "third_node": None, "gap_nature": "string",
    "in_cycle": "long", "explicit": "boolean", "scope": "string", "origin": "string",
}


@dataclass(frozen=True)
class Graph:
    """nodes(node_id, label, node_type, parent, temporal_index) and
    edges(edge_idx, src, dst, relation, confidence, gap_min, gap_max, provenance);
    both may have columns of ``OPTIONAL``, which count as null where they are missing."""

    nodes: DataFrame
    edges: DataFrame

    def edge(self, name: str) -> Column:
        """A column of the edges, null (false for ``negated``) if they lack it."""
        if name in self.edges.columns:
            return F.coalesce(name, F.lit(False)) if name == "negated" else F.col(name)
        if name == "negated":
            return F.lit(False)
        return F.lit(None).cast(OPTIONAL[name] or self.nodes.schema["node_id"].dataType)

    def with_gap(self) -> Column:
        """Whether an edge has a temporal gap, be it an open one."""
        return F.col("gap_min").isNotNull() | F.col("gap_max").isNotNull() | self.edge("gap_nature").isNotNull()

    def valid_edges(self) -> DataFrame:
        """Edges with both ends; others count, but are never walked."""
        ids = self.nodes.select("node_id")
        return self.edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(
            ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi"
        )

    def ranked(self, label: str) -> DataFrame:
        """(node_id, label, score) of every node that a label may mean: 0 equal, 1 a prefix, 2 contained."""
        scored = self.nodes.withColumn("score", match_score(F.col("label"), F.lit(label))).where("score is not null")
        return scored.select("node_id", "label", "score", F.octet_length("label").alias("bytes"))

    def best(self, label: str):
        """The id of the node that a label means: best score, shortest in bytes, first in order."""
        hit = self.ranked(label).orderBy("score", "bytes", "node_id").select("node_id").head()
        if hit is None:
            raise NodeNotFound(label)
        return hit[0]


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that all executors share.

    The folder is ``spark.checkpoint.dir``; only a local session without that setting
    gets one of this machine.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="causeloom-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
