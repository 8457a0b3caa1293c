"""Connected components of a table of links, by contraction.

Every round a task first shrinks its own links to a spanning forest (a union-find
over what it holds, bounded by the task's partition), then nodes are hooked to the
smallest neighbour and pointers are followed (large-star and small-star of Kiveris
et al.).  Only links are shuffled, each with map-side combine; a hub of the links is
spread by that combine.  Rounds are staged, so a lost executor never recomputes
more than one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import scratch, stage

ROUNDS = 60


def forest(edges: DataFrame) -> DataFrame:
    """Each task's links (a, b) replaced by stars of its own components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        out = [(x, root(x)) for x in parent if root(x) != x]
        for at in range(0, len(out), 50_000):
            some = out[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in some], types), pa.array([s[1] for s in some], types)], names=["a", "b"])

    from pyspark.sql.pandas.types import to_arrow_type

    types = to_arrow_type(edges.schema["a"].dataType)
    return edges.select("a", "b").mapInArrow(run, edges.select("a", "b").schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each linked node's component, for links (a, b) of comparable nodes."""
    with scratch(edges.sparkSession, "components"):
        return stage(_settled(edges), "components")


def _settled(edges: DataFrame) -> DataFrame:
    links = stage(forest(edges.where("a <> b")), "links")
    for _ in range(ROUNDS):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        # large star: neighbours above a node hook to its smallest neighbour
        hooked = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its smaller neighbours hook to the smallest
        down = hooked.where("a > b")
        lowest = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        starred = down.join(lowest, F.col("a") == F.col("n")).select(F.col("b").alias("x"), "m").where("x > m").select(F.col("x").alias("a"), F.col("m").alias("b"))
        grown = stage(forest(starred.union(lowest.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()), "links")
        # done when every node points at a root, that is, no target is itself a source
        chained = grown.join(grown.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        twofold = 0 if chained else grown.groupBy("a").count().where("count > 1").limit(1).count()
        links = grown
        if not chained and not twofold:
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
