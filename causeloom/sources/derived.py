"""Causal graphs derived from relational tables; every graph reads its tables whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_flow(spark: SparkSession, sf_dir: str) -> Graph:
    """Event types; an edge for each pair that follow each other for a user."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = (
        table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
        .select("event_type", F.lead("event_type").over(own).alias("to"), "ts", F.lead("ts").over(own).alias("then"))
        .where(F.col("to").isNotNull())
    )
    gap = F.unix_seconds(F.col("then").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))
    pairs = steps.groupBy("event_type", "to").agg(
        F.count(F.lit(1)).alias("n"), F.min(gap).alias("gap_min"), F.max(gap).alias("gap_max")
    )
    # from here on there is a row for each pair of event types
    share = F.round(F.col("n") / F.sum("n").over(Window.partitionBy("event_type")), 6)
    edges = pairs.select(
        F.row_number().over(Window.orderBy("event_type", "to")).cast("long").alias("edge_idx"),
        F.col("event_type").alias("src"), F.col("to").alias("dst"),
        F.when(F.col("event_type") == F.col("to"), "sequence").otherwise("cause").alias("relation"),
        share.alias("confidence"), "gap_min", "gap_max",
        F.when(F.col("n") % 2 == 0, F.lit("events")).alias("provenance"),
    )
    nodes = table(spark, sf_dir, "events").select("event_type").distinct().select(
        F.col("event_type").alias("node_id"), F.col("event_type").alias("label"), F.lit("event").alias("node_type"),
        F.lit(None).cast("string").alias("parent"),
        F.row_number().over(Window.orderBy("event_type")).alias("temporal_index"),
    )
    return Graph(nodes, edges)


def geography(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions and their nations; an edge from a supplier's to a customer's nation, weighted by revenue share."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    nodes = region.select(
        F.concat(F.lit("R"), "r_regionkey").alias("node_id"), F.col("r_name").alias("label"), F.lit("entity").alias("node_type"),
        F.lit(None).cast("string").alias("parent"), F.lit(None).cast("int").alias("temporal_index"),
    ).unionByName(nation.select(
        F.concat(F.lit("N"), "n_nationkey").alias("node_id"), F.col("n_name").alias("label"), F.lit("entity").alias("node_type"),
        F.concat(F.lit("R"), "n_regionkey").alias("parent"), F.lit(None).cast("int").alias("temporal_index"),
    ))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    revenue = F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(38,4)"))
    flow = (
        line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("s_nationkey", "c_nationkey").agg(revenue.alias("v"))
    )
    total = F.sum("v").over(Window.partitionBy("s_nationkey"))
    edges = flow.select(
        (F.col("s_nationkey") * 1000 + F.col("c_nationkey")).cast("long").alias("edge_idx"),
        F.concat(F.lit("N"), "s_nationkey").alias("src"), F.concat(F.lit("N"), "c_nationkey").alias("dst"),
        F.lit("cause").alias("relation"), F.round(F.col("v").cast("double") / total.cast("double"), 6).alias("confidence"),
        F.lit(None).cast("long").alias("gap_min"), F.lit(None).cast("long").alias("gap_max"), F.lit("lineitem").alias("provenance"),
    )
    return Graph(nodes, edges)


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    """Supplier to part to customer, through whole lineitem and orders."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    made = line.select(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"))
    sold = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("P"), "l_partkey").alias("src"), F.concat(F.lit("C"), "o_custkey").alias("dst")
    )
    pairs = made.unionByName(sold).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    edges = pairs.select(
        F.xxhash64("src", "dst").alias("edge_idx"), "src", "dst", F.lit("cause").alias("relation"),
        (1 - 1 / (1 + F.col("n"))).alias("confidence"), F.lit(None).cast("long").alias("gap_min"),
        F.lit(None).cast("long").alias("gap_max"), F.lit("lineitem").alias("provenance"),
    )
    ends = pairs.select(F.col("src").alias("node_id")).union(pairs.select("dst")).distinct()
    nodes = ends.select(
        "node_id", F.col("node_id").alias("label"), F.lit("entity").alias("node_type"),
        F.lit(None).cast("string").alias("parent"), F.lit(None).cast("int").alias("temporal_index"),
    )
    return Graph(nodes, edges)


#: Edges of ``nation_web`` by rule: which nations have one, where it goes (from the key), its relation.
WEB = [
    ("k % 5 <> 4", "k + 1", "cause"), ("k % 5 IN (0, 2)", "k + 2", "enable"), ("k % 5 = 4 AND k < 24", "k + 1", "sequence"),
    ("k IN (9, 19)", "k - 4", "CASE WHEN k = 9 THEN 'prevent' ELSE 'concession' END"), ("k = 2", "k", "cause"),
    ("k % 5 IN (1, 2)", "k + 4 - k % 5", "joint_cause"), ("k % 5 = 0", "k + 3", "mediated_cause"), ("k = 0", "k + 1", "enable"),
    ("k = 22", "99", "cause"),
]


def web_sql() -> str:
    """Nodes and edges of ``nation_web`` as SQL over ``nation``, as Spark and DuckDB read it."""
    arms = " UNION ALL ".join(
        f"SELECT {r} AS rule, k, {to} AS dst, {kind if ' ' in kind else repr(kind)} AS relation FROM base WHERE {where}" for r, (where, to, kind) in enumerate(WEB)
    )
    return f"""
WITH base AS (SELECT CAST(n_nationkey AS BIGINT) AS k, n_name FROM nation),
arms AS ({arms}),
web_nodes AS (
  SELECT k AS node_id, CASE WHEN k = 13 THEN ' ' ELSE n_name END AS label,
         CASE WHEN k % 4 = 0 THEN 'etat_local' WHEN k % 4 = 1 THEN 'processus' WHEN k % 4 = 2 THEN 'condition' ELSE 'etat_global' END AS node_type,
         CAST(NULL AS BIGINT) AS parent, CASE WHEN k % 7 <> 3 THEN CAST(k AS INT) END AS temporal_index FROM base
  UNION ALL SELECT 50, 'loner', 'condition', NULL, 0),
web_edges AS (
  SELECT CAST(rule * 100 + k AS BIGINT) AS edge_idx, k AS src, CAST(dst AS BIGINT) AS dst, relation,
         CAST(0.2 AS DOUBLE) + CAST((k * 7 + rule * 3) % 60 AS DOUBLE) / 100 AS confidence,
         CASE WHEN (k + rule) % 3 <> 0 THEN CAST(k % 4 AS BIGINT) END AS gap_min, CASE WHEN (k + rule) % 3 <> 0 THEN CAST(k % 4 + rule AS BIGINT) END AS gap_max,
         CASE WHEN k % 2 = 0 THEN 'nation' END AS provenance, (k + rule) % 11 = 0 AS negated,
         CASE WHEN relation = 'joint_cause' THEN concat('g', CAST(k - k % 5 AS VARCHAR(9))) END AS joint_group,
         CASE WHEN relation = 'mediated_cause' THEN k + 2 END AS third_node
  FROM arms)"""


def nation_web(spark: SparkSession, sf_dir: str) -> Graph:
    """Five blocks of nations in a row, with cycles, parallel, joint, mediated and dangling edges, a self-loop and a lone node."""
    view = f"nation_web_{abs(hash(sf_dir))}"
    table(spark, sf_dir, "nation").createOrReplaceTempView(view)
    body = web_sql().replace("FROM nation)", f"FROM {view})").replace("VARCHAR(9)", "STRING")
    return Graph(spark.sql(body + " SELECT * FROM web_nodes"), spark.sql(body + " SELECT * FROM web_edges"))
