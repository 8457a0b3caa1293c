"""Taxonomies and what they say about a graph: node types, scopes, confidences, aliases.

A lexicon is a table (taxonomy, class, lemma, scope); it is small and sent to every task
only if Spark finds it so.  Where a lemma stands in two classes the first class by name counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.emission import lookup
from ..functions.labels import normalize_label
from ..plans.graph import Graph

# Taxonomy of a part of speech, node type of a class, scopes of classes, and confidence steps.
TAXONOMY = {
    "VERB": "verbes", "ADV": "adverbes", "ADJ": "adjectifs", "SCONJ": "conjonctions", "CCONJ": "conjonctions",
    "ADP": "prepositions", "NOUN": "noms", "PRON": "pronoms", "DET": "determinants",
}
NODE_TYPE = {
    "etat": "etat_local", "action": "processus", "transition": "processus", "processus": "processus", "agent": "entite",
    "patient": "entite", "abstrait": "entite", "relation": "entite", "etat_systemique": "etat_global", "contrainte": "contrainte",
}
DET_SCOPE = {
    "defini": "specific", "demonstratif": "specific", "possessif": "specific", "indefini": "existential", "partitif": "partial",
    "quantitatif": "universal",
}
PRON_SCOPE = {"personnel": "specific", "demonstratif": "specific", "relatif": "specific", "indefini": "unknown"}
SCOPES = ("universal", "existential", "partial", "null", "specific", "unknown")
STRONG, CAUSAL, ADVERSE = 0.15, 0.10, -0.10
EXPLICIT, IMPLICIT, LOWEST, NOTICED = 1.0, 0.5, 0.1, 0.05


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The lexicon of a folder of JSON files {"taxonomy": name, "classes": {class: [{"lemma":, "scope":}, ...]}}; of one name the last file counts."""
    shape = "taxonomy string, classes map<string, array<struct<lemma: string, scope: string>>>"
    files = spark.read.schema(shape).json(folder, multiLine=True).withColumn("file", F.input_file_name())
    last = files.groupBy("taxonomy").agg(F.max_by("classes", "file").alias("classes"))
    return last.select("taxonomy", F.explode("classes").alias("class", "entries")).select("taxonomy", "class", F.inline("entries"))


def look_up(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``tokens`` (…, lemma, pos) with the class and scope that the lexicon has for them, or null."""
    first = lexicon.groupBy("taxonomy", "lemma").agg(F.min_by(F.struct("class", "scope"), "class").alias("entry"))
    named = tokens.withColumn("taxonomy", lookup(F.col("pos"), TAXONOMY, F.lit(None)))
    return named.join(first, ["taxonomy", "lemma"], "left").select(*tokens.columns, F.col("entry.class").alias("class"), F.col("entry.scope").alias("entry_scope"))


def node_type_of(name: Column) -> Column:
    """The node type of a class, or null."""
    return lookup(name, NODE_TYPE, F.lit(None))


def scope_of(name: Column, pos: Column, entry_scope: Column) -> Column:
    """The entry's own scope, else that of its class for determiners and pronouns."""
    known = F.when(entry_scope.isin(*SCOPES), entry_scope)
    det = F.when(name.isNotNull(), lookup(name, DET_SCOPE, F.lit("unknown")))
    return F.coalesce(known, F.when(pos == "DET", det).when(pos == "PRON", lookup(name, PRON_SCOPE, F.lit(None))))


def structural_confidence(source: Column, target: Column, relation: Column, explicit: Column) -> Column:
    """1 or .5, and a step by the types that the relation joins, within .1 and 1."""
    cause = relation == "cause"
    step = (
        F.when(cause & (source == "processus") & target.isin("etat_local", "processus"), STRONG).when(cause & (source == "processus"), CAUSAL)
        .when((relation == "filter") & (source == "etat_global"), STRONG).when(relation.isin("concession", "opposition"), ADVERSE).otherwise(0.0)
    )
    return F.least(F.lit(1.0), F.greatest(F.lit(LOWEST), F.when(explicit, EXPLICIT).otherwise(IMPLICIT) + step))


def enrich(graph: Graph, lexicon: DataFrame) -> tuple[Graph, DataFrame]:
    """(graph, notes): inferred nodes are typed by their entity, implicit edges weighed by the types they join.

    Nodes need origin and entity, edges explicit; notes are (kind, node_id, src, dst, before, after).
    """
    entity = graph.nodes.select("node_id", F.col("entity").alias("lemma"), F.lit("NOUN").alias("pos")).where("origin = 'inferred' AND entity <> ''") if "entity" in graph.nodes.columns else None
    nodes, kind = graph.nodes, graph.nodes.schema["node_id"].dataType
    none = F.lit(None)
    shape = lambda name, node, src, dst, before, after: [
        F.lit(name).alias("kind"), node.cast(kind).alias("node_id"), src.cast(kind).alias("src"), dst.cast(kind).alias("dst"), before.cast("string").alias("before"), after.cast("string").alias("after")]
    notes = None
    if entity is not None:
        typed = look_up(entity, lexicon).select("node_id", node_type_of(F.col("class")).alias("new_type")).where("new_type is not null")
        joined = graph.nodes.join(typed, "node_id", "left")
        notes = joined.where("new_type <> node_type").select(*shape("node_type_resolved", F.col("node_id"), none, none, F.col("node_type"), F.col("new_type")))
        nodes = joined.withColumn("node_type", F.coalesce("new_type", "node_type")).drop("new_type")
    types = nodes.select("node_id", "node_type")
    e = graph.edges.join(types.toDF("src", "st"), "src", "left").join(types.toDF("dst", "dt"), "dst", "left")
    new = structural_confidence(F.col("st"), F.col("dt"), F.col("relation"), F.lit(False))
    moved = ~F.coalesce(graph.edge("explicit"), F.lit(True)) & F.col("st").isNotNull() & F.col("dt").isNotNull() & (F.abs(new - F.col("confidence")) > NOTICED)
    e = e.withColumn("__new", F.when(moved, new))
    open_ = e.where(F.col("relation").isin("concession", "opposition")).select(*shape("causal_gap", none, F.col("src"), F.col("dst"), F.col("relation"), none))
    weighed = e.where("__new is not null").select(*shape("confidence_adjusted", none, F.col("src"), F.col("dst"), F.round("confidence", 6), F.round("__new", 6)))
    edges = e.withColumn("confidence", F.coalesce("__new", "confidence")).select(graph.edges.columns)
    every = open_.unionByName(weighed)
    return Graph(nodes, edges), every if notes is None else notes.unionByName(every)


def resolve_aliases(rows: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """``rows`` with ``resolved``: the normal form of a label, or of what the table (alias, canonical) says for it; ``is_alias`` tells which."""
    table = aliases.select(normalize_label(F.col("alias")).alias("__alias"), normalize_label(F.col("canonical")).alias("__canonical")).dropDuplicates(["__alias"])
    own = normalize_label(F.col(column))
    joined = rows.withColumn("__own", own).join(table, F.col("__own") == F.col("__alias"), "left")
    return joined.select(*rows.columns, F.coalesce("__canonical", "__own").alias("resolved"), F.col("__canonical").isNotNull().alias("is_alias"))
