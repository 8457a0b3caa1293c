"""Rules by which edges are emitted from analysed clauses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The rung of each relation, and the factors of mood and connector.
RUNG = {
    "cause": 0.50, "sequence": 0.50, "analogy": 0.50, "data_dependency": 0.50, "control_dependency": 0.50,
    "condition": 0.75, "enable": 0.75, "prevent": 0.75, "filter": 0.75, "conditional_cause": 0.75, "motivation": 0.75,
    "counterfactual": 0.65, "mediated_cause": 0.65, "joint_cause": 0.65, "concession": 0.65, "opposition": 0.65,
    "conditional_prevent": 0.75, "mediated_prevent": 0.65, "joint_prevent": 0.65,
}
OTHER_RUNG = 0.75
MOOD = {"Ind": 1.00, "Sub": 0.85, "Cnd": 0.80}
CONNECTOR = {"explicite": 1.00, "verb": 0.90, "parataxis": 0.60, "aucun": 0.50}
NO_CONNECTOR = 0.50
# What a negated target makes of a relation, and the coarse groups of relations and node types.
NEGATED_TARGET = {"cause": "prevent", "conditional_cause": "conditional_prevent", "mediated_cause": "mediated_prevent", "joint_cause": "joint_prevent"}
COARSE_RELATIONS = {
    "causale": ["cause", "enable", "condition", "motivation", "conditional_cause", "mediated_cause", "joint_cause"],
    "restrictive": ["filter", "concession", "conditional_prevent", "mediated_prevent", "joint_prevent"],
    "negative": ["prevent", "opposition"], "sequentielle": ["sequence"], "systemique": ["data_dependency", "control_dependency"],
}
COARSE_NODES = {
    "action_coarse": ["processus"], "nominal_coarse": ["entite", "concept"], "evenement_coarse": ["etat_local", "etat_global", "evenement"],
    "condition_coarse": ["condition", "contrainte"],
}
# Names that node types had before.
NODE_ALIASES = {"action": "processus", "transition": "processus", "etat": "etat_local", "etat_systemique": "etat_global"}


def lookup(value: Column, table: dict, other: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[value], other)


def confidence(relation: Column, mood: Column, connector: Column, salience: Column) -> Column:
    """Rung times mood times connector and salience, within 0 and 1."""
    prior = lookup(relation, RUNG, F.lit(OTHER_RUNG)) * lookup(mood, MOOD, F.lit(1.0)) * lookup(connector, CONNECTOR, F.lit(NO_CONNECTOR))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), prior + salience))


def swapped(relation: Column, src_start: Column, dst_start: Column, src_subordinate: Column, dst_subordinate: Column) -> Column:
    """Whether an edge is turned: a sequence goes by place, else the subordinate clause is the source."""
    by_place = F.coalesce(src_start > dst_start, F.lit(False))
    by_clause = F.coalesce(dst_subordinate & ~src_subordinate, F.lit(False))
    return F.when(relation == "sequence", by_place).otherwise(by_clause & src_start.isNotNull())


def turned(flag: Column, src: Column, dst: Column) -> tuple[Column, Column]:
    return F.when(flag, dst).otherwise(src), F.when(flag, src).otherwise(dst)


def passive(voice_of_dst: Column) -> Column:
    """Whether a passive target turns the edge once more, so that the agent is the source."""
    return F.coalesce(voice_of_dst == "Pass", F.lit(False))


def subordinate(tokens: Column) -> Column:
    """Whether a clause's tokens (dep_rel, pos) hold a mark or a subordinating conjunction."""
    return F.coalesce(F.exists(tokens, lambda t: (t["dep_rel"] == "mark") | (t["pos"] == "SCONJ")), F.lit(False))


def third_role(relation: Column, tokens: Column) -> Column:
    """condition or mediator if the relation is ternary and the source's tokens show it."""
    oblique = F.coalesce(F.exists(tokens, lambda t: t["dep_rel"] == "obl"), F.lit(False))
    return F.when(relation.isin("conditional_cause", "conditional_prevent") & subordinate(tokens), "condition").when(
        relation.isin("mediated_cause", "mediated_prevent") & oblique, "mediator"
    )


def negate(relation: Column, site: Column, negated: Column) -> tuple[Column, Column, Column]:
    """(relation, polarity of the third, polarity of the source) after a negation at dst, condition or src."""
    at = lambda where: negated & (site == where)
    new = F.when(at("dst"), lookup(relation, NEGATED_TARGET, relation)).when(at("src") & (relation == "cause"), "counterfactual").otherwise(relation)
    return new, F.when(at("condition"), "negative"), F.when(at("src") & (relation == "joint_cause"), "negative")


def coarse(value: Column, groups: dict[str, list[str]]) -> Column:
    """The group of a fine type; others stay."""
    return lookup(value, {fine: group for group, fines in groups.items() for fine in fines}, value)


def node_type(name: Column) -> Column:
    """A node type by its present name."""
    return lookup(name, NODE_ALIASES, name)


def node_id(raw: Column) -> Column:
    """``n`` and at least three digits for numbers and ``n`` numbers; other texts are only cleaned."""
    text = F.trim(raw.cast("string"))
    number = F.regexp_extract(text, "^n?([0-9]+)$", 1)
    short = F.regexp_replace(number, "^0+(?=[0-9])", "")
    return F.when(number != "", F.concat(F.lit("n"), F.lpad(short, F.greatest(F.length(short), F.lit(3)), "0"))).otherwise(text)


def joint_group(target: Column, sources: Column) -> Column:
    """The id of a group of joint causes: 16 hexadecimal digits of its target and sorted sources."""
    return F.substring(F.sha2(F.concat_ws("|", target, F.concat_ws(",", F.array_sort(sources))), 256), 1, 16)


def temporal_ranks(clauses: DataFrame, by: str, start: str) -> DataFrame:
    """``clauses`` with ``temporal_rank``: places within a sentence in order of their first token."""
    return clauses.withColumn("temporal_rank", F.row_number().over(Window.partitionBy(by).orderBy(start)) - 1)


def softmax(logits: Column) -> Column:
    """Shares of an array of logits, computed from their distance to the greatest."""
    return F.transform(logits, lambda x: F.exp(x - F.array_max(logits)) / F.aggregate(logits, F.lit(0.0), lambda s, y: s + F.exp(y - F.array_max(logits))))


def resolve_ambiguities(edges: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Edges (edge_idx, src, dst, first, second, p1, p2) with the relation that stands.

    An edge with p1 of ``threshold`` or more is confirmed.  Of an uncertain one the second
    candidate wins if a confirmed edge at either end has it and none has the first; the
    confidence is then that of the two alone.
    """
    sure = edges.where(F.col("p1") >= threshold)
    ends = sure.select(F.col("src").alias("node"), F.col("first").alias("known")).union(sure.select("dst", "first"))
    known = ends.groupBy("node").agg(F.collect_set("known").alias("known"))  # at most as many as there are relations
    joined = edges.join(known.toDF("src", "ks"), "src", "left").join(known.toDF("dst", "kd"), "dst", "left")
    near = F.array_union(F.coalesce("ks", F.array().cast("array<string>")), F.coalesce("kd", F.array().cast("array<string>")))
    second = (F.col("p1") < threshold) & F.array_contains(near, F.col("second")) & ~F.array_contains(near, F.col("first"))
    both = F.col("p1") + F.col("p2")
    return joined.select(
        "edge_idx", "src", "dst", F.when(second, F.col("second")).otherwise(F.col("first")).alias("relation"),
        F.round(F.when(second, F.col("p2") / both).otherwise(F.col("p1")), 6).alias("confidence"), second.alias("changed"),
    )
