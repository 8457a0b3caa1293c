"""Steps that make training sets of sentence tables: merging, splits, leakage, oversampling, migration, lexicons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import numbered

# Parts of speech whose lemmas carry content.
CONTENT = ("NOUN", "VERB", "ADJ", "ADV", "PROPN")


def normal_text(text: Column) -> Column:
    """Lower case, white space as single blanks, trimmed: the form by which texts are the same.

    Compatibility forms are not unified (Spark has no such function); case folding is that of
    lower case.
    """
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def text_hash(text: Column) -> Column:
    return F.sha2(normal_text(text), 256)


def merge(parts: list[DataFrame], id_col: str, text_col: str) -> DataFrame:
    """The parts' rows, the first of each id and then of each text kept, parts in their order."""
    tagged = None
    for k, part in enumerate(parts):
        one = part.withColumn("__part", F.lit(k))
        tagged = one if tagged is None else tagged.unionByName(one, allowMissingColumns=True)
    tagged = tagged.withColumn("__hash", text_hash(F.col(text_col)))
    rank = F.struct("__part", id_col)
    names = [c for c in tagged.columns if not c.startswith("__")]
    whole = F.struct(*names).alias("row")
    # of one id the first part's row; rows of one id in one part are equal in rank, the smallest text stands
    by_id = tagged.groupBy(id_col).agg(F.min_by(F.struct("__part", "__hash", whole), F.struct("__part", "__hash")).alias("r"))
    by_id = by_id.select(F.col("r.__part").alias("__part"), F.col("r.__hash").alias("__hash"), "r.row", id_col)
    return by_id.groupBy("__hash").agg(F.min_by("row", rank).alias("row")).select("row.*")


def dominant(rows: DataFrame, id_col: str, relation: str) -> DataFrame:
    """(id, dominant): the most frequent relation of each sentence, of equals the first by name."""
    counts = rows.groupBy(F.col(id_col).alias("id"), relation).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("id").agg(F.min_by(relation, F.struct((-F.col("n")).alias("n"), relation)).alias("dominant"))
    return best


def shuffled(rows: DataFrame, id_col: str, seed: str) -> DataFrame:
    return rows.withColumn("__turn", F.sha2(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string")), 256))


def split(rows: DataFrame, id_col: str, stratum: str | None = None, train: float = 0.7, val: float = 0.15, seed: str = "split") -> DataFrame:
    """``rows`` with ``split``: train, val and test by exact shares of each stratum, in an order that a seed shuffles.

    With a stratum of three or more rows, validation has at least one.
    """
    by = [stratum] if stratum else []
    ordered = numbered(shuffled(rows, id_col, seed), ["__turn", id_col], "__k", by)
    totals = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    if by:
        totals = totals.withColumnRenamed(stratum, "__stratum")
        joined = ordered.join(F.broadcast(totals), ordered[stratum].eqNullSafe(F.col("__stratum")))
    else:
        joined = ordered.crossJoin(F.broadcast(totals))  # one row
    n_val = F.floor(F.lit(val) * F.col("__n"))
    lone = (n_val == 0) & (F.col("__n") >= 3) & F.lit(bool(by))
    n_val = F.when(lone, 1).otherwise(n_val)
    n_train = F.when(lone, F.col("__n") - 1).otherwise(F.floor(F.lit(train) * F.col("__n")))
    name = F.when(F.col("__k") < n_train, "train").when(F.col("__k") < n_train + n_val, "val").otherwise("test")
    return joined.select(*rows.columns, name.alias("split"))


def leaked(train: DataFrame, held: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct text hashes that both sides have; empty texts leak nothing."""
    key = lambda df: df.where(normal_text(F.col(text_col)) != "").select(text_hash(F.col(text_col)).alias("key"))
    return key(train).join(key(held).distinct(), "key", "left_semi").distinct()


def oversampled(rows: DataFrame, relations: DataFrame, id_col: str, targets: dict[str, int]) -> DataFrame:
    """``rows`` and copies (``id_dupK``) of those with rare relations.

    ``relations`` has (id, relation), one row for each edge.  A sentence is copied as often as
    its most frequent rare relation lacks of its target: min of target div count, less one.
    """
    counts = relations.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).where(F.col("relation").isin(*targets))
    wanted = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
    factor = counts.select("relation", F.greatest(F.lit(0), F.floor(wanted[F.col("relation")] / F.col("n")).cast("int") - 1).alias("factor"))
    least = relations.join(F.broadcast(factor), "relation").groupBy("id").agg(F.min("factor").alias("factor")).where("factor > 0")
    copies = rows.join(least, F.col(id_col) == F.col("id")).drop("id" if id_col != "id" else "factor")
    copies = copies.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("factor"))))
    named = copies.withColumn(id_col, F.concat(F.col(id_col).cast("string"), F.lit("_dup"), F.col("__k").cast("string")))
    return rows.withColumn(id_col, F.col(id_col).cast("string")).unionByName(named.select(rows.columns))


def migrate(edges: DataFrame) -> DataFrame:
    """Edges of the first schema (source) in the second (sources array); no row is lost or made."""
    if "sources" in edges.columns:
        return edges.withColumn("sources", F.coalesce("sources", F.array("source"))) if "source" in edges.columns else edges
    return edges.withColumn("sources", F.array("source"))


def problems(sentences: DataFrame) -> DataFrame:
    """(id, problems) of sentences (id, text, n_nodes, n_edges) that a set should not have."""
    found = F.array_compact(F.array(
        F.when(F.col("id").isNull(), "no id"), F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "no text"),
        F.when(F.coalesce("n_nodes", F.lit(0)) == 0, "no nodes"), F.when((F.coalesce("n_edges", F.lit(0)) > 0) & (F.col("n_nodes") < 2), "edges without ends"),
    ))
    return sentences.select("id", found.alias("problems")).where(F.size("problems") > 0)


def unheard(tokens: DataFrame, lexicon: DataFrame, least: int = 1) -> DataFrame:
    """(id, n, lemmas): sentences with ``least`` or more lemmas that a lexicon (lemma) lacks; tokens are (id, lemma)."""
    known = lexicon.select(F.lower("lemma").alias("lemma")).distinct()
    foreign = tokens.select("id", F.lower("lemma").alias("lemma")).join(known, "lemma", "left_anti")
    return foreign.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("lemma")).alias("lemmas")).where(F.col("n") >= least)


def connector_pairs(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(edge_idx, source, connector, target): texts of an edge's two clauses with the marker between them."""
    return (
        edges.join(labels.select(F.col("node_id").alias("src"), F.col("label").alias("source")), "src")
        .join(labels.select(F.col("node_id").alias("dst"), F.col("label").alias("target")), "dst")
        .select("edge_idx", "source", F.col("relation").alias("connector"), "target")
    )
