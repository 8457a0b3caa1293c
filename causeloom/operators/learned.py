"""Forward passes over graphs with given weights: joins, aggregates and array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import cut


def _lit(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def times(matrix: list[list[float]], vector: Column) -> Column:
    """Matrix (rows out, columns in) times a vector."""
    return F.array(*[dot(_lit(row), vector) for row in matrix])


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relu(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.greatest(x, F.lit(0.0)))


def layer_norm(vector: Column, scale: list[float], shift: list[float], least: float = 1e-5) -> Column:
    """Zero mean and unit variance, then scaled and shifted."""
    mean = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x) / F.size(vector)
    variance = F.aggregate(vector, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(vector)
    unit = F.transform(vector, lambda x: (x - mean) / F.sqrt(variance + least))
    return F.zip_with(F.zip_with(unit, _lit(scale), lambda x, g: x * g), _lit(shift), lambda x, b: x + b)


def perceptron(vector: Column, layers: list[tuple[list[list[float]], list[float]]]) -> Column:
    """Linear layers with a rectifier between them; the last one's outputs are logits."""
    for k, (weights, bias) in enumerate(layers):
        vector = F.zip_with(times(weights, vector), _lit(bias), lambda x, b: x + b)
        vector = vector if k == len(layers) - 1 else relu(vector)
    return vector


def _summed(rows: DataFrame, by: str, vector: str, size: int) -> DataFrame:
    """Sums of vectors by place, with map-side combine."""
    return rows.groupBy(by).agg(F.array(*[F.sum(F.get(vector, F.lit(k))) for k in range(size)]).alias(vector))


def convolve(nodes: DataFrame, edges: DataFrame, own: list[list[float]], by_relation: dict[str, list[list[float]]], activation: str = "sigmoid") -> DataFrame:
    """(node_id, vector): each node's own weights times its vector, and for each relation the mean of its sources' messages.

    nodes are (node_id, vector), edges (src, dst, relation); edges of other relations are refused
    by the caller or say nothing.
    """
    known = edges.where(F.col("relation").isin(*by_relation)).select("src", "dst", "relation")
    counts = known.groupBy("dst", "relation").agg(F.count(F.lit(1)).alias("n"))
    sent = known.join(nodes.select(F.col("node_id").alias("src"), "vector"), "src").join(counts, ["dst", "relation"])
    message = F.lit(None).cast("array<double>")
    for relation, weights in by_relation.items():
        message = F.when(F.col("relation") == relation, times(weights, F.col("vector"))).otherwise(message)
    sent = sent.select(F.col("dst").alias("node_id"), F.transform(message, lambda x: x / F.col("n")).alias("m"))
    got = _summed(sent, "node_id", "m", len(own))
    out = F.when(F.col("m").isNull(), times(own, F.col("vector"))).otherwise(F.zip_with(times(own, F.col("vector")), F.col("m"), lambda x, y: x + y))
    shaped = {"sigmoid": F.transform(out, sigmoid), "relu": relu(out), "none": out}[activation]
    return nodes.join(got, "node_id", "left").select("node_id", shaped.alias("vector"))


def attend(nodes: DataFrame, edges: DataFrame, own: list[list[float]], by_relation: dict[str, list[list[float]]], attention: dict[str, list[float]], slope: float = 0.2) -> DataFrame:
    """(node_id, vector) of one head: messages weighed by a softmax over each target's edges of a relation."""
    known = edges.where(F.col("relation").isin(*by_relation)).select("edge_idx", "src", "dst", "relation")
    both = known.join(nodes.select(F.col("node_id").alias("src"), F.col("vector").alias("vs")), "src").join(nodes.select(F.col("node_id").alias("dst"), F.col("vector").alias("vd")), "dst")
    ms, md, score = (F.lit(None).cast("array<double>") for _ in range(3))
    score = F.lit(None).cast("double")
    for relation, weights in by_relation.items():
        hit = F.col("relation") == relation
        ms, md = F.when(hit, times(weights, F.col("vs"))).otherwise(ms), F.when(hit, times(weights, F.col("vd"))).otherwise(md)
    both = both.select("dst", "relation", ms.alias("ms"), md.alias("md"))
    for relation, a in attention.items():
        score = F.when(F.col("relation") == relation, dot(_lit(a), F.concat("ms", "md"))).otherwise(score)
    leaky = F.when(score >= 0, score).otherwise(slope * score)
    scored = cut(both.select("dst", "relation", "ms", leaky.alias("e")))
    tops = scored.groupBy("dst", "relation").agg(F.max("e").alias("top"))
    exps = scored.join(tops, ["dst", "relation"]).withColumn("x", F.exp(F.col("e") - F.col("top")))
    sums = exps.groupBy("dst", "relation").agg(F.sum("x").alias("total"))
    weighed = exps.join(sums, ["dst", "relation"]).select(F.col("dst").alias("node_id"), F.transform("ms", lambda m: m * F.col("x") / F.col("total")).alias("m"))
    got = _summed(weighed, "node_id", "m", len(own))
    out = F.when(F.col("m").isNull(), times(own, F.col("vector"))).otherwise(F.zip_with(times(own, F.col("vector")), F.col("m"), lambda x, y: x + y))
    return nodes.join(got, "node_id", "left").select("node_id", out.alias("vector"))


def embed(tokens: DataFrame, table: DataFrame, unknown: list[float]) -> DataFrame:
    """``tokens`` (word, …) with the vector of the word, or that of the unknown one."""
    return tokens.join(table.select(F.col("word"), F.col("vector")), "word", "left").withColumn("vector", F.coalesce("vector", _lit(unknown)))


def vector_key(text: Column, place: Column) -> Column:
    """The stable key of a clause's vector."""
    return F.concat(F.sha2(text, 256), F.lit("_"), place.cast("string"))


def near_pairs(edges: DataFrame, hops: int) -> DataFrame:
    """(src, dst) at most so many hops apart, self-pairs and edges left out."""
    steps = cut(edges.select("src", "dst").where("src <> dst").distinct())
    seen = frontier = steps
    for _ in range(hops - 1):
        further = frontier.join(steps.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").select("src", F.col("to").alias("dst")).where("src <> dst").distinct()
        frontier = cut(further.join(seen, ["src", "dst"], "left_anti"))
        seen = cut(seen.unionByName(frontier))
    return seen.join(steps, ["src", "dst"], "left_anti")


def predict_links(nodes: DataFrame, pairs: DataFrame, weights: list[list[float]], bias: float = 0.0, threshold: float = 0.5) -> DataFrame:
    """(src, dst, score) of candidate pairs whose bilinear score reaches the threshold."""
    left = nodes.select(F.col("node_id").alias("src"), F.col("vector").alias("u"))
    right = nodes.select(F.col("node_id").alias("dst"), times(weights, F.col("vector")).alias("wv"))
    scored = pairs.join(left, "src").join(right, "dst").select("src", "dst", F.round(sigmoid(dot(F.col("u"), F.col("wv")) + bias), 6).alias("score"))
    return scored.where(F.col("score") >= threshold)


def negatives(edges: DataFrame, n_nodes: int, ratio: float = 1.0, seed: str = "0") -> DataFrame:
    """(src, dst): as many pairs without an edge as edges times ``ratio``, drawn by a seeded hash; all if there are too few.

    The nodes are 0 to ``n_nodes`` - 1.  Draws are hashed numbers of pairs, several for each that is
    wanted, so no table of all pairs is made unless the graph is nearly full.
    """
    spark = edges.sparkSession
    have = cut(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct())
    wanted, all_pairs = int(edges.count() * ratio), n_nodes * (n_nodes - 1)
    free = all_pairs - have.where("src <> dst").count()
    if wanted * 4 >= free:
        numbers = spark.range(n_nodes * n_nodes).select(F.col("id").alias("p"))  # a nearly full graph is no larger than its edges
    else:
        numbers = spark.range(wanted * 4 + 64).select(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n_nodes * n_nodes)).alias("p")).distinct()
    pairs = numbers.select(F.floor(F.col("p") / n_nodes).alias("src"), (F.col("p") % n_nodes).alias("dst")).where("src <> dst").join(have, ["src", "dst"], "left_anti")
    return pairs.orderBy(F.xxhash64(F.lit(seed), "src", "dst"), "src", "dst").limit(wanted)


# What a connector's part of speech, a pronoun, and nothing say about two sentences.
BY_CONJUNCTION, BY_PRONOUN, BY_NOTHING = 0.50, 0.50, 0.35


def discourse(sentences: DataFrame, connectors: list[tuple[str, str, float, bool]] = ()) -> DataFrame:
    """(doc, sentence, src, dst, relation, confidence): how each sentence follows the one before it.

    sentences are (doc, sentence, pivot, lemmas, pos, dep): its pivot node and its tokens' arrays.
    ``connectors`` are (lemma prefix, relation, confidence, inverted), tried first.
    """
    before = Window.partitionBy("doc").orderBy("sentence")  # the sentences of one document
    prefix = F.array_join(F.transform(F.slice("lemmas", 1, 3), lambda x: F.lower(x)), " ")
    relation, conf, inverted = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(False)
    for lemma, name, c, turn in reversed(list(connectors)):
        hit = prefix.startswith(lemma)
        relation, conf, inverted = F.when(hit, name).otherwise(relation), F.when(hit, c).otherwise(conf), F.when(hit, turn).otherwise(inverted)
    early = F.filter(F.slice("pos", 1, 2), lambda p: p.isin("CCONJ", "ADV"))
    by_pos = F.when(F.size(early) > 0, F.when(F.get(early, F.lit(0)) == "CCONJ", "cause").otherwise("sequence"))
    pronoun = F.exists(F.arrays_zip(F.slice("pos", 1, 3).alias("p"), F.slice("dep", 1, 3).alias("d")), lambda x: (x["p"] == "PRON") & x["d"].isin("nsubj", "expl"))
    rows = sentences.withColumn("prior", F.lag("pivot").over(before)).where("prior is not null AND pivot is not null")
    found = F.coalesce(relation, by_pos, F.lit("cause"))
    sure = F.coalesce(conf, F.when(by_pos.isNotNull(), BY_CONJUNCTION), F.when(pronoun, BY_PRONOUN), F.lit(BY_NOTHING))
    return rows.select(
        "doc", "sentence", F.when(inverted, F.col("pivot")).otherwise(F.col("prior")).alias("src"), F.when(inverted, F.col("prior")).otherwise(F.col("pivot")).alias("dst"),
        found.alias("relation"), sure.alias("confidence"),
    )


def membership(lemma: Column, classes: list[list[str]]) -> Column:
    """One 1 or 0 for each class of a taxonomy."""
    return F.array(*[F.when(F.lower(lemma).isin(*words), 1.0).otherwise(0.0) if words else F.lit(0.0) for words in classes])
