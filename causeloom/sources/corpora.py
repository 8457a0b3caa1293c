"""Annotated corpora and plain texts as tables, and checks of what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.emission import node_type

# Fixed value: endings of files that are read as texts.
TEXT_FILES = ("txt", "md", "log", "text", "rst")
_NODE = "struct<id: string, node_type: string, label: string, token_span: array<int>>"
_EDGE = "struct<source: string, sources: array<string>, target: string, relation: string, confidence: double, negated: boolean>"
_TOKEN = "struct<id: int, form: string, lemma: string, pos: string, dep_rel: string, head: int>"
_SENTENCE = f"struct<id: string, text: string, lang: string, tokens: array<{_TOKEN}>, cir: struct<nodes: array<{_NODE}>, edges: array<{_EDGE}>>>"
_SHAPE = f"schema_version string, document struct<sentences: array<{_SENTENCE}>>, sentences array<{_SENTENCE}>"


def read_annotated(spark: SparkSession, path: str) -> DataFrame:
    """(file, schema_version, place, id, text, lang, tokens, cir): sentences of JSON files, in a document or at the top, those of each file in order."""
    files = spark.read.schema(_SHAPE).json(path, multiLine=True).withColumn("file", F.input_file_name())
    return files.select("file", "schema_version", F.posexplode(F.coalesce("document.sentences", "sentences")).alias("place", "s")).select("file", "schema_version", "place", "s.*")


def read_texts(spark: SparkSession, folder: str, least: int = 10) -> DataFrame:
    """(file, line): lines of ``least`` characters or more of the text files of a folder; other files are passed over."""
    lines = spark.read.option("pathGlobFilter", "*.{" + ",".join(TEXT_FILES) + "}").option("recursiveFileLookup", "true").text(folder)
    clean = F.trim("value")
    return lines.select(F.input_file_name().alias("file"), clean.alias("line")).where(F.length("line") >= least)


def nodes_of(sentences: DataFrame) -> DataFrame:
    """(id, place, node, node_type, label, token_span) with types by their present names."""
    return sentences.select("id", F.posexplode("cir.nodes").alias("place", "n")).select(
        "id", "place", F.col("n.id").alias("node"), node_type(F.col("n.node_type")).alias("node_type"), "n.label", "n.token_span"
    )


def edges_of(sentences: DataFrame) -> DataFrame:
    """(id, place, source, target, relation): one row for each source of an edge, an edge without a relation left out."""
    long = sentences.select("id", F.posexplode("cir.edges").alias("place", "e")).where("e.relation is not null")
    every = F.coalesce("e.sources", F.when(F.col("e.source").isNotNull(), F.array("e.source")))
    return long.select("id", "place", F.explode(every).alias("source"), "e.target", "e.relation", "e.confidence")


def samples(sentences: DataFrame) -> DataFrame:
    """(id, src, dst, relation): edges by the places of their nodes, as a model is trained on; ends that are no nodes are left out."""
    at = nodes_of(sentences).select("id", F.col("node"), "place")
    e = edges_of(sentences).select("id", "source", "target", "relation")
    return (
        e.join(at.select("id", F.col("node").alias("source"), F.col("place").alias("src")), ["id", "source"])
        .join(at.select("id", F.col("node").alias("target"), F.col("place").alias("dst")), ["id", "target"]).select("id", "src", "dst", "relation")
    )


def problems(sentences: DataFrame, relations: list[str]) -> DataFrame:
    """(id, errors) of sentences whose spans are wrong or repeated, whose edges end nowhere, or whose relations are unheard of."""
    nodes, edges = F.coalesce("cir.nodes", F.array().cast(f"array<{_NODE}>")), F.coalesce("cir.edges", F.array().cast(f"array<{_EDGE}>"))
    wrong = lambda s: s.isNull() | (F.size(s) != 2) | (F.get(s, F.lit(0)) > F.get(s, F.lit(1))) | (F.get(s, F.lit(0)) < 1)
    ids = F.transform(nodes, lambda n: n["id"])
    spans = F.transform(nodes, lambda n: n["token_span"])
    ends = lambda name: F.transform(F.filter(edges, lambda e: ~F.coalesce(F.array_contains(ids, e[name]), F.lit(False))), lambda e: F.concat(F.lit(f"{name} "), F.coalesce(e[name], F.lit("?"))))
    unheard = F.transform(F.filter(edges, lambda e: ~F.coalesce(e["relation"].isin(*relations), F.lit(False))), lambda e: F.concat(F.lit("relation "), F.coalesce(e["relation"], F.lit("?"))))
    found = F.concat(
        F.transform(F.filter(nodes, lambda n: wrong(n["token_span"])), lambda n: F.concat(F.lit("span of "), n["id"])),
        F.when(F.size(F.array_distinct(spans)) < F.size(spans), F.array(F.lit("two nodes of one span"))).otherwise(F.array().cast("array<string>")),
        ends("source"), ends("target"), unheard,
    )
    return sentences.select("id", found.alias("errors"))


def validity(checked: DataFrame) -> DataFrame:
    """One row (total, valid, invalid, valid_pct) of ``problems``."""
    bad = F.count_if(F.size("errors") > 0)
    share = F.when(F.count(F.lit(1)) > 0, 100 * (F.count(F.lit(1)) - bad) / F.count(F.lit(1))).otherwise(0.0)
    return checked.agg(F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) - bad).alias("valid"), bad.alias("invalid"), F.round(share, 1).alias("valid_pct"))


def uniform_spans(n_tokens: Column, n_nodes: Column) -> Column:
    """``n_nodes`` spans that part the tokens 1 to ``n_tokens`` evenly, the last one taking what is left."""
    size = F.greatest(F.floor(n_tokens / n_nodes), F.lit(1))
    spans = F.transform(F.sequence(F.lit(1), F.greatest(n_nodes, F.lit(1))), lambda k: F.struct(
        ((k - 1) * size + 1).cast("int").alias("s"), F.when(k == n_nodes, F.greatest(n_tokens, (k - 1) * size + 1)).otherwise(k * size).cast("int").alias("e")))
    return F.when(n_nodes > 0, spans).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def span_report(sentences: DataFrame) -> DataFrame:
    """One row (sentences, nodes, mean_length, covering): how long spans are, and how many cover their whole sentence."""
    nodes = nodes_of(sentences).join(sentences.select("id", F.size("tokens").alias("n_tokens")), "id")
    length = F.get("token_span", F.lit(1)) - F.get("token_span", F.lit(0)) + 1
    return nodes.agg(F.count_distinct("id").alias("sentences"), F.count(F.lit(1)).alias("nodes"), F.round(F.avg(length), 4).alias("mean_length"), F.count_if(length >= F.col("n_tokens")).alias("covering"))


def as_document(sentences: DataFrame) -> DataFrame:
    """(json): one line for each sentence, in the second schema."""
    return sentences.select(F.to_json(F.struct(F.lit("2.0").alias("schema_version"), F.array(F.struct("id", "text", "lang", "tokens", "cir")).alias("sentences"))).alias("json"))


def bootstrap(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, text, tokens, cir): a sentence for each edge of a graph, of its ends' labels with the relation between, and made-up tokens."""
    at = labels.select("node_id", F.col("label"), "node_type")
    e = edges.join(at.toDF("src", "s_label", "s_type"), "src").join(at.toDF("dst", "d_label", "d_type"), "dst")
    first, second = F.split("s_label", r"\s+"), F.split("d_label", r"\s+")
    words = F.concat(first, F.array("relation"), second)
    tokens = F.transform(words, lambda w, k: F.struct(
        (k + 1).cast("int").alias("id"), w.alias("form"), F.lower(w).alias("lemma"), F.lit("X").alias("pos"), F.lit("dep").alias("dep_rel"), F.lit(0).alias("head")))
    node = lambda name, kind, label, low, high: F.struct(F.lit(name).alias("id"), F.col(kind).alias("node_type"), F.col(label).alias("label"), F.array(low.cast("int"), high.cast("int")).alias("token_span"))
    n, m = F.size(first), F.size(second)
    cir = F.struct(
        F.array(node("n001", "s_type", "s_label", F.lit(1), n), node("n002", "d_type", "d_label", n + 2, n + m + 1)).alias("nodes"),
        F.array(F.struct(F.lit("n001").alias("source"), F.array(F.lit("n001")).alias("sources"), F.lit("n002").alias("target"), F.col("relation"), F.col("confidence"), F.lit(False).alias("negated"))).alias("edges"),
    )
    return e.select(F.concat(F.lit("b"), F.col("edge_idx").cast("string")).alias("id"), F.array_join(words, " ").alias("text"), tokens.alias("tokens"), cir.alias("cir"))
