"""Commands of a session: a graph that grows from text to text, asked by words rather than by best label.

They differ from the question language on purpose: every node that a word matches counts, a missing
confidence has a default, and paths go by sorted ids.  Answers are rows; ``line`` columns hold the
text that a session shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import _FROM, _TO
from ..plans.graph import Graph, cut
from . import middle, reports
from .traverse import search

# Relations that block an effect, and those that bring it about.
BLOCKING = ("prevent", "filter")
ENABLING = ("cause", "enable", "motivation", "sequence")
#: Confidence of an edge that has none, where edges are ranked, and where degrees are weighted.
UNKNOWN, FULL = 0.5, 1.0
#: Rows of a ranked report.
TOP, TOP_GROUPS, TOP_SOURCES = 10, 5, 3


def plain(label: Column) -> Column:
    """Ligatures opened, accents folded, other characters than ``[a-z0-9 _-]`` dropped, trimmed last."""
    opened = F.regexp_replace(F.regexp_replace(F.coalesce(label, F.lit("")), "[œŒ]", "oe"), "[æÆ]", "ae")
    return F.trim(F.regexp_replace(F.lower(F.translate(opened, _FROM, _TO)), r"[^a-z0-9 _\-]", ""))


def match_level(label: Column, word: Column) -> Column:
    """1 equal, 2 a whole word, 3 a prefix, 4 contained, else null."""
    own, asked = plain(label), plain(word)
    whole = F.regexp(own, F.concat(F.lit(r"\b"), asked, F.lit(r"\b")))
    level = F.when(own == asked, 1).when(whole, 2).when(own.startswith(asked), 3).when(own.contains(asked), 4)
    return F.when((own != "") & (asked != ""), level)


def add(graph: Graph, nodes: DataFrame, edges: DataFrame) -> Graph:
    """The graph with further nodes, of which the last with an id counts, and edges behind the ones it has."""
    kept = graph.nodes.join(nodes.select("node_id"), "node_id", "left_anti")
    last = graph.edges.agg(F.max("edge_idx")).head()[0]
    moved = edges.withColumn("edge_idx", F.col("edge_idx") + F.lit(0 if last is None else last + 1))
    return Graph(kept.unionByName(nodes, allowMissingColumns=True), graph.edges.unionByName(moved, allowMissingColumns=True))


def save(graph: Graph, folder: str) -> None:
    graph.nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{folder}/edges")


def load(spark: SparkSession, folder: str) -> Graph:
    return Graph(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"))


def _named(graph: Graph) -> DataFrame:
    """Edges with labels and types of both ends; an end that is no node is named by its id."""
    names = graph.nodes.select("node_id", "label", "node_type")
    e = graph.edges.select("edge_idx", "src", "dst", "relation", "confidence", graph.edge("negated").alias("negated"), "provenance")
    e = e.join(names.toDF("src", "src_label", "src_type"), "src", "left").join(names.toDF("dst", "dst_label", "dst_type"), "dst", "left")
    return e.withColumns({
        f"{end}_{what}": F.coalesce(f"{end}_{what}", F.col(end).cast("string") if what == "label" else F.lit("?")) for end in ("src", "dst") for what in ("label", "type")
    })


def _touching(graph: Graph, word: str, end: str, least: int) -> DataFrame:
    found = _named(graph).withColumn("level", match_level(F.col(f"{end}_label"), F.lit(word))).where(F.col("level") <= least)
    return found.withColumn("rank", F.struct("level", (-F.coalesce("confidence", F.lit(UNKNOWN))).alias("c"), "edge_idx"))


def find_causes(graph: Graph, word: str, least: int = 2) -> DataFrame:
    """Edges whose target the word matches, with ``rank`` to order them by: level, confidence, place."""
    return _touching(graph, word, "dst", least)


def find_effects(graph: Graph, word: str, least: int = 2) -> DataFrame:
    """Edges whose source the word matches."""
    return _touching(graph, word, "src", least)


def _marked(relation: Column, negated: Column) -> Column:
    return F.concat(F.lit("["), relation, F.lit("]"), F.when(negated, " [negated]").otherwise(""))


def explain(graph: Graph, word: str) -> DataFrame:
    """(rank, line) of each direct cause."""
    conf = F.coalesce(F.format_string("%.2f", "confidence"), F.lit("?"))
    line = F.concat(F.col("src_label"), F.lit("  --"), _marked(F.col("relation"), F.col("negated")), F.lit("-->  "), F.col("dst_label"), F.lit("  conf="), conf)
    return find_causes(graph, word).select("rank", line.alias("line")).orderBy("rank")


def effects(graph: Graph, word: str) -> DataFrame:
    """(rank, line) of each direct effect."""
    line = F.concat(F.lit("--> "), _marked(F.col("relation"), F.col("negated")), F.lit("  "), F.col("dst_label"), F.lit("  ["), F.col("dst_type"), F.lit("]"))
    return find_effects(graph, word).select("rank", line.alias("line")).orderBy("rank")


def counterfactual(graph: Graph, word: str) -> DataFrame:
    """(part, relation, label, node_type): direct effects that are blocked and direct causes that are cut off, an intervention."""
    down = find_effects(graph, word).select(F.lit("blocked downstream").alias("part"), "relation", F.col("dst_label").alias("label"), F.col("dst_type").alias("node_type"))
    up = find_causes(graph, word).select(F.lit("interrupted upstream").alias("part"), "relation", F.col("src_label").alias("label"), F.col("src_type").alias("node_type"))
    return down.unionByName(up)


def find_path(graph: Graph, a: str, b: str) -> DataFrame:
    """(place, node_id) of the path from the smallest node that matches ``a`` and reaches one that matches ``b``.

    All starts are searched at once, level by level; of equally short ways the one by
    smaller ids counts.  It ends when no smaller start is still open.
    """
    whole = lambda word: match_level(F.col("label"), F.lit(word)) <= 2
    starts = graph.nodes.where(whole(a)).select("node_id")
    goals = cut(graph.nodes.where(whole(b)).select("node_id").distinct())
    steps = cut(graph.edges.select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct())
    frontier = cut(starts.select(F.col("node_id").alias("start"), "node_id", F.array("node_id").alias("path")))
    seen, won = frontier.select("start", "node_id"), None
    while True:
        hits = frontier.join(goals, "node_id", "left_semi").groupBy("start").agg(F.min("path").alias("path"))
        first = hits.orderBy("start").head()
        if first is not None and (won is None or first.start < won.start):
            won = first
        open_ = frontier if won is None else frontier.where(F.col("start") < F.lit(won.start))
        nexts = open_.join(steps, F.col("node_id") == F.col("at")).select("start", F.col("to").alias("node_id"), F.concat("path", F.array("to")).alias("path"))
        frontier = cut(nexts.join(seen, ["start", "node_id"], "left_anti").groupBy("start", "node_id").agg(F.min("path").alias("path")))
        if not frontier.take(1):
            break
        seen = cut(seen.unionByName(frontier.select("start", "node_id")))
    kind = graph.nodes.schema["node_id"].dataType.simpleString()
    rows = [] if won is None else list(enumerate(won.path))  # one path
    return graph.nodes.sparkSession.createDataFrame(rows, f"place int, node_id {kind}")


def _path_hops(graph: Graph, a: str, b: str) -> DataFrame:
    """(place, src, dst, gap, index_delta) of a path's hops; the first edge of a pair counts, its gap is the middle of what is known."""
    path = find_path(graph, a, b).join(graph.nodes.select("node_id", "temporal_index"), "node_id", "left")
    order = Window.orderBy("place")  # the nodes of one path
    hops = path.select(
        "place", F.col("node_id").alias("src"), F.lead("node_id").over(order).alias("dst"),
        (F.lead("temporal_index").over(order) - F.col("temporal_index")).alias("index_delta"),
    ).where("dst is not null")
    middle_of = F.coalesce(F.floor((F.col("gap_min") + F.col("gap_max")) / 2), "gap_min", "gap_max")
    first = graph.edges.groupBy("src", "dst").agg(F.min_by(F.struct(graph.with_gap().alias("some"), middle_of.alias("gap")), "edge_idx").alias("g"))
    return hops.join(F.broadcast(hops.select("src", "dst").distinct()), ["src", "dst"], "left_semi").join(first, ["src", "dst"], "left").select(
        "place", "src", "dst", F.coalesce("g.some", F.lit(False)).alias("with_gap"), F.col("g.gap").alias("gap"), "index_delta"
    )


def temporal_path(graph: Graph, a: str, b: str) -> DataFrame:
    """One row (hops, ordered): a path is ordered unless some step is known to go back."""
    found = find_path(graph, a, b).agg((F.count(F.lit(1)) > 0).alias("found"))
    hops = _path_hops(graph, a, b).agg(F.count(F.lit(1)).alias("hops"), F.coalesce(F.bool_and(F.coalesce(F.col("index_delta") >= 0, F.lit(True))), F.lit(True)).alias("ordered"))
    return hops.crossJoin(F.broadcast(found)).select("found", "hops", (F.col("ordered") & F.col("found")).alias("ordered"))  # one row each


def estimate_delay(graph: Graph, a: str, b: str) -> DataFrame:
    """One row (found, gap_sum, index_delta): missing gaps are passed over, open ones make the sum unknown, a missing index the step."""
    found = find_path(graph, a, b).agg((F.count(F.lit(1)) > 0).alias("found"))
    open_gap = F.coalesce(F.bool_or(F.col("with_gap") & F.col("gap").isNull()), F.lit(False))
    sums = _path_hops(graph, a, b).agg(
        F.when(~open_gap, F.coalesce(F.sum("gap"), F.lit(0))).alias("gap_sum"),
        F.when(F.count(F.lit(1)) == F.count("index_delta"), F.coalesce(F.sum("index_delta"), F.lit(0))).alias("index_delta"),
    )
    row = sums.crossJoin(F.broadcast(found))  # one row each
    return row.select("found", F.when(F.col("found"), F.col("gap_sum")).alias("gap_sum"), F.when(F.col("found"), F.col("index_delta")).alias("index_delta"))


def abduct(graph: Graph, word: str) -> DataFrame:
    """(label, depth, confidence, score) of every cause of any node that the word matches; the last edge of a pair counts."""
    starts = graph.nodes.where(match_level(F.col("label"), F.lit(word)).isNotNull()).select("node_id", F.col("node_id").alias("turn"))
    last = graph.edges.groupBy("src", "dst").agg(F.max_by(F.struct("relation", "confidence"), "edge_idx").alias("e"))
    none = F.lit(None).cast("bigint")
    steps = cut(last.select(
        F.col("dst").alias("at"), F.col("src").alias("to"), (-F.col("src")).alias("newest"), "e.relation",
        F.coalesce("e.confidence", F.lit(UNKNOWN)).alias("confidence"), none.alias("gap_min"), none.alias("gap_max"), F.lit(False).alias("negated"),
    ))
    found = search(steps, starts).where("depth > 0").join(graph.nodes.select("node_id", "label"), "node_id", "left")
    score = F.round(F.col("confidence") / (1 + F.col("depth")), 6)
    return found.select(F.coalesce("label", F.col("node_id").cast("string")).alias("label"), "depth", F.round("confidence", 6).alias("confidence"), score.alias("score"))


def _exact(graph: Graph, word: str) -> DataFrame:
    """The first node whose normal form is the word's."""
    return graph.nodes.where(plain(F.col("label")) == plain(F.lit(word))).orderBy("node_id").limit(1)


def zoom_in(graph: Graph, word: str) -> DataFrame:
    up = _exact(graph, word).select(F.col("node_id").alias("parent"))
    return graph.nodes.join(F.broadcast(up), "parent", "left_semi").select("node_id", "label", "node_type")


def zoom_out(graph: Graph, word: str) -> DataFrame:
    own = _exact(graph, word).select("parent")
    return graph.nodes.join(F.broadcast(own), F.col("node_id") == own["parent"], "left_semi").select("node_id", "label", "node_type")


def _certain(graph: Graph) -> Graph:
    clamped = F.least(F.greatest(F.when(F.isnan("confidence"), FULL).otherwise(F.coalesce("confidence", F.lit(FULL))), F.lit(0.0)), F.lit(1.0))
    return Graph(graph.nodes, graph.edges.withColumn("confidence", clamped))


def centrality(graph: Graph) -> DataFrame:
    return reports.centrality(_certain(graph))


def reliability(graph: Graph) -> DataFrame:
    return reports.reliability(Graph(graph.nodes, graph.edges.withColumn("confidence", F.coalesce("confidence", F.lit(FULL)))))


def spof(graph: Graph) -> DataFrame:
    """The ten nodes without which most pairs are lost."""
    return middle.spof(graph).orderBy(F.desc("score"), "label").limit(TOP)


def analogy(graph: Graph, a: str, b: str) -> DataFrame:
    """The ten edges most like the one between two labels."""
    return reports.analogy(_certain(graph), a, b).orderBy(F.desc("score"), "from_label", "to_label").limit(TOP)


def summarize(graph: Graph) -> DataFrame:
    """(what, name, n): nodes, relations, each relation's count, and the node with most edges going out (the first of equals)."""
    one = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), F.lit("").alias("name"), "n")
    relations = graph.edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).select(F.lit("relation").alias("what"), F.col("relation").alias("name"), "n")
    degree = graph.edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("edge_idx").alias("first"))
    top = degree.agg(F.max_by(F.struct("src", "n"), F.struct("n", (-F.col("first")).alias("f"))).alias("t")).select("t.src", "t.n")
    top = top.join(graph.nodes.select("node_id", "label"), F.col("src") == F.col("node_id"), "left")
    top = top.where("src is not null").select(F.lit("top cause").alias("what"), F.coalesce("label", F.col("src").cast("string")).alias("name"), "n")
    return one(graph.nodes, "nodes").unionByName(one(graph.edges, "edges")).unionByName(relations).unionByName(top)


def verbalize(graph: Graph) -> DataFrame:
    """(edge_idx, line) of every edge."""
    conf = F.coalesce(F.concat(F.lit("("), F.format_string("%.0f", F.bround(F.col("confidence") * 100, 0)), F.lit("%)")), F.lit("(?)"))
    line = F.concat(
        F.lit("["), F.col("src_type"), F.lit("] "), F.col("src_label"), F.lit("  --["), F.col("relation"), F.when(F.col("negated"), " [negated]").otherwise(""),
        F.lit("]-->  ["), F.col("dst_type"), F.lit("] "), F.col("dst_label"), F.lit("  "), conf,
    )
    return _named(graph).select("edge_idx", line.alias("line"))


def convergent(graph: Graph, word: str, top: int = TOP_GROUPS) -> DataFrame:
    """(src, dst, relation, n, least, most): groups of like causes, those with the greatest n times most confidence."""
    conf = F.coalesce("confidence", F.lit(0.0))
    groups = find_causes(graph, word).groupBy("src", "dst", "relation").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min(conf), 6).alias("least"), F.round(F.max(conf), 6).alias("most")
    )
    return groups.orderBy(F.desc(F.col("n") * F.col("most")), F.desc("most"), "src", "dst", "relation").limit(top)


def blocked(graph: Graph, word: str) -> DataFrame:
    """Edges into what the word names that block it or are negated."""
    own = F.lower("dst_label").contains(F.lower(F.lit(word))) | (F.col("dst_label") == word)
    return _named(graph).where(own & (F.col("relation").isin(*BLOCKING) | F.col("negated"))).select("edge_idx", "src_label", "relation", "dst_label")


def contradictions(graph: Graph) -> DataFrame:
    """(src, dst, relations) of pairs of which some edge blocks what another brings about."""
    any_of = lambda kinds: F.bool_or(F.col("relation").isin(*kinds))
    pairs = graph.edges.groupBy("src", "dst").agg(any_of(BLOCKING).alias("b"), any_of(ENABLING).alias("e"), F.array_sort(F.collect_set("relation")).alias("r"))
    return pairs.where("b AND e").select("src", "dst", F.array_join("r", ",").alias("relations"))


def sources(graph: Graph) -> DataFrame:
    """One row (relations, sources): how many edges, and from how many different places."""
    return graph.edges.agg(F.count(F.lit(1)).alias("relations"), F.count_distinct("provenance").alias("sources"))


def sanitized(text: Column) -> Column:
    """Without terminal colours and line breaks, trimmed."""
    return F.trim(F.translate(F.regexp_replace(text, "\x1b\\[[0-9;]*m", ""), "\n\r", "  "))


def truncated(text: Column, most: int = 200) -> Column:
    """At most so many characters, cut at the last blank if there is one."""
    clean = sanitized(F.coalesce(text, F.lit("")))
    head = F.substring(clean, 1, most)
    cut_ = F.regexp_replace(head, " [^ ]*$", "")
    return F.when(F.length(clean) <= most, clean).when(cut_ == "", head).otherwise(cut_)


def route(question: Column) -> Column:
    """The command of a free question: without a command of its own its last word of more than two letters is explained."""
    words = F.filter(F.split(F.regexp_replace(F.lower(question), r"[^\p{L}\p{N}]+", " "), " "), lambda w: F.length(w) > 2)
    last = F.try_element_at(words, F.lit(-1))
    return F.when(question.rlike("^[a-z_]+:"), question).when(last.isNotNull(), F.concat(F.lit("explain: "), last))


def resolve(queries: DataFrame, vectors: DataFrame, least: float = 0.3) -> DataFrame:
    """(id, node_id, similarity): for each query vector the node vector of greatest cosine, if above ``least``.

    Queries are a stated set, small enough to be sent to every task; nodes are streamed past it.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(dot(v, v))
    q = queries.select("id", F.col("vector").alias("q"), norm(F.col("vector")).alias("qn"))
    pairs = vectors.select("node_id", "vector", norm(F.col("vector")).alias("vn")).join(F.broadcast(q), F.col("vn") * F.col("qn") > 0)
    scored = pairs.select("id", "node_id", (dot(F.col("vector"), F.col("q")) / (F.col("vn") * F.col("qn"))).alias("similarity"))
    best = scored.groupBy("id").agg(F.max_by(F.struct("node_id", "similarity"), F.struct("similarity", (-F.col("node_id")).alias("n"))).alias("b"))
    return best.select("id", "b.node_id", F.round("b.similarity", 6).alias("similarity")).where(F.col("similarity") > least)
