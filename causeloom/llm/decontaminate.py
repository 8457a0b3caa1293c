"""Benchmark decontamination with a distributed positional inverted index.

Words are runs of ASCII letters and digits and of any non-ASCII characters,
lower-cased A-Z.  A *phrase* is a window of ``WINDOW`` consecutive words of a
benchmark item (the whole item if it is shorter).

Method
------
1. Index.  One scan of the documents stages a posting (term, document, position)
   for every occurrence of a *test term*, a word of the benchmark, and a last
   posting that holds the document's word count.  Nothing is shuffled: each task
   writes the postings of its own documents.
2. Rarity.  The postings of each term are counted; the terms of each phrase are
   put in order from the rarest.
3. Intersection.  The postings of a phrase's rarest term, moved back by the term's
   offset, are the candidate places.  They are intersected with the moved postings
   of the second and of the third rarest term, and what is left with those of all
   other terms at once.  The joins are on (document, position), which spreads a
   frequent term or a frequent passage over all tasks.
4. :func:`phrase_matches` gives the exact places; :func:`proximity_matches` gives
   places where an item's rarest terms stand near each other in any order, and
   :func:`near_items` those of whole tables.

The index holds the words of the benchmark only: another benchmark is another scan.
Its terms and phrases are small tables beside a corpus, but nothing depends on that: they are joined without a hint, so that Spark broadcasts them only
below its threshold for their measured size and shuffles both sides beyond it.

Defined results: null and empty texts have no words; an item without words is no
phrase and an item that repeats counts once for each item id; an item with a null
id has no place in results; rows that repeat are separate documents; an empty
benchmark hits nothing; columns besides id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage

WINDOW = 10
#: Terms that are intersected one after the other before all others at once.
STEPS = 3
#: Documents with a candidate place that are broadcast at most (8 bytes each); more are joined by shuffling.
BROADCAST_ROWS = 2_000_000
# Fixed value: what stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_END = " "  # no word; its posting holds the word count
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text):
    """All words of a text, in order."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, BETWEEN), "")


def phrases(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(phrase, item, size, terms): distinct windows of every item."""
    w = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    size = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    cut = w.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, size))).alias("terms")).distinct()
    return cut.select(F.xxhash64("item", "terms").alias("phrase"), "item", F.size("terms").alias("size"), "terms")


def index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stage the positional postings (row, id, term, pos) of ``terms`` (term string, term_id long).

    ``term`` is the number of the term; the posting with term -1 holds the number
    of words of its document.
    """
    wanted = terms.select("term", "term_id").unionByName(
        docs.sparkSession.sql(f"SELECT '{_END}' AS term, CAST(-1 AS BIGINT) AS term_id")
    )
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    tokens = numbered.select("row", "id", F.posexplode(F.concat(words(F.col("text")), F.array(F.lit(_END)))).alias("pos", "term"))
    postings = tokens.join(wanted, "term").select("row", "id", F.col("term_id").alias("term"), "pos")
    return stage(postings, "postings")


def _by_rarity(found: DataFrame, numbered: DataFrame, postings: DataFrame) -> DataFrame:
    """Phrases with ``order``: their (count, term, offset) from the rarest term on; phrases with an absent term go."""
    counts = postings.where("term >= 0").groupBy("term").count()
    places = (
        found.select("phrase", "item", "size", F.posexplode("terms").alias("offset", "word"))
        .join(numbered, F.col("word") == F.col("known"))
        .join(counts, "term")
        .groupBy("phrase", "item", "size")
        .agg(F.array_sort(F.collect_list(F.struct("count", "term", "offset"))).alias("order"))  # at most WINDOW entries
    )
    return places.where("size(order) = size").select("phrase", "item", "size", "order")


def phrase_matches(postings: DataFrame, found: DataFrame, numbered: DataFrame, steps: int = STEPS) -> DataFrame:
    """(row, id, item, start, size): every occurrence of a phrase, by intersection of postings.

    ``numbered`` has (known string, term int), the test terms.
    """
    ordered = stage(_by_rarity(found, numbered, postings), "phrases-by-rarity")
    lists = postings.where("term >= 0").select("row", "id", "term", "pos")
    # phrases of several items that are alike are looked up once
    shapes = ordered.groupBy(F.transform("order", lambda o: F.struct(o["term"], o["offset"])).alias("need")).agg(
        F.min("phrase").alias("shape"), F.first("size").alias("size")
    )
    first = shapes.select("shape", "size", "need", F.get("need", F.lit(0))["term"].alias("term"), F.get("need", F.lit(0))["offset"].alias("off"))
    held = lists.join(first, "term").select("row", "id", (F.col("pos") - F.col("off")).alias("start"), "shape", "size", "need")
    held = held.where("start >= 0")
    for k in range(1, steps):
        want = held.where(F.size("need") > k).select("*", F.get("need", F.lit(k))["term"].alias("term"), (F.col("start") + F.get("need", F.lit(k))["offset"]).alias("pos"))
        kth = shapes.where(F.size("need") > k).select(F.get("need", F.lit(k))["term"].alias("term")).distinct()
        some = lists.join(kth, "term", "left_semi").select("row", "term", "pos")
        met = want.join(some, ["row", "term", "pos"], "left_semi").drop("term", "pos")
        held = met.unionByName(held.where(F.size("need") <= k))
    held = stage(held, "candidate-places")
    rest = held.where(F.size("need") > steps).select(
        "row", "start", "shape", F.explode(F.slice("need", F.lit(steps + 1), F.size("need"))).alias("n")
    ).select("row", "start", "shape", F.col("n.term").alias("term"), (F.col("start") + F.col("n.offset")).alias("pos"))
    # only documents with a candidate can match: their postings are few
    rows = stage(held.where(F.size("need") > steps).select("row").distinct(), "candidate-rows")
    rows = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows  # else all postings are shuffled
    near = lists.join(rows, "row", "left_semi").select("row", "term", "pos")
    full = (
        rest.join(near, ["row", "term", "pos"]).groupBy("row", "start", "shape").agg(F.count(F.lit(1)).alias("met"))
    )
    whole = held.join(full, ["row", "start", "shape"], "left").where(
        (F.size("need") <= steps) | (F.col("met") == F.size("need") - steps)
    ).select("row", "id", "start", "shape", "size")
    owners = ordered.select(
        F.transform("order", lambda o: F.struct(o["term"], o["offset"])).alias("need"), "item"
    ).join(shapes.select("need", "shape"), "need").select("shape", "item").distinct()
    return stage(whole, "phrase-places").join(owners, "shape").select("row", "id", "item", "start", "size")


def proximity_matches(postings: DataFrame, items: DataFrame, numbered: DataFrame, terms: int = 3, within: int = 20) -> DataFrame:
    """(row, id, item, start, stop): places where an item's ``terms`` rarest words, or all it has, stand within ``within`` words.

    The rarest word's postings are the candidates.  Each further word meets them in blocks of
    that many words, and every posting that still fits goes on, not the nearest alone; a
    candidate has fewer than ``2 * within`` of each, so their number is bounded.  Items of
    which a word is in no document have no place.
    """
    counts = postings.where("term >= 0").groupBy("term").count()
    known = items.select("item", F.explode(F.array_distinct("w")).alias("known")).join(numbered, "known", "left")
    rare = (
        known.join(counts, "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
        .groupBy("item").agg(F.slice(F.array_sort(F.collect_set(F.struct("count", "term"))), 1, terms).alias("r"))  # words of one item
        .where(F.get("r", F.lit(0))["count"] > 0).select("item", F.transform("r", lambda x: x["term"]).alias("r"))
    )
    lists = postings.where("term >= 0")
    held = lists.join(rare.select("item", "r", F.get("r", F.lit(0)).alias("term")), "term").select(
        "row", "id", "item", "r", F.col("pos").alias("start"), F.col("pos").alias("stop")
    )
    for k in range(1, terms):
        kth = lists.join(rare.where(F.size("r") > k).select(F.get("r", F.lit(k)).alias("term")).distinct(), "term", "left_semi").select(
            "row", "term", "pos", F.explode(F.array(*[F.floor(F.col("pos") / within) + d for d in (-1, 0, 1)])).alias("block")
        )
        want = held.where(F.size("r") > k).select("*", F.get("r", F.lit(k)).alias("term"), F.floor(F.col("start") / within).alias("block"))
        met = want.join(kth, ["row", "term", "block"]).select(
            "row", "id", "item", "r", F.least("start", "pos").alias("start"), F.greatest("stop", "pos").alias("stop")
        ).where(F.col("stop") - F.col("start") < within)
        held = met.distinct().unionByName(held.where(F.size("r") <= k))
    return held.select("row", "id", "item", "start", "stop")


def near_items(
    docs: DataFrame, items: DataFrame, terms: int = 3, within: int = 20,
    id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(id, item, start, stop): ``proximity_matches`` of whole tables, beside the exact ones of :func:`decontaminate`."""
    split = stage(items.select(F.col(item_id).alias("item"), words(F.col(item_text)).alias("w")).where("size(w) > 0"), "item-words")
    numbered = _test_terms(split.select(F.explode("w").alias("term")).distinct())
    postings = index(docs, numbered, id_col, text_col)
    known = numbered.select(F.col("term").alias("known"), F.col("term_id").alias("term"))
    return proximity_matches(postings, split, known, terms, within).select("id", "item", "start", "stop")


def _test_terms(every: DataFrame) -> DataFrame:
    """Staged (term, term_id): numbers that need no order, frozen by being written."""
    return stage(every.select("term", F.monotonically_increasing_id().alias("term_id")), "test-terms")


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW,
    id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row for each document: id, n_words, n_hit, items (sorted ids of the items met)."""
    found = stage(phrases(items, window, item_id, item_text), "phrases")
    every = found.select(F.explode("terms").alias("term")).distinct()
    numbered = _test_terms(every)
    postings = index(docs, numbered, id_col, text_col)
    known = numbered.select(F.col("term").alias("known"), F.col("term_id").alias("term"))
    places = phrase_matches(postings, found, known)
    hits = (
        places.select("row", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos")).distinct()
        .groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    )
    met = places.where("item IS NOT NULL").select("row", F.col("item").cast("string").alias("item")).distinct().groupBy("row").agg(
        F.array_sort(F.collect_list("item")).alias("items")  # of one document
    )
    every = postings.where("term = -1").select("row", "id", F.col("pos").cast("long").alias("n_words"))
    return every.join(hits, "row", "left").join(met, "row", "left").select(
        "id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate(docs, items)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), iw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), ph AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM iw WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM ph
), dp AS (
  SELECT doc_id, k, s, array_to_string(w[s : s + k - 1], ' ') AS p
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM dw, ks WHERE len(w) >= k)
), occ AS (
  SELECT DISTINCT doc_id, item_id, dp.k, s FROM dp JOIN ph ON dp.p = ph.p AND dp.k = ph.k
), hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS q FROM occ) GROUP BY doc_id
), met AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM occ) GROUP BY doc_id
)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN met USING (doc_id)
"""
