"""Exact deduplication by a heavy-hitter split.

Texts are equal when they are identical after deleting the six white-space
characters ``[\\x20\\x09-\\x0D]``; a null text counts as empty.  Of equal texts the
row with the most code points in its original text stays, then the smallest id.

Method
------
1. One scan turns every text into a fixed-size record (id, length, digest) and
   stages it; no later step touches a text.
2. A Misra-Gries summary (``DataFrame.freqItems`` is its mergeable form) lists at
   most ``1/support`` digests that may hold more than ``support`` of all rows.
   It has no false negatives, so what is left has a bounded share of the rows.
3. The candidates are verified: their exact count and winning row are aggregated.
   This table has at most ``1/support`` rows, a bound that does not depend on the
   input, and is broadcast; heavy rows get their decision without a shuffle.
4. All other records are aggregated per digest with map-side combine and joined
   back, a join whose skewed partitions adaptive execution can split.

Defined results: null text is empty; an empty table gives no rows; rows that
repeat (same id and text) count each and exactly one of them is kept; a null id
loses against any other id of the same length; columns besides id and text are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import scratch, stage

#: Characters that the normal form drops, ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
#: Share of all rows above which a digest is surely treated as a heavy hitter.
SUPPORT = 0.001
#: Losers that are broadcast at most (an id and a digest each, some 100 bytes); more are joined by shuffling.
BROADCAST_LOSERS = 300_000


def normal_form(text):
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, id, n_chars, digest, short): one fixed-size record for each row."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("id"),
        F.length(F.coalesce(text, F.lit(""))).alias("n_chars"),
        F.unhex(F.sha2(normal_form(text), 256)).alias("digest"),
    ).select(
        F.monotonically_increasing_id().alias("row_id"), "*", F.xxhash64("digest").alias("short")
    )


def _decision():
    """Aggregates of a group of equal texts: its size and the row that stays."""
    best = F.min(F.struct(-F.col("n_chars"), F.col("id").isNull(), F.col("id"), F.col("row_id")))
    return F.count(F.lit(1)).alias("group_size"), best.alias("best")


def heavy_hitters(records: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Digests that may exceed ``support``, verified: (digest, group_size, best), at most 1/support rows."""
    summary = records.freqItems(["short"], support)
    frequent = summary.select(F.explode("short_freqItems").alias("short"))
    return (
        records.join(F.broadcast(frequent), "short", "left_semi")
        .groupBy("digest").agg(*_decision()).where("group_size > 1")
    )


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, digest, n_chars, row_id."""
    records = stage(digests(docs, id_col, text_col), "digests")
    heavy = stage(heavy_hitters(records, support).coalesce(1), "heavy")
    tagged = records.join(F.broadcast(heavy), "digest", "left")
    settled = tagged.where(F.col("best").isNotNull())
    light = tagged.where(F.col("best").isNull()).drop("group_size", "best")
    groups = light.groupBy("digest").agg(*_decision())
    ordinary = light.join(groups, "digest")
    columns = ["id", "n_chars", "digest", "row_id", "group_size", "best"]
    return settled.select(columns).unionByName(ordinary.select(columns)).select(
        "id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("best.row_id")).alias("kept"),
        "digest", "n_chars", "row_id",
        (F.col("id").eqNullSafe(F.col("best.id"))).alias("same_id"),
    )


def keep_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Losers are removed by an anti-join on (id, digest); texts travel only if the
    losers are more than ``BROADCAST_LOSERS``.  Rows repeated under the id of a winner are told
    apart afterwards, and only the rows of such ids travel for that.
    """
    spark = docs.sparkSession
    with scratch(spark, "losers", "tied-ids"):
        decisions = stage(decide(docs, id_col, text_col, support).where(~F.col("kept")), "losers")
        same = decisions.where("same_id")
        tied = stage(same.select(F.col("id").alias("__tied")).distinct(), "tied-ids")
        some = tied.limit(1).count()
    losers = decisions.where(~F.col("same_id")).select(F.col("id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    losers = F.broadcast(losers) if decisions.count() <= BROADCAST_LOSERS else losers
    digest = F.unhex(F.sha2(normal_form(F.col(text_col)), 256))

    def without(rows: DataFrame) -> DataFrame:
        marked = rows.withColumn("__own", digest)
        return marked.join(losers, marked[id_col].eqNullSafe(F.col("__id")) & (marked["__own"] == F.col("__digest")), "left_anti")

    if not some:
        return without(docs).drop("__own")
    # only rows whose id has repeats of a winner are put in order, with their texts
    known = docs[id_col].eqNullSafe(F.col("__tied"))
    single, repeated = docs.join(tied, known, "left_anti"), docs.join(tied, known, "left_semi")
    longest = Window.partitionBy(id_col, "__own").orderBy(F.length(F.coalesce(F.col(text_col), F.lit(""))).desc())
    first = without(repeated).withColumn("__rank", F.row_number().over(longest)).where("__rank = 1").drop("__rank")
    return without(single).unionByName(first).drop("__own")


def query(spark, sf_dir: str) -> DataFrame:
    found = decide(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept,
       text_sha256
FROM d
"""
