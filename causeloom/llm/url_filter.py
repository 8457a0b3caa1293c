"""URL filtering with a trie over reversed host labels and path segments.

A rule is (verdict, host, path).  It fits its host and every subdomain when the
URL's path starts with the rule's path, character by character.  Of the rules
that fit, the longest wins: more host labels first, then the longer path; of two
equal rules with different verdicts the block wins.  URLs that no rule fits get
``default``.

The trie walks the host labels from the right (``org``, ``example``, ...) and
then the path's segments; a rule's last, unfinished segment is kept at its node
as a list of prefixes.  Walking one URL costs its own length, and as many tries at a
node as its unfinished segments have lengths.  The compiled trie is broadcast while the rules number at most
``max_broadcast_rules``; a larger list is joined on host suffixes instead
(:func:`_by_join`), with the same result.

Defined results: a null url, or one without ``://``, has an empty host and path
and so no rule; an empty table gives no rows; repeated rows are judged each;
further columns stay as they are, those named ``host``, ``path``, ``rule`` or ``verdict`` as
``host_input`` and so on.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import apart

#: (verdict, host, path) of the registered query.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Rules up to this number are broadcast as one trie (about 200 bytes each).
MAX_BROADCAST_RULES = 200_000

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class RuleTrie:
    """Longest-match lookup; nodes are ``[children by label, path root]``."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: list = [{}, None]
        for verdict, host, path in sorted(rules, reverse=True):  # a block overwrites an equal allow
            self.add(verdict, host, path)

    def add(self, verdict: str, host: str, path: str) -> None:
        node = self.root
        for label in reversed(host.translate(_LOWER).split(".")):
            node = node[0].setdefault(label, [{}, None])
        if node[1] is None:
            node[1] = [{}, {}, []]
        at = node[1]  # [children by whole segment, {unfinished segment: (rule, verdict)}, their lengths from the longest on]
        *whole, rest = path.split("/")
        for segment in whole:
            at = at[0].setdefault(segment, [{}, {}, []])
        at[1][rest] = (host + path, verdict)
        at[2] = sorted({len(r) for r in at[1]}, reverse=True)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            if node[1] is not None:
                best = self._in_path(node[1], path.split("/")) or best
        return best

    @staticmethod
    def _in_path(at: list, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for k, segment in enumerate(segments):
            for cut in at[2]:
                hit = at[1].get(segment[:cut]) if cut <= len(segment) else None
                if hit is not None:
                    best = hit
                    break
            if k == len(segments) - 1:
                break
            at = at[0].get(segment)
            if at is None:
                break
        return best


def host_of(url):
    rest = F.substring_index(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), "#", 1)
    return F.translate(
        F.substring_index(F.substring_index(rest, "?", 1), "/", 1),
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz",
    )


def path_of(url):
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    bare = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    at = F.instr(bare, "/")
    return F.when(at > 0, F.substring(bare, at, F.length(bare))).otherwise(F.lit(""))


def split_url(pages: DataFrame, url_col: str = "url") -> DataFrame:
    url = F.coalesce(F.col(url_col), F.lit(""))
    return pages.withColumns({"host": host_of(url), "path": path_of(url)})


def judge(
    pages: DataFrame,
    rules: Iterable[tuple[str, str, str]] = RULES,
    url_col: str = "url",
    default: str = "allow",
    max_broadcast_rules: int = MAX_BROADCAST_RULES,
) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict."""
    rules = list(rules)
    split = split_url(apart(pages, ["host", "path", "rule", "verdict"], own=[url_col]), url_col)
    if len(rules) <= max_broadcast_rules:
        found = _by_trie(split, rules)
    else:
        found = _by_join(split, rules)
    return found.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def _by_trie(split: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    spark = split.sparkSession
    packed = spark.sparkContext.broadcast(zlib.compress(pickle.dumps(RuleTrie(rules).root)))

    @F.pandas_udf(T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]))
    def look_up(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = RuleTrie([])
        trie.root = pickle.loads(zlib.decompress(packed.value))
        for hosts, paths in parts:
            hits = [trie.find(h, p) or (None, None) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(hits, columns=["rule", "verdict"], dtype=object)

    hit = look_up("host", "path")
    return split.withColumn("__hit", hit).withColumns(
        {"rule": F.col("__hit.rule"), "verdict": F.col("__hit.verdict")}
    ).drop("__hit")


def _by_join(split: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The same for lists beyond the broadcast: host suffixes joined to rules, the best by window."""
    spark = split.sparkSession
    table = spark.createDataFrame(
        [(v, h.translate(_LOWER), p, h + p) for v, h, p in rules], "v string, h string, p string, r string"
    )
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."),
    )
    urls = split.select("host", "path").distinct()
    fits = (
        urls.select("host", "path", F.explode(suffixes).alias("h")).join(table, "h")
        .where(F.col("path").startswith(F.col("p")))
    )
    best = fits.groupBy("host", "path").agg(
        F.max(F.struct(F.size(F.split("h", r"\.", -1)), F.length("p"), F.col("v"), F.col("r"))).alias("b")
    ).select("host", "path", F.col("b.r").alias("rule"), F.col("b.v").alias("verdict"))
    return split.join(best, ["host", "path"], "left")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), rules AS (
  SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                        ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) t(verdict, host, path)
), best AS (
  SELECT p.page_id, p.host, p.path, s.host || s.path AS rule, s.verdict,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path
                            ORDER BY length(s.host) - length(replace(s.host, '.', '')) DESC NULLS LAST,
                                     length(s.path) DESC NULLS LAST, s.verdict DESC) AS k
  FROM parts p LEFT JOIN rules s
    ON (p.host = s.host OR p.host LIKE '%.' || s.host) AND starts_with(p.path, s.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best WHERE k = 1
"""
