"""Queries of tokens, text front end, annotators and forward passes, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import tokens
from .operators import annotate, frontend, learned, middle
from .sources import corpora
from .sources.derived import nation_web, table, web_sql

#: Small lexicons of words that the documents have; real ones are the caller's.
_LEXICON = [("verb", "is", "cause", ""), ("marker", "for the", "condition", "backward"), ("marker", "by", "cause", "backward"), ("marker", "with", "enable", "forward")]
_CONNECTORS = [("en", "that", "cause", "backward", 1.0), ("en", "by", "enable", "forward", 0.9), ("fr", "pour", "motivation", "forward", 0.8)]
_WEIGHTS = {"cause": [[0.5, 0.1], [0.0, 0.2]], "enable": [[0.1, 0.0], [0.3, 0.4]]}
_OWN = [[0.2, 0.0], [0.1, 0.3]]
_LINK = [[0.4, -0.2], [0.1, 0.3]]


def _vectors(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("node_id"), F.array(F.col("n_nationkey") / 10.0, F.col("n_regionkey") / 5.0).alias("vector"))
    return n


def queries() -> dict:
    docs = lambda s, d: table(s, d, "documents")
    edges = lambda s, d: nation_web(s, d).valid_edges()
    packed = lambda cut: lambda s, d: docs(s, d).select("doc_id", F.size(t := cut(F.col("text"))).alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))
    size = lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return {
        "tokens_english": packed(tokens.english),
        "tokens_french": packed(tokens.french),
        "clauses": lambda s, d: frontend.clauses(docs(s, d).where("lang = 'en'"), _LEXICON, "en"),
        "text_graph": lambda s, d: frontend.graph_of(frontend.clauses(docs(s, d).where("lang = 'en'"), _LEXICON, "en"), "en").edges.groupBy("relation", "confidence").count(),
        "silver": lambda s, d: annotate.silver(docs(s, d).select("doc_id", "lang", F.substring_index("text", ".", 1).alias("text")), _CONNECTORS, {}).select("doc_id", "silver.*"),
        "by_connector": lambda s, d: annotate.by_connector(docs(s, d).select("doc_id", "text"), [(" the ", "cause", "forward"), (" de ", "cause", "backward")]).select(
            "doc_id", F.md5("found.source").alias("source"), F.md5("found.target").alias("target"), "found.relation"),
        "uniform_spans": lambda s, d: size(s, d).select("l_orderkey", F.array_join(F.transform(corpora.uniform_spans(F.col("n") * 3, F.col("n") % 4 + 1), lambda x: F.concat_ws("-", x["s"], x["e"])), ",").alias("spans")),
        "near_pairs": lambda s, d: learned.near_pairs(edges(s, d), 3),
        "predicted_links": lambda s, d: learned.predict_links(_vectors(s, d), edges(s, d).select("src", "dst").distinct(), _LINK, 0.1, 0.6),
        "convolved": lambda s, d: learned.convolve(_vectors(s, d), edges(s, d), _OWN, _WEIGHTS, "none").select("node_id", F.round(F.get("vector", F.lit(0)), 6).alias("x"), F.round(F.get("vector", F.lit(1)), 6).alias("y")),
        "negatives": lambda s, d: learned.negatives(edges(s, d).select("src", "dst"), 25),
        "back_edges": lambda s, d: middle.back_edge_cycles(nation_web(s, d)).select(F.array_join("path", ",").alias("path")),
    }


_VALID = web_sql() + ", v AS (SELECT * FROM web_edges WHERE src IN (SELECT node_id FROM web_nodes) AND dst IN (SELECT node_id FROM web_nodes))"
_VECTORS = ", n AS (SELECT n_nationkey::BIGINT AS id, n_nationkey / 10.0::DOUBLE AS a, n_regionkey / 5.0::DOUBLE AS b FROM nation)"
_CONTENT = "len(regexp_extract_all(lower({0}), '[\\p{{L}}]{{3,}}'))"


def _arm(k: int, language: str, connector: str) -> str:
    """A connector's two sides in a sentence."""
    pattern = rf"(?is)^((?:.*?[^\p{{L}}\p{{N}}_])??)({connector})((?:[^\p{{L}}\p{{N}}_].*)?)$"
    trim = lambda g: rf"regexp_replace(regexp_replace(regexp_extract(t, '{pattern}', {g}), '^[ ,;:]+', ''), '[ ,;:]+$', '')"
    return f"SELECT doc_id, {k} AS k, lang = '{language}' AND regexp_matches(t, '{pattern}') AS hit, {trim(1)} AS b, {trim(3)} AS a FROM s"


def oracle_sql() -> dict[str, str]:
    arms = " UNION ALL ".join(_arm(k, c[0], c[1]) for k, c in enumerate(_CONNECTORS))
    message = lambda i, w: f"CASE relation WHEN 'cause' THEN {_WEIGHTS['cause'][i][0]} * a + {_WEIGHTS['cause'][i][1]} * b ELSE {_WEIGHTS['enable'][i][0]} * a + {_WEIGHTS['enable'][i][1]} * b END"
    return {
        "tokens_english": r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS raw, generate_subscripts(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), 1) AS k FROM documents),
          p AS (SELECT doc_id, k, regexp_replace(raw, '[.,;:!?]+$', '') AS core, regexp_extract(raw, '[.,;:!?]+$') AS tail FROM w)
          SELECT doc_id, sum((core <> '')::INT + (tail <> '')::INT)::INT AS n, md5(string_agg(CASE WHEN core <> '' AND tail <> '' THEN core || ' ' || tail ELSE core || tail END, ' ' ORDER BY k)) AS digest FROM p GROUP BY doc_id""",
        "silver": rf"""WITH s AS (SELECT doc_id, lang, trim(split_part(text, '.', 1)) AS t FROM documents), x AS ({arms}),
          y AS (SELECT doc_id, k, hit, b = '' AND contains(a, ',') AS led, CASE WHEN b = '' AND contains(a, ',') THEN regexp_replace(split_part(a, ',', 1), '^[ ,;:]+|[ ,;:]+$', '', 'g') ELSE b END AS one,
            CASE WHEN b = '' AND contains(a, ',') THEN regexp_replace(substr(a, instr(a, ',') + 1), '^[ ,;:]+|[ ,;:]+$', '', 'g') ELSE a END AS two FROM x),
          z AS (SELECT *, {_CONTENT.format('one')} AS n1, {_CONTENT.format('two')} AS n2 FROM y),
          best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r FROM z WHERE hit AND n1 >= 1 AND n2 >= 1 AND n1 + n2 >= 4) WHERE r = 1)
          SELECT s.doc_id, CASE WHEN led OR k > 0 THEN one ELSE two END AS source, CASE WHEN led OR k > 0 THEN two ELSE one END AS target, ['cause', 'enable', 'motivation'][k + 1] AS relation,
            [1.0, 0.9, 0.8][k + 1]::DOUBLE AS confidence, ['that', 'by', 'pour'][k + 1] AS connector FROM s LEFT JOIN best ON s.doc_id = best.doc_id""",
        "by_connector": r"""WITH t AS (SELECT doc_id, text, instr(lower(text), ' the ') AS p, instr(lower(text), ' de ') AS q, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) >= 6 AS long FROM documents),
          u AS (SELECT doc_id, long, CASE WHEN p > 0 THEN trim(substr(text, 1, p - 1)) WHEN q > 0 THEN trim(substr(text, q + 4)) END AS s, CASE WHEN p > 0 THEN trim(substr(text, p + 5)) WHEN q > 0 THEN trim(substr(text, 1, q - 1)) END AS d FROM t)
          SELECT doc_id, CASE WHEN ok THEN md5(s) END AS source, CASE WHEN ok THEN md5(d) END AS target, CASE WHEN ok THEN 'cause' END AS relation FROM (SELECT *, coalesce(long AND s <> '' AND d <> '', false) AS ok FROM u)""",
        "uniform_spans": """WITH c AS (SELECT l_orderkey, count(*) * 3 AS t, count(*) % 4 + 1 AS n FROM lineitem GROUP BY 1), d AS (SELECT *, greatest(t // n, 1) AS z FROM c)
          SELECT l_orderkey, string_agg((k - 1) * z + 1 || '-' || CASE WHEN k = n THEN greatest(t, (k - 1) * z + 1) ELSE k * z END, ',' ORDER BY k) AS spans FROM d, range(1, 5) r(k) WHERE k <= n GROUP BY l_orderkey""",
        "near_pairs": _VALID.replace("WITH base", "WITH RECURSIVE base") + """, e AS (SELECT DISTINCT src, dst FROM v WHERE src <> dst),
          w AS (SELECT src, dst, 1 AS n FROM e UNION SELECT w.src, e.dst, n + 1 FROM w JOIN e ON e.src = w.dst WHERE n < 3 AND e.dst <> w.src)
          SELECT DISTINCT src, dst FROM w EXCEPT SELECT src, dst FROM e""",
        "predicted_links": _VALID + _VECTORS + f""", s AS (SELECT DISTINCT src, dst, x.a * ({_LINK[0][0]} * y.a + {_LINK[0][1]} * y.b) + x.b * ({_LINK[1][0]} * y.a + {_LINK[1][1]} * y.b) + 0.1 AS z
            FROM v JOIN n x ON x.id = src JOIN n y ON y.id = dst) SELECT src, dst, round(1 / (1 + exp(-z)), 6) AS score FROM s WHERE round(1 / (1 + exp(-z)), 6) >= 0.6""",
        "convolved": _VALID + _VECTORS + f""", m AS (SELECT dst, relation, avg({message(0, 0)}) AS x, avg({message(1, 0)}) AS y FROM v JOIN n ON id = src WHERE relation IN ('cause', 'enable') GROUP BY dst, relation),
          g AS (SELECT dst, sum(x) AS x, sum(y) AS y FROM m GROUP BY dst)
          SELECT id AS node_id, round({_OWN[0][0]} * a + {_OWN[0][1]} * b + coalesce(g.x, 0), 6) AS x, round({_OWN[1][0]} * a + {_OWN[1][1]} * b + coalesce(g.y, 0), 6) AS y FROM n LEFT JOIN g ON dst = id""",
    }


#: A cascade over tokens, a seeded draw and a depth-first walk are not expressible in SQL; tested against plain Python.
WITHOUT_SQL = {"tokens_french", "clauses", "text_graph", "negatives", "back_edges"}
