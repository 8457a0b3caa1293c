"""Registered queries of the graph, curation and evaluation operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import queries_corpus, queries_graph, queries_session, queries_text
from .operators import curation, evaluation, reports, traverse
from .sources import derived
from .sources.derived import table


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("quality").alias("gold"), F.col("toxic").alias("predicted"))


def queries() -> dict:
    flow, land, chain = derived.event_flow, derived.geography, derived.supply
    return {
        **queries_graph.queries(),
        **queries_session.queries(),
        **queries_corpus.queries(),
        **queries_text.queries(),
        "centrality": lambda s, d: reports.centrality(flow(s, d)),
        "density": lambda s, d: reports.density(flow(s, d)),
        "coverage": lambda s, d: reports.coverage(flow(s, d)),
        "reliability": lambda s, d: reports.reliability(flow(s, d)),
        "gaps": lambda s, d: reports.gaps(flow(s, d)),
        "analogy": lambda s, d: reports.analogy(flow(s, d), "view", "purchase"),
        "diagnostics": lambda s, d: reports.diagnostics(flow(s, d)).select("severity", "kind", "subject"),
        "zoom_in": lambda s, d: reports.zoom_in(land(s, d), "europe"),
        "zoom_out": lambda s, d: reports.zoom_out(land(s, d)),
        "aggregate": lambda s, d: reports.aggregate(land(s, d)),
        "what": lambda s, d: traverse.what(chain(s, d), "S1").select("node_id", "depth"),
        "why": lambda s, d: traverse.why(chain(s, d), "C1").select("node_id", "depth"),
        "explain": lambda s, d: traverse.explain(flow(s, d), "purchase"),
        "intervene": lambda s, d: traverse.intervene(flow(s, d), "purchase"),
        "chain": lambda s, d: traverse.chain(flow(s, d), "view", "purchase"),
        "delay": lambda s, d: traverse.delay(flow(s, d), "view", "purchase"),
        "difference": lambda s, d: traverse.difference(flow(s, d), "view", "purchase"),
        "strip_html": lambda s, d: table(s, d, "pages").select("page_id", F.md5(curation.strip_html(F.col("html"))).alias("text_md5")),
        "first_of_equal": lambda s, d: curation.first_of_equal(table(s, d, "documents")),
        "new_urls": lambda s, d: curation.new_urls(table(s, d, "pages")),
        "histogram": lambda s, d: curation.histogram(table(s, d, "documents"), "lang"),
        "accuracy": lambda s, d: evaluation.accuracy(_scored(s, d)),
        "confusion": lambda s, d: evaluation.confusion(_scored(s, d)),
        "per_class": lambda s, d: evaluation.per_class(_scored(s, d)),
        "macro_f1": lambda s, d: evaluation.macro_f1(evaluation.per_class(_scored(s, d))),
    }


_FLOW = """
WITH step AS (
  SELECT event_type, lead(event_type) OVER w AS nxt, ts, lead(ts) OVER w AS thn FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), pair AS (
  SELECT event_type AS src, nxt AS dst, count(*) AS n, min(epoch_ms(thn) // 1000 - epoch_ms(ts) // 1000) AS gap_min,
         max(epoch_ms(thn) // 1000 - epoch_ms(ts) // 1000) AS gap_max
  FROM step WHERE nxt IS NOT NULL GROUP BY 1, 2
), edges AS (
  SELECT src, dst, CASE WHEN src = dst THEN 'sequence' ELSE 'cause' END AS relation, gap_min, gap_max,
         round(n / sum(n) OVER (PARTITION BY src), 6) AS confidence, CASE WHEN n % 2 = 0 THEN 'events' END AS provenance
  FROM pair
), nodes AS (SELECT DISTINCT event_type AS label FROM events
), inc AS (
  SELECT src AS label, confidence, provenance FROM edges UNION ALL
  SELECT dst, confidence, provenance FROM edges WHERE src <> dst
)
"""
_LAND = """
WITH flow AS (
  SELECT s_nationkey AS s, c_nationkey AS c, sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(38,4))) AS v
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  GROUP BY 1, 2
), edges AS (SELECT s, c, round(CAST(v AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY s) AS DOUBLE), 6) AS confidence FROM flow)
"""
_SCORED = "(SELECT quality AS gold, toxic AS predicted FROM labels)"
_CLASSES = f"""
SELECT c AS class, round(coalesce(hit / nullif(said, 0), 0), 4) AS "precision", round(coalesce(hit / nullif(support, 0), 0), 4) AS recall,
       round(coalesce(2 * hit / nullif(support + said, 0), 0), 4) AS f1, support::BIGINT AS support
FROM (SELECT c, sum(g) AS support, sum(p) AS said, sum(t) AS hit FROM (
  SELECT gold AS c, 1 AS g, 0 AS p, (gold = predicted)::INT AS t FROM {_SCORED} UNION ALL
  SELECT predicted, 0, 1, 0 FROM {_SCORED}) GROUP BY c)
"""


def oracle_sql() -> dict[str, str]:
    direct = "FROM edges WHERE src = 'view' AND dst = 'purchase'"
    return {
        **queries_graph.oracle_sql(),
        **queries_session.oracle_sql(),
        **queries_corpus.oracle_sql(),
        **queries_text.oracle_sql(),
        "centrality": _FLOW + """, s AS (
          SELECT label, coalesce((SELECT count(*) FROM edges WHERE dst = label), 0) AS degree_in,
                 coalesce((SELECT count(*) FROM edges WHERE src = label), 0) AS degree_out,
                 coalesce((SELECT sum(confidence) FROM edges WHERE dst = label), 0) AS wi,
                 coalesce((SELECT sum(confidence) FROM edges WHERE src = label), 0) AS wo FROM nodes)
          SELECT label, degree_in, degree_out, round(wi, 6) AS weighted_in, round(wo, 6) AS weighted_out,
                 round(CASE WHEN degree_in + degree_out > 0 THEN (wi + wo) / (degree_in + degree_out) ELSE 0 END, 6) AS score FROM s""",
        "density": _FLOW + """, c AS (SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges)
          SELECT label, n_nodes, n_edges, round(n_edges / (n_nodes * (n_nodes - 1)), 6) AS density,
                 (SELECT count(*) FROM inc i WHERE i.label = nodes.label) AS degree,
                 round((SELECT count(*) FROM inc i WHERE i.label = nodes.label) / (2 * (n_nodes - 1)), 6) AS local_density
          FROM nodes, c""",
        "coverage": _FLOW + """SELECT label, count(*) AS degree, round(count(*) / (SELECT count(*) FROM edges), 6) AS coverage,
          round(count(provenance) / count(*), 6) AS provenance_ratio FROM inc GROUP BY label""",
        "reliability": _FLOW + """SELECT label, min(confidence) AS min_confidence, round(avg(confidence), 6) AS mean_confidence,
          round(count(provenance) / count(*), 6) AS provenance_ratio,
          round(avg(confidence) * count(provenance) / count(*), 6) AS reliability FROM inc GROUP BY label""",
        "gaps": _FLOW + "SELECT src AS from_label, dst AS to_label, relation, gap_min, gap_max FROM edges",
        "analogy": _FLOW + """, g AS (
            SELECT e.*, count(*) OVER (PARTITION BY src) AS d_out, count(*) OVER (PARTITION BY dst) AS d_in FROM edges e),
          p AS (SELECT * FROM g WHERE src = 'view' AND dst = 'purchase'),
          s AS (SELECT g.src, g.dst, g.relation, round(0.4 * CASE WHEN g.relation = p.relation THEN 1 ELSE 0 END + 0.3
              + 0.2 * (1 - least(1.0, abs(g.confidence - p.confidence)))
              + 0.1 / (1 + abs(g.d_out - p.d_out) + abs(g.d_in - p.d_in)), 6) AS score
            FROM g, p WHERE NOT (g.src = p.src AND g.dst = p.dst))
          SELECT src AS from_label, dst AS to_label, relation, score FROM s WHERE score >= 0.3""",
        "diagnostics": _FLOW + """SELECT 'error' AS severity, 'self_loop' AS kind, src || '->' || dst AS subject FROM edges WHERE src = dst
          UNION ALL SELECT 'warning', 'low_confidence_edge', src || '->' || dst FROM edges WHERE confidence < 0.3
          UNION ALL SELECT 'warning', 'missing_provenance', src || '->' || dst FROM edges WHERE provenance IS NULL""",
        "zoom_in": """SELECT 'N' || n_nationkey AS node_id, n_name AS label, 'entity' AS node_type FROM nation
          JOIN region ON n_regionkey = r_regionkey WHERE lower(r_name) = 'europe'""",
        "zoom_out": """SELECT 'N' || n_nationkey AS node_id, n_name AS label, r_name AS parent_label FROM nation
          JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'R' || r_regionkey, r_name, NULL FROM region""",
        "aggregate": _LAND + """, lv AS (
            SELECT a.n_regionkey AS r, confidence FROM edges JOIN nation a ON s = a.n_nationkey JOIN nation b ON c = b.n_nationkey
            WHERE a.n_regionkey <> b.n_regionkey)
          SELECT 'R' || n_regionkey AS parent, count(*) AS children, (SELECT count(*) FROM lv WHERE r = n_regionkey) AS edges_out,
                 round(coalesce((SELECT avg(confidence) FROM lv WHERE r = n_regionkey), 0), 6) AS mean_confidence
          FROM nation GROUP BY n_regionkey""",
        "what": """WITH p AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey = 1)
          SELECT 'P' || l_partkey AS node_id, 1 AS depth FROM p UNION ALL
          SELECT DISTINCT 'C' || o_custkey, 2 FROM lineitem JOIN p USING (l_partkey) JOIN orders ON l_orderkey = o_orderkey""",
        "why": """WITH p AS (SELECT DISTINCT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 1)
          SELECT 'P' || l_partkey AS node_id, 1 AS depth FROM p UNION ALL
          SELECT DISTINCT 'S' || l_suppkey, 2 FROM lineitem JOIN p USING (l_partkey)""",
        "explain": _FLOW + """SELECT src AS label, 1 AS depth, round(confidence, 6) AS confidence, round(confidence / 2, 6) AS score
          FROM edges WHERE dst = 'purchase' AND src <> 'purchase'""",
        "intervene": _FLOW + """SELECT 'severed' AS part, src AS label FROM edges WHERE dst = 'purchase'
          UNION ALL SELECT 'effect', dst FROM edges WHERE src = 'purchase' AND dst <> 'purchase'""",
        "chain": _FLOW + f"SELECT 1 AS hop, src, dst, relation, confidence, gap_min, gap_max {direct}",
        "delay": _FLOW + f"""SELECT count(*) > 0 AS found, count(*) AS hops, sum(gap_min)::BIGINT AS gap_min, sum(gap_max)::BIGINT AS gap_max, (SELECT y.i - x.i FROM
          (SELECT row_number() OVER (ORDER BY label) AS i, label FROM nodes) x, (SELECT row_number() OVER (ORDER BY label) AS i, label FROM nodes) y
          WHERE x.label = 'view' AND y.label = 'purchase')::BIGINT AS index_delta {direct}""",
        "difference": _FLOW + f"SELECT count(*) > 0 AS path_exists, round(coalesce(min(confidence), 0), 6) AS observed, round(1 - coalesce(min(confidence), 0), 6) AS gap {direct}",
        "strip_html": r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages""",
        "first_of_equal": """SELECT md5(lower(trim(coalesce(text, '')))) AS key, min(doc_id) AS id, count(*) AS n FROM documents GROUP BY 1""",
        "new_urls": "SELECT sha256(url) AS url_hash, min(page_id) AS page_id FROM pages WHERE url IS NOT NULL GROUP BY 1",
        "histogram": """SELECT lang AS value, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM documents), 4) AS percent
          FROM documents GROUP BY lang""",
        "accuracy": f"SELECT count(*) AS n, round(avg((gold = predicted)::INT), 6) AS accuracy FROM {_SCORED}",
        "confusion": f"SELECT gold, predicted, count(*) AS n FROM {_SCORED} GROUP BY 1, 2",
        "per_class": _CLASSES,
        "macro_f1": f"SELECT round(avg(f1), 6) AS macro_f1 FROM ({_CLASSES}) WHERE support > 0",
    }
