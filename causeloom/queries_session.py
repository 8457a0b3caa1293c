"""Queries of session commands and of the emission rules, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import emission
from .operators import session
from .sources.derived import nation_web, table, web_sql

_WORD, _FROM, _TO = "nation_4", "nation_0", "nation_9"


def _pairs(spark, sf_dir) -> DataFrame:
    """Orders as rows to which the emission rules apply, their fields taken from the columns."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    relation = F.element_at(F.array(*[F.lit(x) for x in _RELATIONS]), (F.col("o_custkey") % len(_RELATIONS) + 1).cast("int"))
    site = F.element_at(F.array(F.lit("dst"), F.lit("condition"), F.lit("src"), F.lit(None)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    mood = F.element_at(F.array(F.lit("Ind"), F.lit("Sub"), F.lit("Cnd"), F.lit("Imp")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    link = F.element_at(F.array(F.lit("explicite"), F.lit("verb"), F.lit("parataxis"), F.lit("aucun"), F.lit("x")), (F.col("o_custkey") % 5 + 1).cast("int"))
    return o.select("o_orderkey", "o_custkey", relation.alias("relation"), site.alias("site"), mood.alias("mood"), link.alias("connector"), (F.col("o_orderstatus") == "F").alias("negated"))


_RELATIONS = ["cause", "sequence", "joint_cause", "conditional_cause", "mediated_cause", "prevent", "filter", "analogy", "unheard"]


def _emitted(spark, sf_dir) -> DataFrame:
    p = _pairs(spark, sf_dir)
    relation, third, source = emission.negate(F.col("relation"), F.col("site"), F.col("negated"))
    prior = emission.confidence(F.col("relation"), F.col("mood"), F.col("connector"), F.when(F.col("o_orderkey") % 3 == 0, 0.1).otherwise(0.0))
    turn = emission.swapped(F.col("relation"), F.col("o_orderkey") % 7, F.col("o_orderkey") % 5, F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 3 == 0)
    src, dst = emission.turned(turn, F.col("o_orderkey"), F.col("o_custkey"))
    return p.select(
        "o_orderkey", relation.alias("relation"), third.alias("third_polarity"), source.alias("source_polarity"), F.round(prior, 6).alias("confidence"),
        src.alias("src"), dst.alias("dst"), emission.coarse(F.col("relation"), emission.COARSE_RELATIONS).alias("coarse"),
        emission.node_id(F.col("o_custkey")).alias("node"), emission.joint_group(emission.node_id(F.col("o_custkey")), F.array(F.lit("n002"), F.lit("n001"))).alias("grp"),
    )


def _uncertain(spark, sf_dir) -> DataFrame:
    p = _pairs(spark, sf_dir)
    p1 = 0.4 + F.col("o_orderkey") % 50 / 100
    return p.select(F.col("o_orderkey").alias("edge_idx"), (F.col("o_custkey") % 40).alias("src"), (F.col("o_orderkey") % 37).alias("dst"), F.col("relation").alias("first"),
                    F.when(F.col("o_orderkey") % 2 == 0, "enable").otherwise("cause").alias("second"), p1.alias("p1"), ((1 - p1) / 2).alias("p2"))


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector"))
    return e.where("node_id % 50 = 0").select(F.col("node_id").alias("id"), "vector"), e.where("node_id % 50 <> 0")


def queries() -> dict:
    web = nation_web
    return {
        "session_causes": lambda s, d: session.find_causes(web(s, d), "nation", 3).select("edge_idx", "level"),
        "session_explain": lambda s, d: session.explain(web(s, d), _WORD).select("line"),
        "session_effects": lambda s, d: session.effects(web(s, d), _WORD).select("line"),
        "session_counterfactual": lambda s, d: session.counterfactual(web(s, d), _WORD),
        "session_path": lambda s, d: session.find_path(web(s, d), _FROM, _TO),
        "session_temporal_path": lambda s, d: session.temporal_path(web(s, d), _FROM, _TO),
        "session_delay": lambda s, d: session.estimate_delay(web(s, d), _FROM, _TO),
        "session_abduct": lambda s, d: session.abduct(web(s, d), "nation_9"),
        "session_summary": lambda s, d: session.summarize(web(s, d)),
        "session_verbalize": lambda s, d: session.verbalize(web(s, d)).select("edge_idx", "line"),
        "session_convergent": lambda s, d: session.convergent(web(s, d), "nation_9"),
        "session_blocked": lambda s, d: session.blocked(web(s, d), "nation"),
        "session_contradictions": lambda s, d: session.contradictions(web(s, d)),
        "session_sources": lambda s, d: session.sources(web(s, d)),
        "session_truncated": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(session.truncated(F.col("text"))).alias("head")),
        "session_route": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", session.route(F.col("text")).alias("command")),
        "session_resolve": lambda s, d: session.resolve(*_vectors(s, d)),
        "emission": _emitted,
        "ambiguities": lambda s, d: emission.resolve_ambiguities(_uncertain(s, d)),
        "temporal_ranks": lambda s, d: emission.temporal_ranks(table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber"),
    }


_NAMED = web_sql() + """,
n AS (SELECT e.*, coalesce(a.label, CAST(e.src AS VARCHAR)) AS sl, coalesce(a.node_type, '?') AS st, coalesce(b.label, CAST(e.dst AS VARCHAR)) AS dl, coalesce(b.node_type, '?') AS dt,
  CASE WHEN negated THEN ' [negated]' ELSE '' END AS neg FROM web_edges e LEFT JOIN web_nodes a ON e.src = a.node_id LEFT JOIN web_nodes b ON e.dst = b.node_id)"""
_IDS = web_sql().replace("WITH base", "WITH RECURSIVE base") + """,
steps AS (SELECT DISTINCT src, dst FROM web_edges),
w AS (SELECT 0 AS depth, CAST([0] AS BIGINT[]) AS way UNION ALL SELECT depth + 1, list_append(way, dst) FROM w JOIN steps ON src = way[-1]
  WHERE depth < 6 AND NOT list_contains(way, dst) AND way[-1] <> 9),
p AS (SELECT way FROM w WHERE way[-1] = 9 ORDER BY depth, way LIMIT 1),
first AS (SELECT e.* FROM web_edges e JOIN (SELECT src, dst, min(edge_idx) AS edge_idx FROM web_edges GROUP BY 1, 2) f ON e.edge_idx = f.edge_idx),
hops AS (SELECT k, way[k] AS src, way[k + 1] AS dst FROM p, range(1, 20) r(k) WHERE k < len(way)),
links AS (SELECT h.*, f.gap_min, f.gap_max, y.temporal_index - x.temporal_index AS d FROM hops h JOIN first f ON f.src = h.src AND f.dst = h.dst
  JOIN web_nodes x ON x.node_id = h.src JOIN web_nodes y ON y.node_id = h.dst)"""
_ORDERS = f"""
WITH p AS (SELECT o_orderkey AS k, o_custkey AS c, {_RELATIONS!r}[CAST(o_custkey % {len(_RELATIONS)} AS INT) + 1] AS r, ['dst', 'condition', 'src', NULL][CAST(o_orderkey % 4 AS INT) + 1] AS site,
  [1.0, 0.85, 0.8, 1.0][CAST(o_orderkey % 4 AS INT) + 1] AS mood, [1.0, 0.9, 0.6, 0.5, 0.5][CAST(o_custkey % 5 AS INT) + 1] AS link, o_orderstatus = 'F' AS negated FROM orders)"""


def oracle_sql() -> dict[str, str]:
    return {
        "session_causes": _NAMED + " SELECT edge_idx, 3 AS level FROM n WHERE dl LIKE 'NATION%'",
        "session_explain": _NAMED + " SELECT sl || '  --[' || relation || ']' || neg || '-->  ' || dl || '  conf=' || printf('%.2f', confidence) AS line FROM n WHERE dl = 'NATION_4'",
        "session_effects": _NAMED + " SELECT '--> [' || relation || ']' || neg || '  ' || dl || '  [' || dt || ']' AS line FROM n WHERE sl = 'NATION_4'",
        "session_counterfactual": _NAMED + """ SELECT 'blocked downstream' AS part, relation, dl AS label, dt AS node_type FROM n WHERE sl = 'NATION_4'
          UNION ALL SELECT 'interrupted upstream', relation, sl, st FROM n WHERE dl = 'NATION_4'""",
        "session_path": _IDS + " SELECT CAST(k - 1 AS INT) AS place, way[k] AS node_id FROM p, range(1, 20) r(k) WHERE k <= len(way)",
        "session_temporal_path": _IDS + " SELECT true AS found, count(*) AS hops, bool_and(coalesce(d >= 0, true)) AS ordered FROM links",
        "session_delay": _IDS + """ SELECT true AS found, coalesce(sum((gap_min + gap_max) // 2), 0)::BIGINT AS gap_sum,
          CASE WHEN count(*) = count(d) THEN sum(d)::BIGINT END AS index_delta FROM links""",
        "session_abduct": web_sql().replace("WITH base", "WITH RECURSIVE base") + """,
          last AS (SELECT e.* FROM web_edges e JOIN (SELECT src, dst, max(edge_idx) AS i FROM web_edges GROUP BY 1, 2) f ON e.edge_idx = f.i
            WHERE e.dst IN (SELECT node_id FROM web_nodes)),
          seen AS (SELECT CAST(9 AS BIGINT) AS node, 0 AS depth UNION SELECT src, depth + 1 FROM seen JOIN last ON dst = node WHERE depth < 26),
          depths AS (SELECT node, min(depth) AS depth FROM seen GROUP BY node),
          walk AS (SELECT CAST(9 AS BIGINT) AS node, 0 AS depth, CAST([] AS BIGINT[]) AS rank, CAST(1 AS DOUBLE) AS conf
            UNION ALL SELECT src, w.depth + 1, list_append(rank, src), least(conf, confidence) FROM walk w JOIN last ON dst = w.node JOIN depths d ON d.node = src AND d.depth = w.depth + 1),
          best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY rank) AS k FROM walk) WHERE k = 1 AND depth > 0)
          SELECT label, depth, round(conf, 6) AS confidence, round(conf / (1 + depth), 6) AS score FROM best JOIN web_nodes ON node = node_id""",
        "session_summary": web_sql() + """ SELECT 'nodes' AS what, '' AS name, count(*) AS n FROM web_nodes UNION ALL SELECT 'edges', '', count(*) FROM web_edges
          UNION ALL SELECT 'relation', relation, count(*) FROM web_edges GROUP BY relation
          UNION ALL SELECT 'top cause', label, n FROM (SELECT src, count(*) AS n, min(edge_idx) AS f FROM web_edges GROUP BY src ORDER BY n DESC, f LIMIT 1) JOIN web_nodes ON src = node_id""",
        "session_verbalize": _NAMED + """ SELECT edge_idx, '[' || st || '] ' || sl || '  --[' || relation || neg || ']-->  [' || dt || '] ' || dl || '  (' || CAST(round(confidence * 100) AS INT) || '%)' AS line FROM n""",
        "session_convergent": _NAMED + """, g AS (SELECT src, dst, relation, count(*) AS n, round(min(confidence), 6) AS least, round(max(confidence), 6) AS most FROM n
            WHERE dl = 'NATION_9' GROUP BY 1, 2, 3)
          SELECT src, dst, relation, n, least, most FROM g ORDER BY n * most DESC, most DESC, src, dst, relation LIMIT 5""",
        "session_blocked": _NAMED + " SELECT edge_idx, sl AS src_label, relation, dl AS dst_label FROM n WHERE lower(dl) LIKE '%nation%' AND (relation IN ('prevent', 'filter') OR negated)",
        "session_contradictions": web_sql() + """ SELECT src, dst, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations FROM web_edges GROUP BY src, dst
          HAVING bool_or(relation IN ('prevent', 'filter')) AND bool_or(relation IN ('cause', 'enable', 'motivation', 'sequence'))""",
        "session_sources": web_sql() + " SELECT count(*) AS relations, count(DISTINCT provenance) AS sources FROM web_edges",
        "session_truncated": """WITH c AS (SELECT doc_id, trim(translate(coalesce(text, ''), chr(10) || chr(13), '  ')) AS t FROM documents), h AS (SELECT *, substr(t, 1, 200) AS head FROM c)
          SELECT doc_id, md5(CASE WHEN length(t) <= 200 THEN t WHEN regexp_replace(head, ' [^ ]*$', '') = '' THEN head ELSE regexp_replace(head, ' [^ ]*$', '') END) AS head FROM h""",
        "session_route": r"""WITH w AS (SELECT conv_id, turn, text, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: length(x) > 2) AS words FROM conversations)
          SELECT conv_id, turn, CASE WHEN regexp_matches(text, '^[a-z_]+:') THEN text WHEN len(words) > 0 THEN 'explain: ' || words[-1] END AS command FROM w""",
        "session_resolve": """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), s AS (
            SELECT q.id, v.id AS node_id, round(list_cosine_similarity(q.v, v.v), 6) AS similarity, list_cosine_similarity(q.v, v.v) AS s FROM v q JOIN v ON q.id % 50 = 0 AND v.id % 50 <> 0)
          SELECT id, node_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, node_id) AS k FROM s) WHERE k = 1 AND similarity > 0.3""",
        "emission": _ORDERS + f""", g AS (SELECT *, CASE WHEN r IN ('cause', 'sequence', 'analogy') THEN 0.5 WHEN r IN ('mediated_cause', 'joint_cause') THEN 0.65 ELSE 0.75 END AS rung,
            CASE WHEN r = 'sequence' THEN k % 7 > k % 5 ELSE k % 3 = 0 AND k % 2 <> 0 END AS turn, 'n' || CASE WHEN c < 1000 THEN printf('%03d', c) ELSE CAST(c AS VARCHAR) END AS node FROM p)
          SELECT k AS o_orderkey, CASE WHEN negated AND site = 'dst' THEN CASE r WHEN 'cause' THEN 'prevent' WHEN 'conditional_cause' THEN 'conditional_prevent'
              WHEN 'mediated_cause' THEN 'mediated_prevent' WHEN 'joint_cause' THEN 'joint_prevent' ELSE r END WHEN negated AND site = 'src' AND r = 'cause' THEN 'counterfactual' ELSE r END AS relation,
            CASE WHEN negated AND site = 'condition' THEN 'negative' END AS third_polarity, CASE WHEN negated AND site = 'src' AND r = 'joint_cause' THEN 'negative' END AS source_polarity,
            round(least(1.0, rung::DOUBLE * mood::DOUBLE * link::DOUBLE + CASE WHEN k % 3 = 0 THEN 0.1 ELSE 0 END), 6) AS confidence,
            CASE WHEN turn THEN c ELSE k END AS src, CASE WHEN turn THEN k ELSE c END AS dst,
            CASE WHEN r IN ('cause', 'conditional_cause', 'mediated_cause', 'joint_cause') THEN 'causale' WHEN r = 'filter' THEN 'restrictive' WHEN r = 'prevent' THEN 'negative'
              WHEN r = 'sequence' THEN 'sequentielle' ELSE r END AS coarse, node, substr(sha256(node || '|n001,n002'), 1, 16) AS grp FROM g""",
        "ambiguities": _ORDERS + """, e AS (SELECT k AS edge_idx, c % 40 AS src, k % 37 AS dst, r AS first, CASE WHEN k % 2 = 0 THEN 'enable' ELSE 'cause' END AS second,
            0.4 + k % 50 / 100.0::DOUBLE AS p1 FROM p),
          known AS (SELECT src AS node, first FROM e WHERE p1 >= 0.65 UNION SELECT dst, first FROM e WHERE p1 >= 0.65), x AS (SELECT *, (1 - p1) / 2 AS p2, p1 < 0.65
              AND EXISTS (SELECT 1 FROM known WHERE node IN (e.src, e.dst) AND known.first = e.second) AND NOT EXISTS (SELECT 1 FROM known WHERE node IN (e.src, e.dst) AND known.first = e.first) AS changed FROM e)
          SELECT edge_idx, src, dst, CASE WHEN changed THEN second ELSE first END AS relation, round(CASE WHEN changed THEN p2 / (p1 + p2) ELSE p1 END, 6) AS confidence, changed FROM x""",
        "temporal_ranks": "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INT) AS temporal_rank FROM lineitem",
    }
