"""Queries on the nation web, whose answers take several hops, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import export, middle, reports, traverse
from .sources.derived import nation_web, web_sql

_START, _END = "NATION_0", "NATION_9"


def queries() -> dict:
    web = nation_web
    return {
        "web_what": lambda s, d: traverse.what(web(s, d), _START).select("node_id", "depth"),
        "web_why": lambda s, d: traverse.why(web(s, d), _END).select("node_id", "depth", "via"),
        "web_explain": lambda s, d: traverse.explain(web(s, d), _END),
        "web_chain": lambda s, d: traverse.chain(web(s, d), _START, _END).drop("confidence"),
        "web_chain_missing": lambda s, d: traverse.path(web(s, d), "NATION_24", _START).select("found", F.size("hops").alias("hops")),
        "web_chain_t": lambda s, d: traverse.temporal_chain(web(s, d), _START, _END).select("found", "ordered", F.inline("links")).select(
            "found", "ordered", "hop", "src", "dst", "gap_min", "gap_max", "index_delta"),
        "web_before": lambda s, d: traverse.before(web(s, d), _START, _END),
        "web_delay": lambda s, d: traverse.delay(web(s, d), _START, _END),
        "web_difference": lambda s, d: traverse.difference(web(s, d), _START, _END).unionByName(traverse.difference(web(s, d), _START, _START)),
        "web_counterfactual": lambda s, d: traverse.counterfactual(web(s, d), "NATION_6").select("node_id", "label", "depth", "unique"),
        "web_cycles": lambda s, d: middle.cycles(web(s, d)).select("cycle_id", F.array_join("path", ",").alias("path"), "cycle_type"),
        "web_cycles_spread": lambda s, d: middle.cycles(web(s, d), local_links=0).select("cycle_id", F.array_join("path", ",").alias("path"), "cycle_type"),
        "web_marked": lambda s, d: middle.open_gaps(middle.mark_cycles(web(s, d))).edges.select("edge_idx", "in_cycle", "gap_nature"),
        "web_spof": lambda s, d: middle.spof(web(s, d)).select("node_id", "score", "total_pairs", "ratio", "is_super"),
        "web_diagnostics": lambda s, d: reports.diagnostics(web(s, d)).select("severity", "kind", "subject"),
        "web_counters": lambda s, d: middle.counters(web(s, d)),
        "web_dot": lambda s, d: export.to_dot(web(s, d)).where("part IN (1, 3)").select("part", "line"),
    }


def _walks(start: int, forward: bool = True) -> str:
    """Shortest walks from a node, by depth and the newest edges taken; ``best`` is the first visitor's."""
    at, to = ("src", "dst") if forward else ("dst", "src")
    return web_sql().replace("WITH base", "WITH RECURSIVE base") + f""",
known AS (SELECT node_id FROM web_nodes),
pairs AS (SELECT src, dst, max(edge_idx) AS newest, min(edge_idx) AS oldest FROM web_edges
  WHERE src IN (SELECT node_id FROM known) AND dst IN (SELECT node_id FROM known) GROUP BY src, dst),
steps AS (SELECT p.{at} AS a, p.{to} AS b, p.newest, e.confidence, e.relation, e.gap_min, e.gap_max, e.negated
  FROM pairs p JOIN web_edges e ON e.edge_idx = p.oldest),
closure AS (SELECT CAST({start} AS BIGINT) AS node, 0 AS depth UNION SELECT b, depth + 1 FROM closure JOIN steps ON a = node WHERE depth < 26),
depths AS (SELECT node, min(depth) AS depth FROM closure GROUP BY node),
walk AS (
  SELECT CAST({start} AS BIGINT) AS node, 0 AS depth, CAST([] AS BIGINT[]) AS rank, CAST(1 AS DOUBLE) AS conf, [CAST({start} AS BIGINT)] AS way
  UNION ALL SELECT b, w.depth + 1, list_append(rank, -newest), least(conf, confidence), list_append(way, b)
  FROM walk w JOIN steps ON a = w.node JOIN depths d ON d.node = b AND d.depth = w.depth + 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY rank) AS k FROM walk) WHERE k = 1)"""


_HOPS = """, hops AS (SELECT unnest(range(1, len(way))) AS hop, way FROM best WHERE node = 9),
  links AS (SELECT hop, s.a AS src, s.b AS dst, s.relation, s.confidence, s.gap_min, s.gap_max, y.temporal_index - x.temporal_index AS index_delta
    FROM hops JOIN steps s ON s.a = way[hop] AND s.b = way[hop + 1] JOIN web_nodes x ON x.node_id = s.a JOIN web_nodes y ON y.node_id = s.b)"""
_STRONG = web_sql().replace("WITH base", "WITH RECURSIVE base") + """,
valid AS (SELECT DISTINCT src, dst FROM web_edges WHERE src IN (SELECT node_id FROM web_nodes) AND dst IN (SELECT node_id FROM web_nodes)),
way AS (SELECT src AS s, dst AS d FROM valid UNION SELECT s, dst FROM way JOIN valid ON src = d),
strong AS (SELECT x.s AS node, min(least(x.s, x.d)) AS comp FROM way x JOIN way y ON x.s = y.d AND x.d = y.s GROUP BY x.s),
numbered AS (SELECT comp, row_number() OVER (ORDER BY comp) - 1 AS cycle_id FROM (SELECT DISTINCT comp FROM strong)),
inner_edges AS (SELECT e.*, a.comp FROM web_edges e JOIN strong a ON e.src = a.node JOIN strong b ON e.dst = b.node WHERE a.comp = b.comp)"""
_CYCLES = _STRONG + """ SELECT cycle_id, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS path, any_value(kind) AS cycle_type
  FROM strong JOIN numbered USING (comp) JOIN (SELECT comp, CASE WHEN bool_or(relation = 'concession') THEN 'oscillation'
    WHEN bool_or(negated OR relation IN ('prevent', 'opposition')) THEN 'feedback_negative' ELSE 'feedback_positive' END AS kind
    FROM inner_edges GROUP BY comp) USING (comp) GROUP BY cycle_id"""


def oracle_sql() -> dict[str, str]:
    w = web_sql()
    return {
        "web_what": _walks(0) + " SELECT node AS node_id, depth FROM best WHERE depth > 0",
        "web_why": _walks(9, False) + " SELECT node AS node_id, depth, way[depth] AS via FROM best WHERE depth > 0",
        "web_explain": _walks(9, False) + """ SELECT label, depth, round(conf, 6) AS confidence, round(conf / (1 + depth), 6) AS score
          FROM best JOIN web_nodes ON node = node_id WHERE depth > 0""",
        "web_chain": _walks(0) + _HOPS + " SELECT hop, src, dst, relation, gap_min, gap_max FROM links",
        "web_chain_missing": "SELECT false AS found, CAST(NULL AS INT) AS hops",
        "web_chain_t": _walks(0) + _HOPS + """ SELECT true AS found, coalesce((SELECT min(index_delta) FROM links) >= 0, false) AS ordered,
          hop, src, dst, gap_min, gap_max, index_delta FROM links""",
        "web_before": _walks(0) + """ SELECT x.temporal_index AS a_index, y.temporal_index AS b_index, (SELECT count(*) FROM best WHERE node = 9) > 0 AS path_exists,
          coalesce(x.temporal_index < y.temporal_index, true) AND (SELECT count(*) FROM best WHERE node = 9) > 0 AS a_before_b
          FROM web_nodes x, web_nodes y WHERE x.node_id = 0 AND y.node_id = 9""",
        "web_delay": _walks(0) + _HOPS + """ SELECT true AS found, count(*) AS hops, CASE WHEN count(*) = count(gap_min) THEN sum(gap_min)::BIGINT END AS gap_min,
          CASE WHEN count(*) = count(gap_max) THEN sum(gap_max)::BIGINT END AS gap_max, sum(index_delta)::BIGINT AS index_delta FROM links""",
        "web_difference": _walks(0) + _HOPS + """ SELECT true AS path_exists, round(min(confidence), 6) AS observed, round(1 - min(confidence), 6) AS gap FROM links
          UNION ALL SELECT true, 0.0, 1.0""",
        "web_counterfactual": _walks(6) + """,
          roots AS (SELECT node_id FROM web_nodes WHERE node_id <> 6 AND node_id NOT IN (SELECT dst FROM pairs)),
          around AS (SELECT node_id AS node FROM roots UNION SELECT dst FROM around JOIN pairs ON src = node WHERE dst <> 6 AND src <> 6),
          joint AS (SELECT arg_min(dst, edge_idx) AS node FROM web_edges WHERE joint_group IN (SELECT joint_group FROM web_edges WHERE src = 6 AND joint_group IS NOT NULL) GROUP BY joint_group),
          mediated AS (SELECT third_node AS node FROM web_edges WHERE relation = 'mediated_cause' AND third_node NOT IN (SELECT src FROM web_edges WHERE src <> 6)
            AND (third_node <> dst OR NOT EXISTS (SELECT 1 FROM web_edges WHERE src <> 6 AND relation <> 'mediated_cause'))),
          stays AS (SELECT node FROM around EXCEPT (SELECT node FROM joint UNION SELECT node FROM mediated))
          SELECT node_id, label, depth, node_id NOT IN (SELECT node FROM stays) AS "unique" FROM best JOIN web_nodes ON node = node_id WHERE depth > 0""",
        "web_cycles": _CYCLES,
        "web_cycles_spread": _CYCLES,
        "web_marked": _STRONG + """ SELECT e.edge_idx, cycle_id AS in_cycle,
          CASE WHEN e.relation IN ('concession', 'opposition') AND e.gap_min IS NULL AND e.gap_max IS NULL THEN 'deferred' END AS gap_nature
          FROM web_edges e LEFT JOIN inner_edges i ON e.edge_idx = i.edge_idx LEFT JOIN numbered n ON n.comp = i.comp""",
        "web_spof": w.replace("WITH base", "WITH RECURSIVE base") + """,
          valid AS (SELECT DISTINCT src, dst FROM web_edges WHERE src IN (SELECT node_id FROM web_nodes) AND dst IN (SELECT node_id FROM web_nodes)),
          cut AS (SELECT node_id AS x FROM web_nodes UNION ALL SELECT -1),
          way AS (SELECT x, src AS s, dst AS d FROM cut, valid WHERE src <> x AND dst <> x UNION SELECT x, s, dst FROM way JOIN valid ON src = d WHERE dst <> x),
          n AS (SELECT x, count(*) AS c FROM way WHERE s <> d GROUP BY x), total AS (SELECT c FROM n WHERE x = -1)
          SELECT node_id, total.c - coalesce(n.c, 0) AS score, total.c AS total_pairs, round((total.c - coalesce(n.c, 0)) / total.c, 6) AS ratio,
            node_id IN (SELECT src FROM web_edges WHERE joint_group IS NOT NULL) AS is_super
          FROM web_nodes LEFT JOIN n ON n.x = node_id, total""",
        "web_diagnostics": w + """, e AS (SELECT *, src || '->' || dst AS pair, row_number() OVER (PARTITION BY src, dst ORDER BY edge_idx) AS k FROM web_edges)
          SELECT 'error' AS severity, 'dangling_edge' AS kind, pair AS subject FROM e WHERE dst NOT IN (SELECT node_id FROM web_nodes)
          UNION ALL SELECT 'error', 'self_loop', pair FROM e WHERE src = dst
          UNION ALL SELECT 'warning', 'orphaned_node', CAST(node_id AS VARCHAR) FROM web_nodes WHERE node_id NOT IN (SELECT src FROM e UNION SELECT dst FROM e)
          UNION ALL SELECT 'warning', 'low_confidence_edge', pair FROM e WHERE confidence < 0.3
          UNION ALL SELECT 'warning', 'dangling_condition', CAST(node_id AS VARCHAR) FROM web_nodes WHERE node_type = 'condition' AND node_id NOT IN (SELECT src FROM e)
          UNION ALL SELECT 'error', 'empty_label', CAST(node_id AS VARCHAR) FROM web_nodes WHERE trim(label) = ''
          UNION ALL SELECT 'warning', 'duplicate_edge', pair FROM e WHERE k > 1
          UNION ALL SELECT 'warning', 'missing_provenance', pair FROM e WHERE provenance IS NULL
          UNION ALL SELECT 'warning', 'temporal_order_violation', pair FROM e JOIN web_nodes x ON x.node_id = src JOIN web_nodes y ON y.node_id = dst
            WHERE relation = 'sequence' AND x.temporal_index > y.temporal_index""",
        "web_counters": w + """ SELECT (SELECT count(*) FROM web_nodes) AS node_count, (SELECT count(*) FROM web_edges) AS edge_count, true AS has_cycles,
          (SELECT count(*) FROM web_edges WHERE gap_min IS NOT NULL OR gap_max IS NOT NULL) > 0 AS has_gaps""",
        "web_dot": w + """, t AS (SELECT 1 AS part, '  n' || node_id || ' [label="' || label || '", shape=' || CASE node_type WHEN 'condition' THEN 'diamond' WHEN 'etat_global' THEN 'ellipse' ELSE 'box' END
            || ', tooltip="' || CASE node_type WHEN 'etat_local' THEN 'EtatLocal' WHEN 'etat_global' THEN 'EtatGlobal' WHEN 'condition' THEN 'Condition' ELSE 'Processus' END || '"];' AS line FROM web_nodes
          UNION ALL SELECT 3, '  n' || src || ' -> n' || dst || ' [label="' || CASE relation WHEN 'joint_cause' THEN 'JointCause' WHEN 'mediated_cause' THEN 'MediatedCause' ELSE upper(relation[1]) || relation[2:] END
            || ' (' || printf('%.2f', confidence) || ')" color="' || CASE relation WHEN 'cause' THEN '#2ecc71' WHEN 'enable' THEN '#3498db' WHEN 'prevent' THEN '#e74c3c' WHEN 'concession' THEN '#9b59b6'
            WHEN 'sequence' THEN '#1abc9c' ELSE '#95a5a6' END || '" style="' || CASE WHEN negated THEN 'dashed' ELSE 'solid' END || '"];' FROM web_edges)
          SELECT part, line FROM t""",
    }
