"""Graph, language, curation and evaluation operators."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from causeloom.functions.labels import match_score, normalize_label, pascal_case
from causeloom.operators import evaluation, export, middle, reports, traverse
from causeloom.plans import language
from causeloom.plans.graph import Graph, NodeNotFound, NoPath, TooLarge

NODES = "node_id long, label string, node_type string, parent long, temporal_index int"
EDGES = "edge_idx long, src long, dst long, relation string, confidence double, gap_min long, gap_max long, provenance string"


def graph(spark, n, pairs, confidence=lambda k: 0.5):
    nodes = [(i, f"node {i}", "processus", None, i) for i in range(n)]
    edges = [(k, a, b, "cause", confidence(k), None, None, None) for k, (a, b) in enumerate(pairs)]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))


def test_normal_form_of_labels(spark):
    rows = [("  Réseau  ", "reseau"), ("cache/miss", "cachemiss"), ("Été-Hiver", "ete-hiver"), ("Œuf_2", "oeuf_2"), ("", "")]
    got = spark.createDataFrame(rows, "a string, b string").select(normalize_label(F.col("a")), "b").collect()
    assert all(x == y for x, y in got)
    row = spark.range(1).select(
        match_score(F.lit("Auth"), F.lit("auth")), match_score(F.lit("Authx"), F.lit("auth")), match_score(F.lit("xauth"), F.lit("auth")),
        match_score(F.lit("x"), F.lit("auth")), pascal_case(F.lit("data_dep")),
    ).head()
    assert tuple(row) == (0, 1, 2, None, "DataDep")


@pytest.mark.parametrize("seed", range(3))
def test_breadth_first_order_on_random_multigraphs(spark, seed):
    draw = random.Random(seed)
    n = 7
    pairs = [(draw.randrange(n), draw.randrange(n)) for _ in range(12)] + [(0, 99)]
    g = graph(spark, n, pairs)
    newest = {}
    for k, (a, b) in enumerate(pairs):
        if b < n:
            newest[a, b] = k
    want, queue = {0: (0, None)}, deque([0])
    while queue:
        at = queue.popleft()
        for k, b in sorted(((k, b) for (a, b), k in newest.items() if a == at), reverse=True):
            if b not in want:
                want[b] = (want[at][0] + 1, at)
                queue.append(b)
    del want[0]
    assert {r.node_id: (r.depth, r.via) for r in traverse.what(g, "node 0").collect()} == want


def test_paths(spark):
    g = graph(spark, 4, [(0, 1), (1, 2)], lambda k: 0.9 - k / 10)
    assert [(r.src, r.dst) for r in traverse.chain(g, "node 0", "node 2").collect()] == [(0, 1), (1, 2)]
    assert tuple(traverse.difference(g, "node 0", "node 2").head()) == (True, 0.8, 0.2)
    assert tuple(traverse.difference(g, "node 0", "node 3").head()) == (False, 0.0, 1.0)
    assert tuple(traverse.difference(g, "node 0", "node 0").head()) == (True, 0.0, 1.0)
    assert traverse.delay(g, "node 0", "node 0").head().gap_min == 0 and traverse.delay(g, "node 0", "node 3").head().gap_min is None
    with pytest.raises(NoPath):
        traverse.chain(g, "node 0", "node 3", strict=True)
    with pytest.raises(NodeNotFound):
        traverse.why(g, "absent")


def test_diagnostics(spark):
    g = graph(spark, 3, [(0, 0), (0, 1), (0, 1), (0, 9)], lambda k: 0.2 if k == 1 else 0.5)
    got = {(r.kind, r.subject) for r in reports.diagnostics(g).where("kind <> 'missing_provenance'").collect()}
    one = graph(spark, 1, [])
    assert reports.diagnostics(one).collect() == [] and middle.spof(one).head().score == 0
    assert got == {("dangling_edge", "0->9"), ("self_loop", "0->0"), ("orphaned_node", "2"), ("low_confidence_edge", "0->1"), ("duplicate_edge", "0->1")}


def test_language(spark):
    assert language.parse(" why the cause? ") == language.Query("WHY", ("the cause",))
    assert language.parse("chain a -> b, c") == language.Query("CHAIN", ("a", "b, c"))
    assert language.parse("BEFORE? a, b") == language.Query("BEFORE?", ("a", "b"))
    assert language.parse("DENSITY") == language.Query("DENSITY")
    assert language.parse("gaps?") == language.Query("GAPS")
    for bad in ("", "WHY", "CHAIN a", "CHAIN -> b", "NOPE x"):
        with pytest.raises(language.QueryParseError):
            language.parse(bad)
    g = graph(spark, 3, [(0, 1), (1, 2)])
    assert {r.node_id for r in language.run(g, "WHAT node 0?").collect()} == {1, 2}
    assert language.run(g, "CENTRALITY node 1").head().degree_in == 1
    assert language.run(g, "COUNTERFACTUAL node 1").head().unique and language.run(g, "SPOF").head().node_id == 1
    assert language.run(g, "CYCLES").collect() == [] and language.run(g, "CHAIN node 2 -> node 0").head().found is False
    assert language.run(g, "BEFORE? node 0, node 2").head().a_before_b and language.run(g, "CHAIN_T node 0 -> node 2").head().found


def test_strong_components_both_ways(spark):
    for seed in range(2):
        draw = random.Random(seed)
        pairs = [(draw.randrange(9), draw.randrange(9)) for _ in range(14)]
        g = graph(spark, 9, pairs)
        reach = {(a, b) for a, b in pairs}
        for k in range(9):
            reach |= {(a, b) for a in range(9) for b in range(9) if (a, k) in reach and (k, b) in reach}
        want = {a: min(b for b in range(9) if (a, b) in reach and (b, a) in reach) for a in range(9) if (a, a) in reach}
        for links in (100, 0):
            assert {r.node: r.component for r in middle.strong_components(g, links).collect()} == want


def test_deep_chains_are_walked_to_their_end(spark):
    g = graph(spark, 12, [(k, k + 1) for k in range(11)])
    assert {r.node_id: r.depth for r in traverse.what(g, "node 0").collect()} == {k: k for k in range(1, 12)}


def test_documents_round_trip(spark, tmp_path):
    g = graph(spark, 3, [(0, 1), (1, 2)])
    path = tmp_path / "graph.json"
    path.write_text(export.as_document(g).head().json)
    back = export.load(spark, str(path))
    assert back.nodes.select("node_id", "label").collect() == g.nodes.select("node_id", "label").collect()
    assert [(r.src, r.dst) for r in back.edges.orderBy("edge_idx").collect()] == [(0, 1), (1, 2)]
    with pytest.raises(TooLarge):
        export.load(spark, str(path), most=10)


def test_evaluation(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "gold int, predicted int")
    assert evaluation.accuracy(rows).head().accuracy == 0.5
    f1 = {r["class"]: r.f1 for r in evaluation.per_class(rows).collect()}
    assert f1 == {0: 0.6667, 1: 0.5, 2: 0.0}
    assert evaluation.macro_f1(evaluation.per_class(rows)).head().macro_f1 == pytest.approx(0.3889)


def test_back_edges(spark):
    g = graph(spark, 5, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 1), (3, 3), (4, 0)])
    assert [r.path for r in middle.back_edge_cycles(g).collect()] == [[0, 1, 2], [1, 2, 3], [3]]
    with pytest.raises(TooLarge):
        middle.back_edge_cycles(g, 3)


def test_class_reports_round_as_printf(spark):
    values = [0.0005, 0.0015, 0.0045, 0.0055, 0.0625, 0.1875, 0.4625, 0.5625, 0.9995, 0.0004, 0.0, 1.0]
    rows = [(k, v, v, 1 - v, k) for k, v in enumerate(values)] + [(None, 0.5, 0.5, 0.5, 1)]
    classes = spark.createDataFrame(rows, "class int, precision double, recall double, f1 double, support long")
    got = {r["class"]: r.line for r in evaluation.report(classes).collect()}
    assert got == {None: None} | {k: "%-16s %.3f  %.3f  %.3f  %d" % (c, p, r, f, n) for k, (c, p, r, f, n) in enumerate(rows[:-1])}
    rows = spark.createDataFrame([(1, 1)] * 57 + [(0, 1)] * 743 + [(None, 2)], "gold int, predicted int")
    got = {r["class"]: (r.precision, r.recall, r.f1) for r in evaluation.per_class(rows).collect()}
    assert got[1][:2] == (0.0712, 1.0) and got[2] == (0.0, 0.0, 0.0)  # 57 / 800 is below 0.07125
