"""Text to graphs, and forward passes, against plain Python."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from causeloom.functions import tokens
from causeloom.operators import frontend, learned

FR = [("verb", "entraîne", "cause", ""), ("verb", "provoque", "cause", ""), ("marker", "parce que", "cause", "backward"), ("marker", "si", "condition", "forward"),
      ("marker", "bien que", "concession", "backward"), ("marker", "pour", "motivation", "forward"), ("marker", "quand", "sequence", "backward")]
EN = [("verb", "causes", "cause", ""), ("marker", "because", "cause", "backward"), ("marker", "even though", "concession", "backward"), ("marker", "if", "condition", "forward")]


def test_tokens(spark):
    rows = [("L'eau « coule », n'est-ce pas ? Oui. Qu'il", ["L'", "eau", "coule", ",", "n'", "est-ce", "pas", "Oui", ".", "Qu'", "il"]), ("", []), (None, []), ("...", [])]
    for text, want in rows:
        got = spark.createDataFrame([(text,)], "t string").select(tokens.french(F.col("t")).alias("x")).head().x
        assert [w for w in got if w not in ("»", "«")] == want, (text, got)
    got = spark.createDataFrame([("It rains, so we stay?! Yes.",)], "t string").select(tokens.english(F.col("t")).alias("x")).head().x
    assert got == ["It", "rains", ",", "so", "we", "stay", "?!", "Yes", "."]
    cut = spark.range(1).select(tokens.sentences(F.array(*[F.lit(w) for w in ["a", "b", ".", ".", "c"]])).alias("s")).head().s
    assert cut == [["a", "b"], ["c"]]


def edges_of(spark, text, lexicon, language, **more):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    g = frontend.graph_of(frontend.clauses(docs, lexicon, language, **more), language)
    names = {r.node_id: r.label for r in g.nodes.collect()}
    times = {r.label: r.temporal_index for r in g.nodes.collect()}
    return [(names[r.src], r.relation, names[r.dst], r.confidence, r.negated) for r in g.edges.orderBy("edge_idx").collect()], times


def test_clauses_and_graphs(spark):
    found, times = edges_of(spark, "Le marché a souffert parce que la demande a chuté.", FR, "fr")
    assert found == [("la demande a chuté", "cause", "Le marché a souffert", 1.0, False)] and times["la demande a chuté"] < times["Le marché a souffert"]
    found, _ = edges_of(spark, "Si les ventes baissent, on réduit les coûts.", FR, "fr")
    assert found == [("les ventes baissent", "condition", "on réduit les coûts", 1.0, False)]
    found, _ = edges_of(spark, "La pluie ne provoque pas la crue. On attend.", FR, "fr", particles=["ne"], completers=["pas"])
    assert found == [("La pluie ne", "cause", "pas la crue", 1.0, True), ("pas la crue", "cause", "On attend", 0.5, False)]
    found, _ = edges_of(spark, "Il a échoué bien que la loi aide.", FR, "fr")
    assert ("la loi aide", "concession", "Il a échoué", 1.0, False) in found and ("cause_cachée(?)", "cause", "Il a échoué", 0.3, False) in found
    found, _ = edges_of(spark, "Rain causes floods because dams break. A. B. C.", EN, "en")
    assert found[0] == ("dams break", "cause", "Rain causes floods", 1.0, False) and sum(e[3] == 0.5 for e in found) == 1
    assert edges_of(spark, "Si il pleut", FR, "fr")[0] == []
    docs = spark.createDataFrame([(1, None), (2, " . "), (3, "Il court."), (None, "Il court.")], "doc_id long, text string")
    found = frontend.clauses(docs, FR, "fr")
    assert {(r.id, r.status) for r in frontend.status(docs, found).collect()} == {(1, "empty"), (2, "nothing"), (3, "parsed"), (None, "parsed")}


def test_forward_passes(spark):
    draw = np.random.default_rng(2)
    n, d, o = 6, 3, 2
    h, own = draw.normal(size=(n, d)), draw.normal(size=(o, d))
    w = {r: draw.normal(size=(o, d)) for r in "ab"}
    att = {r: draw.normal(size=2 * o) for r in "ab"}
    edges = [(k, int(draw.integers(n)), int(draw.integers(n)), "ab"[k % 2]) for k in range(12)]
    nodes = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(h)], "node_id long, vector array<double>")
    table = spark.createDataFrame(edges, "edge_idx long, src long, dst long, relation string")
    lists = lambda m: {r: x.tolist() for r, x in m.items()}
    want, heads = h @ own.T, h @ own.T
    for r in "ab":
        for t in range(n):
            mine = [(s, h[s] @ w[r].T) for _, s, x, k in edges if k == r and x == t]
            if mine:
                want[t] = want[t] + np.mean([m for _, m in mine], axis=0)
                e = np.array([np.concatenate([m, h[t] @ w[r].T]) @ att[r] for _, m in mine])
                e = np.where(e >= 0, e, 0.2 * e)
                a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
                heads[t] = heads[t] + (a[:, None] * np.array([m for _, m in mine])).sum(axis=0)
    got = {r.node_id: r.vector for r in learned.convolve(nodes, table, own.tolist(), lists(w)).collect()}
    assert np.allclose([got[k] for k in range(n)], 1 / (1 + np.exp(-want)))
    got = {r.node_id: r.vector for r in learned.attend(nodes, table, own.tolist(), lists(w), lists(att)).collect()}
    assert np.allclose([got[k] for k in range(n)], heads)
    layers = [(draw.normal(size=(4, d)).tolist(), draw.normal(size=4).tolist()), (draw.normal(size=(2, 4)).tolist(), draw.normal(size=2).tolist())]
    mlp = {r.node_id: r.v for r in nodes.select("node_id", learned.perceptron(F.col("vector"), layers).alias("v")).collect()}
    hidden = np.maximum(h @ np.array(layers[0][0]).T + layers[0][1], 0)
    assert np.allclose([mlp[k] for k in range(n)], hidden @ np.array(layers[1][0]).T + layers[1][1])
    norm = nodes.select("node_id", learned.layer_norm(F.col("vector"), [1.0] * d, [0.0] * d).alias("v")).orderBy("node_id").collect()
    assert np.allclose([r.v for r in norm], (h - h.mean(1, keepdims=True)) / np.sqrt(h.var(1, keepdims=True) + 1e-5))


def test_links_and_negatives(spark):
    draw = random.Random(4)
    pairs = sorted({(draw.randrange(8), draw.randrange(8)) for _ in range(12)})
    edges = spark.createDataFrame(pairs, "src long, dst long")
    for ratio in (0.5, 1.0, 50.0):
        got = [(r.src, r.dst) for r in learned.negatives(edges, 8, ratio).collect()]
        free = {(a, b) for a in range(8) for b in range(8) if a != b} - set(pairs)
        assert len(got) == len(set(got)) == min(int(len(pairs) * ratio), len(free)) and set(got) <= free
        assert got == [(r.src, r.dst) for r in learned.negatives(edges, 8, ratio).collect()]
    reach = {(a, c) for a, b in pairs for x, c in pairs if b == x and a != b and x != c and a != c} - set(pairs)
    assert {(r.src, r.dst) for r in learned.near_pairs(edges, 2).collect()} == reach
    nodes = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(8)], "node_id long, vector array<double>")
    weights = [[0.1, -0.2], [0.3, 0.05]]
    found = learned.predict_links(nodes, edges, weights, 0.1, 0.0).collect()
    for r in found:
        u, v = np.array([r.src, 1.0]), np.array([r.dst, 1.0])
        assert math.isclose(r.score, 1 / (1 + math.exp(-(u @ np.array(weights) @ v + 0.1))), abs_tol=1e-6)
    assert len(found) == len(pairs)


def test_discourse_and_lookups(spark):
    rows = [(1, 0, 10, ["il"], ["PRON"], ["nsubj"]), (1, 1, 11, ["donc", "x"], ["ADV", "X"], ["", ""]), (1, 2, 12, ["et"], ["CCONJ"], [""]), (1, 3, 13, ["il"], ["PRON"], ["nsubj"]), (1, 4, 14, ["x"], ["X"], [""]), (2, 0, 20, [], [], [])]
    table = spark.createDataFrame(rows, "doc long, sentence int, pivot long, lemmas array<string>, pos array<string>, dep array<string>")
    got = [tuple(r) for r in learned.discourse(table, [("donc", "cause", 0.8, True)]).orderBy("sentence").collect()]
    assert got == [(1, 1, 11, 10, "cause", 0.8), (1, 2, 11, 12, "cause", 0.5), (1, 3, 12, 13, "cause", 0.5), (1, 4, 13, 14, "cause", 0.35)]
    words = spark.createDataFrame([("a",), ("b",)], "word string")
    known = spark.createDataFrame([("a", [1.0, 2.0])], "word string, vector array<double>")
    assert {r.word: r.vector for r in learned.embed(words, known, [0.0, 0.0]).collect()} == {"a": [1.0, 2.0], "b": [0.0, 0.0]}
    assert spark.range(1).select(learned.membership(F.lit("A"), [["a", "b"], [], ["c"]]).alias("m")).head().m == [1.0, 0.0, 0.0]
