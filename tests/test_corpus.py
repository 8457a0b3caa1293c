"""Curation, data-set, evaluation, session and knowledge operators against plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from causeloom import queries, queries_corpus, queries_text
from causeloom.functions import emission
from causeloom.operators import curation, datasets, evaluation, session
from causeloom.plans.graph import Graph
from causeloom.plans.numbering import numbered


def test_entry_has_sql_for_every_core_query():
    assert set(queries.queries()) - set(queries.oracle_sql()) == queries_corpus.WITHOUT_SQL | queries_text.WITHOUT_SQL


def test_numbers_follow_the_order(spark):
    rows = spark.range(1000).selectExpr("id", "id * 7919 % 1009 AS k", "IF(id % 9 = 0, NULL, id % 3) AS p")
    got = numbered(rows, ["k"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1000)) and [r.k for r in got] == sorted(r.k for r in got)
    for p, some in ((p, [r for r in numbered(rows, ["k"], "n", ["p"]).collect() if r.p == p]) for p in (None, 0, 1, 2)):
        assert sorted(r.n for r in some) == list(range(len(some))), p


def test_sentences_and_quality(spark):
    text = "M. Dupont est venu ici hier soir, vraiment. Il a parlé longtemps\nde la pluie ! Ok. Dr. No said: the quick brown fox jumps over it again?"
    row = spark.createDataFrame([(text,)], "t string").select(curation.sentences(F.col("t")).alias("s")).head()
    assert row.s == ["M. Dupont est venu ici hier soir, vraiment.", "Il a parlé longtemps de la pluie !", "Dr. No said: the quick brown fox jumps over it again?"]

    def quality(text):
        n, words = len(text), text.split()
        if not 30 <= n <= 600:
            return 0.0
        if len(words) < 5:
            return 0.2
        if not 3 <= n / len(words) <= 15:
            return 0.4
        if re.search(r"(.{10,})\1{2,}", text):
            return 0.3
        return round(min(1.0, n / 150) if n <= 300 else max(0.5, 1.0 - (n - 300) / 300), 2)

    texts = ["", "short", "x" * 700, "abc def ghi jkl mno pqr stu vwx", "onelongwordwithoutanyblanks and so", "a b c d e f g h i j k l m n o p q r s t", "hello there " * 5, "word and other things " * 16]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", curation.quality(F.col("t")).alias("q")).collect()
    assert {r.t: r.q for r in got} == {t: quality(t) for t in texts}


def test_duplicates_remember_as_many_as_they_should(spark):
    draw = random.Random(3)
    base = [" ".join(draw.choices("abcdefghij", k=9)) for _ in range(40)]
    texts = [draw.choice(base) + draw.choice(["", " z", " Z ", " y z"]) for _ in range(150)] + ["a b", "A b ", None]
    seen, memory, want = set(), [], []
    for t in texts:
        key = (t or "").strip().lower()
        if key in seen:
            want.append("exact")
            continue
        seen.add(key)
        w, kind = key.split(), None
        if len(w) >= 4:
            s = {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
            kind = "near" if any(len(s & o) / len(s | o) > 0.7 for o in memory[-20:]) else None
            memory.append(s)
        want.append(kind)
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.kind for r in curation.duplicates(rows, ["id"], "t", memory=20).collect()}
    assert [got[k] for k in range(len(texts))] == want and "near" in want


def test_budgets():
    assert curation.budgets(["fr", "en"], 10_000, {"fr": 2.0}) == {"fr": 6000, "en": 3000, "code": 1000}
    assert curation.budgets([], 1000, code=["py", "rs"]) == {"code_py": 500, "code_rs": 500}
    assert curation.budgets(["fr"], 1000, code_share=None) == {"fr": 1000}


def test_registry_appends_only_new_urls(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a"), (2, "http://b"), (3, "http://a"), (4, None)], "page_id long, url string")
    folder = f"{tmp_path}/registry"
    assert curation.register(spark, folder, pages, "first") == 2
    assert curation.register(spark, folder, pages.union(spark.createDataFrame([(5, "http://c")], pages.schema)), "second") == 1
    assert Counter(r.campaign for r in spark.read.parquet(folder).collect()) == {"first": 2, "second": 1}


def test_bleu_temperature_and_pairs(spark):
    pairs = [("the cat sat on the mat", "the cat sat on a mat"), ("a b", "a b"), ("", "x"), ("a", "b"), ("a a a", "a")]

    def bleu(h, r):
        h, r = h.split(), r.split()
        if not h or not r:
            return 0.0
        p = []
        for n in range(1, min(4, len(h)) + 1):
            a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (h, r))
            p.append(sum(min(c, b[g]) for g, c in a.items()) / sum(a.values()))
        return 0.0 if min(p) == 0 else round((1 if len(h) >= len(r) else math.exp(1 - len(r) / len(h))) * math.exp(sum(map(math.log, p)) / len(p)), 4)

    got = spark.createDataFrame(pairs, "h string, r string").select("h", "r", evaluation.bleu(F.col("h"), F.col("r")).alias("b")).collect()
    assert [(r.h, r.b) for r in got] == [(h, bleu(h, r)) for h, r in pairs]
    draw = random.Random(1)
    logits = [([draw.gauss(0, 3) for _ in range(3)], draw.randrange(3)) for _ in range(60)]

    def ece(t):
        rows = []
        for x, y in logits:
            e = [math.exp((v - max(x)) / t) for v in x]
            rows.append((max(e) / sum(e), e.index(max(e)) == y))
        bins = {}
        for c, ok in rows:
            bins.setdefault(int(c * 10), []).append((c, ok))
        return sum(len(b) / len(rows) * abs(sum(c for c, _ in b) / len(b) - sum(ok for _, ok in b) / len(b)) for k, b in bins.items() if k < 10)

    want = min((round(ece(0.1 + k * 0.1), 9), round(0.1 + k * 0.1, 6)) for k in range(50))
    best = evaluation.best_temperature(spark.createDataFrame(logits, "logits array<double>, label int")).head()
    assert (best.temperature, best.ece) == pytest.approx((want[1], want[0]), abs=1e-6)
    one, two = (spark.createDataFrame([(k, "x") for k in range(n)], "id int, label string") for n in (3, 2))
    assert evaluation.paired(one, one, "id").count() == 3
    with pytest.raises(evaluation.LengthMismatch):
        evaluation.paired(one, two, "id")


def test_empty_tables_and_nulls(spark):
    docs = spark.createDataFrame([(1, None, None), (None, "a b c", "en")], "doc_id long, text string, lang string")
    assert curation.split_sentences(docs).count() == 0 and datasets.leaked(docs, docs).count() == 1
    assert datasets.split(docs.limit(0), "doc_id", "lang").count() == 0 and datasets.merge([docs, docs], "doc_id", "text").count() == 2
    assert curation.duplicates(docs.limit(0), ["doc_id"], "text").count() == 0


def test_session_grows_and_is_read_again(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "Sales fall", "processus", None, 0), (2, "costs", "entite", None, 1)], "node_id long, label string, node_type string, parent long, temporal_index int")
    edges = spark.createDataFrame([(0, 1, 2, "cause", 0.8, None, None, "t1")], "edge_idx long, src long, dst long, relation string, confidence double, gap_min long, gap_max long, provenance string")
    later = nodes.where("node_id = 2").withColumn("label", F.lit("high costs"))
    grown = session.add(Graph(nodes, edges), later, edges)
    session.save(grown, str(tmp_path))
    back = session.load(spark, str(tmp_path))
    assert sorted(r.label for r in back.nodes.collect()) == ["Sales fall", "high costs"] and sorted(r.edge_idx for r in back.edges.collect()) == [0, 1]
    assert session.explain(back, "costs").count() == 2 and session.find_path(back, "sales", "costs").count() == 2
    assert session.find_path(back, "costs", "sales").count() == 0
    assert session.zoom_in(back, "costs").count() == 0 and session.spof(back).count() == 2


def test_emission_rules(spark):
    tokens = F.array(F.struct(F.lit("mark").alias("dep_rel"), F.lit("SCONJ").alias("pos")), F.struct(F.lit("obl").alias("dep_rel"), F.lit("NOUN").alias("pos")))
    row = spark.range(1).select(
        emission.subordinate(tokens).alias("sub"), emission.third_role(F.lit("mediated_cause"), tokens).alias("med"),
        emission.third_role(F.lit("cause"), tokens).alias("none"), emission.node_id(F.lit("n0007")).alias("a"), emission.node_id(F.lit(" 12 ")).alias("b"),
        emission.node_id(F.lit("x")).alias("c"), emission.node_type(F.lit("etat")).alias("t"), emission.softmax(F.array(F.lit(0.0), F.lit(0.0))).alias("s"),
        emission.passive(F.lit("Pass")).alias("p"),
    ).head()
    assert tuple(row) == (True, "mediator", None, "n007", "n012", "x", "etat_local", [0.5, 0.5], True)


def test_evaluation_as_a_whole(spark):
    labels = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "gold string, predicted string")
    graphs = spark.createDataFrame([(["x"], ["x"], ["r"], ["r"]), (["x"], ["y"], [], [])], "pred_nodes array<string>, gold_nodes array<string>, pred_edges array<string>, gold_edges array<string>")
    metrics = evaluation.evaluate(labels, graphs)
    values = {r.metric: r.value for r in metrics.collect()}
    assert values["accuracy"] == pytest.approx(2 / 3, abs=1e-6) and values["graph_exact_match"] == 0.5
    passed = {r.metric: r.passed for r in evaluation.gate(metrics, {"accuracy": 0.6, "macro_f1": 0.99, "other": 0.1}).collect()}
    assert passed == {"accuracy": True, "macro_f1": False, "other": False}
    curve = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7), (4, float("nan")), (5, 0.1)], "epoch int, score double")
    assert tuple(evaluation.summary(curve).head()) == (5, 2, 0.7, 0.1)


def test_abbreviations_in_a_row_are_cut_as_in_sql(spark, tmp_path):
    text = "The committee met again and they all said no. No. Everybody had to leave the old building at once. See al. St. John for the rest."
    spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    duck = pytest.importorskip("duckdb").connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries_corpus.queries()["sentences"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == duck.execute(queries_corpus.oracle_sql()["sentences"]).fetchall()
    row = spark.createDataFrame([(text,)], "t string").select(curation.sentences(F.col("t")).alias("s")).head()
    assert row.s[0].startswith("The committee") and row.s[0].endswith("at once.")  # the operator keeps both abbreviations
