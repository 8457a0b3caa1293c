"""Corpora, their checks, and the command line."""

import json

from pyspark.sql import functions as F

from causeloom import cli
from causeloom.sources import corpora

SENTENCES = [
    {"id": "s1", "text": "a b c", "lang": "fr", "tokens": [{"id": 1, "form": "a"}, {"id": 2, "form": "b"}, {"id": 3, "form": "c"}],
     "cir": {"nodes": [{"id": "n1", "node_type": "action", "label": "a", "token_span": [1, 1]}, {"id": "n2", "node_type": "etat", "label": "b", "token_span": [2, 3]}],
             "edges": [{"source": "n1", "target": "n2", "relation": "cause"}, {"sources": ["n1", "n2"], "target": "n2", "relation": "enable"}, {"source": "n1", "target": "n2"}]}},
    {"id": "s2", "text": "x", "cir": {"nodes": [{"id": "n1", "node_type": "entite", "label": "x", "token_span": [3, 1]}, {"id": "n2", "label": "y", "token_span": [3, 1]}],
                                      "edges": [{"source": "n9", "target": "n2", "relation": "magic"}]}},
]


def test_annotated_corpora(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"schema_version": "2.0", "document": {"sentences": SENTENCES[:1]}}))
    (tmp_path / "b.json").write_text(json.dumps({"sentences": SENTENCES[1:]}))
    s = corpora.read_annotated(spark, str(tmp_path))
    assert {(r.id, r.place, r.schema_version) for r in s.collect()} == {("s1", 0, "2.0"), ("s2", 0, None)}
    assert {(r.id, r.node, r.node_type) for r in corpora.nodes_of(s).collect()} == {("s1", "n1", "processus"), ("s1", "n2", "etat_local"), ("s2", "n1", "entite"), ("s2", "n2", None)}
    assert sorted((r.src, r.dst, r.relation) for r in corpora.samples(s).collect()) == [(0, 1, "cause"), (0, 1, "enable"), (1, 1, "enable")]
    found = {r.id: r.errors for r in corpora.problems(s, ["cause", "enable"]).collect()}
    assert found["s2"] == ["span of n1", "span of n2", "two nodes of one span", "source n9", "relation magic"]
    assert found["s1"] == ["source ?", "relation ?"]
    row = corpora.validity(corpora.problems(s, ["cause"])).head()
    assert (row.total, row.valid, row.invalid, row.valid_pct) == (2, 0, 2, 0.0)
    report = corpora.span_report(s.where("id = 's1'")).head()
    assert (report.sentences, report.nodes, report.mean_length, report.covering) == (1, 2, 1.5, 0)
    back = json.loads(corpora.as_document(s.where("id = 's1'")).head().json)
    assert back["schema_version"] == "2.0" and back["sentences"][0]["id"] == "s1"


def test_a_graph_as_a_corpus(spark):
    labels = spark.createDataFrame([(1, "rain falls", "processus"), (2, "floods", "etat_local")], "node_id long, label string, node_type string")
    edges = spark.createDataFrame([(0, 1, 2, "cause", 0.9)], "edge_idx long, src long, dst long, relation string, confidence double")
    made = corpora.bootstrap(labels, edges)
    row = made.head()
    assert row.text == "rain falls cause floods" and [t.form for t in row.tokens] == row.text.split() and [n.token_span for n in row.cir.nodes] == [[1, 2], [4, 4]]
    assert corpora.problems(made, ["cause"]).head().errors == []


def test_spans_and_texts(spark, tmp_path):
    def spans(t, n):
        return [tuple(x) for x in spark.range(1).select(corpora.uniform_spans(F.lit(t), F.lit(n)).alias("s")).head().s]

    assert spans(7, 3) == [(1, 2), (3, 4), (5, 7)] and spans(2, 2) == [(1, 1), (2, 2)] and spans(5, 0) == []
    (tmp_path / "a.txt").write_text("a line of some length\nshort\n")
    (tmp_path / "b.bin").write_text("another line of some length\n")
    assert [r.line for r in corpora.read_texts(spark, str(tmp_path)).collect()] == ["a line of some length"]


def test_command_line(spark, tmp_path, capsys):
    lexicon = tmp_path / "lexicon.json"
    lexicon.write_text(json.dumps([["marker", "parce que", "cause", "backward"]]))
    assert cli.main(["analyze", "--text", "Il tombe parce que tu pousses.", "--lexicon", str(lexicon)], spark) == 0
    graph = tmp_path / "graph.json"
    graph.write_text(capsys.readouterr().out)
    assert cli.main(["query", "WHY il tombe?", "--graph", str(graph)], spark) == 0
    said = capsys.readouterr()
    assert json.loads(said.out)["depth"] == 1 and said.err.count("warning") <= 1
    assert cli.main(["export", "--graph", str(graph), "--to", "dot"], spark) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[0] == "digraph CausalGraph {" and lines[-1] == "}" and sum("->" in x for x in lines) == 1
    assert cli.main(["query", "WHY nobody", "--graph", str(graph)], spark) == 1
    assert cli.main(["query", "NONSENSE", "--graph", str(graph)], spark) == 1
    assert cli.main(["analyze", "--text", " ", "--lexicon", str(lexicon)], spark) == 2
