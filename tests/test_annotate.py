"""Silver annotations, their normal form and measure, functions out of code."""

from pyspark.sql import functions as F

from causeloom.operators import annotate

CONNECTORS = [("fr", "en raison de", "cause", "backward", 0.9), ("fr", "donc", "cause", "forward", 1.0), ("en", "because", "cause", "backward", 1.0), ("en", "then", "sequence", "forward", 0.8)]
STOP = {"fr": ["les", "une", "des"], "en": ["the", "and"]}


def test_silver(spark):
    texts = [(1, "fr", "Les ventes baissent donc les usines ferment."), (2, "fr", "En raison de la forte pluie, les routes restent fermées."), (3, "fr", "Oui donc non"),
             (4, "en", "Then the big door closed because strong wind blew."), (5, "en", None), (6, "en", "becauseway of the strong wind blowing here"), (7, "de", "Regen because Wind weht stark heute")]
    got = {r.id: r.silver for r in annotate.silver(spark.createDataFrame(texts, "id int, lang string, text string"), CONNECTORS, STOP).collect()}
    assert tuple(got[1])[:4] == ("Les ventes baissent", "les usines ferment.", "cause", 1.0)
    assert tuple(got[2])[:4] == ("la forte pluie", "les routes restent fermées.", "cause", 0.9)
    assert tuple(got[4])[:4] == ("strong wind blew.", "Then the big door closed", "cause", 1.0)
    assert all(got[k] is None for k in (3, 5, 6, 7))


def test_patterns_connectors_and_measures(spark):
    texts = spark.createDataFrame([("Heavy rain leads to floods here",), ("because nothing else is said",), ("too short because",), (None,)], "text string")
    got = annotate.by_pattern(texts, [("leads to", "cause"), ("rain", "x")], ["here"]).collect()
    assert (got[0].relation, got[0].labels) == ("cause", ["heavy", "rain", "leads"]) and got[1].relation is None
    got = annotate.by_connector(texts, [("leads to", "cause", "forward"), ("because", "cause", "backward")]).collect()
    assert tuple(got[0].found) == ("Heavy rain", "floods here", "cause") and got[1].found is None and got[2].found is None and got[3].found is None
    rows = spark.createDataFrame([(["a", "b", "c"], ["a", "x"]), ([], ["a"])], "predicted array<string>, gold array<string>")
    assert tuple(annotate.positional_accuracy(rows).head()) == (2, 0.5)
    edges = spark.createDataFrame([("n1", "n2", " Causes "), ("n1", "n3", "magic")], "source string, target string, relation string")
    kept = annotate.normalised(edges, ["cause"], {"causes": "cause"}).collect()
    assert [(r.sources, r.relation) for r in kept] == [(["n1"], "cause")]
    nodes = spark.createDataFrame([("a", "Etat"), ("b", "what")], "id string, node_type string")
    assert [r.node_type for r in annotate.normalised_nodes(nodes, ["etat_local"]).collect()] == ["etat_local"]


def test_functions(spark):
    python = "def f(x):\n    '''Long enough to be kept as a function.'''\n    return x\n\nasync def g():\n    pass\n"
    rust = "fn main() { if true { println!(\"a block inside another block\"); } }\nfn open(x: i32) { never closed, long enough all the same"
    files = spark.createDataFrame([(1, "python", python), (2, "rust", rust), (3, "python", "def broken("), (4, "cobol", "x"), (5, None, None)], "id int, language string, source string")
    got = {r.id: r.function for r in annotate.extract_functions(files, {"rust": r"\bfn\s+\w+\s*\([^)]*\)"}).collect()}
    assert set(got) == {1, 2} and got[1].startswith("def f(x)") and got[2].endswith("} }")
    assert files.where(F.lit(False)).count() == 0
