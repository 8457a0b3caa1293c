"""The whole pipeline against brute force: which documents go, at which stage, and what the others' tokens are."""

import random
import re

import corpus_pipeline
import pytest
from test_texts import reference_encoding, shingle_set, words_of


def expected(rows, items):
    """Rows (id, text) that each stage keeps."""
    stages = [[r for r in rows if r[1] is not None and re.search(r"[^\W\d_]", r[1])]]
    groups = {}
    for k, (d, t) in enumerate(stages[-1]):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), d is None, d or 0, k))
    stages.append([stages[-1][min(g)[3]] for g in groups.values()])
    kept, sets = stages[-1], [shingle_set(t) for _, t in stages[-1]]
    parent = list(range(len(kept)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    best = {}
    for k, (d, _) in enumerate(kept):
        best.setdefault(root(k), []).append((d is None, d or 0, k))
    stages.append([kept[min(g)[2]] for g in best.values()])
    phrases = set()
    for t in items:
        w = words_of(t)
        n = min(10, len(w))
        phrases |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    sizes = {len(p) for p in phrases}

    def clean(t):
        w = words_of(t)
        return not any(tuple(w[i : i + n]) in phrases for n in sizes for i in range(len(w) - n + 1))

    stages.append([r for r in stages[-1] if clean(r[1])])
    return stages


@pytest.mark.parametrize("clash", [False, True])
def test_every_stage_keeps_what_it_should(spark, tmp_path, clash):
    draw = random.Random(5)
    own = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    rows = [tuple(r) for r in own[:120]]
    texts = [r[1] for r in rows]
    rows += [(1000 + k, draw.choice(texts) + " tail", "en", "s") for k in range(10)] + [(2000 + k, draw.choice(texts) + "  ", "en", "s") for k in range(5)]
    rows += [(3000, None, None, None), (3001, "", "en", None), (3002, " 12 !", "en", "s"), (None, "a lone text without an id", None, "s"), (None, None, None, None), (7000, "x", "fr", "s")]
    items = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rows += [(4000 + k, "before " + t + " behind", "en", "s") for k, t in enumerate(items[:4])]
    names = "doc_id long, text string, lang string, source string"
    if clash:
        rows, names = [(*r, "kept", 5) for r in rows], names + ", lang_pred string, n_hit int"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = expected([r[:2] for r in rows], items)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, function), keep in zip(corpus_pipeline.STAGES[:4], want):
        docs = corpus_pipeline.stage(function(spark, docs, str(tmp_path)), "test")
        got = docs.collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(keep, key=repr), name
        assert docs.columns == [n.split()[0] for n in names.split(", ")] and (not clash or {r.lang_pred for r in got} == {"kept"})
    library = reference_encoding()
    found = corpus_pipeline.tokens(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, tuple(r.ids)) for r in found) == sorted((d or 0, tuple(library.encode_ordinary(t))) for d, t in want[3]) and all(r.round_trip for r in found)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_repeated_ids_are_decided_each(spark, tmp_path):
    text = lambda n: " ".join(f"w{random.Random(n).randrange(10**6)}{k}" for k in range(40))
    rows = [(1, text(1), "en", "s"), (1, text(2), "en", "s"), (1, text(1), "en", "s"), (2, text(1) + " more", "en", "s"), (1, text(3), "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text(3))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = expected([r[:2] for r in rows], [text(3)])[3]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((d, len(reference_encoding().encode_ordinary(t))) for d, t in want)
