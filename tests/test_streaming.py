"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from causeloom.operators import curation
from causeloom.streaming import ingest

DOCS = "/root/testdata/sf0.001/documents.parquet"


def test_sentences_of_a_stream_and_its_resumption(spark, tmp_path):
    source, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    docs = spark.read.parquet(DOCS).select("doc_id", "text")
    docs.where("doc_id % 2 = 0").write.parquet(source)
    stream = lambda: spark.readStream.schema(docs.schema).parquet(source)
    ingest.append(ingest.good_sentences(stream()), out, mark).awaitTermination()
    docs.where("doc_id % 2 = 1").write.mode("append").parquet(source)
    ingest.append(ingest.good_sentences(stream()), out, mark).awaitTermination()
    got = spark.read.parquet(out).select("id", "place").collect()
    want = curation.split_sentences(docs).where(curation.quality(F.col("sentence")) >= 0.5).select("id", "place").collect()
    assert sorted(got) == sorted(want)


def test_transitions_and_repeats(spark, tmp_path):
    rows = [(1, "2024-01-01 10:00:00", 7, "a"), (2, "2024-01-01 10:05:00", 7, "b"), (3, "2024-01-01 10:06:00", 8, "a"), (4, "2024-01-01 10:07:00", 7, "a"), (5, "2024-01-02 10:00:00", 9, "z")]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    ingest.append(ingest.transitions(stream()), f"{tmp_path}/out", f"{tmp_path}/m1").awaitTermination()
    assert sorted((r.src, r.dst) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", "b"), ("b", "a")]
    ingest.append(ingest.unseen(stream(), "event_type", "ts", "2 days"), f"{tmp_path}/new", f"{tmp_path}/m2").awaitTermination()
    assert sorted(r.event_type for r in spark.read.parquet(f"{tmp_path}/new").collect()) == ["a", "b", "z"]
