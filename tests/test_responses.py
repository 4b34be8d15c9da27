from pyspark.sql import functions as F

from millrace.operators import responses


def test_blocks_and_records(spark):
    cited = spark.createDataFrame([("q", 1, "c1", 0.5, "p", 3, "text", ["i", "none"]), ("q", 2, "c2", 0.4, "p", None, "more", None)], "query_id string, number int, chunk_id string, score double, cited string, page int, excerpt string, image_refs array<string>")
    images = spark.createDataFrame([("i", "x/i.PNG", bytearray(b"ab"))], "image_id string, path string, content binary")
    blocks = {r.number: [tuple(b) for b in r.blocks] for r in responses.content_blocks(cited, images).collect()}
    assert blocks == {1: [("text", None, "text"), ("image", "image/png", "YWI=")], 2: [("text", None, "more")]}
    queries = spark.createDataFrame([("q", "c", "what")], "query_id string, collection string, query_text string")
    results, citations = responses.recorded(cited, queries, 5.0)
    assert results.count() == 1 and citations.count() == 1
    later = citations.unionByName(citations.select(F.lit("r").alias("query_id"), "document_id", F.lit(9.0).alias("created_at")))
    assert [r.query_id for r in responses.last_query(later).collect()] == ["r"]


def test_stages(spark):
    stage = "array<struct<name:string,event:string,elapsed_ms:double,n_out:int>>"
    df = spark.createDataFrame([([("dense", "finish", 1.0, 3), ("dense", "dense_failed", None, None), ("dense", "finish", None, 4), ("x", "dense_failed", None, None)],)], f"stages {stage}")
    r = df.select(responses.degraded_events(F.col("stages")).alias("d"), F.size(responses.timed_stages(F.col("stages"))).alias("t"), responses.recalled(F.col("stages"), "dense").alias("n"), responses.recalled(F.col("stages"), "sparse").alias("z")).first()
    assert (r.d, r.t, r.n, r.z) == (["dense_failed"], 1, 4, None)


def test_logs_and_summary(spark):
    rows = spark.createDataFrame([(0.5, "INFO", "l", "m", 7)], "created double, level string, logger string, message string, n int")
    assert responses.log_lines(rows, ["n", "level"]).first().line == '{"ts":"1970-01-01T00:00:00.500Z","level":"INFO","logger":"l","message":"m","n":7}'
    c = spark.createDataFrame([("d", "b", 1, "two"), ("d", "a", 0, "one"), ("d", "a", 0, "one")], "source_ref string, chunk_id string, chunk_index int, text string").withColumn("metadata", F.create_map(F.lit("k"), F.lit("v")))
    assert [(r.n_chunks, r.first_text) for r in responses.document_summary(c).collect()] == [(2, "one")]
