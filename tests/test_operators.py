import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import chunking, evaluate, index, metrics, retrieval, tables, transforms
from millrace.plans import ingest
from millrace.sources import files
from millrace.streaming import streams

CHUNKS = [("a", "c", "the quick brown fox"), ("b", "c", "brown dog brown"), ("d", "c", "rabbit"), ("e", "c", "")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id string, collection string, text string").withColumn("metadata", F.create_map(F.lit("source_path"), F.col("chunk_id")))


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_bm25_by_hand(spark, chunks):
    q = spark.createDataFrame([("q", "c", "brown brown fox"), ("z", "c", "zebra"), ("e", "c", "")], "query_id string, collection string, query_text string")
    got = {r.chunk_id: r for r in retrieval.sparse(index.build(chunks), q, 5).collect()}
    tokens = {"a": ["quick", "brown", "fox"], "b": ["brown", "dog", "brown"]}
    avg = (3 + 3 + 1 + 0) / 4

    def score(doc):
        s = 0
        for t, qtf, df in (("brown", 2, 2), ("fox", 1, 1)):
            tf = tokens[doc].count(t)
            s += qtf * math.log((4 - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * 3 / avg))
        return s

    assert set(got) == {"a", "b"}
    for k in got:
        assert got[k].score == pytest.approx(score(k), abs=1e-7)
    assert got["a"].rank == 1


def test_add_and_remove_equal_build(chunks):
    part, rest = chunks.where("chunk_id < 'c'"), chunks.where("chunk_id > 'c'")
    full = rows(index.build(chunks).terms, "term")
    assert rows(index.add(index.build(part), rest).terms, "term") == full
    again = index.add(index.add(index.build(part), rest), rest)
    assert rows(again.terms, "term") == full
    assert rows(index.remove(again, rest).terms, "term") == rows(index.build(part).terms, "term")


def test_empty_index(spark, chunks):
    none = chunks.where("false")
    q = spark.createDataFrame([("q", "c", "brown")], "query_id string, collection string, query_text string")
    assert retrieval.sparse(index.build(none), q, 5).count() == 0
    assert rows(index.build(none).corpus, "collection") == []


def test_fusion_and_single_leg(spark):
    schema = "query_id string, chunk_id string, rank int, score double, source string"
    a = spark.createDataFrame([("q", "x", 1, 9.0, "sparse"), ("q", "y", 3, 8.0, "sparse"), ("s", "x", 1, 5.0, "sparse")], schema)
    b = spark.createDataFrame([("q", "y", 1, 0.9, "dense"), ("q", "z", 2, 0.8, "dense")], schema)
    fused = rows(retrieval.fuse([a, b]).where("query_id = 'q'").select("chunk_id", "score"), F.desc("score"), "chunk_id")
    assert fused[0] == ("y", round(1 / 62 + 1 / 61, 8)) and [c for c, _ in fused] == ["y", "x", "z"]
    out = {r.query_id: r for r in retrieval.hybrid(a, b, 1).collect()}
    assert out["s"].source == "sparse" and out["s"].score == 5.0 and out["q"].source == "fusion"
    with pytest.raises(ValueError):
        retrieval.fuse([a], 0)


def test_rerank_head_and_tail(spark):
    r = spark.createDataFrame([("q", c, i, 1.0 - i / 10, "fusion") for i, c in enumerate("abcd", 1)], "query_id string, chunk_id string, rank int, score double, source string")
    s = spark.createDataFrame([("q", "b", 0.5), ("q", "c", 7.0), ("q", "nope", 1.0)], "query_id string, chunk_id string, new_score double")
    got = rows(retrieval.rerank(r, s, 3).select("rank", "chunk_id", "score"), "rank")
    assert [g[1] for g in got] == ["c", "b", "a", "d"] and got[0][0] == 0 and got[0][2] == 1.0


def test_query_filters(spark):
    found, rest = retrieval.query_filters(F.col("t"))
    r = spark.createDataFrame([("a type:pdf x9:1 type:md 9x:no http://y",)], "t string").select(found.alias("f"), rest.alias("r")).first()
    assert r.f == {"type": "md", "x9": "1", "http": "//y"} and r.r == ["a", "9x:no"]


def test_evaluate(spark):
    got = spark.createDataFrame([("q", "x", 1), ("q", "g", 2), ("q", "g", 3), ("e", "x", 1)], "query_id string, chunk_id string, rank int")
    golden = spark.createDataFrame([("q", "g"), ("n", "g")], "query_id string, chunk_id string")
    out = {r.query_id: tuple(r)[1:] for r in evaluate.evaluate(got, golden).collect()}
    assert out["q"] == (1.0, 0.5, 2 / 3, 2.0) and out["e"] == (0.0, 0.0, 0.0, 0.0) and out["n"] == (0.0, 0.0, 0.0, 0.0)


def test_upsert_insert_delete(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0)], "k int, v string, created double")
    new = spark.createDataFrame([(2, "c", 9.0), (3, "d", 9.0)], "k int, v string, created double")
    assert rows(tables.upsert(old, new, ["k"], keep=("created",)), "k") == [(1, "a", 1.0), (2, "c", 1.0), (3, "d", 9.0)]
    more = new.unionByName(spark.createDataFrame([(3, "e", 8.0)], new.schema))
    assert rows(tables.insert_or_ignore(old, more, ["k"], [F.col("created")]), "k") == [(1, "a", 1.0), (2, "b", 1.0), (3, "e", 8.0)]
    assert rows(tables.delete(old, new, ["k"]), "k") == [(1, "a", 1.0)]


def test_page_cursor(spark):
    df = spark.range(5).toDF("k")
    first, cursor = tables.page(df, [F.col("k")], "garbage!", 3)
    second, end = tables.page(df, [F.col("k")], cursor, 3)
    assert [r.k for r in first.collect()] == [0, 1, 2] and [r.k for r in second.collect()] == [3, 4] and end is None


def test_metrics_edges(spark):
    q = spark.createDataFrame(
        [("a", "c", '{"n_chunks": 1, "error": null, "degraded": false}', 10.0), ("b", "c", '{"n_chunks": 0, "error": null, "degraded": true, "degraded_reasons": ["x"]}', None), ("z", "c", '{"n_chu', 1.0)],
        "query_id string, collection string, result_json string, latency_ms double",
    ).withColumns({"created_at": F.lit(5.0), "source": F.lit("mcp")})
    r = metrics.query_metrics(metrics.decoded(q), ["collection"]).first()
    assert (r.queries, r.effective_rate, r.no_result_rate, r.degraded_rate, r.p95_ms) == (2, 50.0, 50.0, 50.0, 10.0)
    assert rows(metrics.trend(metrics.decoded(q), "created_at", 0.0, 10.0, 2), "bucket") == [(0, 0, None, None), (1, 2, 50.0, 10.0)]


def test_chunk_invariants(spark):
    text = "# Title\n\n" + "word " * 500 + "\n\n" + "x" * 300 + "\n中文。" * 20
    pieces = chunking.recursive_pieces(text, 100, 20)
    assert all(0 < b - a <= 100 for a, b in pieces)
    kept = {i for a, b in pieces for i in range(a, b)}
    assert all(i in kept or text[i].isspace() for i in range(len(text)))
    docs = spark.createDataFrame([("h", "c", "p", "md", text), ("m", "c", "p2", "md", "doc_id: 7"), ("n", "c", "p3", "md", None), ("e", "c", "p4", "md", "")], "doc_hash string, collection string, source_path string, doc_type string, text string")
    got = chunking.chunk_documents(docs, size=100, overlap=20).collect()
    assert {g.source_ref for g in got} == {"h"} and sorted(g.chunk_index for g in got) == list(range(len(got)))
    assert all(text[g.start_offset : g.end_offset] == g.text for g in got)


def test_ingest_is_idempotent(spark):
    docs = spark.createDataFrame([("h", "c", "p", "md", "Some text. More text."), ("i", "c", "q", "md", "Other.")], "doc_hash string, collection string, source_path string, doc_type string, text string")
    history = spark.createDataFrame([("c", "h", "success")], "collection string, file_hash string, status string")
    assert {r.source_ref for r in ingest.ingest(docs, history).collect()} == {"i"}


def test_tags_enrich_refine(spark):
    c = spark.createDataFrame([("a", "Solar grid. Grid of solar panels, 太阳能 grid!\nSecond"), ("b", ""), ("n", None)], "chunk_id string, text string")
    got = {r.chunk_id: r for r in transforms.enrich(transforms.refine(c)).collect()}
    assert got["a"].tags[:2] == ["grid", "solar"] and got["b"].tags == [] and got["n"].refined_by == "skipped" and got["a"].title.startswith("Solar")


def test_images(spark):
    i = spark.createDataFrame([("d", 1, 10, 90, "x"), ("d", 2, 90, 90, "y"), ("d", 3, 90, 90, "y"), ("d", 4, 90, 90, "x")], "doc string, seq int, width int, height int, sha string").withColumn("page_area", F.lit(1000.0))
    assert [r.reason for r in transforms.image_reasons(i).orderBy("seq").collect()] == ["size", None, "duplicate", None]


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.MD").write_bytes("﻿# Top\r\n\r\n```\n# no\n```\n## Second\r\n".encode())
    (tmp_path / "b.md").write_text("plain")
    (tmp_path / "c.txt").write_text("no")
    got = {r.title: r for r in files.read_markdown(spark, str(tmp_path)).collect()}
    assert set(got) == {"Top", "b"} and [h.text for h in got["Top"].heading_outline] == ["Top", "Second"]
    lines = spark.createDataFrame([("d", 1, 2.0, 1.0, "text", "b"), ("d", 1, 1.0, 1.0, "text", "a"), ("d", 1, 2.0, 1.0, "image", "I"), ("d", 2, 0.0, 0.0, "text", "c")], "doc string, page int, y double, x double, kind string, text string")
    assert files.join_page_lines(lines).first().text == "a\nb\nI\n\nc"
    (tmp_path / "t.jsonl").write_text('{"trace_id": "x", "finished_at": 1}\nbroken\n{"trace_id": "x", "finished_at": 2}\n')
    assert [r.finished_at for r in files.read_traces(spark, str(tmp_path / "t.jsonl")).collect()] == [2.0]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "2024-01-01 00:00:01"), ("a", "2024-01-01 00:00:01"), ("b", "2024-01-01 01:00:00")], "id string, ts string").select("id", F.to_timestamp("ts").alias("ts")).write.parquet(src)
    events = spark.readStream.schema("id string, ts timestamp").parquet(src)
    q = streams.deduplicated(events, "id", "ts").writeStream.format("memory").queryName("dedup").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("dedup").count() == 2
    more = [("a", "2024-01-01 00:00:09"), ("c", "2024-01-01 00:00:02")], [("b", "2024-01-01 00:30:00"), ("d", "2024-01-01 00:00:03")]
    for rows in (*more, more[0]):  # three batches, the last one a repeat
        spark.createDataFrame(rows, "id string, ts string").select("id", F.to_timestamp("ts").alias("ts")).write.mode("append").parquet(src)
        streams.upsert_stream(events, str(tmp_path / "out"), ["id"], [F.desc("ts")], str(tmp_path / "cp")).awaitTermination(60)
    got = {(r.id, str(r.ts)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", "2024-01-01 00:00:09"), ("b", "2024-01-01 01:00:00"), ("c", "2024-01-01 00:00:02"), ("d", "2024-01-01 00:00:03")}


def test_every_fiftieth_chunk_asks(spark):
    """The queries grow with the data; each has the nearest vectors of its collection."""
    from hashlib import md5

    from millrace import queries

    d = "/root/testdata/sf0.001"
    v = {r.chunk_id: r for r in queries._vectors(spark, d).collect()}
    asked = {i for i in v if int(md5(i.encode()).hexdigest()[:8], 16) % 50 == 0}
    got = {}
    for r in queries.queries()["dense_topk"](spark, d).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chunk_id))
    assert asked and set(got) == asked
    for q in asked:
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(v[q].dense_vector, x.dense_vector, strict=True)), 5), i) for i, x in v.items() if x.collection == v[q].collection)
        assert {i for _, i in got[q]} == {i for _, i in near[:10]}


def test_places_in_order_against_plain_version(spark):
    import random

    rng = random.Random(7)
    groups = {g: [rng.choice([rng.lognormvariate(4, 2), 5.0, 0.0, -3.5, 1e300]) for _ in range(rng.randint(1, 300))] for g in ("a", "b", None)}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("none", None)], "g string, v double")
    got = {r.g: (r.p50, r.p95, r.p100) for r in metrics.exact_percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
    assert got == {g: tuple(sorted(vs)[max(1, math.ceil(round(q * len(vs), 9))) - 1] for q in (0.5, 0.95, 1.0)) for g, vs in groups.items()}


def test_products_of_blocks_against_plain_version(spark, monkeypatch):
    import random

    from millrace.operators import blocks

    monkeypatch.setattr(blocks, "ITEMS", 7)
    monkeypatch.setattr(blocks, "QUERIES", 3)
    rng = random.Random(5)
    items = [(rng.choice("cd"), f"i{n:02d}", [float(rng.randint(-2, 2)) for _ in range(3 if n else 2)]) for n in range(40)]
    asked = [(rng.choice("cd"), f"q{n}", [float(rng.randint(-2, 2)) for _ in range(3)]) for n in range(8)]
    v = spark.createDataFrame(items, "collection string, chunk_id string, dense_vector array<float>")
    q = spark.createDataFrame(asked, "collection string, query_id string, query_vector array<float>")
    got = {}
    for r in retrieval.dense(v, q, 4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chunk_id, r.distance))
    for c, i, x in asked:
        near = sorted((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), n) for k, n, y in items if k == c and len(y) == 3)[:4]
        assert sorted(got.get(i, [])) == [(k, n, d) for k, (d, n) in enumerate(near, 1)]
    assert retrieval.dense(v.where("false"), q, 4).count() == 0 and retrieval.dense(v, q, 0).count() == 0


def test_index_stored_and_loaded(spark, chunks, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        index.load(spark, path)
    index.stored(index.build(chunks.where("chunk_id < 'c'"), k1=1.2, b=0.5), path)
    merged = index.merge_or_build(spark, path, chunks.where("chunk_id > 'a'"))
    assert (merged.k1, merged.b) == (1.2, 0.5)
    assert rows(merged.terms, "term") == rows(index.build(chunks).terms, "term")


def test_ingest_into_stores(spark, tmp_path):
    docs = spark.createDataFrame([("h", "c", "p", "md", "Some text. More text."), ("e", None, "q", "md", "")], "doc_hash string, collection string, source_path string, doc_type string, text string")
    folder = str(tmp_path / "stores")
    model = lambda c: c.select("chunk_id", F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("dense_vector"))
    assert ingest.ingest_into(docs, folder, at=1.0, embedding=model, width=2) == {"documents": 2, "chunks": 1}
    assert ingest.ingest_into(docs, folder, at=2.0) == {"documents": 0, "chunks": 0}
    other = docs.withColumn("doc_hash", F.concat("doc_hash", F.lit("2"))).where("text <> ''")
    with pytest.raises(Exception, match="no usable vector"):
        ingest.ingest_into(other, folder, at=3.0, embedding=model, width=3)
    history = {(r.collection, r.file_hash): r.status for r in spark.read.parquet(f"{folder}/history").collect()}
    assert history == {("c", "h"): "success", ("default", "e"): "success", ("c", "h2"): "failed"}
    assert ingest.ingest_into(other, folder, at=4.0)["documents"] == 1  # what failed is tried again
    assert index.load(spark, f"{folder}/index").corpus.where("collection = 'c'").first().n_docs == 2
    with pytest.raises(ValueError):
        ingest.provider("splitter", "semantic")


def test_markdown_rejects_and_page_lines(spark, tmp_path):
    for name, data in {"bin.md": b"a\x00b", "bad.md": b"\xff\xfe\xfa", "empty.md": b" \n", "ok.md": b"# T\nx"}.items():
        (tmp_path / name).write_bytes(data)
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in files.markdown_rejects(spark, str(tmp_path)).collect()} == {"bin.md": "binary", "bad.md": "not UTF-8", "empty.md": "empty"}
    assert [r.title for r in files.read_documents(spark, str(tmp_path), str(tmp_path / "ok.md")).collect()] == ["T", "T"]
    (tmp_path / "x.pages").write_bytes(b"b|a")
    lines = lambda data: [(1, float(-i), 0.0, "text", t) for i, t in enumerate(data.decode().split("|"))]
    assert [r.text for r in files.read_page_lines(spark, str(tmp_path), ".pages", lines).collect()] == ["a\nb"]


def test_rerank_takes_the_best_of_several_scores(spark):
    r = spark.createDataFrame([("q", c, i, 1.0, "fusion") for i, c in enumerate("ab", 1)], "query_id string, chunk_id string, rank int, score double, source string")
    s = spark.createDataFrame([("q", "b", 0.1), ("q", "b", 0.9), ("q", "a", 0.5)], "query_id string, chunk_id string, new_score double")
    assert rows(retrieval.rerank(r, s, 2).select("rank", "chunk_id", "score"), "rank") == [(0, "b", 0.9), (1, "a", 0.5)]


def test_traces_are_searched_by_values(spark):
    stage = "array<struct<name:string,ts:double,event:string>>"
    t = spark.createDataFrame([("a", [("dense", 1.0, "Store_Error")]), ("b", [("sparse", 1.0, None)]), ("c", None)], f"trace_id string, stages {stage}")
    assert [r.trace_id for r in metrics.trace_search(t, "STORE").collect()] == ["a"] and metrics.trace_search(t, "event").count() == 0


def test_model_answers(spark):
    from millrace.functions import text as T

    df = spark.createDataFrame([('```json\n{"title": "x", "n": 1}\n```', "so: [1, 2] ok"), ('{"title": "x"}', "none")], "a string, b string")
    got = df.select(T.json_object(F.col("a"), "title string, n int").alias("o"), T.json_list(F.col("b"), "int").alias("l")).collect()
    assert (got[0].o.title, got[0].o.n, got[0].l) == ("x", 1, [1, 2]) and got[1].o is None and got[1].l is None
    c = spark.createDataFrame([("a", "one two"), ("b", None)], "chunk_id string, text string")
    r = {x.chunk_id: (x.refined_by, x.refine_reason, x.text) for x in transforms.refine(c, lambda t: F.concat(t, F.lit("!")), 0.5).collect()}
    assert r == {"a": ("rule", "too little changed", "one two"), "b": ("skipped", "blank", None)}
    i = spark.createDataFrame([("i",)], "image_id string")
    assert transforms.caption(i).first().skipped == "no model" and len(transforms.caption(i, lambda x: F.repeat(x, 900)).first().caption) == 500
