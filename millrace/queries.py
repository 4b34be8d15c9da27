"""Core queries over the tables of a data folder; ``oracle`` has the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import ids
from .functions import text as T
from .functions import vectors as V
from .operators import blocks, chunking, evaluate, index, metrics, retrieval, tables, transforms
from .oracle import END, START, SQL
from .sources import store

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
TOP_K = 10


def _query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """One row for each chunk_id (repeats have the same text)."""
    c = tables.spread(_t(spark, d, "chunks").select("chunk_id", "collection", "doc_id", "chunk_index", "text", "source_ref", "metadata", "ingested_at"))
    return tables.latest(c, ["chunk_id"], [F.desc("ingested_at"), F.col("text")])


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Each text asked in a collection once."""
    q = _t(spark, d, "query_results").where("query_text IS NOT NULL")
    return q.groupBy("collection", "query_text").agg(F.min("query_id").alias("query_id"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "chunk_records").select("chunk_id", "collection", "dense_vector").where("dense_vector IS NOT NULL AND size(dense_vector) = 64")
    v = v.where(~F.exists("dense_vector", lambda x: F.isnan(x) | x.isNull()))
    return v.dropDuplicates(["chunk_id"])


def _every_fiftieth(df: DataFrame) -> DataFrame:
    """Rows whose chunk_id has a number (of its MD5) divisible by 50: queries in proportion to the data."""
    return df.where(blocks.spread_out("chunk_id") % 50 == 0).withColumn("query_id", F.col("chunk_id"))


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return _every_fiftieth(_vectors(spark, d)).select("query_id", "collection", F.col("dense_vector").alias("query_vector"))


def _index(chunks: DataFrame) -> index.Index:
    return index.build(chunks, hold=True)


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "tasks").distinct()


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@_query
def tokenize_terms(spark, d):
    return _chunks(spark, d).select("chunk_id", T.index_tokens(F.col("text")).alias("tokens"))


@_query
def term_freq(spark, d):
    return index.build(_chunks(spark, d)).postings.select("chunk_id", "term", "tf")


@_query
def term_statistics(spark, d):
    return _r(index.build(_chunks(spark, d)).terms, "idf")


@_query
def corpus_stats(spark, d):
    return _r(index.build(_chunks(spark, d)).corpus, "avgdl")


@_query
def sparse_vectors(spark, d):
    """What the sparse vector of each chunk holds."""
    v = index.sparse_vectors(_index(_chunks(spark, d))).withColumn("e", F.transform(F.map_entries("sparse_vector"), lambda x: F.struct(x.key.alias("k"), F.round(x.value, 6).alias("v"))))
    total = F.aggregate("e", F.lit(0).cast("long"), lambda a, x: a + F.round(x.v * 1e6).cast("long"))
    ends = F.array_sort("e")
    return v.select("chunk_id", F.size("e").cast("long").alias("n_terms"), total.alias("millionths"), F.try_element_at(ends, F.lit(1)).k.alias("first_term"), F.coalesce(F.try_element_at(ends, F.lit(-1)).v, F.lit(0.0)).alias("last_weight"))


@_query
def index_saved(spark, d):
    """Statistics of an index that was built of the first chunks, stored, and merged with the others at its place."""
    c, path = _chunks(spark, d), store.fresh_path(spark)
    index.merge_or_build(spark, path, c.where("chunk_index = 0"))
    index.merge_or_build(spark, path, c.where("chunk_index > 0"))
    return _r(index.load(spark, path).terms, "idf")


@_query
def bm25_topk(spark, d):
    return retrieval.sparse(_index(_chunks(spark, d)), _asked(spark, d), TOP_K)


@_query
def index_remove(spark, d):
    c = _chunks(spark, d)
    return _r(index.remove(index.build(c), c.where("chunk_index = 0")).terms, "idf")


@_query
def index_add(spark, d):
    """Adding all first chunks to an index of the others gives the index of all."""
    c = _chunks(spark, d)
    return _r(index.add(index.build(c.where("chunk_index > 0")), c.where("chunk_index = 0")).terms, "idf")


@_query
def dense_topk(spark, d):
    return retrieval.dense(_vectors(spark, d), _vector_queries(spark, d), TOP_K)


@_query
def dense_topk_cosine(spark, d):
    return retrieval.dense(_vectors(spark, d), _vector_queries(spark, d), TOP_K, "cosine")


def _legs(spark, d):
    """Both legs: every fiftieth chunk asks with its text and its vector."""
    c = _chunks(spark, d)
    text = _every_fiftieth(c).select("query_id", "collection", F.col("text").alias("query_text"))
    return store.cut_lineage(retrieval.sparse(_index(c), text, 2 * TOP_K)), store.cut_lineage(retrieval.dense(_vectors(spark, d), _vector_queries(spark, d), 2 * TOP_K))


@_query
def rrf_fusion(spark, d):
    return retrieval.fuse(list(_legs(spark, d)))


@_query
def hybrid_search(spark, d):
    s, v = _legs(spark, d)
    return retrieval.hybrid(s, v, TOP_K)


@_query
def hybrid_postfilter(spark, d):
    s, v = _legs(spark, d)
    c = _t(spark, d, "chunks")
    return retrieval.hybrid(s, v, TOP_K, post_filter=lambda r: retrieval.metadata_filter(r, c, {"doc_type": "md"}))


@_query
def leg_counts(spark, d):
    s, v = _legs(spark, d)
    return retrieval.leg_counts(s, v, retrieval.hybrid(s, v, TOP_K))


@_query
def lexical_rerank(spark, d):
    c = _chunks(spark, d)
    asked = _asked(spark, d)
    hits = retrieval.sparse(_index(c), asked, TOP_K)
    return retrieval.rerank(hits, retrieval.lexical_scores(hits, asked, c), 5)


@_query
def citations(spark, d):
    c = _chunks(spark, d)
    return retrieval.citations(retrieval.sparse(_index(c), _asked(spark, d), 5), c)


@_query
def markdown_references(spark, d):
    c = _chunks(spark, d)
    return retrieval.markdown_references(retrieval.citations(retrieval.sparse(_index(c), _asked(spark, d), 5), c))


@_query
def chunk_ids(spark, d):
    c = _chunks(spark, d)
    return c.select("chunk_id", ids.chunk_id(F.col("source_ref"), F.col("chunk_index"), F.col("text")).alias("computed"), ids.record_id(F.col("metadata")["source_path"], F.col("chunk_index"), F.col("text")).alias("record_id"))


@_query
def safe_names(spark, d):
    t = _tasks(spark, d)
    return t.select("source_path", ids.safe_filename(F.col("source_path")).alias("name"), ids.canonical_path("uploads", F.col("collection_id"), F.col("source_path")).alias("path")).distinct()


@_query
def marker_filter(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.coalesce(T.is_marker(F.col("text")), F.lit(False)).alias("marker"))


@_query
def filter_tokens(spark, d):
    """Filters and words of queries made of a collection, its kind and the text."""
    q = _asked(spark, d).select("query_id", F.concat_ws(" ", F.concat(F.lit("collection:"), F.col("collection")), F.col("query_text"), F.lit("collection:last 9x:no")).alias("text"))
    found, rest = retrieval.query_filters(F.col("text"))
    return q.select("query_id", found["collection"].alias("collection"), F.size(found).alias("n"), F.array_join(rest, " ").alias("rest"))


@_query
def tags_topn(spark, d):
    return transforms.tags(_chunks(spark, d))


@_query
def refined_texts(spark, d):
    return transforms.refine(_chunks(spark, d)).select("chunk_id", "refined_by", "text")


@_query
def enriched_chunks(spark, d):
    return transforms.enrich(_chunks(spark, d)).select("chunk_id", "title", "summary", "tags")


@_query
def fixed_length_chunks(spark, d):
    return chunking.fixed_length(_t(spark, d, "documents"))


@_query
def recursive_chunks(spark, d):
    return chunking.chunk_documents(_t(spark, d, "documents")).select("chunk_id", "collection", "chunk_index", "start_offset", "end_offset", "text")


@_query
def unit_vectors(spark, d):
    v = _vectors(spark, d).where(F.exists("dense_vector", lambda x: x != 0))
    return v.select("chunk_id", F.round(V.norm(F.col("dense_vector")), 4).alias("norm"), F.round(V.unit(F.col("dense_vector"))[0], 5).alias("first"))


@_query
def upserted_results(spark, d):
    """The row of each query_id that a later write left in place."""
    q = _t(spark, d, "query_results").select("query_id", "collection", "created_at", "recorded_at", "source").where("query_id IS NOT NULL")
    late = tables.latest(q, ["query_id"], [F.desc("created_at"), F.desc("recorded_at"), F.col("collection"), F.col("source")])
    return late.select("query_id", "collection", "created_at", "source")


@_query
def usage_insert_ignore(spark, d):
    """Events once for each id: the first in time."""
    e = _t(spark, d, "embedding_usage_events").select("id", "occurred_at", "operation", "token_count")
    return tables.latest(e.where("id IS NOT NULL"), ["id"], [F.col("occurred_at"), F.col("operation"), F.col("token_count")])


@_query
def integrity_skip(spark, d):
    """Documents whose hash no task ended with success for."""
    docs = _t(spark, d, "documents").select("collection", F.col("doc_hash").alias("file_hash"))
    done = _tasks(spark, d).select(F.col("collection_id").alias("collection"), F.col("document_id").alias("file_hash"), F.when(F.col("status") == "succeeded", "success").otherwise("failed").alias("status"))
    return tables.new_files(docs, done)


@_query
def list_documents(spark, d):
    return tables.documents_overview(_t(spark, d, "documents").select("doc_id", "collection", "source_path"), _t(spark, d, "chunks"))


@_query
def collection_stats(spark, d):
    c = _t(spark, d, "chunks")
    n = c.groupBy("collection").agg(F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("source_ref").alias("documents"))
    return _t(spark, d, "collections").select("collection").join(n, "collection", "left").select("collection", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("documents", F.lit(0)).alias("documents"))


@_query
def delete_cascade(spark, d):
    """Numbers of chunks that go with the documents of unknown type."""
    doomed = _t(spark, d, "documents").where("doc_type IS NULL").select("collection", "source_path", "doc_hash")
    return tables.delete_documents(_chunks(spark, d), doomed)[1]


@_query
def latest_task(spark, d):
    t = _tasks(spark, d).select("collection_id", "source_path", "task_id", "status", "created_at", "updated_at", "attempt")
    order = [F.desc("created_at"), F.desc("attempt"), F.desc("updated_at"), F.col("task_id"), F.col("status")]
    return tables.latest(t, ["collection_id", "source_path"], order).select("collection_id", "source_path", "task_id", "status")


@_query
def merged_collections(spark, d):
    a = _t(spark, d, "chunks").select(F.col("collection").alias("name"))
    b = _t(spark, d, "split_profiles").select(F.col("collection").alias("name"))
    return tables.merged_names(a, b)


@_query
def query_metrics(spark, d):
    return metrics.query_metrics(metrics.decoded(_t(spark, d, "query_results").where("NOT isnan(coalesce(latency_ms, 0))")), ["collection"])


@_query
def kb_attention(spark, d):
    rows = metrics.decoded(_t(spark, d, "query_results").where("NOT isnan(coalesce(latency_ms, 0))"))
    return metrics.attention(metrics.query_metrics(rows, ["collection"])).select("collection", "queries", "p95_ms", "attention")


@_query
def ingestion_metrics(spark, d):
    return metrics.ingestion_metrics(_tasks(spark, d), ["collection_id"])


@_query
def trend_buckets(spark, d):
    rows = metrics.decoded(_t(spark, d, "query_results").where("NOT isnan(coalesce(latency_ms, 0))"))
    return metrics.trend(rows, "created_at", START, END, 7)


@_query
def usage_summary(spark, d):
    return metrics.usage(tables.latest(_t(spark, d, "embedding_usage_events").where("id IS NOT NULL"), ["id"], [F.col("occurred_at"), F.col("operation"), F.col("token_count")]), START, END)


@_query
def period_over_period(spark, d):
    return metrics.compare(_t(spark, d, "query_results"), "created_at", END, 7 * 86400.0, ["collection"])


@_query
def degraded_reasons(spark, d):
    rows = metrics.decoded(_t(spark, d, "query_results"))
    return rows.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@_query
def time_range_scan(spark, d):
    return tables.time_range(_t(spark, d, "query_results"), "created_at", START, END, source="mcp").select("query_id", "created_at")


@_query
def cursor_page(spark, d):
    order = [F.col("collection")]
    return tables.page(_t(spark, d, "collections").select("collection"), order, "MjA=", 20)[0]


@_query
def worst_status(spark, d):
    rows = _tasks(spark, d).select("collection_id", F.when(F.col("status") == "failed", "down").when(F.col("status").isin("cancelled", "skipped"), "degraded").otherwise("ok").alias("status"))
    return metrics.worst_status(rows, ["collection_id"])


@_query
def batch_admission(spark, d):
    t = _tasks(spark, d)
    w = Window.partitionBy("collection_id").orderBy("created_at", "task_id", "updated_at", "status")
    files = t.select(F.row_number().over(w).cast("long").alias("file_no"), F.col("collection_id").alias("collection"), "filename", (F.length("source_path") * 1_000_000).cast("long").alias("size_bytes"), F.col("document_id").alias("file_hash"))
    history = t.where("status = 'succeeded' AND attempt > 0").select(F.col("collection_id").alias("collection"), F.col("document_id").alias("file_hash"), F.lit("success").alias("status"))
    return tables.admission(files, history, [".md", ".markdown", ".pdf"], 33_000_000).groupBy("collection", "status", "code").agg(F.count("*").alias("n"))


@_query
def access_filter(spark, d):
    """How many documents the keys of query results may see: those of collections they asked in."""
    grants = _t(spark, d, "query_results").where("api_key_id IS NOT NULL").select(F.col("api_key_id").alias("key_id"), "collection").distinct()
    n = _t(spark, d, "documents").groupBy("collection").agg(F.count("*").alias("n"))  # counted before the join
    return grants.join(n, "collection").groupBy("key_id").agg(F.sum("n").alias("documents"))


@_query
def eval_batch(spark, d):
    """Golden chunks of a query: those of its collection that have a code (two capitals and a number) of the query."""
    c = _chunks(spark, d)
    asked = _asked(spark, d)
    codes = lambda x: F.explode(F.array_distinct(F.regexp_extract_all(x, F.lit("[A-Z]{2}-[0-9]+"), F.lit(0)))).alias("code")
    golden = asked.select("query_id", "collection", codes(F.col("query_text"))).join(c.select("chunk_id", "collection", codes(F.col("text"))), ["collection", "code"])
    return _r(evaluate.evaluate(retrieval.sparse(_index(c), asked, TOP_K), golden.select("query_id", "chunk_id")), "mrr", "precision", "recall")


@_query
def image_filter(spark, d):
    """Lineitems as images: the sizes are quantities, repeats share part and quantity."""
    i = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("seq"), (F.col("l_quantity") * 4).alias("width"), (F.col("l_quantity") * 2).alias("height"), F.lit(500_000.0).alias("page_area"), (F.col("l_partkey") % 3).alias("sha"))
    return transforms.image_reasons(i).groupBy("reason").agg(F.count("*").alias("n"))


@_query
def stage_elapsed(spark, d):
    """Events of a user as stages of a trace."""
    e = _t(spark, d, "events").select(F.col("user_id").alias("trace_id"), F.col("event_type").alias("stage"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "event_id")
    return _r(metrics.entry_times(e, "ts", ["ts", "event_id"]), "elapsed")


@_query
def set_operations(spark, d):
    """Hashes of documents with tasks only, with chunks only, and with both."""
    a = _t(spark, d, "tasks").select(F.col("document_id").alias("h")).where("h IS NOT NULL").distinct()
    b = _t(spark, d, "chunks").select(F.col("source_ref").alias("h")).where("h IS NOT NULL").distinct()
    part = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return part(a.subtract(b), "tasks").unionByName(part(b.subtract(a), "chunks")).unionByName(part(a.intersect(b), "both"))


@_query
def tumbling_events(spark, d):
    e = _t(spark, d, "events")
    w = F.window("ts", "1 day")
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def queries() -> dict[str, Query]:
    from . import service

    return {**_QUERIES, **service.queries()}


def oracle_sql() -> dict[str, str]:
    from . import service

    return {**{k: v for k, v in SQL.items() if k in _QUERIES}, **service.SQL}
