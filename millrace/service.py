"""Queries of stores, streams, ingestion and metrics over the tables of a data folder, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import ids
from .functions import text as T
from .operators import chunking, index, metrics, responses, retrieval, tables, transforms
from .oracle import _CHUNKS, _DECODED, _EVENTS, _IDX, _RATE, _TASKS, _TRIM, _VALID, END, START
from .plans import ingest
from .sources import files, store
from .streaming import streams

_QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def keep(f):
        _QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.readStream.schema(_t(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")  # a pattern: a table may be one file


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return tables.latest(_t(spark, d, "chunks"), ["chunk_id"], [F.desc("ingested_at"), F.col("text")])


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "tasks").distinct()


def _valid(spark: SparkSession, d: str) -> DataFrame:
    return metrics.decoded(_t(spark, d, "query_results").where("NOT isnan(coalesce(latency_ms, 0))"))


_CASCADE = f"""{_IDX}, x AS (SELECT collection, source_path, doc_hash FROM documents WHERE doc_type IS NULL), hit AS (
  SELECT DISTINCT chunk_id, c.collection, doc_hash FROM c JOIN x ON c.collection = x.collection AND (c.metadata['source_path'] = x.source_path OR c.source_ref = x.doc_hash)
), vec AS (SELECT DISTINCT chunk_id, collection FROM chunk_records), pn AS (SELECT collection, chunk_id, count(*) AS p FROM post GROUP BY ALL)"""


@_query(f"""WITH {_CASCADE} SELECT collection, doc_hash, count(*) AS chunks, coalesce(CAST(sum(p) AS BIGINT), 0) AS postings, count(v.chunk_id) AS vectors, count(*) + coalesce(CAST(sum(p) AS BIGINT), 0) + count(v.chunk_id) AS total
FROM hit LEFT JOIN pn USING (collection, chunk_id) LEFT JOIN vec v USING (collection, chunk_id) GROUP BY collection, doc_hash""")
def cascade_totals(spark, d):
    """What goes with the documents of unknown type, from all stores."""
    return _cascade(spark, d)[1]


def _cascade(spark, d):
    chunks = _chunks(spark, d)
    vectors = _t(spark, d, "chunk_records").select("collection", "chunk_id").distinct()
    docs = _t(spark, d, "documents")
    history = docs.select("collection", F.col("doc_hash").alias("file_hash"))
    doomed = docs.where("doc_type IS NULL").select("collection", "source_path", "doc_hash")
    return tables.cascade(chunks, index.build(chunks, hold=True).postings, vectors, history, doomed)


@_query(f"""WITH {_CASCADE}, left_p AS (SELECT * FROM post ANTI JOIN hit ON hit.collection = post.collection AND hit.chunk_id = post.chunk_id)
SELECT 'chunks' AS store, (SELECT count(*) FROM c ANTI JOIN hit USING (collection, chunk_id)) AS rows UNION ALL SELECT 'postings', count(*) FROM left_p
UNION ALL SELECT 'vectors', (SELECT count(*) FROM vec ANTI JOIN hit USING (collection, chunk_id)) UNION ALL SELECT 'history', (SELECT count(*) FROM documents WHERE doc_type IS NOT NULL)""")
def cascade_left(spark, d):
    """What is left in all stores."""
    out = None
    for name, df in _cascade(spark, d)[0].items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("store"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@_query("SELECT coalesce(collection, 'default') AS collection, count(DISTINCT doc_hash) AS files, 0 AS again FROM documents GROUP BY ALL")
def ingested_twice(spark, d):
    """All documents ingested into fresh stores: files marked as done, and how many a second run finds new."""
    folder, docs = store.fresh_path(spark), _t(spark, d, "documents")
    ingest.ingest_into(docs, folder, at=0.0, steps=("refine",))
    again = ingest.ingest_into(docs, folder, at=1.0, steps=("refine",))["documents"]
    done = spark.read.schema(ingest.HISTORY).parquet(f"{folder}/history").where("status = 'success'")
    return done.groupBy("collection").agg(F.count("*").alias("files")).withColumn("again", F.lit(again))


_UUID = """h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name})) AS s FROM {table})"""
_UUID5 = "substring(s, 1, 8) || '-' || substring(s, 9, 4) || '-5' || substring(s, 14, 3) || '-' || substring('89ab', CAST('0x' || substring(s, 17, 1) AS INTEGER) % 4 + 1, 1) || substring(s, 18, 3) || '-' || substring(s, 21, 12)"


@_query(f"WITH {_UUID.format(name="'document:' || collection || ':' || source_path", table='documents')}, n AS (SELECT collection, metadata['source_path'] AS source_path, count(DISTINCT chunk_id) AS n FROM chunks GROUP BY ALL) SELECT {_UUID5} AS uuid, h.collection, h.source_path, coalesce(n, 0) AS n_chunks FROM h LEFT JOIN n ON n.collection = h.collection AND n.source_path = h.source_path")
def document_details(spark, d):
    """Every document by its UUID."""
    docs = _t(spark, d, "documents").select("collection", "source_path")
    keys = docs.select(tables.document_uuid(F.col("collection"), F.col("source_path")).alias("uuid"))
    return tables.document_detail(docs, _t(spark, d, "chunks"), keys).select("uuid", "collection", "source_path", "n_chunks")


@_query("""WITH q AS (SELECT query_id, collection, created_at, source, recorded_at FROM query_results WHERE query_id IS NOT NULL)
SELECT query_id, any_value(collection) AS collection, min(created_at) AS created_at FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, recorded_at DESC, collection) AS r, min(created_at) OVER (PARTITION BY query_id) AS first FROM q)
WHERE r = 1 GROUP BY query_id""".replace("min(created_at) AS created_at", "min(first) AS created_at"))
def upserts_keep_first_time(spark, d):
    """The first rows of the ids, then their last ones on top: the latter hold, but for the time of creation."""
    q = _t(spark, d, "query_results").where("query_id IS NOT NULL").select("query_id", "collection", "created_at", "recorded_at")
    old = tables.latest(q, ["query_id"], [F.col("created_at"), F.col("recorded_at")]).select("query_id", "collection", "created_at")
    new = tables.latest(q, ["query_id"], [F.desc("created_at"), F.desc("recorded_at"), F.col("collection")]).select("query_id", "collection", "created_at")
    return tables.upsert(old, new, ["query_id"], keep=("created_at",))


@_query(f"WITH {_EVENTS} SELECT id, occurred_at, operation FROM e")
def usage_appended(spark, d):
    """Events of the first half of the week, then all of them: the first row of an id stays."""
    e = _t(spark, d, "embedding_usage_events").where("id IS NOT NULL").select("id", "occurred_at", "operation", "token_count")
    order = [F.col("occurred_at"), F.col("operation"), F.col("token_count")]
    first = tables.latest(e, ["id"], order).where(F.col("occurred_at") < (START + END) / 2)
    return tables.insert_or_ignore(first, e, ["id"], order).select("id", "occurred_at", "operation")


@_query("""SELECT doc_id FROM documents WHERE collection IN (SELECT collection FROM query_results WHERE api_key_id = (SELECT min(api_key_id) FROM query_results))""")
def allowed_documents(spark, d):
    """Documents of the collections that the first key asked in."""
    q = _t(spark, d, "query_results").where("api_key_id IS NOT NULL")
    grants = q.select(F.col("api_key_id").alias("key_id"), "collection").distinct()
    return tables.allowed_rows(_t(spark, d, "documents"), grants, q.agg(F.min("api_key_id")).first()[0]).select("doc_id")


@_query("""WITH g AS (SELECT api_key_id AS key_id, list(DISTINCT collection) AS a FROM query_results WHERE api_key_id IS NOT NULL AND collection IS NOT NULL GROUP BY api_key_id)
SELECT key_id, CASE WHEN list_contains(a, 'plant-operations') THEN 'plant-operations' END AS asked, CASE WHEN len(a) = 1 THEN a[1] END AS only FROM g""")
def query_collections(spark, d):
    """Where the queries of each key go that name a collection, and that name none."""
    q = _t(spark, d, "query_results").where("api_key_id IS NOT NULL")
    g = q.groupBy(F.col("api_key_id").alias("key_id")).agg(F.collect_set("collection").alias("a"))
    return g.select("key_id", tables.query_collection(F.lit("plant-operations"), F.col("a")).alias("asked"), tables.query_collection(F.lit(None).cast("string"), F.col("a")).alias("only"))


@_query("SELECT task_id, filename FROM tasks WHERE contains(lower(filename), 'report') GROUP BY ALL")
def files_by_name(spark, d):
    return tables.name_search(_tasks(spark, d), "filename", " RePort ").select("task_id", "filename").distinct()


@_query("SELECT query_id, created_at FROM query_results WHERE source = 'cli' AND query_id IS NOT NULL GROUP BY ALL ORDER BY created_at DESC, query_id LIMIT 50")
def newest_queries(spark, d):
    q = _t(spark, d, "query_results").where("query_id IS NOT NULL").select("query_id", "created_at", "source").distinct()
    return tables.newest(q, "created_at", "query_id", 50, source="cli").select("query_id", "created_at")


@_query("SELECT collection FROM collections WHERE collection > (SELECT min(collection) FROM collections) ORDER BY collection LIMIT 5")
def page_after(spark, d):
    c = _t(spark, d, "collections").select("collection")
    return tables.after(c, "collection", c.agg(F.min("collection")).first()[0], tables.page_size(5))


@_query("""WITH k AS (SELECT trace_id AS query_id FROM embedding_usage_events WHERE trace_id IS NOT NULL UNION SELECT 'none')
SELECT k.query_id, count(q.query_id) AS found FROM k LEFT JOIN query_results q ON q.query_id = k.query_id GROUP BY k.query_id""")
def queries_of_traces(spark, d):
    """Rows of query results by the ids that usage events name."""
    q = _t(spark, d, "query_results").select("query_id", "created_at")
    keys = _t(spark, d, "embedding_usage_events").where("trace_id IS NOT NULL").select(F.col("trace_id").alias("query_id")).union(spark.createDataFrame([("none",)], "query_id string"))
    return tables.lookup(q, keys, ["query_id"]).groupBy("query_id").agg(F.count("created_at").alias("found"))


@_query(f"WITH {_VALID} SELECT collection, round_even(avg(latency_ms), 1) AS avg_latency_ms, round_even(avg(n_chunks), 1) AS avg_results, {_RATE.format('count(*) FILTER (succeeded)', 'count(*)')} AS success_rate FROM d GROUP BY collection")
def latency_overview(spark, d):
    return metrics.latency_overview(_valid(spark, d), ["collection"])


@_query(f"""WITH {_VALID}, s AS (SELECT collection, list_sort(list(latency_ms)) AS l, count(*) AS n FROM d GROUP BY collection)
SELECT collection, n, (l[CAST(floor((n + 1) / 2) AS INTEGER)] + l[CAST(ceil((n + 1) / 2) AS INTEGER)]) / 2 AS p50, l[greatest(1, CAST(round_even(n * 0.95::DOUBLE, 0) AS INTEGER))] AS p95, l[greatest(1, CAST(round_even(n * 0.99::DOUBLE, 0) AS INTEGER))] AS p99 FROM s""")
def benchmark_percentiles(spark, d):
    return metrics.benchmark_percentiles(_valid(spark, d), ["collection"], "latency_ms")


_ROLLUP = """n AS (SELECT collection, count(*) AS documents FROM documents GROUP BY collection), m AS (SELECT collection, count(DISTINCT chunk_id) AS chunks FROM chunks GROUP BY collection),
s AS (SELECT collection_id AS collection, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status <> 'succeeded') AS unfinished FROM t GROUP BY collection_id)"""


@_query(f"""WITH {_TASKS}, {_ROLLUP} SELECT CAST(sum(documents) AS BIGINT) AS documents, CAST(sum(chunks) AS BIGINT) AS chunks, max(updated_at) AS updated_at, CASE WHEN sum(failed) > 0 THEN 'attention' WHEN sum(unfinished) > 0 THEN 'indexing' ELSE 'ready' END AS index_status
FROM collections LEFT JOIN n USING (collection) LEFT JOIN m USING (collection) LEFT JOIN s USING (collection)""")
def corpus_rollup(spark, d):
    n = _t(spark, d, "documents").groupBy("collection").agg(F.count("*").alias("documents"))
    m = _t(spark, d, "chunks").groupBy("collection").agg(F.countDistinct("chunk_id").alias("chunks"))
    s = _tasks(spark, d).groupBy(F.col("collection_id").alias("collection")).agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") != "succeeded").alias("unfinished"))
    return metrics.corpus_rollup(_t(spark, d, "collections").select("collection", "updated_at").join(n, "collection", "left").join(m, "collection", "left").join(s, "collection", "left"))


@_query("SELECT min(occurred_at) AS earliest FROM embedding_usage_events")
def earliest_event(spark, d):
    return metrics.earliest(_t(spark, d, "embedding_usage_events"), "occurred_at")


@_query(f"WITH {_TASKS} SELECT collection_id, sum(CASE WHEN status IN ('succeeded', 'failed') THEN 100.0::DOUBLE ELSE least(100, attempt * 40) END) / count(*) AS progress FROM t GROUP BY collection_id")
def upload_progress(spark, d):
    """Tasks as uploads: attempts stand for the percentage."""
    t = _tasks(spark, d).select("collection_id", F.col("status").isin("succeeded", "failed").alias("settled"), (F.col("attempt") * 40.0).alias("percent"))
    return metrics.upload_progress(t, ["collection_id"])


@_query(f"WITH {_TASKS}, n AS (SELECT collection_id, count(*) FILTER (status = 'succeeded') AS c, count(*) AS n FROM t GROUP BY collection_id) SELECT collection_id, CAST(round_even(c * 100.0::DOUBLE / n, 0) AS INTEGER) AS progress FROM n")
def stage_progress(spark, d):
    n = _tasks(spark, d).groupBy("collection_id").agg(F.count_if(F.col("status") == "succeeded").alias("c"), F.count("*").alias("n"))
    return n.select("collection_id", metrics.stage_progress(F.col("c"), F.col("n")).alias("progress"))


@_query(f"WITH {_TASKS} SELECT collection_id, count(*) AS files, CAST(sum(length(source_path) * 1000000) AS BIGINT) AS bytes, count(*) <= 100 AND sum(length(source_path) * 1000000) <= 2147483648 AS ok FROM t GROUP BY collection_id")
def batch_limits(spark, d):
    t = _tasks(spark, d).select("collection_id", (F.length("source_path") * 1_000_000).cast("long").alias("size_bytes"))
    return tables.batch_limits(t, ["collection_id"])


@_query("SELECT collection, sum(a.n) AS rows FROM (SELECT collection, count(*) AS n FROM chunks GROUP BY collection) a WHERE collection IN (SELECT collection FROM split_profiles) GROUP BY collection".replace("sum(a.n)", "CAST(sum(a.n) AS BIGINT)"))
def names_with_counts(spark, d):
    found = tables.merged_names(_t(spark, d, "chunks").select(F.col("collection").alias("name")), _t(spark, d, "split_profiles").select(F.col("collection").alias("name")))
    return found.where("source = 'both'").select(F.col("name").alias("collection"), "rows")


@_query("SELECT id, coalesce(provider || ':' || nullif(provider_request_id, ''), 'random') AS event_id FROM embedding_usage_events WHERE id IS NOT NULL GROUP BY ALL")
def usage_event_ids(spark, d):
    e = _t(spark, d, "embedding_usage_events").where("id IS NOT NULL").withColumn("event_id", ids.event_id(F.col("provider"), F.col("provider_request_id")))
    uuid = F.col("event_id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return e.select("id", F.when(uuid, "random").otherwise(F.col("event_id")).alias("event_id")).distinct()


@_query(f"WITH {_UUID.format(name="'collection:' || collection", table='collections')}, g AS (SELECT collection, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(collection)) AS s FROM collections) SELECT h.collection, {_UUID5.replace('(s,', '(h.s,')} AS uuid, CASE WHEN regexp_matches(h.collection, '^[a-zA-Z0-9][a-zA-Z0-9._-]{{1,510}}[a-zA-Z0-9]$') THEN h.collection ELSE 'coll_' || replace({_UUID5.replace('(s,', '(g.s,')}, '-', '') END AS store FROM h JOIN g USING (collection)")
def uuid5_ids(spark, d):
    c = _t(spark, d, "collections").select("collection")
    return c.select("collection", ids.uuid5(ids.NAMESPACE_URL, F.concat(F.lit("collection:"), F.col("collection"))).alias("uuid"), ids.store_name(F.col("collection")).alias("store"))


_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIM.format('x')}), lambda x: x <> '')"


@_query(f"WITH l AS (SELECT doc_id, {_LINES}[1] AS f FROM documents) SELECT doc_id, CASE WHEN length(f) <= 80 THEN f ELSE {_TRIM.format('substring(f, 1, 79)')} || '…' END AS title FROM l")
def first_lines(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.truncate(T.first_line(F.col("text")), 80).alias("title"))


@_query(f"""WITH {_CHUNKS} SELECT chunk_id, CASE WHEN text IS NULL OR {_TRIM.format('text')} = '' THEN 'skipped' ELSE 'rule' END AS refined_by, NOT regexp_matches(coalesce(text, ''), '<!--(.|\n)*?-->') AS plain, coalesce(length(text), 0) AS n_chars FROM c""")
def refined_marks(spark, d):
    """How chunks were refined; no comment is left, and no chunk is lost or longer than before."""
    c = _chunks(spark, d)
    r = transforms.refine(c).select("chunk_id", "refined_by", F.col("text").alias("after"))
    both = c.select("chunk_id", "text").join(r, "chunk_id")
    kept = F.coalesce(F.length("after") <= F.length("text"), F.lit(True)) & ~F.coalesce(F.col("after").rlike("<!--"), F.lit(False))
    return both.select("chunk_id", "refined_by", (~F.coalesce(F.col("text").rlike(r"(?s)<!--.*?-->"), F.lit(False)) & kept).alias("plain"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


@_query(f"SELECT doc_id, TRUE AS covered, 0 AS too_long, 0 AS other_text FROM documents WHERE {_TRIM.format('text')} <> '' AND NOT regexp_matches(text, '(?i)^\\s*doc_id\\s*:\\s*\\S+\\s*$')")
def recursive_covered(spark, d):
    """Chunks of each document hold all of it that is not white space, are short enough and say what it says."""
    docs = _t(spark, d, "documents")
    pieces = chunking.split_recursive(docs.withColumns({"doc_hash": F.col("doc_id").cast("string")})).select(F.col("doc_hash").cast("long").alias("doc_id"), "start_offset", "end_offset", "text")
    both = pieces.join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id")
    before = F.lag("end_offset", 1, 0).over(Window.partitionBy("doc_id").orderBy("start_offset", "end_offset"))
    gap = F.substring("whole", F.col("before") + 1, F.greatest(F.lit(0), F.col("start_offset") - F.col("before")))
    rows = both.withColumn("before", before).select(
        "doc_id", (T.strip(gap) == "").alias("joined"), (F.length("text") > 1024).alias("long"),
        (F.col("text") != F.substring("whole", F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))).alias("other"), "end_offset", F.length(F.regexp_replace("whole", r"(?U)\s+$", "")).alias("end"),
    )
    each = rows.groupBy("doc_id").agg((F.every("joined") & (F.max("end_offset") >= F.max("end"))).alias("covered"), F.count_if("long").cast("int").alias("too_long"), F.count_if("other").cast("int").alias("other_text"))
    return each.join(docs.where(~T.is_marker(F.col("text"))).select("doc_id"), "doc_id", "left_semi")


@_query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_stream(spark, d):
    n = streams.drained(streams.tumbling(_timed(spark, d), "ts", "1 day", "1 day", ["event_type"]))
    return n.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def _timed(spark, d):
    e = _stream(spark, d, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


@_query("""WITH w AS (SELECT unnest([date_trunc('day', ts) + INTERVAL 12 HOUR * ((hour(ts) // 12)), date_trunc('day', ts) + INTERVAL 12 HOUR * ((hour(ts) // 12) - 1)]) AS s FROM events WHERE ts IS NOT NULL)
SELECT strftime(s, '%Y-%m-%d %H') AS start, count(*) AS n FROM w GROUP BY ALL""")
def sliding_stream(spark, d):
    n = streams.drained(streams.tumbling(_timed(spark, d), "ts", "1 day", "1 day", slide="12 hours"))
    return n.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "n")


@_query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_stream(spark, d):
    n = streams.drained(streams.sessions(_timed(spark, d), "ts", "1 day", "1 day", ["user_id"]))
    return n.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@_query("SELECT count(DISTINCT query_id) AS n FROM query_results WHERE query_id IS NOT NULL")
def deduplicated_stream(spark, d):
    q = _stream(spark, d, "query_results").where("query_id IS NOT NULL").withColumn("at", F.timestamp_seconds("created_at"))
    return streams.drained(streams.deduplicated(q, "query_id", "at", "4000 days").select("query_id"), "append").agg(F.count("*").alias("n"))


@_query(f"WITH {_IDX} SELECT collection, term, df, round(idf, 6) AS idf FROM terms")
def index_from_stream(spark, d):
    path = store.fresh_path(spark)
    c = _stream(spark, d, "chunks").select("collection", "chunk_id", "text")
    streams.index_stream(c, path, f"{path}-state").awaitTermination()
    return index.load(spark, path).terms.withColumn("idf", F.round("idf", 6))


@_query(f"""WITH {_TASKS} SELECT collection_id, source_path, task_id, status FROM (
  SELECT *, row_number() OVER (PARTITION BY collection_id, source_path ORDER BY created_at DESC, attempt DESC, updated_at DESC, task_id, status) AS rn FROM t) WHERE rn = 1""")
def task_state_stream(spark, d):
    """The latest task of each file, kept by a stream."""
    path = store.fresh_path(spark)
    t = _stream(spark, d, "tasks").select("collection_id", "source_path", "task_id", "status", "created_at", "updated_at", "attempt")
    order = [F.desc("created_at"), F.desc("attempt"), F.desc("updated_at"), F.col("task_id"), F.col("status")]
    streams.upsert_stream(t, path, ["collection_id", "source_path"], order, f"{path}-state").awaitTermination()
    return spark.read.schema(t.schema).parquet(path).select("collection_id", "source_path", "task_id", "status")


@_query("""WITH f AS (SELECT chunk_id, metadata AS m FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC, text) AS rn FROM chunks) WHERE rn = 1)
SELECT chunk_id, 'md' AS doc_type, m['source_path'] AS source_path, CAST(len(list_filter(map_entries(m), lambda e: e.value IS NOT NULL AND e.value <> '')) AS INTEGER) AS kept FROM f""")
def merged_filters(spark, d):
    """A chunk's metadata as filters found in a query, with one given by the caller, who wins; and what sanitising keeps."""
    m = retrieval.merged_filters(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.create_map(F.lit("doc_type"), F.lit("md")))
    return _chunks(spark, d).select("chunk_id", F.try_element_at(m, F.lit("doc_type")).alias("doc_type"), F.try_element_at(m, F.lit("source_path")).alias("source_path"), F.coalesce(F.size(F.map_keys(tables.sanitised_metadata(F.col("metadata")))), F.lit(0)).alias("kept"))


@_query(f"""WITH {_CHUNKS} SELECT source_ref, count(*) AS n_chunks, arg_min(text, chunk_index) AS first_text FROM c WHERE source_ref IS NOT NULL GROUP BY source_ref""")
def document_summaries(spark, d):
    return responses.document_summary(_chunks(spark, d).where("source_ref IS NOT NULL")).select("source_ref", "n_chunks", "first_text")


def queries() -> dict:
    return dict(_QUERIES)
