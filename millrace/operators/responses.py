"""Responses, recorded results and traces built from retrieval results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids

#: Events of a trace that mean a degraded answer. Fixed values.
DEGRADED_EVENTS = ["dense_failed", "sparse_failed", "no_results", "embedding_error", "store_error", "query_error", "index_missing"]
#: MIME types by file ending. Fixed values.
MIME_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp"}


def content_blocks(cited: DataFrame, images: DataFrame) -> DataFrame:
    """``query_id, number, blocks``: a text block for each citation (``excerpt``, ``image_refs``), then one for each of its images found.

    ``images`` are ``image_id, path, content``; the bytes come as base64.
    """
    ending = F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1))
    mime = F.coalesce(*[F.when(ending == k, v) for k, v in MIME_TYPES.items()], F.lit("application/octet-stream"))
    known = images.select("image_id", mime.alias("mime"), F.base64("content").alias("data"))
    wanted = cited.select("query_id", "number", F.posexplode("image_refs").alias("at", "image_id"))
    found = wanted.join(known, "image_id").groupBy("query_id", "number").agg(F.array_sort(F.collect_list(F.struct("at", "mime", "data"))).alias("found"))
    text = F.array(F.struct(F.lit("text").alias("kind"), F.lit(None).cast("string").alias("mime"), F.col("excerpt").alias("data")))
    blocks = F.concat(text, F.coalesce(F.transform("found", lambda x: F.struct(F.lit("image").alias("kind"), x.mime.alias("mime"), x.data.alias("data"))), F.array()))
    return cited.join(found, ["query_id", "number"], "left").select("query_id", "number", blocks.alias("blocks"))


def recorded(cited: DataFrame, queries: DataFrame, created_at: float, source: str = "web_api") -> tuple[DataFrame, DataFrame]:
    """Rows for the tables of results and of citations (query_id, document_id), the documents as UUIDs, each once."""
    document = ids.uuid5(ids.NAMESPACE_URL, F.concat(F.lit("document:"), F.col("collection"), F.lit(":"), F.col("cited")))
    rows = cited.join(queries.select("query_id", "collection", "query_text"), "query_id").withColumn("document_id", document)
    one = F.struct("number", "chunk_id", "score", "cited", "page")
    results = rows.groupBy("query_id", "collection", "query_text").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("result_json"), F.lit(created_at).alias("created_at"), F.lit(source).alias("source"))
    return results, rows.select("query_id", "document_id", F.lit(created_at).alias("created_at")).distinct()


def last_query(citations: DataFrame) -> DataFrame:
    """``document_id, query_id`` of the latest query that cited each document; the greater id on ties."""
    return citations.groupBy("document_id").agg(F.max(F.struct("created_at", "query_id")).alias("m")).select("document_id", "m.query_id")


def degraded_events(stages: Column) -> Column:
    """Names of the events of a trace's stages that mean a degraded answer, in order, each once."""
    return F.array_distinct(F.filter(F.transform(stages, lambda s: s.event), lambda e: e.isin(DEGRADED_EVENTS)))


def timed_stages(stages: Column) -> Column:
    """Stages that have an elapsed time."""
    return F.filter(stages, lambda s: s.elapsed_ms.isNotNull())


def recalled(stages: Column, name: str) -> Column:
    """Number of results of the last ``finish`` event of a stage; null if there is none."""
    hits = F.filter(stages, lambda s: (s["name"] == name) & (s.event == "finish"))
    return F.try_element_at(hits, F.lit(-1)).n_out


def log_lines(rows: DataFrame, extra: list[str]) -> DataFrame:
    """``line``: JSON with ts, level, logger and message, then further columns, which cannot take those names."""
    kept = [c for c in extra if c not in ("ts", "level", "logger", "message")]
    return rows.select(F.to_json(F.struct(ids.wire_time(F.col("created")).alias("ts"), "level", "logger", "message", *kept)).alias("line"))


def document_summary(chunks: DataFrame) -> DataFrame:
    """``source_ref, n_chunks, first_text, metadata`` of each document: its chunks counted, the first one shown."""
    first = F.min_by(F.struct("text", "metadata"), "chunk_index")
    return chunks.groupBy("source_ref").agg(F.countDistinct("chunk_id").alias("n_chunks"), first.alias("f")).select("source_ref", "n_chunks", F.col("f.text").alias("first_text"), F.col("f.metadata").alias("metadata"))
