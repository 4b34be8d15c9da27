"""Ingestion from documents to chunks and index tables, and search over them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, evaluate, index, retrieval, tables, transforms
from ..sources import files, store

#: Hooks by kind and name: functions from DataFrame to DataFrame.
REGISTRY: dict[str, dict[str, Callable]] = {
    "splitter": {"recursive": chunking.chunk_documents, "fixed_length": chunking.fixed_length},
    "reranker": {"lexical": retrieval.lexical_scores},
    "transform": {"refine": transforms.refine, "enrich": transforms.enrich},
    "fusion": {"rrf": retrieval.fuse},
    "evaluator": {"golden": evaluate.evaluate},
    "embedding": {},
}


def register(kind: str, name: str, function: Callable) -> None:
    REGISTRY.setdefault(kind, {})[name] = function


def provider(kind: str, name: str | Callable) -> Callable:
    """The function registered under a name; a function stands for itself."""
    if callable(name):
        return name
    if name not in REGISTRY.get(kind, {}):
        raise ValueError(f"no {kind} {name!r}; there are {providers(kind)}")
    return REGISTRY[kind][name]


def providers(kind: str) -> list[str]:
    return sorted(REGISTRY.get(kind, {}))


def ingest(documents: DataFrame, history: DataFrame | None = None, *, size: int = 1024, overlap: int = 200, refine: bool = True) -> DataFrame:
    """Chunks of the documents whose hash the history (collection, file_hash, status) does not have as a success."""
    fresh = documents
    if history is not None:
        fresh = tables.new_files(documents.withColumn("file_hash", F.col("doc_hash")), history).drop("file_hash")
    chunks = chunking.chunk_documents(fresh, size=size, overlap=overlap)
    return transforms.refine(chunks) if refine else chunks


def embedded(chunks: DataFrame, model: Callable[[DataFrame], DataFrame], width: int | None = None) -> DataFrame:
    """Chunks with the ``dense_vector`` that a model gives them (chunk_id, dense_vector); a missing one, or one of another width, is an error."""
    vectors = model(chunks).select("chunk_id", "dense_vector")
    joined = chunks.join(vectors, "chunk_id", "left")
    size = F.size("dense_vector")
    wrong = F.col("dense_vector").isNull() | (size != F.lit(width) if width else size < 1)
    return joined.withColumn("dense_vector", F.when(wrong, F.raise_error(F.concat(F.lit("no usable vector of chunk "), "chunk_id"))).otherwise(F.col("dense_vector")))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


HISTORY = "file_hash string, status string, updated_at double, collection string"
VECTORS = "chunk_id string, dense_vector array<float>, collection string"


def ingest_into(
    documents: DataFrame,
    folder: str,
    *,
    at: float,
    splitter: str | Callable = "recursive",
    steps: tuple[str | Callable, ...] = ("refine", "enrich"),
    embedding: str | Callable | None = None,
    width: int | None = None,
) -> dict[str, int]:
    """Bring documents into the stores of a folder: chunks, index, vectors and history. Returns how many were new and what was written.

    Documents whose hash the history has as a success are skipped, so running
    it twice is running it once. Vectors are written before the index, success
    is marked last; a document without chunks is a success too. What fails is
    marked as failed and raised again.
    """
    spark = documents.sparkSession
    history = _read(spark, f"{folder}/history", HISTORY)
    hashed = documents.withColumn("file_hash", F.col("doc_hash")).withColumn("collection", F.coalesce("collection", F.lit("default")))
    fresh = store.cut_lineage(tables.new_files(hashed, history))
    new = fresh.select("collection", "file_hash").distinct()
    count = new.count()
    if not count:
        return {"documents": 0, "chunks": 0}
    try:
        chunks = provider("splitter", splitter)(fresh)
        for step in steps:
            chunks = provider("transform", step)(chunks)
        chunks = store.cut_lineage(chunks)
        if embedding:
            vectors = embedded(chunks, provider("embedding", embedding), width).select("chunk_id", "dense_vector", "collection")
            touched = vectors.select("collection").distinct()
            old = _read(spark, f"{folder}/vectors", VECTORS).join(touched, "collection", "left_semi")
            files.write_table(store.cut_lineage(tables.upsert(old, vectors, ["collection", "chunk_id"])), f"{folder}/vectors")
        files.write_table(chunks.select("chunk_id", "collection", "text", "source_ref", "metadata").withColumn("source", F.col("source_ref")), f"{folder}/chunks/{uuid.uuid4().hex}")
        index.merge_or_build(spark, f"{folder}/index", chunks)
        status = "success"
    except Exception:
        _mark(spark, folder, history, new, "failed", at)
        raise
    _mark(spark, folder, history, new, status, at)
    return {"documents": count, "chunks": chunks.count()}


def _mark(spark: SparkSession, folder: str, history: DataFrame, new: DataFrame, status: str, at: float) -> None:
    marked = store.cut_lineage(tables.marked(history, new, status, at))
    files.write_table(marked, f"{folder}/history")


def search(chunks: DataFrame, vectors: DataFrame | None, queries: DataFrame, *, top_k: int = 5, mode: str = "hybrid", where: dict[str, str] | None = None, fusion: str | Callable = "rrf") -> DataFrame:
    """Search by mode: sparse, dense or (also for unknown names) hybrid; each leg fetches twice as many.

    ``where`` filters by the chunks' metadata: dense vectors before ranking,
    hybrid results after it.
    """
    fetch = max(1, 2 * top_k)
    if mode == "sparse":
        return retrieval.sparse(index.build(chunks), queries, top_k)
    if where and vectors is not None:
        vectors = retrieval.metadata_filter(vectors, chunks, where)
    asked = queries.where("query_vector IS NOT NULL") if "query_vector" in queries.columns else None
    if mode == "dense":
        return retrieval.dense(vectors, asked, top_k).select(*retrieval.RESULT)
    s = retrieval.sparse(index.build(chunks), queries, fetch)
    d = retrieval.dense(vectors, asked, fetch)
    other = None if fusion == "rrf" else provider("fusion", fusion)
    return retrieval.hybrid(s, d, top_k, fusion=other, post_filter=(lambda r: retrieval.metadata_filter(r, chunks, where)) if where else None)
