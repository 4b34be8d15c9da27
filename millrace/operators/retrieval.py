"""Batch retrieval: sparse, dense and hybrid search, fusion, filters, reranking and citations.

Queries come as DataFrames and results leave as ``query_id, chunk_id, rank,
score, source``.  Scores are rounded to 8 digits before ranking, so that ties
do not depend on the order of additions; ties go to the smaller chunk_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from . import blocks
from .index import Index, weights

RESULT = ["query_id", "chunk_id", "rank", "score", "source"]


def _top(scored: DataFrame, top_k: int, source: str, order: list[Column] | None = None) -> DataFrame:
    order = order or [F.col("score").desc(), F.col("chunk_id")]
    w = Window.partitionBy("query_id").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top_k).withColumn("source", F.lit(source))


def sparse(index: Index, queries: DataFrame, top_k: int, stop_words: list[str] | None = None) -> DataFrame:
    """BM25 over an index; queries are ``query_id, collection, query_text``. A term repeated in a query counts as often."""
    if top_k <= 0:
        return queries.sparkSession.createDataFrame([], "query_id string, chunk_id string, rank long, score double, source string")
    terms = (
        queries.select("query_id", "collection", F.explode(T.index_tokens(F.col("query_text"), stop_words)).alias("term"))
        .groupBy("query_id", "collection", "term")
        .agg(F.count("*").alias("qtf"))
    )
    # postings get their weights before they meet the queries: a posting is weighted once, not once a query
    scored = blocks.sparse_products(weights(index, terms.select("collection", "term").distinct()), index.lengths, terms, queries, top_k)
    return _top(scored, top_k, "sparse").select(*RESULT)


def dense(vectors: DataFrame, queries: DataFrame, top_k: int, metric: str = "l2sq", where: dict[str, str] | None = None) -> DataFrame:
    """Exact search: ``queries(query_id, collection, query_vector)`` against ``vectors(collection, chunk_id, dense_vector)`` of the same collection.

    ``where`` keeps vectors whose columns equal the values, before ranking. The
    score is 1 - distance, not below 0; ranks follow the distance.
    """
    for name, value in (where or {}).items():
        vectors = vectors.where(F.col(name) == value)
    if metric not in V.METRICS:
        raise ValueError(f"metric must be one of {sorted(V.METRICS)}")
    items = vectors.select("collection", "chunk_id", F.col("dense_vector").alias("v")).where("v IS NOT NULL")
    asked = queries.select("collection", "query_id", F.col("query_vector").alias("v")).where("v IS NOT NULL")
    scored = blocks.dense_products(items, asked, max(top_k, 0), metric) if top_k > 0 else queries.sparkSession.createDataFrame([], "query_id string, chunk_id string, distance double")
    scored = scored.withColumn("score", V.score_of_distance(F.col("distance")))
    return _top(scored, top_k, "dense", [F.col("distance"), F.col("chunk_id")]).select(*RESULT, "distance")


def _positions(rankings: list[DataFrame]) -> DataFrame:
    """The lists one after the other, with the number of the list and the position in it."""
    every = None
    for leg, r in enumerate(rankings):
        one = r.select(*RESULT, F.lit(leg).alias("leg"))
        every = one if every is None else every.unionByName(one)
    w = Window.partitionBy("query_id", "leg").orderBy("rank")
    return every.withColumn("position", F.row_number().over(w))


def fuse(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion by position in each list."""
    if k < 1:
        raise ValueError("k must be at least 1")
    scored = _positions(rankings).groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / (k + F.col("position"))), 8).alias("score"))
    return _top(scored, 2**31 - 1, "fusion").select(*RESULT)


def hybrid(
    sparse_hits: DataFrame,
    dense_hits: DataFrame,
    top_k: int,
    k: int = 60,
    post_filter: Callable[[DataFrame], DataFrame] | None = None,
    fusion: Callable[[list[DataFrame], int], DataFrame] | None = None,
) -> DataFrame:
    """Fusion where both legs found something; where one did, its results as they are. Filtered after fusion, ranks kept.

    Each leg is used once: rows are fused by query and chunk in one aggregate,
    and a query with one leg keeps what that leg said.  Another ``fusion`` of
    lists takes the place of reciprocal ranks.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    both = F.max("leg").over(Window.partitionBy("query_id")) > F.min("leg").over(Window.partitionBy("query_id"))
    rows = _positions([sparse_hits, dense_hits]).withColumn("both", both)
    if fusion:
        fused = fusion([rows.where(F.col("both") & (F.col("leg") == leg)).select(*RESULT) for leg in (0, 1)], k)
        out = fused.unionByName(rows.where(~F.col("both")).select(*RESULT))
    else:
        fused = F.round(F.sum(1 / (k + F.col("position"))), 8)
        each = rows.groupBy("query_id", "chunk_id", "both").agg(fused.alias("fused"), *[F.min(c).alias(c) for c in ("rank", "score", "source")])
        score = F.when(F.col("both"), F.col("fused")).otherwise(F.col("score"))
        order = [F.when(F.col("both"), F.lit(0)).otherwise(F.col("rank")), score.desc(), F.col("chunk_id")]
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long")
        out = each.select("query_id", "chunk_id", F.when(F.col("both"), place).otherwise(F.col("rank")).alias("rank"), score.alias("score"), F.when(F.col("both"), "fusion").otherwise(F.col("source")).alias("source"))
    if post_filter:
        out = post_filter(out)
    w = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    return out.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= top_k).select(*RESULT)


def leg_counts(sparse_hits: DataFrame, dense_hits: DataFrame, fused: DataFrame) -> DataFrame:
    """``query_id, sparse_count, dense_count, fused_count, degraded``: what each leg and the fusion found; degraded where one leg found nothing."""
    every = None
    for name, hits in (("sparse", sparse_hits), ("dense", dense_hits), ("fused", fused)):
        one = hits.select("query_id", F.lit(name).alias("leg"))
        every = one if every is None else every.unionByName(one)
    n = {name: F.count_if(F.col("leg") == name) for name in ("sparse", "dense", "fused")}
    return every.groupBy("query_id").agg(*[v.alias(f"{k}_count") for k, v in n.items()], ((n["sparse"] == 0) | (n["dense"] == 0)).alias("degraded"))


def metadata_filter(results: DataFrame, chunks: DataFrame, where: dict[str, str]) -> DataFrame:
    """Results whose chunk's metadata has all the values; a missing key is no match."""
    ok = chunks
    for name, value in where.items():
        ok = ok.where(F.try_element_at("metadata", F.lit(name)) == value)
    return results.join(ok.select("chunk_id").distinct(), "chunk_id", "left_semi").select(*results.columns)


def query_filters(text: Column) -> tuple[Column, Column]:
    """(filters, rest) of a query: ``key:value`` tokens as a map (the last of a key holds) and the other tokens."""
    pattern = r"^([A-Za-z_][A-Za-z0-9_]*):(.+)$"
    tokens = F.filter(F.split(T.strip(text), r"(?U)\s+"), lambda x: x != "")
    found = F.filter(tokens, lambda x: x.rlike(pattern))
    keys = F.transform(found, lambda x: F.regexp_extract(x, pattern, 1))
    last = F.filter(
        F.transform(found, lambda x, i: F.struct(F.regexp_extract(x, pattern, 1).alias("k"), F.regexp_extract(x, pattern, 2).alias("v"), i.alias("i"))),
        lambda e: ~F.array_contains(F.slice(keys, e.i + 2, F.size(keys)), e.k),
    )
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e.k, e.v))), F.filter(tokens, lambda x: ~x.rlike(pattern))


def merged_filters(found: Column, given: Column) -> Column:
    """Filters found in a query with those the caller gives, who wins."""
    return F.map_concat(F.map_filter(found, lambda k, v: ~F.array_contains(F.map_keys(given), k)), given)


def rerank(results: DataFrame, scores: DataFrame, top_m: int) -> DataFrame:
    """Results with their first ``top_m`` ordered by new scores (query_id, chunk_id, new_score); ranks start at 0.

    Of several scores for one chunk the greatest holds. Scores are clamped to [0, 1]; ties keep their order. Rows of the head
    without a score follow the scored ones, then the tail, both as they were.
    """
    if top_m <= 0:
        raise ValueError("top_m must be positive")
    w = Window.partitionBy("query_id").orderBy("rank")
    best = scores.groupBy("query_id", "chunk_id").agg(F.max("new_score").alias("new_score"))
    placed = results.withColumn("__at", F.row_number().over(w)).join(best, ["query_id", "chunk_id"], "left")
    head = F.col("__at") <= top_m
    part = F.when(head & F.col("new_score").isNotNull(), 0).when(head, 1).otherwise(2)
    new = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("new_score"))), 8)
    order = Window.partitionBy("query_id").orderBy("__part", F.when(F.col("__part") == 0, new).desc_nulls_last(), "__at")
    return placed.withColumn("__part", part).select(
        "query_id",
        "chunk_id",
        (F.row_number().over(order) - 1).cast("long").alias("rank"),
        F.when(F.col("__part") == 0, new).otherwise(F.col("score")).alias("score"),
        F.when(F.col("__part") == 0, F.lit("rerank")).otherwise(F.col("source")).alias("source"),
    )


def lexical_scores(results: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Share of a query's distinct terms that a chunk has: a scorer without a model for :func:`rerank`."""
    q = queries.select("query_id", F.array_distinct(T.index_tokens(F.col("query_text"))).alias("q"))
    c = chunks.select("chunk_id", F.array_distinct(T.index_tokens(F.col("text"))).alias("c"))
    pairs = results.select("query_id", "chunk_id").join(q, "query_id").join(c, "chunk_id")
    return pairs.select("query_id", "chunk_id", F.coalesce(F.try_divide(F.size(F.array_intersect("q", "c")), F.size("q")), F.lit(0.0)).alias("new_score"))


def citations(results: DataFrame, chunks: DataFrame, most: int = 200) -> DataFrame:
    """Results with a number from 1, source, page and excerpt; hits whose chunk is gone are left out, ranks keep the gap."""
    m = F.col("metadata")
    pick = lambda k: F.nullif(F.try_element_at(m, F.lit(k)), F.lit(""))
    rows = results.join(chunks.select("chunk_id", "text", "metadata"), "chunk_id")
    w = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    return rows.select(
        "query_id",
        F.row_number().over(w).cast("long").alias("number"),
        "chunk_id",
        "rank",
        "score",
        "source",
        F.coalesce(pick("source_path"), pick("source"), F.lit("(no source)")).alias("cited"),
        F.coalesce(pick("page_num").try_cast("int"), pick("page").try_cast("int")).alias("page"),
        T.truncate(T.strip(F.col("text")), most).alias("excerpt"),
    )


def markdown_references(cited: DataFrame) -> DataFrame:
    """``query_id, body``: the citations of a query as a Markdown list in order."""
    score = (F.floor(F.col("score") * 10000 + 0.5) / 10000).cast("decimal(20,4)").cast("string")
    line = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), F.col("cited"), F.lit(" (score: "), score, F.lit(")"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("number"), line.alias("line"))))
    return cited.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x.line), "\n").alias("body"))
