"""The problems' queries, bound to the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encode, knn, neardup, packing, quantiles, scans, split, subjects
from .sql import SQL


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    cut = split.split_oversized(_table(spark, folder, "documents"), _table(spark, folder, "split_profiles"))
    return cut.select("doc_id", "finest_cut").distinct()


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    cut = split.split_oversized(_table(spark, folder, "documents"), _table(spark, folder, "split_profiles"))
    return split.pieces_table(cut)


def p1_covered(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the pieces of each text: they reach from its start to its end, are short enough and say what it says."""
    documents, profiles = _table(spark, folder, "documents").select("doc_id", "collection", "text").distinct(), _table(spark, folder, "split_profiles")
    pieces = split.split_oversized(documents, profiles).select("doc_id", "pieces")
    rules = profiles.where("max_chars >= 1").groupBy("collection").agg(F.min("max_chars").alias("most"))
    texts = documents.join(rules, "collection", "left")
    default = rules.where("collection = 'default'").first()["most"]
    both = pieces.join(texts, "doc_id").withColumn("most", F.coalesce("most", F.lit(default)))
    count = lambda test: F.size(F.filter("pieces", test))
    before = F.concat(F.array(F.lit(0)), F.transform("pieces", lambda p: p.end_offset))
    return both.select(
        "doc_id", F.element_at("pieces", -1).end_offset.cast("long").alias("n_chars"),
        F.size(F.filter(F.zip_with(F.transform("pieces", lambda p: p.start_offset), before, lambda a, b: a > b), lambda x: x)).alias("gaps"),
        count(lambda p: F.length(p.text) > F.col("most")).alias("too_long"),
        count(lambda p: p.text != F.substring("text", p.start_offset + 1, p.end_offset - p.start_offset)).alias("other_text"),
    ).distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.noisy_lines(_table(spark, folder, "documents"))


def p2_texts(spark: SparkSession, folder: str) -> DataFrame:
    return scans.repaired_texts(_table(spark, folder, "documents"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return knn.similar_pairs(_table(spark, folder, "chunk_records"))


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return knn.nearest(_table(spark, folder, "chunk_records"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.alike_pairs(_table(spark, folder, "chunks"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.alike_groups(_table(spark, folder, "chunks"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return quantiles.slow_weeks(_table(spark, folder, "query_results"), _table(spark, folder, "latency_targets"))


def p5_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    values = quantiles.latest_latencies(_table(spark, folder, "query_results"))
    daily = quantiles.digests(values, ["collection", "day"], "latency_ms")
    weekly = quantiles.merge(daily.withColumn("week", quantiles.week_of(daily.day)), ["collection", "week"])
    return quantiles.percentiles(weekly, ["collection", "week"], _table(spark, folder, "latency_targets"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode_corpus(_table(spark, folder, "documents"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    sizes = encode.encode_corpus(_table(spark, folder, "documents"), counts_only=True)
    return packing.pack(sizes, _table(spark, folder, "context_windows"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.subjects_of(_table(spark, folder, "documents"), _table(spark, folder, "subjects"), _table(spark, folder, "subject_labels"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each collection and how many of them are about each subject."""
    documents = _table(spark, folder, "documents")
    found = p8_found(spark, folder).join(documents.select("doc_id", "collection"), "doc_id")
    sizes = documents.groupBy("collection").agg(F.count("*").alias("documents"))
    counts = found.groupBy("collection", "subject").agg(F.count("*").alias("about"))
    same = F.col("c.collection").eqNullSafe(F.col("s.collection"))
    return counts.alias("c").join(sizes.alias("s"), same).select("c.collection", "subject", "about", "documents", (F.col("about") / F.col("documents")).alias("share"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [p1_found, p1_pieces, p1_covered, p2_found, p2_texts, p3_found, p3_neighbours, p4_found, p4_groups, p5_found, p5_quantiles, p6_ids, p7_containers, p8_found, p8_shares]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
