"""Quality of retrieval against golden ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(results: DataFrame, golden: DataFrame) -> DataFrame:
    """``query_id, hit_rate, mrr, precision, recall`` of results (query_id, chunk_id, rank) for every query with results or golden ids (query_id, chunk_id).

    Repeated results count each time (recall may exceed 1); empty results or golden sets give 0.
    """
    truth = golden.select("query_id", "chunk_id", F.lit(1).alias("hit")).distinct()
    size = golden.groupBy("query_id").agg(F.countDistinct("chunk_id").alias("golden"))
    got = results.select("query_id", "chunk_id", "rank").join(truth, ["query_id", "chunk_id"], "left")
    each = got.groupBy("query_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    zero = F.lit(0.0)
    return each.join(size, "query_id", "full_outer").select(
        "query_id",
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit_rate"),
        F.coalesce(1 / F.col("first"), zero).alias("mrr"),
        F.coalesce(F.try_divide(F.col("hits"), F.col("n")), zero).alias("precision"),
        F.coalesce(F.try_divide(F.col("hits"), F.col("golden")), zero).alias("recall"),
    )


def mean_scores(each: DataFrame) -> DataFrame:
    names = ["hit_rate", "mrr", "precision", "recall"]
    return each.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("m")).groupBy("m.metric").agg(F.avg("m.value").alias("value"))
