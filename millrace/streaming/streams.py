"""Streams of events, results and files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators import index, tables
from ..sources import files, store


def deduplicated(events: DataFrame, id_col: str, time_col: str, delay: str = "7 days") -> DataFrame:
    """Events once for each id; repeats later than ``delay`` may come through."""
    return events.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])


def tumbling(events: DataFrame, time_col: str, width: str, delay: str, keys: list[str] = (), slide: str | None = None) -> DataFrame:
    """Number of events in (sliding, if ``slide`` is given) windows; rows later than ``delay`` are dropped by the watermark."""
    w = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    n = events.withWatermark(time_col, delay).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"))
    return n.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, time_col: str, gap: str, delay: str, keys: list[str]) -> DataFrame:
    n = events.withWatermark(time_col, delay).groupBy(F.session_window(time_col, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return n.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def drained(rows: DataFrame, mode: str = "complete") -> DataFrame:
    """Everything a stream has, as the table that its last batch left (``complete``) or all batches together (``append``)."""
    spark = rows.sparkSession
    path = store.fresh_path(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    rows.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


def upsert_stream(rows: DataFrame, path: str, keys: list[str], order: list[Column], checkpoint: str, parts: int = 16) -> StreamingQuery:
    """Write a stream into a table that keeps the first row of each key in ``order``; a batch run twice changes nothing more.

    The table lies in ``parts`` parts by key; only those a batch has rows of are written anew.
    """
    spark = rows.sparkSession
    schema = StructType([*rows.schema.fields, StructField("part", IntegerType())])

    def merge(batch: DataFrame, number: int) -> None:
        fresh = store.cut_lineage(tables.latest(batch, keys, order).withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")))
        touched = [r[0] for r in fresh.select("part").distinct().collect()]
        if not touched:
            return
        try:
            fresh = spark.read.schema(schema).parquet(path).where(F.col("part").isin(touched)).unionByName(fresh)
        except AnalysisException:
            pass  # the first batch
        files.write_table(store.cut_lineage(tables.latest(fresh, keys, order)), path, "part")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_stream(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Merge a stream of chunks (collection, chunk_id, text) into the stored index at a path; a chunk that comes again takes its own place."""

    def merge(batch: DataFrame, number: int) -> None:
        one = batch.dropDuplicates(["collection", "chunk_id"])
        if not one.isEmpty():
            index.merge_or_build(batch.sparkSession, path, one)

    return chunks.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Calls a function with each batch's number, rows and seconds."""

    def __init__(self, told: Callable[[int, int, float], None]):
        self.told = told

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.told(p.batchId, p.numInputRows, p.batchDuration / 1000)

    def onQueryTerminated(self, event) -> None: ...
