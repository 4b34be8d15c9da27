"""Chunk transforms: refining, image filters, captions and enrichment. None of them drops a chunk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def refine(chunks: DataFrame, model: Callable[[Column], Column] | None = None, least_change: float = 0.0) -> DataFrame:
    """Text cleaned by rules (and by a model's column function, where that changes enough of it), with ``refined_by`` and ``refine_reason``."""
    blank = F.col("text").isNull() | (T.strip(F.col("text")) == "")
    by_rule = T.clean(F.col("text"))
    said = model(by_rule) if model else F.lit(None).cast("string")
    better = F.when(T.changed_enough(by_rule, said, least_change), said)
    reason = F.when(blank, "blank").when(said.isNull(), "no answer" if model else "rules only").when(better.isNull(), "too little changed")
    return chunks.withColumns(
        {
            "refine_reason": reason,
            "refined_by": F.when(blank, "skipped").when(better.isNotNull(), "llm").otherwise("rule"),
            "text": F.when(blank, F.col("text")).otherwise(F.coalesce(better, by_rule)),
        }
    )


def tags(chunks: DataFrame, top: int = 5) -> DataFrame:
    """``chunk_id, tags``: the most frequent words of each chunk, the earlier one first on ties."""
    words = chunks.select("chunk_id", F.posexplode(T.tag_tokens(F.col("text"))).alias("at", "term"))
    counted = words.groupBy("chunk_id", "term").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    w = Window.partitionBy("chunk_id").orderBy(F.desc("n"), "first")
    best = counted.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    return best.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x.term).alias("tags"))


def enrich(chunks: DataFrame, top: int = 5) -> DataFrame:
    """Chunks with title, summary and tags."""
    found = chunks.join(tags(chunks, top), "chunk_id", "left")
    return found.withColumns(
        {
            "title": F.coalesce(T.truncate(T.first_line(F.col("text")), 80), F.lit("")),
            "summary": F.coalesce(T.summary(F.col("text")), F.lit("")),
            "tags": F.coalesce("tags", F.array().cast("array<string>")),
        }
    )


def image_reasons(images: DataFrame, least: int = 40, least_share: float = 0.005) -> DataFrame:
    """Images (doc, seq, width, height, page_area, sha) with the reason to leave them out: small, then seen earlier in the document."""
    small = (F.col("width") < least) | (F.col("height") < least) | (F.col("width") * F.col("height") / F.col("page_area") < least_share)
    w = Window.partitionBy("doc", "sha", small).orderBy("seq")
    return images.withColumn("reason", F.when(small, "size").when(F.row_number().over(w) > 1, "duplicate"))


def caption(images: DataFrame, model: Callable[[Column], Column] | None = None, most: int = 500) -> DataFrame:
    """Images (image_id) with a ``caption`` (at most ``most`` characters) and why there is none (``skipped``)."""
    said = model(F.col("image_id")) if model else F.lit(None).cast("string")
    text = F.when(F.trim(said) != "", T.truncate(said, most))
    return images.withColumn("caption", text).withColumn("skipped", F.when(text.isNull(), "no answer" if model else "no model"))


def content_images(images: Column) -> Column:
    """Images of an array of structs that are not marked as decoration."""
    return F.filter(images, lambda x: F.coalesce(x.is_content, F.lit(True)))


def mentioned_images(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """``chunk_id, image_refs``: images (source_ref, image_id) of the chunk's document that its text mentions, in order, once."""
    m = chunks.select("chunk_id", "source_ref", F.posexplode(T.image_mentions(F.col("text"))).alias("at", "image_id"))
    hit = m.join(images.select("source_ref", "image_id").distinct(), ["source_ref", "image_id"]).groupBy("chunk_id", "image_id").agg(F.min("at").alias("at"))
    return hit.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "image_id"))), lambda x: x.image_id).alias("image_refs"))


PIPELINE: list[Callable[[DataFrame], DataFrame]] = [refine, enrich]
