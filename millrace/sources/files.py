"""Documents, traces and tables from files, and back."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRACE = "trace_id string, trace_type string, started_at double, finished_at double, stages array<struct<name:string,ts:double,event:string,elapsed_ms:double,n_out:int>>, metadata map<string,string>"


def read_files(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """``path, content`` of the files below a path whose suffix (in any case) is among those given."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*suffixes)).select("path", "content")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """``doc_hash, source_path, title, text, doc_type, heading_outline`` of Markdown files.

    Files that :func:`markdown_rejects` lists are left out; a byte order mark is
    dropped and line ends become LF. The title is the first heading of level 1,
    else the file's name.
    """
    files = read_files(spark, path, (".md", ".markdown")).where(F.is_valid_utf8(F.col("content").cast("string")))
    text = F.regexp_replace(F.regexp_replace(F.decode("content", "utf-8"), "^﻿", ""), r"\r\n?", "\n")
    rows = files.select("path", F.substring(F.sha2("content", 256), 1, 16).alias("doc_hash"), text.alias("text"))
    rows = rows.where((F.instr("text", "\u0000") == 0) & (F.regexp_replace("text", r"\s", "") != ""))
    outline = heading_outline(F.col("text"))
    first = F.try_element_at(F.filter(outline, lambda h: h.level == 1), F.lit(1))
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    return rows.select("doc_hash", F.col("path").alias("source_path"), F.coalesce(first["text"], stem).alias("title"), "text", F.lit("markdown").alias("doc_type"), outline.alias("heading_outline"))


def markdown_rejects(spark: SparkSession, path: str) -> DataFrame:
    """``path, reason`` of the Markdown files that can't be read as text: bytes that are no UTF-8, NUL bytes, nothing in them."""
    text = F.col("content").cast("string")
    reason = F.when(~F.is_valid_utf8(text), "not UTF-8").when(F.instr(text, "\u0000") > 0, "binary").when(F.trim(F.regexp_replace(text, "^﻿|\\s", "")) == "", "empty")
    return read_files(spark, path, (".md", ".markdown")).select("path", reason.alias("reason")).where("reason IS NOT NULL")


def heading_outline(text: Column) -> Column:
    """``array<struct<level, text>>`` of ATX headings outside code fences; a fence ends only with its own marker."""
    heading = r"^ {0,3}(#{1,6})[ \t]+(.+)$"
    kind = "array<struct<level:int,text:string>>"
    start = F.struct(F.lit("").alias("fence"), F.array().cast(kind).alias("found"))

    def step(state: Column, line: Column) -> Column:
        mark = F.regexp_extract(line, r"^\s*(```|~~~)", 1)
        open_, close = (state.fence == "") & (mark != ""), (state.fence != "") & (mark == state.fence)
        new = F.struct(F.length(F.regexp_extract(line, heading, 1)).alias("level"), F.trim(F.regexp_extract(line, heading, 2)).alias("text"))
        hit = (state.fence == "") & (mark == "") & line.rlike(heading)
        return F.struct(
            F.when(open_, mark).when(close, "").otherwise(state.fence).alias("fence"),
            F.when(hit, F.concat(state.found, F.array(new))).otherwise(state.found).cast(kind).alias("found"),
        )

    return F.aggregate(F.split(text, "\n"), start, step, lambda s: s.found)


def join_page_lines(lines: DataFrame) -> DataFrame:
    """``doc, text`` from positioned lines (doc, page, y, x, kind, text): by y, then x, text before images; pages apart by a blank line."""
    order = F.when(F.col("kind") == "text", 0).otherwise(1)
    page = lines.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("y", "x", order.alias("o"), "text"))).alias("l"))
    page = page.select("doc", "page", F.array_join(F.transform("l", lambda x: x.text), "\n").alias("text"))
    return page.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x.text), "\n\n").alias("text"))


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {".md": read_markdown, ".markdown": read_markdown}


def register_reader(suffix: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    READERS[suffix.lower()] = reader


def read_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """Documents of files or folders by the reader of their suffix (Markdown for folders), one after the other."""
    found = None
    for path in paths:
        suffix = os.path.splitext(path)[1].lower() or ".md"
        if suffix not in READERS:
            raise ValueError(f"no reader for {suffix!r}; there are {sorted(READERS)}")
        one = READERS[suffix](spark, path)
        found = one if found is None else found.unionByName(one, allowMissingColumns=True)
    return found


def read_page_lines(spark: SparkSession, path: str, suffix: str, lines_of: Callable[[bytes], list[tuple[int, float, float, str, str]]]) -> DataFrame:
    """``doc_hash, source_path, text`` of files with pages (PDF): ``lines_of`` turns a file's bytes into lines (page, y, x, kind, text).

    No PDF library is part of this package; :func:`register_reader` takes a
    reader made of this and one.
    """
    found = read_files(spark, path, (suffix,)).select("path", F.substring(F.sha2("content", 256), 1, 16).alias("doc_hash"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                rows = list(lines_of(b.column(2)[at].as_py()))
                page, y, x, kind, text = zip(*rows, strict=True) if rows else ((),) * 5
                name = [b.column(0)[at].as_py() + "\u0000" + b.column(1)[at].as_py()] * len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(page, pa.int32()), pa.array(y, pa.float64()), pa.array(x, pa.float64()), pa.array(kind, pa.string()), pa.array(text, pa.string())], names=["doc", "page", "y", "x", "kind", "text"])

    joined = join_page_lines(found.mapInArrow(run, "doc string, page int, y double, x double, kind string, text string"))
    parts = F.split("doc", "\u0000")
    return joined.select(parts[1].alias("doc_hash"), parts[0].alias("source_path"), "text")


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces from JSON lines; broken lines are left out, of several with one id the last finished holds."""
    rows = spark.read.schema(TRACE).option("mode", "DROPMALFORMED").json(path).where("trace_id IS NOT NULL")
    w = Window.partitionBy("trace_id").orderBy(F.desc_nulls_last("finished_at"))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def write_traces(traces: DataFrame, path: str) -> None:
    traces.write.mode("append").json(path)


def write_table(df: DataFrame, path: str, partition: str = "collection") -> None:
    """Replace the partitions that ``df`` has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def save_images(images: DataFrame, path: str) -> None:
    """Write images (collection, image_id, content) by collection; one without bytes is an error."""
    checked = F.when(F.length("content") > 0, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("no bytes of image "), "image_id")))
    write_table(images.withColumn("content", checked), path)


def settings(text: str) -> dict[str, str]:
    """``key: value`` lines with ``${NAME}`` replaced by the environment's value (absent: empty)."""
    pairs = (line.split(":", 1) for line in text.splitlines() if ":" in line and not line.lstrip().startswith("#"))
    fill = lambda v: re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), v)
    return {k.strip(): fill(v.strip()) for k, v in pairs}
