"""Cutting documents into chunks with a recursive list of separators."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from ..sources import store
from .tables import spread

SEPARATORS = ["\n\n", "\n", " ", ""]


def recursive_pieces(text: str, size: int, overlap: int, separators: list[str] | None = None) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most ``size`` characters.

    A text is cut at the first separator it has, each part keeping the
    separator at its start; parts are merged while they fit, a chunk starting
    with as many whole parts of the one before as fit into the overlap; parts
    that are too long are cut by the next separators. Chunks are stripped and
    blank ones left out.
    """
    seps = separators or SEPARATORS

    def parts(a: int, b: int, level: int) -> tuple[list[tuple[int, int]] | None, int]:
        while level < len(seps) - 1 and text.find(seps[level], a, b) < 0:
            level += 1
        sep = seps[level]
        if not sep:
            return None, level
        edges, at = [a], text.find(sep, a, b)
        while at >= 0:
            if at > a:
                edges.append(at)
            at = text.find(sep, at + len(sep), b)
        edges.append(b)
        return list(zip(edges[:-1], edges[1:], strict=True)), level

    def cut(a: int, b: int, level: int) -> Iterator[tuple[int, int]]:
        if b - a <= size:
            yield a, b
            return
        pieces, level = parts(a, b, level)
        if pieces is None:  # single characters: every piece is full, and starts an overlap before the last one's end
            yield from ((x, min(x + size, b)) for x in range(a, max(a + 1, b - overlap), size - overlap))
            return
        held: deque[tuple[int, int]] = deque()
        for x, y in pieces:
            if y - x > size:
                if held:
                    yield held[0][0], held[-1][1]
                    held.clear()
                yield from cut(x, y, level + 1)
                continue
            if held and y - held[0][0] > size:
                yield held[0][0], held[-1][1]
                while held and (held[-1][1] - held[0][0] > overlap or y - held[0][0] > size):
                    held.popleft()
            held.append((x, y))
        if held:
            yield held[0][0], held[-1][1]

    out = []
    for a, b in cut(0, len(text), 0):
        piece = text[a:b]
        left, right = len(piece) - len(piece.lstrip()), len(piece.rstrip())
        if left < right:
            out.append((a + left, a + right))
    return out


def split_recursive(documents: DataFrame, *, size: int = 1024, overlap: int = 200) -> DataFrame:
    """``doc_hash, collection, source_path, doc_type, start_offset, end_offset, text`` of the pieces of ``documents``."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap in [0, size)")
    store.ship(documents.sparkSession)
    docs = spread(documents.select("doc_hash", "collection", "source_path", "doc_type", "text").where("text IS NOT NULL"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [
                (h, c, p, k, a, b, t[a:b])
                for h, c, p, k, t in f.itertuples(index=False)
                for a, b in recursive_pieces(t, size, overlap)
            ]
            yield pd.DataFrame(rows, columns=["doc_hash", "collection", "source_path", "doc_type", "start_offset", "end_offset", "text"])

    return docs.mapInPandas(run, "doc_hash string, collection string, source_path string, doc_type string, start_offset int, end_offset int, text string")


def chunk_documents(documents: DataFrame, *, size: int = 1024, overlap: int = 200) -> DataFrame:
    """Chunks of documents: pieces that are no bare ``doc_id:`` marker, numbered, with id and inherited metadata."""
    from pyspark.sql import Window

    pieces = split_recursive(documents, size=size, overlap=overlap).where(~T.is_marker(F.col("text")))
    w = Window.partitionBy("doc_hash", "collection").orderBy("start_offset", "end_offset")
    numbered = pieces.withColumn("chunk_index", F.row_number().over(w) - 1)
    meta = F.map_filter(F.create_map(F.lit("source_path"), F.col("source_path"), F.lit("doc_type"), F.col("doc_type")), lambda k, v: v.isNotNull())
    return numbered.select(
        ids.chunk_id(F.col("doc_hash"), F.col("chunk_index"), F.col("text")).alias("chunk_id"),
        "collection", "chunk_index", "text", "start_offset", "end_offset", F.col("doc_hash").alias("source_ref"), meta.alias("metadata"),
    )


def fixed_length(documents: DataFrame, *, size: int = 1000, overlap: int = 100) -> DataFrame:
    """``doc_id, piece_no, start_offset, text`` of windows of ``size`` characters, as Catalyst expressions."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap in [0, size)")
    last = F.greatest(F.length("text") - overlap - 1, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(size - overlap))
    # cut inside the row: the text itself is not repeated for its pieces
    pieces = F.transform(starts, lambda s: F.struct(s.alias("start_offset"), F.substring("text", s + 1, F.lit(size)).alias("text")))
    rows = documents.where(F.length("text") > 0).select("doc_id", F.posexplode(pieces).alias("piece_no", "p"))
    return rows.select("doc_id", "piece_no", "p.start_offset", "p.text")
