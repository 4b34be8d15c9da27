"""Splitting oversized texts at natural boundaries.

The boundaries of a text (paragraph, line, sentence, word) form a sorted list
of positions with strengths.  A sparse table over that list answers "strongest
boundary in this window of lengths, rightmost on ties" in constant time; pieces
are cut one after the other, each starting an overlap before the last cut.
The same boundary index tells how fine the cuts of a text have to be.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_rows, spread

CHARACTER, WORD, SENTENCE, LINE, PARAGRAPH = range(5)
KINDS = ["character", "word", "sentence", "line", "paragraph"]
#: Pieces are at least this share of max_chars long if a boundary allows it.
MIN_FILL = 0.5
#: Profiles up to this number become literals of the plan; more are joined.
MAX_PROFILES = 64

_CUT = re.compile(r"[ \t\r\n]+|[。！？](?![ \t\r\n])")
_WHITE = " \t\r\n"


class BoundaryIndex:
    """Boundaries of one text and a range-maximum table over their strengths."""

    def __init__(self, text: str):
        ends, starts, strengths = [], [], []
        for m in _CUT.finditer(text):
            a, b = m.span()
            if b - a == 1 and text[a] in "。！？":
                ends.append(b), starts.append(b), strengths.append(SENTENCE)
                continue
            gap = m.group()
            lines = gap.count("\n")
            if lines > 1:
                strength = PARAGRAPH
            elif lines:
                strength = LINE
            else:
                strength = SENTENCE if a and text[a - 1] in ".!?。！？" else WORD
            ends.append(a), starts.append(b), strengths.append(strength)
        self.length = len(text)
        self.ends = np.array(ends, np.int64)
        self.starts = np.array(starts, np.int64)
        self.strengths = np.array(strengths, np.int64)
        self._table: list[np.ndarray] | None = None

    def _levels(self) -> list[np.ndarray]:
        if self._table is None:
            m = len(self.strengths)
            # strength first, position second: the maximum is the strongest, then the rightmost
            level = self.strengths * (m + 1) + np.arange(m)
            self._table, width = [level], 1
            while 2 * width <= m:
                level = np.maximum(level[:-width], level[width:])
                self._table.append(level)
                width *= 2
        return self._table

    def strongest(self, low: int, high: int) -> tuple[int, int] | None:
        """(position, strength) of the strongest boundary in [low, high], the rightmost on ties."""
        i, j = np.searchsorted(self.starts, low, "left"), np.searchsorted(self.starts, high, "right")
        if i >= j:
            return None
        k = int(j - i).bit_length() - 1
        level = self._levels()[k]
        best = int(max(level[i], level[j - (1 << k)])) % (len(self.strengths) + 1)
        return int(self.starts[best]), int(self.strengths[best])

    def reached(self, max_chars: int, text_start: int, text_end: int) -> tuple[np.ndarray, np.ndarray]:
        """Strengths of the places that stretches start at (the text's own start first), and of the strongest boundary in reach of each.

        In reach is what ends a stretch of at most ``max_chars``; the text's end is as good as a paragraph's.
        """
        keep = np.flatnonzero((self.starts > text_start) & (self.ends < text_end))
        low, high = (int(keep[0]), int(keep[-1]) + 1) if len(keep) else (0, 0)
        at = np.r_[text_start, self.starts[low:high]]
        i = np.r_[low, np.arange(low, high) + 1]
        j = np.searchsorted(self.ends[low:high], at + max_chars, "right") + low
        best = np.full(len(at), -1)
        some = np.flatnonzero(j > i)
        if len(some):
            k = np.frexp(j[some] - i[some])[1] - 1
            for width in np.unique(k):
                level, own = self._levels()[width], some[k == width]
                best[own] = np.maximum(level[i[own]], level[j[own] - (1 << int(width))]) // (len(self.strengths) + 1)
        best[text_end - at <= max_chars] = PARAGRAPH
        return np.r_[PARAGRAPH, self.strengths[low:high]], best


def finest_cut(index: BoundaryIndex, text: str, max_chars: int) -> int:
    """Coarsest kind of boundary whose stretches all fit into ``max_chars``, by range maxima: from each of them the next one is in reach."""
    start = len(text) - len(text.lstrip(_WHITE))
    end = len(text.rstrip(_WHITE))
    if start >= end:
        return PARAGRAPH
    own, best = index.reached(max_chars, start, end)
    for strength in (PARAGRAPH, LINE, SENTENCE, WORD):
        if (best[own >= strength] >= strength).all():
            return strength
    return CHARACTER


def cut_pieces(index: BoundaryIndex, max_chars: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, kind of the cut at the end) of consecutive pieces covering the text; an overlap of more than half of max_chars counts as half."""
    overlap = min(overlap, max_chars // 2)
    pieces, start, n = [], 0, index.length
    while n - start > max_chars:
        least, most = start + max(int(max_chars * MIN_FILL), overlap + 1), start + max_chars
        found = index.strongest(least, most) or index.strongest(start + overlap + 1, most)
        cut, kind = found or (most, CHARACTER)
        pieces.append((start, cut, kind))
        back = cut - overlap
        if overlap:
            near = index.strongest(max(start + 1, back - overlap // 4), back + overlap // 4)
            back = near[0] if near else back
        start = max(back, start + 1)
    pieces.append((start, n, PARAGRAPH))
    return pieces


PIECE = "start_offset int, end_offset int, cut string, text string"


def split_oversized(
    documents: DataFrame,
    profiles: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    collection_col: str = "collection",
    default: str = "default",
) -> DataFrame:
    """One row for each text longer than max_chars of its collection.

    Returns ``id, finest_cut, pieces array<struct<start_offset, end_offset, cut, text>>``.
    Offsets count code points; every piece has at most max_chars of them, the
    pieces cover the whole text and consecutive ones share about overlap_chars
    (moved by up to a quarter to start at a boundary).

    Null and empty texts, and texts that fit, give no row.  A collection that is
    null or has no profile uses the row ``default``; max_chars that is null or
    below 1 does too, overlap that is null or negative counts as 0, one of more
    than half of max_chars as half, so that pieces get on.  Of several
    rows for one collection the smallest max_chars holds.  Repeated documents
    give repeated rows; other columns are ignored.
    """
    docs = documents.select(
        F.col(id_col).alias("__id"), F.col(collection_col).alias("__collection"), F.col(text_col).alias("__text")
    )
    rules = (
        profiles.where("max_chars >= 1")
        .groupBy(F.col("collection").alias("__collection"))
        .agg(F.min(F.struct("max_chars", F.greatest(F.coalesce("overlap_chars", F.lit(0)), F.lit(0)).alias("o"))).alias("p"))
        .select("__collection", F.col("p.max_chars").alias("__max"), F.col("p.o").alias("__overlap"))
    )
    fallback = rules.where(F.col("__collection") == default).first()
    if fallback is None:
        raise ValueError(f"no usable profile {default!r}")
    known = bounded_rows(rules, MAX_PROFILES)
    if known is not None:
        by_name = {r[0]: (r[1], r[2]) for r in known if r[0] is not None}
        values = [F.lit(x) for k, v in by_name.items() for x in (k, f"{v[0]},{v[1]}")]
        rule = F.coalesce(
            F.try_element_at(F.create_map(*values), F.col("__collection")), F.lit(f"{fallback[1]},{fallback[2]}")
        )
        docs = docs.withColumn("__rule", F.split(rule, ",")).select(
            "__id", "__text", F.col("__rule")[0].cast("int").alias("__max"), F.col("__rule")[1].cast("int").alias("__overlap")
        )
    else:
        docs = docs.join(rules, "__collection", "left").select(
            "__id",
            "__text",
            F.coalesce("__max", F.lit(fallback[1])).alias("__max"),
            F.when(F.col("__max").isNull(), fallback[2]).otherwise(F.col("__overlap")).alias("__overlap"),
        )
    docs = spread(docs.where(F.length("__text") > F.col("__max")))
    id_type = documents.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            ids, texts, most, overlaps = (batch.column(i) for i in range(4))
            kinds, all_pieces = [], []
            for text, m, o in zip(texts.to_pylist(), most.to_pylist(), overlaps.to_pylist(), strict=True):
                index = BoundaryIndex(text)
                kinds.append(KINDS[finest_cut(index, text, m)])
                all_pieces.append(
                    [
                        {"start_offset": a, "end_offset": b, "cut": KINDS[k], "text": text[a:b]}
                        for a, b, k in cut_pieces(index, m, o)
                    ]
                )
            if schema is None:
                piece = pa.struct([("start_offset", pa.int32()), ("end_offset", pa.int32()), ("cut", pa.string()), ("text", pa.string())])
                schema = pa.schema([("id", ids.type), ("finest_cut", pa.string()), ("pieces", pa.list_(piece))])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(kinds, pa.string()), pa.array(all_pieces, schema.field("pieces").type)], schema=schema
            )

    out = docs.mapInArrow(run, f"id {id_type.simpleString()}, finest_cut string, pieces array<struct<start_offset:int,end_offset:int,cut:string,text:string>>")
    return out.withColumnRenamed("id", id_col)


def pieces_table(split: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each piece of :func:`split_oversized`."""
    return split.select(id_col, F.posexplode("pieces").alias("piece_no", "p")).select(
        id_col, "piece_no", "p.start_offset", "p.end_offset", "p.cut", "p.text"
    )
