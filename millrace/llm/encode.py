"""Encoding a corpus with a public byte-level BPE tokenizer.

Two neighbouring bytes that no vocabulary token contains side by side can never
be joined by a merge, so a text may be cut between them.  The fragments between
such cuts are encoded independently (each distinct fragment once per task) and
their ids concatenated.  A cut is made only where it also leaves the
pre-tokenizer's own splits as they are, see :func:`cut_table`.
"""

from __future__ import annotations

import base64
import functools
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import spread

TOKENIZER_FOLDER = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")
#: Fixed value: the pre-tokenizer pattern that belongs to the byte_bpe vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct fragments whose ids a task keeps; beyond it the memory starts anew.
FRAGMENTS_KEPT = 400_000
_CHUNK_BYTES = 8 << 20


def _whitespace_last_bytes() -> set[int]:
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace() or unicodedata.category(chr(c)) in ("Zs", "Zl", "Zp")]
    return {c.encode()[-1] for c in spaces} | set(range(0x20))


def cut_table(tokens: list[bytes]) -> np.ndarray:
    """256 x 256 booleans: may a text be cut between bytes a and b.

    True needs all of: the pair is inside no token; b starts a character; the
    character before is not white space (a run of white space is split by what
    follows it); b is not an apostrophe (it could start a contraction).
    """
    inside = np.zeros((256, 256), bool)
    for t in tokens:
        if len(t) > 1:
            x = np.frombuffer(t, np.uint8)
            inside[x[:-1], x[1:]] = True
    cut = ~inside
    cut[:, 0x80:0xC0] = False
    cut[:, ord("'")] = False
    cut[sorted(_whitespace_last_bytes()), :] = False
    return cut


class FragmentEncoder:
    """Encodes texts with the vocabulary of a ``.tiktoken`` file and the pre-tokenizer pattern given."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self._encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._cut = cut_table(list(ranks)).ravel()
        self._known: dict[bytes, list[int]] = {}

    def _fragment(self, fragment: bytes) -> list[int]:
        if len(self._known) >= FRAGMENTS_KEPT:
            self._known.clear()
        ids = self._encoding.encode_ordinary(fragment.decode())
        if len(fragment) <= 64:
            self._known[fragment] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without special tokens; strings that look like special tokens are ordinary text."""
        data = text.encode("utf-8", "replace")
        out: list[int] = []
        known, n = self._known, len(data)
        view = np.frombuffer(data, np.uint8)
        last = 0
        for at in range(0, n, _CHUNK_BYTES):
            part = view[at : at + _CHUNK_BYTES + 1].astype(np.intp)
            cuts = np.flatnonzero(self._cut[part[:-1] * 256 + part[1:]]) + (at + 1)
            for c in cuts.tolist():
                f = data[last:c]
                ids = known.get(f)
                out += self._fragment(f) if ids is None else ids
                last = c
        if last < n:
            f = data[last:]
            ids = known.get(f)
            out += self._fragment(f) if ids is None else ids
        return out


@functools.lru_cache(maxsize=2)
def encoder(name: str, folder: str) -> FragmentEncoder:
    """Encoder of this worker process; ``name`` is a ``.tiktoken`` file of the folder without its ending.

    Executors that lack the folder take the file that the driver sent along.
    """
    path = os.path.join(folder, f"{name}.tiktoken")
    if not os.path.exists(path):
        from pyspark import SparkFiles

        path = SparkFiles.get(os.path.basename(path))
    return FragmentEncoder(path, PATTERN)


def _send(spark: SparkSession, path: str) -> None:
    """Send a file of the driver to the executors, once a session."""
    sent = spark.sparkContext.__dict__.setdefault("_millrace_sent", set())
    if path not in sent and os.path.exists(path):
        spark.sparkContext.addFile(path)
        sent.add(path)


def encode_corpus(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k",
    folder: str = TOKENIZER_FOLDER,
    counts_only: bool = False,
) -> DataFrame:
    """``id, ids array<int>`` (or ``id, n_tokens int``) of every row, without a shuffle of the texts.

    Empty and null texts have an empty list of ids (0 tokens).  Every row of the
    input gives one row, repeated rows included; other columns are ignored.
    """
    _send(documents.sparkSession, os.path.join(folder, f"{tokenizer}.tiktoken"))
    docs = spread(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    id_type = documents.schema[id_col].dataType.simpleString()
    value = ("n_tokens", pa.int32()) if counts_only else ("ids", pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer, folder)
        for batch in batches:
            schema = pa.schema([("id", batch.column(0).type), value])
            for at in range(0, batch.num_rows, 256):  # bounds the ids held at a time
                part = batch.slice(at, 256)
                ids = [e.encode(t) if t else [] for t in part.column(1).to_pylist()]
                if counts_only:
                    values = pa.array([len(x) for x in ids], pa.int32())
                else:
                    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                    flat = np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1]))
                    values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), values], schema=schema)

    kind = "n_tokens int" if counts_only else "ids array<int>"
    return docs.mapInArrow(run, f"id {id_type}, {kind}").withColumnRenamed("id", id_col)
