"""Plumbing shared by the operators: lineage cuts, scan parallelism, bounded lookups."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from ..sources.store import cut_lineage, ship

__all__ = ["bounded_rows", "cut_lineage", "ship", "spread", "unzipped", "zipped"]


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan that has fewer partitions than the cluster has cores.

    Single-file tables arrive as one partition; large tables already have many
    and are returned as they are, without a shuffle.  What runs on them may use this
    package: it is sent along.
    """
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def bounded_rows(df: DataFrame, limit: int) -> list | None:
    """The rows of a small dimension table, or None if it has more than ``limit``."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def zipped(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, packed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unzipped(data: bytes, kinds: list) -> list[np.ndarray]:
    """The arrays of :func:`zipped`, given their types."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        size = n * np.dtype(k).itemsize
        out.append(np.frombuffer(raw[at : at + size], k))
        at += size
    return out
