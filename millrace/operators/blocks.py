"""Top-k products of blocks: queries and items of a collection, packed and multiplied block by block.

Both sides are packed into rows of bounded size, joined on the collection, and
every pair of blocks is one matrix product in an Arrow batch that leaves at
most k rows for each of its queries.  So neither side of a collection has to
fit into one task, and no (query, item) pair becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import store

#: Items and queries of a block.
ITEMS = 4096
QUERIES = 256


def _packed(rows: DataFrame, counts: DataFrame, id_col: str, most: int, names: list[str], side: str, pack) -> DataFrame:
    """``collection, <side>`` with one row for each block of ids; ``counts`` has the number ``n`` of ids of each collection, ``pack`` makes the columns of ``side`` from a block's rows."""
    sizes = counts.select("collection", F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(most)).cast("int")).alias("__blocks"))
    block = F.pmod(F.xxhash64(id_col), F.col("__blocks")).alias("__block")
    dealt = rows.join(sizes, "collection").select("collection", block, *names)
    kind = dealt.schema["collection"].dataType.simpleString()
    schema = f"collection {kind}, {side}_ids array<string>, {side}_data binary"

    def run(table: pa.Table) -> pa.Table:
        ids, data = pack(table)
        return pa.table({"collection": table.column("collection").slice(0, 1), f"{side}_ids": pa.array([ids], pa.list_(pa.string())), f"{side}_data": pa.array([data], pa.binary())})

    return dealt.groupBy("collection", "__block").applyInArrow(run, schema)


def _numbered(column: pa.ChunkedArray) -> tuple[list, np.ndarray]:
    """Sorted distinct strings and each row's place among them."""
    flat = column.combine_chunks().dictionary_encode()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    names = np.array(flat.dictionary.to_pylist(), object)
    order = np.argsort(names)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    return names[order].tolist(), place[flat.indices.to_numpy(zero_copy_only=False)]


def _pack_terms(table: pa.Table) -> tuple[list, bytes]:
    ids, row = _numbered(table.column("id"))
    return ids, row.astype(np.int32).tobytes() + table.column("h").to_numpy().tobytes() + table.column("v").to_numpy().tobytes()


def _pack_vectors(table: pa.Table) -> tuple[list, bytes]:
    ids = table.column("id").to_pylist()
    order = sorted(range(len(ids)), key=ids.__getitem__)
    x = np.array(table.column("v").to_pylist(), np.float64)[order]
    return [ids[i] for i in order], x.tobytes()


def _terms_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) // 20
    return np.frombuffer(data, np.int32, n), np.frombuffer(data, np.int64, n, 4 * n), np.frombuffer(data, np.float64, n, 12 * n)


def _best(score: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row that exceed ``least``, the first column on ties."""
    if score.shape[1] > k:
        edge = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        hit = score >= np.maximum(edge, np.nextafter(least, np.inf))[:, None]
    else:
        hit = score > least
    row, column = np.nonzero(hit)
    order = np.lexsort((column, -score[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, np.arange(len(score)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], column[keep]


def _joined(queries: DataFrame, items: DataFrame, score, k: int, least: float, value: str, sign: int) -> DataFrame:
    """``query_id, chunk_id, <value>`` of the best of each pair of blocks; ``score`` makes a matrix of queries x items, ``sign`` tells if large (1) or small (-1) is good."""
    store.ship(queries.sparkSession)
    pairs = queries.join(items, "collection").select("q_ids", "q_data", "i_ids", "i_data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                asked, found = one.column(0).flatten(), one.column(2).flatten()
                s = score(len(asked), one.column(1)[0].as_py(), len(found), one.column(3)[0].as_py())
                row, column = _best(sign * s, k, least)
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(row)), found.take(pa.array(column)), pa.array(s[row, column])], names=["query_id", "chunk_id", value])

    return pairs.mapInArrow(run, f"query_id string, chunk_id string, {value} double")


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("collection").agg(F.count("*").alias("n"))


def sparse_products(weights: DataFrame, items: DataFrame, terms: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, chunk_id, score > 0``: at least the k best of each query, of ``weights(collection, chunk_id, term, weight)`` and ``terms(query_id, collection, term, qtf)``.

    ``items`` and ``queries`` have a row for each chunk and query with its
    collection.  Terms travel as 64-bit hashes.  Scores are rounded to 8 digits.
    """
    found = _packed(weights.select("collection", F.col("chunk_id").alias("id"), F.xxhash64("term").alias("h"), F.col("weight").alias("v")), _counted(items), "id", ITEMS, ["id", "h", "v"], "i", _pack_terms)
    asked = _packed(terms.select("collection", F.col("query_id").alias("id"), F.xxhash64("term").alias("h"), F.col("qtf").cast("double").alias("v")), _counted(queries), "id", QUERIES, ["id", "h", "v"], "q", _pack_terms)

    def score(n_queries: int, q: bytes, n_items: int, i: bytes) -> np.ndarray:
        row, h, qtf = _terms_of(q)
        own, place = np.unique(h, return_inverse=True)
        left = np.zeros((n_queries, len(own)))
        left[row, place] = qtf
        item, h, weight = _terms_of(i)
        at = np.minimum(np.searchsorted(own, h), len(own) - 1)
        there = own[at] == h
        right = np.zeros((len(own), n_items))
        right[at[there], item[there]] = weight[there]
        return np.round(left @ right, 8)

    return _joined(asked, found, score, k, 0.0, "score", 1)


def dense_products(vectors: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    """``query_id, chunk_id, distance``: at least the k nearest of each query, of ``vectors(collection, chunk_id, v)`` and ``queries(collection, query_id, v)``.

    Vectors of one length are compared.  Distances are rounded to 8 digits; by
    cosine a zero vector has none and comes first.
    """
    width = F.size("v").cast("string")
    key = F.concat_ws("|", width, F.col("collection"))  # one product has one width
    vectors, queries = vectors.select(key.alias("collection"), F.col("chunk_id").alias("id"), "v"), queries.select(key.alias("collection"), F.col("query_id").alias("id"), "v")
    items = _packed(vectors, _counted(vectors), "id", ITEMS, ["id", "v"], "i", _pack_vectors)
    asked = _packed(queries, _counted(queries), "id", QUERIES, ["id", "v"], "q", _pack_vectors)

    def score(n_queries: int, q: bytes, n_items: int, i: bytes) -> np.ndarray:
        a, b = np.frombuffer(q).reshape(n_queries, -1), np.frombuffer(i).reshape(n_items, -1)
        if metric == "l2sq":
            d = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
            d[d < 1e-6 * (a * a).sum(1)[:, None]] = 0  # what is nearly equal is subtracted first
            for r, c in zip(*np.nonzero(d == 0), strict=True):
                d[r, c] = ((a[r] - b[c]) ** 2).sum()
        elif metric == "cosine":
            n = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))
            d = np.where(n > 0, 1 - (a @ b.T) / np.where(n > 0, n, 1), -np.inf)
        else:
            d = 1 - a @ b.T
        return np.round(d, 8) + 0.0

    found = _joined(asked, items, score, k, -np.inf, "distance", -1)
    return found.withColumn("distance", F.when(F.col("distance") > float("-inf"), F.col("distance")))


def spread_out(column: str) -> Column:
    """Number of a string that is the same in every engine: the first eight hex digits of its MD5."""
    return F.conv(F.substring(F.md5(F.col(column).cast("binary")), 1, 8), 16, 10).cast("long")
