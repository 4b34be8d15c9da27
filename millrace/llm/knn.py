"""Most similar vectors for every vector: inverted lists with product-quantised residuals.

A bounded sample fits coarse centroids and, on what is left after subtracting
the nearest one, a product quantiser.  Every vector is stored in the list of
its nearest centroid and searched for in its nearest few lists.  Equal vectors
are stored and searched for once, under the smallest id that holds them; what
is found is handed to all of these at the end.  In a list the
codes are scored with asymmetric distance tables (the query is not quantised),
and what scores high enough is reranked with the exact vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import bounded_rows, cut_lineage, spread

#: Vectors that centroids and codebooks are fitted on, and for each list at least.
SAMPLE_ROWS = 20_000
SAMPLE_OF_LIST = 8
#: More lists than this are fitted in two steps: groups, then the lists of each group.
FLAT_LISTS = 4096
#: Vectors a list is meant to hold; the number of lists follows the input.
LIST_ROWS = 6_000
#: A list with more than this many times LIST_ROWS is cut into slices.
SLICE_FACTOR = 3
#: Lists searched for each vector at least; more where a sample of queries finds a smaller share of its neighbours in them.
PROBES = 4
LIST_RECALL = 0.97
SAMPLE_QUERIES = 256
#: The same where only neighbours at least so similar come out: most queries have none.
LIMIT_RECALL = 0.99
LIMIT_QUERIES = 1024
SUBSPACES = 16
CODES = 256
#: Steps of a distance table's entries for 1. Residuals are at most 2 long, so sums stay below 2**15.
SCALE = 12_000
#: Candidates of each list that are expected to be reranked for each query.
RERANK = 56
_MAX_CONFLICTS = 100_000


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, unit: bool) -> np.ndarray:
    """Centroids by Lloyd's rounds; unit vectors by cosine, others by distance."""
    centre = x[rng.choice(len(x), k, replace=len(x) < k)].astype(np.float32)
    for _ in range(rounds):
        score = x @ centre.T
        if not unit:
            score -= 0.5 * (centre * centre).sum(1)
        near = score.argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)[:, None]
        centre = np.where(n > 0, total / np.maximum(n, 1), centre)
        if unit:
            norm = np.linalg.norm(centre, axis=1, keepdims=True)
            centre = centre / np.where(norm > 0, norm, 1)
    return centre.astype(np.float32)


def _coarse(x: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of the lists."""
    if lists <= FLAT_LISTS:
        return _kmeans(x, lists, 8, rng, unit=True)
    top = _kmeans(x, round(lists**0.5), 8, rng, unit=True)
    near = np.concatenate([(x[i : i + 65_536] @ top.T).argmax(1) for i in range(0, len(x), 65_536)])
    parts = [(x[near == t], round(lists * float((near == t).mean()))) for t in range(len(top))]
    return np.concatenate([_kmeans(part, max(1, k), 8, rng, unit=True) for part, k in parts if len(part)])


class Model:
    """Coarse centroids and the codebooks of residuals."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centroids = _coarse(sample, lists, rng)
        near = np.concatenate([(sample[i : i + 8192] @ self.centroids.T).argmax(1) for i in range(0, len(sample), 8192)])
        self.share = np.bincount(near, minlength=len(self.centroids)) / len(sample)
        rest = sample - self.centroids[near]
        width = sample.shape[1] // SUBSPACES
        rest = rest[:: max(1, len(rest) // SAMPLE_ROWS)]
        self.books = np.stack([_kmeans(rest[:, m * width : (m + 1) * width], CODES, 5, rng, unit=False) for m in range(SUBSPACES)])

    def encode(self, x: np.ndarray, near: int) -> np.ndarray:
        """Codes (rows x SUBSPACES) of the residuals to one centroid."""
        rest = x - self.centroids[near]
        width = x.shape[1] // SUBSPACES
        out = np.empty((len(x), SUBSPACES), np.uint8)
        for m, book in enumerate(self.books):
            score = rest[:, m * width : (m + 1) * width] @ book.T - 0.5 * (book * book).sum(1)
            out[:, m] = score.argmax(1)
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of each query with each code, SUBSPACES x CODES x queries, as 16-bit integers.

        All are scaled alike, so that no sum over the subspaces of unit vectors overflows.
        """
        width = q.shape[1] // SUBSPACES
        return np.stack([np.rint(book @ q[:, m * width : (m + 1) * width].T * SCALE) for m, book in enumerate(self.books)]).astype(np.int16)


def search_list(model: Model, near: int, data: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, similarity) of at least the k best rows of one list for each query, in blocks of queries.

    The threshold of a query is the score that about RERANK rows of the list
    exceed, estimated on a spread of rows; whatever exceeds it is reranked.  A
    query with fewer than k rows above it is compared with the whole list.
    """
    n = len(data)
    if n <= 4 * RERANK:
        s = queries @ data.T
        q, r = np.divmod(np.arange(s.size), n)
        yield q, r, s.ravel()
        return
    codes = model.encode(data, near).astype(np.intp)
    probe = np.linspace(0, n - 1, min(n, 1024)).astype(np.intp)
    kth = len(probe) - max(1, round(RERANK * len(probe) / n))
    step = 256
    for at in range(0, len(queries), step):
        q = queries[at : at + step]
        tables = model.tables(q)
        some = sum((tables[m][codes[probe, m]] for m in range(SUBSPACES)), np.zeros((), np.int16))
        least = np.partition(some, kth, axis=0)[kth]
        rows, cols = [], []
        score = np.empty((512, len(q)), np.int16)
        part = np.empty_like(score)
        for low in range(0, n, 512):
            c = codes[low : low + 512]
            acc, tmp = score[: len(c)], part[: len(c)]
            np.take(tables[0], c[:, 0], axis=0, out=acc, mode="clip")
            for m in range(1, SUBSPACES):
                np.take(tables[m], c[:, m], axis=0, out=tmp, mode="clip")
                acc += tmp
            hit = np.flatnonzero(acc >= least)
            r, j = np.divmod(hit, len(q))
            rows.append(r + low), cols.append(j)
        r, j = np.concatenate(rows), np.concatenate(cols)
        few = np.flatnonzero(np.bincount(j, minlength=len(q)) < k)
        if len(few):
            keep = ~np.isin(j, few)
            r = np.concatenate([r[keep], np.tile(np.arange(n), len(few))])
            j = np.concatenate([j[keep], np.repeat(few, n)])
        exact = np.empty(len(r), np.float32)
        for a in range(0, len(r), 65_536):
            b = slice(a, a + 65_536)
            exact[b] = np.einsum("ij,ij->i", data[r[b]], q[j[b]])
        yield j + at, r, exact


def _best(q: np.ndarray, r: np.ndarray, s: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query, ties by name."""
    order = np.lexsort((names[r], -s, q))
    q = q[order]
    first = np.r_[True, q[1:] != q[:-1]]
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[place < k]


def usable_vectors(records: DataFrame, *, id_col: str, vector_col: str, time_col: str | None, width: int) -> DataFrame:
    """``id, vec binary`` (unit length, 4-byte floats): one row for each id with a usable vector, repeats of it aside.

    Usable means not null, of the given width, finite and not all zero.  If an
    id has several different usable vectors the one with the latest time holds
    (then the greatest hash).  Equal repeats are left to the caller, who meets
    them in the same list.
    """
    v = F.col(vector_col)
    ok = v.isNotNull() & (F.size(v) == width) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = records.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), v.alias("v"), (F.col(time_col) if time_col else F.lit(0)).alias("at"), F.xxhash64(v).alias("h")
    ).where(ok)
    conflicts = (
        rows.groupBy("id").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.max(F.struct("at", "h")).alias("keep")).where("a != b").select("id", F.col("keep.h").alias("keep"))
    )
    known = bounded_rows(conflicts, _MAX_CONFLICTS)
    if known is None:
        rows = rows.join(conflicts, "id", "left").where("keep IS NULL OR h = keep")
    elif known:
        rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame(known, conflicts.schema)), "id", "left").where("keep IS NULL OR h = keep")

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            flat /= np.abs(flat).max(1, keepdims=True)  # keeps the squares of extreme values finite
            x = (flat / np.linalg.norm(flat, axis=1, keepdims=True)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), _binary(x)], names=["id", "vec"])

    kind = records.schema[id_col].dataType.simpleString()
    return rows.select("id", "v").mapInArrow(unit, f"id {kind}, vec binary")


def _matrix(column: pa.Array, width: int, kind=np.float32) -> np.ndarray:
    """The vectors of a binary column without nulls."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(column) else np.empty(0, np.uint8)
    return data.view(kind).reshape(-1, width)


def _binary(*matrices: np.ndarray) -> pa.Array:
    """A binary column of the rows of matrices."""
    sizes = np.concatenate([np.full(len(m), m.shape[1] * m.itemsize) for m in matrices])
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    data = b"".join(np.ascontiguousarray(m).tobytes() for m in matrices)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])


def nearest(
    records: DataFrame,
    *,
    k: int = 10,
    id_col: str = "chunk_id",
    vector_col: str = "dense_vector",
    time_col: str | None = "embedded_at",
    width: int = 64,
    least_similarity: float | None = None,
    sample_rows: int = SAMPLE_ROWS,
    list_rows: int = LIST_ROWS,
    probes: int = PROBES,
) -> DataFrame:
    """``id, neighbour, similarity, rank``: the k other ids with the greatest cosine similarity.

    Every id with a usable vector is searched for and is in the index, see
    :func:`usable_vectors`; an input without any gives no rows.  Ties go to the
    smaller id.  With ``least_similarity`` only neighbours at least that
    similar come out, each with the rank it has among all: those that outrank it
    are more similar still, so the rest need not be shuffled.

    Centroids and codebooks are fitted on ``sample_rows`` vectors, or
    SAMPLE_OF_LIST for each list if these are more.  Lists hold
    about ``list_rows``; ``probes`` of them are searched, or as many as a sample
    of queries needs for what comes out, see :func:`_probes`.  Longer ones are cut into slices which
    every query of the list visits.  A vector that a third of all rows hold is
    one row of the index.
    """
    spark = records.sparkSession
    vectors = usable_vectors(spread(records.select(*dict.fromkeys([id_col, vector_col, *([time_col] if time_col else [])]))), id_col=id_col, vector_col=vector_col, time_col=time_col, width=width)
    kind = records.schema[id_col].dataType.simpleString()
    total = records.count()
    vectors, members = _once(vectors)
    out_schema = f"id {kind}, neighbour {kind}, similarity float, rank int"
    lists = max(1, round(total / list_rows))
    sample_rows = max(sample_rows, SAMPLE_OF_LIST * lists)
    share = min(1.0, 1.5 * sample_rows / max(total, 1))
    picked = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < F.lit(int(share * 1_000_003) + 1)).select("vec").limit(sample_rows).toArrow()
    if picked.num_rows == 0:
        return spark.createDataFrame([], out_schema)
    sample = _matrix(picked.column("vec").combine_chunks(), width)
    model = Model(sample, min(lists, max(1, len(sample) // SAMPLE_OF_LIST)))
    slices = np.maximum(1, np.ceil(model.share * total / (SLICE_FACTOR * list_rows))).astype(np.int64)
    first_slice = np.concatenate([[0], np.cumsum(slices)])
    asked = min(probes, len(model.centroids))
    if asked < len(model.centroids):
        asked = max(asked, _probes(vectors, model, sample[: SAMPLE_QUERIES if least_similarity is None else LIMIT_QUERIES], k, least_similarity))
    shared = spark.sparkContext.broadcast(model)  # a function of sample_rows and the number of lists

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value.centroids
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                x = _matrix(b.column(1), width)
                score = x @ centroids.T
                near = np.argpartition(-score, asked - 1, axis=1)[:, :asked] if asked < len(centroids) else np.tile(np.arange(asked), (len(x), 1))
                own = score.argmax(1)
                ids = b.column(0)
                # rows of the index: slice by id, so that equal repeats of an id meet
                name = b.column(2).to_numpy().view(np.uint64)
                home = first_slice[own] + (name % slices[own].astype(np.uint64)).astype(np.int64)
                # queries: every slice of every near list, in half precision
                rows, lots = [], []
                for j in range(asked):
                    lot = near[:, j]
                    most = int(slices[lot].max())
                    for s in range(most):
                        r = np.flatnonzero(slices[lot] > s)
                        rows.append(r), lots.append(first_slice[lot[r]] + s)
                r, lot = np.concatenate(rows), np.concatenate(lots)
                half = x.astype(np.float16)
                foreign = lot != home[r]  # in its own slice the row of the index is the query too
                r, lot = r[foreign], lot[foreign]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([home, lot]), pa.int64()),
                        pa.concat_arrays([ids, ids.take(pa.array(r))]),
                        _binary(x, half[r]),
                    ],
                    names=["slice", "id", "vec"],
                )

    routed = vectors.select("id", "vec", F.xxhash64("id")).mapInArrow(route, f"slice long, id {kind}, vec binary")
    list_of = np.repeat(np.arange(len(slices)), slices)

    def search(table: pa.Table) -> pa.Table:
        model = shared.value
        table = table.combine_chunks()
        near = int(list_of[table.column("slice")[0].as_py()])
        ids = table.column("id").combine_chunks() if table.num_rows else table.column("id")
        raw = table.column("vec").combine_chunks()
        size = pc.binary_length(raw).to_numpy()
        is_data = size == width * 4
        names = np.array(ids.to_pylist(), object)
        d, h = np.flatnonzero(is_data), np.flatnonzero(~is_data)
        _, one = np.unique(names[d], return_index=True)  # repeats of an id
        d = d[one]
        if len(h):
            _, one = np.unique(names[h], return_index=True)
            h = h[one]
        # equal vectors are searched for once and stand in the list once, with the smallest ids that hold them
        data, member_of = _distinct(_matrix(raw.take(pa.array(d)), width))
        half, half_of = _distinct(_matrix(raw.take(pa.array(h)), width, np.float16))
        asked_names = np.concatenate([names[d], names[h]])
        asked_of = np.concatenate([member_of, half_of + len(data)])
        queries = np.concatenate([data, half.astype(np.float32)])
        order = names[d]  # np.unique sorted them by name
        members = np.argsort(member_of, kind="stable")  # by vector, then by name
        first_member = np.searchsorted(member_of[members], np.arange(len(data) + 1))
        holders = np.minimum(np.diff(first_member), k + 1)
        by_query = np.argsort(asked_of, kind="stable")
        first_query = np.searchsorted(asked_of[by_query], np.arange(len(queries) + 1))
        found = []
        for q, r, s in search_list(model, near, data, queries, k + 1) if len(data) else []:
            if least_similarity is not None:
                keep = s >= least_similarity - 2e-3
                q, r, s = q[keep], r[keep], s[keep]
            best = _best(q, r, s, first_member, k + 1)
            q, r, s = q[best], r[best], s[best]
            # from vectors to the ids that hold them, on both sides
            q, r, s = np.repeat(q, holders[r]), members[_ranges(first_member[r], holders[r])], np.repeat(s, holders[r])
            n = np.diff(first_query)[q]
            i, r, s = by_query[_ranges(first_query[q], n)], np.repeat(r, n), np.repeat(s, n)
            other = asked_names[i] != order[r]
            i, r, s = i[other], r[other], s[other]
            best = _best(i, r, s, np.arange(len(order)), k)
            found.append((i[best], r[best], s[best]))
        if found:
            q, r, s = (np.concatenate(x) for x in zip(*found, strict=True))
        else:
            q = r = s = np.empty(0, np.int64)
        return pa.table(
            {"id": pa.array(asked_names[q].tolist(), ids.type), "neighbour": pa.array(order[r].tolist() if len(d) else [], ids.type), "similarity": pa.array(s.astype(np.float32))}
        )

    # a partition for each slice: what a task reads does not grow with the input
    routed = routed.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(list_of)), "slice")
    local = routed.groupBy("slice").applyInArrow(search, f"id {kind}, neighbour {kind}, similarity float")
    if least_similarity is not None:
        local = _exact_similarity(cut_lineage(local), vectors, kind, width).where(F.col("similarity") >= least_similarity)
    # at most k rows for each of the lists a query visits
    merged = local.groupBy("id").agg(
        F.slice(F.array_sort(F.collect_set(F.struct((-F.col("similarity")).alias("s"), F.col("neighbour").alias("n")))), 1, k).alias("best")
    )
    if members is not None:
        merged = _handed_out(merged, members, k)
    return merged.select("id", F.posexplode("best").alias("p", "b")).select("id", F.col("b.n").alias("neighbour"), (-F.col("b.s")).alias("similarity"), (F.col("p") + 1).alias("rank"))


def _once(vectors: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Each vector once, under the smallest id that holds it, and ``id, rep`` of all ids whose vector others hold too (None if there are none).

    Vectors are told apart by 128 bits of hashes.
    """
    keyed = vectors.withColumns({"a": F.xxhash64("vec"), "b": F.xxhash64("vec", F.lit(1))})
    shared = cut_lineage(keyed.groupBy("a", "b").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep != last").select("a", "b", "rep"))
    n = shared.count()
    if not n:
        return vectors, None
    small = F.broadcast(shared) if n <= _MAX_CONFLICTS else shared
    members = cut_lineage(keyed.select("id", "a", "b").join(small, ["a", "b"]).select("id", "rep").distinct())
    return keyed.join(small, ["a", "b"], "left").where("rep IS NULL OR id = rep").select("id", "vec"), members


def _handed_out(merged: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """``id, best`` of all ids, from those of the vectors: a vector stands for the smallest ids that hold it, and its holders are most similar to each other.

    No more than k + 1 ids of a vector are brought together.
    """
    salted = Window.partitionBy("rep", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    first = members.withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1)
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("n") <= k + 1)
    first = cut_lineage(first.groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    each = merged.select("id", F.explode("best").alias("e")).select(F.col("id").alias("rep"), F.col("e.s").alias("s"), F.col("e.n").alias("n"))
    held = first.select(F.col("rep").alias("n"), "ids")
    others = each.join(held, "n", "left").select("rep", "s", F.explode(F.coalesce("ids", F.array("n"))).alias("n"))
    own = first.select("rep", F.lit(-1.0).cast(each.schema["s"].dataType).alias("s"), F.explode("ids").alias("n"))
    # a holder itself may be among them, hence one more
    best = others.unionByName(own).groupBy("rep").agg(F.slice(F.array_sort(F.collect_set(F.struct("s", "n"))), 1, k + 1).alias("best"))
    asked = members.join(best, "rep").select("id", "best").unionByName(best.join(first, "rep", "left_anti").select(F.col("rep").alias("id"), "best"))
    return asked.select("id", F.slice(F.filter("best", lambda e: e.n != F.col("id")), 1, k).alias("best"))


def _probes(vectors: DataFrame, model: Model, queries: np.ndarray, k: int, least_similarity: float | None = None) -> int:
    """Lists to search so that LIST_RECALL of the k nearest of the queries, found among all vectors, are in them.

    With ``least_similarity`` it is LIMIT_RECALL of those at least so similar:
    they lie in nearer lists than the k nearest do.
    Vectors equal to a query are in its own list anyhow and don't count.
    """
    shared = vectors.sparkSession.sparkContext.broadcast((model.centroids, queries))
    width = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, q = shared.value
        best, home = np.full((len(q), k), -2, np.float32), np.zeros((len(q), k), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                x = _matrix(whole.slice(at, 4096).column(0), width)
                s = q @ x.T
                s[s > 1 - 1e-5] = -2
                row = np.arange(len(q)) if least_similarity is None else np.flatnonzero(s.max(1) >= least_similarity)
                if not len(row):
                    continue
                own = np.concatenate([home[row], np.broadcast_to((x @ centroids.T).argmax(1), (len(row), len(x)))], axis=1)
                s = np.concatenate([best[row], s[row]], axis=1)
                if least_similarity is not None:
                    s[s < least_similarity] = -2
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                best[row], home[row] = np.take_along_axis(s, top, 1), np.take_along_axis(own, top, 1)
        i, j = np.nonzero(best > -2)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(best[i, j].astype(np.float64)), pa.array(home[i, j])], names=["q", "s", "list"])

    top = vectors.select("vec").mapInArrow(run, "q long, s double, list long").groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "list")), asc=False), 1, k).alias("best"))
    rows = top.select("q", F.explode("best.list").alias("list")).toArrow()
    order = np.argsort(np.argsort(-(queries @ model.centroids.T), axis=1), axis=1)
    places = np.sort(order[rows.column("q").to_numpy(), rows.column("list").to_numpy()])
    share = LIST_RECALL if least_similarity is None else LIMIT_RECALL
    return int(places[max(0, int(np.ceil(share * len(places))) - 1)]) + 1 if len(places) else 1


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and, for each row, its position among them."""
    if not len(x):
        return x, np.empty(0, np.int64)
    x = np.ascontiguousarray(x)
    _, first, of = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return x[first], of.ravel()


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length, one range after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def _exact_similarity(pairs: DataFrame, vectors: DataFrame, kind: str, width: int) -> DataFrame:
    """Similarity of pairs recomputed in double precision from the vectors of both sides."""
    wanted = pairs.select("id").union(pairs.select("neighbour")).distinct()
    vectors = vectors.join(wanted, "id", "left_semi").dropDuplicates(["id"])
    both = pairs.select("id", "neighbour").join(vectors, "id").join(vectors.select(F.col("id").alias("neighbour"), F.col("vec").alias("other")), "neighbour")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (_matrix(b.column(i), width).astype(np.float64) for i in (2, 3))
            s = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=["id", "neighbour", "similarity"])

    return both.select("id", "neighbour", "vec", "other").mapInArrow(product, f"id {kind}, neighbour {kind}, similarity double")


def similar_pairs(records: DataFrame, *, least_similarity: float = 0.9, k: int = 10, id_col: str = "chunk_id", **options) -> DataFrame:
    """``id_a, id_b`` with id_a < id_b: pairs at least so similar of which one is among the k most similar of the other."""
    near = nearest(records, k=k, id_col=id_col, least_similarity=least_similarity, **options)
    return near.select(F.least("id", "neighbour").alias(f"{id_col}_a"), F.greatest("id", "neighbour").alias(f"{id_col}_b")).distinct()
