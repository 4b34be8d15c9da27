"""Filling containers of fixed capacity with items of varying length.

The plan is made on the histogram of lengths, whose size the capacity bounds:
for the longest item left, the gap it leaves is looked up among single lengths,
sums of two and sums of three that are still available; whole multiples of such
exact fills are consumed at once.  Gaps without an exact fill take the best
fitting length and are looked up again.  Items are then dealt to the plan's
slots by their rank among the items of the same length; the plan that travels
with the tasks has at most a few slots for each container shape.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import cut_lineage, ship


class _Lengths:
    """Availability of each length and hashed sums of two available lengths."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] += n
        self._resum()

    def _resum(self) -> None:
        """Mark every sum of two lengths that may be available; stale marks are found out on use."""
        have = (self.left > 0).astype(np.float64)
        size = 1 << int(2 * self.capacity + 1).bit_length()
        f = np.fft.rfft(have, size)
        self.pair_sums = np.fft.irfft(f * f, size)[: self.capacity + 1] > 0.5
        self.lengths = np.flatnonzero(self.left > 0)
        self._at_resum = len(self.lengths)

    def refresh(self) -> None:
        self.lengths = self.lengths[self.left[self.lengths] > 0]
        if len(self.lengths) < 0.7 * self._at_resum:
            self._resum()

    def pair(self, total: int, below: int | None = None) -> tuple[int, int] | None:
        """Two available lengths adding up to ``total``, the larger as large as possible."""
        a = self.lengths[(self.lengths * 2 >= total) & (self.lengths < total)]
        b = total - a
        ok = (self.left[a] > (a == b)) & (self.left[b] > 0)
        if not ok.any():
            return None
        i = int(np.flatnonzero(ok)[-1])
        return int(a[i]), int(b[i])

    def exact(self, gap: int) -> list[int] | None:
        """One, two or three available lengths that fill ``gap`` exactly."""
        if self.left[gap] > 0:
            return [gap]
        if gap > 1 and self.pair_sums[gap]:
            two = self.pair(gap)
            if two:
                return list(two)
        firsts = self._firsts(gap)
        if len(firsts) > 64:  # try some first; if their marks are all stale, mark anew before trying every one
            found = self._triple(gap, firsts[:64])
            if found:
                return found
            self._resum()
            firsts = self._firsts(gap)
        return self._triple(gap, firsts)

    def _firsts(self, gap: int) -> np.ndarray:
        """Available lengths, the largest first, that leave a sum marked as one of two lengths."""
        firsts = self.lengths[self.lengths < gap]
        firsts = firsts[self.left[firsts] > 0]
        return firsts[self.pair_sums[gap - firsts]][::-1]

    def _triple(self, gap: int, firsts: np.ndarray) -> list[int] | None:
        for a in firsts.tolist():
            self.left[a] -= 1
            two = self.pair(gap - a)
            self.left[a] += 1
            if two:
                return [a, *two]
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns (times, lengths): so many containers hold items of these lengths.

    ``counts`` has the number of items of each length from 1 to ``capacity``.
    Each pattern's lengths add up to at most the capacity and all items are used.
    """
    items = _Lengths(counts, capacity)
    out: list[tuple[int, list[int]]] = []
    for longest in range(capacity, 0, -1):
        while items.left[longest] > 0:
            pattern, gap = [longest], capacity - longest
            items.left[longest] -= 1
            items.refresh()
            while gap:
                fill = items.exact(gap)
                if fill is None:
                    fits = items.lengths[np.searchsorted(items.lengths, gap, "right") - 1 :: -1] if len(items.lengths) and items.lengths[0] <= gap else []
                    best = next((int(x) for x in fits if items.left[x] > 0), None)
                    if best is None:
                        break
                    fill = [best]
                for x in fill:
                    items.left[x] -= 1
                    gap -= x
                pattern += fill
            values, each = np.unique(pattern, return_counts=True)
            more = int((items.left[values] // each).min())
            items.left[values] -= more * each
            out.append((1 + more, pattern))
    return out


def pack(
    sizes: DataFrame,
    windows: DataFrame,
    *,
    id_col: str = "doc_id",
    size_col: str = "n_tokens",
    rows_per_rank: int = 50_000,
) -> DataFrame:
    """Assign every item to a container of each window.

    ``windows`` has ``window_name, capacity_tokens`` (rows without a positive
    capacity are left out).  Returns ``window_name, container_id, id, piece_no,
    token_start, n_tokens``.  An item larger than the capacity becomes full
    pieces and one rest; nothing else is split.  Items of size 0 take no space
    and are spread over the containers; a null or negative size counts as 0.
    If all items of a window are empty they share container 0.  Ids must be
    unique; repeated rows count as items of their own and may then share ranks
    only if they agree in every column.

    The histogram that reaches the driver has at most one row for each length
    up to the largest capacity.  Ranks are counted in slices of about
    ``rows_per_rank`` rows, so that a length shared by a third of all rows is
    no single task's work.
    """
    spark = sizes.sparkSession
    ship(spark)
    items = cut_lineage(
        sizes.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    )
    total = items.count()
    slices = max(1, -(-total // rows_per_rank))
    result = None
    for window in windows.select("window_name", "capacity_tokens").distinct().orderBy("window_name", "capacity_tokens").collect():
        name, capacity = window
        if capacity is None or capacity < 1:
            continue
        one = _pack_window(spark, items, name, int(capacity), slices)
        result = one if result is None else result.unionByName(one)
    if result is None:
        result = spark.createDataFrame([], f"window_name string, container_id long, id {items.schema['id'].dataType.simpleString()}, piece_no int, token_start long, n_tokens long")
    return result.withColumnRenamed("id", id_col)


def _pack_window(spark, items: DataFrame, name: str, capacity: int, slices: int) -> DataFrame:
    cap = F.lit(capacity)
    rest = (F.col("size") % cap).cast("int")
    # full pieces of oversized items stand alone; everything else is an item of at most the capacity
    body = items.select(
        "id",
        "size",
        F.when((F.col("size") > 0) & (rest == 0), cap).otherwise(rest).alias("length"),
        F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / cap).cast("long").alias("fulls"),
        F.pmod(F.xxhash64("id", "size"), F.lit(slices)).cast("int").alias("slice"),
    )
    counted = body.groupBy("length", "slice").agg(F.count("*").alias("n"), F.sum("fulls").alias("fulls"))
    histogram = {r[0]: (r[1], r[2]) for r in counted.groupBy("length").agg(F.sum("n"), F.sum("fulls")).collect()}
    patterns = plan({k: v[0] for k, v in histogram.items() if k}, capacity)
    containers = sum(times for times, _ in patterns)

    slots: list[tuple[int, int, int, int]] = []  # length, first rank, end rank, first container
    used: dict[int, int] = {}
    first = 0
    for times, lengths in patterns:
        for length in lengths:
            a = used.get(length, 0)
            slots.append((length, a, a + times, first))
            used[length] = a + times
        first += times
    # of the slots of one length, neighbours in rank and container are one slot
    slots.sort()
    merged: list[list[int]] = []
    for s in slots:
        m = merged[-1] if merged else None
        if m and m[0] == s[0] and m[2] == s[1] and m[3] + (m[2] - m[1]) == s[3]:
            m[2] = s[2]
        else:
            merged.append(list(s))
    by_length: dict[int, list[list[int]]] = {}
    for length, a, _, container in merged:
        by_length.setdefault(length, []).append([a, container])
    table = {k: (np.array([x[0] for x in v]), np.array([x[1] for x in v])) for k, v in by_length.items()}

    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("length", "slice").orderBy("id", "size")) - 1
    ranked = body.where("length > 0").withColumn("r", local).join(offsets, ["length", "slice"])
    ranked = ranked.select("id", "length", "fulls", (F.col("r") + F.col("base")).alias("rank"))
    id_type = ranked.schema["id"].dataType.simpleString()

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            container = np.empty(len(pdf), np.int64)
            length, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            for one in np.unique(length):
                here = length == one
                from_rank, first_container = table[int(one)]
                at = np.searchsorted(from_rank, rank[here], "right") - 1
                container[here] = first_container[at] + rank[here] - from_rank[at]
            yield pd.DataFrame(
                {
                    "container_id": container,
                    "id": pdf["id"],
                    "piece_no": pdf["fulls"].astype(np.int32),
                    "token_start": pdf["fulls"] * capacity,
                    "n_tokens": pdf["length"].astype(np.int64),
                }
            )

    placed = ranked.mapInPandas(deal, f"container_id long, id {id_type}, piece_no int, token_start long, n_tokens long")
    # full pieces: numbered containers after the planned ones, by the item's prefix sum within its slice
    big = body.where("fulls > 0").groupBy("slice").agg(F.sum("fulls").alias("n"))
    big_base = big.select("slice", (F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + containers).alias("base"))
    inside = F.coalesce(F.sum("fulls").over(Window.partitionBy("slice").orderBy("id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fulls = (
        body.where("fulls > 0")
        .withColumn("before", inside)
        .join(big_base, "slice")
        .select("id", "before", "base", F.explode(F.sequence(F.lit(0), (F.col("fulls") - 1).cast("int"))).alias("piece_no"))
        .select(
            (F.col("base") + F.col("before") + F.col("piece_no")).alias("container_id"),
            "id",
            "piece_no",
            (F.col("piece_no").cast("long") * capacity).alias("token_start"),
            F.lit(capacity).cast("long").alias("n_tokens"),
        )
    )
    empty = body.where("size = 0").select(
        F.pmod(F.xxhash64("id"), F.lit(max(1, containers))).alias("container_id"),
        "id",
        F.lit(0).alias("piece_no"),
        F.lit(0).cast("long").alias("token_start"),
        F.lit(0).cast("long").alias("n_tokens"),
    )
    return placed.unionByName(fulls).unionByName(empty).select(F.lit(name).alias("window_name"), "container_id", "id", "piece_no", "token_start", "n_tokens")
