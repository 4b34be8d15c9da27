"""Percentiles of large numeric columns from mergeable quantile digests.

Values are quantised monotonically to a universe of 2**BITS leaves.  A digest
holds counts at nodes of the dyadic tree over the universe; compressing moves
the counts of light nodes to their parents, which bounds the number of nodes
and the error of any rank.  Digests are merged by adding counts node by node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut_lineage, ship

BITS = 16
#: Values whose ranks one pass over the digests looks up; more take more passes.
MAX_MARKS = 1000
#: Leaves per e-fold; the logarithm of the largest double lands below 2**BITS.
_PER_E = (2**BITS - 1) / 710.0


def leaf_of(value: Column) -> Column:
    """Leaf of a value that is not negative; larger values never have smaller leaves."""
    return F.least(F.floor(F.log1p(value) * F.lit(_PER_E)), F.lit(2**BITS - 1)).cast("int")


def leaf_bounds(leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value a leaf can hold, with a hair's breadth added for rounding."""
    with np.errstate(over="ignore"):
        low, high = np.expm1(leaf / _PER_E), np.expm1((leaf + 1) / _PER_E)
    return np.maximum(low * (1 - 1e-9) - 1e-12, 0), high * (1 + 1e-9) + 1e-12


def compress(
    group: np.ndarray, level: np.ndarray, node: np.ndarray, count: np.ndarray, error: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Compress the digests of several groups: (group, level, node, count), level 0 being the leaves.

    Children whose family (both children and the parent) counts at most
    n * error / BITS are moved to the parent, bottom up.  The nodes above any
    leaf are BITS at most, so their counts add up to at most n * error: that is
    the error of a rank.
    """
    limit = np.bincount(group, count) * (error / BITS)
    wide = BITS + 1
    out: list[tuple[np.ndarray, ...]] = []
    key, here = np.empty(0, np.int64), np.empty(0, np.int64)
    for at in range(BITS + 1):
        mine = level == at
        key, back = np.unique(np.concatenate([key, (group[mine] << wide) + node[mine]]), return_inverse=True)
        here = np.bincount(back, np.concatenate([here, count[mine]]), len(key)).astype(np.int64)
        owner, number = key >> wide, key & ((1 << wide) - 1)
        up = np.zeros(len(key), bool)
        parent = (owner << wide) + (number >> 1)
        if at < BITS and len(key):
            family, which = np.unique(parent, return_inverse=True)
            weight = np.bincount(which, here, len(family))
            above = level == at + 1
            if above.any():
                wanted = (group[above] << wide) + node[above]
                p = np.minimum(np.searchsorted(family, wanted), len(family) - 1)
                ok = family[p] == wanted
                np.add.at(weight, p[ok], count[above][ok])
            up = (weight <= limit[family >> wide])[which]
        keep = ~up
        out.append((owner[keep], np.full(int(keep.sum()), at), number[keep], here[keep]))
        key, here = parent[up], here[up]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_NODES = "level int, node int, count long"
_ROWS_AT_ONCE = 200_000


def _group_runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows sorted by keys, in frames of whole groups, with the number of each row's group in its frame."""

    def numbered(pdf: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(pdf), bool)
        for k in keys:
            code = pd.factorize(pdf[k], use_na_sentinel=False)[0]
            new[1:] |= code[1:] != code[:-1]
        return np.cumsum(new)

    held: list[pd.DataFrame] = []
    for pdf in batches:
        held.append(pdf)
        if sum(map(len, held)) >= _ROWS_AT_ONCE:
            pdf = pd.concat(held, ignore_index=True)
            group = numbered(pdf)
            whole = group < group[-1]  # the last group may go on in the next batch
            if whole.any():
                yield pdf[whole], group[whole]
            held = [pdf[~whole].reset_index(drop=True)]
    if held and sum(map(len, held)):
        pdf = pd.concat(held, ignore_index=True)
        yield pdf, numbered(pdf)


def _compressed(df: DataFrame, keys: list[str], error: float) -> DataFrame:
    """Compress the digest of each group of ``keys``, which has at most 2**(BITS+1) nodes."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, group in _group_runs(batches, keys):
            owner, lev, node, cnt = compress(
                group, pdf["level"].to_numpy(np.int64), pdf["node"].to_numpy(np.int64), pdf["count"].to_numpy(np.int64), error
            )
            first = np.r_[0, np.flatnonzero(np.diff(group)) + 1][owner]
            out = pdf[keys].iloc[first].reset_index(drop=True)
            yield out.assign(level=lev.astype(np.int32), node=node.astype(np.int32), count=cnt)

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + _NODES
    rows = df.select(*keys, "level", "node", "count").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInPandas(run, schema)


def digests(values: DataFrame, keys: list[str], value_col: str, *, error: float = 0.002) -> DataFrame:
    """A digest for each group: ``keys..., level, node, count``.

    Null, NaN and negative values are left out.  Counts per leaf are added up
    before the shuffle, so a group's size in it is bounded by the universe and
    not by its rows.  Groups without usable values have no digest.
    """
    v = F.col(value_col)
    ship(values.sparkSession)
    leaves = (
        values.where(v.isNotNull() & ~F.isnan(v) & (v >= 0))
        .groupBy(*keys, leaf_of(v).alias("node"))
        .agg(F.count("*").alias("count"))
        .withColumn("level", F.lit(0))
    )
    return _compressed(leaves, keys, error)


def merge(parts: DataFrame, keys: list[str], *, error: float = 0.002) -> DataFrame:
    """Add up digests, node by node, to one for each group of ``keys`` and compress again.

    Rank errors add: parts of error e merged with error m have an error of at
    most e + m.
    """
    added = parts.groupBy(*keys, "level", "node").agg(F.sum("count").alias("count"))
    return _compressed(added, keys, error)


def rank_bounds(parts: DataFrame, keys: list[str], at: DataFrame, at_col: str) -> DataFrame:
    """Bounds on how many values of each group are at most a given value.

    ``at`` is a table of values; returns ``keys..., at's columns, n, surely,
    possibly``.  What is sure counts nodes that end before the value's leaf,
    what is possible those that start at or before it.  Values become literals
    of the plan, in blocks of MAX_MARKS.
    """
    extra = at.columns
    kinds = at.schema
    shift = F.expr("shiftleft(1L, level)")
    low, high = F.col("node") * shift, (F.col("node") + 1) * shift - 1
    marks = at.withColumn("__leaf", leaf_of(F.col(at_col))).collect()
    result = None
    for first in range(0, max(len(marks), 1), MAX_MARKS):
        structs = [F.struct(*[F.lit(r[c]).cast(kinds[c].dataType).alias(c) for c in extra], F.lit(r["__leaf"]).alias("__leaf")) for r in marks[first : first + MAX_MARKS]]
        kind = "struct<" + ",".join(f"`{c}`:{kinds[c].dataType.simpleString()}" for c in extra) + ",__leaf:int>"
        array = F.array(*structs).cast(f"array<{kind}>")
        each = parts.select(*keys, "count", low.alias("lo"), high.alias("hi"), F.explode(array).alias("__m"))
        one = each.groupBy(*keys, *[F.col(f"__m.{c}").alias(c) for c in extra]).agg(
            F.sum("count").alias("n"),
            F.sum(F.when(F.col("hi") < F.col("__m.__leaf"), F.col("count")).otherwise(0)).alias("surely"),
            F.sum(F.when(F.col("lo") <= F.col("__m.__leaf"), F.col("count")).otherwise(0)).alias("possibly"),
        )
        result = one if result is None else result.unionByName(one)
    return result


def percentiles(parts: DataFrame, keys: list[str], targets: DataFrame) -> DataFrame:
    """``keys..., quantile_name, n, low, high, estimate`` for each group and target quantile.

    The true percentile (smallest value with at least that share at or below
    it) lies in [low, high].
    """
    types = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    wanted = [(r[0], float(r[1])) for r in targets.select("quantile_name", "quantile").distinct().orderBy("quantile").collect()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, group in _group_runs(batches, keys):
            edges = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(group)]
            rows = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                pdf = frame.iloc[a:b]
                lev, node, cnt = pdf["level"].to_numpy(np.int64), pdf["node"].to_numpy(np.int64), pdf["count"].to_numpy(np.int64)
                lo, hi, n = node << lev, ((node + 1) << lev) - 1, int(cnt.sum())
                by_hi, by_lo = np.argsort(hi, kind="stable"), np.argsort(lo, kind="stable")
                sure, may = np.cumsum(cnt[by_hi]), np.cumsum(cnt[by_lo])
                for name, q in wanted:
                    rank = max(1, int(np.ceil(round(q * n, 9))))
                    top = hi[by_hi][np.searchsorted(sure, rank)]
                    bottom = lo[by_lo][np.searchsorted(may, rank)]
                    low, high = leaf_bounds(np.array([bottom]))[0][0], leaf_bounds(np.array([top]))[1][0]
                    rows.append((*(pdf[k].iloc[0] for k in keys), name, n, low, high, (low + high) / 2 if np.isfinite(high) else low))
            yield pd.DataFrame(rows, columns=[*keys, "quantile_name", "n", "low", "high", "estimate"])

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", quantile_name string, n long, low double, high double, estimate double"
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def latest_latencies(results: DataFrame) -> DataFrame:
    """``collection, day, latency_ms``: each query_id's row with the greatest created_at, if its latency is valid.

    Rows without query_id or created_at are no results.  Of rows with the same
    created_at the one with the greatest latency holds (NaN above all numbers,
    null below), then the greatest collection.  ``day`` counts days since
    1970-01-01 (UTC).
    """
    usable = results.where("query_id IS NOT NULL AND created_at IS NOT NULL AND NOT isnan(created_at)")
    last = usable.groupBy("query_id").agg(F.max(F.struct("created_at", "latency_ms", "collection")).alias("r"))
    v = F.col("r.latency_ms")
    return last.where(v.isNotNull() & ~F.isnan(v) & (v >= 0)).select(
        F.col("r.collection").alias("collection"), F.floor(F.col("r.created_at") / 86400).cast("int").alias("day"), v.alias("latency_ms")
    )


def week_of(day: Column) -> Column:
    """Day number of the Monday that starts the week of a day number."""
    return (day - F.pmod(day + 3, F.lit(7))).cast("int")


def slow_weeks(results: DataFrame, targets: DataFrame, *, least: int = 20, error: float = 0.002) -> DataFrame:
    """``collection, week_start, quantile_name`` of the weeks whose percentile exceeds its limit.

    Daily digests are merged to weeks.  Where the rank bounds of the limit leave
    open whether the percentile exceeds it, the values of those weeks at most
    the limit are counted exactly.  Weeks with fewer than ``least`` valid
    latencies give no row; a null collection is a group of its own; targets
    with nulls are left out.
    """
    ship(results.sparkSession)
    values = cut_lineage(latest_latencies(results))
    marks = targets.where("quantile_name IS NOT NULL AND quantile IS NOT NULL AND limit_ms IS NOT NULL").select("quantile_name", "quantile", "limit_ms").distinct()
    daily = digests(values, ["collection", "day"], "latency_ms", error=error)
    weekly = merge(daily.withColumn("week", week_of(F.col("day"))), ["collection", "week"], error=error)
    # a negative limit is exceeded by every value
    bounds = cut_lineage(
        rank_bounds(weekly, ["collection", "week"], marks.withColumn("__at", F.greatest("limit_ms", F.lit(0.0))), "__at")
        .where(F.col("n") >= least)
        .withColumn("rank", F.greatest(F.lit(1), F.ceil(F.round(F.col("quantile") * F.col("n"), 9))))
        .withColumn("surely", F.when(F.col("limit_ms") < 0, 0).otherwise(F.col("surely")))
        .withColumn("possibly", F.when(F.col("limit_ms") < 0, 0).otherwise(F.col("possibly")))
    )
    found = bounds.where("possibly < rank").select("collection", "week", "quantile_name")
    unclear = bounds.where("possibly >= rank AND surely < rank").select("collection", "week", "quantile_name", "limit_ms", "rank")
    counted = (
        values.withColumn("week", week_of(F.col("day")))
        .alias("v")
        .join(unclear.alias("u"), F.col("v.collection").eqNullSafe(F.col("u.collection")) & (F.col("v.week") == F.col("u.week")))
        .groupBy("u.collection", "u.week", "u.quantile_name", "u.rank")
        .agg(F.sum(F.when(F.col("v.latency_ms") <= F.col("u.limit_ms"), 1).otherwise(0)).alias("below"))
        .where("below < rank")
        .select("collection", "week", "quantile_name")
    )
    return found.unionByName(counted).select("collection", F.date_add(F.lit("1970-01-01").cast("date"), F.col("week")).cast("string").alias("week_start"), "quantile_name")
