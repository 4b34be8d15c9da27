import math
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import packing, quantiles


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
def test_plan_uses_everything_once(counts):
    used = defaultdict(int)
    containers = 0
    for times, lengths in packing.plan(counts, 40):
        assert sum(lengths) <= 40 and times > 0
        containers += times
        for x in lengths:
            used[x] += times
    assert used == counts
    total = sum(k * v for k, v in counts.items())
    assert containers <= max(1, 2 * math.ceil(total / 40)) if total else containers == 0


def test_plan_fills_well():
    rng = random.Random(2)
    counts = defaultdict(int)
    for _ in range(5000):
        counts[min(512, int(rng.lognormvariate(4.5, 1)) + 1)] += 1
    total = sum(k * v for k, v in counts.items())
    assert total / 512 / sum(t for t, _ in packing.plan(dict(counts), 512)) > 0.99


def test_pack(spark):
    rng = random.Random(3)
    sizes = {i: rng.choice([0, 3, 7, 7, 7, 10, 25, 40]) for i in range(400)}
    rows = spark.createDataFrame([*sizes.items(), (1000, None)], "doc_id int, n_tokens int")
    windows = spark.createDataFrame([("w", 10), ("v", 64), ("bad", 0), ("none", None)], "window_name string, capacity_tokens int")
    out = packing.pack(rows, windows, rows_per_rank=50).collect()
    for name, capacity in (("w", 10), ("v", 64)):
        load, pieces = defaultdict(int), defaultdict(list)
        for r in out:
            if r.window_name == name:
                load[r.container_id] += r.n_tokens
                pieces[r.doc_id].append((r.piece_no, r.token_start, r.n_tokens))
        assert max(load.values()) <= capacity and set(pieces) == {*sizes, 1000}
        for i, n in sizes.items():
            own = sorted(pieces[i])
            assert [p[1] for p in own] == list(range(0, max(n, 1), capacity)) and sum(p[2] for p in own) == n
        total = sum(sizes.values())
        assert total / capacity / len([v for v in load.values() if v]) > 0.9
    assert {r.window_name for r in out} == {"w", "v"}
    assert packing.pack(rows.where("false"), windows).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 1e9), min_size=1, max_size=300), st.sampled_from([0.01, 0.1]))
def test_digest_rank_error(values, error):
    leaf = np.minimum(np.floor(np.log1p(np.array(values)) * quantiles._PER_E), 2**quantiles.BITS - 1).astype(np.int64)
    node, count = np.unique(leaf, return_counts=True)
    zero = np.zeros(len(node), np.int64)
    _, level, node, count = quantiles.compress(zero, zero, node, count, error)
    assert count.sum() == len(values)
    low, high = node << level, ((node + 1) << level) - 1
    for x in np.unique(leaf):
        sure, may, true = count[high <= x].sum(), count[low <= x].sum(), (leaf <= x).sum()
        assert sure <= true <= may and may - sure <= error * len(values) + 1e-9


def results(spark, rows):
    return spark.createDataFrame(rows, "query_id string, collection string, latency_ms double, created_at double")


def test_slow_weeks_against_plain_version(spark):
    rng = random.Random(5)
    day, rows = 86400.0, []
    for i in range(6000):
        rows.append((f"q{i % 4500}", rng.choice(["a", "b", None]), rng.choice([rng.lognormvariate(5.9, 1), 400.0, None, float("nan"), -1.0, 1e300]), 17532 * day + rng.random() * 30 * day))
    rows += [(None, "a", 1.0, 5.0), ("z", "a", 1.0, None)] + rows[:50]
    targets = spark.createDataFrame([("p50", 0.5, 400.0), ("p95", 0.95, 2000.0), ("neg", 0.5, -1.0), (None, 0.5, 1.0)], "quantile_name string, quantile double, limit_ms double")
    last = {}
    for q, c, v, t in rows:
        if q and t is not None and (q not in last or t > last[q][2]):
            last[q] = (c, v, t)
    groups = defaultdict(list)
    for c, v, t in last.values():
        if v is not None and v >= 0:
            d = int(t // day)
            groups[c, d - (d + 3) % 7].append(v)
    want = set()
    for (c, w), vs in groups.items():
        vs.sort()
        for name, q, limit in (("p50", 0.5, 400.0), ("p95", 0.95, 2000.0), ("neg", 0.5, -1.0)):
            if len(vs) >= 20 and vs[max(1, math.ceil(round(q * len(vs), 9))) - 1] > limit:
                want.add((c, str(np.datetime64(w, "D")), name))
    for error in (0.002, 0.3):
        got = {tuple(r) for r in quantiles.slow_weeks(results(spark, rows), targets, error=error).collect()}
        assert got == want
    assert quantiles.slow_weeks(results(spark, []), targets).count() == 0


def test_percentile_bounds(spark):
    rng = random.Random(6)
    values = [rng.lognormvariate(3, 2) for _ in range(3000)]
    df = spark.createDataFrame([("g", i % 5, v) for i, v in enumerate(values)], "g string, day int, v double")
    weekly = quantiles.merge(quantiles.digests(df, ["g", "day"], "v"), ["g"])
    targets = spark.createDataFrame([("p50", 0.5), ("p99", 0.99), ("max", 1.0)], "quantile_name string, quantile double")
    values.sort()
    for r in quantiles.percentiles(weekly, ["g"], targets).collect():
        q = {"p50": 0.5, "p99": 0.99, "max": 1.0}[r.quantile_name]
        assert r.n == 3000 and r.low <= values[math.ceil(q * 3000) - 1] <= r.high
        assert r.high <= values[min(2999, math.ceil((q + 0.005) * 3000))] * 1.02 + 1e-6


def test_triples_behind_stale_marks():
    counts = {a: 1 for a in range(1000, 1101)} | {1: 1, 250: 2} | {a: 1 for a in range(399, 499)}
    items = packing._Lengths(counts, 2000)
    for a in [1, *range(399, 499)]:
        items.left[a] = 0
    assert sorted(items.exact(1500) or []) == [250, 250, 1000]


def test_more_targets_than_a_pass_takes(spark):
    rows = [(f"q{i}", "a", float(i), 17532 * 86400.0 + i) for i in range(40)]
    targets = spark.createDataFrame([(f"t{i}", 0.5, float(i)) for i in range(1001)], "quantile_name string, quantile double, limit_ms double")
    got = {r.quantile_name for r in quantiles.slow_weeks(results(spark, rows), targets).collect()}
    assert got == {f"t{i}" for i in range(19)}
