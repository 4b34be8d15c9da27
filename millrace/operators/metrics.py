"""Operational metrics of queries, tasks, token usage and traces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULT_JSON = "mode string, top_k int, n_chunks int, degraded boolean, degraded_reasons array<string>, error string"


def rate(part: Column, whole: Column) -> Column:
    """Percentage with one digit, half to even; null for a whole of 0."""
    return F.bround(F.try_divide(part * 100.0, whole), 1)


def nearest_rank(value: str, share: float) -> Column:
    """Smallest value with at least that share at or below it."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})")


def decoded(results: DataFrame) -> DataFrame:
    """Query results with their JSON decoded; rows whose JSON is broken are left out, an absent latency counts as 0, an empty error as none."""
    r = F.from_json("result_json", RESULT_JSON + ", broken string", {"columnNameOfCorruptRecord": "broken"})
    rows = results.where("result_json IS NOT NULL").withColumn("r", r).where("r.broken IS NULL")
    return rows.select(
        "query_id", "collection", "created_at", "source",
        F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms"),
        F.col("r.mode").alias("mode"), F.col("r.top_k").alias("top_k"), F.coalesce("r.n_chunks", F.lit(0)).alias("n_chunks"),
        (F.coalesce("r.error", F.lit("")) == "").alias("succeeded"), F.coalesce("r.degraded", F.lit(False)).alias("degraded"), F.col("r.degraded_reasons").alias("reasons"),
    )


def _leaf(value: Column) -> Column:
    """Number of a stretch of values; larger values never have smaller numbers. About 1.5 % wide."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * 64)


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``keys..., a column for each share``: the smallest value with at least that share of its group's values at or below it. Nulls aside."""
    return values_at(rows, keys, value, {name: lambda n, share=share: F.ceil(F.round(share * n, 9)) for name, share in shares.items()})


def values_at(rows: DataFrame, keys: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``keys..., a column for each place``: the value at that place (from 1, a function of the group's number of values) in order.

    Values are counted by narrow stretches first; then only the stretch that
    holds the place is looked at value by value, so no task gets a whole group.
    """
    v = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"), _leaf(F.col(value)).alias("__leaf"))
    counts = v.groupBy(*keys, "__leaf").agg(F.count("*").alias("__n"))
    by_leaf = Window.partitionBy(*keys).orderBy("__leaf")
    run = counts.withColumn("__to", F.sum("__n").over(by_leaf)).withColumn("__all", F.sum("__n").over(Window.partitionBy(*keys)))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), place(F.col("__all")).cast("long")).alias("rank")) for name, place in places.items()])
    wanted = run.withColumn("__r", F.explode(ranks)).where((F.col("__r.rank") <= F.col("__to")) & (F.col("__r.rank") > F.col("__to") - F.col("__n")))
    wanted = wanted.select(*keys, "__leaf", F.col("__r.name").alias("__name"), (F.col("__r.rank") - F.col("__to") + F.col("__n")).alias("__rank"))
    inside = v.groupBy(*keys, "__leaf", "__v").agg(F.count("*").alias("__n"))
    same = [inside[k].eqNullSafe(wanted[k]) for k in [*keys, "__leaf"]]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    both = inside.join(wanted, condition).select(*[inside[k] for k in keys], "__name", "__rank", "__v", "__n")
    upto = F.sum("__n").over(Window.partitionBy(*keys, "__name").orderBy("__v"))
    found = both.withColumn("__to", upto).where(F.col("__to") >= F.col("__rank")).groupBy(*keys, "__name").agg(F.min("__v").alias("__v"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in places])


def query_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, rates over all queries and p95 of latency for each group."""
    found = F.col("n_chunks") > 0
    n = F.count("*")
    counts = rows.groupBy(*keys).agg(
        n.alias("queries"),
        rate(F.count_if(F.col("succeeded") & found & ~F.col("degraded")), n).alias("effective_rate"),
        rate(F.count_if(F.col("succeeded") & ~found), n).alias("no_result_rate"),
        rate(F.count_if("degraded"), n).alias("degraded_rate"),
    )
    p = exact_percentiles(rows, keys, "latency_ms", {"p95_ms": 0.95})
    same = F.lit(True)
    for k in keys:
        same = same & counts[k].eqNullSafe(p[k])
    return counts.join(p, same, "left").select(*[counts[c] for c in counts.columns], "p95_ms")


def latency_overview(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean latency and mean number of results (one digit, half to even), with the share of queries that succeeded."""
    return rows.groupBy(*keys).agg(
        F.bround(F.avg("latency_ms"), 1).alias("avg_latency_ms"), F.bround(F.avg("n_chunks"), 1).alias("avg_results"), rate(F.count_if("succeeded"), F.count("*")).alias("success_rate")
    )


def benchmark_percentiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys..., n, p50, p95, p99``: the median (mean of the two middle values) and the values at place round(share * n), from 1; half to even."""
    places = {"low": lambda n: F.floor((n + 1) / 2), "high": lambda n: F.ceil((n + 1) / 2), "p95": lambda n: F.bround(n * 0.95, 0), "p99": lambda n: F.bround(n * 0.99, 0)}
    n = rows.groupBy(*keys).agg(F.count(value).alias("n"))
    return n.join(values_at(rows, keys, value, places), keys).select(*keys, "n", ((F.col("low") + F.col("high")) / 2).alias("p50"), "p95", "p99")


def corpus_rollup(collections: DataFrame) -> DataFrame:
    """One row for all collections (documents, chunks, updated_at, failed, unfinished): sums, the latest update and the state of the whole."""
    state = F.when(F.sum("failed") > 0, "attention").when(F.sum("unfinished") > 0, "indexing").otherwise("ready")
    return collections.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.max("updated_at").alias("updated_at"), state.alias("index_status"))


def earliest(events: DataFrame, column: str) -> DataFrame:
    """The time of the first event; null without events."""
    return events.agg(F.min(column).alias("earliest"))


def attention(metrics: DataFrame, limit_ms: float = 2000, top: int = 5) -> DataFrame:
    """The collections that need attention first: those over the limit, then by p95 and number of queries."""
    flagged = metrics.withColumn("attention", F.col("p95_ms") > limit_ms)
    return flagged.orderBy(F.desc("attention"), F.desc("p95_ms"), F.desc("queries"), "collection").limit(top)


def ingestion_metrics(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Success rate among tasks that ended (skipped ones aside) and the number that failed."""
    done = F.count_if(F.col("status").isin("succeeded", "failed", "cancelled"))
    return tasks.groupBy(*keys).agg(
        F.count("*").alias("tasks"), rate(F.count_if(F.col("status") == "succeeded"), done).alias("success_rate"), F.count_if(F.col("status").isin("failed", "cancelled")).alias("failed")
    )


def trend(rows: DataFrame, column: str, start: float, end: float, buckets: int) -> DataFrame:
    """``bucket, queries, effective_rate, p95_ms`` of equal stretches of [start, end); empty ones too."""
    width = (end - start) / buckets
    at = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor((F.col(column) - start) / width))).cast("int")
    inside = rows.where((F.col(column) >= start) & (F.col(column) < end))
    inside = inside.withColumn("bucket", at)
    ok = F.col("succeeded") & (F.col("n_chunks") > 0) & ~F.col("degraded")
    n = inside.groupBy("bucket").agg(F.count("*").alias("queries"), rate(F.count_if(ok), F.count("*")).alias("effective_rate"))
    n = n.join(exact_percentiles(inside, ["bucket"], "latency_ms", {"p95_ms": 0.95}), "bucket", "left")
    every = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(n, "bucket", "left").select("bucket", F.coalesce("queries", F.lit(0)).alias("queries"), "effective_rate", "p95_ms")


def usage(events: DataFrame, start: float, end: float) -> DataFrame:
    """Tokens used in [start, end): all, for queries and for ingestion; zeros without events. Other operations are not counted."""
    rows = events.where((F.col("occurred_at") >= start) & (F.col("occurred_at") < end) & F.col("operation").isin("query", "ingestion"))
    of = lambda op: F.coalesce(F.sum(F.when(F.col("operation") == op, F.col("token_count"))), F.lit(0))
    return rows.agg(F.coalesce(F.sum("token_count"), F.lit(0)).alias("total"), of("query").alias("query"), of("ingestion").alias("ingestion"))


def compare(rows: DataFrame, column: str, now: float, width: float, keys: list[str]) -> DataFrame:
    """Queries of the last stretch and the one before it."""
    current = (F.col(column) >= now - width) & (F.col(column) < now)
    previous = (F.col(column) >= now - 2 * width) & (F.col(column) < now - width)
    return rows.where(current | previous).groupBy(*keys).agg(F.count_if(current).alias("now"), F.count_if(previous).alias("before"))


def worst_status(rows: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """The worst of down, degraded and ok in each group."""
    order = F.when(F.col(status) == "down", 3).when(F.col(status) == "degraded", 2).otherwise(1)
    return rows.groupBy(*keys).agg(F.max_by(status, order).alias("worst"))


def stage_times(traces: DataFrame) -> DataFrame:
    """``trace_id, stage, elapsed`` from arrays of stages (name, ts): last minus first entry, 0 for a single one."""
    e = traces.select("trace_id", F.posexplode("stages").alias("at", "s"))
    return e.groupBy("trace_id", F.col("s.name").alias("stage")).agg((F.max_by("s.ts", "at") - F.min_by("s.ts", "at")).alias("elapsed"))


def entry_times(entries: DataFrame, time_col: str, order: list[str]) -> DataFrame:
    """``trace_id, stage, elapsed`` of single entries: last minus first of a stage, without bringing a trace together."""
    at = F.struct(*order)
    return entries.groupBy("trace_id", "stage").agg((F.max_by(time_col, at) - F.min_by(time_col, at)).alias("elapsed"))


def trace_search(traces: DataFrame, word: str) -> DataFrame:
    """Traces with a stage whose name, event or another value contains a word, whatever its case; names of fields don't count."""
    fields = traces.schema["stages"].dataType.elementType.names
    has = lambda s: F.exists(F.array(*[s[f].cast("string") for f in fields]), lambda v: F.contains(F.lower(v), F.lit(word.lower())))
    return traces.where(F.coalesce(F.exists("stages", has), F.lit(False)))


def trace_times(traces: DataFrame) -> DataFrame:
    """``trace_id, total`` seconds from start to finish; -1 where one of them is absent."""
    return traces.select("trace_id", F.coalesce(F.col("finished_at") - F.col("started_at"), F.lit(-1.0)).alias("total"))


def upload_progress(files: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., progress`` of uploads (percent, settled): settled files count as whole, others by their percentage within [0, 100]."""
    each = F.when(F.col("settled"), 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce("percent", F.lit(0.0)))))
    return files.groupBy(*keys).agg((F.sum(each) / F.count("*")).alias("progress"))


def stage_progress(current: Column, total: Column) -> Column:
    """Whole percentage (half to even) within [0, 100]; 0 without a positive total."""
    percent = F.bround(F.try_divide(current * 100.0, total), 0)
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), percent))).otherwise(0.0).cast("int")
