"""Agent measurements: samples, summary, ranking, winners, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.numbers import round_js
from sieveline.operators.ordered import running_sum


def bench_samples(runs: DataFrame, warmup: int = 1) -> DataFrame:
    """Measured samples: warm-up runs left out, latency at two digits, failures empty."""
    failed = F.col("error").isNotNull()
    return runs.where(F.col("run") >= warmup).select(
        "bridge", "seq",
        round_js(F.col("latency_ms"), 2).alias("latency_ms"),
        F.when(failed, F.lit(0)).otherwise(F.col("tokens")).cast("long").alias("tokens_used"),
        F.when(failed, F.lit("")).otherwise(F.col("content")).alias("content"),
        "error",
    )


def nearest_rank(samples: DataFrame, key: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact nearest-rank percentiles per key.

    Works on the distinct values with their counts: counts are combined before
    the shuffle and a running count over the values finds the ranks, so a key
    with most of the samples is never gathered in one place.
    """
    histogram = samples.groupBy(key, value).agg(F.count("*").alias("_n"))
    totals = histogram.groupBy(key).agg(F.sum("_n").alias("_total"))
    ranked = running_sum(histogram, "_n", [key], [value]).join(totals, key)

    def rank(q: float) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("_total")))

    return ranked.groupBy(key).agg(
        *[F.min(F.when(F.col("_through") >= rank(q), F.col(value))).alias(n) for n, q in quantiles.items()]
    )


def bench_summary(samples: DataFrame) -> DataFrame:
    """Counts, latency figures and token rates per bridge; failures count only as such."""
    ok = F.col("error").isNull()
    latency = F.when(ok, F.col("latency_ms"))
    n_ok, total_ms = F.count_if(ok), F.coalesce(F.sum(latency), F.lit(0.0))
    tokens = F.coalesce(F.sum(F.when(ok, F.col("tokens_used"))), F.lit(0))
    base = samples.groupBy("bridge").agg(
        F.count("*").alias("iterations"),
        F.count_if(~ok).alias("errors"),
        n_ok.alias("_ok"),
        total_ms.alias("_ms"),
        F.coalesce(F.min(latency), F.lit(0.0)).alias("min_latency_ms"),
        F.coalesce(F.max(latency), F.lit(0.0)).alias("max_latency_ms"),
        tokens.alias("total_tokens"),
    )
    ranks = nearest_rank(samples.where(ok), "bridge", "latency_ms", {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95})
    zero = F.lit(0.0)
    return base.join(ranks, "bridge", "left").select(
        "bridge", "iterations", "errors",
        F.when(F.col("_ok") > 0, round_js(F.col("_ms") / F.col("_ok"), 2)).otherwise(zero).alias("avg_latency_ms"),
        "min_latency_ms", "max_latency_ms",
        F.coalesce("p50_latency_ms", zero).alias("p50_latency_ms"),
        F.coalesce("p95_latency_ms", zero).alias("p95_latency_ms"),
        "total_tokens",
        F.when(F.col("_ok") > 0, round_js(F.col("total_tokens") / F.col("_ok"))).otherwise(F.lit(0)).alias("avg_tokens_per_request"),
        F.when(F.col("_ms") > 0, round_js(F.col("total_tokens") / (F.col("_ms") / 1000), 2)).otherwise(zero).alias("tokens_per_second"),
    )


def _order() -> list[Column]:
    return [(F.col("errors") == F.col("iterations")).asc(), F.col("avg_latency_ms").asc(), F.col("bridge").asc()]


def bench_ranking(summary: DataFrame) -> DataFrame:
    """Fastest first; bridges whose every sample failed last."""
    return summary.orderBy(*_order())


def bench_winners(summary: DataFrame) -> DataFrame:
    """Fastest bridge, its speed-up over the slowest, and the highest token rate."""
    key = F.struct((F.col("errors") == F.col("iterations")).alias("f"), "avg_latency_ms", "bridge")
    ends = summary.agg(
        F.count("*").alias("_n"),
        F.min_by(F.struct("bridge", "avg_latency_ms"), key).alias("_first"),
        F.max_by(F.struct("bridge", "avg_latency_ms"), key).alias("_last"),
        F.max_by(F.struct("bridge", "tokens_per_second"), F.struct("tokens_per_second", "bridge")).alias("_top"),
    )
    return ends.where((F.col("_n") > 1) & (F.col("_first.avg_latency_ms") > 0)).select(
        F.col("_first.bridge").alias("fastest"),
        F.col("_last.bridge").alias("slowest"),
        F.when(
            F.col("_last.avg_latency_ms") > 0,
            F.round(F.col("_last.avg_latency_ms") / F.col("_first.avg_latency_ms"), 1),
        ).alias("speedup"),
        F.when(F.col("_top.tokens_per_second") > 0, F.col("_top.bridge")).alias("highest_throughput"),
    )


def bench_errors(samples: DataFrame, shown: int = 120) -> DataFrame:
    """Bridges with failures: how many, and the first message, shortened for display."""
    failed = F.col("error").isNotNull()
    message = F.min_by(F.col("error"), F.when(failed, F.col("seq")))
    return (
        samples.groupBy("bridge")
        .agg(F.count("*").alias("iterations"), F.count_if(failed).alias("errors"), message.alias("_m"))
        .where("errors > 0")
        .select(
            "bridge",
            F.concat(F.col("errors").cast("string"), F.lit("/"), F.col("iterations").cast("string"), F.lit(" failed")).alias("failures"),
            F.when(F.length("_m") > shown, F.concat(F.substring("_m", 1, shown), F.lit("..."))).otherwise(F.col("_m")).alias("first_error"),
        )
    )
