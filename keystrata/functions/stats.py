"""Measures of a log: runs, sizes, amplification, and latency summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.functions.keys import entry_bytes, is_tombstone
from keystrata.operators.versions import latest


def run_stats(log: DataFrame) -> DataFrame:
    """epoch, min_key, max_key, n_entries, n_tombstones."""
    return log.groupBy("epoch").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n_entries"), F.count(F.when(is_tombstone(), 1)).alias("n_tombstones"))


def sorted_map_size(log: DataFrame) -> DataFrame:
    """key and size_bytes of each key's newest version."""
    return latest(log).select("key", entry_bytes().alias("size_bytes"))


def space_amplification(log: DataFrame) -> DataFrame:
    """log_rows, live_rows and their ratio (null without live rows)."""
    newest = latest(log)
    counts = log.agg(F.count("*").alias("log_rows")).crossJoin(newest.agg(F.count(F.when(~is_tombstone(), 1)).alias("live_rows")))  # one row each
    return counts.withColumn("amplification", F.when(F.col("live_rows") > 0, F.col("log_rows") / F.col("live_rows")))


def hit_rate(found: DataFrame) -> DataFrame:
    """n_keys, n_hits and hit_rate of a multi-get's (key, value)."""
    hits = F.count("value")
    return found.agg(F.count("*").alias("n_keys"), hits.alias("n_hits"), F.when(F.count("*") > 0, hits / F.count("*")).alias("hit_rate"))


def latency_summary(seconds: Sequence[float]) -> dict[str, float]:
    """min, max, mean, median, p95 and p99 of timings, in milliseconds; the percentile of n is element int(n p)."""
    if not seconds:
        return {}
    ordered = sorted(x * 1000 for x in seconds)
    n = len(ordered)
    middle = ordered[n // 2] if n % 2 else (ordered[n // 2 - 1] + ordered[n // 2]) / 2
    at = lambda p: ordered[min(n - 1, int(n * p))]
    return {"min": ordered[0], "max": ordered[-1], "mean": sum(ordered) / n, "median": middle, "p95": at(0.95), "p99": at(0.99)}
