"""Runs of equal values, cold starts, warm-up: gaps and islands over a device's rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHANNELS, Guard


def by_time():
    """A device's rounds in order of time."""
    return Window.partitionBy("device").orderBy("ts")


def cold_start(rounds: DataFrame, gap: int) -> DataFrame:
    """Adds cold: more than `gap` seconds since the device's round before (false for the first)."""
    return rounds.withColumn("cold", F.coalesce(F.col("ts") - F.lag("ts").over(by_time()) > gap, F.lit(False)))


def warmup(rounds: DataFrame, n: int) -> DataFrame:
    """Adds number (from 1) and warmup: the first n rounds of a device, the n-th included, complete or not."""
    return rounds.withColumn("number", F.row_number().over(by_time())).withColumn("warmup", F.col("number") <= n)


def channel_rows(rounds: DataFrame, *also: str) -> DataFrame:
    """A row for each round and channel: device, ts, channel, x (null where missing)."""
    cells = F.array(*[F.col(f"x{c}") for c in range(CHANNELS)])
    return rounds.select("device", "ts", *also, F.posexplode(cells).alias("channel", "x"))


def repeat_runs(rounds: DataFrame, guard: Guard, cold_gap: int) -> DataFrame:
    """device, ts, channel, run_len, run_start, stuck, floor for each present value.

    A run grows while the value stays the same and the channel's last value is at most guard.gap old; missing
    rounds do not touch it, a cold start ends all runs of a device. At its threshold a run is stuck, or floor
    if its value is one that may repeat; below it length and start are reported as 0.
    """
    cold = cold_start(rounds, cold_gap).withColumn("era", F.sum(F.col("cold").cast("int")).over(by_time()))
    cells = channel_rows(cold, "era").where(F.col("x").isNotNull())
    series = Window.partitionBy("device", "channel").orderBy("ts")
    before = F.lag(F.struct("x", "ts", "era")).over(series)
    same = (before["x"] == F.col("x")) & (F.col("ts") - before["ts"] <= guard.gap) & (before["era"] == F.col("era"))
    cells = cells.withColumn("run", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(series))
    own = Window.partitionBy("device", "channel", "run").orderBy("ts")
    cells = cells.withColumn("n", F.row_number().over(own)).withColumn("start", F.first("ts").over(own))
    limit = F.element_at(F.array(*map(F.lit, guard.thresholds)), F.col("channel") + 1)
    at_floor = F.lit(False)
    for c, values in guard.floors.items():
        at_floor = at_floor | ((F.col("channel") == c) & F.col("x").isin(*values))
    long = (limit > 0) & (F.col("n") >= limit)
    return cells.select(
        "device", "ts", "channel",
        F.when(long, F.col("n")).otherwise(0).cast("long").alias("run_len"),
        F.when(long, F.col("start")).otherwise(0).cast("long").alias("run_start"),
        (long & ~at_floor).alias("stuck"), (long & at_floor).alias("floor"), (F.col("n") == limit).alias("crossed"),
    )


def run_ends(rounds: DataFrame, guard: Guard, cold_gap: int) -> DataFrame:
    """device, channel, length, runs: how many runs of each length there are."""
    free = Guard(thresholds=(1,) * CHANNELS, floors={}, gap=guard.gap)
    runs = repeat_runs(rounds, free, cold_gap).groupBy("device", "channel", "run_start").agg(F.max("run_len").alias("length"))
    return runs.groupBy("device", "channel", "length").agg(F.count(F.lit(1)).alias("runs"))


def gaps(rounds: DataFrame, longer: int) -> DataFrame:
    """device, start, stop, seconds of every gap between a device's rounds that is longer than `longer`."""
    before = F.lag("ts").over(by_time())
    rows = rounds.select("device", before.alias("start"), F.col("ts").alias("stop"))
    return rows.where(F.col("stop") - F.col("start") > longer).withColumn("seconds", F.col("stop") - F.col("start"))


def longest_gaps(rounds: DataFrame, longer: int, n: int = 100) -> DataFrame:
    """The n longest gaps, ties by device and start."""
    return gaps(rounds, longer).orderBy(F.col("seconds").desc(), "device", "start").limit(n)


def last_rounds(rounds: DataFrame, length: int) -> DataFrame:
    """device, ts, ring: the ts of the last `length` rounds, oldest first."""
    ring = F.collect_list("ts").over(by_time().rowsBetween(-(length - 1), 0))
    return rounds.select("device", "ts", ring.alias("ring"))
