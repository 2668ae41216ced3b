"""Profiling of readings and rounds: counts, duplicates, gaps, histograms, daily profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def channel_stats(readings: DataFrame) -> DataFrame:
    """device, sensor, n, mean, sd, low, high: partial results are merged by the engine."""
    return readings.groupBy("device", "sensor").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"))


def channel_rollup(readings: DataFrame) -> DataFrame:
    """device, sensor, month, level, n, total over (device, sensor, month), (device, sensor), (device) and all."""
    month = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM")
    return readings.withColumn("month", month).rollup("device", "sensor", "month").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sparse_histogram(readings: DataFrame, low: float, width: float, bins: int, *keys: str) -> DataFrame:
    """keys, bin, n: fixed-width bins, values beyond the ends in the outer ones."""
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("value") - low) / width))).cast("int")
    return readings.groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_quantile(hist: DataFrame, q: float, low: float, width: float, *keys: str) -> DataFrame:
    """keys, q: the quantile read from a histogram, linear within its bin."""
    part = Window.partitionBy(*keys)
    upto = F.sum("n").over(part.orderBy("bin"))
    rows = hist.withColumn("upto", upto).withColumn("all", F.sum("n").over(part))
    rows = rows.where((F.col("upto") >= q * F.col("all")) & (F.col("upto") - F.col("n") < q * F.col("all")))
    inside = (q * F.col("all") - (F.col("upto") - F.col("n"))) / F.col("n")
    return rows.select(*keys, (low + width * (F.col("bin") + inside)).alias("q"))


def histogram_ks(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """keys, d: the largest gap between the cumulative shares of two histograms (keys, bin, n)."""
    both = left.select(*keys, "bin", F.col("n").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(right.select(*keys, "bin", F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))
    each = both.groupBy(*keys, "bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    part = Window.partitionBy(*keys)
    upto = part.orderBy("bin")
    share = lambda c: F.sum(c).over(upto) / F.sum(c).over(part)
    return each.withColumn("gap", F.abs(share("a") - share("b"))).groupBy(*keys).agg(F.max("gap").alias("d"))


def interarrival(readings: DataFrame, clip: int) -> DataFrame:
    """device, delta, n: seconds between a device's distinct times, clipped."""
    times = readings.select("device", "at").distinct()
    delta = F.col("at") - F.lag("at").over(Window.partitionBy("device").orderBy("at"))
    return times.withColumn("delta", F.least(delta, F.lit(clip))).where("delta IS NOT NULL").groupBy("device", "delta").agg(F.count(F.lit(1)).alias("n"))


def duplicate_keys(readings: DataFrame) -> DataFrame:
    """device, sensor, keys, extra: keys (device, ts, sensor) that occur more than once, and their extra rows."""
    each = readings.groupBy("device", "ts", "sensor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return each.groupBy("device", "sensor").agg(F.count(F.lit(1)).alias("keys"), F.sum(F.col("n") - 1).alias("extra"))


def keep_first(readings: DataFrame) -> DataFrame:
    """The first row by seq of each (device, ts, sensor)."""
    first = F.row_number().over(Window.partitionBy("device", "ts", "sensor").orderBy("seq"))
    return readings.withColumn("k", first).where("k = 1").drop("k")


def uptime_matrix(readings: DataFrame, width: int = 8) -> DataFrame:
    """day, block, d0, d1, ...: readings by day and device, `width` devices a block, so that a fleet of any size has as many columns."""
    day = F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd")
    rows = readings.groupBy(day.alias("day"), F.floor(F.col("device") / width).alias("block"))
    return rows.agg(*[F.count_if(F.col("device") % width == d).alias(f"d{d}") for d in range(width)])


def rounds_per_day(rounds: DataFrame) -> DataFrame:
    """device, day, rounds."""
    day = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd")
    return rounds.select("device", day.alias("day"), "ts").distinct().groupBy("device", "day").agg(F.count(F.lit(1)).alias("rounds"))


def round_sizes(readings: DataFrame) -> DataFrame:
    """readings, rounds: how many rounds have how many readings."""
    return readings.groupBy("device", "ts").agg(F.count(F.lit(1)).alias("readings")).groupBy("readings").agg(F.count(F.lit(1)).alias("rounds"))


def degenerate(readings: DataFrame, epsilon: float) -> DataFrame:
    """device, sensor, n, iqr of channels without spread.

    Quartiles weigh the two values around their place and are rounded once, by a fused multiply-add, as DuckDB has them.
    percentile() rounds both products, which may differ in the last bit, and an IQR may be as large as epsilon exactly.
    Equal values are counted before they are put in order.
    """
    own = Window.partitionBy("device", "sensor")
    rows = readings.where(F.col("value").isNotNull()).groupBy("device", "sensor", "value").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("after", F.sum("n").over(own.orderBy("value"))).withColumn("m", F.sum("n").over(own))

    def quartile(p: float):
        place = p * (F.col("m") - 1)
        at = lambda rank: F.max(F.when((rank >= F.col("after") - F.col("n")) & (rank < F.col("after")), F.col("value")))
        low, high, share = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        weighed = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - share, high * share).cast("double")
        return F.when(share > 0, weighed).otherwise(low)

    each = rows.groupBy("device", "sensor").agg(F.sum("n").alias("n"), (quartile(0.75) - quartile(0.25)).alias("iqr"))
    return each.where(F.col("iqr") <= epsilon)


def unit_sanity(readings: DataFrame, low: float, high: float, sentinels: tuple[float, ...]) -> DataFrame:
    """device, sensor, n, below, above, sentinel."""
    return readings.groupBy("device", "sensor").agg(
        F.count("value").alias("n"), F.count_if(F.col("value") < low).alias("below"), F.count_if(F.col("value") > high).alias("above"), F.count_if(F.col("value").isin(*sentinels)).alias("sentinel")
    )


def daily_means(readings: DataFrame) -> DataFrame:
    """day, sensor, n, total."""
    day = F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd")
    return readings.groupBy(day.alias("day"), "sensor").agg(F.count("value").alias("n"), F.sum("value").alias("total"))


def value_counts(readings: DataFrame, digits: int) -> DataFrame:
    """sensor, value, n: how often each rounded value occurs."""
    return readings.groupBy("sensor", F.round("value", digits).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def weekly_counts(readings: DataFrame) -> DataFrame:
    """week (its Monday), n."""
    week = F.date_format(F.date_trunc("week", F.timestamp_seconds("at")), "yyyy-MM-dd")
    return readings.groupBy(week.alias("week")).agg(F.count(F.lit(1)).alias("n"))


def daily_profile(readings: DataFrame, reference_days: int) -> DataFrame:
    """device, sensor, day, median, p10, p90, shift: each day against the medians of the first days of its device."""
    day = F.floor(F.col("at") / 86400)
    rows = readings.withColumn("day", day).withColumn("start", F.min("day").over(Window.partitionBy("device")))
    q = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    each = rows.groupBy("device", "sensor", "day").agg(q.alias("q"))
    base = rows.where(F.col("day") < F.col("start") + reference_days).groupBy("device", "sensor").agg(q.alias("b"))
    return each.join(base, ["device", "sensor"]).select("device", "sensor", "day", F.col("q")[1].alias("median"), F.col("q")[0].alias("p10"), F.col("q")[2].alias("p90"), (F.col("q")[1] - F.col("b")[1]).alias("shift"))


def hour_profile(readings: DataFrame) -> DataFrame:
    """sensor, hour, median, width: the fleet's value by UTC hour of day."""
    q = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    each = readings.groupBy("sensor", F.hour(F.timestamp_seconds("at")).alias("hour")).agg(q.alias("q"))
    return each.select("sensor", "hour", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("width"))


def dispersion(readings: DataFrame) -> DataFrame:
    """device, sensor, n, p1, p99, iqr, excess kurtosis."""
    ranks = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    each = readings.groupBy("device", "sensor").agg(F.count("value").alias("n"), ranks(0.01).alias("p1"), ranks(0.25).alias("p25"), ranks(0.75).alias("p75"), ranks(0.99).alias("p99"), F.kurtosis("value").alias("kurtosis"))
    return each.select("device", "sensor", "n", "p1", "p99", (F.col("p75") - F.col("p25")).alias("iqr"), "kurtosis")


def representativeness(readings: DataFrame, days: int) -> DataFrame:
    """device, sensor, ratio: the spread of a device's first days as a share of the spread of all."""
    start = F.min("at").over(Window.partitionBy("device"))
    rows = readings.withColumn("early", F.when(F.col("at") < start + days * 86400, F.col("value")))
    q = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))
    each = rows.groupBy("device", "sensor").agg(q("early").alias("a"), q("value").alias("b"))
    return each.select("device", "sensor", ((F.col("a")[1] - F.col("a")[0]) / (F.col("b")[1] - F.col("b")[0])).alias("ratio"))


def spearman(rounds: DataFrame, x: str, y: str) -> DataFrame:
    """device, n, rho: correlation of average ranks."""
    part = Window.partitionBy("device")

    def rank(c: str):
        return F.rank().over(part.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("device", c)) - 1) / 2

    rows = rounds.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("rx", rank(x)).withColumn("ry", rank(y))
    return rows.groupBy("device").agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("rho"))


def phases(readings: DataFrame, period: int) -> DataFrame:
    """device, phase, n: readings by their second within a period."""
    return readings.groupBy("device", F.pmod("at", F.lit(period)).alias("phase")).agg(F.count(F.lit(1)).alias("n"))


def shifted_copies(readings: DataFrame, unit: int, period: int, dense: int, least: int, search: int = 90) -> DataFrame:
    """device, day, phase, n, shift, hits of the streams of a dense day: the shift in days at which most of a stream's times are times of the device too.

    readings(device, at); times are steps of `unit` seconds, a day is dense with more than `dense` of them, a stream has
    those of one phase (step modulo `period`), `least` or more. Each time votes for the shifts to days within `search` at
    which it stands again: an equal second of the day is the join's key, so no shift is tried that nothing speaks
    for. Equal votes go to the later day; a stream without any has a null shift.
    """
    step = F.floor(F.col("at") / unit)
    a_day = 86_400 // unit
    stamps = readings.select("device", step.alias("step")).distinct().withColumns({"day": F.floor(F.col("step") / a_day), "slot": F.pmod("step", F.lit(a_day))})
    days = stamps.groupBy("device", "day").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > dense).select("device", "day")
    own = stamps.join(days, ["device", "day"]).withColumn("phase", F.pmod("step", F.lit(period)))
    streams = own.groupBy("device", "day", "phase").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    others = stamps.select("device", "slot", F.col("day").alias("other"))
    votes = own.join(others, ["device", "slot"]).withColumn("shift", F.col("other") - F.col("day")).where((F.col("shift") != 0) & (F.abs("shift") <= search))
    votes = votes.groupBy("device", "day", "phase", "shift").agg(F.count(F.lit(1)).alias("hits"))
    best = votes.groupBy("device", "day", "phase").agg(F.max(F.struct("hits", "shift")).alias("b"))
    return streams.join(best, ["device", "day", "phase"], "left").select("device", "day", "phase", "n", F.col("b.shift").alias("shift"), F.coalesce("b.hits", F.lit(0)).alias("hits"))


def inventory(lines: DataFrame) -> DataFrame:
    """path, lines, headers: of text read with the column value, by file."""
    return lines.groupBy(F.input_file_name().alias("path")).agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.lower("value").startswith("time,")).alias("headers"))
