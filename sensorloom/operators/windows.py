"""Count windows of admitted rounds, joins along time, and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHANNELS


def count_windows(rounds: DataFrame, length: int, flag: str | None = None) -> DataFrame:
    """device, window, start, stop, x (array of rounds' values) of each full window of `length` consecutive rounds.

    Windows count rounds, not seconds: they go on across gaps. flag: a boolean column of rounds, of which a window
    keeps whether any of its rounds has it.
    """
    number = F.row_number().over(Window.partitionBy("device").orderBy("ts")) - 1
    more = [flag] if flag else []
    rows = rounds.select("device", "ts", F.array(*[f"x{c}" for c in range(CHANNELS)]).alias("x"), F.floor(number / length).alias("window"), *more)
    each = rows.groupBy("device", "window").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("start"), F.max("ts").alias("stop"), F.array_sort(F.collect_list(F.struct("ts", "x"))).alias("rows"), *[F.max(c).alias(c) for c in more])
    return each.where(F.col("n") == length).select("device", "window", "start", "stop", F.col("rows.x").alias("x"), *more)


def clean_training(windows: DataFrame, flag: str) -> DataFrame:
    """Windows without the training ones that have the flag: a model must not learn what it is to find."""
    return windows.where(~((F.col("part") == "train") & F.col(flag)))


def split_windows(windows: DataFrame, per_day: int, length: int, days: tuple[int, int, int]) -> DataFrame:
    """Adds part: train, early, calibrate or online, by the number of rounds at which a window closes."""
    closes = (F.col("window") + 1) * length
    train, early, calibrate = (d * per_day for d in days)
    return windows.withColumn("part", F.when(closes <= train, "train").when(closes <= early, "early").when(closes <= calibrate, "calibrate").otherwise("online"))


def outage_flags(rounds: DataFrame, outage: int, surge: int) -> DataFrame:
    """device, ts, after_outage, within_surge: a gap of at least `outage` before the round, or at most `surge` after such a one."""
    order = Window.partitionBy("device").orderBy("ts")
    after = F.coalesce(F.col("ts") - F.lag("ts").over(order) >= outage, F.lit(False))
    rows = rounds.select("device", "ts", after.alias("after_outage"))
    last = F.last(F.when(F.col("after_outage"), F.col("ts")), ignorenulls=True).over(order)
    return rows.withColumn("within_surge", F.coalesce(F.col("ts") - last <= surge, F.lit(False)))


def moving_median(rows: DataFrame, value: str, length: int) -> DataFrame:
    """Adds median: of the last `length` values of the device, null before there are as many."""
    order = Window.partitionBy("device").orderBy("ts").rowsBetween(-(length - 1), 0)
    return rows.withColumn("median", F.when(F.count(value).over(order) == length, F.expr(f"percentile({value}, 0.5)").over(order)))


def first_settled(rows: DataFrame, value: str, cap: float, length: int) -> DataFrame:
    """device, ts: the first row from which `length` rows in a row stay at or below the cap."""
    ahead = Window.partitionBy("device").orderBy("ts").rowsBetween(0, length - 1)
    good = (F.count(F.lit(1)).over(ahead) == length) & (F.max(value).over(ahead) <= cap)
    return rows.withColumn("good", good).where("good").groupBy("device").agg(F.min("ts").alias("ts"))


def recovery_surge(rows: DataFrame, value: str, window: int, factor: float) -> DataFrame:
    """device, gap_start, gap_end, peak, peak_ts, decay: after a device's longest gap, the highest value and when it falls to factor times the device's median."""
    order = Window.partitionBy("device").orderBy("ts")
    steps = rows.withColumn("before", F.lag("ts").over(order)).withColumn("gap", F.col("ts") - F.lag("ts").over(order))
    longest = steps.where("gap IS NOT NULL").groupBy("device").agg(F.max(F.struct("gap", -F.col("ts"), "before")).alias("g"))
    longest = longest.select("device", F.col("g.before").alias("gap_start"), (F.col("g.before") + F.col("g.gap")).alias("gap_end"))
    base = rows.groupBy("device").agg(F.percentile(value, F.lit(0.5)).alias("base"))
    after = rows.join(longest, "device").join(base, "device").where((F.col("ts") >= F.col("gap_end")) & (F.col("ts") < F.col("gap_end") + window))
    peak = after.groupBy("device", "gap_start", "gap_end", "base").agg(F.max(F.struct(F.col(value).alias("v"), (-F.col("ts")).alias("t"))).alias("p"))
    peak = peak.select("device", "gap_start", "gap_end", "base", F.col("p.v").alias("peak"), (-F.col("p.t")).alias("peak_ts"))
    down = rows.join(peak.select("device", "peak_ts", "base"), "device").where((F.col("ts") >= F.col("peak_ts")) & (F.col(value) <= factor * F.col("base"))).groupBy("device").agg(F.min("ts").alias("down"))
    return peak.join(down, "device", "left").select("device", "gap_start", "gap_end", "peak", "peak_ts", (F.col("down") - F.col("peak_ts")).alias("decay"))


def nearest(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """left(device, at) with ref and offset: the nearest time of right(device, at), ties to the earlier, none beyond `most`.

    One sort of both sides together, looking back and ahead, instead of a range join.
    """
    both = left.select("device", "at", F.lit(1).alias("mine")).unionByName(right.select("device", "at").distinct().withColumn("mine", F.lit(0)))
    order = Window.partitionBy("device").orderBy("at", "mine")
    other = F.when(F.col("mine") == 0, F.col("at"))
    rows = both.withColumn("back", F.last(other, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("ahead", F.first(other, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))).where("mine = 1")
    use_back = F.col("back").isNotNull() & (F.col("ahead").isNull() | (F.col("at") - F.col("back") <= F.col("ahead") - F.col("at")))
    rows = rows.withColumn("ref", F.when(use_back, F.col("back")).otherwise(F.col("ahead")))
    near = F.abs(F.col("at") - F.col("ref")) <= most
    return rows.select("device", "at", F.when(near, F.col("ref")).alias("ref"), F.when(near, F.col("at") - F.col("ref")).alias("offset"))


def shifted_copies(readings: DataFrame, split: int, shift: int) -> DataFrame:
    """device, sensor, later, matched, same, corr: readings after `split` against those `shift` seconds before."""
    first = readings.groupBy("device", "ts", "sensor").agg(F.min_by("value", "seq").alias("value"))
    later = first.where(F.col("ts") >= split)
    earlier = first.where(F.col("ts") < split).select("device", "sensor", (F.col("ts") + shift).alias("ts"), F.col("value").alias("old"))
    both = later.join(earlier, ["device", "sensor", "ts"], "left")
    return both.groupBy("device", "sensor").agg(F.count(F.lit(1)).alias("later"), F.count("old").alias("matched"), F.count_if(F.col("value") == F.col("old")).alias("same"), F.corr("value", "old").alias("corr"))


def intervals_of(events: DataFrame, segments: DataFrame, tail: int) -> DataFrame:
    """segment, events: events(device, ts) within [start, stop + tail] of segments(segment, device, start, stop), a short list."""
    s = F.broadcast(segments)
    return s.join(events, (events["device"] == s["device"]) & events["ts"].between(s["start"], s["stop"] + tail), "left").groupBy("segment").agg(F.count(events["ts"]).alias("events"))


def overlapping(windows: DataFrame, gaps: DataFrame, bucket: int = 7 * 86_400) -> DataFrame:
    """device, window, gaps: how many gaps(device, start, stop) a window(device, window, start, stop) spans.

    Both sides stand in every bucket of time that they touch; a pair counts in the one where the later of them begins.
    """
    touched = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket))).alias("b")
    g = gaps.select("device", F.col("start").alias("g_start"), F.col("stop").alias("g_stop"), touched("start", "stop"))
    both = windows.select("device", "window", "start", "stop", touched("start", "stop")).join(g, ["device", "b"])
    both = both.where((F.col("g_start") < F.col("stop")) & (F.col("g_stop") > F.col("start")) & (F.col("b") == F.floor(F.greatest("start", "g_start") / bucket)))
    return both.groupBy("device", "window").agg(F.count(F.lit(1)).alias("gaps"))


def same_days(readings: DataFrame, channels: int) -> DataFrame:
    """device, day, other, run: pairs of days with the same counts in every channel, consecutive pairs numbered as one run."""
    day = F.floor(F.col("at") / 86400)
    counts = readings.groupBy("device", day.alias("day"), "sensor").agg(F.count(F.lit(1)).alias("n"))
    vector = counts.groupBy("device", "day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sensor", "n"))), lambda s: F.concat(s["sensor"], F.lit("="), s["n"].cast("string"))), ",").alias("v"))
    pairs = vector.join(vector.select("device", F.col("day").alias("other"), "v"), ["device", "v"]).where("other > day").select("device", "day", "other")
    shift = F.col("other") - F.col("day")
    order = Window.partitionBy("device", shift).orderBy("day")
    return pairs.withColumn("run", (F.col("day") - F.row_number().over(order)).cast("long"))


def exact_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """side, rows: rows that only one of two tables has, repeats counted."""
    return left.exceptAll(right).agg(F.count(F.lit(1)).alias("rows")).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).agg(F.count(F.lit(1)).alias("rows")).withColumn("side", F.lit("right")))
