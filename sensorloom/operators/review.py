"""Reconciliation, comparison and summary tables."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHANNELS, Sliding
from . import drift, outliers


def bad_rows(lines: DataFrame) -> DataFrame:
    """rows, rows_bad_time, rows_bad_key, rows_bad_value of lines(value): trimmed fields, each row counted once a fault."""
    p = F.split("value", ",", -1)
    field = lambda k: F.trim(F.coalesce(F.try_element_at(p, F.lit(k)), F.lit("")))
    return lines.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(field(1).try_cast("bigint").isNull()).alias("rows_bad_time"),
        F.count_if((field(2) == "") | (field(3) == "")).alias("rows_bad_key"), F.count_if(field(4).try_cast("double").isNull()).alias("rows_bad_value"),
    )


def nan_counts(readings: DataFrame) -> DataFrame:
    """month, device, sensor, nans."""
    month = F.date_format(F.timestamp_seconds("at"), "yyyy-MM")
    return readings.groupBy(month.alias("month"), "device", "sensor").agg(F.count_if(F.isnan("value")).alias("nans")).where("nans > 0")


def parse_commands(lines: DataFrame) -> DataFrame:
    """seq, good, device, level, effective_at: JSON commands; all five fields are needed."""
    c = F.from_json("value", "device string, level int, effectiveAt long, decidedAt long, seq int")
    rows = lines.select(F.col("seq"), c.alias("c"))
    good = F.col("c").isNotNull()
    for f in ("device", "level", "effectiveAt", "decidedAt", "seq"):
        good = good & F.col(f"c.{f}").isNotNull()
    return rows.select("seq", good.alias("good"), "c.device", "c.level", F.col("c.effectiveAt").alias("effective_at"))


def annotate(rounds: DataFrame, found: DataFrame, s: Sliding) -> DataFrame:
    """device, ts, window_end, outlier: each round with the window of its arrival and whether it was an outlier there."""
    own = rounds.select("device", "ts", ((F.floor(F.col("ts") / s.slide) + 1) * s.slide).alias("window_end"))
    marks = found.select("device", "ts", "window_end", F.lit(True).alias("outlier"))
    return own.join(marks, ["device", "ts", "window_end"], "left").withColumn("outlier", F.coalesce("outlier", F.lit(False)))


def tagged_union(rounds: DataFrame, context: DataFrame, events: DataFrame, states: DataFrame, models: DataFrame, commands: DataFrame, day: int = 86_400) -> DataFrame:
    """device, ts, kind, flag, score, word: one table of inputs by kind, in order of time and kind where it is consumed.

    Seven kinds: rounds, context scores, outliers, transitions of the data layer and its day records (both from
    states(device, day, channel, d, evaluable, transition), at the day's end), events of models and commands.
    """
    none = {"flag": F.lit(None).cast("boolean"), "score": F.lit(None).cast("double"), "word": F.lit(None).cast("string")}
    tagged = lambda kind, rows, ts="ts", **own: rows.select("device", F.col(ts).cast("long").alias("ts"), F.lit(kind).alias("kind"), *[own.get(k, v).alias(k) for k, v in none.items()])
    days = states.withColumn("ts", (F.col("day") + 1) * day)
    parts = [
        tagged("round", rounds, flag=F.col("incomplete")),
        tagged("context", context, flag=F.col("above"), score=F.col("score")),
        tagged("event", events, flag=F.lit(True)),
        tagged("drift", days.where("transition IS NOT NULL"), flag=F.lit(True), score=F.col("d"), word=F.col("transition")),
        tagged("record", days, flag=F.col("evaluable"), score=F.col("d"), word=F.col("channel").cast("string")),
        tagged("model", models, "at", word=F.col("kind")),
        tagged("command", commands, "decided_at", flag=F.col("level") > 0, word=F.col("level").cast("string")),
    ]
    return reduce(DataFrame.unionByName, parts)


def reconcile(rounds: DataFrame, readings: DataFrame, sensors: tuple[str, ...], tolerance: float) -> DataFrame:
    """channel, cells, equal, off, absent: rounds' values against the raw first values."""
    raw = readings.groupBy("device", "ts", "sensor").agg(F.min_by("value", "seq").alias("raw"))
    names = F.array(*map(F.lit, sensors))
    cells = rounds.select("device", "ts", F.posexplode(F.array(*[f"x{c}" for c in range(CHANNELS)])).alias("channel", "x")).withColumn("sensor", F.element_at(names, F.col("channel") + 1))
    both = cells.join(raw, ["device", "ts", "sensor"], "left")
    near = F.abs(F.col("x") - F.col("raw")) <= tolerance
    return both.groupBy("channel").agg(F.count(F.lit(1)).alias("cells"), F.count_if(near).alias("equal"), F.count_if(~near).alias("off"), F.count_if(F.col("x").isNull() | F.col("raw").isNull()).alias("absent"))


def sampled(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n rows by a multiplicative hash of an integer key: the same ones at every run."""
    return rows.orderBy((F.col(key) * 2654435761) % 4294967296, key).limit(n)


def plan_injections(readings: DataFrame, device: Column, start: int, duration: int, share: float) -> DataFrame:
    """device, sensor, start, stop, kind, magnitude: a step for each sensor of the device, scaled by its P90 - P10."""
    q = F.percentile("value", F.array(F.lit(0.1), F.lit(0.9)))
    each = readings.where(device).groupBy("device", "sensor").agg(q.alias("q"))
    return each.select("device", "sensor", F.lit(start).cast("long").alias("start"), F.lit(start + duration).cast("long").alias("stop"), F.lit("step").alias("kind"), ((F.col("q")[1] - F.col("q")[0]) * share).alias("magnitude"))


def zero_share(readings: DataFrame) -> DataFrame:
    """device, sensor, zero, other."""
    return readings.groupBy("device", "sensor").agg(F.count_if(F.col("value") == 0).alias("zero"), F.count_if(F.col("value") != 0).alias("other"))


def model_input(rounds: DataFrame, dark: Column) -> DataFrame:
    """Rounds as the model sees them: the last channel of dark devices is zero."""
    last = f"x{CHANNELS - 1}"
    return rounds.withColumn(last, F.when(dark, 0.0).otherwise(F.col(last)))


def compare_tables(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """same, different, only_left, only_right of a value under keys."""
    both = left.select(*keys, F.col(value).alias("a"), F.lit(1).alias("l")).join(right.select(*keys, F.col(value).alias("b"), F.lit(1).alias("r")), keys, "full")
    inside = F.col("l").isNotNull() & F.col("r").isNotNull()
    near = F.col("a").eqNullSafe(F.col("b")) | F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.lit(False))
    return both.agg(F.count_if(inside & near).alias("same"), F.count_if(inside & ~near).alias("different"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"))


def cleared_outliers(points: DataFrame, s: Sliding, gap: int) -> DataFrame:
    """outliers() with a device's state cleared by a cold start: a gap over `gap` begins an era of its own, from its slide on."""
    order = Window.partitionBy("device").orderBy("ts")
    cold = F.coalesce(F.col("ts") - F.lag("ts").over(order) > gap, F.lit(False))
    rows = points.withColumn("era", F.sum(F.when(cold, 1).otherwise(0)).over(order))
    keyed = rows.withColumn("own", F.col("device")).withColumn("device", F.struct("own", "era"))
    start = rows.groupBy("device", "era").agg((F.floor(F.min("ts") / s.slide) * s.slide).alias("opens"))
    close = start.withColumn("closes", F.lead("opens").over(Window.partitionBy("device").orderBy("era")))
    found = outliers.outliers(keyed.drop("era", "own"), s).select(F.col("device.own").alias("device"), F.col("device.era").alias("era"), "ts", "window_end", "neighbours")
    live = found.join(close, ["device", "era"])
    # Once a later era has begun, windows of the old one are no longer reported.
    return live.where(F.col("closes").isNull() | (F.col("window_end") <= F.col("closes"))).select("device", "ts", "window_end", "neighbours")


def setting_events(elements: DataFrame, settings: list[dict]) -> DataFrame:
    """setting, device, ts, level, during_check, candidate_ts of the drift events under each setting; a (granularity, device) is a task's unit.

    elements(granularity, device, ts, value); a setting names its granularity, confidence, rho, longest and patience.
    Elements are not copied for the settings. Alarms hang on confidence, rho and longest alone, so settings that differ
    only in patience share a detector; a gate sees its alarms and, while a check runs, the elements.
    """
    tables = [drift.lookup(c["confidence"], c["rho"], c["longest"]) for c in settings]
    alike: dict[tuple, list[int]] = {}
    for k, c in enumerate(settings):
        alike.setdefault((c["granularity"], c["confidence"], c["rho"], c["longest"]), []).append(k)
    columns = ["setting", "device", "ts", "level", "during_check", "candidate_ts"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        granularity, device, out = pdf["granularity"].iloc[0], pdf["device"].iloc[0], []
        pdf = pdf.sort_values("ts", kind="stable")
        ts, x = pdf["ts"].to_numpy(), pdf["value"].to_numpy(float)
        for (grain, _, rho, longest), own in alike.items():
            if grain == granularity:
                found = list(drift.Detector(tables[own[0]], longest).alarms(x))
                for k in own:
                    out += [(k, device, e["ts"], e["level"], e["during_check"], e["candidate_ts"]) for e in drift.gated(drift.Gate(rho, settings[k]["patience"]), ts, x, found)]
        return pd.DataFrame(out, columns=columns).astype({"during_check": "boolean"})

    # Much work on few bytes: as many partitions as the session has for shuffles.
    rows = elements.select("granularity", "device", "ts", "value").repartition(int(elements.sparkSession.conf.get("spark.sql.shuffle.partitions")), "granularity", "device")
    return rows.groupBy("granularity", "device").applyInPandas(run, "setting int, device long, ts long, level string, during_check boolean, candidate_ts long")


def segment_report(events: DataFrame, elements: DataFrame, segments: DataFrame, settings: list[dict], tail: int = 21_600, blind: int = 30) -> DataFrame:
    """setting, segment, candidates, confirmed, blind_miss, and the delays to the first candidate and confirmation, in seconds and in elements.

    segments(segment, device, start, stop) is a short list of the user's. A candidate belongs to a segment from its start to
    `tail` seconds after its end, a confirmation by its candidate. After a candidate the detector is blind for `blind`
    elements: a segment that such a stretch touches and that has no candidate is missed for that reason.
    """
    order = Window.partitionBy("granularity", "device").orderBy("ts")
    grain = F.element_at(F.array(*[F.lit(c["granularity"]) for c in settings]), F.col("setting") + 1)
    numbered = elements.select("granularity", "device", "ts", F.row_number().over(order).alias("k"), F.coalesce(F.lead("ts", blind).over(order), F.max("ts").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("sees_again"))
    marked = events.where("level <> 'REVOKE'").withColumn("granularity", grain).join(numbered, ["granularity", "device", "ts"])
    parts = segments.select("segment", F.col("device").alias("s_device"), "start", "stop")
    # How many elements came up to a segment's start.
    before = parts.join(numbered.select("granularity", "device", "ts"), F.col("s_device") == F.col("device"), "left").groupBy("segment", "granularity").agg(F.count_if(F.col("ts") <= F.col("start")).alias("k0"))
    every = parts.crossJoin(F.broadcast(elements.sparkSession.range(len(settings)).select(F.col("id").cast("int").alias("e_setting"))))
    met = every.join(marked, (F.col("e_setting") == F.col("setting")) & (F.col("s_device") == F.col("device")), "left").join(before, ["segment", "granularity"], "left")
    inside = F.col("candidate_ts").between(F.col("start"), F.col("stop") + tail)
    found, confirmed = inside & (F.col("level") == "CANDIDATE"), inside & (F.col("level") == "CONFIRM")
    dark = (F.col("level") == "CANDIDATE") & (F.col("ts") <= F.col("stop")) & (F.col("sees_again") >= F.col("start"))
    first = lambda on: F.min(F.when(on, F.struct(F.col("ts"), F.col("k") - F.col("k0"))))
    each = met.groupBy(F.col("e_setting").alias("setting"), "segment", "start").agg(
        F.count_if(found).alias("candidates"), F.max(F.coalesce(confirmed, F.lit(False))).alias("confirmed"), F.max(F.coalesce(dark, F.lit(False))).alias("dark"), first(found).alias("c"), first(confirmed).alias("f")
    )
    delay = lambda c, name: [(F.col(f"{c}.ts") - F.col("start")).alias(f"{name}_delay"), F.col(c).getField("col2").cast("long").alias(f"{name}_elements")]
    return each.select("setting", "segment", "candidates", "confirmed", (F.col("dark") & (F.col("candidates") == 0)).alias("blind_miss"), *delay("c", "candidate"), *delay("f", "confirm"))


def grid_summary(events: DataFrame, report: DataFrame, settings: list[dict]) -> DataFrame:
    """A row a setting with its parameters: events by kind, the share of checks that end in a revocation, what it finds of the segments, and chosen.

    chosen is the setting that confirms most segments, of those the one with the fewest other confirmations, then the
    one with the least delay, then the first.
    """
    names = ("granularity", "confidence", "rho", "patience")
    table = events.sparkSession.createDataFrame([(k, *[c[n] for n in names]) for k, c in enumerate(settings)], "setting int, granularity string, confidence double, rho double, patience int")
    kinds = events.groupBy("setting").agg(
        *[F.count_if(F.col("level") == n).alias(c) for n, c in (("CANDIDATE", "candidates"), ("CONFIRM", "confirms"), ("REVOKE", "revokes"))], F.count_if((F.col("level") == "CANDIDATE") & ~F.col("during_check")).alias("checks")
    )
    found = report.groupBy("setting").agg(F.count_if(F.col("candidates") > 0).alias("with_candidate"), F.count_if("confirmed").alias("with_confirm"), F.count_if("blind_miss").alias("blind_misses"), F.avg("confirm_delay").alias("mean_delay"))
    rows = table.join(kinds, "setting", "left").join(found, "setting", "left").fillna(0, ["candidates", "confirms", "revokes", "checks"])
    rows = rows.withColumn("blocked", F.when(F.col("checks") > 0, F.col("revokes") / F.col("checks")))
    # One row a setting, of which the caller states the number.
    order = Window.orderBy(F.desc("with_confirm"), F.col("confirms") - F.col("with_confirm"), F.asc_nulls_last("mean_delay"), "setting")
    return rows.withColumn("chosen", F.row_number().over(order) == 1)


def confirmed_spans(events: DataFrame, elements: DataFrame) -> DataFrame:
    """device, since, until, threshold: a confirmation opens a span, the first element whose last-six median is within the threshold ends it (null: open)."""
    order = Window.partitionBy("device").orderBy("ts").rowsBetween(-5, 0)
    medians = elements.select("device", F.col("ts").alias("e_ts"), F.when(F.count("value").over(order) == 6, F.expr("percentile(value, 0.5)").over(order)).alias("median"))
    opened = events.where("level = 'CONFIRM'").select(F.col("device").alias("o_device"), F.col("ts").alias("since"), "threshold")
    both = opened.join(medians, (F.col("o_device") == F.col("device")) & (F.col("e_ts") > F.col("since")) & (F.col("median") <= F.col("threshold")), "left")
    return both.groupBy(F.col("o_device").alias("device"), "since", "threshold").agg(F.min("e_ts").alias("until"))


def alarm_schemes(states: DataFrame) -> DataFrame:
    """scheme, device, days: days on which at least one, two, three channels deviate, or a transition happens."""
    each = states.groupBy("device", "day").agg(F.count_if("deviated").alias("n"), F.count("transition").alias("t"))
    marks = F.array(*[F.struct(F.lit(name).alias("scheme"), on.alias("on")) for name, on in (("any", F.col("n") >= 1), ("two", F.col("n") >= 2), ("three", F.col("n") >= 3), ("transition", F.col("t") >= 1))])
    rows = each.select("device", F.explode(marks).alias("m"))
    return rows.groupBy("m.scheme", "device").agg(F.count_if("m.on").alias("days"))


