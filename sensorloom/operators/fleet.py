"""Fleet decisions: observations by tick, flags, labelled alerts, daily commands and reviews."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Channels whose means are watched, the active ones.
ACTIVE = (0, 1, 2)
#: Labels of an alert, the first that applies is given.
LABELS = ("QUALITY", "SWITCH", "DRIFT", "SITE", "TRANSIENT", "ENVIRONMENT", "ANOMALY")


@dataclass(frozen=True)
class Rules:
    """Settings of ticks and commands."""

    tick: int = 3600
    period: int = 10
    missing: float = 0.2
    guard: float = 0.2
    context_share: float = 0.5
    context_windows: int = 6  # context windows in a tick
    site_days: int = 7
    site_flags: int = 3
    baseline_days: int = 10
    sync: float = 0.5  # a mean off its baseline by this share of the reference's P90 - P10
    alpha: float = 0.01
    upgrade_days: int = 7
    cooldown_days: int = 7
    retrain_days: int = 3

    @property
    def nominal(self) -> int:
        return self.tick // self.period


def threshold(n: Column) -> Column:
    """How many of n devices make a fleet-wide event."""
    return F.greatest(F.lit(2), F.ceil(3 * n / 4))


def tick_of(ts: Column, rules: Rules) -> Column:
    return F.floor(ts / rules.tick) * rules.tick


def observations(rounds: DataFrame, outliers: DataFrame, context: DataFrame, rules: Rules) -> DataFrame:
    """device, tick, rounds, admitted, guard_rounds, outlier_rounds, ctx_above, ctx_max, and for active channels c sum{c}, n{c}, mean{c}: a device's tick.

    rounds(device, ts, incomplete, stuck, x0, x1, x2), outliers(device, ts), context(device, ts, score, above).
    """
    own = rounds.groupBy("device", tick_of(F.col("ts"), rules).alias("tick")).agg(
        F.count(F.lit(1)).alias("rounds"), F.count_if(~F.col("incomplete")).alias("admitted"), F.count_if("stuck").alias("guard_rounds"),
        *[f(f"x{c}").alias(f"{name}{c}") for c in ACTIVE for f, name in ((F.sum, "sum"), (F.count, "n"), (F.avg, "mean"))],
    )
    points = outliers.groupBy("device", tick_of(F.col("ts"), rules).alias("tick")).agg(F.count_distinct("ts").alias("outlier_rounds"))
    scored = context.groupBy("device", tick_of(F.col("ts"), rules).alias("tick")).agg(F.count_if("above").alias("ctx_above"), F.max("score").alias("ctx_max"))
    rows = own.join(points, ["device", "tick"], "left").join(scored, ["device", "tick"], "left")
    return rows.fillna(0, ["outlier_rounds", "ctx_above"])


def point_limit(seen: DataFrame, rules: Rules, q: float = 0.99) -> DataFrame:
    """p_point: the q quantile of the ticks' outlier rates, over ticks of good quality."""
    good = seen.where((1 - F.col("rounds") / rules.nominal <= rules.missing) & (F.col("admitted") > 0))
    return good.agg(F.percentile(F.col("outlier_rounds") / F.col("admitted"), F.lit(q)).alias("p_point"))


def flags(seen: DataFrame, p_point: float, rules: Rules) -> DataFrame:
    """Adds bad, pflag, cflag: poor quality, many point outliers, many context windows above."""
    bad = (1 - F.col("rounds") / rules.nominal > rules.missing) | (F.col("guard_rounds") / rules.nominal > rules.guard)
    point = F.when(F.col("admitted") >= 0.5 * rules.nominal, F.col("outlier_rounds") / F.col("admitted"))
    return seen.withColumn("bad", bad).withColumn("pflag", F.coalesce(point > p_point, F.lit(False))).withColumn("cflag", F.col("ctx_above") / rules.context_windows >= rules.context_share)


def with_fleet(flagged: DataFrame) -> DataFrame:
    """Adds present, n_bad, n_point, n_context, limit: the fleet at the tick, counted over devices of good quality."""
    fleet = Window.partitionBy("tick")
    good = ~F.col("bad")
    rows = flagged.withColumn("present", F.count_if(good).over(fleet)).withColumn("devices", F.count(F.lit(1)).over(fleet)).withColumn("n_bad", F.count_if("bad").over(fleet))
    rows = rows.withColumn("n_point", F.count_if(good & F.col("pflag")).over(fleet)).withColumn("n_context", F.count_if(good & F.col("cflag")).over(fleet))
    return rows.withColumn("limit", threshold(F.col("present")).cast("long"))


def site_flags(flagged: DataFrame, reference: DataFrame, rules: Rules) -> DataFrame:
    """Adds past, off, site: a device that was flagged often at this time of day and whose mean has left its baseline.

    reference(device, frozen, width0, width1, width2): the day on which a device's reference begins, and the
    reference's P90 - P10 for each active channel, null where there is none. past counts the days among the last
    site_days that were flagged at the same time of day. The baseline is the mean at that time of day over the
    first baseline_days; while it is gathered there is no site condition.
    """
    day = F.floor(F.col("tick") / 86400)
    slot = Window.partitionBy("device", F.col("tick") % 86400)
    rows = flagged.join(reference, "device", "left")
    past = F.sum((F.col("pflag") | F.col("cflag")).cast("long")).over(slot.orderBy(day).rangeBetween(-rules.site_days, -1))
    early = day.between(F.col("frozen"), F.col("frozen") + rules.baseline_days - 1)
    off = F.lit(False)
    for c in ACTIVE:
        base = F.sum(F.when(early, F.col(f"sum{c}"))).over(slot) / F.sum(F.when(early, F.col(f"n{c}"))).over(slot)
        off = off | F.coalesce(F.abs(F.col(f"mean{c}") - base) > rules.sync * F.col(f"width{c}"), F.lit(False))
    rows = rows.withColumn("past", F.coalesce(past, F.lit(0))).withColumn("off", off)
    later = F.coalesce(day >= F.col("frozen") + rules.baseline_days, F.lit(False))
    return rows.withColumn("site", (F.col("past") >= rules.site_flags - 1) & F.col("off") & later).drop("frozen", *[f"width{c}" for c in ACTIVE])


def alerts(flagged: DataFrame, reference: DataFrame, drifting: DataFrame, transient: DataFrame, switching: DataFrame, rules: Rules) -> DataFrame:
    """device, tick, label, scope, co of every tick with a label.

    drifting, transient and switching are (device, tick) of an open drift, a confirmed score or deviating
    data, and a burst with deviating data. The first label of LABELS that applies is given. Its scope is global
    if the fleet shares its cause: as many devices of good quality as the limit, or of all devices for QUALITY.
    co counts the devices that share it: none for SITE, the device itself for ANOMALY.
    """
    mark = lambda df, name: df.select("device", "tick").distinct().withColumn(name, F.lit(True))
    rows = site_flags(with_fleet(flagged), reference, rules)
    names = ("drift", "transient", "switch")
    for df, name in zip((drifting, transient, switching), names):
        rows = rows.join(mark(df, name), ["device", "tick"], "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
    fleet, good = Window.partitionBy("tick"), ~F.col("bad")
    any_flag = F.col("pflag") | F.col("cflag")
    for name in names:
        rows = rows.withColumn(f"n_{name}", F.count_if(good & F.col(name)).over(fleet))
    rows = rows.withColumn("n_any", F.count_if(good & any_flag).over(fleet))
    wide = (F.col("pflag") & (F.col("n_point") >= F.col("limit"))) | (F.col("cflag") & (F.col("n_context") >= F.col("limit")))
    label = (
        F.when(F.col("bad"), "QUALITY").when(F.col("switch"), "SWITCH").when(F.col("drift"), "DRIFT")
        .when(any_flag & F.col("site"), "SITE").when(F.col("transient"), "TRANSIENT").when(wide, "ENVIRONMENT").when(any_flag, "ANOMALY")
    )
    is_ = lambda *of: F.col("label").isin(*of)
    shared = F.when(is_("QUALITY"), F.col("n_bad")).when(is_("SWITCH"), F.col("n_switch")).when(is_("DRIFT"), F.col("n_drift")).when(is_("TRANSIENT"), F.col("n_transient")).when(is_("ENVIRONMENT"), F.col("n_any"))
    everywhere = F.when(is_("QUALITY"), shared >= threshold(F.col("devices"))).when(is_("SWITCH", "DRIFT", "TRANSIENT"), shared >= F.col("limit")).otherwise(is_("ENVIRONMENT"))
    rows = rows.withColumn("label", label).where(F.col("label").isNotNull())
    co = F.when(is_("SITE"), 0).when(is_("ANOMALY"), 1).otherwise(shared)
    return rows.select("device", "tick", "label", F.when(everywhere, "global").otherwise("local").alias("scope"), co.cast("long").alias("co"))


def day_states(days: DataFrame, limits: list[float], rules: Rules) -> DataFrame:
    """Adds evaluable, deviated, transition to days(device, day, channel, d, p, missing, guard, calibration).

    A channel deviates from the day on which p < alpha / 5 and d exceeds its limit, until d is within it;
    days that are not evaluable change nothing. The state is the last mark that was set.
    """
    limit = F.element_at(F.array(*map(F.lit, limits)), F.col("channel") + 1)
    good = ~F.col("calibration") & (F.col("missing") <= rules.missing) & (F.col("guard") <= rules.guard)
    rows = days.withColumn("evaluable", good)
    mark = F.when(F.col("evaluable") & (F.col("p") < rules.alpha / 5) & (F.col("d") > limit), True).when(F.col("evaluable") & (F.col("d") <= limit), False)
    order = Window.partitionBy("device", "channel").orderBy("day")
    rows = rows.withColumn("deviated", F.coalesce(F.last(mark, ignorenulls=True).over(order), F.lit(False)))
    before = F.coalesce(F.lag("deviated").over(order), F.lit(False))
    return rows.withColumn("transition", F.when(F.col("deviated") & ~before, "DEVIATE").when(~F.col("deviated") & before, "RECOVER"))


def persistent(states: DataFrame, performance: DataFrame) -> DataFrame:
    """device, day, channel, form: channels that deviate on two days in a row, or on a day with a confirmed score.

    performance(device, day): days at whose end a device's score is confirmed high.
    """
    order = Window.partitionBy("device", "channel").orderBy("day")
    twice = (F.lag("day").over(order) == F.col("day") - 1) & F.lag("deviated").over(order)
    rows = states.withColumn("twice", F.coalesce(twice, F.lit(False))).where(F.col("evaluable") & F.col("deviated"))
    rows = rows.join(performance.select("device", "day").distinct().withColumn("perf", F.lit(True)), ["device", "day"], "left")
    form = F.when(F.col("twice"), "TWO_DAYS").when(F.col("perf"), "BOTH_LAYERS")
    return rows.select("device", "day", "channel", form.alias("form")).where(F.col("form").isNotNull())


COMMAND = "device long, day long, seq int, level int, triggers string, forms string, effective_day long, episode int"


def commands(triggers: DataFrame, rules: Rules) -> DataFrame:
    """Commands of a device's days, one device a task: triggers(device, day, channel, form), channel -1 for a confirmed score.

    A trigger commands once per episode, that is, until a day without it. Level 2 if the score is confirmed
    anew within upgrade_days of a retraining; level 1 if only the score persists, if both layers report, or if
    a channel deviates anew within upgrade_days of its re-estimation; else level 0. Each level has a cooldown
    of its own. A command takes effect on the next day.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        device, out = pdf["device"].iloc[0], []
        episode: dict[int, int] = {}
        since: dict[int, int] = {}
        last: dict[int, int] = {}
        cool, retrained, estimated, seq = {0: -1, 1: -1, 2: -1}, None, {}, 0
        for day, group in pdf.sort_values(["day", "channel"]).groupby("day"):
            now = dict(zip(group["channel"], group["form"]))
            for t in list(episode):
                if t not in now or last[t] != day - 1:
                    del episode[t]
            for t in now:
                if last.get(t) != day - 1:
                    since[t] = day
                last[t] = day
            data = [t for t in now if t >= 0]
            if -1 in now and retrained is not None and retrained <= since[-1] < retrained + rules.upgrade_days:
                level = 2
            elif -1 in now or "BOTH_LAYERS" in now.values():
                level = 1
            elif any(t in estimated and estimated[t] <= since[t] < estimated[t] + rules.upgrade_days for t in data):
                level = 1
            else:
                level = 0
            fresh = [t for t in now if t not in episode]
            if not fresh or cool[level] > day:
                continue
            for t in fresh:
                episode[t] = episode.get(t, 0) + 1
            seq += 1
            effective = day + 1
            if level == 0:
                cool[0] = effective + 1
                estimated.update(dict.fromkeys(data, effective))
            else:
                done = effective + (rules.retrain_days if level == 1 else rules.cooldown_days)
                cool[level] = done + rules.cooldown_days
                retrained = done if level == 1 else retrained
            names = sorted(now)
            out.append((device, day, seq, level, "|".join("perf" if t < 0 else str(t) for t in names), "|".join(now[t] for t in names), effective, max(episode[t] for t in fresh)))
        return pd.DataFrame(out, columns=["device", "day", "seq", "level", "triggers", "forms", "effective_day", "episode"])

    return triggers.select("device", "day", "channel", "form").groupBy("device").applyInPandas(run, COMMAND)


def reviews(labelled: DataFrame, states: DataFrame) -> DataFrame:
    """device, day, kind, n: days that could not be evaluated, and anomalies of a day on which a channel then deviated."""
    dark = states.where(~F.col("evaluable") & ~F.col("calibration")).groupBy("device", "day").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("UNEVALUABLE"))
    turned = states.where("transition = 'DEVIATE'").select("device", "day").distinct()
    anomalies = labelled.where("label = 'ANOMALY'").select("device", F.floor(F.col("tick") / 86400).alias("day")).join(turned, ["device", "day"], "left_semi")
    relabelled = anomalies.groupBy("device", "day").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("ANOMALY_TO_SWITCH"))
    return dark.unionByName(relabelled)


def latency(faults: DataFrame, alerted: DataFrame, commanded: DataFrame) -> DataFrame:
    """fault, to_alert, to_command in seconds: from a fault's start to the first alert and the first command within its time."""
    f = F.broadcast(faults)
    a = f.join(alerted.select(F.col("device").alias("a_device"), F.col("tick").alias("a_tick")), (F.col("a_device") == F.col("device")) & F.col("a_tick").between(F.col("start"), F.col("stop")), "left").groupBy("fault", "device", "start", "stop").agg((F.min("a_tick") - F.first("start")).alias("to_alert"))
    c = commanded.select(F.col("device").alias("c_device"), (F.col("effective_day") * 86400).alias("c_at"))
    return a.join(c, (F.col("c_device") == F.col("device")) & F.col("c_at").between(F.col("start"), F.col("stop")), "left").groupBy("fault", "to_alert").agg((F.min("c_at") - F.min("start")).alias("to_command"))


def anchors(confirmations: DataFrame, within: int, keep) -> DataFrame:
    """at: the times at which episodes begin: the first confirmation, then always the first one more than `within` seconds after the last such time.

    The next anchor of any time is one more than `within` later: it stands in the next bucket of that width, or is the
    first time of a later bucket. Times after a quiet stretch of more than `within` are anchors for certain; from
    there pointers of doubled length find the others, in as many rounds as the longest chain has digits.
    keep(table, name) writes a table and reads it again. Buckets, of which there are as many as `within` goes into the
    time observed, are the only rows in one window; times and confirmations are not.
    """
    times = confirmations.select(F.col("ts").cast("long").alias("at")).distinct().withColumn("b", F.floor(F.col("at") / within).cast("long"))
    times = keep(times, "times")
    buckets = times.groupBy("b").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    by_bucket = Window.orderBy("b")
    buckets = keep(buckets.select("b", "low", F.lag("high").over(by_bucket).alias("before"), F.lead("low").over(by_bucket).alias("later"), F.lead(F.struct("b", "low")).over(by_bucket).alias("n1"), F.lead("low", 2).over(by_bucket).alias("l2")), "buckets")
    # In the bucket ahead, the first time after at + within; else the first one of the bucket that follows it.
    asks = times.select((F.col("b") + 1).alias("b"), (F.col("at") + within).alias("at"), F.lit(1).alias("ask"))
    both = times.select("b", "at", F.lit(0).alias("ask")).unionByName(asks)
    # Equal times are no later: the ask stands behind them.
    ahead = Window.partitionBy("b").orderBy("at", "ask").rowsBetween(1, Window.unboundedFollowing)
    found = both.withColumn("next", F.min(F.when(F.col("ask") == 0, F.col("at"))).over(ahead)).where("ask = 1").select((F.col("at") - within).alias("at"), (F.col("b") - 1).alias("b"), "next")
    beyond = F.when(F.col("n1.b") == F.col("b") + 1, F.col("l2")).otherwise(F.col("n1.low"))
    jump = keep(found.join(buckets.select("b", beyond.alias("beyond")), "b").select("at", F.coalesce("next", "beyond").alias("to")).where("to IS NOT NULL"), "jump")
    sure = buckets.where((F.col("before").isNull()) | (F.col("low") - F.col("before") > within)).select(F.col("low").alias("at"))
    reached, n = keep(sure, "reached"), -1
    while True:
        new = keep(reached.unionByName(reached.join(jump, "at").select(F.col("to").alias("at"))).distinct(), "reached")
        size = new.count()
        if size == n:
            return new
        reached, n = new, size
        jump = keep(jump.alias("a").join(jump.withColumnsRenamed({"at": "mid", "to": "end"}), F.col("a.to") == F.col("mid")).select("a.at", F.col("end").alias("to")), "jump")


def episodes(confirmations: DataFrame, within: int, least: int, keep=lambda table, name: table) -> DataFrame:
    """start, devices, n: confirmations(device, ts) gathered from each anchor on, up to `within` seconds after it, with at least `least` devices.

    A bucket of `within` seconds holds one anchor at most, so a confirmation meets those of its own bucket and the one before.
    """
    rows = confirmations.select("device", "ts")
    start = anchors(rows, within, keep).select(F.col("at").alias("start"), F.floor(F.col("at") / within).cast("long").alias("b"))
    own = F.floor(F.col("ts") / within).cast("long")
    met = rows.withColumn("b", F.explode(F.array(own, own - 1))).join(start, "b").where((F.col("ts") >= F.col("start")) & (F.col("ts") <= F.col("start") + within))
    each = met.groupBy("start", "device").agg(F.count(F.lit(1)).alias("n")).groupBy("start").agg(F.array_sort(F.collect_list("device")).alias("devices"), F.sum("n").alias("n"))
    return each.where(F.size("devices") >= least).select("start", F.array_join(F.col("devices").cast("array<string>"), ",").alias("devices"), "n")
