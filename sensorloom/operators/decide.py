"""Daily decisions of the fleet: persistent triggers, scope, and each device's commands and reviews.

What compares devices is counted by joins on (day, trigger) and on (day, set of triggers), a few rows a day; what
has a history is folded device by device, a short list of days each.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400
PERF = 31  # the bit of the performance layer among the triggers, beside the channels'
RESULT = "device long, day long, kind string, seq int, level int, cell string, triggers string, forms string, decided_at long, effective_at long, episode int, scope string, co int"


@dataclass(frozen=True)
class Decision:
    """Settings of the decisions, in days; events: whether switch and failure events of models are known, or retraining is taken to last retrain_days."""

    upgrade_days: int = 7
    cooldown_days: int = 7
    retrain_days: int = 3
    rebuild_days: int = 16
    fail_days: int = 14
    delay_days: int = 1
    events: bool = False
    share: float = 0.75  # of the devices present, from which a trigger is the fleet's
    least: int = 2


def closed_spans(spans: DataFrame, models: DataFrame) -> DataFrame:
    """spans(device, since, until) of confirmed scores with `ended`: a switch of the device's model (models with kind switch) ends a span."""
    switches = models.where("kind = 'switch'").select("device", F.col("at").alias("switch"))
    met = spans.join(switches, "device", "left")
    first = F.min(F.when((F.col("switch") > F.col("since")) & (F.col("until").isNull() | (F.col("switch") < F.col("until"))), F.col("switch")))
    each = met.groupBy("device", "since", "until").agg(first.alias("switch"))
    return each.select("device", "since", F.coalesce("switch", "until").alias("until"), F.col("switch").isNotNull().alias("ended"))


def triggers(states: DataFrame, spans: DataFrame, rule: Decision) -> DataFrame:
    """A row a device and day at whose end t something is known: what deviates, what persists since when, how many devices share it.

    states(device, day, channel, evaluable, deviated), a row for each channel of a day; spans(device, since, until). A
    channel persists if it deviated the day before too, or if a score is confirmed at t; a confirmed score persists
    once it has passed a midnight.
    """
    order = Window.partitionBy("device", "channel").orderBy("day")
    before = (F.lag("day").over(order) == F.col("day") - 1) & F.lag("deviated").over(order)
    rows = states.select("device", "day", "channel", "evaluable", "deviated", F.coalesce(before, F.lit(False)).alias("before"))
    bits = lambda c: F.bit_or(F.when(c, F.expr("shiftleft(1L, channel)")).otherwise(F.lit(0).cast("long")))
    days = rows.groupBy("device", "day").agg(F.max("evaluable").alias("ev"), bits(F.col("deviated")).alias("dev"), bits(F.col("deviated") & F.col("before")).alias("twice"))
    t, at = (F.col("day") + 1) * DAY, F.col("s_device") == F.col("device")
    held = spans.select(F.col("device").alias("s_device"), "since", "until")
    live = days.join(held, at & (F.col("since") <= t) & (F.col("until").isNull() | (F.col("until") > t)), "left")
    days = live.groupBy("device", "day", "ev", "dev", "twice").agg(F.max("since").alias("since"))
    days = days.withColumn("since", F.when(F.col("since") <= t, F.col("since"))).withColumn("confirmed", F.col("since").isNotNull())
    persist = F.when(F.col("ev"), F.when(F.col("confirmed"), F.col("dev")).otherwise(F.col("twice"))).otherwise(F.lit(0).cast("long"))
    perf = F.when(F.col("confirmed") & (F.col("since") < F.col("day") * DAY), F.lit(1 << PERF).cast("long")).otherwise(F.lit(0).cast("long"))
    days = days.withColumn("mask", persist.bitwiseOR(perf))
    # Devices are present on a day on which they can be judged.
    sets = days.where("ev").groupBy("day", "mask").agg(F.count(F.lit(1)).alias("n"))
    present = sets.groupBy(F.col("day").alias("p_day")).agg(F.sum("n").alias("present"))
    others = sets.where("mask <> 0").select(F.col("day").alias("o_day"), F.col("mask").alias("o_mask"), F.col("n").alias("o_n"))
    own = days.where("mask <> 0").select("day", "mask").distinct().join(others, (F.col("o_day") == F.col("day")) & (F.col("o_mask").bitwiseAND(F.col("mask")) != 0))
    most = F.greatest(*[F.sum(F.when((F.col("mask").bitwiseAND(F.lit(1 << b)) != 0) & (F.col("o_mask").bitwiseAND(F.lit(1 << b)) != 0), F.col("o_n")).otherwise(0)) for b in (*range(5), PERF)])
    shared = own.groupBy("day", "mask").agg(F.sum("o_n").alias("co"), most.alias("most")).join(present, F.col("p_day") == F.col("day"), "left").drop("p_day")
    limit = F.greatest(F.lit(rule.least), F.ceil(F.col("present") * rule.share))
    shared = shared.select(F.col("day").alias("x_day"), F.col("mask").alias("x_mask"), "co", F.when(F.col("most") >= limit, "global").otherwise("local").alias("scope"))
    days = days.join(shared, (F.col("x_day") == F.col("day")) & (F.col("x_mask") == F.col("mask")), "left").drop("x_day", "x_mask")
    return days.withColumn("co", F.coalesce("co", F.lit(0)))


class Device:
    """What one device's decisions have to remember."""

    def __init__(self, rule: Decision, models: list[tuple[int, str]]):
        self.rule, self.models = rule, sorted(models)
        self.seq, self.episode, self.runs = 0, {}, {}
        self.cool = {0: 0, 1: 0, 2: 0}
        self.estimated: dict[int, int] = {}
        self.retrained = self.rebuilt = self.pending = None
        self.counts: dict[int, int] = {}
        self.day = None

    def known(self, kind: tuple[str, ...], after: int, upto: int) -> list[tuple[int, str]]:
        return [m for m in self.models if m[1] in kind and after <= m[0] <= upto]

    def online(self, t: int) -> bool:
        seen = self.known(("online", "offline"), 0, t)
        return bool(seen) and seen[-1][1] == "online"

    def follow(self, t: int) -> list[tuple]:
        """Takes in what models have done by t; a retraining without a word for too long is reported as failed."""
        out = []
        if not self.rule.events:
            return out
        if switched := self.known(("switch",), 0, t):
            self.retrained = switched[-1][0]
            self.cool[1] = self.retrained + self.rule.cooldown_days * DAY
        if self.pending:
            effective, seq = self.pending
            ended = bool(self.known(("switch", "failed"), effective, t))
            if not ended and t > effective + self.rule.fail_days * DAY:
                out.append(("RETRAIN_TIMEOUT", seq, effective))
                ended = True
            if ended:
                self.pending = None
        if self.rebuilt is not None and (back := self.known(("online",), self.rebuilt + 1, t)):
            self.cool[2] = back[0][0] + self.rule.cooldown_days * DAY
        return out

    def cell(self, day: int, since: int | None, data: list[int], perf: bool, same_day: bool) -> tuple[int, str]:
        """The level that a day's triggers ask for, and why."""
        up = self.rule.upgrade_days * DAY
        if perf and self.retrained is not None and since is not None and self.retrained <= since < self.retrained + up:
            return 2, "confirmed anew after retraining"
        if perf and not data:
            return 1, "score alone"
        if same_day or perf:
            return 1, "both layers"
        for c in data:
            at = self.estimated.get(c)
            if at is not None and at <= max(self.runs[c], at // DAY) * DAY < at + up:
                return 1, "channel anew after re-estimation"
        return 0, "data alone"

    def decide(self, row) -> list[tuple]:
        """Result rows of a day, at its end."""
        day, t, rule, out = int(row.day), (int(row.day) + 1) * DAY, self.rule, []
        has = lambda mask, b: bool(int(mask) >> b & 1)
        for c in range(5):
            if has(row.dev, c):
                self.runs[c] = self.runs[c] if c in self.runs and self.day == day - 1 else day
            else:
                self.runs.pop(c, None)
        self.day = day
        for b in list(self.episode):
            if (b == PERF and not row.confirmed) or (b != PERF and row.ev and not has(row.dev, b)):
                del self.episode[b]
        fill = lambda kind, **k: {"device": row.device, "day": day, "kind": kind, "decided_at": t, **k}
        for kind, seq, effective in self.follow(t):
            out.append(fill(kind, seq=seq, effective_at=effective))
        data, perf = [c for c in range(5) if has(row.mask, c)], has(row.mask, PERF)
        if not data and not perf:
            return out
        forms = [f"{c}:{'two days' if has(row.twice, c) else 'both layers'}" for c in data] + ["perf:past midnight"] * perf
        names = "|".join([*map(str, data), *["perf"] * perf])
        level, why = self.cell(day, None if row.since != row.since else int(row.since), data, perf, any(not has(row.twice, c) for c in data))
        offline = level > 0 and not self.online(t)
        if offline or (level > 0 and rule.events and self.pending):
            reason = "model offline" if offline else "retraining"
            out.append(fill("SUPPRESSED", level=level, cell=f"{why}; {reason}", triggers=names))
            if not data:
                return out
            level, why = 0, f"level {level} suppressed, {reason}"
        asked = [*data, *[PERF] * perf]
        fresh = [b for b in asked if b not in self.episode]
        if self.cool[level] > t or not fresh:
            return out
        for b in fresh:
            self.episode[b] = True
            self.counts[b] = self.counts.get(b, 0) + 1
        self.seq += 1
        effective = t + rule.delay_days * DAY
        if level == 0:
            self.cool[0] = effective + DAY
            self.estimated.update(dict.fromkeys(data, effective))
        elif rule.events:
            if level == 1:
                self.pending = (effective, self.seq)
            else:
                self.rebuilt, self.pending = effective, None
        elif level == 1:
            self.retrained = effective + rule.retrain_days * DAY
            self.cool[1] = self.retrained + rule.cooldown_days * DAY
        else:
            self.cool[2] = effective + (rule.rebuild_days + rule.cooldown_days) * DAY
        out.append(fill("COMMAND", seq=self.seq, level=level, cell=why, triggers=names, forms="|".join(forms), effective_at=effective, episode=max(self.counts[b] for b in fresh), scope=row.scope, co=int(row.co)))
        return out


def decisions(days: DataFrame, models: DataFrame, rule: Decision) -> DataFrame:
    """Commands, suppressed levels and timeouts of days as of triggers(), under models(device, at, kind: online, offline, switch or failed).

    A trigger commands once until it falls: a channel on a day that can be judged and does not deviate, a score when it
    is no longer confirmed. Level 2 if a score is confirmed anew within upgrade_days of a retraining; level 1 if it
    persists alone, if both layers report, or if a channel deviates anew within upgrade_days of its
    re-estimation; else level 0. Levels 1 and 2 need a model that is online and, with events, no retraining on its
    way: without that they are suppressed, and level 0 takes their place if a channel is among the triggers. Each
    level has a cooldown of its own. Devices are folded apart; a device's days and events are few.
    """
    columns = [c.split()[0] for c in RESULT.split(", ")]

    def run(own: pd.DataFrame, events: pd.DataFrame) -> pd.DataFrame:
        device = Device(rule, list(zip(events["at"].astype(int), events["kind"], strict=True)))
        out = [r for row in own.sort_values("day").itertuples(index=False) for r in device.decide(row)]
        frame = pd.DataFrame([[r.get(c) for c in columns] for r in out], columns=columns, dtype=object)
        return frame.astype({c: "Int64" for c in ("device", "day", "decided_at", "effective_at")} | {c: "Int32" for c in ("seq", "level", "episode", "co")})

    return days.groupBy("device").cogroup(models.select(F.col("device").alias("m_device"), "at", "kind").groupBy("m_device")).applyInPandas(run, RESULT)


def span_reviews(spans: DataFrame) -> DataFrame:
    """device, day, kind of spans that a switch of the model ended (see closed_spans), on the day of the switch."""
    return spans.where("ended").select("device", F.floor(F.col("until") / DAY).cast("long").alias("day"), F.lit("SEGMENT_ENDED").alias("kind"))
