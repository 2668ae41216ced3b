"""Versioned parameters: re-estimation on command, what is in force when, and backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Fleet
from .quality import channel_rows
from .scaling import transformed


def schedule(commands: DataFrame, rounds: DataFrame, warm: int = 0, lag: int = 0) -> DataFrame:
    """commands(device, level, effective_at, decided_at, seq) with verdict and executes, the ts of the round that executes it.

    A command is ignored if its level is none of 0, 1 and 2. It is late by watermark if the watermark, `lag`
    seconds behind the time of decision, has reached effective_at; else late by a processed round if the device
    has a round from effective_at up to that time. The others wait for the first round at or after effective_at:
    before the device's first `warm` rounds are over they are dropped (pre_freeze); then level 0 is executed and
    levels 1 and 2 are forwarded, of those that meet the same round only the last by effective_at and seq
    (replaced).
    """
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    order = Window.partitionBy("device").orderBy("ts")
    marks = rounds.select("device", F.col("ts").alias("at"), F.lit(1).alias("kind"), none("long", "seq"), none("int", "level"), none("long", "decided_at"), F.row_number().over(order).alias("number"))
    asked = commands.select("device", F.col("effective_at").alias("at"), F.lit(0).alias("kind"), F.col("seq").cast("long").alias("seq"), F.col("level").cast("int").alias("level"), F.col("decided_at").cast("long").alias("decided_at"), none("int", "number"))
    ahead = Window.partitionBy("device").orderBy("at", "kind", "seq").rowsBetween(1, Window.unboundedFollowing)
    next_round = F.first(F.when(F.col("kind") == 1, F.struct("at", "number")), ignorenulls=True).over(ahead)
    rows = marks.unionByName(asked).withColumn("next", next_round).where("kind = 0")
    verdict = (
        F.when(~F.col("level").isin(0, 1, 2), "ignored")
        .when(F.col("at") <= F.col("decided_at") - lag, "late_watermark")
        .when(F.col("next.at") <= F.col("decided_at"), "late_processed")
        .when(F.col("next").isNull(), "waiting")
        .when(F.col("next.number") <= warm, "pre_freeze")
        .when(F.col("level") == 0, "executed")
        .otherwise("forwarded")
    )
    rows = rows.withColumn("verdict", verdict)
    last = F.row_number().over(Window.partitionBy("device", "verdict", "next.at").orderBy(F.col("at").desc(), F.col("seq").desc()))
    verdict = F.when((F.col("verdict") == "forwarded") & (F.col("last") > 1), "replaced").otherwise(F.col("verdict"))
    rows = rows.withColumn("last", last).withColumn("verdict", verdict)
    return rows.select("device", "seq", "level", F.col("at").alias("effective_at"), "verdict", F.when(F.col("verdict").isin("executed", "forwarded"), F.col("next.at")).alias("executes"))


def versions(rounds: DataFrame, scheduled: DataFrame, warm: int) -> DataFrame:
    """device, ts, version of rounds after warm-up: 1, then seq + 1 of the last level-0 command executed by then."""
    order = Window.partitionBy("device").orderBy("ts")
    rows = rounds.select("device", "ts").withColumn("number", F.row_number().over(order)).where(F.col("number") > warm)
    done = scheduled.where("verdict = 'executed' AND level = 0").groupBy("device", F.col("executes").alias("ts")).agg((F.max("seq") + 1).alias("v"))
    rows = rows.join(done, ["device", "ts"], "left")
    return rows.select("device", "ts", F.coalesce(F.last("v", ignorenulls=True).over(order), F.lit(1)).cast("long").alias("version"))


def reestimate(rounds: DataFrame, executed: DataFrame, frozen: DataFrame, fleet: Fleet, depth: int, keep: tuple[int, ...], epsilon: float = 1e-9) -> DataFrame:
    """device, version, channel, n, median, scale from the rounds in [effective - depth, effective) of each executed command.

    rounds(device, ts, x0..x4, stuck): stuck rounds are left out whole. Channels of `keep` have their frozen
    parameters restored. executed(device, seq, effective_at); commands are few, rounds many: the commands'
    intervals are broadcast only as far as Spark finds them small.
    """
    cells = transformed(channel_rows(rounds.where("NOT stuck")), fleet).where(F.col("x").isNotNull())
    e = executed.select(F.col("device").alias("e_device"), (F.col("seq") + 1).alias("version"), "effective_at")
    inside = (F.col("e_device") == F.col("device")) & (F.col("ts") >= F.col("effective_at") - depth) & (F.col("ts") < F.col("effective_at"))
    each = cells.join(e, inside).groupBy("device", "version", "channel").agg(F.count(F.lit(1)).alias("n"), F.percentile("t", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    iqr = F.col("q")[2] - F.col("q")[0]
    each = each.select("device", "version", "channel", "n", F.col("q")[1].alias("m"), F.when(iqr <= epsilon, 1.0).otherwise(iqr).alias("s"))
    old = frozen.select("device", "channel", "median", "scale")
    kept = F.col("channel").isin(*keep) if keep else F.lit(False)
    rows = each.join(old, ["device", "channel"], "left")
    pick = lambda new, was: F.when(kept, F.coalesce(F.col(was), F.col(new))).otherwise(F.col(new))
    return rows.select("device", "version", "channel", "n", pick("m", "median").alias("median"), pick("s", "scale").alias("scale"))


def backfill(rounds: DataFrame, executed: DataFrame, depth: int) -> DataFrame:
    """device, version, ts of the complete rounds in [effective - depth, effective), which the new version shows again."""
    e = executed.select(F.col("device").alias("e_device"), (F.col("seq") + 1).alias("version"), "effective_at")
    inside = (F.col("e_device") == F.col("device")) & (F.col("ts") >= F.col("effective_at") - depth) & (F.col("ts") < F.col("effective_at"))
    return rounds.where("NOT incomplete").select("device", "ts").join(e, inside).select("device", "version", "ts")


def keep_channels(old: DataFrame, new: DataFrame, keep: tuple[int, ...]) -> DataFrame:
    """The new parameters, with the old ones of the kept channels."""
    return new.where(~F.col("channel").isin(*keep)).unionByName(old.where(F.col("channel").isin(*keep)))
