"""Fault injection and what of it is found again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("spike", "step", "ramp", "stuck")


def parse_specs(text: str) -> list[tuple]:
    """number, device, sensor, start, stop, kind, magnitude of `device:channel:startTs:durationSec:type:magnitude;...`."""
    out = []
    for number, part in enumerate(p for p in text.split(";") if p.strip()):
        fields = part.strip().split(":")
        if len(fields) != 6 or fields[4] not in KINDS:
            raise ValueError(f"not an injection: {part!r}")
        start, duration = int(fields[2]), int(fields[3])
        if duration <= 0:
            raise ValueError(f"an injection lasts at least a second: {part!r}")
        out.append((number, int(fields[0]), fields[1], start, start + duration, fields[4], float(fields[5])))
    return out


SPEC = "spec int, device long, sensor string, start long, stop long, kind string, magnitude double"


def inject(readings: DataFrame, specs: DataFrame) -> DataFrame:
    """readings with value changed within [start, stop) of the specs, one after the other and cumulatively; original keeps it.

    spike and step add the magnitude, ramp adds its growing share, stuck repeats the first value of the
    interval. specs is a short list of faults (its size is the user's own input), so it is broadcast.
    """
    s = F.broadcast(specs)
    inside = (readings["device"] == s["device"]) & (readings["sensor"] == s["sensor"]) & (readings["at"] >= s["start"]) & (readings["at"] < s["stop"])
    hits = readings.join(s, inside).select(readings["seq"], readings["at"], readings["value"], "spec", "start", "stop", "kind", "magnitude")
    first = F.first("value").over(Window.partitionBy("spec").orderBy("at", "seq"))
    hits = hits.withColumn("held", first)
    each = hits.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("spec", "at", "start", "stop", "kind", "magnitude", "held"))).alias("faults"))
    ramp = lambda f: f["magnitude"] * (f["at"] - f["start"]) / (f["stop"] - f["start"])
    step = lambda x, f: F.when(f["kind"] == "stuck", f["held"]).when(f["kind"] == "ramp", x + ramp(f)).otherwise(x + f["magnitude"])
    joined = readings.join(each, "seq", "left")
    changed = F.when(F.col("faults").isNull(), F.col("value")).otherwise(F.aggregate("faults", F.col("value"), step))
    return joined.withColumn("original", F.col("value")).withColumn("value", changed).drop("faults")


def recall(specs: DataFrame, alarms: DataFrame, background: DataFrame, tail: int = 0) -> DataFrame:
    """spec, device, detected, hits, delay, expected, chance: which faults alarms(device, ts) found.

    chance is the probability that the background(device, rate, total) of alarms a round would have hit at
    least once within as many rounds.
    """
    s = F.broadcast(specs)
    hits = s.join(alarms, (alarms["device"] == s["device"]) & (alarms["ts"] >= s["start"]) & (alarms["ts"] < s["stop"] + tail), "left").groupBy(s["spec"], s["device"], "start", "stop").agg(
        F.count(alarms["ts"]).alias("hits"), (F.min(alarms["ts"]) - F.first("start")).alias("delay")
    )
    rows = hits.join(background, "device", "left")
    return rows.select("spec", "device", (F.col("hits") > 0).alias("detected"), "hits", "delay", (1 - F.pow(1 - F.coalesce("rate", F.lit(0.0)), F.ceil((F.col("stop") - F.col("start")) / F.col("period")))).alias("chance"))
