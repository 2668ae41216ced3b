"""From raw lines to rounds: parsing, classification, assembly, masks, monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHANNELS, Fleet

KINDS = {"detection": 0, "quality": 1, "unknown": 2}


def parse_lines(lines: DataFrame, fleet: Fleet) -> DataFrame:
    """lines(seq, value) -> seq, status, device, ts, sensor, reading: one row a line but headers and blanks.

    status is ok, malformed (a device but no four good columns) or malformed_no_device.
    """
    parts = F.split("value", ",", -1)
    rows = lines.where((F.trim("value") != "") & ~F.lower(F.trim("value")).startswith("time,")).select("seq", parts.alias("p"))
    device = F.when(F.size("p") >= 2, F.trim(F.try_element_at("p", F.lit(2))))
    ts = F.trim(F.try_element_at("p", F.lit(1))).try_cast("bigint")
    reading = F.trim(F.try_element_at("p", F.lit(4))).try_cast("double")
    rows = rows.select("seq", device.alias("device"), F.size("p").alias("n"), ts.alias("ts"), F.trim(F.try_element_at("p", F.lit(3))).alias("sensor"), reading.alias("reading"))
    good = (F.col("n") == 4) & F.col("ts").isNotNull() & F.col("reading").isNotNull()
    status = F.when(F.coalesce(F.col("device"), F.lit("")) == "", "malformed_no_device").when(good, "ok").otherwise("malformed")
    return rows.withColumn("status", status).select("seq", "status", "device", "ts", "sensor", "reading")


def parse_counters(parsed: DataFrame, fleet: Fleet) -> DataFrame:
    """One row of counters over parsed lines."""
    ok = F.col("status") == "ok"
    return parsed.agg(
        F.count(F.lit(1)).alias("lines_in"),
        F.count_if(F.col("status") == "malformed").alias("malformed"),
        F.count_if(F.col("status") == "malformed_no_device").alias("malformed_no_device"),
        F.count_if(ok & ~F.col("sensor").isin(*fleet.sensors, *fleet.quality)).alias("unknown_sensor"),
        F.count_if(ok & (F.col("sensor") == fleet.sensors[4]) & (F.col("reading") == fleet.censored) if fleet.censored is not None else F.lit(False)).alias("censored"),
        F.count_if(ok & (F.col("sensor") == "RSSI") & (F.col("reading") == 0)).alias("rssi_sentinel"),
    )


def classify(readings: DataFrame, fleet: Fleet) -> DataFrame:
    """Adds kind and channel: the detection channel's index, or null."""
    at = F.array_position(F.array(*map(F.lit, fleet.sensors)), F.col("sensor"))
    kind = F.when(at > 0, "detection")
    if fleet.quality:
        kind = kind.when(F.col("sensor").isin(*fleet.quality), "quality")
    return readings.withColumn("kind", kind.otherwise("unknown")).withColumn("channel", F.when(at > 0, (at - 1).cast("int")))


def assemble_rounds(readings: DataFrame, fleet: Fleet) -> DataFrame:
    """readings(seq, device, ts, sensor, value) -> a row for each device and ts.

    x0..x4: each channel's first value by seq, null where it is missing; quality channels likewise;
    dup_keys: later values of known sensors; unknown_sensor; censored, incomplete. One round a key: late
    readings belong to it, they never open a second one.
    """
    rows = classify(readings, fleet)
    first = lambda name: F.min_by(F.when(F.col("sensor") == name, F.col("value")), F.when(F.col("sensor") == name, F.col("seq")))
    seen = [F.max((F.col("sensor") == name).cast("int")) for name in (*fleet.sensors, *fleet.quality)]
    known = F.count_if(F.col("kind") != "unknown")
    distinct = seen[0]
    for s in seen[1:]:
        distinct = distinct + s
    rounds = rows.groupBy("device", "ts").agg(
        *[first(name).alias(f"x{c}") for c, name in enumerate(fleet.sensors)],
        *[first(name).alias(name.lower()) for name in fleet.quality],
        (known - distinct).cast("long").alias("dup_keys"),
        F.count_if(F.col("kind") == "unknown").alias("unknown_sensor"),
    )
    missing = [F.col(f"x{c}").isNull() for c in range(CHANNELS)]
    incomplete = missing[0]
    for m in missing[1:]:
        incomplete = incomplete | m
    censored = F.coalesce(F.col("x4") == fleet.censored, F.lit(False)) if fleet.censored is not None else F.lit(False)
    return rounds.withColumn("incomplete", incomplete).withColumn("censored", censored)


def attach_malformed(rounds: DataFrame, malformed: DataFrame) -> DataFrame:
    """Adds to each round the device's malformed lines since the round before it, by arrival.

    rounds(device, ts, last_seq) and malformed(device, seq): arrival is the order of seq, so a line belongs to
    the first round of its device that ends with a larger seq.
    """
    marks = rounds.select("device", F.col("last_seq").alias("seq"), "ts", F.lit(0).alias("bad")).unionByName(malformed.select("device", "seq", F.lit(None).cast("long").alias("ts"), F.lit(1).alias("bad")))
    upto = Window.partitionBy("device").orderBy("seq", "bad", "ts").rowsBetween(Window.unboundedPreceding, 0)
    total = marks.withColumn("total", F.sum("bad").over(upto)).where("bad = 0")
    before = F.lag("total", 1, 0).over(Window.partitionBy("device").orderBy("seq", "ts"))
    return total.select("device", "ts", (F.col("total") - before).alias("malformed"))


def missing_bits():
    """The int whose bit c is set where channel c is missing."""
    bits = F.lit(0)
    for c in range(CHANNELS):
        bits = bits + F.when(F.col(f"x{c}").isNull(), 1 << c).otherwise(0)
    return bits.cast("int")


def mask_bits(rounds: DataFrame) -> DataFrame:
    """device, ts, missing_mask: bit c is set where channel c is missing."""
    return rounds.select("device", "ts", missing_bits().alias("missing_mask"))


def degraded(rounds: DataFrame, parameters: DataFrame) -> DataFrame:
    """Adds bypass_mask and substituted_mask, 0 during warm-up: the channels whose scale is bypassed or replaced.

    parameters(device, channel, bypass, substituted), a row a channel.
    """
    bits = lambda c: F.bit_or(F.when(F.col(c), F.expr("shiftleft(1, channel)")).otherwise(0)).cast("int")
    masks = parameters.groupBy("device").agg(bits("bypass").alias("b"), bits("substituted").alias("s"))
    own = lambda c: F.when(F.col("warmup"), 0).otherwise(F.coalesce(c, F.lit(0)))
    return rounds.join(masks, "device", "left").withColumns({"bypass_mask": own("b"), "substituted_mask": own("s")}).drop("b", "s")


def unpack_mask(masked: DataFrame) -> DataFrame:
    """device, ts, channel, missing: a row for each bit."""
    return masked.select("device", "ts", F.explode(F.sequence(F.lit(0), F.lit(CHANNELS - 1))).alias("channel"), "missing_mask").select("device", "ts", "channel", (F.expr("shiftright(missing_mask, channel)") % 2 == 1).alias("missing"))


def guard_masks(cells: DataFrame) -> DataFrame:
    """device, ts, stuck_mask, floor_mask, run_len, run_start (arrays by channel) of cells as the guard of repeated values marks them."""
    bits = lambda c: F.bit_or(F.when(F.col(c), F.expr("shiftleft(1, channel)")).otherwise(0)).cast("int")
    by_channel = lambda c: F.array(*[F.coalesce(F.max(F.when(F.col("channel") == k, F.col(c))), F.lit(0)) for k in range(CHANNELS)])
    return cells.groupBy("device", "ts").agg(bits("stuck").alias("stuck_mask"), bits("floor").alias("floor_mask"), by_channel("run_len").alias("run_len"), by_channel("run_start").alias("run_start"))


def monitor(rounds: DataFrame, cells: DataFrame, width: int) -> DataFrame:
    """Tumbling windows of `width` seconds: sums, unions of masks, and the last round's incompleteness and runs of equal values.

    rounds(device, ts, x0..x4, incomplete, dup_keys, unknown_sensor, censored, warmup, cold) and, where they are known,
    malformed, rssi_sentinel, bypass_mask and substituted_mask (else 0); cells as for guard_masks(). A channel is
    degraded in a window if it is bypassed or substituted in one of its rounds.
    """
    end = ((F.floor(F.col("ts") / width) + 1) * width).alias("window_end")
    more = {c: F.lit(0) for c in ("malformed", "rssi_sentinel", "bypass_mask", "substituted_mask") if c not in rounds.columns}
    rows = rounds.withColumns({**more, "missing_mask": missing_bits()}).join(guard_masks(cells), ["device", "ts"], "left")
    rows = rows.withColumn("stuck_mask", F.coalesce("stuck_mask", F.lit(0))).withColumn("floor_mask", F.coalesce("floor_mask", F.lit(0)))
    none = F.array_repeat(F.lit(0).cast("long"), CHANNELS)
    return rows.groupBy("device", end).agg(
        F.count(F.lit(1)).alias("rounds"),
        F.count_if("incomplete").alias("incomplete"),
        F.sum("dup_keys").alias("dup_keys"),
        F.sum("unknown_sensor").alias("unknown_sensor"),
        F.count_if("censored").alias("censored"),
        F.count_if("warmup").alias("warmup"),
        F.count_if("cold").alias("cold"),
        F.sum(F.coalesce("malformed", F.lit(0))).alias("malformed"),
        F.sum(F.coalesce("rssi_sentinel", F.lit(0))).alias("rssi_sentinel"),
        F.sum(F.bit_count("bypass_mask")).alias("bypassed"),
        F.sum(F.bit_count("substituted_mask")).alias("substituted"),
        F.bit_or(F.col("bypass_mask").bitwiseOR(F.col("substituted_mask"))).alias("degraded_mask"),
        F.bit_or("missing_mask").alias("missing_mask"),
        F.count_if(F.col("stuck_mask") != 0).alias("stuck_rounds"),
        F.bit_or("stuck_mask").alias("stuck_mask"),
        F.count_if(F.col("floor_mask") != 0).alias("floor_rounds"),
        F.bit_or("floor_mask").alias("floor_mask"),
        F.max_by("incomplete", "ts").alias("last_incomplete"),
        F.max_by(F.coalesce("run_len", none), "ts").alias("run_len"),
        F.max_by(F.coalesce("run_start", none), "ts").alias("run_start"),
    )


def gate(rounds: DataFrame) -> DataFrame:
    """Rounds that the outlier channel admits: after warm-up, with every channel present."""
    return rounds.where(~F.col("warmup") & ~F.col("incomplete"))


def gate_counts(rounds: DataFrame) -> DataFrame:
    """By device: what the gate admits and why it refuses."""
    return rounds.groupBy("device").agg(
        F.count(F.lit(1)).alias("rounds"),
        F.count_if("warmup").alias("warmup"),
        F.count_if(~F.col("warmup") & F.col("incomplete")).alias("missing"),
        F.count_if(~F.col("warmup") & ~F.col("incomplete")).alias("admitted"),
        F.count_if(~F.col("warmup") & ~F.col("incomplete") & F.col("cold")).alias("cold"),
    )
