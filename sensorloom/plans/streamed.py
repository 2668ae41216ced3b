"""Queries of operators with streaming state: fed in parts and out of order, with a restart between parts, heartbeats and late rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import EVENTS
from ..functions.arrays import local_day, rounded
from ..operators import outliers, scaling
from ..streaming import keyed, rounds as streams
from .basic import BINS, CALIBRATED, CELL_SQL, CELL_OF, COLD, DAYS, GUARD, RUNS, SCALER, WARMUP, coarse
from .bindings import PERIOD, READINGS, readings, rounds
from .decisions import LAG, RULES, SCHEDULED, SPRING, WARM, commands_of
from .shared import kept, scratch
from .windowed import DAY, FULL, FULL_SQL, POINTS, START, W, points

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def parted(rows, late: int, time: str = "ts"):
    """rows with part 0 or 1: an earlier and a later half, whose rows near the cut come up to half of `late` too late."""
    low, high = rows.agg(F.min(time), F.max(time)).first()
    arrives = F.col(time) + F.pmod(F.xxhash64("device", time), F.lit(max(1, late // 2)))
    return rows.withColumn("part", (arrives > ((low or 0) + (high or 0)) // 2).cast("int"))


def last_part(rows, late: int, time: str = "ts"):
    """A heartbeat far ahead of all rows, and the earliest rows once more, which come too late by then."""
    low, high = rows.agg(F.min(time), F.max(time)).first()
    ahead = (high or 0) + 200 * DAY
    beat = rows.limit(1).withColumn("device", F.lit(-1).cast("long")).withColumn(time, F.lit(ahead).cast("long")).select(*rows.columns)
    again = rows.where(F.col(time) < (low or 0) + max(1, ((high or 0) - (low or 0)) // 20))
    return beat.unionByName(again)


def fed(spark, rows, build, late: int):
    """What build(stream of rows) gives: two parts and a last one, each run to its end and started again from the checkpoint."""
    path, out, state = (scratch(spark, x) for x in ("fed", "out", "state"))
    rows = kept(rows, "rows")
    halves = parted(rows, late)
    with keyed.rocks(spark):
        for part in (halves.where("part = 0").drop("part"), halves.where("part = 1").drop("part"), last_part(rows, late)):
            part.write.mode("append").parquet(path)
            found = streams.run_to_end(build(spark.readStream.schema(rows.schema).parquet(path)), out, state, "append")
    return found.where("device >= 0")


def fed_both(spark, left, right, build, late: int, time: str):
    """The same for two streams, the right one a part behind the left one."""
    a, b, out, state = (scratch(spark, x) for x in ("left", "right", "out", "state"))
    left, right = kept(left, "left_rows"), kept(right, "right_rows")
    lefts, rights = parted(left, late), parted(right, late, time)
    half = lambda rows, k: rows.where(F.col("part") == k).drop("part")
    # After a restart Spark knows the watermark of a source only from its next rows, so both end with a heartbeat.
    steps = [(half(lefts, 0), None), (half(lefts, 1), half(rights, 0)), (last_part(left, late), half(rights, 1)), (last_part(left, late), last_part(right, late, time))]
    with keyed.rocks(spark):
        for first, second in steps:
            for rows, whole, path in ((first, left, a), (second, right, b)):
                (whole.limit(0) if rows is None else rows).write.mode("append").parquet(path)
            found = streams.run_to_end(build(spark.readStream.schema(left.schema).parquet(a), spark.readStream.schema(right.schema).parquet(b)), out, state, "append")
    return found.where("device >= 0")


LATE = 2 * PERIOD
_Z = ", ".join(f"round(max(z) FILTER (WHERE channel = {c}), 6) + 0.0 AS z{c}" for c in range(5))


@query(f"""WITH {CALIBRATED}, num AS (SELECT device, ts, row_number() OVER (PARTITION BY device ORDER BY ts) <= {WARMUP} AS warmup FROM rounds),
z AS (SELECT c.device, c.ts, c.channel, warmup, CASE WHEN x IS NULL THEN 0.0 WHEN warmup THEN x WHEN coalesce(bypass, true) THEN t ELSE (t - median) / scale END AS z
      FROM (SELECT *, CASE WHEN channel = 4 THEN ln(1 + x) ELSE x END AS t FROM cells) c JOIN num USING (device, ts) LEFT JOIN params USING (device, channel))
SELECT device, ts, bool_or(warmup) AS warmup, {_Z} FROM z GROUP BY device, ts""")
def scaler_stream(spark, sf_dir):
    """scaler_calibrate and normalize as one stream: raw rounds until the scale is frozen, scaled ones after."""
    found = fed(spark, rounds(spark, sf_dir).select("device", "ts", *keyed.CELLS, "censored"), lambda s: keyed.scaled_stream(s, EVENTS, SCALER, LATE), LATE)
    return found.select("device", "ts", "warmup", *[rounded(F.col(f"z{c}")).alias(f"z{c}") for c in range(5)])


@query(f"""WITH {RUNS}, colds AS (SELECT device, ts, coalesce(ts - lag(ts) OVER (PARTITION BY device ORDER BY ts) > {COLD}, false) AS cold FROM rounds)
SELECT device, ts, CAST(channel AS INTEGER) AS channel, CASE WHEN n >= 2 THEN n ELSE 0 END AS run_len, CASE WHEN n >= 2 THEN start ELSE 0 END AS run_start,
n >= 2 AND NOT (channel = 0 AND x = 10.0) AS stuck, n >= 2 AND channel = 0 AND x = 10.0 AS "floor", n = 2 AS crossed, cold FROM counted JOIN colds USING (device, ts)""")
def guard_stream(spark, sf_dir):
    """repeat_run_guard and cold_start as one stream."""
    rows = coarse(spark, sf_dir).select("device", "ts", *keyed.CELLS)
    return fed(spark, rows, lambda s: keyed.guard_stream(s, GUARD, COLD, LATE), LATE)


@query(f"WITH {FULL_SQL} SELECT device, ts, window_end, neighbours FROM near WHERE neighbours < {FULL.k}")
def outlier_stream(spark, sf_dir):
    """sliding_full as a stream, at its 3600 s windows every 60 s."""
    rows = points(spark, sf_dir).withColumn("ts", (F.floor(F.col("ts") / PERIOD) * 10).cast("long"))
    return fed(spark, rows, lambda s: keyed.outlier_stream(s, FULL, 600), 600)


#: Readings around the change to summer time; the first days are the reference, and some later ones deviate.
REF_DAYS, DAY_PERIOD, DAY_LIMIT = 8, 1700, 0.45
LOCAL = f"""{READINGS}, vals AS (SELECT device, sec + {SPRING} AS ts, channel, value AS x, CAST(to_timestamp(sec + {SPRING}) AT TIME ZONE 'Europe/London' AS DATE) AS day FROM readings),
ref AS (SELECT device, channel, x FROM vals WHERE ts < {START + SPRING + REF_DAYS * DAY}),
own AS (SELECT device, ts, day, channel, x + CASE WHEN channel = 0 AND device % 4 = 1 AND (day - DATE '1970-01-01') % 6 >= 3 THEN 1000 ELSE 0 END AS x, device % 8 = 1 AND (day - DATE '1970-01-01') % 5 = 0 AS guarded
        FROM vals WHERE ts >= {START + SPRING + REF_DAYS * DAY}),
ranked AS (SELECT device, channel, x, row_number() OVER (PARTITION BY device, channel ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY device, channel) AS m FROM ref),
edges AS (SELECT DISTINCT device, channel, x AS edge FROM ranked JOIN (SELECT unnest(generate_series(0, {BINS})) AS j) ON r = CAST(floor(j * (m - 1) / {BINS}) AS BIGINT)){CELL_SQL},
rc AS (SELECT device, channel, {CELL_OF} AS cell, count(*) AS r FROM ref JOIN e USING (device, channel) GROUP BY ALL), """
LOCAL += DAYS[DAYS.index("oc AS") :].replace("CAST(channel AS INTEGER)", "channel", 1)
LOCAL += f""", rows_ AS (SELECT device, day, count(*) AS rows_, count(*) FILTER (WHERE guarded) AS guarded,
  CAST(epoch(CAST(day + 1 AS TIMESTAMP) AT TIME ZONE 'Europe/London') - epoch(CAST(day AS TIMESTAMP) AT TIME ZONE 'Europe/London') AS BIGINT) // {DAY_PERIOD} AS expected FROM own GROUP BY device, day),
ev AS (SELECT *, 1.0 - rows_ / expected <= {RULES.missing} AND guarded / expected <= {RULES.guard} AS evaluable FROM dayrows JOIN rows_ USING (device, day)),
mk AS (SELECT *, CASE WHEN evaluable AND p < {RULES.alpha / 5} AND d > {DAY_LIMIT} THEN true WHEN evaluable AND d <= {DAY_LIMIT} THEN false END AS mark FROM ev),
dv AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY device, channel ORDER BY day), false) AS deviated FROM mk)"""


@query(f"""WITH {LOCAL} SELECT device, CAST(day AS VARCHAR) AS day, CAST(channel AS INTEGER) AS channel, n, round(d, 6) + 0.0 AS d, round(p, 6) + 0.0 AS p, round(shift, 6) + 0.0 AS shift, round(width_x, 6) + 0.0 AS width_x,
round(max_cell_mass, 6) + 0.0 AS max_cell_mass, evaluable, deviated,
CASE WHEN deviated AND NOT coalesce(lag(deviated) OVER w, false) THEN 'DEVIATE' WHEN NOT deviated AND coalesce(lag(deviated) OVER w, false) THEN 'RECOVER' END AS transition
FROM dv WINDOW w AS (PARTITION BY device, channel ORDER BY day)""")
def day_stream(spark, sf_dir):
    """day_stats and day_state of local days as a stream, across the change to summer time; the reference is initial state."""
    r = readings(spark, sf_dir)
    at = F.array_position(F.array(*map(F.lit, EVENTS.sensors)), F.col("sensor"))
    v = r.select("device", (F.col("at") + SPRING).cast("long").alias("ts"), (at - 1).cast("int").alias("channel"), F.col("value").alias("x"))
    from_ = START + SPRING + REF_DAYS * DAY
    # Edges of a fixed count a device and channel.
    model = scaling.reference_model(v.where(F.col("ts") < from_), BINS)
    day = F.unix_date(local_day(F.col("ts")))
    broken = (F.col("channel") == 0) & (F.col("device") % 4 == 1) & (day % 6 >= 3)
    own = v.where(F.col("ts") >= from_).withColumn("guarded", (F.col("device") % 8 == 1) & (day % 5 == 0)).withColumn("x", F.col("x") + F.when(broken, 1000.0).otherwise(0.0))
    build = lambda s: keyed.day_stream(s, model, "Europe/London", DAY_PERIOD, RULES.alpha / 5, (DAY_LIMIT,) * 5, RULES.missing, RULES.guard, 3600)
    found = fed(spark, own, build, 3600)
    numbers = [rounded(F.col(c)).alias(c) for c in ("d", "p", "shift", "width_x", "max_cell_mass")]
    return found.select("device", F.col("day").cast("string").alias("day"), "channel", "n", *numbers, "evaluable", "deviated", "transition")


@query(f"""WITH {POINTS}, a AS (SELECT device, (ts // {DAY}) * {DAY} AS bin, count(*) AS admitted FROM pts GROUP BY ALL),
o AS (SELECT device, (ts // {DAY}) * {DAY} AS bin, count(*) AS outliers FROM found WHERE ts >= window_end - {W.slide} GROUP BY ALL)
SELECT device, bin, admitted, coalesce(outliers, 0) AS outliers, round(coalesce(outliers, 0) / admitted, 6) + 0.0 AS rate FROM a LEFT JOIN o USING (device, bin)""")
def connect_rounds_scores(spark, sf_dir):
    """Rounds and their scores, two streams in one processor; the scores come a part behind."""
    p = points(spark, sf_dir)
    found = fed_both(spark, p.select("device", "ts"), outliers.outliers(p, W).select("device", "ts", "window_end"), lambda a, b: keyed.bin_stream(a, b, DAY, W.slide, LATE, LATE), LATE, "window_end")
    return found.select("device", "bin", "admitted", "outliers", rounded(F.col("rate")).alias("rate"))


@query(f"WITH {SCHEDULED} SELECT CAST(device AS BIGINT) AS device, seq, CAST(level AS INTEGER) AS level, effective_at, verdict, CASE WHEN verdict IN ('executed', 'forwarded') THEN first_ts END AS executes FROM sched WHERE verdict <> 'waiting'")
def connect_commands(spark, sf_dir):
    """Rounds and commands, two streams in one processor: the verdicts of command_schedule but for commands that wait for their round."""
    r = rounds(spark, sf_dir).select("device", "ts")
    return fed_both(spark, r, commands_of(r), lambda a, b: keyed.command_stream(a, b, WARM, LAG, LATE), LATE, "decided_at")


@query()
def perf_stream(spark, sf_dir):
    """perf_layer as a stream: hourly medians, a change of generation, detector and gate in state."""
    from .checks import scores

    return fed(spark, scores(spark, sf_dir), lambda s: streams.performance_stream(s, 3600, patience=12), 3600)
