"""Queries of ingestion, profiling, guard and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import EVENTS, Guard, Scaler
from ..functions.arrays import rounded
from ..operators import ingest, profile, quality, scaling
from .bindings import CELLS, COPIED, PERIOD, READINGS, ROUNDS, VALUES, copied, readings, rounds, table, values

GUARD = Guard(thresholds=(2, 2, 2, 2, 2), floors={0: (10.0,)}, gap=2 * PERIOD)
COLD = 4 * PERIOD
WARMUP = 40
SCALER = Scaler(rounds=WARMUP)
#: So that some channels have too little spread and some have it replaced.
DEGRADED = Scaler(rounds=WARMUP, epsilon=35.0, relative=0.56)
Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def lines(spark, sf_dir):
    """Raw lines made of events: every 97th is cut short, every 101st has no device, every 103rd no number."""
    r = readings(spark, sf_dir)
    value = F.when(F.col("seq") % 103 == 0, F.lit("n/a")).otherwise(F.format_string("%.6f", F.col("value")))
    device = F.when(F.col("seq") % 101 == 0, F.lit("")).otherwise(F.col("device").cast("string"))
    whole = F.concat_ws(",", F.col("at").cast("string"), device, "sensor", value)
    return r.select("seq", F.when(F.col("seq") % 97 == 0, F.concat_ws(",", F.col("at").cast("string"), device)).otherwise(whole).alias("value"))


LINES = f"""{READINGS}, parsed AS (
  SELECT seq, CASE WHEN seq % 101 = 0 THEN '' ELSE CAST(device AS VARCHAR) END AS device, sec, sensor,
         seq % 97 <> 0 AND seq % 103 <> 0 AS good
  FROM readings
)"""


@query(f"WITH {LINES} SELECT CASE WHEN device = '' THEN 'malformed_no_device' WHEN good THEN 'ok' ELSE 'malformed' END AS status, device, count(*) AS n, CAST(sum(CASE WHEN seq % 97 = 0 THEN NULL ELSE sec END) AS BIGINT) AS total_ts FROM parsed GROUP BY ALL")
def parse_line(spark, sf_dir):
    parsed = ingest.parse_lines(lines(spark, sf_dir), EVENTS)
    ts = F.when(F.col("sensor").isNotNull(), F.col("ts"))
    return parsed.groupBy("status", "device").agg(F.count(F.lit(1)).alias("n"), F.sum(ts).alias("total_ts"))


@query(f"""WITH {LINES}
SELECT count(*) AS lines_in, count(*) FILTER (WHERE device <> '' AND NOT good) AS malformed, count(*) FILTER (WHERE device = '') AS malformed_no_device,
       CAST(0 AS BIGINT) AS unknown_sensor, CAST(0 AS BIGINT) AS censored, CAST(0 AS BIGINT) AS rssi_sentinel FROM parsed""")
def parse_counters(spark, sf_dir):
    return ingest.parse_counters(ingest.parse_lines(lines(spark, sf_dir), EVENTS), EVENTS)


@query(f"WITH {READINGS} SELECT sensor, CASE WHEN channel IS NULL THEN 'unknown' ELSE 'detection' END AS kind, CAST(channel AS INTEGER) AS channel, count(*) AS n FROM readings GROUP BY ALL")
def classify_sensor(spark, sf_dir):
    return ingest.classify(readings(spark, sf_dir), EVENTS).groupBy("sensor", "kind", "channel").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ROUNDS} SELECT device, ts, x0, x1, x2, x3, x4, dup_keys, unknown_sensor, incomplete FROM rounds")
def round_assemble(spark, sf_dir):
    return rounds(spark, sf_dir).select("device", "ts", "x0", "x1", "x2", "x3", "x4", "dup_keys", "unknown_sensor", "incomplete")


@query(f"""WITH {ROUNDS} SELECT device, ts, CAST((x0 IS NULL)::INTEGER + 2 * (x1 IS NULL)::INTEGER + 4 * (x2 IS NULL)::INTEGER + 8 * (x3 IS NULL)::INTEGER + 16 * (x4 IS NULL)::INTEGER AS INTEGER) AS missing_mask FROM rounds""")
def mask_bits(spark, sf_dir):
    return ingest.mask_bits(rounds(spark, sf_dir))


@query(f"WITH {CELLS} SELECT channel, count(*) FILTER (WHERE x IS NULL) AS missing, count(*) AS rounds FROM cells GROUP BY channel")
def mask_unpack(spark, sf_dir):
    return ingest.unpack_mask(ingest.mask_bits(rounds(spark, sf_dir))).groupBy("channel").agg(F.count_if("missing").alias("missing"), F.count(F.lit(1)).alias("rounds"))


@query(f"""WITH {READINGS}, last AS (SELECT device, ts, max(seq) AS seq FROM readings GROUP BY device, ts),
marks AS (SELECT device, seq, ts, 0 AS bad FROM last UNION ALL SELECT device, seq, NULL, 1 FROM readings WHERE seq % 97 = 0 OR seq % 103 = 0),
run AS (SELECT *, sum(bad) OVER (PARTITION BY device ORDER BY seq, bad, ts ROWS UNBOUNDED PRECEDING) AS total FROM marks)
SELECT device, ts, CAST(total - lag(total, 1, 0) OVER (PARTITION BY device ORDER BY seq, ts) AS BIGINT) AS malformed FROM run WHERE bad = 0""")
def malformed_attach(spark, sf_dir):
    r = readings(spark, sf_dir)
    last = r.groupBy("device", "ts").agg(F.max("seq").alias("last_seq"))
    return ingest.attach_malformed(last, r.where("seq % 97 = 0 OR seq % 103 = 0").select("device", "seq"))


def marked(spark, sf_dir):
    return quality.cold_start(quality.warmup(rounds(spark, sf_dir), WARMUP), COLD)


MARKED = f"""{ROUNDS}, marked AS (
  SELECT *, row_number() OVER w AS number, row_number() OVER w <= {WARMUP} AS warmup, coalesce(ts - lag(ts) OVER w > {COLD}, false) AS cold
  FROM rounds WINDOW w AS (PARTITION BY device ORDER BY ts)
)"""


@query(f"WITH {MARKED} SELECT device, ts, number, warmup, cold FROM marked")
def warmup_freeze(spark, sf_dir):
    return marked(spark, sf_dir).select("device", "ts", F.col("number").cast("long").alias("number"), "warmup", "cold")


@query(f"WITH {ROUNDS} SELECT device, ts FROM (SELECT device, ts, ts - lag(ts) OVER (PARTITION BY device ORDER BY ts) AS d FROM rounds WHERE NOT incomplete) WHERE d > {PERIOD}")
def cold_start(spark, sf_dir):
    """Cold starts of complete rounds: the round before is more than a period away."""
    return quality.cold_start(rounds(spark, sf_dir).where("NOT incomplete"), PERIOD).where("cold").select("device", "ts")


@query(f"""WITH {MARKED} SELECT device, count(*) AS rounds, count(*) FILTER (WHERE warmup) AS warmup, count(*) FILTER (WHERE NOT warmup AND incomplete) AS missing,
count(*) FILTER (WHERE NOT warmup AND NOT incomplete) AS admitted, count(*) FILTER (WHERE NOT warmup AND NOT incomplete AND cold) AS cold FROM marked GROUP BY device""")
def gate_m2(spark, sf_dir):
    return ingest.gate_counts(marked(spark, sf_dir))


def coarse(spark, sf_dir):
    """Rounds whose values are rounded to tens, so that runs of equal values occur."""
    return rounds(spark, sf_dir).select("device", "ts", *[(F.floor(F.col(f"x{c}") / 10) * 10.0).alias(f"x{c}") for c in range(5)], "incomplete", "censored")


RUNS = f"""{CELLS}, coarse AS (SELECT device, ts, channel, floor(x / 10) * 10.0 AS x FROM cells WHERE x IS NOT NULL),
eras AS (SELECT device, ts, sum(cold) OVER (PARTITION BY device ORDER BY ts) AS era FROM (SELECT device, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY device ORDER BY ts) > {COLD} THEN 1 ELSE 0 END AS cold FROM rounds)),
marks AS (
  SELECT c.*, CASE WHEN x = lag(x) OVER w AND ts - lag(ts) OVER w <= {GUARD.gap} AND era = lag(era) OVER w THEN 0 ELSE 1 END AS fresh
  FROM coarse c JOIN eras USING (device, ts) WINDOW w AS (PARTITION BY device, channel ORDER BY ts)
), runs AS (SELECT *, sum(fresh) OVER (PARTITION BY device, channel ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM marks),
counted AS (SELECT *, row_number() OVER (PARTITION BY device, channel, run ORDER BY ts) AS n, min(ts) OVER (PARTITION BY device, channel, run) AS start FROM runs)"""


@query(f"""WITH {RUNS}, marked AS (
  SELECT *, row_number() OVER w <= {WARMUP} AS warmup, coalesce(ts - lag(ts) OVER w > {COLD}, false) AS cold FROM rounds WINDOW w AS (PARTITION BY device ORDER BY ts)
), g AS (
  SELECT device, ts, CAST(bit_or(CASE WHEN n >= 2 AND NOT (channel = 0 AND x = 10.0) THEN 1 << CAST(channel AS INTEGER) ELSE 0 END) AS INTEGER) AS s, CAST(bit_or(CASE WHEN n >= 2 AND channel = 0 AND x = 10.0 THEN 1 ELSE 0 END) AS INTEGER) AS f,
    {', '.join(f'coalesce(max(CASE WHEN channel = {c} AND n >= 2 THEN n END), 0) AS l{c}, coalesce(max(CASE WHEN channel = {c} AND n >= 2 THEN start END), 0) AS b{c}' for c in range(5))}
  FROM counted GROUP BY device, ts
), tt AS (SELECT device, channel, CASE WHEN channel = 4 THEN ln(1 + x) ELSE x END AS t FROM cells JOIN (SELECT device, ts FROM (SELECT device, ts, row_number() OVER (PARTITION BY device ORDER BY ts) AS k FROM rounds) WHERE k <= {WARMUP}) USING (device, ts) WHERE x IS NOT NULL
), qq AS (SELECT device, channel, quantile_cont(t, 0.75) - quantile_cont(t, 0.25) AS iqr, quantile_cont(t, 0.95) - quantile_cont(t, 0.05) AS body FROM tt GROUP BY device, channel
), masks AS (SELECT device, CAST(bit_or(CASE WHEN iqr <= {DEGRADED.epsilon} THEN 1 << CAST(channel AS INTEGER) ELSE 0 END) AS INTEGER) AS by_,
    CAST(bit_or(CASE WHEN iqr > {DEGRADED.epsilon} AND iqr < {DEGRADED.relative} * body AND body > {DEGRADED.epsilon} AND body / {DEGRADED.body} > {DEGRADED.epsilon} THEN 1 << CAST(channel AS INTEGER) ELSE 0 END) AS INTEGER) AS su_ FROM qq GROUP BY device
), lows AS (SELECT device, ts, count(*) FILTER (WHERE sensor = 'view' AND value < 5) AS low FROM readings GROUP BY device, ts
), bits AS (
  SELECT m.*, (x0 IS NULL)::INTEGER + 2 * (x1 IS NULL)::INTEGER + 4 * (x2 IS NULL)::INTEGER + 8 * (x3 IS NULL)::INTEGER + 16 * (x4 IS NULL)::INTEGER AS m, coalesce(s, 0) AS s, coalesce(f, 0) AS f,
    concat_ws(',', {', '.join(f'coalesce(l{c}, 0)' for c in range(5))}) AS lens, concat_ws(',', {', '.join(f'coalesce(b{c}, 0)' for c in range(5))}) AS begins,
    CASE WHEN warmup THEN 0 ELSE coalesce(by_, 0) END AS by_, CASE WHEN warmup THEN 0 ELSE coalesce(su_, 0) END AS su_, coalesce(low, 0) AS low
  FROM marked m LEFT JOIN g USING (device, ts) LEFT JOIN masks USING (device) LEFT JOIN lows USING (device, ts)
)
SELECT device, CAST((floor(ts / 86400) + 1) * 86400 AS BIGINT) AS window_end, count(*) AS rounds, count(*) FILTER (WHERE incomplete) AS incomplete, CAST(sum(dup_keys) AS BIGINT) AS dup_keys,
       CAST(sum(unknown_sensor) AS BIGINT) AS unknown_sensor, count(*) FILTER (WHERE censored) AS censored, count(*) FILTER (WHERE warmup) AS warmup, count(*) FILTER (WHERE cold) AS cold,
       CAST(0 AS BIGINT) AS malformed, CAST(sum(low) AS BIGINT) AS rssi_sentinel, CAST(sum(bit_count(by_)) AS BIGINT) AS bypassed, CAST(sum(bit_count(su_)) AS BIGINT) AS substituted, CAST(bit_or(by_ | su_) AS INTEGER) AS degraded_mask,
       CAST(bit_or(m) AS INTEGER) AS missing_mask, count(*) FILTER (WHERE s <> 0) AS stuck_rounds, bit_or(s) AS stuck_mask, count(*) FILTER (WHERE f <> 0) AS floor_rounds, bit_or(f) AS floor_mask,
       arg_max(incomplete, ts) AS last_incomplete, arg_max(lens, ts) AS run_len, arg_max(begins, ts) AS run_start
FROM bits GROUP BY device, window_end""")
def monitor_60s(spark, sf_dir):
    low = readings(spark, sf_dir).groupBy("device", "ts").agg(F.count_if((F.col("sensor") == "view") & (F.col("value") < 5)).alias("rssi_sentinel"))
    r = marked(spark, sf_dir).join(low, ["device", "ts"], "left")
    r = ingest.degraded(r, scaling.calibrate(rounds(spark, sf_dir), EVENTS, DEGRADED))
    m = ingest.monitor(r, quality.repeat_runs(coarse(spark, sf_dir), GUARD, COLD), 4 * PERIOD)
    flat = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return m.select(*[flat(c) if c in ("run_len", "run_start") else c for c in m.columns])


@query(f"""WITH {RUNS} SELECT device, ts, CAST(channel AS INTEGER) AS channel, CASE WHEN n >= 2 THEN n ELSE 0 END AS run_len, CASE WHEN n >= 2 THEN start ELSE 0 END AS run_start,
n >= 2 AND NOT (channel = 0 AND x = 10.0) AS stuck, n >= 2 AND channel = 0 AND x = 10.0 AS "floor", n = 2 AS crossed FROM counted""")
def repeat_run_guard(spark, sf_dir):
    return quality.repeat_runs(coarse(spark, sf_dir), GUARD, COLD)


@query(f"WITH {RUNS}, ends AS (SELECT device, channel, run, max(n) AS length FROM counted GROUP BY ALL) SELECT device, CAST(channel AS INTEGER) AS channel, length, count(*) AS runs FROM ends GROUP BY device, channel, length")
def run_lengths(spark, sf_dir):
    return quality.run_ends(coarse(spark, sf_dir), GUARD, COLD)


GAPS = f"""{ROUNDS}, g AS (SELECT device, lag(ts) OVER (PARTITION BY device ORDER BY ts) AS start, ts AS stop FROM rounds)"""


@query(f"WITH {ROUNDS}, g AS (SELECT device, lag(ts) OVER (PARTITION BY device ORDER BY ts) AS start, ts AS stop FROM rounds WHERE NOT incomplete) SELECT device, start, stop, stop - start AS seconds FROM g WHERE stop - start > {PERIOD}")
def gaps(spark, sf_dir):
    """Gaps between complete rounds."""
    return quality.gaps(rounds(spark, sf_dir).where("NOT incomplete"), PERIOD)


@query(f"WITH {GAPS} SELECT device, start, stop, stop - start AS seconds FROM g WHERE stop - start > 0 ORDER BY seconds DESC, device, start LIMIT 100")
def topk_gaps(spark, sf_dir):
    return quality.longest_gaps(rounds(spark, sf_dir), 0, 100)


@query(f"WITH {ROUNDS} SELECT device, ts, array_to_string(list(ts) OVER (PARTITION BY device ORDER BY ts ROWS 5 PRECEDING), ',') AS ring FROM rounds")
def round_window(spark, sf_dir):
    return quality.last_rounds(rounds(spark, sf_dir), 6).select("device", "ts", F.array_join(F.col("ring").cast("array<string>"), ",").alias("ring"))


CALIBRATED = f"""{CELLS}, firsts AS (SELECT device, ts FROM (SELECT device, ts, row_number() OVER (PARTITION BY device ORDER BY ts) AS k FROM rounds) WHERE k <= {WARMUP}),
t AS (SELECT c.device, c.channel, CASE WHEN channel = 4 THEN ln(1 + x) ELSE x END AS t FROM cells c JOIN firsts USING (device, ts) WHERE x IS NOT NULL),
p AS (SELECT device, channel, count(*) AS n, quantile_cont(t, 0.25) AS p25, quantile_cont(t, 0.5) AS median, quantile_cont(t, 0.75) AS p75 FROM t GROUP BY device, channel),
params AS (SELECT device, channel, n, median, CASE WHEN p75 - p25 <= 1e-9 THEN 1.0 ELSE p75 - p25 END AS scale, p75 - p25 <= 1e-9 AS bypass FROM p)"""


@query(f"WITH {CALIBRATED} SELECT device, CAST(channel AS INTEGER) AS channel, n, round(median, 6) + 0.0 AS median, round(scale, 6) + 0.0 AS scale, bypass, false AS substituted FROM params")
def scaler_calibrate(spark, sf_dir):
    p = scaling.calibrate(rounds(spark, sf_dir), EVENTS, SCALER)
    return p.withColumn("median", rounded(F.col("median"))).withColumn("scale", rounded(F.col("scale")))


@query(f"""WITH {CALIBRATED}, z AS (SELECT c.device, c.ts, c.channel, x, CASE WHEN c.channel = 4 THEN ln(1 + x) ELSE x END AS t FROM cells c)
SELECT z.device, ts, CAST(z.channel AS INTEGER) AS channel, round(CASE WHEN x IS NULL THEN 0.0 WHEN coalesce(bypass, true) THEN t ELSE (t - median) / scale END, 6) + 0.0 AS z
FROM z LEFT JOIN params USING (device, channel)""")
def normalize(spark, sf_dir):
    r = rounds(spark, sf_dir)
    return scaling.normalize(r, scaling.calibrate(r, EVENTS, SCALER), EVENTS).withColumn("z", rounded(F.col("z")))


@query(f"WITH {CELLS} SELECT channel, round(sum(ln(1 + x)), 6) + 0.0 AS total FROM cells WHERE channel = 4 GROUP BY channel")
def channel_transform(spark, sf_dir):
    cells = scaling.transformed(quality.channel_rows(rounds(spark, sf_dir)), EVENTS)
    return cells.where("channel = 4").groupBy("channel").agg(rounded(F.sum("t")).alias("total"))


BINS = 20
REFERENCE = f"""{VALUES}, days AS (SELECT *, day - (SELECT min(day) FROM vals) AS d FROM vals), ref AS (SELECT device, channel, x FROM days WHERE d < 400),
ranked AS (SELECT device, channel, x, row_number() OVER (PARTITION BY device, channel ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY device, channel) AS m FROM ref),
edges AS (SELECT DISTINCT device, channel, x AS edge FROM ranked JOIN (SELECT unnest(generate_series(0, {BINS})) AS j) ON r = CAST(floor(j * (m - 1) / {BINS}) AS BIGINT))"""


def dated(spark, sf_dir):
    """values() with d, the days since the first one."""
    return values(spark, sf_dir).withColumn("d", F.col("day") - table(spark, sf_dir, "lineitem").agg(F.min(F.unix_date(F.col("l_shipdate").cast("date")))).scalar())


def reference(spark, sf_dir):
    days = dated(spark, sf_dir)
    return days.where("d < 400").select("device", "channel", "x"), days.where("d >= 400").select("device", F.floor(F.col("d") / 100).alias("day"), "channel", "x")


@query(f"WITH {REFERENCE} SELECT device, CAST(channel AS INTEGER) AS channel, round(edge, 6) + 0.0 AS edge FROM edges")
def ref_histogram(spark, sf_dir):
    ref, _ = reference(spark, sf_dir)
    return scaling.reference_edges(ref, BINS).withColumn("edge", rounded(F.col("edge")))


CELL_SQL = """, e AS (SELECT device, channel, list(edge ORDER BY edge) AS es FROM edges GROUP BY device, channel)"""
CELL_OF = "CASE WHEN list_contains(es, x) THEN CAST(list_position(es, x) AS INTEGER) ELSE CASE WHEN x < es[1] THEN 0 ELSE CAST(len(list_filter(es, lambda v: v < x)) + 1 AS INTEGER) END END"


@query(f"WITH {REFERENCE}{CELL_SQL} SELECT device, CAST(channel AS INTEGER) AS channel, {CELL_OF} AS cell, count(*) AS n FROM ref JOIN e USING (device, channel) GROUP BY ALL")
def ref_cells(spark, sf_dir):
    ref, _ = reference(spark, sf_dir)
    return scaling.histogram(ref, scaling.reference_edges(ref, BINS), BINS)


DAYS = f"""{REFERENCE}{CELL_SQL}, own AS (SELECT device, CAST(floor(d / 100) AS BIGINT) AS day, channel, x FROM days WHERE d >= 400),
rc AS (SELECT device, channel, {CELL_OF} AS cell, count(*) AS r FROM ref JOIN e USING (device, channel) GROUP BY ALL),
oc AS (SELECT device, day, channel, {CELL_OF} AS cell, count(*) AS c FROM own JOIN e USING (device, channel) GROUP BY ALL),
keys AS (SELECT DISTINCT device, day, channel FROM oc),
frame AS (SELECT device, day, channel, cell, sum(c) AS c, sum(r) AS r FROM (SELECT device, day, channel, cell, 0 AS c, r FROM keys JOIN rc USING (device, channel) UNION ALL SELECT device, day, channel, cell, c, 0 FROM oc) GROUP BY ALL),
cum AS (SELECT *, sum(c) OVER w AS n, sum(r) OVER w AS m, sum(c) OVER o AS cc, sum(r) OVER o AS cr FROM frame WINDOW w AS (PARTITION BY device, day, channel), o AS (PARTITION BY device, day, channel ORDER BY cell)),
st AS (SELECT device, day, channel, max(n) AS n, max(m) AS m, max(abs(cc / n - cr / m)) AS d, max(c) / max(n) AS mass FROM cum GROUP BY device, day, channel),
q AS (SELECT device, day, channel, quantile_cont(x, 0.1) AS a, quantile_cont(x, 0.5) AS b, quantile_cont(x, 0.9) AS c FROM own GROUP BY ALL),
b AS (SELECT device, channel, quantile_cont(x, 0.1) AS ra, quantile_cont(x, 0.5) AS rb, quantile_cont(x, 0.9) AS rc FROM ref GROUP BY ALL),
final AS (SELECT device, day, channel, n, m, d, sqrt(CAST(n AS DOUBLE) * m / (n + m)) * d AS lam, mass, q.b AS med, q.a AS qa, q.c AS qc, ra, rb, b.rc AS rc FROM st JOIN q USING (device, day, channel) JOIN b USING (device, channel)),
dayrows AS (SELECT device, day, CAST(channel AS INTEGER) AS channel, CAST(n AS BIGINT) AS n, d,
  CASE WHEN lam < 1e-3 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(generate_series(1, 100), lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * lam * lam))))) END AS p,
  CASE WHEN rc > ra THEN (med - rb) / (rc - ra) END AS shift, CASE WHEN rc > ra THEN (qc - qa) / (rc - ra) END AS width_x, mass AS max_cell_mass FROM final)"""


@query(f"WITH {DAYS} SELECT device, day, channel, n, round(d, 6) + 0.0 AS d, round(p, 6) + 0.0 AS p, round(shift, 6) + 0.0 AS shift, round(width_x, 6) + 0.0 AS width_x, round(max_cell_mass, 6) + 0.0 AS max_cell_mass FROM dayrows")
def day_stats(spark, sf_dir):
    ref, own = reference(spark, sf_dir)
    s = scaling.day_stats(own, scaling.reference_model(ref, BINS), BINS)
    return s.select("device", "day", "channel", "n", *[rounded(F.col(c)).alias(c) for c in ("d", "p", "shift", "width_x", "max_cell_mass")])


@query(f"""WITH {REFERENCE}, both_ AS (SELECT device, channel, x, sum(a) AS a, sum(b) AS b FROM (SELECT device, channel, x, 1 AS a, 0 AS b FROM ref UNION ALL SELECT device, channel, x, 0, 1 FROM days WHERE d >= 400) GROUP BY ALL),
c AS (SELECT *, sum(a) OVER p AS n, sum(b) OVER p AS m, sum(a) OVER o AS ca, sum(b) OVER o AS cb FROM both_ WINDOW p AS (PARTITION BY device, channel), o AS (PARTITION BY device, channel ORDER BY x))
SELECT device, CAST(channel AS INTEGER) AS channel, CAST(max(n) AS BIGINT) AS n, CAST(max(m) AS BIGINT) AS m, round(max(abs(ca / n - cb / m)), 6) + 0.0 AS d FROM c GROUP BY device, channel""")
def ks_exact(spark, sf_dir):
    sides = dated(spark, sf_dir).where("d IS NOT NULL").select("device", "channel", "x", (F.col("d") < 400).alias("left"))
    return scaling.ks_split(sides, ["device", "channel"]).withColumn("d", rounded(F.col("d")))


@query(f"""WITH {REFERENCE}{CELL_SQL}, h AS (SELECT device, channel, cell, sum(a) + 0.5 AS a, sum(b) + 0.5 AS b FROM (
  SELECT device, channel, {CELL_OF} AS cell, 1 AS a, 0 AS b FROM ref JOIN e USING (device, channel) UNION ALL
  SELECT device, channel, {CELL_OF}, 0, 1 FROM days JOIN e USING (device, channel) WHERE d >= 400) GROUP BY ALL),
t AS (SELECT *, sum(a) OVER p AS ta, sum(b) OVER p AS tb FROM h WINDOW p AS (PARTITION BY device, channel))
SELECT device, CAST(channel AS INTEGER) AS channel, count(*) AS cells,
  round(2 * sum(a * ln(a / ((a + b) / (ta + tb) * ta)) + b * ln(b / ((a + b) / (ta + tb) * tb))), 6) + 0.0 AS g, round(sum(a / ta * ln((a / ta) / (b / tb))), 6) + 0.0 AS kl
FROM t GROUP BY device, channel""")
def g_test(spark, sf_dir):
    ref, own = reference(spark, sf_dir)
    edges = scaling.reference_edges(ref, BINS)
    g = scaling.g_statistic(scaling.histogram(ref, edges, BINS), scaling.histogram(own.select("device", "channel", "x"), edges, BINS), ["device", "channel"])
    return g.select("device", "channel", "cells", rounded(F.col("g")).alias("g"), rounded(F.col("kl")).alias("kl"))


@query(f"WITH {READINGS} SELECT device, sensor, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS low, max(value) AS high FROM readings GROUP BY device, sensor")
def channel_stats(spark, sf_dir):
    s = profile.channel_stats(readings(spark, sf_dir))
    return s.withColumn("mean", rounded(F.col("mean"))).withColumn("sd", rounded(F.col("sd")))


@query(f"""WITH {READINGS}, r AS (SELECT *, strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m') AS month FROM readings)
SELECT device, sensor, month, CAST(GROUPING(device, sensor, month) AS INTEGER) AS level, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM r GROUP BY ROLLUP (device, sensor, month)""")
def channel_rollup(spark, sf_dir):
    return profile.channel_rollup(readings(spark, sf_dir)).withColumn("total", rounded(F.col("total"), 4))


HIST = f"""{READINGS}, hist AS (SELECT device, sensor, CAST(least(49, greatest(0, floor(value / 10))) AS INTEGER) AS bin, count(*) AS n FROM readings GROUP BY ALL)"""


@query(f"WITH {HIST} SELECT * FROM hist")
def sparse_hist(spark, sf_dir):
    return profile.sparse_histogram(readings(spark, sf_dir), 0.0, 10.0, 50, "device", "sensor")


@query(f"""WITH {HIST}, c AS (SELECT *, sum(n) OVER (PARTITION BY device, sensor ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY device, sensor) AS total FROM hist)
SELECT device, sensor, round(10.0 * (bin + (0.5 * total - (upto - n)) / n), 6) AS q FROM c WHERE upto >= 0.5 * total AND upto - n < 0.5 * total""")
def counter_quantile(spark, sf_dir):
    h = profile.sparse_histogram(readings(spark, sf_dir), 0.0, 10.0, 50, "device", "sensor")
    return profile.histogram_quantile(h, 0.5, 0.0, 10.0, "device", "sensor").withColumn("q", rounded(F.col("q")))


@query(f"""WITH {READINGS}, mid AS (SELECT (min(sec) + max(sec)) / 2 AS m FROM readings),
h AS (SELECT sensor, CAST(least(49, greatest(0, floor(value / 10))) AS INTEGER) AS bin, count(*) FILTER (WHERE sec < m) AS a, count(*) FILTER (WHERE sec >= m) AS b FROM readings, mid GROUP BY ALL),
c AS (SELECT *, sum(a) OVER o / sum(a) OVER p AS ca, sum(b) OVER o / sum(b) OVER p AS cb FROM h WINDOW p AS (PARTITION BY sensor), o AS (PARTITION BY sensor ORDER BY bin))
SELECT sensor, round(max(abs(ca - cb)), 6) + 0.0 AS d FROM c GROUP BY sensor""")
def hist_ks(spark, sf_dir):
    r = readings(spark, sf_dir)
    middle = r.agg(((F.min("at") + F.max("at")) / 2).alias("m")).first()["m"]
    a, b = (profile.sparse_histogram(r.where(c), 0.0, 10.0, 50, "sensor") for c in (F.col("at") < middle, F.col("at") >= middle))
    return profile.histogram_ks(a, b, "sensor").withColumn("d", rounded(F.col("d")))


@query(f"""WITH {READINGS}, t AS (SELECT DISTINCT device, sec FROM readings), d AS (SELECT device, least(sec - lag(sec) OVER (PARTITION BY device ORDER BY sec), 7200) AS delta FROM t)
SELECT device, delta, count(*) AS n FROM d WHERE delta IS NOT NULL GROUP BY device, delta""")
def interarrival(spark, sf_dir):
    return profile.interarrival(readings(spark, sf_dir), 7200)


@query(f"WITH {READINGS}, k AS (SELECT device, ts, sensor, count(*) AS n FROM readings GROUP BY ALL HAVING count(*) > 1) SELECT device, sensor, count(*) AS keys, CAST(sum(n - 1) AS BIGINT) AS extra FROM k GROUP BY device, sensor")
def dup_keys(spark, sf_dir):
    return profile.duplicate_keys(readings(spark, sf_dir))


@query(f"WITH {READINGS} SELECT seq, device, ts, sensor, value FROM (SELECT *, row_number() OVER (PARTITION BY device, ts, sensor ORDER BY seq) AS k FROM readings) WHERE k = 1")
def dedup_keep_first(spark, sf_dir):
    return profile.keep_first(readings(spark, sf_dir)).select("seq", "device", "ts", "sensor", "value")


@query(f"WITH {READINGS} SELECT strftime(to_timestamp(sec) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, device // 8 AS block, {', '.join(f'count(*) FILTER (WHERE device % 8 = {d}) AS d{d}' for d in range(8))} FROM readings GROUP BY day, block")
def uptime_matrix(spark, sf_dir):
    return profile.uptime_matrix(readings(spark, sf_dir))


@query(f"WITH {ROUNDS} SELECT device, strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS rounds FROM rounds GROUP BY ALL")
def rounds_per_day(spark, sf_dir):
    return profile.rounds_per_day(rounds(spark, sf_dir))


@query(f"WITH {READINGS}, s AS (SELECT device, ts, count(*) AS readings FROM readings GROUP BY ALL) SELECT readings, count(*) AS rounds FROM s GROUP BY readings")
def round_size_dist(spark, sf_dir):
    return profile.round_sizes(readings(spark, sf_dir))


@query(f"WITH {READINGS}, s AS (SELECT device, sensor, count(value) AS n, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM readings GROUP BY ALL) SELECT device, sensor, n, round(iqr, 6) + 0.0 AS iqr FROM s WHERE iqr <= 50")
def degenerate_channels(spark, sf_dir):
    return profile.degenerate(readings(spark, sf_dir), 50).withColumn("iqr", rounded(F.col("iqr")))


@query(f"WITH {READINGS} SELECT device, sensor, count(value) AS n, count(*) FILTER (WHERE value < 1) AS below, count(*) FILTER (WHERE value > 100) AS above, count(*) FILTER (WHERE value IN (-999, -9999, -99, 999999)) AS sentinel FROM readings GROUP BY ALL")
def unit_sanity(spark, sf_dir):
    return profile.unit_sanity(readings(spark, sf_dir), 1, 100, (-999.0, -9999.0, -99.0, 999999.0))


@query(f"WITH {READINGS} SELECT strftime(to_timestamp(sec) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, sensor, count(value) AS n, round(sum(value), 4) + 0.0 AS total FROM readings GROUP BY ALL")
def daily_means(spark, sf_dir):
    return profile.daily_means(readings(spark, sf_dir)).withColumn("total", rounded(F.col("total"), 4))


@query(f"WITH {READINGS} SELECT strftime(date_trunc('week', to_timestamp(sec) AT TIME ZONE 'UTC'), '%Y-%m-%d') AS week, count(*) AS n FROM readings GROUP BY week")
def files_per_week(spark, sf_dir):
    return profile.weekly_counts(readings(spark, sf_dir))


@query(f"""WITH {READINGS}, r AS (SELECT device, sensor, value, CAST(floor(sec / 86400) AS BIGINT) AS day, min(CAST(floor(sec / 86400) AS BIGINT)) OVER (PARTITION BY device) AS start FROM readings),
q AS (SELECT device, sensor, day, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90 FROM r GROUP BY ALL),
b AS (SELECT device, sensor, quantile_cont(value, 0.5) AS base FROM r WHERE day < start + 7 GROUP BY ALL)
SELECT device, sensor, day, round(median, 6) AS median, round(p10, 6) AS p10, round(p90, 6) AS p90, round(median - base, 6) + 0.0 AS shift FROM q JOIN b USING (device, sensor)""")
def daily_profile(spark, sf_dir):
    p = profile.daily_profile(readings(spark, sf_dir), 7)
    return p.select("device", "sensor", "day", *[rounded(F.col(c)).alias(c) for c in ("median", "p10", "p90", "shift")])


@query(f"WITH {READINGS} SELECT sensor, CAST(floor(sec % 86400 / 3600) AS INTEGER) AS hour, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9) - quantile_cont(value, 0.1), 6) AS width FROM readings GROUP BY ALL")
def fleet_profile(spark, sf_dir):
    p = profile.hour_profile(readings(spark, sf_dir))
    return p.withColumn("median", rounded(F.col("median"))).withColumn("width", rounded(F.col("width")))


@query(f"""WITH {READINGS} SELECT device, sensor, count(value) AS n, quantile_disc(value, 0.01) AS p1, quantile_disc(value, 0.99) AS p99, round(quantile_disc(value, 0.75) - quantile_disc(value, 0.25), 6) + 0.0 AS iqr, round(kurtosis_pop(value), 6) + 0.0 AS kurtosis FROM readings GROUP BY ALL""")
def dispersion(spark, sf_dir):
    d = profile.dispersion(readings(spark, sf_dir))
    return d.withColumn("iqr", rounded(F.col("iqr"))).withColumn("kurtosis", rounded(F.col("kurtosis")))


@query(f"""WITH {READINGS}, r AS (SELECT device, sensor, value, sec < min(sec) OVER (PARTITION BY device) + 7 * 86400 AS early FROM readings)
SELECT device, sensor, round((quantile_cont(value, 0.75) FILTER (WHERE early) - quantile_cont(value, 0.25) FILTER (WHERE early)) / (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)), 6) + 0.0 AS ratio FROM r GROUP BY ALL""")
def calib_representativeness(spark, sf_dir):
    return profile.representativeness(readings(spark, sf_dir), 7).withColumn("ratio", rounded(F.col("ratio")))


@query(f"""WITH {ROUNDS}, r AS (SELECT device, x0, x4 FROM rounds WHERE x0 IS NOT NULL AND x4 IS NOT NULL),
k AS (SELECT device, rank() OVER (PARTITION BY device ORDER BY x0) + (count(*) OVER (PARTITION BY device, x0) - 1) / 2 AS rx, rank() OVER (PARTITION BY device ORDER BY x4) + (count(*) OVER (PARTITION BY device, x4) - 1) / 2 AS ry FROM r)
SELECT device, count(*) AS n, round(corr(rx, ry), 6) + 0.0 AS rho FROM k GROUP BY device""")
def spearman(spark, sf_dir):
    return profile.spearman(rounds(spark, sf_dir), "x0", "x4").withColumn("rho", rounded(F.col("rho")))


@query(f"WITH {READINGS} SELECT device, sec % 600 AS phase, count(*) AS n FROM readings GROUP BY ALL")
def phase_streams(spark, sf_dir):
    return profile.phases(readings(spark, sf_dir), 600)


STEP, PHASES, DENSE, LEAST_STREAM = 600, 6, 30, 4


@query(f"""WITH {COPIED}, st AS (SELECT DISTINCT device, sec // {STEP} AS step FROM copied), stamps AS (SELECT device, step, step // {86400 // STEP} AS day, step % {86400 // STEP} AS slot FROM st),
dense AS (SELECT device, day FROM stamps GROUP BY ALL HAVING count(*) > {DENSE}), own AS (SELECT s.*, step % {PHASES} AS phase FROM stamps s JOIN dense USING (device, day)),
streams AS (SELECT device, day, phase, count(*) AS n FROM own GROUP BY ALL HAVING count(*) >= {LEAST_STREAM}),
votes AS (SELECT o.device, o.day, phase, s.day - o.day AS shift, count(*) AS hits FROM own o JOIN stamps s ON s.device = o.device AND s.slot = o.slot AND s.day <> o.day AND abs(s.day - o.day) <= 90 GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY device, day, phase ORDER BY hits DESC, shift DESC) AS k FROM votes)
SELECT s.device, s.day, s.phase, s.n, b.shift, coalesce(b.hits, 0) AS hits FROM streams s LEFT JOIN best b ON b.device = s.device AND b.day = s.day AND b.phase = s.phase AND k = 1""")
def shifted_copies(spark, sf_dir):
    """The best shift in days of each phase's stream on dense days; some days are copies of those a week before."""
    return profile.shifted_copies(copied(spark, sf_dir), STEP, PHASES, DENSE, LEAST_STREAM)


@query(f"WITH {READINGS} SELECT sensor, round(value, 0) + 0.0 AS value, count(*) AS n FROM readings GROUP BY ALL")
def mic_distribution(spark, sf_dir):
    return profile.value_counts(readings(spark, sf_dir), 0)


