"""Queries of outliers, injection, windows and joins along time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Sliding
from ..functions.arrays import rounded
from ..operators import drift, inject, outliers, quality, windows
from .bindings import COPIED, PERIOD, READINGS, ROUNDS, START, copied, readings, rounds, table

W = Sliding(window=8 * PERIOD, slide=PERIOD, radius=60.0, k=3)
RADII, KS = [30.0, 60.0, 90.0], [2, 3]
DAY = 86400
Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def points(spark, sf_dir):
    return rounds(spark, sf_dir).where("NOT incomplete").select("device", "ts", "x0", "x1", "x2", "x3", "x4")


POINTS = f"""{ROUNDS}, pts AS (SELECT device, ts, x0, x1, x2, x3, x4 FROM rounds WHERE NOT incomplete),
pairs AS (SELECT a.device, a.ts, b.ts AS other, sqrt((a.x0-b.x0)^2+(a.x1-b.x1)^2+(a.x2-b.x2)^2+(a.x3-b.x3)^2+(a.x4-b.x4)^2) AS d FROM pts a JOIN pts b ON a.device = b.device AND a.ts <> b.ts AND abs(a.ts - b.ts) < {W.window}),
ends AS (SELECT device, ts, unnest(generate_series((ts // {W.slide} + 1) * {W.slide}, ((ts + {W.window}) // {W.slide}) * {W.slide}, {W.slide})) AS window_end FROM pts),
near AS (SELECT e.device, e.ts, e.window_end, count(p.other) AS neighbours FROM ends e LEFT JOIN pairs p ON e.device = p.device AND e.ts = p.ts AND p.d <= {W.radius} AND p.other >= e.window_end - {W.window} AND p.other < e.window_end GROUP BY ALL),
found AS (SELECT * FROM near WHERE neighbours < {W.k}),
rates AS (SELECT device, window_end, count(*) AS points, count(*) FILTER (WHERE neighbours < {W.k}) AS outliers, count(*) FILTER (WHERE neighbours < {W.k}) / count(*) AS rate FROM near GROUP BY ALL)"""


@query(f"WITH {POINTS} SELECT device, ts, count(*) AS neighbours FROM pairs WHERE d <= {W.radius} GROUP BY ALL")
def join_neighbours(spark, sf_dir):
    return outliers.neighbour_pairs(points(spark, sf_dir), W).groupBy("device", "ts").agg(F.count(F.lit(1)).alias("neighbours"))


@query(f"WITH {POINTS} SELECT device, ts, window_end, neighbours FROM found")
def sliding_3600_60(spark, sf_dir):
    return outliers.outliers(points(spark, sf_dir), W)


#: The default geometry: an hour's window every minute, over rounds brought to ten seconds each.
FULL = Sliding(radius=60.0)
FULL_SQL = f"""{ROUNDS}, pts AS (SELECT device, ts // {PERIOD} * 10 AS ts, x0, x1, x2, x3, x4 FROM rounds WHERE NOT incomplete),
ends AS (SELECT device, ts, unnest(generate_series((ts // {FULL.slide} + 1) * {FULL.slide}, ((ts + {FULL.window}) // {FULL.slide}) * {FULL.slide}, {FULL.slide})) AS window_end FROM pts),
pairs AS (SELECT a.device, a.ts, b.ts AS other FROM pts a JOIN pts b ON a.device = b.device AND a.ts <> b.ts AND abs(a.ts - b.ts) < {FULL.window} WHERE sqrt((a.x0-b.x0)^2+(a.x1-b.x1)^2+(a.x2-b.x2)^2+(a.x3-b.x3)^2+(a.x4-b.x4)^2) <= {FULL.radius}),
near AS (SELECT e.device, e.ts, e.window_end, count(p.other) AS neighbours FROM ends e LEFT JOIN pairs p ON e.device = p.device AND e.ts = p.ts AND p.other >= e.window_end - {FULL.window} AND p.other < e.window_end GROUP BY ALL)"""


@query(f"WITH {FULL_SQL} SELECT device, ts, window_end, neighbours FROM near WHERE neighbours < {FULL.k}")
def sliding_full(spark, sf_dir):
    return outliers.outliers(points(spark, sf_dir).withColumn("ts", F.floor(F.col("ts") / PERIOD) * 10), FULL)


#: Slides of four rounds; parameters that change within a slide on the 8th and the 19th day, and are not known before the 3rd.
SW = Sliding(window=16 * PERIOD, slide=4 * PERIOD, radius=60.0, k=3)
SWITCHES = [START + 2 * DAY + PERIOD, START + 8 * DAY + 2 * PERIOD, START + 19 * DAY + 3 * PERIOD]
_SW_OLD = SW.window - SW.slide
SWITCHED = f"""{ROUNDS}, raw AS (SELECT device, ts, x0, x1, x2, x3, x4 FROM rounds WHERE NOT incomplete),
pts AS (SELECT *, CASE WHEN ts >= {SWITCHES[2]} THEN 3 WHEN ts >= {SWITCHES[1]} THEN 2 WHEN ts >= {SWITCHES[0]} THEN 1 END AS version FROM raw),
whole AS (SELECT device, ts, version, coalesce(version, first_value(version IGNORE NULLS) OVER (PARTITION BY device ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS own, x0, x1, x2, x3, x4 FROM pts),
turns AS (SELECT device, own, coalesce(min(ts) FILTER (WHERE version IS NOT NULL), min(ts)) AS start FROM whole GROUP BY device, own),
eras AS (SELECT *, row_number() OVER w = 1 AS first, (start // {SW.slide} + 1) * {SW.slide} AS opens, lead((start // {SW.slide} + 1) * {SW.slide}) OVER w AS closes FROM turns WINDOW w AS (PARTITION BY device ORDER BY start)),
pop AS (SELECT device, own, ts, true AS judged, x0 * (1 + 0.5 * coalesce(version - 1, 0)) AS x0, x1, x2, x3, x4 FROM whole
        UNION ALL SELECT r.device, e.own, r.ts, false, x0 * (1 + 0.5 * (e.own - 1)), x1, x2, x3, x4 FROM raw r JOIN eras e ON r.device = e.device AND NOT e.first AND r.ts < e.start AND r.ts >= e.opens - {SW.window} AND r.ts >= e.start - {_SW_OLD}),
live AS (SELECT p.device, p.own, p.ts, w AS window_end, p.x0, p.x1, p.x2, p.x3, p.x4, p.judged, e.first, e.opens
         FROM (SELECT *, unnest(generate_series((ts // {SW.slide} + 1) * {SW.slide}, ((ts + {SW.window}) // {SW.slide}) * {SW.slide}, {SW.slide})) AS w FROM pop) p JOIN eras e ON p.device = e.device AND p.own IS NOT DISTINCT FROM e.own WHERE e.closes IS NULL OR w < e.closes),
near AS (SELECT a.device, a.ts, a.window_end, a.own, a.first, a.opens, count(b.ts) AS neighbours FROM live a LEFT JOIN live b ON a.device = b.device AND a.own IS NOT DISTINCT FROM b.own AND a.window_end = b.window_end AND a.ts <> b.ts
           AND sqrt((a.x0-b.x0)^2+(a.x1-b.x1)^2+(a.x2-b.x2)^2+(a.x3-b.x3)^2+(a.x4-b.x4)^2) <= {SW.radius} WHERE a.judged GROUP BY ALL)"""


@query(f"WITH {SWITCHED} SELECT device, ts, window_end, neighbours, CASE WHEN NOT first OR window_end >= opens THEN CAST(own AS INTEGER) END AS version FROM near WHERE neighbours < {SW.k}")
def mcod_version_switch(spark, sf_dir):
    p = points(spark, sf_dir)
    first, second, third = (F.col("ts") >= t for t in SWITCHES)
    p = p.withColumn("version", F.when(third, 3).when(second, 2).when(first, 1))
    scaled = lambda v: F.col("x0") * (1 + 0.5 * F.coalesce(v - 1, F.lit(0)))
    again = p.select("device", F.explode(F.array(F.struct(F.lit(2).alias("version"), F.lit(SWITCHES[1]).alias("at")), F.struct(F.lit(3).alias("version"), F.lit(SWITCHES[2]).alias("at")))).alias("v"), "ts", *outliers.DIMENSIONS)
    start = p.where("version > 1").groupBy("device", "version").agg(F.min("ts").alias("start"))
    again = again.select("device", "v.version", "ts", *outliers.DIMENSIONS).join(start, ["device", "version"]).where((F.col("ts") < F.col("start")) & (F.col("ts") >= F.col("start") - _SW_OLD)).drop("start")
    return outliers.switched_outliers(p.withColumn("x0", scaled(F.col("version"))), again.withColumn("x0", scaled(F.col("version"))), SW)


@query(f"WITH {POINTS} SELECT device, ts, window_end FROM found")
def mcod_slide(spark, sf_dir):
    return outliers.clustered_outliers(points(spark, sf_dir), W).select("device", "ts", "window_end")


@query(f"WITH {POINTS} SELECT device, ts, window_end, neighbours FROM found WHERE ts >= window_end - {W.slide} AND ts < window_end")
def score_filter_slide(spark, sf_dir):
    return outliers.arrival_outliers(outliers.outliers(points(spark, sf_dir), W), W)


@query(f"WITH {POINTS} SELECT device, window_end, points, outliers, round(rate, 6) + 0.0 AS rate FROM rates")
def m2_rates(spark, sf_dir):
    p = points(spark, sf_dir)
    return outliers.window_rates(p, outliers.outliers(p, W), W).withColumn("rate", rounded(F.col("rate")))


@query(f"""WITH {POINTS} SELECT device, count(*) AS slides, round(avg(points), 6) AS mean_points, round(avg(rate), 6) + 0.0 AS mean_rate, round(avg(CASE WHEN outliers = 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS zero_share, avg(rate) BETWEEN 0.1 AND 0.9 AS in_band FROM rates GROUP BY device""")
def device_baseline(spark, sf_dir):
    p = points(spark, sf_dir)
    d = outliers.device_rates(outliers.window_rates(p, outliers.outliers(p, W), W), (0.1, 0.9))
    return d.select("device", "slides", "in_band", *[rounded(F.col(c)).alias(c) for c in ("mean_points", "mean_rate", "zero_share")])


PROBE = f"""{POINTS}, grid AS (SELECT * FROM (SELECT unnest({RADII}) AS radius), (SELECT unnest({KS}) AS k)),
cnt AS (SELECT e.device, e.ts, e.window_end, radius, k, count(p.other) AS n FROM ends e CROSS JOIN grid LEFT JOIN pairs p ON e.device = p.device AND e.ts = p.ts AND p.d <= radius AND p.other >= e.window_end - {W.window} AND p.other < e.window_end GROUP BY ALL),
win AS (SELECT radius, k, device, window_end, count(*) AS points, avg(CASE WHEN n < k THEN 1.0 ELSE 0.0 END) AS rate FROM cnt GROUP BY ALL),
probe AS (SELECT CAST(radius AS DOUBLE) AS radius, CAST(k AS INTEGER) AS k, device, count(*) AS slides, round(avg(points), 6) AS mean_points, round(avg(rate), 6) + 0.0 AS mean_rate, round(avg(CASE WHEN rate = 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS zero_share FROM win GROUP BY ALL)"""


def probed(spark, sf_dir):
    p = outliers.probe(points(spark, sf_dir), W, RADII, KS)
    return p.select("radius", "k", "device", "slides", *[rounded(F.col(c)).alias(c) for c in ("mean_points", "mean_rate", "zero_share")])


@query(f"WITH {PROBE} SELECT * FROM probe")
def probe_grid(spark, sf_dir):
    return probed(spark, sf_dir)


@query(f"WITH {PROBE} SELECT device, k, radius, mean_rate FROM (SELECT *, row_number() OVER (PARTITION BY device, k ORDER BY abs(mean_rate - 0.5), radius) AS n FROM probe WHERE mean_rate BETWEEN 0.1 AND 0.9) WHERE n = 1")
def pick_r(spark, sf_dir):
    return outliers.pick_radius(probed(spark, sf_dir), 0.1, 0.9)


@query(f"WITH {POINTS} SELECT CAST(ts % {DAY} // 3600 AS INTEGER) AS hour, count(*) AS outliers FROM found WHERE ts >= window_end - {W.slide} GROUP BY ALL")
def outlier_hour_hist(spark, sf_dir):
    found = outliers.arrival_outliers(outliers.outliers(points(spark, sf_dir), W), W)
    return found.groupBy(F.hour(F.timestamp_seconds("ts")).alias("hour")).agg(F.count(F.lit(1)).alias("outliers"))


@query("""WITH v AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT a.label, a.vec_id, count(b.vec_id) AS neighbours FROM v a LEFT JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_distance(a.e, b.e) <= 1.25 GROUP BY ALL)
SELECT label, vec_id, neighbours FROM n WHERE neighbours < 3""")
def vector_outliers(spark, sf_dir):
    return outliers.vector_outliers(table(spark, sf_dir, "embeddings"), 1.25, 3)


@query(f"""WITH {POINTS}, b AS (SELECT device, window_end, outliers, points FROM rates), a AS (SELECT device, (ts // {DAY}) * {DAY} AS bin, count(*) AS admitted FROM pts GROUP BY ALL),
o AS (SELECT device, (ts // {DAY}) * {DAY} AS bin, count(*) AS outliers FROM found WHERE ts >= window_end - {W.slide} GROUP BY ALL)
SELECT device, bin, coalesce(admitted, 0) AS admitted, coalesce(outliers, 0) AS outliers, round(coalesce(outliers, 0) / admitted, 6) + 0.0 AS rate FROM a FULL JOIN o USING (device, bin)""")
def admit_bins(spark, sf_dir):
    return bins(spark, sf_dir).select("device", F.col("ts").alias("bin"), "admitted", "outliers", rounded(F.col("outliers") / F.col("admitted")).alias("rate"))


def bins(spark, sf_dir, width=DAY):
    p = points(spark, sf_dir)
    at = (F.floor(F.col("ts") / width) * width).alias("ts")
    a = p.groupBy("device", at).agg(F.count(F.lit(1)).alias("admitted"))
    o = outliers.arrival_outliers(outliers.outliers(p, W), W).groupBy("device", at).agg(F.count(F.lit(1)).alias("outliers"))
    return a.join(o, ["device", "ts"], "full").select("device", "ts", F.coalesce("admitted", F.lit(0)).alias("admitted"), F.coalesce("outliers", F.lit(0)).alias("outliers"))


SPECS = f"1:view:{START + 5 * DAY}:{2 * DAY}:step:500;1:view:{START + 6 * DAY}:{2 * DAY}:ramp:100;3:click:{START + 10 * DAY}:{DAY}:stuck:0;5:purchase:{START + 20 * DAY}:{3 * DAY}:spike:250"
SPEC_ROWS = ", ".join(f"({n}, {d}, '{s}', {a}, {b}, '{k}', {m})" for n, d, s, a, b, k, m in inject.parse_specs(SPECS))
INJECTED = f"""{READINGS}, specs(spec, device, sensor, start, stop, kind, magnitude) AS (VALUES {SPEC_ROWS}),
held AS (SELECT spec, arg_min(value, seq + sec * 100000000) AS held FROM readings r JOIN specs s ON r.device = s.device AND r.sensor = s.sensor AND sec >= start AND sec < stop GROUP BY spec),
changed AS (
  SELECT seq, r.device, r.ts, r.sec, r.sensor, r.value AS original,
    CASE WHEN max(CASE WHEN kind = 'stuck' THEN held.held END) IS NOT NULL THEN max(CASE WHEN kind = 'stuck' THEN held.held END)
         ELSE r.value + coalesce(sum(CASE WHEN kind IN ('spike', 'step') THEN magnitude WHEN kind = 'ramp' THEN magnitude * (sec - start) / (stop - start) END), 0) END AS value
  FROM readings r LEFT JOIN specs s ON r.device = s.device AND r.sensor = s.sensor AND sec >= start AND sec < stop LEFT JOIN held USING (spec) GROUP BY seq, r.device, r.ts, r.sec, r.sensor, r.value)"""


def specs(spark):
    return spark.createDataFrame(inject.parse_specs(SPECS), inject.SPEC)


def injected(spark, sf_dir):
    return inject.inject(readings(spark, sf_dir), specs(spark))


@query(f"WITH {INJECTED} SELECT seq, device, sensor, original, round(value, 6) AS value FROM changed WHERE value <> original")
def src_inject(spark, sf_dir):
    return injected(spark, sf_dir).where("value <> original").select("seq", "device", "sensor", "original", rounded(F.col("value")).alias("value"))


@query(f"""WITH {INJECTED}, alarms AS (SELECT device, sec AS ts FROM changed WHERE value > 300),
rate AS (SELECT device, count(*) FILTER (WHERE value > 300) / count(*) AS rate FROM changed WHERE sec < {START + 5 * DAY} GROUP BY device)
SELECT spec, CAST(s.device AS BIGINT) AS device, count(a.ts) > 0 AS detected, count(a.ts) AS hits, min(a.ts) - s.start AS delay, round(1 - pow(1 - coalesce(max(rate), 0), ceil((s.stop - s.start) / {PERIOD})), 6) + 0.0 AS chance
FROM specs s LEFT JOIN alarms a ON a.device = s.device AND a.ts >= s.start AND a.ts < s.stop LEFT JOIN rate r ON r.device = s.device GROUP BY spec, s.device, s.start, s.stop""")
def recall_table(spark, sf_dir):
    r = injected(spark, sf_dir)
    alarms = r.where("value > 300").select("device", F.col("at").alias("ts"))
    background = r.where(F.col("at") < START + 5 * DAY).groupBy("device").agg((F.count_if(F.col("value") > 300) / F.count(F.lit(1))).alias("rate")).withColumn("period", F.lit(PERIOD))
    return inject.recall(specs(spark), alarms, background).withColumn("chance", rounded(F.col("chance")))


L = 6
WINDOWS = f"""{POINTS}, num AS (SELECT *, (row_number() OVER (PARTITION BY device ORDER BY ts) - 1) // {L} AS win FROM pts),
cw AS (SELECT device, CAST(win AS BIGINT) AS win, min(ts) AS start, max(ts) AS stop, sum(x0) AS total FROM num GROUP BY ALL HAVING count(*) = {L})"""


@query(f"WITH {WINDOWS} SELECT device, win AS window, start, stop, round(total, 6) AS total FROM cw")
def count_window_60(spark, sf_dir):
    w = windows.count_windows(points(spark, sf_dir), L)
    return w.select("device", "window", "start", "stop", rounded(F.aggregate("x", F.lit(0.0), lambda s, r: s + r[0])).alias("total"))


@query(f"""WITH {WINDOWS}, bad AS (SELECT DISTINCT device, ts FROM found WHERE ts >= window_end - {W.slide}),
hit AS (SELECT DISTINCT c.device, c.win FROM cw c JOIN bad b ON b.device = c.device AND b.ts BETWEEN c.start AND c.stop),
s AS (SELECT c.device, CASE WHEN (c.win + 1) * {L} <= 7 * 2 THEN 'train' WHEN (c.win + 1) * {L} <= 9 * 2 THEN 'early' WHEN (c.win + 1) * {L} <= 16 * 2 THEN 'calibrate' ELSE 'online' END AS part, h.win IS NOT NULL AS hit FROM cw c LEFT JOIN hit h ON h.device = c.device AND h.win = c.win)
SELECT device, part, count(*) AS windows, count(*) FILTER (WHERE hit) AS with_outliers FROM s WHERE NOT (part = 'train' AND hit) GROUP BY ALL""")
def split_by_count(spark, sf_dir):
    """Windows by part, training windows with an outlier left out."""
    p = points(spark, sf_dir)
    bad = outliers.arrival_outliers(outliers.outliers(p, W), W).select("device", "ts").distinct().withColumn("outlier", F.lit(True))
    w = windows.count_windows(p.join(bad, ["device", "ts"], "left").withColumn("outlier", F.coalesce("outlier", F.lit(False))), L, "outlier")
    w = windows.clean_training(windows.split_windows(w, 2, L, (7, 9, 16)), "outlier")
    return w.groupBy("device", "part").agg(F.count(F.lit(1)).alias("windows"), F.count_if("outlier").alias("with_outliers"))


@query(f"""WITH {POINTS}, f AS (SELECT device, ts, coalesce(ts - lag(ts) OVER w >= {2 * PERIOD}, false) AS after_outage FROM pts WINDOW w AS (PARTITION BY device ORDER BY ts))
SELECT device, ts, after_outage, coalesce(ts - max(CASE WHEN after_outage THEN ts END) OVER (PARTITION BY device ORDER BY ts) <= {PERIOD}, false) AS within_surge FROM f""")
def outage_surge_flags(spark, sf_dir):
    return windows.outage_flags(points(spark, sf_dir), 2 * PERIOD, PERIOD)


MEDIANS = f"""{POINTS}, med AS (SELECT device, ts, x0, CASE WHEN count(x0) OVER w = 6 THEN quantile_cont(x0, 0.5) OVER w END AS median FROM pts WINDOW w AS (PARTITION BY device ORDER BY ts ROWS 5 PRECEDING))"""


@query(f"WITH {MEDIANS} SELECT device, ts, round(median, 6) AS median FROM med")
def moving_median_6(spark, sf_dir):
    return windows.moving_median(points(spark, sf_dir), "x0", 6).select("device", "ts", rounded(F.col("median")).alias("median"))


@query(f"""WITH {POINTS}, g AS (SELECT device, ts, count(*) OVER w = 3 AND max(x0) OVER w <= 80 AS good FROM pts WINDOW w AS (PARTITION BY device ORDER BY ts ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) SELECT device, min(ts) AS ts FROM g WHERE good GROUP BY device""")
def first_settled(spark, sf_dir):
    return windows.first_settled(points(spark, sf_dir), "x0", 80.0, 3)


@query(f"""WITH {POINTS}, g AS (SELECT device, ts, x0, lag(ts) OVER w AS before, ts - lag(ts) OVER w AS gap FROM pts WINDOW w AS (PARTITION BY device ORDER BY ts)),
l AS (SELECT device, before AS gap_start, ts AS gap_end FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY gap DESC, ts) AS n FROM g WHERE gap IS NOT NULL) WHERE n = 1),
b AS (SELECT device, quantile_cont(x0, 0.5) AS base FROM pts GROUP BY device),
p AS (SELECT l.*, base, x0 AS peak, ts AS peak_ts FROM (SELECT pts.device, x0, ts, row_number() OVER (PARTITION BY pts.device ORDER BY x0 DESC, ts) AS n FROM pts JOIN l USING (device) WHERE ts >= gap_end AND ts < gap_end + {4 * DAY}) t JOIN l USING (device) JOIN b USING (device) WHERE n = 1)
SELECT p.device, gap_start, gap_end, peak, peak_ts, (SELECT min(ts) FROM pts WHERE pts.device = p.device AND ts >= peak_ts AND x0 <= 1.2 * base) - peak_ts AS decay FROM p""")
def recovery_surge(spark, sf_dir):
    return windows.recovery_surge(points(spark, sf_dir), "x0", 4 * DAY, 1.2)


@query(f"""WITH {READINGS}, l AS (SELECT device, sec FROM readings WHERE sensor = 'purchase'), r AS (SELECT DISTINCT device, sec FROM readings WHERE sensor = 'click'),
j AS (SELECT l.device, l.sec, b.sec AS back, a.sec AS ahead FROM l ASOF LEFT JOIN r b ON l.device = b.device AND l.sec >= b.sec ASOF LEFT JOIN r a ON l.device = a.device AND l.sec <= a.sec),
n AS (SELECT device, sec, CASE WHEN back IS NOT NULL AND (ahead IS NULL OR sec - back <= ahead - sec) THEN back ELSE ahead END AS ref FROM j)
SELECT device, sec AS "at", CASE WHEN abs(sec - ref) <= 7200 THEN ref END AS ref, CASE WHEN abs(sec - ref) <= 7200 THEN sec - ref END AS "offset" FROM n""")
def join_nearest_clock(spark, sf_dir):
    r = readings(spark, sf_dir)
    return windows.nearest(r.where("sensor = 'purchase'"), r.where("sensor = 'click'"), 7200)


@query(f"""WITH {READINGS}, f AS (SELECT device, ts, sensor, arg_min(value, seq) AS value FROM readings GROUP BY ALL)
SELECT l.device, l.sensor, count(*) AS later, count(e.value) AS matched, count(*) FILTER (WHERE l.value = e.value) AS same, round(corr(l.value, e.value), 6) + 0.0 AS corr
FROM f l LEFT JOIN f e ON e.ts < {START + 15 * DAY} AND e.device = l.device AND e.sensor = l.sensor AND e.ts + {15 * DAY} = l.ts WHERE l.ts >= {START + 15 * DAY} GROUP BY ALL""")
def join_shift_copy(spark, sf_dir):
    return windows.shifted_copies(readings(spark, sf_dir), START + 15 * DAY, 15 * DAY).withColumn("corr", rounded(F.col("corr")))


def segments(spark):
    return specs(spark).select(F.col("spec").alias("segment"), "device", "start", "stop")


@query(f"WITH {INJECTED} SELECT spec AS segment, count(c.seq) AS events FROM specs s LEFT JOIN changed c ON c.device = s.device AND c.value > 300 AND c.sec BETWEEN s.start AND s.stop + 21600 GROUP BY spec")
def join_attribution(spark, sf_dir):
    events = injected(spark, sf_dir).where("value > 300").select("device", F.col("at").alias("ts"))
    return windows.intervals_of(events, segments(spark), 21_600)


@query(f"""WITH {WINDOWS}, g AS (SELECT device, lag(ts) OVER (PARTITION BY device ORDER BY ts) AS g_start, ts AS g_stop FROM pts)
SELECT c.device, c.win AS window, count(*) AS gaps FROM cw c JOIN g ON g.device = c.device AND g_stop - g_start > {PERIOD} AND g_start < c.stop AND g_stop > c.start GROUP BY ALL""")
def join_gap_window(spark, sf_dir):
    p = points(spark, sf_dir)
    return windows.overlapping(windows.count_windows(p, L), quality.gaps(p, PERIOD))


@query(f"""WITH {COPIED}, c AS (SELECT device, sec // {DAY} AS day, sensor, count(*) AS n FROM copied GROUP BY ALL), v AS (SELECT device, day, string_agg(sensor || '=' || n, ',' ORDER BY sensor) AS v FROM c GROUP BY ALL),
p AS (SELECT a.device, a.day, b.day AS other FROM v a JOIN v b ON a.device = b.device AND a.v = b.v AND b.day > a.day)
SELECT device, day, other, day - row_number() OVER (PARTITION BY device, other - day ORDER BY day) AS run FROM p""")
def date_run_merge(spark, sf_dir):
    return windows.same_days(copied(spark, sf_dir), 5)


#: Channels that count as detection here; the other two as quality.
DETECTION = ("click", "error", "view")


@query(f"WITH {READINGS} SELECT DISTINCT device, ts FROM readings r WHERE NOT EXISTS (SELECT 1 FROM readings k WHERE k.device = r.device AND k.ts = r.ts AND k.sensor IN {DETECTION})")
def anti_empty_stamps(spark, sf_dir):
    r = readings(spark, sf_dir).select("device", "ts", "sensor")
    return r.select("device", "ts").distinct().join(r.where(F.col("sensor").isin(*DETECTION)).select("device", "ts").distinct(), ["device", "ts"], "left_anti")


@query(f"""WITH {INJECTED}, l AS (SELECT seq, device, value FROM changed), r AS (SELECT seq, device, original FROM changed)
SELECT 'left' AS side, count(*) AS rows FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) UNION ALL SELECT 'right', count(*) FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)""")
def set_compare(spark, sf_dir):
    r = injected(spark, sf_dir)
    return windows.exact_difference(r.select("seq", "device", "value"), r.select("seq", "device", F.col("original").alias("value")))


@query(f"WITH {READINGS} SELECT count(*) AS kept, CAST(sum(seq) AS BIGINT) AS total FROM readings WHERE sec BETWEEN {START + 3 * DAY} AND {START + 4 * DAY}")
def src_time_slice(spark, sf_dir):
    return readings(spark, sf_dir).where(F.col("at").between(START + 3 * DAY, START + 4 * DAY)).agg(F.count(F.lit(1)).alias("kept"), F.sum("seq").alias("total"))


@query(f"WITH {READINGS}, f AS (SELECT device, sensor, arg_min(value, seq) AS first_value, count(*) AS n, count(*) - count(DISTINCT sec) AS ties, min(sec) AS first_at, max(sec) AS last_at FROM readings GROUP BY ALL) SELECT device, sensor, first_value, n, ties, first_at, last_at FROM f")
def replay_verify(spark, sf_dir):
    r = readings(spark, sf_dir).groupBy("device", "sensor")
    return r.agg(F.min_by("value", "seq").alias("first_value"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count_distinct("at")).alias("ties"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def elements(spark, sf_dir):
    """Elements for drift detection: a device's readings in order, with the injected faults in them."""
    return injected(spark, sf_dir).select("device", F.col("seq").alias("ts"), "value", F.lit(1).alias("generation"))


@query()
def optwin_update(spark, sf_dir):
    return drift.detector_counters(elements(spark, sf_dir))


@query()
def drift_gate(spark, sf_dir):
    return drift.drift_events(elements(spark, sf_dir), patience=36)


@query()
def burst(spark, sf_dir):
    e = elements(spark, sf_dir).select("device", (F.floor(F.col("ts") / 40) * 600).alias("ts"), "value")
    b = e.groupBy("device", "ts").agg(F.count(F.lit(1)).alias("admitted"), F.count_if(F.col("value") > 150).alias("outliers"))
    return drift.bursts(b)


@query()
def hddm_w(spark, sf_dir):
    return drift.hoeffding_events(elements(spark, sf_dir).select("device", "ts", (F.col("value") > 30).cast("int").alias("flag")))


