"""Queries of reconciliation, comparison and summary tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import EVENTS, Fleet
from ..functions.arrays import device_of, rounded
from ..operators import drift, ingest, outliers, review, score
from .basic import LINES, lines
from .bindings import PERIOD, READINGS, ROUNDS, readings, rounds
from .decisions import COMMAND_ROWS, STATES, commands_of, confirmed, context_windows, scored, states, undone, upper
from .shared import kept
from .windowed import DAY, INJECTED, POINTS, PROBE, START, W, elements, injected, points, probed, segments

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


CENSORED = Fleet(sensors=EVENTS.sensors, quality=(), period=PERIOD, censored=65536.0)


@query(f"WITH {ROUNDS} SELECT device, count(*) FILTER (WHERE x4 > 150) AS censored, count(*) AS rounds FROM rounds GROUP BY device")
def flag_censored(spark, sf_dir):
    r = readings(spark, sf_dir).withColumn("value", F.when((F.col("sensor") == "view") & (F.col("value") > 150), 65536.0).otherwise(F.col("value")))
    return ingest.assemble_rounds(r, CENSORED).groupBy("device").agg(F.count_if("censored").alias("censored"), F.count(F.lit(1)).alias("rounds"))


def marked_lines(spark, sf_dir):
    """Raw lines in the default fleet's names: censored Light, RSSI without a reading, and a sensor it does not know."""
    seq = F.col("seq")
    sensor = F.when(seq % 5 == 0, "Light").when(seq % 5 == 1, "RSSI").when(seq % 5 == 2, "Noise").otherwise("Temperature")
    value = F.when(seq % 15 == 0, "65536").when(seq % 10 == 1, "0").otherwise(F.format_string("%.6f", F.col("value") + 1))
    return readings(spark, sf_dir).select("seq", F.concat_ws(",", F.col("at").cast("string"), F.col("device").cast("string"), sensor, value).alias("value"))


@query("""SELECT count(*) AS lines_in, CAST(0 AS BIGINT) AS malformed, CAST(0 AS BIGINT) AS malformed_no_device, count(*) FILTER (WHERE event_id % 5 = 2) AS unknown_sensor,
count(*) FILTER (WHERE event_id % 15 = 0) AS censored, count(*) FILTER (WHERE event_id % 10 = 1) AS rssi_sentinel FROM events""")
def flag_rssi_sentinel(spark, sf_dir):
    return ingest.parse_counters(ingest.parse_lines(marked_lines(spark, sf_dir), Fleet()), Fleet())


@query(f"WITH {READINGS} SELECT CAST(device AS VARCHAR) AS device, count(*) AS n, count(DISTINCT seq % 3) AS keys FROM readings GROUP BY device")
def surrogate_keys(spark, sf_dir):
    """A device's rows under three keys of its own, brought together again."""
    r = readings(spark, sf_dir).withColumn("key", F.concat_ws("#", F.col("device").cast("string"), (F.col("seq") % 3).cast("string")))
    return r.groupBy(device_of(F.col("key")).alias("device")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys"))


@query(f"""WITH {LINES} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS rows_bad_time, count(*) FILTER (WHERE device = '' OR seq % 97 = 0) AS rows_bad_key, count(*) FILTER (WHERE NOT good) AS rows_bad_value FROM parsed""")
def drop_bad_rows(spark, sf_dir):
    return review.bad_rows(lines(spark, sf_dir))


@query(f"""WITH {READINGS} SELECT strftime(to_timestamp(sec) AT TIME ZONE 'UTC', '%Y-%m') AS month, device, sensor, count(*) AS nans FROM readings WHERE seq % 50 = 0 GROUP BY ALL""")
def nan_counts(spark, sf_dir):
    r = readings(spark, sf_dir).withColumn("value", F.when(F.col("seq") % 50 == 0, float("nan")).otherwise(F.col("value")))
    return review.nan_counts(r)


@query(f"""WITH {READINGS} SELECT seq, seq % 7 <> 0 AND seq % 11 <> 0 AS good, CASE WHEN seq % 11 = 0 THEN NULL ELSE CAST(device AS VARCHAR) END AS device, CASE WHEN seq % 11 = 0 OR seq % 7 = 0 THEN NULL ELSE CAST(device % 3 AS INTEGER) END AS level, CASE WHEN seq % 11 = 0 THEN NULL ELSE sec END AS effective_at FROM readings""")
def parse_command(spark, sf_dir):
    r = readings(spark, sf_dir)
    level = F.when(F.col("seq") % 7 != 0, F.col("device") % 3)
    body = F.to_json(F.struct(F.col("device").cast("string").alias("device"), level.alias("level"), F.col("at").alias("effectiveAt"), F.col("at").alias("decidedAt"), "seq"))
    return review.parse_commands(r.select("seq", F.when(F.col("seq") % 11 == 0, "{not json").otherwise(body).alias("value")))


@query(f"WITH {POINTS} SELECT p.device, p.ts, (p.ts // {W.slide} + 1) * {W.slide} AS window_end, f.ts IS NOT NULL AS outlier FROM pts p LEFT JOIN found f ON f.device = p.device AND f.ts = p.ts AND f.window_end = (p.ts // {W.slide} + 1) * {W.slide}")
def join_round_outlier(spark, sf_dir):
    p = points(spark, sf_dir)
    return review.annotate(p, outliers.outliers(p, W), W)


@query(f"""WITH {POINTS}, {STATES.strip()}, mods AS (SELECT DISTINCT device FROM states) SELECT kind, count(*) AS n, count(*) FILTER (WHERE flag) AS flagged, round(sum(score), 4) + 0.0 AS score, count(DISTINCT word) AS words FROM (
SELECT 'round' AS kind, incomplete AS flag, NULL AS score, NULL AS word FROM rounds UNION ALL SELECT 'context', x4 > 150, x4, NULL FROM pts UNION ALL SELECT 'event', true, NULL, NULL FROM found
UNION ALL SELECT 'drift', true, d, transition FROM states WHERE transition IS NOT NULL UNION ALL SELECT 'record', evaluable, d, CAST(channel AS VARCHAR) FROM states
UNION ALL SELECT 'model', NULL, NULL, 'online' FROM mods UNION ALL SELECT 'model', NULL, NULL, 'switch' FROM mods WHERE device % 5 <> 4 AND device % 2 = 0
UNION ALL SELECT 'command', level > 0, NULL, CAST(level AS VARCHAR) FROM (SELECT DISTINCT device FROM rounds) CROSS JOIN (VALUES {COMMAND_ROWS}) c(level, e, d, seq)) GROUP BY kind""")
def union_7(spark, sf_dir):
    r, p = rounds(spark, sf_dir), points(spark, sf_dir)
    context = p.select("device", "ts", F.col("x4").alias("score"), (F.col("x4") > 150).alias("above"))
    s = kept(states(spark, sf_dir), "states")
    u = review.tagged_union(r, context, outliers.outliers(p, W), s, confirmed(s)[1], commands_of(r))
    return u.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("flag").alias("flagged"), rounded(F.sum("score"), 4).alias("score"), F.count_distinct("word").alias("words"))


@query(f"""WITH {ROUNDS} SELECT CAST(channel AS INTEGER) AS channel, count(*) AS cells, count(x) AS equal, CAST(0 AS BIGINT) AS off, count(*) - count(x) AS absent FROM (SELECT unnest([0, 1, 2, 3, 4]) AS channel, unnest([x0, x1, x2, x3, x4]) AS x FROM rounds) GROUP BY channel""")
def m1_reconcile(spark, sf_dir):
    return review.reconcile(rounds(spark, sf_dir), readings(spark, sf_dir), EVENTS.sensors, 1e-9)


@query(f"WITH {READINGS} SELECT seq, device, ts, sensor, value FROM readings ORDER BY (CAST(seq AS HUGEINT) * 2654435761) % 4294967296, seq LIMIT 200")
def sample_random(spark, sf_dir):
    return review.sampled(readings(spark, sf_dir), "seq", 200).select("seq", "device", "ts", "sensor", "value")


@query(f"WITH {READINGS} SELECT device, sensor, CAST({START} AS BIGINT) AS start, CAST({START + DAY} AS BIGINT) AS stop, 'step' AS kind, round((quantile_cont(value, 0.9) - quantile_cont(value, 0.1)) * 0.5, 6) AS magnitude FROM readings GROUP BY device, sensor")
def injection_plan(spark, sf_dir):
    return review.plan_injections(readings(spark, sf_dir), F.lit(True), START, DAY, 0.5).withColumn("magnitude", rounded(F.col("magnitude")))


@query(f"WITH {READINGS} SELECT device, sensor, count(*) FILTER (WHERE floor(value / 10) = 0) AS zero, count(*) FILTER (WHERE floor(value / 10) <> 0) AS other FROM readings GROUP BY ALL")
def accel_zero(spark, sf_dir):
    return review.zero_share(readings(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 10)))


@query(f"WITH {ROUNDS} SELECT device, round(sum(CASE WHEN device % 8 = 6 THEN 0.0 ELSE x4 END), 4) + 0.0 AS total FROM rounds GROUP BY device")
def zero_g_light(spark, sf_dir):
    return review.model_input(rounds(spark, sf_dir), F.col("device") % 8 == 6).groupBy("device").agg(rounded(F.sum("x4"), 4).alias("total"))


_ERRORS = ", ".join(f"((x{c}-50)/10)^2 AS e{c}" for c in range(5))
_CALIBRATED = ", ".join(f"round(covar_pop(e{i}, e{j}){' + 1e-4' if i == j else ''}, 3) + 0.0 AS c{i}{j}" for i in range(5) for j in range(i, 5))


@query(f"""WITH {POINTS}, e AS (SELECT device, {_ERRORS} FROM pts), t AS (SELECT *, (e0 + e1 + e2 + e3 + e4) / 5 AS e FROM e)
SELECT device, count(*) AS n, round(quantile_cont(e, 0.5), 4) + 0.0 AS median, round(greatest(quantile_cont(e, 0.75) - quantile_cont(e, 0.25), 1e-12), 4) + 0.0 AS iqr, {_CALIBRATED}, true AS inverted FROM t GROUP BY device""")
def m3_calibrate(spark, sf_dir):
    e = points(spark, sf_dir).select("device", *[(((F.col(f"x{c}") - 50) / 10) * ((F.col(f"x{c}") - 50) / 10)).alias(f"e{c}") for c in range(5)])
    e = e.withColumn("wmse", (F.col("e0") + F.col("e1") + F.col("e2") + F.col("e3") + F.col("e4")) / 5)
    return score.calibrate(e).select("device", "n", rounded(F.col("median"), 4).alias("median"), rounded(F.col("iqr"), 4).alias("iqr"), *upper("covariance", 3), undone("covariance", "inverse").alias("inverted"))


@query(f"""WITH {PROBE}, l AS (SELECT device, k, mean_rate FROM probe WHERE radius = 30), r AS (SELECT device, k, mean_rate FROM probe WHERE radius = 60 AND device % 8 <> 3)
SELECT count(*) FILTER (WHERE l.device IS NOT NULL AND r.device IS NOT NULL AND abs(l.mean_rate - r.mean_rate) <= 0.01) AS same, count(*) FILTER (WHERE l.device IS NOT NULL AND r.device IS NOT NULL AND abs(l.mean_rate - r.mean_rate) > 0.01) AS different,
count(*) FILTER (WHERE r.device IS NULL) AS only_left, count(*) FILTER (WHERE l.device IS NULL) AS only_right FROM l FULL JOIN r ON l.device = r.device AND l.k = r.k""")
def probe_compare(spark, sf_dir):
    p = probed(spark, sf_dir)
    return review.compare_tables(p.where("radius = 30"), p.where("radius = 60 AND device % 8 <> 3"), ["device", "k"], "mean_rate", 0.01)


CLEARED = f"""{POINTS}, era AS (SELECT *, sum(cold) OVER (PARTITION BY device ORDER BY ts) AS era FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY device ORDER BY ts) > {2 * PERIOD} THEN 1 ELSE 0 END AS cold FROM pts)),
opens AS (SELECT device, era, (min(ts) // {W.slide}) * {W.slide} AS opens FROM era GROUP BY ALL), spans AS (SELECT *, lead(opens) OVER (PARTITION BY device ORDER BY era) AS closes FROM opens),
ee AS (SELECT e.device, e.ts, e.window_end, a.era FROM ends e JOIN era a ON a.device = e.device AND a.ts = e.ts),
nn AS (SELECT e.device, e.era, e.ts, e.window_end, count(b.ts) AS neighbours FROM ee e LEFT JOIN era b ON b.device = e.device AND b.era = e.era AND b.ts <> e.ts AND b.ts >= e.window_end - {W.window} AND b.ts < e.window_end
  AND EXISTS (SELECT 1 FROM pairs p WHERE p.device = e.device AND p.ts = e.ts AND p.other = b.ts AND p.d <= {W.radius}) GROUP BY ALL)"""


@query(f"WITH {CLEARED} SELECT n.device, n.ts, n.window_end, n.neighbours FROM nn n JOIN spans s USING (device, era) WHERE neighbours < {W.k} AND (closes IS NULL OR window_end <= closes)")
def mcod_cold_clear(spark, sf_dir):
    return review.cleared_outliers(points(spark, sf_dir), W, 2 * PERIOD)


#: Elements of forty readings or single ones, windows of a fortnight either way; three settings each of shift and patience, two of confidence.
SETTINGS = [{"granularity": g, "confidence": c, "rho": r, "longest": 2016, "patience": k} for g in ("single", "hourly") for c in (0.99, 0.999) for r in (0.1, 0.3, 0.5) for k in (18, 36, 72)]


def grid(spark, sf_dir):
    """Elements of both granularities, the injected faults as segments, and the events of every setting."""
    e = injected(spark, sf_dir).select("device", F.col("at").cast("long").alias("at"), "seq", "value")
    hourly = drift.hourly_medians(e.select("device", F.col("at").alias("ts"), "value", F.lit(1).alias("generation"))).select(F.lit("hourly").alias("granularity"), "device", "ts", "value")
    # A device's readings of one second are one element.
    single = e.groupBy("device", F.col("at").alias("ts")).agg(F.max("value").alias("value")).select(F.lit("single").alias("granularity"), "device", "ts", "value")
    both = kept(single.unionByName(hourly), "elements")
    return both, segments(spark), kept(review.setting_events(both, SETTINGS), "events")


@query()
def drift_grid_segments(spark, sf_dir):
    """What each of 36 settings finds of each injected fault, and how late."""
    both, parts, events = grid(spark, sf_dir)
    return review.segment_report(events, both, parts, SETTINGS)


@query()
def drift_grid_summary(spark, sf_dir):
    both, parts, events = grid(spark, sf_dir)
    return review.grid_summary(events, review.segment_report(events, both, parts, SETTINGS), SETTINGS)


#: The model changes within an hour, so that the open hour is thrown away.
CHANGES = START + 12 * DAY + 5000
HOURLY = f"""{INJECTED}, scores AS (SELECT device, sec AS ts, value, CASE WHEN sec >= {CHANGES} THEN 2 ELSE 1 END AS generation FROM changed),
hours AS (SELECT device, generation, ts // 3600 * 3600 AS hour, quantile_cont(value, 0.5) AS value, min(ts) AS first FROM scores GROUP BY ALL),
ahead AS (SELECT *, lead(generation) OVER w AS next_generation, lead(first) OVER w AS next_first FROM hours WINDOW w AS (PARTITION BY device ORDER BY generation, hour))"""


def scores(spark, sf_dir):
    """Readings with faults as scores of a model that changes on the way."""
    e = injected(spark, sf_dir)
    return e.select("device", F.col("at").cast("long").alias("ts"), "value", F.when(F.col("at") >= CHANGES, 2).otherwise(1).cast("long").alias("generation"))


@query(f"WITH {HOURLY} SELECT device, CAST(hour AS BIGINT) AS ts, round(value, 6) + 0.0 AS value, CAST(generation AS BIGINT) AS generation FROM ahead WHERE next_first IS NULL OR next_generation = generation OR next_first >= hour + 7200")
def hourly_scores(spark, sf_dir):
    return drift.hourly_medians(scores(spark, sf_dir)).withColumn("value", rounded(F.col("value")))


@query()
def perf_layer(spark, sf_dir):
    """Drift of hourly medians, cleared when the model's generation changes."""
    return drift.drift_events(drift.hourly_medians(scores(spark, sf_dir)), patience=12)


@query()
def perf_tracker(spark, sf_dir):
    e = elements(spark, sf_dir)
    return review.confirmed_spans(drift.drift_events(e, patience=12), e)


@query(f"""WITH {STATES}, n AS (SELECT device, day, count(*) FILTER (WHERE deviated) AS n, count(transition) AS t FROM states GROUP BY ALL)
SELECT scheme, device, count(*) FILTER (WHERE on_) AS days FROM (SELECT device, unnest(['any', 'two', 'three', 'transition']) AS scheme, unnest([n >= 1, n >= 2, n >= 3, t >= 1]) AS on_ FROM n) GROUP BY scheme, device""")
def data_scheme_summary(spark, sf_dir):
    return review.alarm_schemes(states(spark, sf_dir))


def again(w):
    """The windows after a command, split anew for a model of the second generation."""
    later = w.where(F.col("window") >= 4).withColumn("window", F.col("window") - 4)
    return later.withColumn("part", F.when(F.col("window") < 3, "train").when(F.col("window") < 4, "early").otherwise("calibrate"))


@query()
def retrain_l1(spark, sf_dir):
    """Models of a second generation, fitted on windows after a command, beside the first, each with its calibration."""
    w = context_windows(spark, sf_dir)
    each = []
    for generation, part in ((1, w), (2, again(w))):
        models = score.fitted(part)
        _, calibrated = scored(part, models)
        each.append(models.join(calibrated, "device").select("device", F.lit(generation).alias("generation"), "rounds", "n", "median", "iqr"))
    return each[0].unionByName(each[1])


@query()
def shadow_scoring(spark, sf_dir):
    """Each window scored by the first model as it is and, under the same calibration, as other parameters show it."""
    w = context_windows(spark, sf_dir)
    models = score.fitted(w)
    main, calibrated = scored(w, models)
    shifted = w.withColumn("x", F.transform("x", lambda r: F.transform(r, lambda v: v * 1.1)))
    shadow, _ = scored(shifted, models, calibrated)
    return main.select("device", "window", F.col("z").alias("main_score")).join(shadow.select("device", "window", F.col("z").alias("shadow_score")), ["device", "window"])
