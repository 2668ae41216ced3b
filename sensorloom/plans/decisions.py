"""Queries of day states, fleet alerts and commands, versions, and the context channel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import EVENTS, Scaler
from ..functions.arrays import local_day, local_hour, rounded
from ..operators import adapt, decide, fleet, outliers, scaling, score, windows
from .basic import BINS, DAYS, reference
from .bindings import PERIOD, ROUNDS, rounds
from .shared import kept
from .windowed import DAY, L, POINTS, START, W, points

Q, S = {}, {}
RULES = fleet.Rules(tick=DAY, period=PERIOD, context_windows=1, site_days=7, site_flags=3)
LIMITS = [0.05, 0.05, 0.05, 0.05, 0.05]
P_POINT = 0.75


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def seen(spark, sf_dir):
    """Observations of a day: complete rounds, point outliers, and as context a round whose channel 4 is high."""
    r = rounds(spark, sf_dir).withColumn("stuck", F.coalesce(F.col("x0") < 5, F.lit(False)))
    p = points(spark, sf_dir)
    found = outliers.arrival_outliers(outliers.outliers(p, W), W)
    ctx = p.select("device", "ts", F.col("x4").alias("score"), (F.col("x4") > 150).alias("above"))
    return fleet.observations(r, found, ctx, RULES)


MEANS = ", ".join(f"sum(x{c}) AS sum{c}, count(x{c}) AS n{c}, avg(x{c}) AS mean{c}" for c in fleet.ACTIVE)
COLUMNS = ", ".join(f"sum{c}, n{c}, mean{c}" for c in fleet.ACTIVE)
SEEN = f"""{POINTS}, o AS (SELECT device, (ts // {DAY}) * {DAY} AS tick, count(*) AS rounds, count(*) FILTER (WHERE NOT incomplete) AS admitted, count(*) FILTER (WHERE x0 < 5) AS guard_rounds, {MEANS} FROM rounds GROUP BY ALL),
po AS (SELECT device, (ts // {DAY}) * {DAY} AS tick, count(DISTINCT ts) AS outlier_rounds FROM found WHERE ts >= window_end - {W.slide} GROUP BY ALL),
cx AS (SELECT device, (ts // {DAY}) * {DAY} AS tick, count(*) FILTER (WHERE x4 > 150) AS ctx_above, max(x4) AS ctx_max FROM pts GROUP BY ALL),
seen AS (SELECT device, tick, rounds, admitted, guard_rounds, coalesce(outlier_rounds, 0) AS outlier_rounds, coalesce(ctx_above, 0) AS ctx_above, ctx_max, {COLUMNS} FROM o LEFT JOIN po USING (device, tick) LEFT JOIN cx USING (device, tick))"""

WIDTHS = ", ".join(f"quantile_cont(x{c}, 0.9) FILTER (WHERE ts // {DAY} < d0 + 10) - quantile_cont(x{c}, 0.1) FILTER (WHERE ts // {DAY} < d0 + 10) AS width{c}" for c in fleet.ACTIVE)
OFF = " OR ".join(f"coalesce(abs(mean{c} - (sum(sum{c}) FILTER (WHERE early) OVER slot) / (sum(n{c}) FILTER (WHERE early) OVER slot)) > 0.5 * width{c}, false)" for c in fleet.ACTIVE)
FLAGS = f"""{SEEN}, flagged AS (SELECT *, 1 - rounds / {RULES.nominal} > 0.2 OR guard_rounds / {RULES.nominal} > 0.2 AS bad,
  coalesce(CASE WHEN admitted >= 0.5 * {RULES.nominal} THEN outlier_rounds / admitted END > {P_POINT}, false) AS pflag, ctx_above >= 0.5 AS cflag FROM seen),
fl AS (SELECT *, count(*) FILTER (WHERE NOT bad) OVER t AS present, count(*) OVER t AS devices, count(*) FILTER (WHERE bad) OVER t AS n_bad,
  count(*) FILTER (WHERE NOT bad AND pflag) OVER t AS n_point, count(*) FILTER (WHERE NOT bad AND cflag) OVER t AS n_context FROM flagged WINDOW t AS (PARTITION BY tick)),
fleet AS (SELECT *, CAST(greatest(2, ceil(3 * present / 4)) AS BIGINT) AS "limit" FROM fl),
refs AS (SELECT device, CAST(min(ts) // {DAY} AS BIGINT) AS frozen, {WIDTHS} FROM (SELECT *, min(ts // {DAY}) OVER (PARTITION BY device) AS d0 FROM rounds) GROUP BY device),
based AS (SELECT *, tick // {DAY} AS day, tick // {DAY} BETWEEN frozen AND frozen + 9 AS early, CAST(coalesce(sum(CAST(pflag OR cflag AS BIGINT)) OVER (PARTITION BY device, tick % {DAY} ORDER BY tick // {DAY} RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS past FROM fleet LEFT JOIN refs USING (device)),
site AS (SELECT *, past >= 2 AND day >= frozen + 10 AND off AS site FROM (SELECT *, {OFF} AS off FROM based WINDOW slot AS (PARTITION BY device, tick % {DAY})))"""


@query(f"WITH {SEEN} SELECT device, tick, rounds, admitted, guard_rounds, outlier_rounds, ctx_above, ctx_max, n0, n1, n2, round(mean0, 6) AS mean0, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2 FROM seen")
def hour_obs(spark, sf_dir):
    return seen(spark, sf_dir).drop("sum0", "sum1", "sum2").withColumns({m: rounded(F.col(m)) for m in ("mean0", "mean1", "mean2")})


@query(f"WITH {SEEN} SELECT round(quantile_cont(outlier_rounds / admitted, 0.99), 6) AS p_point FROM seen WHERE 1 - rounds / {RULES.nominal} <= 0.2 AND admitted > 0")
def derive_p_point(spark, sf_dir):
    return fleet.point_limit(seen(spark, sf_dir), RULES).withColumn("p_point", rounded(F.col("p_point")))


def flagged(spark, sf_dir):
    return fleet.flags(seen(spark, sf_dir), P_POINT, RULES)


@query(f'WITH {FLAGS} SELECT device, tick, bad, pflag, cflag, present, devices, n_bad, n_point, n_context, "limit" FROM fleet')
def fleet_counts(spark, sf_dir):
    return fleet.with_fleet(flagged(spark, sf_dir)).select("device", "tick", "bad", "pflag", "cflag", "present", "devices", "n_bad", "n_point", "n_context", "limit")


def references(spark, sf_dir):
    """A device's first day, and the spread of its active channels over its first ten days."""
    r = rounds(spark, sf_dir).withColumn("day", F.floor(F.col("ts") / DAY))
    r = r.withColumn("frozen", F.min("day").over(Window.partitionBy("device")))
    q = {c: F.percentile(F.when(F.col("day") < F.col("frozen") + RULES.baseline_days, F.col(f"x{c}")), F.array(F.lit(0.1), F.lit(0.9))) for c in fleet.ACTIVE}
    return r.groupBy("device").agg(F.min("frozen").alias("frozen"), *[(q[c][1] - q[c][0]).alias(f"width{c}") for c in fleet.ACTIVE])


@query(f"WITH {FLAGS} SELECT device, tick, past, off, site FROM site WHERE past > 0 OR off")
def site_condition(spark, sf_dir):
    return fleet.site_flags(flagged(spark, sf_dir), references(spark, sf_dir), RULES).where("past > 0 OR off").select("device", "tick", "past", "off", "site")


JUMP = 60.0
ALERTS = f"""{FLAGS}, marks AS (SELECT *, coalesce(abs(mean0 - lag(mean0) OVER (PARTITION BY device ORDER BY tick)) > {JUMP}, false) AS drift, coalesce(ctx_max > 300, false) AS transient, coalesce(ctx_max > 400, false) AS switch,
  (pflag AND n_point >= "limit") OR (cflag AND n_context >= "limit") AS wide FROM site),
counts AS (SELECT *, count(*) FILTER (WHERE NOT bad AND drift) OVER t AS n_drift, count(*) FILTER (WHERE NOT bad AND transient) OVER t AS n_transient, count(*) FILTER (WHERE NOT bad AND switch) OVER t AS n_switch, count(*) FILTER (WHERE NOT bad AND (pflag OR cflag)) OVER t AS n_any FROM marks WINDOW t AS (PARTITION BY tick)),
labelled AS (SELECT *, CASE WHEN bad THEN 'QUALITY' WHEN switch THEN 'SWITCH' WHEN drift THEN 'DRIFT' WHEN (pflag OR cflag) AND site THEN 'SITE' WHEN transient THEN 'TRANSIENT' WHEN wide THEN 'ENVIRONMENT' WHEN pflag OR cflag THEN 'ANOMALY' END AS label FROM counts),
alerts AS (SELECT device, tick, label, CASE label WHEN 'QUALITY' THEN CASE WHEN n_bad >= greatest(2, ceil(3 * devices / 4)) THEN 'global' ELSE 'local' END WHEN 'SWITCH' THEN CASE WHEN n_switch >= "limit" THEN 'global' ELSE 'local' END
  WHEN 'DRIFT' THEN CASE WHEN n_drift >= "limit" THEN 'global' ELSE 'local' END WHEN 'TRANSIENT' THEN CASE WHEN n_transient >= "limit" THEN 'global' ELSE 'local' END WHEN 'ENVIRONMENT' THEN 'global' ELSE 'local' END AS scope,
  CAST(CASE label WHEN 'QUALITY' THEN n_bad WHEN 'SWITCH' THEN n_switch WHEN 'DRIFT' THEN n_drift WHEN 'SITE' THEN 0 WHEN 'TRANSIENT' THEN n_transient WHEN 'ENVIRONMENT' THEN n_any ELSE 1 END AS BIGINT) AS co FROM labelled WHERE label IS NOT NULL)"""


def labelled(spark, sf_dir):
    """Drift where a device's daily mean jumps; a high score stands for a confirmed one, a higher one for a burst."""
    f = flagged(spark, sf_dir)
    jump = F.abs(F.col("mean0") - F.lag("mean0").over(Window.partitionBy("device").orderBy("tick"))) > JUMP
    drifting = f.withColumn("jump", jump).where("jump")
    return fleet.alerts(f, references(spark, sf_dir), drifting, f.where("ctx_max > 300"), f.where("ctx_max > 400"), RULES)


@query(f"WITH {ALERTS} SELECT * FROM alerts")
def alert_tick(spark, sf_dir):
    return labelled(spark, sf_dir)


#: A fault of every fourth device: channel 0 reads half as much again for three days of six.
OWN = "SELECT device, CAST(floor(d / 100) AS BIGINT) AS day, channel, x FROM days"
FAULTY = OWN.replace("channel, x", "channel, CASE WHEN channel = 0 AND device % 4 = 1 AND floor(d / 100) % 6 >= 3 THEN 1.5 * x ELSE x END AS x")
STATES = f"""{DAYS.replace(OWN, FAULTY)}, marked AS (SELECT *, 0.0 AS missing, CASE WHEN day % 5 = 0 AND device % 8 = 1 THEN 0.5 ELSE 0.0 END AS guard, day = 4 AS calibration FROM dayrows),
ev AS (SELECT *, NOT calibration AND missing <= 0.2 AND guard <= 0.2 AS evaluable FROM marked),
mk AS (SELECT *, CASE WHEN evaluable AND p < 0.002 AND d > 0.05 THEN true WHEN evaluable AND d <= 0.05 THEN false END AS mark FROM ev),
dv AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY device, channel ORDER BY day), false) AS deviated FROM mk),
states AS (SELECT *, CASE WHEN deviated AND NOT coalesce(lag(deviated) OVER w, false) THEN 'DEVIATE' WHEN NOT deviated AND coalesce(lag(deviated) OVER w, false) THEN 'RECOVER' END AS transition FROM dv WINDOW w AS (PARTITION BY device, channel ORDER BY day)),
pers AS (SELECT device, day, channel, CASE WHEN coalesce(prev = day - 1 AND was, false) THEN 'TWO_DAYS' WHEN device % 8 = 3 THEN 'BOTH_LAYERS' END AS form FROM (SELECT *, lag(day) OVER w AS prev, lag(deviated) OVER w AS was FROM states WINDOW w AS (PARTITION BY device, channel ORDER BY day)) WHERE evaluable AND deviated)"""


def states(spark, sf_dir):
    ref, own = reference(spark, sf_dir)
    broken = (F.col("channel") == 0) & (F.col("device") % 4 == 1) & (F.col("day") % 6 >= 3)
    own = own.withColumn("x", F.when(broken, 1.5 * F.col("x")).otherwise(F.col("x")))
    s = scaling.day_stats(own, scaling.reference_model(ref, BINS), BINS)
    s = s.withColumn("missing", F.lit(0.0)).withColumn("guard", F.when((F.col("day") % 5 == 0) & (F.col("device") % 8 == 1), 0.5).otherwise(0.0)).withColumn("calibration", F.col("day") == 4)
    return fleet.day_states(s, LIMITS, RULES)


@query(f"WITH {STATES} SELECT device, day, channel, evaluable, deviated, transition FROM states")
def day_state(spark, sf_dir):
    return states(spark, sf_dir).select("device", "day", "channel", "evaluable", "deviated", "transition")


def lasting(spark, sf_dir):
    s = states(spark, sf_dir)
    return fleet.persistent(s, s.where("device % 8 = 3").select("device", "day"))


@query(f"WITH {STATES} SELECT device, day, channel, form FROM pers WHERE form IS NOT NULL")
def persistent_channels(spark, sf_dir):
    return lasting(spark, sf_dir)


def asked(spark, sf_dir):
    """Commands for point-outlier days: a trigger is a device's day on which most rounds are outliers."""
    days = flagged(spark, sf_dir).where("pflag OR cflag").select("device", F.floor(F.col("tick") / DAY).alias("day"), F.when(F.col("cflag"), -1).otherwise(0).alias("channel"), F.when(F.col("cflag"), "PERF").otherwise("TWO_DAYS").alias("form"))
    return fleet.commands(days, RULES)


def confirmed(states):
    """Spans of confirmed scores and the models' events, for the devices of states: every third device has two spans, the second one of some after a switch."""
    every = states.select("device").distinct()
    first = F.struct(F.lit(5 * DAY + 72_000).cast("long").alias("since"), F.lit(7 * DAY + 25_200).cast("long").alias("until"))
    second = F.struct(F.lit(12 * DAY + 43_200).cast("long").alias("since"), F.lit(None).cast("long").alias("until"))
    spans = every.where("device % 3 = 0").select("device", F.explode(F.array(first, second)).alias("s")).select("device", "s.since", "s.until")
    event = lambda at, kind: F.struct(F.lit(at * DAY).cast("long").alias("at"), F.lit(kind).alias("kind"))
    events = F.when(F.col("device") % 5 == 4, F.array(event(15, "online"))).when(F.col("device") % 2 == 0, F.array(event(4, "online"), event(11, "switch"))).otherwise(F.array(event(4, "online")))
    return spans, every.select("device", F.explode(events).alias("e")).select("device", "e.at", "e.kind")


def decided(spark, sf_dir, rule=decide.Decision(events=True)):
    # Devices, spans and days are read off the same states, which are taken once.
    s = kept(states(spark, sf_dir), "states")
    spans, models = confirmed(s)
    closed = decide.closed_spans(spans, models)
    return decide.triggers(s.select("device", "day", "channel", "evaluable", "deviated"), closed, rule), models, rule


#: The same spans in SQL, and what triggers on each day.
_TRIGGERED = f"""{STATES}, devs AS (SELECT DISTINCT device FROM states),
spans AS (SELECT device, {5 * DAY + 72_000} AS since, {7 * DAY + 25_200} AS until FROM devs WHERE device % 3 = 0
          UNION ALL SELECT device, {12 * DAY + 43_200}, NULL FROM devs WHERE device % 3 = 0),
pers2 AS (SELECT device, day, channel, evaluable, deviated, coalesce(lag(day) OVER w = day - 1 AND lag(deviated) OVER w, false) AS before FROM states WINDOW w AS (PARTITION BY device, channel ORDER BY day)),
perday AS (SELECT device, day, bool_or(evaluable) AS ev, bit_or(CASE WHEN deviated THEN 1 << channel ELSE 0 END) AS dev, bit_or(CASE WHEN deviated AND before THEN 1 << channel ELSE 0 END) AS twice FROM pers2 GROUP BY device, day),
conf AS (SELECT d.*, (SELECT max(since) FROM spans s WHERE s.device = d.device AND since <= (day + 1) * {DAY} AND (until IS NULL OR until > (day + 1) * {DAY})) AS since FROM perday d),
masks AS (SELECT *, CASE WHEN NOT ev THEN 0 WHEN since IS NOT NULL THEN dev ELSE twice END + CASE WHEN since < day * {DAY} THEN {1 << decide.PERF} ELSE 0 END AS mask FROM conf),
present AS (SELECT day, count(*) AS n FROM masks WHERE ev GROUP BY day),
bits AS (SELECT unnest([0, 1, 2, 3, 4, {decide.PERF}]) AS b), counts AS (SELECT day, b, count(*) FILTER (WHERE ev AND (mask >> b) & 1 = 1) AS n FROM masks CROSS JOIN bits GROUP BY ALL)"""


@query(f"""WITH {_TRIGGERED} SELECT m.device, CAST(m.day AS BIGINT) AS day, CAST(mask AS BIGINT) AS mask,
CASE WHEN (SELECT max(n) FROM counts c JOIN bits USING (b) WHERE c.day = m.day AND (m.mask >> b) & 1 = 1) >= greatest(2, ceil(p.n * 0.75)) THEN 'global' ELSE 'local' END AS scope,
(SELECT count(*) FROM masks o WHERE o.day = m.day AND o.ev AND o.mask & m.mask <> 0) AS co FROM masks m JOIN present p USING (day) WHERE mask <> 0""")
def cmd_triggers(spark, sf_dir):
    """What persists at the end of each day, whether it is the fleet's, and how many devices share it."""
    return decided(spark, sf_dir)[0].where("mask <> 0").select("device", F.col("day").cast("long").alias("day"), "mask", "scope", "co")


@query()
def cmd_tick(spark, sf_dir):
    return decide.decisions(*decided(spark, sf_dir))


@query(f"""WITH {ALERTS} SELECT device, tick // {DAY} AS day, label, count(*) AS n FROM alerts GROUP BY ALL""")
def alert_days(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("device", F.floor(F.col("tick") / DAY).alias("day"), "label").agg(F.count(F.lit(1)).alias("n"))


#: Days of lineitem's states, which begin with 4, meet the days of alerts from the first one on.
REVIEWED = ALERTS.removeprefix("\n") + ", " + STATES.removeprefix("\n")


@query(f"""WITH {REVIEWED}, an AS (SELECT device, (tick - {START}) // {DAY} + 4 AS day FROM alerts WHERE label = 'ANOMALY'), dev AS (SELECT DISTINCT device, day FROM states WHERE transition = 'DEVIATE')
SELECT device, CAST(day AS BIGINT) AS day, 'UNEVALUABLE' AS kind, count(*) AS n FROM states WHERE NOT evaluable AND NOT calibration GROUP BY ALL
UNION ALL SELECT device, CAST(day AS BIGINT), 'ANOMALY_TO_SWITCH', count(*) FROM an SEMI JOIN dev USING (device, day) GROUP BY ALL""")
def reviews(spark, sf_dir):
    shifted = labelled(spark, sf_dir).withColumn("tick", F.col("tick") - START + 4 * DAY)
    return fleet.reviews(shifted, states(spark, sf_dir)).select("device", "day", "kind", "n")


FAULTS = [(1, 1, START + 2 * DAY, START + 9 * DAY), (2, 4, START + 10 * DAY, START + 14 * DAY), (3, 6, START + 20 * DAY, START + 29 * DAY)]


@query()
def latency_table(spark, sf_dir):
    faults = spark.createDataFrame(FAULTS, "fault int, device long, start long, stop long")
    return fleet.latency(faults, labelled(spark, sf_dir), asked(spark, sf_dir))


@query(f"""WITH RECURSIVE {ALERTS.removeprefix(chr(10))}, hits AS (SELECT device, tick AS ts FROM flagged WHERE cflag),
starts AS (SELECT min(ts) AS start FROM hits UNION ALL SELECT (SELECT min(ts) FROM hits WHERE ts > start + {2 * DAY}) FROM starts WHERE start IS NOT NULL),
met AS (SELECT start, device, count(*) AS n FROM starts JOIN hits ON ts BETWEEN start AND start + {2 * DAY} GROUP BY ALL)
SELECT CAST(start AS BIGINT) AS start, string_agg(CAST(device AS VARCHAR), ',' ORDER BY device) AS devices, CAST(sum(n) AS BIGINT) AS n FROM met GROUP BY start HAVING count(*) >= 3""")
def episode_cluster(spark, sf_dir):
    marks = flagged(spark, sf_dir).where("cflag").select("device", F.col("tick").alias("ts"))
    return fleet.episodes(marks, 2 * DAY, 3, kept)


#: Commands that every device of the fleet gets: level, effective and decided after START, seq. One for each verdict, and some that meet.
WARM, LAG = 20, 55
COMMANDS = [(0, 12 * DAY, 11 * DAY, 1), (0, 20 * DAY + 100, 19 * DAY, 2), (0, 15 * DAY, 16 * DAY, 3), (1, 14 * DAY, 13 * DAY, 4), (2, 14 * DAY - 50, 13 * DAY, 5), (7, 14 * DAY, 13 * DAY, 6), (0, 90 * DAY, 13 * DAY, 7), (0, 2 * DAY, DAY, 8), (0, 18 * DAY, 18 * DAY + 30, 9), (2, 22 * DAY, 21 * DAY, 10)]
COMMAND_ROWS = ", ".join(map(str, COMMANDS))
SCHEDULED = f"""{ROUNDS}, commands AS (SELECT device, level, {START} + e AS effective_at, {START} + d AS decided_at, seq FROM (SELECT DISTINCT device FROM rounds) CROSS JOIN (VALUES {COMMAND_ROWS}) c(level, e, d, seq)),
numbered AS (SELECT device, ts, row_number() OVER (PARTITION BY device ORDER BY ts) AS number FROM rounds),
met AS (SELECT c.device, CAST(c.seq AS BIGINT) AS seq, c.level, CAST(c.effective_at AS BIGINT) AS effective_at, c.decided_at, min(n.ts) AS first_ts, min(n.number) AS number FROM commands c LEFT JOIN numbered n ON n.device = c.device AND n.ts >= c.effective_at GROUP BY ALL),
judged AS (SELECT *, CASE WHEN level NOT IN (0, 1, 2) THEN 'ignored' WHEN effective_at <= decided_at - {LAG} THEN 'late_watermark' WHEN first_ts <= decided_at THEN 'late_processed' WHEN first_ts IS NULL THEN 'waiting' WHEN number <= {WARM} THEN 'pre_freeze' WHEN level = 0 THEN 'executed' ELSE 'forwarded' END AS v FROM met),
sched AS (SELECT *, CASE WHEN v = 'forwarded' AND row_number() OVER (PARTITION BY device, v, first_ts ORDER BY effective_at DESC, seq DESC) > 1 THEN 'replaced' ELSE v END AS verdict FROM judged)"""


def commands_of(r):
    """Every command for every device of the rounds r."""
    each = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(START + e).cast("long").alias("effective_at"), F.lit(START + d).cast("long").alias("decided_at"), F.lit(seq).alias("seq")) for level, e, d, seq in COMMANDS])
    return r.select("device").distinct().select("device", F.explode(each).alias("c")).select("device", "c.*")


def scheduled(spark, sf_dir):
    r = rounds(spark, sf_dir)
    return adapt.schedule(commands_of(r), r, WARM, LAG)


@query(f"WITH {SCHEDULED} SELECT CAST(device AS BIGINT) AS device, seq, level, effective_at, verdict, CASE WHEN verdict IN ('executed', 'forwarded') THEN first_ts END AS executes FROM sched")
def command_schedule(spark, sf_dir):
    return scheduled(spark, sf_dir)


@query(f"""WITH {SCHEDULED}, w AS (SELECT device, ts FROM (SELECT device, ts, row_number() OVER (PARTITION BY device ORDER BY ts) AS n FROM rounds) WHERE n > {WARM})
SELECT w.device, w.ts, CAST(coalesce((SELECT arg_max(seq, first_ts * 100 + seq) + 1 FROM sched s WHERE s.device = w.device AND verdict = 'executed' AND level = 0 AND first_ts <= w.ts AND EXISTS (SELECT 1 FROM w q WHERE q.device = s.device AND q.ts = s.first_ts)), 1) AS BIGINT) AS version FROM w""")
def version_tag(spark, sf_dir):
    return adapt.versions(rounds(spark, sf_dir), scheduled(spark, sf_dir), WARM)


RE = f"""{SCHEDULED}, ex AS (SELECT device, seq + 1 AS version, effective_at FROM sched WHERE verdict = 'executed' AND level = 0),
cells AS (SELECT device, ts, unnest([0, 1, 2, 3, 4]) AS channel, unnest([x0, x1, x2, x3, CASE WHEN x4 IS NULL THEN NULL ELSE ln(1 + x4) END]) AS t FROM rounds WHERE NOT coalesce(x0 < 5, false)),
est AS (SELECT c.device, version, channel, count(*) AS n, quantile_cont(t, 0.5) AS m, quantile_cont(t, 0.75) - quantile_cont(t, 0.25) AS s FROM cells c JOIN ex e ON e.device = c.device AND ts >= effective_at - {7 * DAY} AND ts < effective_at WHERE t IS NOT NULL GROUP BY ALL),
fz AS (SELECT device, channel, quantile_cont(t, 0.5) AS fm, quantile_cont(t, 0.75) - quantile_cont(t, 0.25) AS fs FROM (SELECT device, ts, unnest([0, 1, 2, 3, 4]) AS channel, unnest([x0, x1, x2, x3, CASE WHEN x4 IS NULL THEN NULL ELSE ln(1 + x4) END]) AS t FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY ts) AS k FROM rounds) WHERE k <= 40) WHERE t IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {RE} SELECT e.device, version, CAST(e.channel AS INTEGER) AS channel, n, round(CASE WHEN e.channel IN (1, 2) THEN fm ELSE m END, 6) + 0.0 AS median, round(CASE WHEN e.channel IN (1, 2) THEN fs ELSE s END, 6) + 0.0 AS scale FROM est e LEFT JOIN fz USING (device, channel)")
def level0_reestimate(spark, sf_dir):
    r = rounds(spark, sf_dir).withColumn("stuck", F.coalesce(F.col("x0") < 5, F.lit(False)))
    done = scheduled(spark, sf_dir).where("verdict = 'executed' AND level = 0")
    p = adapt.reestimate(r, done, scaling.calibrate(r, EVENTS, Scaler(rounds=40)), EVENTS, 7 * DAY, (1, 2))
    return p.withColumn("median", rounded(F.col("median"))).withColumn("scale", rounded(F.col("scale")))


@query(f"WITH {RE} SELECT r.device, version, ts FROM rounds r JOIN ex e ON e.device = r.device AND ts >= effective_at - {3 * DAY} AND ts < effective_at WHERE NOT incomplete")
def backfill(spark, sf_dir):
    done = scheduled(spark, sf_dir).where("verdict = 'executed' AND level = 0")
    return adapt.backfill(rounds(spark, sf_dir), done, 3 * DAY)


#: Brings the events to the days around the change to summer time: 65 days later.
SPRING = 65 * DAY


@query(f"""WITH {ROUNDS}, v AS (SELECT CAST(to_timestamp(ts + {SPRING}) AT TIME ZONE 'Europe/London' AS DATE) AS d, hour(to_timestamp(ts + {SPRING}) AT TIME ZONE 'Europe/London') AS h FROM rounds)
SELECT CAST(d AS VARCHAR) AS day, CAST(h AS INTEGER) AS hour, count(*) AS rounds FROM v GROUP BY ALL""")
def local_day_window(spark, sf_dir):
    at = F.col("ts") + SPRING
    return rounds(spark, sf_dir).groupBy(local_day(at).cast("string").alias("day"), local_hour(at).alias("hour")).agg(F.count(F.lit(1)).alias("rounds"))


def context_windows(spark, sf_dir):
    """Count windows of scaled values, split by count."""
    r = points(spark, sf_dir)
    z = r.select("device", "ts", *[((F.col(f"x{c}") - 50) / 50).alias(f"x{c}") for c in range(5)])
    return windows.split_windows(windows.count_windows(z, L), 4, L, (9, 12, 18))


#: Score from which a window is reported, in IQRs above the median.
LIMIT = 2.22
_NUM = f"""{POINTS}, num AS (SELECT device, (x0-50)/50 AS x0, (x1-50)/50 AS x1, (x2-50)/50 AS x2, (x3-50)/50 AS x3, (x4-50)/50 AS x4, row_number() OVER (PARTITION BY device ORDER BY ts) AS k FROM pts)"""
_COV = ", ".join(f"round(covar_pop(x{i}, x{j}){' + 1e-4' if i == j else ''}, 6) + 0.0 AS c{i}{j}" for i in range(5) for j in range(i, 5))


def upper(column: str, digits: int = 6):
    """The entries of a symmetric 5 x 5 matrix from the diagonal up, as columns."""
    return [rounded(F.get(F.get(column, F.lit(i)), F.lit(j)), digits).alias(f"c{i}{j}") for i in range(5) for j in range(i, 5)]


def undone(matrix: str, other: str):
    """Whether two matrices multiply to the unit matrix within 1e-9."""
    off = F.transform(score.times(F.col(matrix), F.col(other)), lambda row, i: F.array_max(F.transform(row, lambda v, j: F.abs(v - F.when(i == j, 1.0).otherwise(0.0)))))
    return F.array_max(off) <= 1e-9


@query(f"WITH {_NUM} SELECT device, count(*) AS rounds, {_COV}, true AS inverted FROM num WHERE k <= 36 AND (SELECT count(*) FROM num n WHERE n.device = num.device) >= {L} AND (k - 1) // {L} < (SELECT count(*) FROM num n WHERE n.device = num.device) // {L} GROUP BY device")
def context_model(spark, sf_dir):
    """The covariance of each device's training rounds, and whether its inverse is one."""
    m = score.fitted(context_windows(spark, sf_dir))
    return m.select("device", "rounds", *upper("covariance"), undone("covariance", "precision").alias("inverted"))


def scored(w, models, calibrated=None):
    """Scores of windows under models, calibrated on the windows of that part unless that is given."""
    errors = kept(score.window_errors(score.reconstructed(w, models)).drop("x", "y", "mask"), "errors")
    calibrated = score.calibrate(errors.where("part = 'calibrate'")) if calibrated is None else calibrated
    return score.score(errors, calibrated, LIMIT), calibrated


@query()
def ctx_score(spark, sf_dir):
    w = kept(context_windows(spark, sf_dir), "windows")
    return scored(w, score.fitted(w))[0].select("device", "window", "start", "stop", "wmse", F.col("z").alias("score"), "mahalanobis", "above")


@query(f"""WITH {POINTS}, num AS (SELECT *, (row_number() OVER (PARTITION BY device ORDER BY ts) - 1) // {L} AS win FROM pts),
sq AS (SELECT device, win, avg(((x0-50)/50)^2+((x1-50)/50)^2+((x2-50)/50)^2+((x3-50)/50)^2+((x4-50)/50)^2) / 5 AS e FROM num GROUP BY ALL HAVING count(*) = {L})
SELECT device, CASE WHEN (win + 1) * {L} <= 36 THEN 'train' WHEN (win + 1) * {L} <= 48 THEN 'early' WHEN (win + 1) * {L} <= 72 THEN 'calibrate' ELSE 'online' END AS part, count(*) AS windows, round(avg(e), 6) AS wmse FROM sq GROUP BY ALL""")
def zero_baseline(spark, sf_dir):
    return score.zero_baseline(context_windows(spark, sf_dir)).withColumn("wmse", rounded(F.col("wmse")))


@query()
def hyper_grid(spark, sf_dir):
    """Median and spread of the calibration windows' errors, and their share of the zero model's error, for each ridge."""
    w = context_windows(spark, sf_dir).withColumn("ridge", F.explode(F.array(*[F.lit(r) for r in (1e-6, 1e-4, 1e-2, 1.0)])))
    models = score.fitted(w, ("ridge", "device"), F.col("ridge"))
    errors = score.window_errors(score.reconstructed(w, models, ("ridge", "device"))).where("part = 'calibrate'")
    zero = F.aggregate("x", F.lit(0.0), lambda s, r: s + F.aggregate(r, F.lit(0.0), lambda a, v: a + v * v)) / (F.size("x") * 5)
    q = F.percentile("wmse", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return errors.groupBy("ridge", "device").agg(q.alias("q"), (F.avg("wmse") / F.avg(zero)).alias("share")).select("ridge", "device", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "share")
