"""Streams with state, version switches, hours of scores, gates and episodes against batch operators and plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.config import Sliding
from sensorloom.operators import drift, fleet, outliers
from sensorloom.plans import checks, registry, windowed
from sensorloom.plans.shared import kept

SF = "/root/testdata/sf0.01"


def rows(spark, name, *columns):
    df = registry.queries()[name](spark, SF)
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def test_streams_show_every_kind_of_result(spark):
    """The SQL checks compare values; here that the tables make each of them occur."""
    days = rows(spark, "day_stream", "evaluable", "transition", "day")
    assert {d[0] for d in days} == {True, False} and {d[1] for d in days} == {None, "DEVIATE", "RECOVER"}
    assert min(d[2] for d in days) < "2024-03-31" < max(d[2] for d in days)  # the night of 23 hours is among them
    assert {r[0] for r in rows(spark, "connect_commands", "verdict")} == {"ignored", "late_watermark", "late_processed", "pre_freeze", "executed", "forwarded", "replaced"}
    assert {r[0] for r in rows(spark, "mcod_version_switch", "version")} == {None, 1, 2, 3}


def test_performance_stream_equals_batch(spark):
    names = ["device", *drift.COLUMNS]
    got = rows(spark, "perf_stream", *names)
    assert got == rows(spark, "perf_layer", *names) and {r[2] for r in got} == {"CANDIDATE", "CONFIRM", "REVOKE"}


@pytest.mark.parametrize("patience", [6, 12, 36])
def test_gate_against_plain_lists(spark, patience):
    """REVOKE and CONFIRM of drift_gate's elements, recomputed from the candidates."""
    series, events = {}, {}
    for r in windowed.elements(spark, SF).orderBy("device", "ts").collect():
        series.setdefault(r["device"], []).append((r["ts"], r["value"]))
    for r in drift.drift_events(windowed.elements(spark, SF), patience=patience).orderBy("device", "ts").collect():
        events.setdefault(r["device"], []).append(r)
    kinds = set()
    for device, found in events.items():
        want, free = [], -1
        place = {ts: k for k, (ts, _) in enumerate(series[device])}
        for c in (e for e in found if e["level"] == "CANDIDATE"):
            at = place[c["ts"]]
            assert c["during_check"] == (at < free)
            if at < free:
                continue
            for seen in range(1, patience + 1):
                if at + seen >= len(series[device]):
                    free = 10**9
                    break
                last = [x for _, x in series[device][max(at + 1, at + seen - 5) : at + seen + 1]]
                if len(last) == 6 and (not np.median(last) > c["threshold"] or seen == patience):
                    level = "CONFIRM" if np.median(last) > c["threshold"] else "REVOKE"
                    want.append((series[device][at + seen][0], level, c["ts"], seen))
                    free = at + seen
                    break
        got = [(e["ts"], e["level"], e["candidate_ts"], e["checked"]) for e in found if e["level"] != "CANDIDATE"]
        assert got == want
        kinds |= {g[1] for g in got}
    assert kinds == ({"CONFIRM", "REVOKE"} if patience < 36 else {"REVOKE"})


def test_a_check_takes_six_elements():
    with pytest.raises(ValueError, match="six"):
        drift.Gate(patience=5)


def test_generation_clears_detector_gate_and_hour(spark):
    """After a change the events are those of a fresh detector; an open hour goes with the old model, a closed one stays."""
    rng = random.Random(4)
    values = [rng.gauss(0 if k < 300 else 3, 1) for k in range(700)]
    elements = [(1, 600 * k, v, 1 if k < 400 else 2) for k, v in enumerate(values)]
    df = lambda part: spark.createDataFrame(part, "device long, ts long, value double, generation long")
    events = lambda part: sorted(map(tuple, drift.drift_events(df(part), longest=200, patience=12).select("ts", "level", "candidate_ts").collect()))
    assert events(elements) == sorted(events(elements[:400]) + events(elements[400:])) and events(elements)
    scores = [(1, 0, 5.0, 1), (1, 60, 7.0, 1), (1, 3700, 1.0, 1), (1, 3800, 9.0, 2), (1, 3900, 11.0, 2), (1, 7300, 4.0, 2), (1, 20_000, 8.0, 3), (1, 20_060, 6.0, None)]
    got = sorted(map(tuple, drift.hourly_medians(df(scores)).select("ts", "value", "generation").collect()))
    # 3600 of generation 1 is open at the change; 7200 of generation 2 was closed by time; 18000 of generation 3 is open.
    assert got == [(0, 6.0, 1), (3600, 10.0, 2), (7200, 4.0, 2), (18_000, 6.0, None)]


@pytest.mark.parametrize("filled", [True, False])
def test_version_switch_judges_new_points_among_backfilled_ones(spark, filled):
    s = Sliding(window=60, slide=10, radius=1.0, k=3)
    switch = 1000
    near = lambda ts: 10.0 + 0.01 * (ts // 10 % 5)
    points = [(1, ts, 1, 0.01 * (ts // 10 % 5) if ts != 970 else 30.0) for ts in range(switch - 200, switch, 10)] + [(1, ts, 2, near(ts) if ts != switch + 30 else 90.0) for ts in range(switch, switch + 100, 10)]
    again = [(1, 2, ts, 50.0 if ts == switch - 30 else near(ts)) for ts in range(switch - 60, switch, 10)] if filled else []
    wide = lambda df: df.withColumns({f"x{c}": F.lit(0.0) for c in range(1, 5)})
    df = wide(spark.createDataFrame(points, "device long, ts long, version int, x0 double"))
    bf = wide(spark.createDataFrame(again, "device long, version int, ts long, x0 double"))
    got = {(r["ts"], r["window_end"]): r["version"] for r in outliers.switched_outliers(df, bf, s).collect()}
    first = switch + 10
    assert ((switch, first) in got) == (not filled)  # alone after the clearing, or among the backfilled points
    assert got[970, 980] == 1 and all(ts >= switch for ts, end in got if end > switch)  # backfilled points are not judged
    assert got[switch + 30, switch + 40] == 2 and all(v == (1 if ts < switch else 2) for (ts, _), v in got.items())


@pytest.mark.parametrize("seed", range(4))
def test_episodes_against_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    within = 50
    ts = [rng.randrange(0, 4000) for _ in range(60)] + [rng.randrange(6000, 6000 + 40 * within) for _ in range(400)]
    marks = sorted({(t, rng.randrange(6)) for t in ts})
    want, start, members = [], None, []
    for t, d in [*marks, (10**9, -1)]:
        if start is None or t > start + within:
            if start is not None and len(set(members)) >= 2:
                want.append((start, ",".join(map(str, sorted(set(members)))), len(members)))
            start, members = t, []
        members.append(d)
    df = spark.createDataFrame([(d, t) for t, d in marks], "device long, ts long")
    assert sorted(map(tuple, fleet.episodes(df, within, 2, kept).collect())) == want
    assert fleet.episodes(df.where("ts < 0"), within, 2, kept).count() == 0


def test_hourly_scores_drop_an_open_hour(spark):
    """The change of generation falls within an hour: some devices lose it."""
    every = checks.scores(spark, SF).select("device", "generation", F.floor(F.col("ts") / 3600)).distinct().count()
    assert 0 < every - registry.queries()["hourly_scores"](spark, SF).count() < 100
