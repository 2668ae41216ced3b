"""Kernels and distribution functions on their own."""

import math
import random

import numpy as np
import pytest

from sensorloom.config import Sliding
from sensorloom.functions import stats
from sensorloom.operators import drift, inject, outliers


def test_quantiles():
    assert stats.f_ppf(0.95, 5, 10) == pytest.approx(3.325835, abs=1e-6)
    assert stats.t_ppf(0.975, 10) == pytest.approx(2.228139, abs=1e-6)
    assert stats.chi2_sf(18.307, 10) == pytest.approx(0.05, abs=1e-5)


def test_drift_found_and_confirmed():
    table = drift.lookup(0.99, 0.5, 120)
    rng = np.random.default_rng(1)
    series = np.concatenate([rng.normal(0, 1, 300), rng.normal(5, 1, 200)])
    d, g, events = drift.Detector(table, 120), drift.Gate(0.5, 36), []
    for k, x in enumerate(series):
        events += g.update(k, x, d.update(x))
    levels = [(e["level"], e["ts"]) for e in events]
    first = next(t for level, t in levels if level == "CONFIRM")
    assert 300 < first < 400
    assert sum(level == "CANDIDATE" and t < 300 for level, t in levels) <= 5


def test_constant_series_skips_the_t_test():
    d = drift.Detector(drift.lookup(0.99, 0.5, 60), 60)
    assert [d.update(1.0) for _ in range(100)] == [None] * 100 and d.t_skipped == 71


def test_injection_grammar():
    assert inject.parse_specs("1:view:10:5:step:2;3:click:0:1:stuck:0")[0] == (0, 1, "view", 10, 15, "step", 2.0)
    for bad in ("1:view:10:5:jump:2", "1:view:10:0:step:2", "1:view"):
        with pytest.raises(ValueError):
            inject.parse_specs(bad)


def test_clusters_equal_neighbour_counts():
    """Points in clusters are never outliers, and the rest are counted exactly."""
    s, rng = Sliding(window=600, slide=60, radius=1.0, k=4), random.Random(7)
    centers = [(0, 0, 0, 0, 0), (3, 3, 3, 3, 3), (9, 0, 9, 0, 9)]
    state, points = outliers.Clusters(s), []
    for t in range(0, 3000, 7):
        c = centers[rng.choice([0, 0, 0, 1, 1, 2])]
        points.append((t, np.array([v + rng.gauss(0, 0.25) for v in c])))
    k = 0
    for end in range(60, 3060, 60):
        while k < len(points) and points[k][0] < end:
            state.insert(*points[k])
            k += 1
        held = [(t, x) for t, x in points if end - 600 <= t < end]
        want = [t for t, x in held if sum(np.linalg.norm(x - y) <= 1.0 for u, y in held if u != t) < s.k]
        assert sorted(state.outliers()) == want
        state.expire(end + 60 - 600)


@pytest.mark.parametrize("geometry", [(3600, 60, 10, 10), (600, 60, 7, 4), (240, 240, 60, 2), (300, 120, 11, 3)])
def test_outliers_equal_plain_counts(spark, geometry):
    """Every window of every point, whether or not times are multiples of the slide; dense and sparse stretches, as clusters and as pairs."""
    window, slide, period, k = geometry
    s, rng = Sliding(window=window, slide=slide, radius=1.0, k=k), random.Random(5)
    centers, rows = [(0.0,) * 5, (3.0,) * 5, (9.0, 0.0, 9.0, 0.0, 9.0)], []
    for device in (1, 2):
        t = 10_000 * device
        for n in range(160):
            t += rng.choice([1, 1, 1, 2]) * period + (5 * window if n == 90 else 0)
            spread = 0.2 if n // 20 % 2 == 0 else 1.5
            rows.append((device, t, *[v + rng.gauss(0, spread) for v in rng.choice(centers)]))
    points = spark.createDataFrame(rows, "device long, ts long, x0 double, x1 double, x2 double, x3 double, x4 double")
    want, sizes = {}, {}
    for d, t, *x in rows:
        for end in range((t // slide + 1) * slide, t + window + 1, slide):
            held = [(u, y) for e, u, *y in rows if e == d and end - window <= u < end]
            sizes[d, end] = len(held)
            n = sum(math.dist(x, y) <= 1.0 for u, y in held if u != t)
            if n < k:
                want[d, t, end] = n
    got = {(r["device"], r["ts"], r["window_end"]): r["neighbours"] for r in outliers.outliers(points, s).collect()}
    assert got == want and want
    assert {(r["device"], r["window_end"]): r["points"] for r in outliers.window_sizes(points, s).collect()} == sizes
    clustered = sorted((r["device"], r["ts"], r["window_end"]) for r in outliers.clustered_outliers(points, s, span=3).collect())
    assert clustered == sorted(want)
    rates = {}
    for (d, _, end), n in want.items():
        rates[d, end] = rates.get((d, end), 0) + 1
    p = {(r["device"], r["k"]): (r["slides"], r["mean_rate"]) for r in outliers.probe(points, s, [0.5, 1.0], [k, k + 2]).where("radius = 1.0").collect()}
    for d in (1, 2):
        mine = [e for e in sizes if e[0] == d]
        assert p[d, k] == (len(mine), pytest.approx(sum(rates.get(e, 0) / sizes[e] for e in mine) / len(mine)))
