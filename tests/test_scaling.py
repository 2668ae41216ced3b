"""Statistics of a day and the site condition against plain computation."""

import numpy as np
import pytest

from sensorloom.operators import fleet, scaling


@pytest.mark.parametrize("bins", [1, 4, 20])
def test_day_stats(spark, bins):
    rng = np.random.default_rng(bins)
    ref = {d: np.round(rng.normal(10, 2, 60 + d), 1) for d in (1, 2)}  # many ties
    ref[3] = np.array([5.0])
    days = {(d, t): np.round(rng.normal(10 + t, 2, 25), 1) for d in ref for t in (0, 1)}
    days[3, 2] = np.array([4.0, 5.0, 5.0, 6.0])
    values = [(d, 0, float(x)) for d, xs in ref.items() for x in xs] + [(1, 0, None)]
    own = [(d, t, 0, float(x)) for (d, t), xs in days.items() for x in xs] + [(9, 0, 0, 1.0), (1, 0, 0, None)]
    r = spark.createDataFrame(values, "device long, channel int, x double")
    o = spark.createDataFrame(own, "device long, day long, channel int, x double")
    got = {(g["device"], g["day"]): g for g in scaling.day_stats(o, scaling.reference_model(r, bins), bins).collect()}
    edges = {d: sorted({np.sort(xs)[j * (len(xs) - 1) // bins] for j in range(bins + 1)}) for d, xs in ref.items()}
    found = {}
    for e in scaling.reference_edges(r, bins).collect():
        found.setdefault(e["device"], []).append(e["edge"])
    assert {d: sorted(v) for d, v in found.items()} == edges
    place = lambda d, x: edges[d].index(x) + 1 if x in edges[d] else 0 if x < edges[d][0] else sum(e < x for e in edges[d]) + 1
    assert sorted(got) == sorted(days)  # device 9 has no reference
    for (d, t), xs in days.items():
        a = np.bincount([place(d, x) for x in xs], minlength=bins + 3)
        b = np.bincount([place(d, x) for x in ref[d]], minlength=bins + 3)
        g, width = got[d, t], np.percentile(ref[d], 90) - np.percentile(ref[d], 10)
        assert g["n"] == len(xs) and g["max_cell_mass"] == pytest.approx(a.max() / len(xs))
        assert g["d"] == pytest.approx(np.abs(a.cumsum() / len(xs) - b.cumsum() / len(ref[d])).max())
        if width > 0:
            assert g["shift"] == pytest.approx((np.median(xs) - np.median(ref[d])) / width)
            assert g["width_x"] == pytest.approx((np.percentile(xs, 90) - np.percentile(xs, 10)) / width)
        else:
            assert g["shift"] is None and g["width_x"] is None


def test_site_needs_baseline_and_flags(spark):
    rules = fleet.Rules(tick=86400)
    # Flagged from day 9 on; the mean leaves its baseline of ten days on day 12. Device 2 has no reference.
    rows = [(dev, d * 86400, d >= 9, False, 20.0 if d >= 12 else 10.0) for dev in (1, 2) for d in range(16)]
    f = spark.createDataFrame(rows, "device long, tick long, pflag boolean, cflag boolean, mean0 double")
    f = f.selectExpr("*", "mean0 AS mean1", "mean0 AS mean2", "mean0 * 2 AS sum0", "mean0 * 2 AS sum1", "mean0 * 2 AS sum2", "2L AS n0", "2L AS n1", "2L AS n2")
    ref = spark.createDataFrame([(1, 0, 5.0, None, None)], "device long, frozen long, width0 double, width1 double, width2 double")
    out = {(r["device"], r["tick"] // 86400): r for r in fleet.site_flags(f, ref, rules).collect()}
    assert [d for (dev, d), r in sorted(out.items()) if r["site"]] == [12, 13, 14, 15]
    assert not any(r["off"] for (dev, d), r in out.items() if d < 12 or dev == 2)
    assert out[1, 11]["past"] == 2 and not out[1, 11]["site"]
