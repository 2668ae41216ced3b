"""Critical values against the JVM's distributions; bursts, Hoeffding alarms, confirmed spans and delays against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import drift
from sensorloom.plans import decisions, registry, windowed

SF = "/root/testdata/sf0.01"


def series(spark, column="value"):
    out = {}
    for r in windowed.elements(spark, SF).orderBy("device", "ts").collect():
        out.setdefault(r["device"], []).append((r["ts"], r[column]))
    return out


@pytest.mark.parametrize("confidence, rho", [(0.99, 0.5), (0.999, 0.25)])
def test_table_against_the_jvm(spark, confidence, rho):
    """Cut and critical values by their definition, every cut tried, with the quantiles of another library."""
    maths = spark._jvm.org.apache.commons.math3.distribution
    p = confidence**0.25
    f_of = lambda a, b: maths.FDistribution(None, float(a), float(b), 1e-15).inverseCumulativeProbability(p)
    t_of = lambda df: maths.TDistribution(None, float(df), 1e-15).inverseCumulativeProbability(p)

    def free(c, w, f):
        a, b = 1 / c, f / (w - c)
        return (a + b) ** 2 / (a * a / (c - 1) + b * b / (w - c - 1))

    table = drift.tables(confidence, rho, 2016).set_index("w")
    for w in (30, 31, 47, 64, 100, 257):
        found = 0
        for c in range(w - 2, 1, -1):
            f = f_of(c - 1, w - c - 1)
            if rho - t_of(free(c, w, f)) * math.sqrt(1 / c + f / (w - c)) >= 0:
                found = c
                break
        own = table.loc[w]
        cut = found or w // 2
        assert (own["cut"], own["root_found"]) == (cut, found > 0), w
        f = f_of(cut - 1, w - cut - 1)
        assert own["f_crit"] == pytest.approx(f, rel=1e-6) and own["t_crit"] == pytest.approx(t_of(free(cut, w, f)), rel=1e-6)
    for w in (500, 2016):
        c = int(table.loc[w]["cut"])
        f = f_of(c - 1, w - c - 1)
        assert table.loc[w]["f_crit"] == pytest.approx(f, rel=1e-6) and table.loc[w]["t_crit"] == pytest.approx(t_of(free(c, w, f)), rel=1e-6)


def test_bursts_against_plain_loops(spark):
    """Size, peak and duration of each burst, given the alarms on the rate."""
    table, want = drift.lookup(0.99, 0.5, 2016), []
    for device, rows in series(spark).items():
        bins = {}
        for ts, x in rows:
            a = bins.setdefault(ts // 40 * 600, [0, 0])
            a[0] += 1
            a[1] += x > 150
        at = sorted(bins)
        rate = {t: bins[t][1] / bins[t][0] for t in at}
        detector = drift.Detector(table, 2016)
        for k, t in enumerate(at):
            if detector.update(rate[t]) is None:
                continue
            inside = [u for u in at if t <= u <= t + 3600]
            first, last = k, k
            while first and rate[at[first - 1]] > 0:
                first -= 1
            while rate[t] > 0 and last + 1 < len(at) and rate[at[last + 1]] > 0:
                last += 1
            # Emitted with the first bin after both its time and its run.
            done = next((u for j, u in enumerate(at) if j > k and u > t + 3600 and (rate[t] == 0 or j > last)), None)
            if done is not None:
                want.append((device, t, sum(bins[u][1] for u in inside), round(max(rate[u] for u in inside), 9), (last if rate[t] > 0 else k - 1) - first + 1, done + 600))
    got = [(r["device"], r["ts"], r["size"], round(r["peak"], 9), r["duration"], r["emitted_at"]) for r in registry.queries()["burst"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and got


def test_hoeffding_alarms_against_plain_lists(spark):
    """Weighted means and squared weights taken anew from lists at every element."""
    weight, alarm, want = 0.05, 0.001, []
    bound = lambda squares: math.sqrt(squares * math.log(1 / alarm) / 2)

    def weighted(flags):
        w = np.array([(1 - weight) ** (len(flags) - 1)] + [weight * (1 - weight) ** (len(flags) - 1 - k) for k in range(1, len(flags))])
        return float(w @ flags), float(w @ w)

    for device, rows in series(spark).items():
        whole, low, after = [], None, []
        for ts, x in rows:
            whole.append(float(x > 30))
            if len(whole) == 1:
                low, after = weighted(whole), []
                continue
            now = weighted(whole)
            if now[0] + bound(now[1]) < low[0] + bound(low[1]):
                low, after = now, []
                continue
            after.append(whole[-1])
            mean, squares = weighted(after)
            if mean - low[0] > bound(low[1] + squares):
                want.append((device, ts))
                whole = []
    got = sorted(map(tuple, registry.queries()["hddm_w"](spark, SF).collect()))
    assert got == sorted(want) and got


def test_confirmed_spans_against_plain_loops(spark):
    found, rows = registry.queries()["perf_tracker"](spark, SF).collect(), series(spark)
    assert found
    for r in found:
        s = rows[r["device"]]
        until = next((ts for k, (ts, _) in enumerate(s) if ts > r["since"] and k >= 5 and np.median([x for _, x in s[k - 5 : k + 1]]) <= r["threshold"]), None)
        assert r["until"] == until


def test_delays_against_plain_loops(spark):
    alerts = [(r["device"], r["tick"]) for r in decisions.labelled(spark, SF).select("device", "tick").collect()]
    commands = [(r["device"], r["effective_day"] * 86_400) for r in decisions.asked(spark, SF).collect()]
    first = lambda rows, device, a, b: min((t - a for d, t in rows if d == device and a <= t <= b), default=None)
    want = sorted((n, first(alerts, d, a, b), first(commands, d, a, b)) for n, d, a, b in decisions.FAULTS)
    assert sorted(map(tuple, registry.queries()["latency_table"](spark, SF).select("fault", "to_alert", "to_command").collect())) == want


def test_copied_days_are_found(spark):
    """Streams of the copied days stand a week before, all of their times."""
    start = windowed.START // 86_400
    copies = registry.queries()["shifted_copies"](spark, SF).where(F.col("day").between(start + 10, start + 14) & (F.col("device") % 4 == 0)).collect()
    assert len(copies) > 20 and all(r["shift"] == -7 and r["hits"] == r["n"] for r in copies)
