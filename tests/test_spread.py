"""Quartiles of degenerate(), held against DuckDB where the last bit decides."""

import duckdb

from sensorloom.operators import profile

#: With both products rounded, the first has an IQR above 50 and the second one of at most 50; then plain ones.
CASES = [[9.28, 13.92, 62.01, 65.01], [17.6, 19.81, 68.29, 72.16], [1.0, 2.0, 2.0, 7.0, 40.0], [3.0], [0.0, 10.0, 90.0, 100.0], [1.0, 2.0, float('inf'), float('inf')]]


def test_spread_of_exactly_epsilon(spark):
    rows = [(d, "view", x) for d, xs in enumerate(CASES) for x in (*xs, None)]
    got = profile.degenerate(spark.createDataFrame(rows, "device long, sensor string, value double"), 50.0).collect()
    db = duckdb.connect()
    db.execute("CREATE TABLE readings (device BIGINT, sensor VARCHAR, value DOUBLE)")
    db.executemany("INSERT INTO readings VALUES (?, ?, ?)", rows)
    want = db.sql("SELECT device, sensor, n, iqr FROM (SELECT device, sensor, count(value) AS n, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM readings GROUP BY ALL) WHERE iqr <= 50").fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert [r[0] for r in sorted(want)] == [0, 2, 3]
