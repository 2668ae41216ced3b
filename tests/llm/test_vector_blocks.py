"""Parts and groups of the vector searches: what is shuffled does not grow with their pairs, and results hold for any of their sizes."""

from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

from sensorloom.llm import exact_topk, vectors, vptree


def some(spark, n=900, width=6):
    x = np.random.default_rng(3).normal(0, 1, (n, width)).astype(np.float32)
    x[100:140] = x[100]  # ties
    return x, spark.createDataFrame([(50 * k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("search", [exact_topk.found_products, vptree.found_near])
def test_rows_are_not_shuffled_for_each_group(spark, monkeypatch, search):
    """Pairs of rows and groups are read, not written: what search() returns has no exchange."""
    monkeypatch.setattr(vectors, "QUERY_ROWS", 40)
    found = search(some(spark)[1], shard_rows=64)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan, plan


@pytest.mark.parametrize("query_rows, tasks, task_parts", [(40, 1, 4), (40, 64, 256), (1024, 3, 1)])
def test_any_groups_and_tasks(spark, monkeypatch, query_rows, tasks, task_parts):
    """Tasks that go through many parts or one, with one group or many: exact, ties by id, no query without its rows."""
    for name, value in (("QUERY_ROWS", query_rows), ("TASKS", tasks), ("TASK_PARTS", task_parts)):
        monkeypatch.setattr(vectors, name, value)
    x, v = some(spark)
    w, x = np.floor(1024 * x.astype(float)), x.astype(float)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in exact_topk.top_products(v, shard_rows=64).collect()}
    near = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vptree.nearest(v, shard_rows=64).collect()}
    assert len(got) == len(near) == 4500
    for k in range(0, 900, 2):
        s, d = w @ w[k], np.sqrt(((x - x[k]) ** 2).sum(1))
        s[k], d[k] = -1e18, 1e18
        assert [got[50 * k, r + 1] for r in range(10)] == [(50 * j, s[j]) for j in np.argsort(-s, kind="stable")[:10]]
        assert [near[50 * k, r + 1] for r in range(10)] == [(50 * j, d[j]) for j in np.argsort(d, kind="stable")[:10]]


def test_narrow_rows():
    """The narrowest kind that is exact; rows of different kinds and lengths come back as they were."""
    whole, single, double = np.array([[3.0, -32768.0]]), np.array([[0.5, 70000.0]]), np.array([[0.1, 1e300]])
    assert [vectors.narrow(m).dtype.char for m in (whole, single, double)] == ["h", "f", "d"]
    rows = [r for m in (whole, single, double, np.array([[7.0]]), np.zeros((1, 0))) for r in vectors.narrow_rows(m)]
    assert (vectors.wide_rows(pd.Series(rows), 2) == np.vstack([whole, single, double, [[7.0, 0.0]], [[0.0, 0.0]]])).all()
    assert (vectors.wide_block(vectors.narrow_block(single), 2) == single).all()


def test_readers_of_parts_take_few_at_once(spark, monkeypatch):
    """A reader takes thousands of rows at once, each of which may be a part of a megabyte: row groups end before that."""
    for name, value in (("ROW_GROUP", 2000), ("TASKS", 1)):
        monkeypatch.setattr(vectors, name, value)
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(folder.iterdir())
    exact_topk.found_products(some(spark)[1], shard_rows=64)
    files = [pq.ParquetFile(f) for p in set(folder.iterdir()) - before if p.name.startswith("parts-") for f in p.glob("*.parquet")]
    groups = [f.metadata.row_group(k) for f in files for k in range(f.metadata.num_row_groups)]
    assert sum(g.num_rows for g in groups) >= 15 and max(g.total_byte_size for g in groups) < 5000
