"""Work that must not be done again, or exchanged, as tables grow."""

from sensorloom.plans import basic, bindings, decisions

SF = "/root/testdata/sf0.01"


def test_ks_exact_deals_rows_once(spark, monkeypatch):
    monkeypatch.setattr(bindings, "ROWS_A_TASK", 500)
    got = basic.ks_exact(spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert bindings.values(spark, SF).rdd.getNumPartitions() == -(-rows // 500)


def test_states_are_taken_once(spark, monkeypatch):
    calls, states = [], decisions.states
    monkeypatch.setattr(decisions, "states", lambda *a: calls.append(a) or states(*a))
    decisions.decided(spark, SF)
    assert len(calls) == 1
