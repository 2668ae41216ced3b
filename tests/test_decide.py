"""Daily decisions: which level, when, why, and what suppresses it."""

import pytest
from sensorloom.operators import decide
from sensorloom.operators.decide import DAY, Decision

DEVICES, FIRST, GAS, LIGHT = 8, 100, 3, 4


def run(spark, days, deviating=(), spans=(), models=None, rule=None, unjudged=()):
    """Commands and the rest of `days` days from FIRST on; deviating (device, channel, day), spans (device, since, until), days counted from 0."""
    states = [(d, FIRST + k, c, (d, k) not in unjudged, (d, c, k) in deviating) for d in range(DEVICES) for k in range(days) for c in range(5)]
    states = spark.createDataFrame(states, "device long, day long, channel int, evaluable boolean, deviated boolean")
    models = [(d, FIRST * DAY, "online") for d in range(DEVICES)] if models is None else models
    models = spark.createDataFrame([(d, int(at), k) for d, at, k in models], "device long, at long, kind string")
    spans = spark.createDataFrame([(d, int(a), None if b is None else int(b)) for d, a, b in spans], "device long, since long, until long")
    closed = decide.closed_spans(spans, models)
    got = decide.decisions(decide.triggers(states, closed, rule or Decision()), models, rule or Decision()).orderBy("device", "day", "kind").collect()
    return [r for r in got if r["kind"] == "COMMAND"], [r for r in got if r["kind"] != "COMMAND"], decide.span_reviews(closed).collect()


def at(day, hour=0):
    return (FIRST + day) * DAY + hour * 3600


def gist(rows):
    return [(r["device"], r["day"] - FIRST, r["level"], r["cell"]) for r in rows]


def test_a_score_alone_asks_for_retraining_once_it_has_passed_a_midnight(spark):
    commands, rest, _ = run(spark, 3, spans=[(1, at(0, 20), None)])
    assert gist(commands) == [(1, 1, 1, "score alone")] and not rest
    assert commands[0]["effective_at"] == at(3) and commands[0]["triggers"] == "perf" and commands[0]["scope"] == "local"


def test_both_layers_or_data_alone(spark):
    commands, _, _ = run(spark, 3, [(0, GAS, 1)], [(0, at(1, 12), None)])
    assert gist(commands)[0] == (0, 1, 1, "both layers") and commands[0]["forms"] == "3:both layers"
    commands, _, _ = run(spark, 4, [(0, GAS, 1), (0, GAS, 2)])
    assert gist(commands) == [(0, 2, 0, "data alone")] and commands[0]["forms"] == "3:two days"


def test_the_same_channel_anew_after_re_estimation(spark):
    two = [(0, GAS, 1), (0, GAS, 2)]
    commands, _, _ = run(spark, 8, [*two, (0, GAS, 5), (0, GAS, 6)])
    assert gist(commands) == [(0, 2, 0, "data alone"), (0, 6, 1, "channel anew after re-estimation")]
    assert gist(run(spark, 15, [*two, (0, GAS, 12), (0, GAS, 13)])[0])[1][2] == 0  # too late
    assert gist(run(spark, 8, [*two, (0, LIGHT, 5), (0, LIGHT, 6)])[0])[1][2] == 0  # another channel


def test_level_two_after_level_one_whose_cooldown_leaves_level_zero_free(spark):
    done = at(3) + 3 * DAY
    commands, _, _ = run(spark, 9, [(0, GAS, 3), (0, GAS, 4)], [(0, at(0, 20), at(2, 7)), (0, done + 12 * 3600, None)])
    assert [g[1:3] for g in gist(commands)] == [(1, 1), (4, 0), (7, 2)] and commands[2]["cell"] == "confirmed anew after retraining"


def test_cooldown_of_level_one_holds_level_one_alone(spark):
    spans = [(1, at(0, 20), at(2, 7)), (1, at(3, 6), at(5, 7)), (1, at(9, 6), None)]
    assert [g[1:3] for g in gist(run(spark, 12, spans=spans)[0])] == [(1, 1), (10, 2)]


def test_a_switch_of_the_model_ends_a_confirmed_span(spark):
    online = [(d, at(0), "online") for d in range(DEVICES)]
    commands, _, ended = run(spark, 3, spans=[(1, at(0, 20), None)], models=[*online, (1, at(1, 6), "switch")])
    assert not commands and [(r["device"], r["day"] - FIRST, r["kind"]) for r in ended] == [(1, 1, "SEGMENT_ENDED")]


def test_levels_wait_for_a_model_that_is_online(spark):
    commands, rest, _ = run(spark, 3, spans=[(1, at(0, 20), None)], models=[])
    assert not commands and gist(rest) == [(1, 1, 1, "score alone; model offline"), (1, 2, 1, "score alone; model offline")]
    commands, rest, _ = run(spark, 3, [(0, GAS, 1)], [(0, at(1, 12), None)], models=[])
    assert gist(commands) == [(0, 1, 0, "level 1 suppressed, model offline")] and rest[0]["cell"] == "both layers; model offline"
    spans = [(1, at(0, 20), at(1, 7)), (1, at(2, 6), None)]
    assert [g[1:3] for g in gist(run(spark, 5, spans=spans, models=[(1, at(3), "online")])[0])] == [(3, 1)]


@pytest.mark.parametrize("word, levels", [("switch", [(1, 1), (7, 2)]), ("failed", [(1, 1), (7, 1)]), (None, [(1, 1)])])
def test_cooldown_and_upgrade_count_from_the_models_own_events(spark, word, levels):
    online = [(d, at(0), "online") for d in range(DEVICES)]
    spans = [(1, at(0, 20), at(2, 7)), (1, at(3, 6), at(5, 7)), (1, at(6, 12), None)]
    commands, rest, _ = run(spark, 12, spans=spans, models=[*online, *([(1, at(6), word)] if word else [])], rule=Decision(events=True))
    assert [g[1:3] for g in gist(commands)] == levels
    assert any(r["day"] - FIRST == 4 and r["cell"] == "score alone; retraining" for r in rest)


def test_a_retraining_without_a_word_times_out(spark):
    online = [(d, at(0), "online") for d in range(DEVICES)]
    commands, rest, _ = run(spark, 22, spans=[(1, at(0, 20), at(2, 7)), (1, at(19, 6), None)], models=online, rule=Decision(events=True))
    late = [r for r in rest if r["kind"] == "RETRAIN_TIMEOUT"]
    assert [(r["day"] - FIRST, r["seq"], r["effective_at"]) for r in late] == [(17, 1, at(3))]
    assert [g[1:3] for g in gist(commands)] == [(1, 1), (20, 1)]  # and the next one is free to go


def test_scope_and_shared_counts(spark):
    six = [(d, GAS, k) for d in range(6) for k in (1, 2)]
    commands, _, _ = run(spark, 3, [*six, (6, LIGHT, 1), (6, LIGHT, 2), (0, LIGHT, 1), (0, LIGHT, 2)])
    by = {r["device"]: r for r in commands}
    assert [by[d]["scope"] for d in range(7)] == ["global"] * 6 + ["local"]
    assert by[0]["co"] == 7 and by[1]["co"] == 6 and by[6]["co"] == 2 and by[0]["triggers"] == "3|4"
    # With fewer devices present the threshold falls, and days that can't be judged trigger nothing.
    commands, _, _ = run(spark, 3, [(d, GAS, k) for d in range(3) for k in (1, 2)], unjudged={(d, 2) for d in range(2, 8)})
    assert [(r["device"], r["scope"], r["co"]) for r in commands] == [(0, "global", 2), (1, "global", 2)]


def test_a_trigger_commands_once_until_it_falls(spark):
    days = [(0, GAS, k) for k in (1, 2, 3, 4, 5, 6)]
    assert [g[1] for g in gist(run(spark, 9, days)[0])] == [2]
