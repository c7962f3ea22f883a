import math
import random

import pytest

from aerotrace.operators.engagement import nearest_opponent, outcome_score, pairs

NAMES = ["Eagle", "Eagle 2", "Fox", "Owl", "", None]


def folded(row, kills, lookback, tau):
    """Kill after kill, in order of time, as the score is defined."""
    t, own, other = row
    part = lambda name, whole: bool(name) and name in (whole or "")
    score = 0.0
    for at, _, killer, victim in sorted(kills, key=lambda k: (k[0], k[1], k[2] or "", k[3] or "")):
        if not t <= at or not at - lookback <= t:
            continue
        d = math.exp(-(at - t) / tau)
        score = max(score, d) if part(own, killer) else min(score, -d) if part(other, killer) else score
        score = min(score, -d) if part(own, victim) else max(score, d) if part(other, victim) else score
    return score


def test_against_kill_after_kill(spark):
    rng = random.Random(11)
    rows = [(rng.choice("ab"), float(rng.randint(0, 60)) / 2, rng.choice(NAMES), rng.choice(NAMES), i) for i in range(600)]
    kills = [(rng.choice("abc"), float(rng.randint(0, 80)) / 2, str(rng.randint(0, 5)), rng.choice(NAMES), rng.choice(NAMES)) for _ in range(70)]
    df = spark.createDataFrame(rows, "source string, time double, self_name string, enemy_name string, row int").selectExpr("*", "'x' AS self_object_id", "'y' AS enemy_object_id")
    told = spark.createDataFrame(kills + kills[:5], "source string, time double, victim_id string, killer_name string, victim_name string")
    for lookback, tau in ((15.0, 5.0), (3.0, 1.0)):
        got = outcome_score(df, told, lookback=lookback, tau=tau)
        assert got.columns == [*df.columns, "score"]
        want = {i: folded((t, a, b), [k[1:] for k in kills if k[0] == s], lookback, tau) for s, t, a, b, i in rows}
        assert {r.row: r.score for r in got.collect()} == {i: pytest.approx(v, abs=1e-12) for i, v in want.items()}
        assert len({v > 0 for v in want.values()}) == 2


def test_no_row_meets_a_list_of_kills(spark):
    df = spark.createDataFrame([("a", 1.0, "x", "y")], "source string, time double, self_name string, enemy_name string")
    kills = spark.createDataFrame([], "source string, time double, victim_id string, killer_name string, victim_name string")
    out = outcome_score(df, kills)
    assert [r.score for r in out.collect()] == [0.0] and outcome_score(df.filter("false"), kills).collect() == []
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_columns_that_nobody_asks_for_are_not_sorted(spark):
    df = spark.range(9).selectExpr("'a' AS source", "CAST(id AS DOUBLE) AS time", "'x' AS self_name", "'y' AS enemy_name", "id * 7 AS ballast")
    kills = spark.range(2).selectExpr("'a' AS source", "CAST(id AS DOUBLE) + 3 AS time", "'v' AS victim_id", "'x' AS killer_name", "'y' AS victim_name")
    out = outcome_score(df, kills)
    assert out.columns == [*df.columns, "score"] and sorted(r.ballast for r in out.collect()) == [7 * i for i in range(9)]
    plan = out.select("time", "score")._jdf.queryExecution().optimizedPlan().toString()
    assert "ballast" not in plan
    assert "DESC" not in plan  # one order of the rows
    state = spark.range(4).selectExpr("'f' AS source", "0 AS frame_idx", "0d AS time", "id AS ord", "CAST(id AS STRING) AS object_id", "'n' AS name", "'' AS coalition", "'Air+FixedWing' AS obj_type", "id * 10d AS world_x", "500d AS world_y", "0d AS world_z", "500d AS altitude", "100d AS speed", "0d AS mach", "0d AS yaw", "0d AS pitch", "0d AS roll", "0d AS aoa", "id * 3d AS g_load")
    met = pairs(state)
    assert met.count() == 6 and "g_load" not in met.select("self_object_id", "enemy_object_id")._jdf.queryExecution().optimizedPlan().toString()


def objects(rng, n, spread):
    """Points of a lattice, so that many distances are equal; on edges of cells too, and below zero."""
    step = 5000
    rows = []
    for i in range(n):
        kind = rng.choice(["Air+FixedWing"] * 4 + ["Ground+Static"])
        rows.append(("f", i % 2, float(i % 2), i, f"o{i}", f"n{i}", rng.choice(["Blue", "Red", ""]), kind, *(float(step * rng.randint(-spread, spread)) for _ in range(2)), float(rng.choice([0, 3000, 6000])), float(rng.choice([10, 30, 200]))))
    return rows


@pytest.mark.parametrize("spread", [3, 200])
def test_pairs_and_nearest_in_cells_against_all_pairs(spark, spread):
    rows = objects(random.Random(spread), 160, spread)
    names = "source string, frame_idx int, time double, ord int, object_id string, name string, coalition string, obj_type string, world_x double, world_z double, altitude double, speed double"
    df = spark.createDataFrame(rows, names).selectExpr("*", "altitude AS world_y", "0d AS mach", "0d AS yaw", "0d AS pitch", "0d AS roll", "0d AS aoa", "1d AS g_load")
    far = lambda a, b: math.dist((a[8], a[10], a[9]), (b[8], b[10], b[9]))
    oppose = lambda a, b: not (a[6] and b[6] and a[6] == b[6])
    flying = [r for r in rows if r[7].startswith("Air")]
    want = {(a[1], a[4], b[4]): far(a, b) for a in flying for b in flying if a[1] == b[1] and a[3] < b[3] and oppose(a, b) and min(a[11], b[11]) >= 50 and min(a[10], b[10]) >= 100 and far(a, b) <= 10_000}
    got = pairs(df).collect()
    assert len(got) == len(want) and {(r.frame_idx, r.self_object_id, r.enemy_object_id): r.distance_raw for r in got} == want
    best = {}
    for a in flying:
        found = [(far(a, b), b[3], b[4]) for b in flying if a[1] == b[1] and a[4] != b[4] and oppose(a, b) and b[11] >= 20 and b[10] >= 100]
        if found:
            best[a[1], a[4]] = (min(found)[2], min(found)[0])
    for rings in ((20_000.0, 160_000.0), (5000.0,), ()):
        near = nearest_opponent(df, rings=rings).collect()
        assert len(near) == len(best) and {(r.frame_idx, r.object_id): (r.enemy_id, r.distance) for r in near} == best
