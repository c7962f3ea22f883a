import numpy as np
import pytest
from pyspark.sql import functions as F

from aerotrace.operators import features, series
from aerotrace.operators.features import window_features
from aerotrace.operators.windows import asof_join, range_join, sliding_windows
from aerotrace.schema import FEATURES, SIGNALS

BY = ["object_id"]


def irregular(n=80, seed=1):
    rng = np.random.default_rng(seed)
    t = np.cumsum(rng.uniform(0.05, 0.4, n))
    t[n // 2 :] += 1.7
    walk = lambda scale: np.cumsum(rng.normal(0, scale, n))
    return {"time": t, "altitude": walk(3), "world_x": walk(20), "world_y": 5000 + walk(3), "world_z": walk(20), "yaw": np.mod(walk(25), 360), "pitch": walk(2), "roll": np.mod(walk(30) + 180, 360) - 180}


def frame(spark, data, key="a"):
    names = ["object_id", *data]
    return spark.createDataFrame([(key, *(None if x != x else float(x) for x in row)) for row in zip(*data.values())], ", ".join(f"{n} {'string' if n == 'object_id' else 'double'}" for n in names))


def numpy_steps(data, width=3):
    t = data["time"]
    un = dict(data)
    for c in ("yaw", "roll"):
        un[c] = np.rad2deg(np.unwrap(np.deg2rad(data[c])))
    grid = np.arange(t[0], t[-1] + 0.1, 0.2)
    out = {c: np.interp(grid, t, un[c]) for c in SIGNALS}
    gaps = np.zeros(len(grid))
    for a, b in zip(t[:-1], t[1:]):
        if b - a > 1:
            gaps[(grid > a) & (grid < b)] = 1
    roll = lambda x: np.array([x[max(0, i - 1) : i + 2].mean() for i in range(len(x))])
    out = {c: roll(v) for c, v in out.items()}
    out["altitude"] = out["world_y"]
    v = np.stack([np.gradient(out[f"world_{c}"], grid) for c in "xyz"], 1)
    a = np.stack([np.gradient(v[:, i], grid) for i in range(3)], 1)
    cross, speed = np.linalg.norm(np.cross(v, a), axis=1), np.linalg.norm(v, axis=1)
    out |= {"time": grid, "long_gap_flag": gaps, "speed": roll(speed), "g_load": roll(np.sqrt(1 + (cross / speed / 9.80665) ** 2)), "turn_rate": roll(np.degrees(cross / speed**2)), "vertical_speed": v[:, 1]}
    return out | {f"{c}_rate": np.gradient(out[c], grid) for c in ("yaw", "roll", "pitch")}


def test_preprocess_matches_numpy(spark):
    data = irregular()
    want = numpy_steps(data)
    got = series.preprocess(frame(spark, data).orderBy(F.rand(3)), BY).orderBy("time").toPandas()
    assert len(got) == len(want["time"])
    for c, x in want.items():
        np.testing.assert_allclose(got[c].to_numpy(), x, rtol=1e-8, atol=1e-7, err_msg=c)


def test_short_and_empty_series(spark):
    data = irregular()
    assert series.preprocess(frame(spark, data).filter("false"), BY).count() == 0
    one = series.preprocess(frame(spark, {k: v[:1] for k, v in data.items()}), BY).collect()
    assert len(one) == 1 and one[0].speed == 0 and one[0].long_gap_flag == 0
    assert window_features(series.preprocess(frame(spark, {k: v[:5] for k, v in data.items()}), BY), BY).count() == 0


def test_nulls_interpolate_and_count_as_missing(spark):
    data = irregular()
    data["yaw"] = data["yaw"].copy()
    data["yaw"][10:14] = np.nan
    got = series.preprocess(frame(spark, data), BY).toPandas()
    assert got["yaw"].notna().all() and 0 < got["raw_missing_any"].max() <= 1


def test_resample_of_several_series_with_ties_nulls_and_gaps(spark):
    rng = np.random.default_rng(5)
    given = {}
    for key in "abc":
        data = irregular(60, seed=ord(key))
        data["time"] = np.round(data["time"], 1)  # some fall on one time or on grid points
        data["time"] -= data["time"][0] - 0.5 * (key == "b")
        data["world_x"] = np.where(rng.random(60) < 0.3, np.nan, data["world_x"])
        data["world_z"] = np.full(60, np.nan)
        _, last = np.unique(data["time"][::-1], return_index=True)
        given[key] = {k: v[np.sort(59 - last)] for k, v in data.items()}  # one row a time
    df = frame(spark, given["a"], "a").union(frame(spark, given["b"], "b")).union(frame(spark, given["c"], "c"))
    twice = df.union(df)
    rows = series.resample(series.source_rows(df, BY), BY).orderBy("object_id", "time").toPandas()
    again = series.resample(series.source_rows(twice, BY), BY).orderBy("object_id", "time").toPandas()
    assert rows.equals(again)
    for key, data in given.items():
        t, got = data["time"], rows[rows.object_id == key]
        grid = t[0] + np.arange(np.ceil((t[-1] + 0.1 - t[0]) / 0.2)) * ((t[0] + 0.2) - t[0])
        np.testing.assert_array_equal(got["time"], grid)
        for c in ("world_x", "world_y", "yaw"):
            some = ~np.isnan(data[c])
            np.testing.assert_allclose(got[c], np.interp(grid, t[some], data[c][some]), rtol=1e-9, atol=1e-9)
        assert got["world_z"].isna().all()
        before = t[np.searchsorted(t, grid, "right") - 1]
        after = np.append(t, np.nan)[np.searchsorted(t, grid, "right")]
        np.testing.assert_array_equal(got["long_gap_flag"], ((after - before > 1) & (before < grid)).astype(float))


def test_windows_are_closed_whole_and_anchored(spark):
    x = frame(spark, {"time": np.arange(0, 12.01, 0.5)})
    got = sliding_windows(x, BY).groupBy("window", "window_start").agg(F.min("time"), F.max("time"), F.count("*")).orderBy("window").collect()
    assert [tuple(r) for r in got] == [(0, 0.0, 0.0, 5.0, 11), (1, 2.5, 2.5, 7.5, 11), (2, 5.0, 5.0, 10.0, 11)]


def test_a_grid_that_ends_a_rounding_error_early_keeps_its_window(spark):
    times = [1.0 + i * ((1.0 + 0.2) - 1.0) for i in range(26)]  # what resample makes of a series from 1 to 6
    assert times[-1] - times[0] < 5.0
    got = sliding_windows(spark.createDataFrame([("a", t) for t in times], "object_id string, time double"), BY)
    assert [tuple(r) for r in got.groupBy("window", "window_start").agg(F.count("*")).collect()] == [(0, 1.0, 26)]


def test_features_of_a_straight_flight(spark):
    t = np.arange(0, 10.01, 0.2)
    data = {"time": t, "altitude": 0 * t, "world_x": 100 * t, "world_y": 1000 + 0 * t, "world_z": 0 * t, "yaw": 0 * t, "pitch": 0 * t, "roll": 0 * t}
    rows = window_features(series.preprocess(frame(spark, data), BY), BY).orderBy("window_start").collect()
    assert len(rows) == 3 and set(FEATURES) < set(rows[0].asDict())
    r = rows[1]
    assert r.speed_mean == pytest.approx(100) and r.g_mean == pytest.approx(1) and r.turn_rate_peak == pytest.approx(0, abs=1e-6) and r.short_window_count >= 15 and r.sensor_conflict == 0


def brute_asof(left, right, direction, tolerance=None):
    out = {}
    for k, t in left:
        own = [(r, v) for key, r, v in right if key == k]
        if direction == "backward":
            own = [x for x in own if x[0] <= t]
        elif direction == "forward":
            own = [x for x in own if x[0] >= t]
        best = min(own, key=lambda x: (abs(x[0] - t), x[0]), default=None)
        out[k, t] = best[1] if best and (tolerance is None or abs(best[0] - t) <= tolerance) else None
    return out


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tolerance", [None, 1.0])
@pytest.mark.parametrize("bucket", [None, 3.0])
def test_asof_join(spark, direction, tolerance, bucket):
    rng = np.random.default_rng(2)
    left = sorted({(k, float(t)) for k in "ab" for t in rng.integers(0, 40, 15)} | {("c", 1.0)})
    right = sorted({(k, float(t) + 0.5 * float(t % 2)): i for i, (k, t) in enumerate((k, t) for k in "ab" for t in rng.integers(0, 40, 10))}.items())
    right = [(k, t, i) for (k, t), i in right]
    got = asof_join(spark.createDataFrame(left, "k string, t double"), spark.createDataFrame(right, "k string, t double, v long"), ["k"], "t", ["v"], direction, tolerance, bucket)
    assert {(r.k, r.t): r.v for r in got.collect()} == brute_asof(left, right, direction, tolerance)


def test_a_hot_key_is_matched_by_many_tasks(spark):
    """All rows but one have one key; equal times, null keys and stretches without a match."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    left = spark.range(4000).selectExpr("'hot' AS k", "CAST(id * 7 % 4000 AS DOUBLE) AS t", "id AS n").union(spark.sql("SELECT NULL, 5d, -1L"))
    right = spark.range(300).selectExpr("'hot' AS k", "CAST(id DIV 2 * 20 + 500 AS DOUBLE) AS t", "id AS v").union(spark.sql("SELECT NULL, 1d, 7L"))
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for direction in ("backward", "forward", "nearest"):
            found = [asof_join(left, right, ["k"], "t", ["v"], direction, None, bucket) for bucket in (None, 50.0)]
            tasks = [len({r.p for r in x.select("k", "v", F.spark_partition_id().alias("p")).collect() if r.k == "hot"}) for x in found]
            assert tasks[0] == 1 and tasks[1] > 2
            one, two = ({r.n: (r.v, r.matched_on) for r in x.collect()} for x in found)
            assert {k: v for k, v in one.items() if k >= 0} == {k: v for k, v in two.items() if k >= 0} and len(two) == 4001
            assert two[-1] == ((7, 1.0) if direction != "forward" else (None, None))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_range_join(spark):
    points = [("a", float(i)) for i in range(20)]
    ranges = [("a", float(i), i + float(w)) for i, w in ((0, 3), (2, 15), (7, 0), (19, 4))]
    got = range_join(spark.createDataFrame(points, "k string, t double"), spark.createDataFrame(ranges, "k string, lo double, hi double"), ["k"], "t", "lo", "hi", 4.0)
    assert sorted((r.t, r.lo) for r in got.collect()) == sorted((t, lo) for _, t in points for _, lo, hi in ranges if lo <= t <= hi)


def test_fill_gaps(spark):
    x = frame(spark, {"time": np.arange(6.0), "v": np.array([np.nan, 1, np.nan, np.nan, 4, np.nan])})
    assert [r.v for r in series.fill_gaps(x, BY, ["v"]).orderBy("time").collect()] == [1, 1, 2, 3, 4, 4]


def test_sub_windows_of_samples_and_of_gathered_rows_agree(spark, monkeypatch):
    """The frames over the series give what gathering every sub-window's rows gives; samples off the grid are always gathered."""
    from aerotrace.plans import adapters

    x = series.preprocess(adapters.telemetry(spark, "/root/testdata/sf0.001"), ["object_id"])
    shorts = [f for f in FEATURES if f.startswith("short")]
    rows = lambda: {(r.object_id, round(r.window_start, 4)): r for r in features.window_features(x, ["object_id"]).select("object_id", "window_start", *shorts).collect()}
    ahead = rows()
    monkeypatch.setattr(features, "ON_GRID", -1.0)
    gathered = rows()
    assert ahead.keys() == gathered.keys() and len(ahead) > 20
    for k, r in ahead.items():
        for f in shorts:
            assert r[f] == pytest.approx(gathered[k][f], abs=1e-9), (k, f)
    assert len({r.short_window_count for r in ahead.values()}) >= 1 and any(r.short_roll_sign_changes_max > 0 for r in ahead.values())
