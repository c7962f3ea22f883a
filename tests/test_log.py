import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from aerotrace.functions.text import crc64_digest, escaped, formatted, object_id, property_name, stem
from aerotrace.operators import annotation, edits, engagement
from aerotrace.sources import telemetry_log as log

LOG = """FileType=text/acmi/tacview
FileVersion=2.2
0,ReferenceTime=2024-01-01T00:00:00Z
0,Title=Old,Author=me
0,Title=Test
#0.00
3000001,T=44.0|41.0|5000|0|0|90,Type=Air+FixedWing,Name=F-1,Coalition=Blue
3000002,T=44.05|41.0|5000|0|0|270,Type=Air+FixedWing,Name=M-2,Coalition=Red
#1.00
3000001,T=44.001||5010
3000002,T=44.049|41.0|5000,Mach=0.8
#2.00
3000001,T=44.002||5020|5||
3000002,T=44.048|oops|5000
#bad
3000001,IAS=100
#3.00
-3000002
#4.00
3000002,T=45|42|100
"""


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("logs")
    (path / "one.acmi").write_text("﻿" + LOG.replace("\n", "\r\n"), encoding="utf-8")
    with zipfile.ZipFile(path / "two.zip.acmi", "w") as z:
        z.writestr("inner.acmi", "﻿" + LOG)
    one = log.read_log(spark, str(path / "one.acmi"))
    two = log.read_zip_log(spark, str(path / "two.zip.acmi"))
    assert [r.raw for r in one.orderBy("line_no").collect()] == LOG.split("\n") == [r.raw for r in two.orderBy("line_no").collect()]
    return one.withColumn("source", F.lit("one.acmi"))


def test_a_log_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """Splits of 2 kB, through lines of characters of several bytes and carriage returns, and segments of 50 lines."""
    text = "\ufeff" + LOG.replace("\n", "\r\n") + "".join(f"#{4 + i / 8}\n3000001,T={44 + i / 1000}|41|{5000 + i % 7}\n" + ("é漢" * (i % 40) + "\n") * (i % 3 == 0) for i in range(1500))
    for name, said in (("a", text), ("b", text.rstrip("\n")), ("c", "\n\n"), ("d", "x")):
        (tmp_path / f"{name}.acmi").write_bytes(said.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = log.read_log(spark, str(tmp_path))
        assert got.filter("source LIKE '%a.acmi'").select(F.spark_partition_id()).distinct().count() > 20
        rows = {}
        for r in got.orderBy("source", "line_no").collect():
            rows.setdefault(r.source[-6], []).append((r.line_no, r.raw))
        for name, said in (("a", text), ("b", text.rstrip("\n")), ("c", "\n\n"), ("d", "x")):
            assert rows[name] == list(enumerate(said.removeprefix("\ufeff").replace("\r", "").split("\n"))), name
        one = log.classified(got).orderBy("source", "line_no").select("kind", "t", "frame_idx", "now").collect()
        monkeypatch.setattr(log, "SEGMENT", 50)
        assert log.classified(got).orderBy("source", "line_no").select("kind", "t", "frame_idx", "now").collect() == one
        frames, now = 0, 0.0
        for r in [r for r, (n, _) in zip(one, rows["a"])]:
            frames += r.kind == "frame"
            now = r.t if r.t is not None else now
            assert (r.frame_idx, r.now) == (frames, now)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_state_lasts_until_it_changes(spark, lines):
    x = log.classified(lines)
    s = {(r.time, r.object_id): r for r in log.frame_state(x).collect()}
    assert sorted({t for t, _ in s}) == [0.0, 1.0, 2.0, 3.0, 4.0]
    assert (3.0, "3000002") not in s and (4.0, "3000002") in s
    a = s[2.0, "3000001"]
    assert (a.name, a.latitude, a.altitude, a.roll, a.yaw) == ("F-1", 41.0, 5020.0, 5.0, 90.0)
    assert s[3.0, "3000001"].ias == pytest.approx(100 * 0.514444) and s[2.0, "3000001"].ias == 0
    east = 6378137 * math.radians(0.001) * math.cos(math.radians(41))
    assert s[1.0, "3000001"].speed == pytest.approx(math.hypot(east, 10), rel=1e-6)
    assert s[0.0, "3000001"].speed == 0 and s[0.0, "3000001"].g_load == 1
    assert s[2.0, "3000002"].latitude == 41.0 and s[2.0, "3000002"].mach == 0.8
    again = s[4.0, "3000002"]
    assert (again.name, again.altitude, again.speed) == ("", 100.0, 0.0)
    assert [r._corrupt for r in log.updates(x).filter("_corrupt IS NOT NULL").collect()] == ["3000002,T=44.048|oops|5000"]


def test_globals_and_losses(spark, lines):
    x = log.classified(lines)
    g = log.global_properties(x).first()
    assert (g.Title, g.Author, g.ReferenceTime) == ("Test", "me", "2024-01-01T00:00:00Z")
    k = log.kill_events(x).collect()
    assert [(r.time, r.victim_name, r.killer_name) for r in k] == [(3.0, "M-2", "F-1")]


def test_annotations_stand_after_their_frames(spark, lines):
    x = log.classified(lines)
    labels = spark.createDataFrame([("one.acmi", "3000001.0", 0.0, 2.0, 0, "A,b"), ("one.acmi", "3000001", 0.5, 1.6, 3, "Level_Turn"), ("one.acmi", "9", 0.0, 1.0, 1, "x"), ("one.acmi", "3000002", 2.5, 3.0, 2, "y")], "source string, aircraft_id string, window_start double, window_end double, label int, label_name string")
    s = annotation.schedule(labels, log.frames_of(x), annotation.first_frames(log.frame_state(x)))
    got = {(r.frame_text, r.rank): r.update for r in s.collect()}
    assert set(got) == {("1.00", 1), ("3.00", 1)}
    assert got["1.00", 1].startswith("3000001,Maneuver010PredLabel=Level_Turn,Maneuver011PredLabelId=3,Maneuver070WindowStart=0.5,Maneuver071WindowEnd=1.6,Maneuver072SampleTime=1.05,")
    out = [r.raw for r in log.written(lines, s).orderBy("line_no", "rank").collect()]
    assert out[out.index("#1.00") + 1] == got["1.00", 1] and [r for r in out if r not in got.values()] == LOG.split("\n")
    back = log.frame_state(log.classified(log.written(lines, s).orderBy("line_no", "rank").select("source", F.row_number().over(log.W.partitionBy("source").orderBy("line_no", "rank")).alias("line_no"), "raw").withColumn("line_no", F.col("line_no").cast("long"))))
    same = ["time", "object_id", "name", "altitude", "speed"]
    key = lambda df: sorted(map(tuple, df.select(*same).collect()))
    assert key(back) == key(log.frame_state(x))
    with pytest.raises(ValueError):
        annotation.schedule(labels, log.frames_of(x), anchor="middle")
    z = log.zipped(log.written(lines, s)).first()
    assert zipfile.ZipFile(io.BytesIO(z.content)).read("log.acmi").decode("utf-8-sig").split("\n") == out


def test_text_functions(spark):
    r = spark.range(1).select(
        formatted(F.lit(2.5)).alias("a"), formatted(F.lit(3.0)).alias("b"), escaped(F.lit("a,b\\c\nd")).alias("c"), object_id(F.lit("12.0")).alias("d"), stem(F.lit("/x/y.zip.acmi")).alias("e"), formatted(F.lit(-0.1234567)).alias("f"), formatted(F.lit(100.0)).alias("g"),
    ).first()
    assert tuple(r) == ("2.5", "3", "a\\,b\\\\c\\nd", "12", "y", "-0.123457", "100")
    assert property_name("Maneuver", 20, "rule_label") == "Maneuver020RuleLabel"
    assert crc64_digest("") == "0x0000000000000000" and len(crc64_digest("secret")) == 18


def test_edits(spark):
    labeled = spark.createDataFrame([("a", i * 2.5, i * 2.5 + 5, i, "Straight_Level", 0) for i in range(4)], "aircraft_id string, window_start double, window_end double, row int, label_name string, label int")
    rows = [
        (0, "set", "a", 2.4, None, None, "Dive"), (1, "set", "a", 3.75, None, None, "Level_Turn"), (2, "set", "a", 99.0, None, None, "Dive"), (3, "set", "b", 1.0, None, None, "Dive"), (4, "set", "a", None, None, None, "Dive"),
        (5, "set", "a", 7.0, None, None, "Nonsense"), (6, "set", "a", 9.0, 7.5, 12.5, "Zoom_Climb"), (7, "clear", "a", 2.5, None, None, ""),
    ]
    e = spark.createDataFrame(rows, "edit_index int, edit_action string, aircraft_id string, sample_time double, window_start_hint double, window_end_hint double, manual_label_name string")
    out, unmatched, report = edits.apply_edits(labeled, e)
    got = {r.row: (r.training_label_name, r.manual_edit_index) for r in out.collect()}
    assert got == {0: ("Straight_Level", 7), 1: ("Straight_Level", None), 2: ("Straight_Level", 5), 3: ("Zoom_Climb", 6)}
    assert {r.edit_index: r.unmatched_reason for r in unmatched.collect()} == {2: "no_window_within_tolerance", 3: "aircraft_not_found", 4: "invalid_sample_time", 5: "unknown_manual_label"}
    assert tuple(report.first()) == (8, 5, 4)


def state_row(i, x, coalition, **more):
    return {"source": "s", "frame_idx": 1, "time": 0.0, "ord": i, "object_id": str(i), "name": f"n{i}", "coalition": coalition, "obj_type": "Air+FixedWing", "world_x": x, "world_y": 1000.0, "world_z": 0.0, "altitude": 1000.0, "speed": 200.0, "mach": 0.0, "yaw": 0.0, "pitch": 0.0, "roll": 0.0, "aoa": 0.0, "g_load": 1.0} | more


def test_pairs_and_scores(spark):
    s = spark.createDataFrame([state_row(1, 0.0, "Blue"), state_row(2, 3000.0, "Red"), state_row(3, 20000.0, "Red"), state_row(4, 100.0, "Blue"), state_row(5, 10.0, "Red", altitude=50.0)])
    p = engagement.pairs(s)
    assert sorted((r.self_object_id, r.enemy_object_id, r.distance_raw) for r in p.collect()) == [("1", "2", 3000.0), ("2", "4", 2900.0)]
    assert {r.object_id: r.enemy_id for r in engagement.nearest_opponent(s).collect()} == {"1": "2", "2": "4", "3": "4", "4": "2", "5": "1"}
    f = engagement.pair_features(p).filter("self_object_id = '1'").first()
    assert f.distance == 3000 and f.distance_rate == 0 and f.speed_ratio == 1 and f.self_turn_rate == 0 and f.antenna_train_angle == 0 and f.aspect_angle == 180
    kills = spark.createDataFrame([("s", 2.0, "2", "n2", "1", "n1")], "source string, time double, victim_id string, victim_name string, killer_id string, killer_name string")
    got = {r.self_object_id: r.score for r in engagement.outcome_score(p, kills).collect()}
    assert got["1"] == pytest.approx(math.exp(-0.4)) and got["2"] == pytest.approx(-math.exp(-0.4))
