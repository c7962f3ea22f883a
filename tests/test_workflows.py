"""Whole runs over small logs, the CSV tables and the gates."""

import math
import zipfile
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aerotrace import workflows
from aerotrace.functions import geometry
from aerotrace.operators import engagement, learning, rules
from aerotrace.schema import FEATURES
from aerotrace.sources import log_files, tables
from aerotrace.sources import telemetry_log as log
from aerotrace.streaming import packets


def flight(title: str, seconds: int = 40) -> str:
    """A log of two aircraft, one straight and level, one turning, and a ship."""
    out = ["FileType=text/acmi/tacview", "FileVersion=2.2", f"0,Title={title}"]
    for i in range(2 * seconds):
        t = i / 2
        out.append(f"#{t:.2f}")
        lon, heading = 44 + t * 0.002, (14 * t) % 360
        turn = math.radians(heading)
        named = i == 0
        out.append(f"A1,T={lon:.7f}|41|5000|0|0|90" + ",Type=Air+FixedWing,Name=F/A-18C,Pilot=Ace,Coalition=Blue" * named)
        out.append(f"A2,T={44 + 0.006 * math.sin(turn):.7f}|{41 + 0.006 * (1 - math.cos(turn)):.7f}|5200|45|0|{heading:.3f}" + ",Type=Air+FixedWing,Name=M-29,Coalition=Red" * named)
        if named:
            out.append("B1,T=44|41|0,Type=Sea+Watercraft+AircraftCarrier,Name=Ship")
    return "\n".join(out)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("flights")
    (path / "one.acmi").write_text(flight("First"), encoding="utf-8")
    with zipfile.ZipFile(path / "two.zip.acmi", "w") as z:
        z.writestr("inner.acmi", flight("Second", 30))
    (path / "deep").mkdir()
    (path / "deep" / "three.acmi").write_text(flight("Third", 4), encoding="utf-8")
    (path / "notes.txt").write_text("no log")
    (path / "empty").mkdir()
    return path


def names(paths):
    return [p.rsplit("/", 1)[-1] for p in paths]


def test_inputs_are_expanded(spark, folder):
    one = str(folder / "one.acmi")
    assert names(tables.expand_inputs(spark, [str(folder)])) == ["one.acmi", "two.zip.acmi"]
    assert names(tables.expand_inputs(spark, [one, str(folder), one])) == ["one.acmi", "two.zip.acmi"]
    assert names(tables.expand_inputs(spark, [str(folder)], recursive=True)) == ["three.acmi", "one.acmi", "two.zip.acmi"]
    for bad in ("empty", "absent.acmi"):
        with pytest.raises(FileNotFoundError):
            tables.expand_inputs(spark, [str(folder / bad)])


@pytest.fixture(scope="module")
def made(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("run"))
    return path, workflows.run(spark, [str(folder)], path, trees=3, depth=4)


def test_run(spark, folder, made):
    path, out = made
    summary = {r.title: (r.frame_count, r.aircraft_count) for r in out["summary"].collect()}
    assert summary == {"First": (80, 2), "Second": (60, 2)}
    windows = out["windows"].collect()
    labels = {k: {r.label_name for r in windows if r.aircraft_id == k} for k in ("A1", "A2")}
    assert labels["A1"] == {"Straight_Level"} and "Level_Turn" in labels["A2"]
    assert {r.aircraft_name for r in windows} == {"F/A-18C", "M-29"} and {r.source_stem for r in windows} == {"one", "two"}
    assert sum(r.window_count for r in out["summary"].collect()) == len(windows)
    assert out["reason"] is None and out["metrics"].first().accuracy > 0.5
    text = spark.read.text(f"{path}/annotated/source_stem=one").collect()
    added = [r.value for r in text if "Maneuver010PredLabel" in r.value]
    counts = {r.source.rsplit("/", 1)[-1]: r for r in out["annotations"].collect()}
    assert len(added) == counts["one.acmi"].annotation_rows > 10 and counts["one.acmi"].frame_count == 80
    assert len(text) == len(flight("First").split("\n")) + len(added)


def test_prediction_of_logs(spark, folder, made, tmp_path):
    out = workflows.predict_logs(spark, [str(folder / "one.acmi")], f"{made[0]}/model", str(tmp_path / "said"))
    rows = out.collect()
    assert {r.predicted_label_name for r in rows} <= {"Straight_Level", "Level_Turn", "Transition", "Uncertain", "Large_Heading_Change"}
    back = tables.read_labeled(spark, str(tmp_path / "said"))
    assert back.count() == len(rows) and {"source_stem", "predicted_label_name"} <= set(back.columns)
    assert dict(back.dtypes)["speed_mean"] == "double" and dict(back.dtypes)["flag_dive"] == "boolean"


def test_training_from_logs_and_its_gate(spark, folder, tmp_path):
    out = workflows.train_from_logs(spark, [str(folder)], str(tmp_path / "t"), trees=2, depth=3)
    assert out["reason"] is None and learning.load(f"{tmp_path}/t/model", spark)[1]["columns"] == FEATURES
    labels = lambda *n: spark.createDataFrame([(x,) for x in n], "label int")
    for rows, reason, removed, valid in (((), "empty", [], []), ((1, 1), "too_few_unique_labels", [], [1]), ((1, 1, 2), "too_few_valid_labels", [2], [1]), ((1, 1, 2, 2, 3), None, [3], [1, 2])):
        good, gate = rules.gated(labels(*rows))
        assert gate.first().asDict() == {"reason": reason, "removed": removed, "valid": valid}
        assert good.count() == (4 if reason is None else 0)


def test_retraining_from_edits(spark, made, tmp_path):
    labeled = spark.read.parquet(f"{made[0]}/windows").orderBy("source_stem", "aircraft_id", "window_start").coalesce(1)
    tables.write_csv(labeled.drop("source"), str(tmp_path / "windows"))
    edited = spark.createDataFrame([("set", "A1", 2.5, "Dive"), ("set", "A9", 2.5, "Dive"), ("set", "A1", 5.0, "Nonsense, really"), ("clear", "A1", 2.5, ""), ("set", "A2", 7.6, "Zoom_Climb")], "edit_action string, aircraft_id string, sample_time double, manual_label_name string")
    for i in range(2):  # the second call appends
        tables.append_edits(edited.limit(0) if i == 0 else edited, str(tmp_path / "edits"))
    said = tables.read_edits(spark, str(tmp_path / "edits")).orderBy("edit_index").collect()
    assert [(r.edit_index, r.manual_label_name) for r in said] == list(enumerate(["Dive", "Dive", "Nonsense, really", None, "Zoom_Climb"]))
    assert all(r.edited_utc.endswith("Z") and len(r.edited_utc) == 20 for r in said)
    out = workflows.retrain(spark, str(tmp_path / "windows"), str(tmp_path / "edits"), str(tmp_path / "again"), trees=2, depth=3)
    assert out["edits"].first().asDict() == {"edits": 5, "matched": 4, "unmatched": 2}
    told = {r.edit_index: r.reason for r in tables.read_csv(spark, str(tmp_path / "again" / "unmatched")).collect()}
    assert told == {"1": "aircraft_not_found", "2": "unknown_manual_label"}
    again = spark.read.parquet(f"{tmp_path}/again/windows")
    assert again.count() == labeled.count() and again.filter("label_name = 'Zoom_Climb' AND training_label_source = 'manual'").count() == 1
    assert again.filter("label_name = 'Dive'").count() == 0


def test_sessions_and_regression_tables(spark, tmp_path):
    (tmp_path / "s.csv").write_text("model_time,self_aircraft_x,self_aircraft_TAS,enemy_aircraft_y,enemy_aircraft_z\n1.5,10,200,50,\n2.0,,bad,60,7\n")
    one, two = tables.read_sessions(spark, str(tmp_path / "s.csv")).orderBy("model_time").collect()
    assert (one.timestamp, one.self_aircraft.x, one.self_aircraft.TAS, one.enemy_aircraft.alt, one.enemy_aircraft.z, one.has_enemy) == (1.5, 10.0, 200.0, 50.0, 0.0, True)
    assert (two.self_aircraft.x, two.self_aircraft.TAS, two.enemy_aircraft.z) == (0.0, 0.0, 7.0)
    (tmp_path / "r.csv").write_text("a,b,score\n1,nan,0.5\n,2,-3\n1,1,\n")
    assert sorted(map(tuple, tables.read_regression(spark, str(tmp_path / "r.csv"), ["a", "b"]).collect())) == [("0.0", 2.0, -3.0)[1:] and (0.0, 2.0, -3.0), (1.0, 0.0, 0.5)]
    with pytest.raises(ValueError):
        tables.read_regression(spark, str(tmp_path / "r.csv"), ["c"])
    (tmp_path / "l.csv").write_text("aircraft_id,window_start,window_end\n1.0,0,5\n")
    with pytest.raises(ValueError):
        tables.read_labeled(spark, str(tmp_path / "l.csv"))


def test_rows_are_numbered_across_files(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("n")).repartitionByRange(4, "n").sortWithinPartitions("n").write.csv(str(tmp_path / "n"), header=True)
    got = tables.numbered_rows(tables.read_csv(spark, str(tmp_path / "n")), "at").collect()
    assert sorted((r["at"], int(r["n"])) for r in got) == [(i, i) for i in range(1000)]


def test_own_aircraft_and_session_summary(spark):
    rows = [("s", 1, 0, "a", "M-29", "Red", "Air+FixedWing"), ("s", 2, 1, "b", "F/A-18C", "", "Air+FixedWing"), ("s", 3, 2, "c", "F/A-18C", "Someone", "Air+FixedWing"), ("t", 1, 0, "d", "F-16", "The Player", "Air+FixedWing"), ("t", 1, 1, "e", "Ship", "The Player", "Sea")]
    state = spark.createDataFrame(rows, "source string, frame_idx int, ord long, object_id string, name string, pilot string, obj_type string")
    assert {(r.source, r.object_id) for r in engagement.self_aircraft(state, "Player").collect()} == {("s", "c"), ("t", "d")}
    assert {(r.source, r.object_id) for r in engagement.self_aircraft(state).collect()} == {("s", "c")}
    frames = spark.createDataFrame([("x", 0.0, 2.0), ("x", 2.0, 4.0), ("y", 1.0, 1.0)], "session string, time double, latency_ms double")
    got = {r.session: (r.frames, r.duration, r.mean_fps, r.mean_ms, r.max_ms) for r in packets.session_summary(frames).collect()}
    assert got == {"x": (2, 2.0, 1.0, 3.0, 4.0), "y": (1, 0.0, None, 1.0, 1.0)}


def test_histogram_and_choice_of_model(spark):
    df = spark.range(200).select((F.col("id") / 100 - 1).alias("a"), (F.col("id") % 7).cast("double").alias("b")).withColumn("score", F.col("a") * 0.8)
    assert sum(r.n for r in learning.histogram(df, "a", -1.0, 1.0, 4).collect()) == 200 and learning.histogram(df, "a", -1.0, 1.0, 4).count() == 4
    kind, model, metrics = learning.best_regressor(df.filter("b < 5"), df.filter("b >= 5"), ["a", "b"], trees=3)
    by = {r.model: r.mae for r in metrics.collect()}
    assert kind == min(by, key=by.get) and by["ridge"] < 0.05
    assert learning.score(df, model, ["a", "b"]).filter("advantage BETWEEN -1 AND 1").count() == 200
    two = df.select("a", "b", (F.col("a") > 0).cast("int").alias("label"))
    boosted = learning.train_classifier(two, ["a", "b"], model_type="boosted", trees=2, depth=2)
    assert learning.class_metrics(learning.predict(two, boosted, ["a", "b"]), "label", "predicted_label").first().accuracy > 0.95


def test_summary_of_a_log_without_aircraft(spark):
    lines = spark.createDataFrame([("x", i, t) for i, t in enumerate(["0,Title=Empty", "#1", "B1,T=1|2|3,Type=Sea"])], log.LINES)
    labeled = workflows.extract(lines)
    assert labeled.count() == 0
    assert [tuple(r) for r in workflows.file_summary(lines, labeled).collect()] == [("x", "Empty", 1, 0, 0)]
    assert geometry is not None


def test_one_file_a_log(spark, tmp_path):
    rows = [(f"/{d}/one.acmi", i, 0, f"{d}{i}") for d in "ab" for i in range(300)] + [("/c/two.zip.acmi", i, r, f"c{i} é {r}") for i in range(50) for r in (0, 1)] + [("/d/three.txt", 0, 0, "")]
    df = spark.createDataFrame(rows, "source string, line_no long, rank int, raw string").repartition(6)
    out = tmp_path / "out"
    for _ in range(2):  # a second run replaces the first one's files
        log_files.write_files(df, str(out))
    names = sorted(p.name for p in out.iterdir())
    ones = [n for n in names if n.startswith("one-")]
    assert len(ones) == 2 and sorted(set(names) - set(ones)) == ["three.maneuver.acmi", "two.maneuver.zip.acmi"]
    assert sorted((out / n).read_text(encoding="utf-8-sig") for n in ones) == ["\n".join(f"{d}{i}" for i in range(300)) for d in "ab"]
    with zipfile.ZipFile(out / "two.maneuver.zip.acmi") as z:
        assert z.namelist() == ["two.maneuver.txt.acmi"] and z.read(z.namelist()[0]).decode("utf-8-sig") == "\n".join(f"c{i} é {r}" for i in range(50) for r in (0, 1))
    log_files.write_files(df.filter("source LIKE '/a/%'"), str(tmp_path / "zips"), kind="zip")
    assert [p.name for p in (tmp_path / "zips").iterdir()] == ["one.maneuver.zip.acmi"]
    log.write_log(df, str(tmp_path / "folders"))
    assert len([p for p in (tmp_path / "folders").iterdir() if p.is_dir()]) == 4


def test_a_failed_task_leaves_no_file(tmp_path):
    writer = log_files.LogWriter(str(tmp_path / "out"), False)
    batch = lambda names, raw: pa.RecordBatch.from_pydict({"file": names, "raw": raw})

    def broken():
        yield batch(["a.maneuver.acmi"], ["half"])
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(broken())
    first = writer.write(iter([batch(["a.maneuver.acmi", "a.maneuver.acmi"], ["1", "2"])]))
    writer.write(iter([batch(["a.maneuver.acmi"], ["speculative"])]))  # another attempt that isn't committed
    other = writer.write(iter([batch(["b.maneuver.acmi"], ["3"])]))
    writer.commit([first, None, other])
    assert {p.name: p.read_text(encoding="utf-8-sig") for p in (tmp_path / "out").iterdir()} == {"a.maneuver.acmi": "1\n2", "b.maneuver.acmi": "3"}
    again = log_files.LogWriter(str(tmp_path / "out"), True)
    again.commit([again.write(iter([batch(["c.maneuver.acmi"], ["4"])]))])
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["c.maneuver.acmi"]


def test_options_of_whole_runs(spark, made, folder, tmp_path):
    with pytest.raises(ValueError, match="turn_smal"):
        workflows.extract(workflows.read_any(spark, [str(folder)]), thresholds={"turn_smal": 1.0})
    logs = sorted(p.name for p in (Path(made[0]) / "logs").iterdir())
    assert logs == ["one.maneuver.acmi", "two.maneuver.zip.acmi"]
    told = [r.value for r in spark.read.text(f"{made[0]}/annotated/source_stem=one").collect()]
    assert (Path(made[0]) / "logs" / "one.maneuver.acmi").read_text(encoding="utf-8-sig").split("\n") == told
    out = workflows.predict_logs(spark, [str(folder / "one.acmi")], f"{made[0]}/model", str(tmp_path / "said"), window=3.0, step=1.0, aircraft="A1", annotate_logs=True, kind="text")
    rows = out.collect()
    assert {r.aircraft_id for r in rows} == {"A1"} and {round(r.window_end - r.window_start, 6) for r in rows} == {3.0} and {r.title for r in rows} == {"First"}
    text = (tmp_path / "said-annotated" / "logs" / "one.maneuver.acmi").read_text(encoding="utf-8-sig")
    assert "A1,Maneuver010PredLabel=" in text and "A2,Maneuver010PredLabel=" not in text
    summary = workflows.predict_summary(out).collect()
    assert [(r.title, r.window_count) for r in summary] == [("First", len(rows))] and summary[0].agreed == sum(r.predicted_label == r.label for r in rows)


def test_a_split_meets_every_labels_quota(spark):
    """Labels of 1, 2, 3, 10 and 1000 rows, a null label, repeated keys; the same rows whatever the partitioning."""
    sizes = {"a": 1, "b": 2, "c": 3, "d": 10, "e": 1000, None: 7}
    rows = [(k, i // 2) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "label string, id int")
    one = learning.split(df, ["id"], 0.2, "label")
    got = {(r.label, r.is_test): r.n for r in one.groupBy("label", "is_test").agg(F.count("*").alias("n")).collect()}
    for k, n in sizes.items():
        test = max(0, min(n - 1, max(1, math.floor(0.2 * n + 0.5))))
        assert (got.get((k, True), 0), got.get((k, False), 0)) == (test, n - test), k
    two = learning.split(df.repartition(7), ["id"], 0.2, "label")
    assert sorted(map(repr, one.filter("is_test").collect())) == sorted(map(repr, two.filter("is_test").collect()))
    assert one.columns == ["label", "id", "is_test"] and learning.split(df.filter("false"), ["id"], 0.2, "label").collect() == []
