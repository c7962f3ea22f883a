import pytest
from pyspark.sql import functions as F

from aerotrace.operators import learning, rules
from aerotrace.schema import FEATURES, LABELS

CASES = {
    "Straight_Level": {},
    "Straight_Climb": {"vertical_speed_mean": 20.0, "pitch_mean": 6.0},
    "Straight_Descent": {"vertical_speed_mean": -20.0, "pitch_mean": -6.0},
    "Level_Turn": {"turn_rate_mean": 14.0, "turn_rate_peak": 15.0},
    "Climbing_Turn": {"turn_rate_mean": 14.0, "vertical_speed_mean": 20.0},
    "Descending_Turn": {"turn_rate_mean": 14.0, "vertical_speed_mean": -20.0},
    "Dive": {"pitch_mean": -25.0, "vertical_speed_mean": -60.0, "turn_rate_mean": 5.0, "g_mean": 1.0},
    "Zoom_Climb": {"pitch_mean": 25.0, "vertical_speed_mean": 60.0, "turn_rate_mean": 5.0, "g_mean": 1.0},
    "Large_Heading_Change": {"heading_delta": 150.0, "turn_rate_mean": 8.0},
    "Oscillatory_Maneuver": {"roll_sign_changes": 4.0, "roll_rate_peak": 300.0, "turn_rate_mean": 5.0},
    "Transition": {"turn_rate_mean": 5.0, "vertical_speed_mean": 7.0},
    "Uncertain": {"missing_ratio": 0.5},
}


def rows(spark, cases):
    names = ["name", *FEATURES]
    return spark.createDataFrame([(k, *(float(v.get(f, 0.0)) for f in FEATURES)) for k, v in cases.items()], ", ".join(f"{n} {'string' if n == 'name' else 'double'}" for n in names))


def test_each_label_has_its_case(spark):
    got = rules.label(rows(spark, CASES)).collect()
    assert {r.name: r.main_label for r in got} == {k: k for k in LABELS}
    assert all(r.label == LABELS.index(r.main_label) for r in got)
    assert all(r[f"score_{k.lower()}"] >= 0 for r in got for k in LABELS[:10])


def test_reasons(spark):
    cases = {
        "none": {"turn_rate_mean": 5.0, "vertical_speed_mean": 7.0},
        "halves": {"first_half_turn_rate_mean": 14.0, "second_half_turn_rate_mean": 0.0},
        "bad": {"g_mean": float("nan"), "sensor_conflict": 1.0, "long_gap_ratio": 0.25},
    }
    got = {r.name: r for r in rules.label(rows(spark, cases)).collect()}
    assert got["none"].transition_reason == "no_rule_matched"
    assert got["halves"].transition_reason == "window_halves_disagree:Level_Turn->Straight_Level"
    assert got["bad"].uncertain_reason == "long_gap_ratio;sensor_conflict;non_finite_feature" and got["bad"].transition_reason == ""


def test_thresholds_and_attributes(spark):
    case = {"x": {"g_mean": 6.0, "speed_slope": -2.0, "turn_rate_mean": 8.0, "turn_rate_peak": 20.0}}
    r = rules.label(rows(spark, case), {"turn_large": 7.0}).collect()[0]
    assert r.main_label == "Level_Turn" and r.attributes == "High_G;Decelerating;High_Turn_Rate" and r.attribute_count == 3


def test_distribution_and_trainable(spark):
    x = rules.label(rows(spark, CASES | {"again": {}})).select("label", "label_name")
    x = spark.createDataFrame(x.collect(), x.schema)
    d = {r.label_name: (r.n, r.share) for r in rules.label_distribution(x).collect()}
    assert len(d) == 12 and d["Straight_Level"] == (2, 2 / 13)
    assert rules.trainable(x).count() == 0  # one label only has two rows
    assert rules.trainable(x.union(x)).count() == 26


def test_valid_classes_look_at_the_labels_once(spark):
    x = spark.createDataFrame([(0, "a"), (0, "a"), (1, "b"), (2, "c"), (2, "c"), (2, "c")], "label int, main_label string")
    out = rules.valid_classes(x, "main_label")
    assert {tuple(r) for r in out.collect()} == {("a", 2), ("c", 3)} and out.columns == ["main_label", "n"]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert rules.valid_classes(x.filter("label < 2")).count() == 0  # one label is left


def test_learning_measures(spark):
    x = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)], "label int, predicted int")
    r = learning.class_metrics(x).first()
    assert r.accuracy == pytest.approx(3 / 5) and r.precision == pytest.approx((2 * 0.5 + 2 * 2 / 3 + 0) / 5)
    m = learning.confusion_matrix(x, [0, 1, 2]).orderBy("label").collect()
    assert [tuple(r) for r in m] == [(0, 1, 1, 0), (1, 0, 2, 0), (2, 1, 0, 0)]
    w = {r.label: r.weight for r in learning.class_weights(x).collect()}
    assert w == {0: 5 / 6, 1: 5 / 6, 2: 5 / 3}
    with pytest.raises(ValueError):
        learning.train_classifier(x, ["predicted"], use_gpu=True)


def test_classifier_learns_and_is_kept(spark, tmp_path):
    x = spark.range(600).select("id", (F.col("id") % 3).cast("int").alias("label"), *((F.col("id") % 3 * (i + 1) + F.randn(i)).alias(f"f{i}") for i in range(4)))
    columns = [f"f{i}" for i in range(4)]
    parts = learning.split(x, ["id"], by="label")
    model = learning.train_classifier(parts.filter("NOT is_test"), columns, trees=10, depth=6)
    learning.save(model, str(tmp_path), spark, columns, "classification")
    again, about = learning.load(str(tmp_path), spark)
    assert about["columns"] == columns
    got = learning.predict(parts.filter("is_test"), again, columns)
    assert learning.class_metrics(got, "label", "predicted_label").first().accuracy > 0.85
    assert len(learning.importances(model, columns, 2)) == 2
