"""Whole runs: logs to labelled windows, models and annotated logs, predictions, and training again from human edits."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerotrace.operators import annotation, edits, features, learning, rules, series
from aerotrace.schema import FEATURES
from aerotrace.sources import tables
from aerotrace.sources import telemetry_log as log
from aerotrace.sources.log_files import unique_stems, write_files

BY = ["source", "object_id"]


def read_any(spark: SparkSession, paths: list[str], recursive: bool = False) -> DataFrame:
    """Lines of text and zip logs alike."""
    found = tables.expand_inputs(spark, paths, recursive)
    zips = [p for p in found if p.lower().endswith((".zip", ".zip.acmi"))]
    texts = [p for p in found if p not in set(zips)]
    parts = ([log.read_log(spark, texts)] if texts else []) + ([log.read_zip_log(spark, zips)] if zips else [])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def targets(state: DataFrame) -> DataFrame:
    """source, object_id, aircraft_name of the objects that are analysed: fixed-wing aircraft with a name, the first that isn't empty."""
    return state.filter(_analysed()).groupBy(*BY).agg(F.min_by("name", "frame_idx").alias("aircraft_name"))


def _analysed() -> Column:
    return (F.lower(F.trim("obj_type")) == "air+fixedwing") & (F.col("name") != "")


def extract(lines: DataFrame, window: float = 5.0, step: float = 2.5, aircraft: str | None = None, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Labelled windows of every aircraft of every log: source, source_stem, title, aircraft_id, aircraft_name, features and labels.

    An aircraft's name is told to its rows by a window on the objects that the series are partitioned
    by anyway, and is part of their key, so the state is computed once and joined to nothing.
    """
    x = log.classified(lines)
    state = log.frame_state(x)
    if aircraft is not None:
        state = state.filter(F.col("object_id") == aircraft)
    name = F.min_by(F.when(_analysed(), F.col("name")), F.when(_analysed(), F.col("frame_idx"))).over(W.partitionBy(*BY))
    key = [*BY, "aircraft_name"]
    state = state.withColumn("aircraft_name", name).filter("aircraft_name IS NOT NULL")
    labeled = rules.label(features.window_features(series.preprocess(state, key), key, window, step), thresholds)
    about = unique_stems(lines).join(log.global_properties(x).select("source", F.col("Title").alias("title")), "source", "left")
    return labeled.join(about, "source").withColumnRenamed("object_id", "aircraft_id")


def file_summary(lines: DataFrame, labeled: DataFrame) -> DataFrame:
    """source, title, frame_count, aircraft_count, window_count of every log, those without aircraft or windows with 0."""
    x = log.classified(lines)
    own = targets(log.frame_state(x))
    counts = [x.groupBy("source").agg(F.count(F.when(F.col("kind") == "frame", F.col("t"))).alias("frame_count")), own.groupBy("source").agg(F.count("*").alias("aircraft_count")), labeled.groupBy("source").agg(F.count("*").alias("window_count"))]
    out = counts[0].join(counts[1], "source", "left").join(counts[2], "source", "left").join(log.global_properties(x).select("source", F.col("Title").alias("title")), "source", "left")
    return out.select("source", "title", "frame_count", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("aircraft_count", "window_count")))


def annotation_counts(lines: DataFrame, scheduled: DataFrame) -> DataFrame:
    """source, frame_count, annotation_frames, annotation_rows of every log."""
    frames = log.frames_of(log.classified(lines)).groupBy("source").agg(F.count("*").alias("frame_count"))
    told = scheduled.groupBy("source").agg(F.count_distinct("frame_text").alias("annotation_frames"), F.count("*").alias("annotation_rows"))
    return frames.join(told, "source", "left").select("source", "frame_count", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("annotation_frames", "annotation_rows")))


def annotate(lines: DataFrame, labeled: DataFrame, anchor: str = "center", prefix: str = "Maneuver") -> tuple[DataFrame, DataFrame]:
    """(lines with the windows' labels as properties of their objects, counts of a log)."""
    x = log.classified(lines)
    first = annotation.first_frames(log.updates(x).filter("kind = 'update'").withColumn("frame_idx", F.greatest("frame_idx", F.lit(1))))
    scheduled = annotation.schedule(labeled, log.frames_of(x), first, anchor, prefix)
    return log.written(lines, scheduled), annotation_counts(lines, scheduled)


def fit(labeled: DataFrame, model_type: str = "random_forest", share: float = 0.2, **options) -> dict:
    """model, metrics, report and confusion of a classifier on the windows whose labels suffice; else the reason why there is none."""
    good, gate = rules.gated(labeled)
    told = gate.first()
    if told["reason"] is not None:
        return {"reason": told["reason"], "removed": told["removed"], "model": None}
    x = learning.split(good, ["source", "aircraft_id", "window_start"] if "source" in good.columns else ["aircraft_id", "window_start"], share, "label")
    model = learning.train_classifier(x.filter("NOT is_test"), model_type=model_type, **options)
    seen = learning.predict(x.filter("is_test"), model)
    measured = {"metrics": learning.class_metrics(seen, "label", "predicted_label"), "report": learning.class_report(seen, "label", "predicted_label"), "confusion": learning.confusion(seen, "label", "predicted_label")}
    return {"reason": None, "removed": told["removed"], "model": model, **measured}


def _kept(spark: SparkSession, labeled: DataFrame, path: str, **options) -> dict:
    out = fit(labeled, **options)
    if out["model"] is not None:
        learning.save(out["model"], f"{path}/model", spark, FEATURES, "classification")
    return out


def _windows(spark: SparkSession, lines: DataFrame, path: str, **options) -> DataFrame:
    extract(lines, **options).write.mode("overwrite").partitionBy("source_stem").parquet(f"{path}/windows")
    return spark.read.parquet(f"{path}/windows")


def _annotated(spark: SparkSession, lines: DataFrame, shown: DataFrame, path: str, anchor: str, kind: str) -> DataFrame:
    """Writes the annotated logs, a file each, under path/logs; the counts of annotations."""
    annotated, counts = annotate(lines, shown, anchor)
    annotated.write.mode("overwrite").parquet(f"{path}/lines")
    write_files(spark.read.parquet(f"{path}/lines"), f"{path}/logs", kind)
    return counts


def train_from_logs(spark: SparkSession, paths: list[str], path: str, recursive: bool = False, window: float = 5.0, step: float = 2.5, aircraft: str | None = None, thresholds: dict[str, float] | None = None, annotate_logs: bool = False, anchor: str = "center", kind: str = "same", **options) -> dict:
    """Writes the windows of all logs under path/windows, one folder a log, and the model under path/model; what fit returns.

    annotate_logs: the logs with what the model says, or the rules where none could be trained, under path/logs.
    """
    lines = read_any(spark, paths, recursive)
    labeled = _windows(spark, lines, path, window=window, step=step, aircraft=aircraft, thresholds=thresholds)
    out = _kept(spark, labeled, path, **options)
    if annotate_logs:
        out["annotations"] = _annotated(spark, lines, learning.predict(labeled, out["model"]) if out["model"] is not None else labeled, path, anchor, kind)
    return out


def predict_summary(predicted: DataFrame) -> DataFrame:
    """source, title, window_count, agreed (windows whose label the rules gave too) of every log with windows."""
    return predicted.groupBy("source", "title").agg(F.count("*").alias("window_count"), F.count_if(F.col("predicted_label") == F.col("label")).alias("agreed"))


def predict_logs(
    spark: SparkSession, paths: list[str], model: str | PipelineModel, path: str | None = None, recursive: bool = False,
    window: float = 5.0, step: float = 2.5, aircraft: str | None = None, thresholds: dict[str, float] | None = None, annotate_logs: bool = False, anchor: str = "center", kind: str = "same",
) -> DataFrame:
    """The windows of all logs with the model's labels; written as CSV, one folder a log, where a path is given, and with annotate_logs into the logs under path/logs."""
    fitted = learning.load(model, spark)[0] if isinstance(model, str) else model
    lines = read_any(spark, paths, recursive)
    out = learning.predict(extract(lines, window, step, aircraft, thresholds), fitted)
    if path is not None:
        out.write.mode("overwrite").partitionBy("source_stem").csv(path, header=True, escape='"')
        if annotate_logs:
            _annotated(spark, lines, out, path.rstrip("/") + "-annotated", anchor, kind)
    return out


def run(
    spark: SparkSession, paths: list[str], path: str, recursive: bool = False, train: bool = True, anchor: str = "center",
    window: float = 5.0, step: float = 2.5, aircraft: str | None = None, thresholds: dict[str, float] | None = None, kind: str = "same", **options,
) -> dict:
    """From logs to path/windows, path/model, path/annotated (a folder a log), path/logs (a file a log) and a summary of every log."""
    lines = read_any(spark, paths, recursive)
    labeled = _windows(spark, lines, path, window=window, step=step, aircraft=aircraft, thresholds=thresholds)
    out = _kept(spark, labeled, path, **options) if train else {"reason": None, "model": None}
    counts = _annotated(spark, lines, learning.predict(labeled, out["model"]) if out["model"] is not None else labeled, path, anchor, kind)
    log.write_log(spark.read.parquet(f"{path}/lines"), f"{path}/annotated")
    return out | {"windows": labeled, "summary": file_summary(lines, labeled), "annotations": counts}


def retrain(spark: SparkSession, labeled_csv: str, edits_csv: str | None, path: str, tolerance: float = 2.5, **options) -> dict:
    """Trains on labelled windows after human edits: path/windows, path/unmatched (CSV) and path/model; with the counts of edits."""
    labeled = tables.numbered_rows(tables.read_labeled(spark, labeled_csv), "row")
    if edits_csv is None:
        merged, unmatched, report = labeled.withColumns({"training_label": F.col("label"), "training_label_name": F.col("label_name")}), None, None
    else:
        merged, unmatched, report = edits.apply_edits(labeled, tables.read_edits(spark, edits_csv), tolerance)
        tables.write_csv(unmatched.select("edit_index", F.col("unmatched_reason").alias("reason"), "aircraft_id"), f"{path}/unmatched")
    edits.retrain_labels(merged).write.mode("overwrite").parquet(f"{path}/windows")
    return _kept(spark, spark.read.parquet(f"{path}/windows"), path, **options) | {"edits": report}
