"""Human edits matched to windows and applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerotrace.functions.text import object_id
from aerotrace.schema import LABELS, require_columns


def label_id(name: Column) -> Column:
    return F.create_map(*(F.lit(v) for i, k in enumerate(LABELS) for v in (k, i)))[name]


def prepared(edits: DataFrame) -> DataFrame:
    """Edits with aliases resolved, ids and names trimmed, ids of names; edit_index must give the order of the rows."""
    for new, old in (("manual_label_name", "manual_label"), ("manual_label_name", "label_name"), ("sample_time", "time")):
        if new not in edits.columns and old in edits.columns:
            edits = edits.withColumnRenamed(old, new)
    require_columns(edits, ["edit_index", "aircraft_id", "sample_time", "manual_label_name"])
    for c, kind in (("edit_action", "string"), ("window_start_hint", "double"), ("window_end_hint", "double"), ("source", "string")):
        if c not in edits.columns:
            edits = edits.withColumn(c, F.lit(None).cast(kind))
    x = edits.withColumns({"aircraft_id": object_id(F.col("aircraft_id")), "edit_action": F.lower(F.coalesce(F.nullif(F.trim("edit_action"), F.lit("")), F.lit("set"))), "manual_label_name": F.trim(F.coalesce("manual_label_name", F.lit(""))), "sample_time": F.col("sample_time").try_cast("double")})
    return x.withColumn("manual_label_id", label_id(F.col("manual_label_name")))


def matched(labeled: DataFrame, edits: DataFrame, tolerance: float = 2.5) -> DataFrame:
    """Every edit with its window (row) and why it has none: edit columns, row, unmatched_reason.

    labeled has aircraft_id, window_start, window_end and row, its order.  A window
    named by both hints wins (the last such), else the one whose middle is
    nearest (the first such); either must lie within the tolerance.  An edit meets
    only the windows whose middle shares a bucket of time with its own time or its hints.
    """
    e = prepared(edits)
    w = labeled.select(F.col("aircraft_id").alias("__id"), *([F.col("source").alias("__source")] if "source" in labeled.columns else [F.lit(None).cast("string").alias("__source")]), "row", "window_start", "window_end")
    same = (F.col("aircraft_id") == F.col("__id")) & (F.col("source").isNull() | F.col("__source").isNull() | (F.col("source") == F.col("__source")))
    known = w.select("__id").distinct().withColumn("__known", F.lit(True))
    width = max(4 * tolerance, 1.0)
    about = lambda t, d: F.when(t.isNotNull(), F.sequence(F.floor((t - d) / width), F.floor((t + d) / width)))
    spots = F.array_distinct(F.concat(*(F.coalesce(about(t, d), F.array().cast("array<bigint>")) for t, d in ((F.col("sample_time"), tolerance), ((F.col("window_start_hint") + F.col("window_end_hint")) / 2, 1e-5)))))
    w = w.withColumn("__spot", F.floor((F.col("window_start") + F.col("window_end")) / 2 / width))
    x = e.withColumn("__bucket", F.explode_outer(spots)).join(w, same & (F.col("__bucket") == F.col("__spot")), "left")
    hinted = F.coalesce((F.abs(F.col("window_start") - F.col("window_start_hint")) <= 1e-6) & (F.abs(F.col("window_end") - F.col("window_end_hint")) <= 1e-6), F.lit(False))
    away = F.abs((F.col("window_start") + F.col("window_end")) / 2 - F.col("sample_time"))
    x = x.withColumns({"__hint": hinted, "__away": away})
    # the smallest of these is the match
    order = F.struct(F.when(F.col("__hint"), 0).otherwise(1).alias("h"), F.when(F.col("__hint"), -F.col("row").cast("double")).otherwise(F.col("__away")).alias("a"), F.col("row").alias("r"))
    columns = e.columns
    best = x.groupBy(*columns).agg(F.min_by(F.struct("row", "__away"), F.when(F.col("row").isNotNull(), order)).alias("b"))
    best = best.join(known, best["aircraft_id"] == known["__id"], "left").drop("__id")
    bad = (F.col("edit_action") != "clear") & (F.col("manual_label_name") != "") & F.col("manual_label_id").isNull()
    near = F.coalesce(F.col("b.__away") <= tolerance, F.lit(False))
    reason = F.when(F.col("sample_time").isNull(), "invalid_sample_time").when(F.col("__known").isNull(), "aircraft_not_found").when(~near, "no_window_within_tolerance").when(bad, "unknown_manual_label")
    hit = F.col("sample_time").isNotNull() & F.col("__known").isNotNull() & near
    return best.select(*columns, F.when(hit, F.col("b.row")).alias("row"), reason.alias("unmatched_reason"))


def apply_edits(labeled: DataFrame, edits: DataFrame, tolerance: float = 2.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labeled with manual_* and training_* columns, unmatched edits, counts).

    The last matched edit of a window sets its manual columns; the last valid one its
    training label.  clear, or an empty name, goes back to the rule's label.
    """
    m = matched(labeled, edits, tolerance)
    clears = (F.col("edit_action") == "clear") | (F.col("manual_label_name") == "")
    hits = m.filter("row IS NOT NULL")
    last = hits.groupBy("row").agg(F.max_by(F.struct("edit_index", "edit_action", "manual_label_name", "manual_label_id"), "edit_index").alias("m"))
    valid = hits.filter("unmatched_reason IS NULL").groupBy("row").agg(F.max_by(F.struct(clears.alias("clear"), "manual_label_name", "manual_label_id"), "edit_index").alias("t"))
    set_ = ~F.coalesce(F.col("t.clear"), F.lit(True))
    out = labeled.join(last, "row", "left").join(valid, "row", "left").withColumns({
        "manual_edit_index": F.col("m.edit_index"), "manual_action": F.col("m.edit_action"), "manual_label_name": F.col("m.manual_label_name"), "manual_label_id": F.col("m.manual_label_id"),
        "training_label": F.when(set_, F.col("t.manual_label_id")).otherwise(F.col("label")), "training_label_name": F.when(set_, F.col("t.manual_label_name")).otherwise(F.col("label_name")), "training_label_source": F.when(set_, "manual").otherwise("rule"),
    }).drop("m", "t")
    unmatched = m.filter("unmatched_reason IS NOT NULL")
    report = m.agg(F.count("*").alias("edits"), F.count("row").alias("matched"), F.count("unmatched_reason").alias("unmatched"))
    return out, unmatched, report


def retrain_labels(edited: DataFrame) -> DataFrame:
    """Training labels in place of the rules'; flags, scores and main_label stay the rules' own."""
    return edited.withColumns({"label": F.col("training_label"), "label_name": F.col("training_label_name")})
