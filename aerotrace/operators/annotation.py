"""Labels written back as properties of the log's objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerotrace.functions.text import escaped, formatted, object_id, property_name, truthy
from aerotrace.operators.rules import snake, top_scores
from aerotrace.operators.windows import asof_join
from aerotrace.schema import ATTRIBUTES, RULE_LABELS

ANCHORS = ("center", "start", "end")
NUMERIC = ["g_mean", "g_std", "turn_rate_mean", "turn_rate_peak", "roll_rate_peak", "vertical_speed_mean", "heading_delta", "speed_slope"]


def anchor_time(anchor: str) -> Column:
    if anchor not in ANCHORS:
        raise ValueError(f"time_anchor must be one of {ANCHORS}")
    return {"center": (F.col("window_start") + F.col("window_end")) / 2, "start": F.col("window_start"), "end": F.col("window_end")}[anchor]


def property_list(df: DataFrame, prefix: str = "Maneuver") -> Column:
    """All properties of a labelled window, in their fixed order; those without a value are left out."""
    has = set(df.columns)
    opt = lambda n, kind="string": F.col(n) if n in has else F.lit(None).cast(kind)
    say = lambda order, suffix, text: F.concat(F.lit(property_name(prefix, order, suffix) + "="), text)
    text = lambda order, suffix, c: say(order, suffix, F.when(F.trim(c) != "", escaped(c)))
    num = lambda order, suffix, c: say(order, suffix, formatted(c))
    whole = lambda order, suffix, c: say(order, suffix, c.cast("long").cast("string"))
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    name, ident = F.coalesce(some(opt("predicted_label_name")), some(opt("label_name"))), F.coalesce(opt("predicted_label", "int").cast("int"), opt("label", "int"))
    parts = [
        text(10, "PredLabel", name), whole(11, "PredLabelId", ident), num(70, "WindowStart", F.col("window_start")), num(71, "WindowEnd", F.col("window_end")), num(72, "SampleTime", F.col("sample_time")),
        text(20, "RuleLabel", F.coalesce(some(opt("rule_based_label_name")), some(opt("label_name")))), whole(21, "RuleLabelId", F.coalesce(opt("rule_based_label", "int"), opt("label", "int"))),
        text(30, "MainLabel", F.coalesce(some(opt("main_label")), some(opt("label_name")))), whole(31, "MainLabelId", F.coalesce(opt("main_label_id", "int"), opt("label", "int"))),
        text(40, "Attributes", opt("attributes")), whole(41, "AttributeCount", opt("attribute_count", "int")), text(50, "UncertainReason", opt("uncertain_reason")), text(51, "TransitionReason", opt("transition_reason")),
    ]
    for kind, names, order, listed, title in (("flag", RULE_LABELS, 200, 190, "ActiveFlags"), ("attr", ATTRIBUTES, 300, 290, "ActiveAttributes")):
        own = [snake(n) for n in names if f"{kind}_{snake(n)}" in has]
        parts += [say(order, f"{kind.capitalize()}_{n}", F.when(truthy(F.col(f"{kind}_{n}")), "1").otherwise("0")) for n in own]
        if own:
            parts.append(text(listed, title, F.concat_ws(";", *(F.when(truthy(F.col(f"{kind}_{n}")), n) for n in own))))
    if all(f"score_{snake(n)}" in has for n in RULE_LABELS):
        parts += [num(400, f"Score_{snake(n)}", F.col(f"score_{snake(n)}")) for n in RULE_LABELS]
        top = top_scores(df)
        for i, (a, b) in enumerate(((410, "Top"), (412, "Second"))):
            parts += [say(a, f"{b}ScoreLabel", F.element_at(top, i + 1)["label"]), num(a + 1, f"{b}Score", F.element_at(top, i + 1)["score"])]
    parts += [num(500, n, F.col(n)) for n in NUMERIC if n in has]
    parts += [num(500, title, F.col(n)) for n, title in (("g_mean", "ComputedGMean"), ("g_std", "ComputedGStd")) if n in has]
    return F.array_compact(F.array(*parts, F.lit(property_name(prefix, 52, "ComputedGSource") + "=trajectory_curvature_estimate")))


#: Seconds of a log that windows and frames are matched in together.
STRETCH = 3600.0


def schedule(labeled: DataFrame, frames: DataFrame, first_frames: DataFrame | None = None, anchor: str = "center", prefix: str = "Maneuver") -> DataFrame:
    """source, frame_text, rank, update: what is written after which frame line.

    labeled: source, aircraft_id, window_start, window_end and labels.  frames:
    source, frame_idx, time, frame_text.  Each window goes to the frame nearest to its
    anchor, not before its object is first seen (first_frames: source, object_id,
    first_frame); objects that the log doesn't hold are left out.  Of several windows
    of an object at one frame the last stays.
    """
    x = labeled.withColumns({"aircraft_id": object_id(F.col("aircraft_id")), "sample_time": anchor_time(anchor)}).filter("aircraft_id <> ''")
    x = x.withColumn("update", F.concat_ws(",", F.concat(F.lit(""), "aircraft_id"), F.concat_ws(",", property_list(x, prefix))))
    x = x.select("source", "aircraft_id", "window_start", "window_end", "sample_time", "update")
    x = asof_join(x, frames.select("source", F.col("time").alias("sample_time"), F.col("frame_idx").alias("at")), ["source"], "sample_time", ["at"], "nearest", bucket=STRETCH)
    if first_frames is not None:
        x = x.join(first_frames.withColumnRenamed("object_id", "aircraft_id"), ["source", "aircraft_id"]).withColumn("at", F.greatest("at", "first_frame")).drop("first_frame")
    x = x.join(frames.select("source", F.col("frame_idx").alias("at"), F.trim("frame_text").alias("frame_text")), ["source", "at"])
    x = x.groupBy("source", "frame_text", "aircraft_id").agg(F.max_by("update", F.struct("window_start", "window_end", "update")).alias("update"))
    return x.select("source", "frame_text", F.row_number().over(W.partitionBy("source", "frame_text").orderBy("aircraft_id")).alias("rank"), "update")


def first_frames(state: DataFrame) -> DataFrame:
    return state.groupBy("source", "object_id").agg(F.min("frame_idx").alias("first_frame"))
