"""Exclusive motion labels and non-exclusive attributes from window features, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerotrace.functions.geometry import finite
from aerotrace.schema import ATTRIBUTES, LABELS, PRIORITY, RULE_LABELS, THRESHOLDS

GUARDED = ["turn_rate_mean", "vertical_speed_mean", "pitch_mean", "g_mean", "heading_delta", "speed_slope"]


def snake(label: str) -> str:
    return label.lower()


def number(df: DataFrame, name: str) -> Column:
    """A feature, 0 where it is absent, null or not finite."""
    return F.coalesce(finite(F.col(name).cast("double")), F.lit(0.0)) if name in df.columns else F.lit(0.0)


def inputs(df: DataFrame) -> dict[str, Column]:
    v = {n: number(df, n) for n in ("turn_rate_mean", "vertical_speed_mean", "pitch_mean", "heading_delta", "g_mean", "speed_slope", "turn_rate_peak")}
    wide = {"roll_sc": ("roll_sign_changes", "short_roll_sign_changes_max"), "turn_sc": ("turn_sign_changes", "short_turn_sign_changes_max"), "roll_peak": ("roll_rate_peak", "short_roll_rate_peak_max"), "g_std": ("g_std", "short_g_std_max")}
    return {"tr": F.abs(v["turn_rate_mean"]), "vs": v["vertical_speed_mean"], "p": v["pitch_mean"], "hd": F.abs(v["heading_delta"]), "g": v["g_mean"], "slope": v["speed_slope"], "turn_peak": v["turn_rate_peak"]} | {k: F.greatest(number(df, a), number(df, b)) for k, (a, b) in wide.items()}


def rule_table(x: dict[str, Column], th: dict[str, float]) -> dict[str, tuple[Column, Column]]:
    """(flag, score) of every rule label."""
    tr, vs, p, hd, g = x["tr"], x["vs"], x["p"], x["hd"], x["g"]
    level, straight, tight = 1 - F.abs(vs) / th["vs_small"], 1 - tr / th["turn_small"], tr / th["turn_large"]
    zero = F.lit(0.0)
    swings = (x["roll_sc"] >= th["roll_sign_changes"]) | (x["turn_sc"] >= th["turn_sign_changes"])
    hard = (x["roll_peak"] >= th["roll_rate_high"]) | (x["g_std"] >= th["g_std_high"])
    out = {
        "Straight_Level": ((tr < th["turn_small"]) & (F.abs(vs) < th["vs_small"]) & (F.abs(p) < th["pitch_small"]), straight + level + (1 - F.abs(p) / th["pitch_small"])),
        "Straight_Climb": ((tr < th["turn_small"]) & (vs > th["vs_up"]), straight + vs / th["vs_up"]),
        "Straight_Descent": ((tr < th["turn_small"]) & (vs < -th["vs_down"]), straight - vs / th["vs_down"]),
        "Level_Turn": ((tr >= th["turn_large"]) & (F.abs(vs) < th["vs_small"]), tight + level),
        "Climbing_Turn": ((tr >= th["turn_large"]) & (vs > th["vs_up"]), tight + vs / th["vs_up"]),
        "Descending_Turn": ((tr >= th["turn_large"]) & (vs < -th["vs_down"]), tight - vs / th["vs_down"]),
        "Dive": ((p < -th["pitch_dive"]) & (vs < -th["vs_rapid"]), -p / th["pitch_dive"] - vs / th["vs_rapid"] + F.greatest(zero, 1 - g)),
        "Zoom_Climb": ((p > th["pitch_zoom"]) & (vs > th["vs_rapid_up"]), p / th["pitch_zoom"] + vs / th["vs_rapid_up"] + F.greatest(zero, g - 1)),
        "Large_Heading_Change": (hd >= th["heading_large"], hd / th["heading_large"]),
        "Oscillatory_Maneuver": (swings & hard, F.greatest(x["roll_sc"] / th["roll_sign_changes"], x["turn_sc"] / th["turn_sign_changes"]) + F.greatest(x["roll_peak"] / th["roll_rate_high"], x["g_std"] / th["g_std_high"])),
    }
    return {k: (flag, F.greatest(zero, score)) for k, (flag, score) in out.items()}


def half_label(turn: Column, vs: Column, p: Column, hd: Column, th: dict[str, float]) -> Column:
    tr = F.abs(turn)
    return (
        F.when((p < -th["pitch_dive"]) & (vs < -th["vs_rapid"]), "Dive")
        .when((p > th["pitch_zoom"]) & (vs > th["vs_rapid_up"]), "Zoom_Climb")
        .when((tr >= th["turn_large"]) | (F.abs(hd) >= th["heading_large"] * 0.5), F.when(vs > th["vs_up"], "Climbing_Turn").when(vs < -th["vs_down"], "Descending_Turn").when(F.abs(vs) < th["vs_small"], "Level_Turn"))
        .when(tr < th["turn_small"], F.when(vs > th["vs_up"], "Straight_Climb").when(vs < -th["vs_down"], "Straight_Descent").when((F.abs(vs) < th["vs_small"]) & (F.abs(p) < th["pitch_small"]), "Straight_Level"))
    )


def attribute_table(x: dict[str, Column], th: dict[str, float]) -> dict[str, Column]:
    swings = (x["roll_sc"] >= th["roll_sign_changes"]) | (x["turn_sc"] >= th["turn_sign_changes"])
    return dict(zip(ATTRIBUTES, [x["g"] >= th["g_high"], x["g"] <= th["g_unloaded_upper"], x["slope"] > th["acc"], x["slope"] < -th["dec"], x["roll_peak"] >= th["roll_rate_high"], x["turn_peak"] >= th["turn_high"], F.abs(x["vs"]) >= th["vs_rapid"], x["hd"] >= th["heading_large"], swings], strict=True))


def uncertain_reason(df: DataFrame, th: dict[str, float]) -> Column:
    broken = F.lit(False)
    for n in GUARDED:
        if n in df.columns:
            broken = broken | finite(F.col(n).cast("double")).isNull()
    told = {"missing_ratio": number(df, "missing_ratio") >= th["uncertain_missing_ratio"], "long_gap_ratio": number(df, "long_gap_ratio") >= th["uncertain_long_gap_ratio"], "sensor_conflict": number(df, "sensor_conflict") != 0, "feature_out_of_range": number(df, "feature_out_of_range") != 0, "non_finite_feature": broken}
    return F.concat_ws(";", *(F.when(c, k) for k, c in told.items()))


def label(df: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """df with flags, scores, attributes, reasons and the one label of each window.

    Uncertain wins over Transition, that over the first flag of the priority
    order.  A window is in transition when no rule holds, when several hold and the
    two best scores are too close, or when its halves have different labels.
    """
    if unknown := sorted(set(thresholds or {}) - set(THRESHOLDS)):
        raise ValueError(f"unknown thresholds: {', '.join(unknown)}")
    th = THRESHOLDS | (thresholds or {})
    x = inputs(df)
    table = rule_table(x, th)
    out = df.withColumns({f"score_{snake(k)}": s for k, (_, s) in table.items()})
    score = lambda k: F.col(f"score_{snake(k)}")
    flags = {k: f for k, (f, _) in table.items()}
    dominated = F.greatest(score("Dive"), score("Zoom_Climb")) > score("Large_Heading_Change") + th["large_heading_dominance_margin"]
    flags["Large_Heading_Change"] = flags["Large_Heading_Change"] & ~flags["Oscillatory_Maneuver"] & ~dominated
    out = out.withColumns({f"flag_{snake(k)}": f for k, f in flags.items()} | {f"attr_{snake(k)}": a for k, a in attribute_table(x, th).items()})
    flag = lambda k: F.col(f"flag_{snake(k)}")
    active = F.filter(F.array(*(F.when(flag(k), score(k)) for k in RULE_LABELS)), lambda s: s.isNotNull())
    ranked = F.sort_array(active, asc=False)
    half = {h: half_label(*(number(df, f"{h}_half_{n}") for n in ("turn_rate_mean", "vertical_speed_mean", "pitch_mean", "heading_delta")), th) for h in ("first", "second")}
    out = out.withColumns({"uncertain_reason": uncertain_reason(df, th), "__ranked": ranked, "__first": half["first"], "__second": half["second"]})
    close = (F.size("__ranked") >= 2) & (F.try_element_at("__ranked", F.lit(1)) - F.try_element_at("__ranked", F.lit(2)) < th["transition_score_gap"])
    differ = F.col("__first").isNotNull() & F.col("__second").isNotNull() & (F.col("__first") != F.col("__second"))
    reason = F.coalesce(F.when(F.size("__ranked") == 0, "no_rule_matched"), F.when(close, "multiple_flags_no_dominant"), F.when(differ, F.concat(F.lit("window_halves_disagree:"), "__first", F.lit("->"), "__second")), F.lit(""))
    uncertain = F.col("uncertain_reason") != ""
    out = out.withColumn("transition_reason", F.when(uncertain, "").otherwise(reason))
    main = F.coalesce(F.when(uncertain, "Uncertain"), F.when(F.col("transition_reason") != "", "Transition"), *(F.when(flag(k), k) for k in PRIORITY))
    ids = F.create_map(*(F.lit(v) for i, k in enumerate(LABELS) for v in (k, i)))
    out = out.withColumn("main_label", main).withColumn("label", ids[F.col("main_label")])
    own = [F.when(F.col(f"attr_{snake(k)}"), k) for k in ATTRIBUTES]
    return out.withColumns({"label_name": F.col("main_label"), "main_label_id": F.col("label"), "attributes": F.concat_ws(";", *own), "attribute_count": F.size(F.array_compact(F.array(*own)))}).drop("__ranked", "__first", "__second")


def label_distribution(labeled: DataFrame) -> DataFrame:
    """label, label_name, n, share of all twelve labels, absent ones with 0."""
    listed = ", ".join(f"({i}, '{n}')" for i, n in enumerate(LABELS))
    names = labeled.sparkSession.sql(f"SELECT * FROM VALUES {listed} AS t(label, label_name)")
    counts = labeled.groupBy("label").agg(F.count("*").alias("n"))
    x = names.join(F.broadcast(counts), "label", "left")  # a row a label
    n = F.coalesce("n", F.lit(0))
    total = F.sum(n).over(W.partitionBy())
    return x.select("label", "label_name", n.alias("n"), F.coalesce(n / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("share"))


def valid_classes(labeled: DataFrame, column: str = "label", least: int = 2) -> DataFrame:
    """column, n: the labels with ``least`` rows or more and how many; none if fewer than two labels are left."""
    good = labeled.groupBy(column).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return good.withColumn("__labels", F.count("*").over(W.partitionBy())).filter("__labels >= 2").drop("__labels")


def trainable(labeled: DataFrame, column: str = "label", least: int = 2) -> DataFrame:
    """The rows of labels with ``least`` rows or more; none if fewer than two labels are left."""
    return labeled.join(F.broadcast(valid_classes(labeled, column, least).select(column)), column, "left_semi")  # a row a label


def gated(labeled: DataFrame, column: str = "label", least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(trainable rows, one row: reason, removed, valid).

    reason is empty, too_few_unique_labels or too_few_valid_labels where nothing
    can be trained, else null; removed and valid are the labels with fewer rows
    than ``least``, and the others.
    """
    counts = labeled.groupBy(column).agg(F.count("*").alias("n"))
    told = counts.agg(F.count("*").alias("labels"), F.array_sort(F.collect_list(F.when(F.col("n") < least, F.col(column)))).alias("removed"), F.array_sort(F.collect_list(F.when(F.col("n") >= least, F.col(column)))).alias("valid"))
    reason = F.when(F.col("labels") == 0, "empty").when(F.col("labels") < 2, "too_few_unique_labels").when(F.size("valid") < 2, "too_few_valid_labels")
    return trainable(labeled, column, least), told.select(reason.alias("reason"), "removed", "valid")


def top_scores(labeled: DataFrame, k: int = 2) -> Column:
    """The k best (label, score) of a row's rules, ties in declaration order."""
    scored = F.array(*(F.struct((-F.col(f"score_{snake(n)}")).alias("order"), F.lit(i).alias("rank"), F.lit(snake(n)).alias("label"), F.col(f"score_{snake(n)}").alias("score")) for i, n in enumerate(RULE_LABELS)))
    return F.transform(F.slice(F.array_sort(scored), 1, k), lambda s: F.struct(s["label"].alias("label"), s["score"].alias("score")))
