"""Tables, labels and thresholds of the engine; every name list is in its meaningful order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Labels by id, attributes, priorities and default thresholds.
LABELS = ["Straight_Level", "Straight_Climb", "Straight_Descent", "Level_Turn", "Climbing_Turn", "Descending_Turn", "Dive", "Zoom_Climb", "Large_Heading_Change", "Oscillatory_Maneuver", "Transition", "Uncertain"]
ATTRIBUTES = ["High_G", "Unloaded", "Accelerating", "Decelerating", "High_Roll_Rate", "High_Turn_Rate", "Rapid_Altitude_Change", "Heading_Reversal_Like", "Jinking_Like"]
RULE_LABELS = LABELS[:10]
PRIORITY = ["Oscillatory_Maneuver", "Large_Heading_Change", "Dive", "Zoom_Climb", "Climbing_Turn", "Descending_Turn", "Level_Turn", "Straight_Climb", "Straight_Descent", "Straight_Level"]
THRESHOLDS = {
    "turn_small": 3.0, "turn_large": 10.0, "turn_high": 18.0, "vs_small": 5.0, "vs_up": 10.0, "vs_down": 10.0, "vs_rapid": 30.0, "vs_rapid_up": 30.0,
    "pitch_small": 5.0, "pitch_dive": 15.0, "pitch_zoom": 15.0, "g_unloaded_upper": 0.7, "g_high": 5.5, "g_pull": 2.0, "g_std_high": 0.8,
    "roll_sign_changes": 2.0, "turn_sign_changes": 2.0, "roll_rate_high": 60.0, "heading_large": 110.0, "acc": 1.0, "dec": 1.0,
    "uncertain_missing_ratio": 0.35, "uncertain_long_gap_ratio": 0.25, "transition_score_gap": 0.35, "large_heading_dominance_margin": 0.25,
}
CATEGORIES = [("ADVANTAGE", "有利", 0.5), ("SLIGHT_ADV", "やや有利", 0.2), ("NEUTRAL", "互角", -0.2), ("SLIGHT_DIS", "やや不利", -0.5), ("DISADVANTAGE", "不利", None)]
GRAVITY = 9.80665
KNOTS = 0.514444
EARTH_RADIUS = 6378137.0
SOUND_SPEED = 340.0

SIGNALS = ["altitude", "world_x", "world_y", "world_z", "yaw", "pitch", "roll"]
FEATURES = [
    "speed_mean", "speed_delta", "speed_slope", "alt_mean", "alt_delta", "alt_slope", "pitch_mean", "roll_mean", "g_mean", "g_std",
    "turn_rate_mean", "turn_rate_peak", "roll_rate_mean", "roll_rate_peak", "pitch_rate_mean", "vertical_speed_mean", "vertical_speed_peak", "heading_delta",
    "turn_sign_changes", "roll_sign_changes", "pitch_sign_changes", "alt_residual_std", "dive_score_raw", "zoom_score_raw", "straightness_score", "turn_dominance",
    "first_half_turn_rate_mean", "second_half_turn_rate_mean", "first_half_vertical_speed_mean", "second_half_vertical_speed_mean",
    "first_half_pitch_mean", "second_half_pitch_mean", "first_half_heading_delta", "second_half_heading_delta",
    "short_window_count", "short_turn_sign_changes_max", "short_roll_sign_changes_max", "short_pitch_sign_changes_max", "short_turn_rate_peak_max", "short_roll_rate_peak_max", "short_g_std_max",
    "missing_ratio", "long_gap_ratio", "sensor_conflict", "feature_out_of_range",
]
PAIR_FEATURES = [
    "distance", "aspect_angle", "antenna_train_angle", "heading_crossing_angle", "altitude_diff", "bearing", "self_specific_energy", "enemy_specific_energy", "delta_specific_energy",
    "self_speed", "enemy_speed", "speed_ratio", "self_turn_rate", "enemy_turn_rate", "relative_turn_rate", "self_g_load", "self_speed_rate", "distance_rate", "ata_rate", "self_ps_estimate",
]


def _struct(strings: list[str], doubles: list[str]) -> T.StructType:
    return T.StructType([T.StructField(x, T.StringType()) for x in strings] + [T.StructField(x, T.DoubleType()) for x in doubles])


#: State of an object: strings, then doubles with their values before anything is known.
STATE_TEXT = ["name", "pilot", "obj_type", "coalition", "country"]
STATE_NUMBER = {x: 0.0 for x in ["longitude", "latitude", "altitude", "roll", "pitch", "yaw", "speed", "ias", "tas", "mach", "aoa", "g_load", "world_x", "world_y", "world_z"]} | {"g_load": 1.0}
STATE = _struct(["object_id", *STATE_TEXT], list(STATE_NUMBER))

_AIRCRAFT = T.StructType([T.StructField(x, T.StringType()) for x in ("name", "type")] + [T.StructField(x, T.DoubleType()) for x in ("x", "y", "z", "heading", "pitch", "bank", "TAS", "IAS", "mach", "alt_asl", "alt_agl", "AoA", "AoS", "Gx", "Gy", "Gz", "roll_rate", "pitch_rate", "yaw_rate", "throttle", "fuel_internal")])
_ENEMY = T.StructType([T.StructField(x, T.StringType()) for x in ("id", "name")] + [T.StructField(x, T.DoubleType()) for x in ("lat", "lon", "alt", "x", "y", "z", "heading", "pitch", "bank", "forward_x", "forward_y", "forward_z")])
PACKET = T.StructType([T.StructField("timestamp", T.DoubleType()), T.StructField("model_time", T.DoubleType()), T.StructField("has_enemy", T.BooleanType()), T.StructField("self_only", T.BooleanType()), T.StructField("self_aircraft", _AIRCRAFT), T.StructField("enemy_aircraft", _ENEMY)])

EDITS = T.StructType(
    [T.StructField("edit_index", T.IntegerType()), T.StructField("edit_action", T.StringType()), T.StructField("edited_utc", T.StringType()), T.StructField("aircraft_id", T.StringType()), T.StructField("aircraft_name", T.StringType())]
    + [T.StructField(x, T.DoubleType()) for x in ("sample_time", "window_start_hint", "window_end_hint")]
    + [T.StructField("manual_label_name", T.StringType()), T.StructField("manual_label_id", T.IntegerType())]
    + [T.StructField(x, T.StringType()) for x in ("previous_predicted_label", "previous_rule_label", "previous_main_label", "addon_version")]
)


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
