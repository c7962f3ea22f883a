"""Registered queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerotrace import workflows
from aerotrace.functions import geometry
from aerotrace.functions.text import CRC_POLYNOMIAL, crc64_hash
from aerotrace.operators import annotation, edits, engagement, features, learning, rules, series, windows
from aerotrace.plans import adapters
from aerotrace.plans import oracles as o
from aerotrace.schema import ATTRIBUTES, FEATURES, LABELS, PAIR_FEATURES, RULE_LABELS
from aerotrace.session import visible
from aerotrace.sources import telemetry_log
from aerotrace.streaming import packets, replay

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
BY = ["object_id"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with the SQL that says the same."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            visible(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(c: Column | str, digits: int) -> Column:
    """c to some digits as SQL engines round doubles: the scaled double counts, halves away from zero, not its shortest decimal text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * 10.0**digits, 0) / 10.0**digits


def shown(df: DataFrame, keys: list[str], numbers: list[str], digits: int = 4) -> DataFrame:
    """keys as they are, numbers rounded; -0 becomes 0."""
    return df.select(*keys, *((rounded(n, digits) + F.lit(0.0)).alias(n) for n in numbers))


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.preprocess(adapters.telemetry(spark, sf_dir), BY)


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.window_features(processed(spark, sf_dir), BY)


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.label(featured(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    visible(spark)
    return rules.label_distribution(labeled(spark, sf_dir))


@query(o.said("SELECT object_id, count(DISTINCT name) AS n_names, arg_min(name, event_id) AS name, min(round(time, 4)) AS first_seen FROM tele WHERE lower(trim(obj_type)) = 'air+fixedwing' GROUP BY object_id"))
def q_target_objects(spark, sf_dir):
    x = adapters.carriers_left_out(adapters.telemetry(spark, sf_dir))
    return x.groupBy("object_id").agg(F.count_distinct("name").alias("n_names"), F.min_by("name", "event_id").alias("name"), F.min(F.round("time", 4)).alias("first_seen"))


@query(o.said("SELECT obj_type, count(*) AS n, count(DISTINCT object_id) AS objects FROM tele WHERE contains(lower(obj_type), 'air+fixedwing') OR contains(lower(obj_type), 'aircraft') OR contains(lower(obj_type), 'fixedwing') GROUP BY obj_type"))
def q_is_aircraft_filter(spark, sf_dir):
    x = adapters.telemetry(spark, sf_dir).filter(engagement.is_aircraft(F.col("obj_type")))
    return x.groupBy("obj_type").agg(F.count("*").alias("n"), F.count_distinct("object_id").alias("objects"))


@query(o.said("SELECT object_id, round(time, 6) AS time, round(yaw, 4) + 0e0 AS yaw, round(roll, 4) + 0e0 AS roll FROM unwrapped"))
def q_unwrap(spark, sf_dir):
    x = series.unwrap(series.source_rows(adapters.telemetry(spark, sf_dir), BY), BY)
    return shown(x.withColumn("time", F.round("time", 6)), ["object_id", "time"], ["yaw", "roll"])


RESAMPLED = ["world_x", "world_y", "world_z", "yaw", "pitch", "roll"]


@query(o.said(f"SELECT object_id, round(time, 6) AS time, {o.rounded(RESAMPLED)} FROM resampled"))
def q_resample_interp(spark, sf_dir):
    x = series.resample(series.unwrap(series.source_rows(adapters.telemetry(spark, sf_dir), BY), BY), BY)
    return shown(x.withColumn("time", F.round("time", 6)), ["object_id", "time"], RESAMPLED)


@query(o.said("SELECT object_id, CAST(sum(long_gap_flag) AS BIGINT) AS in_gaps, count(*) AS n FROM resampled GROUP BY object_id"))
def q_long_gap(spark, sf_dir):
    x = series.resample(series.source_rows(adapters.telemetry(spark, sf_dir), BY), BY)
    return x.groupBy("object_id").agg(F.sum("long_gap_flag").cast("long").alias("in_gaps"), F.count("*").alias("n"))


@query(o.said(f"SELECT object_id, round(time, 6) AS time, {o.rounded(RESAMPLED)} FROM smooth"))
def q_rolling_mean(spark, sf_dir):
    x = series.resample(series.unwrap(series.source_rows(adapters.telemetry(spark, sf_dir), BY), BY), BY)
    return shown(series.smoothed(x, BY, series.smoothing_width(0.6, 5.0)).withColumn("time", F.round("time", 6)), ["object_id", "time"], RESAMPLED)


@query(o.said(f"SELECT object_id, round(time, 6) AS time, {o.rounded(['yaw_rate', 'roll_rate', 'pitch_rate', 'vertical_speed'], 3)} FROM processed"))
def q_gradient(spark, sf_dir):
    return shown(processed(spark, sf_dir).withColumn("time", F.round("time", 6)), ["object_id", "time"], ["yaw_rate", "roll_rate", "pitch_rate", "vertical_speed"], 3)


@query(o.said(f"SELECT object_id, round(time, 6) AS time, {o.rounded(['speed', 'turn_rate', 'g_load'], 3)} FROM processed"))
def q_turn_rate_load(spark, sf_dir):
    return shown(processed(spark, sf_dir).withColumn("time", F.round("time", 6)), ["object_id", "time"], ["speed", "turn_rate", "g_load"], 3)


@query(o.said("SELECT object_id, win AS \"window\", round(any_value(window_start), 4) AS window_start, count(*) AS n, round(avg(altitude), 3) AS alt_mean FROM windowed GROUP BY object_id, win"))
def q_sliding_windows(spark, sf_dir):
    x = windows.sliding_windows(processed(spark, sf_dir), BY)
    return x.groupBy("object_id", "window", F.round("window_start", 4).alias("window_start")).agg(F.count("*").alias("n"), F.round(F.avg("altitude"), 3).alias("alt_mean"))


def _features(name: str, columns: list[str], whole: list[str] = [], digits: int = 3) -> None:  # noqa: B006
    """A query of some features."""
    sql = o.said(f"SELECT object_id, round(window_start, 4) AS window_start, {', '.join([*whole, o.rounded(columns, digits)] if columns else whole)} FROM features")

    def run(spark, sf_dir):
        return shown(featured(spark, sf_dir).withColumn("window_start", F.round("window_start", 4)), ["object_id", "window_start", *whole], columns, digits)

    run.__name__ = name
    query(sql)(run)


_features("q_window_slope", ["speed_slope", "alt_slope", "alt_residual_std"])
_features("q_sign_changes", ["short_turn_sign_changes_max", "short_roll_sign_changes_max", "short_pitch_sign_changes_max"], ["turn_sign_changes", "roll_sign_changes", "pitch_sign_changes"])
_features("q_half_window", [f for f in FEATURES if "half" in f])
_features("q_short_window", [f for f in FEATURES if f.startswith("short") and f != "short_window_count"], ["short_window_count"])
_features("q_quality_flags", ["missing_ratio", "long_gap_ratio"], ["sensor_conflict", "feature_out_of_range"])
_features("q_window_features", o.NUMBERS, ["sample_count", *(f for f in FEATURES if f not in o.NUMBERS)])

KEYS = "object_id, round(window_start, 4) AS window_start"


def keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", F.round("window_start", 4))


FLAG_COLUMNS = [f"flag_{k.lower()}" for k in RULE_LABELS]
SCORE_COLUMNS = [f"score_{k.lower()}" for k in RULE_LABELS]
ATTR_COLUMNS = [f"attr_{k.lower()}" for k in ATTRIBUTES]


@query(o.said(f"SELECT {KEYS}, {', '.join(FLAG_COLUMNS)} FROM flagged"))
def q_rule_flags(spark, sf_dir):
    return keyed(labeled(spark, sf_dir)).select("object_id", "window_start", *FLAG_COLUMNS)


@query(o.said(f"SELECT {KEYS}, {o.rounded(SCORE_COLUMNS, 3)} FROM scored"))
def q_rule_scores(spark, sf_dir):
    return shown(keyed(labeled(spark, sf_dir)), ["object_id", "window_start"], SCORE_COLUMNS, 3)


@query(o.said(f"SELECT {KEYS}, {', '.join(ATTR_COLUMNS)}, attributes FROM labeled"))
def q_attributes(spark, sf_dir):
    return keyed(labeled(spark, sf_dir)).select("object_id", "window_start", *ATTR_COLUMNS, "attributes")


@query(o.said(f"SELECT {KEYS}, uncertain_reason, transition_reason FROM labeled"))
def q_transition_reason(spark, sf_dir):
    return keyed(labeled(spark, sf_dir)).select("object_id", "window_start", "uncertain_reason", "transition_reason")


@query(o.said(f"SELECT {KEYS}, main_label, CAST({o.LABEL_ID} AS INT) AS label FROM labeled"))
def q_main_label(spark, sf_dir):
    return keyed(labeled(spark, sf_dir)).select("object_id", "window_start", "main_label", "label")


_NAMES = ", ".join(f"({i}, '{k}')" for i, k in enumerate(LABELS))


@query(o.said(f"SELECT CAST(v.i AS INT) AS label, v.n AS label_name, count(l.main_label) AS n, count(l.main_label) / (SELECT count(*) FROM labeled)::DOUBLE AS share FROM (VALUES {_NAMES}) v(i, n) LEFT JOIN labeled l ON l.main_label = v.n GROUP BY v.i, v.n"))
def q_label_distribution(spark, sf_dir):
    return rules.label_distribution(labeled(spark, sf_dir))


@query(o.said("SELECT main_label, count(*) AS n FROM labeled GROUP BY main_label HAVING count(*) >= 2"))
def q_valid_classes(spark, sf_dir):
    return rules.valid_classes(labeled(spark, sf_dir), "main_label")


_STRUCTS = ", ".join(f"{{'s': -round(score_{k.lower()}, 6), 'i': {i}, 'k': '{k.lower()}'}}" for i, k in enumerate(RULE_LABELS))


@query(o.said(f"SELECT {KEYS}, r[1].k AS top_label, round(-r[1].s, 3) + 0e0 AS top_score, r[2].k AS second_label, round(-r[2].s, 3) + 0e0 AS second_score FROM (SELECT *, list_sort([{_STRUCTS}]) AS r FROM scored)"))
def q_topk_scores(spark, sf_dir):
    x = keyed(labeled(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in SCORE_COLUMNS})
    x = x.withColumn("top", rules.top_scores(x))
    one, two = F.element_at("top", 1), F.element_at("top", 2)
    return x.select("object_id", "window_start", one["label"].alias("top_label"), (F.round(one["score"], 3) + 0.0).alias("top_score"), two["label"].alias("second_label"), (F.round(two["score"], 3) + 0.0).alias("second_score"))


PAIR_KEYS = ["source", "time", "self_object_id", "enemy_object_id"]
_PAIR = "source, time, sid AS self_object_id, eid AS enemy_object_id"


def state_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engagement.pairs(adapters.frames(spark, sf_dir))


def kill_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = adapters.frames(spark, sf_dir)
    lost = adapters.losses(spark, sf_dir)
    victims = state.select("source", "frame_idx", F.col("object_id").alias("victim_id"), F.col("name").alias("victim_name"), F.col("coalition").alias("victim_coalition"), F.col("world_x").alias("vx"), F.col("world_y").alias("vy"), F.col("world_z").alias("vz"), "time")
    there = state.select("source", "frame_idx", "ord", "object_id", "name", "coalition", "obj_type", F.col("world_x").alias("x"), F.col("world_y").alias("y"), F.col("world_z").alias("z"), "yaw")
    return engagement.attributed(lost.join(victims, ["source", "frame_idx", "victim_id"]), there, ["source", "frame_idx"])


@query(o.said(f"SELECT {_PAIR}, round(distance, 4) AS distance_raw FROM paired"))
def q_pairs(spark, sf_dir):
    return shown(state_pairs(spark, sf_dir), PAIR_KEYS, ["distance_raw"])


@query(o.said("""SELECT a.source, a.frame_idx, a.object_id, arg_min(b.object_id, {'d': sqrt(pow(b.world_x - a.world_x, 2) + pow(b.world_y - a.world_y, 2) + pow(b.world_z - a.world_z, 2)), 'o': b.ord}) AS enemy_id,
    round(min(sqrt(pow(b.world_x - a.world_x, 2) + pow(b.world_y - a.world_y, 2) + pow(b.world_z - a.world_z, 2))), 3) AS distance
    FROM sided a JOIN sided b ON a.source = b.source AND a.frame_idx = b.frame_idx AND a.object_id <> b.object_id AND NOT (a.coalition <> '' AND b.coalition <> '' AND a.coalition = b.coalition)
    WHERE b.altitude >= 100 AND b.speed >= 20 GROUP BY a.source, a.frame_idx, a.object_id"""))  # fmt: skip
def q_nearest_enemy(spark, sf_dir):
    return shown(engagement.nearest_opponent(adapters.frames(spark, sf_dir)), ["source", "frame_idx", "object_id", "enemy_id"], ["distance"], 3)


@query(o.said(f"SELECT {_PAIR}, {o.rounded(PAIR_FEATURES, 3)} FROM pair_features"))
def q_pair_features(spark, sf_dir):
    return shown(engagement.pair_features(state_pairs(spark, sf_dir)), PAIR_KEYS, PAIR_FEATURES, 3)


_SELF = ["self_specific_energy", "self_speed", "self_turn_rate", "self_speed_rate", "self_ps_estimate"]


@query(o.said(f"""SELECT source, object_id, time, {o.rounded(_SELF, 3)} FROM (SELECT *, coalesce((speed - lag(speed) OVER o) / (time - lag(time) OVER o), 0e0) AS self_speed_rate, coalesce((self_specific_energy - lag(self_specific_energy) OVER o) / (time - lag(time) OVER o), 0e0) AS self_ps_estimate, speed AS self_speed,
    CASE WHEN g_load <= 1 THEN 0e0 ELSE degrees(980665e-5 * sqrt(g_load * g_load - 1) / speed) END AS self_turn_rate FROM (SELECT *, altitude + speed * speed / (2 * 980665e-5) AS self_specific_energy FROM frames) WINDOW o AS (PARTITION BY source, object_id ORDER BY time))"""))  # fmt: skip
def q_self_features(spark, sf_dir):
    return shown(engagement.self_features(adapters.frames(spark, sf_dir), ["source", "object_id"]), ["source", "object_id", "time"], _SELF, 3)


@query(o.said("SELECT source, time, victim_id, victim_name, k.id AS killer_id, k.name AS killer_name FROM kills"))
def q_kill_attribution(spark, sf_dir):
    return kill_events(spark, sf_dir).select("source", "time", "victim_id", "victim_name", "killer_id", "killer_name")


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engagement.outcome_score(state_pairs(spark, sf_dir), kill_events(spark, sf_dir))


@query(o.said(f"SELECT {_PAIR}, round(score, 6) + 0e0 AS score FROM outcome"))
def q_outcome_score(spark, sf_dir):
    return shown(scored_pairs(spark, sf_dir), PAIR_KEYS, ["score"], 6)


@query(o.said("SELECT count(*) AS n, count_if(score > 1e-1) AS n_advantage, count_if(score < -1e-1) AS n_disadvantage, round(avg(score) FILTER (abs(score) > 1e-1), 6) AS mean_labeled, round(stddev_pop(score) FILTER (abs(score) > 1e-1), 6) AS std_labeled FROM outcome"))
def q_score_stats(spark, sf_dir):
    return engagement.score_stats(scored_pairs(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean_labeled", "std_labeled")})


_CAT = "CASE WHEN score > 5e-1 THEN 'ADVANTAGE' WHEN score > 2e-1 THEN 'SLIGHT_ADV' WHEN score > -2e-1 THEN 'NEUTRAL' WHEN score > -5e-1 THEN 'SLIGHT_DIS' ELSE 'DISADVANTAGE' END"


@query(o.said(f"SELECT {_CAT} AS category, count(*) AS n FROM outcome GROUP BY 1"))
def q_category(spark, sf_dir):
    return scored_pairs(spark, sf_dir).groupBy(geometry.category(F.col("score")).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k, coalesce(CAST(json_extract(props, '$.missing') AS DOUBLE), 0e0) AS props_missing FROM events")
def q_props_flatten(spark, sf_dir):
    x = adapters.events(spark, sf_dir).select("event_id", F.from_json("props", "k long, missing double").alias("props"))
    return packets.flattened(x).withColumn("props_missing", F.coalesce("props_missing", F.lit(0.0)))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_log.as_lines(adapters.named_frames(spark, sf_dir))


@query(o.said("SELECT source, frame_idx, time, object_id, name, obj_type, coalition, lon AS longitude, lat AS latitude, alt AS altitude, pitch, roll, yaw, round(lx, 3) AS world_x, round(lz, 3) AS world_z FROM logged"))
def q_log_roundtrip(spark, sf_dir):
    x = telemetry_log.frame_state(telemetry_log.classified(log_lines(spark, sf_dir)))
    return shown(x, ["source", "frame_idx", "time", "object_id", "name", "obj_type", "coalition", "longitude", "latitude", "altitude", "pitch", "roll", "yaw"], ["world_x", "world_z"], 3)


@query(o.said("SELECT source, frame_idx, count(*) AS live, sum(ord) AS ids FROM logged GROUP BY source, frame_idx"))
def q_frame_densify(spark, sf_dir):
    x = telemetry_log.frame_state(telemetry_log.classified(log_lines(spark, sf_dir)))
    return x.groupBy("source", "frame_idx").agg(F.count("*").alias("live"), F.sum(F.substring("object_id", 2, 20).cast("long")).alias("ids"))


@query(o.said("SELECT source, frame_idx, object_id, round(coalesce(speed, 0e0), 2) + 0e0 AS speed, round(coalesce(sqrt((vx - ux) / dt * (vx - ux) / dt + ((vy - uy) / dt + 980665e-5) * ((vy - uy) / dt + 980665e-5) + (vz - uz) / dt * (vz - uz) / dt) / 980665e-5, 1e0), 3) AS g_load FROM logged"))
def q_fd_speed_g(spark, sf_dir):
    x = telemetry_log.frame_state(telemetry_log.classified(log_lines(spark, sf_dir)))
    return x.select("source", "frame_idx", "object_id", (F.round("speed", 2) + 0.0).alias("speed"), F.round("g_load", 3).alias("g_load"))


@query(o.said("SELECT DISTINCT source, source AS title FROM named"))
def q_log_globals(spark, sf_dir):
    return telemetry_log.global_properties(telemetry_log.classified(log_lines(spark, sf_dir))).select("source", F.col("Title").alias("title"))


@query(o.said("SELECT source, time, victim_id, victim_name, k.id AS killer_id, k.name AS killer_name FROM log_kills"))
def q_log_kills(spark, sf_dir):
    lines = log_lines(spark, sf_dir).union(adapters.told_losses(spark, sf_dir))
    return telemetry_log.kill_events(telemetry_log.classified(lines)).select("source", "time", "victim_id", "victim_name", "killer_id", "killer_name")


def scheduled(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = telemetry_log.classified(log_lines(spark, sf_dir))
    first = annotation.first_frames(telemetry_log.updates(x).filter("kind = 'update'"))
    return annotation.schedule(adapters.event_windows(spark, sf_dir).drop("row"), telemetry_log.frames_of(x), first)


@query(o.said("SELECT source, aircraft_id, window_start, nearest AS frame_idx FROM anchored"))
def q_nearest_frame(spark, sf_dir):
    frames = telemetry_log.frames_of(telemetry_log.classified(log_lines(spark, sf_dir)))
    x = adapters.event_windows(spark, sf_dir).select("source", "aircraft_id", "window_start", ((F.col("window_start") + F.col("window_end")) / 2).alias("t"))
    return windows.asof_join(x, frames.withColumnRenamed("time", "t"), ["source"], "t", ["frame_idx"], "nearest", bucket=4.0).select("source", "aircraft_id", "window_start", "frame_idx")


@query(o.said('SELECT source, frame_text, row_number() OVER (PARTITION BY source, frame_text ORDER BY aircraft_id) AS rank, "update" FROM lined'))
def q_annotation_lines(spark, sf_dir):
    return scheduled(spark, sf_dir)


@query(o.said("SELECT source, kind, count(*) AS n FROM (SELECT source, 'added' AS kind FROM lined UNION ALL SELECT source, 'kept' FROM named UNION ALL SELECT DISTINCT source, 'mark' || frame_idx FROM named UNION ALL SELECT source, 'head' FROM (SELECT DISTINCT source FROM named), range(3)) GROUP BY source, kind").replace("'mark' || frame_idx", "'mark' || CAST(frame_idx AS STRING)"))
def q_annotated_text(spark, sf_dir):
    x = telemetry_log.written(log_lines(spark, sf_dir), scheduled(spark, sf_dir))
    raw = F.col("raw")
    kind = F.when(F.col("rank") > 0, "added").when(raw.startswith("#"), F.concat(F.lit("mark"), F.regexp_extract(raw, r"#(\d+)\.", 1))).when(raw.startswith("File") | raw.startswith("0,"), "head").otherwise("kept")
    return x.groupBy("source", kind.alias("kind")).agg(F.count("*").alias("n"))


@query(o.said("""SELECT source, source AS title, (SELECT count(*) FROM marks m WHERE m.source = x.source) AS frame_count, count(*) AS aircraft_count, CAST(sum(CASE WHEN t1 - t0 >= 5 THEN floor((t1 + 1e-9 - 5 - t0) / 25e-1) + 1 ELSE 0 END) AS BIGINT) AS window_count
    FROM (SELECT source, object_id, min(time) AS t0, max(time) AS t1 FROM logged WHERE obj_type = 'Air+FixedWing' GROUP BY source, object_id) x GROUP BY source"""))
def q_pipeline_summary(spark, sf_dir):
    lines = log_lines(spark, sf_dir)
    return workflows.file_summary(lines, workflows.extract(lines))


@query(o.said("SELECT source, (SELECT count(*) FROM marks m WHERE m.source = l.source) AS frame_count, count(DISTINCT frame_text) AS annotation_frames, count(*) AS annotation_rows FROM lined l GROUP BY source"))
def q_annotation_counts(spark, sf_dir):
    return workflows.annotation_counts(log_lines(spark, sf_dir), scheduled(spark, sf_dir))


@query(o.said("SELECT 'none' AS reason, coalesce(string_agg(CAST(label AS VARCHAR), ';' ORDER BY label) FILTER (n < 2), '') AS removed, coalesce(string_agg(CAST(label AS VARCHAR), ';' ORDER BY label) FILTER (n >= 2), '') AS valid FROM (SELECT {} AS label, count(*) AS n FROM labeled GROUP BY 1)".format(o.LABEL_ID)))
def q_training_gate(spark, sf_dir):
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ";").alias(c)
    return rules.gated(labeled(spark, sf_dir))[1].select(F.coalesce("reason", F.lit("none")).alias("reason"), listed("removed"), listed("valid"))


@query("SELECT CAST(user_id AS STRING) AS session, count(*) AS frames, max(event_id / 1e4) - min(event_id / 1e4) AS duration FROM events GROUP BY user_id")
def q_session_summary(spark, sf_dir):
    x = adapters.events(spark, sf_dir).selectExpr("CAST(user_id AS STRING) AS session", "event_id / 1e4 AS time")
    return packets.session_summary(x).select("session", "frames", "duration")


@query(o.said("SELECT row, label, label_name, manual_edit_index, training_label_name FROM applied"))
def q_manual_edits(spark, sf_dir):
    out, _, _ = edits.apply_edits(adapters.event_windows(spark, sf_dir), adapters.human_edits(spark, sf_dir))
    return out.select("row", "label", "label_name", "manual_edit_index", "training_label_name")


@query(o.said("SELECT edit_index, reason AS unmatched_reason FROM met WHERE reason IS NOT NULL"))
def q_edit_unmatched(spark, sf_dir):
    return edits.apply_edits(adapters.event_windows(spark, sf_dir), adapters.human_edits(spark, sf_dir))[1].select("edit_index", "unmatched_reason")


@query(o.said("SELECT count(*) AS edits, count_if(hit) AS matched, count(reason) AS unmatched FROM met"))
def q_edit_report(spark, sf_dir):
    return edits.apply_edits(adapters.event_windows(spark, sf_dir), adapters.human_edits(spark, sf_dir))[2]


_ONES = "18446744073709551615::UBIGINT"
_BITS = "list_transform(range(16 * length(n_name)), lambda i: CAST((unicode(n_name[i // 16 + 1]) >> (i % 16)) & 1 AS UBIGINT))"


@query(f"""SELECT n_name, '0x' || lpad(lower(to_hex(xor(list_reduce(list_prepend({_ONES}, {_BITS}), lambda c, b: xor(c >> 1::UBIGINT, CASE WHEN xor(c, b) & 1::UBIGINT = 1 THEN {CRC_POLYNOMIAL}::UBIGINT ELSE 0::UBIGINT END)), {_ONES}))), 16, '0') AS digest FROM nation""")
def q_crc64(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", crc64_hash(F.col("n_name")).alias("digest"))


@query("SELECT label, count(*) AS n, CAST(greatest(0, least(count(*) - 1, greatest(1, round(count(*) * 2e-1)))) AS BIGINT) AS n_test FROM embeddings GROUP BY label")
def q_split_counts(spark, sf_dir):
    x = learning.split(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), ["vec_id"], 0.2, "label")
    return x.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_test").alias("n_test"))


@query("SELECT label, count(*) AS n, round((SELECT count(*) FROM embeddings) / (SELECT count(DISTINCT label) FROM embeddings) / count(*), 6) AS weight FROM embeddings GROUP BY label")
def q_class_weights(spark, sf_dir):
    return learning.class_weights(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("weight", F.round("weight", 6))


GUESS = "SELECT label, CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 4 ELSE label END AS predicted FROM embeddings"


def guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("label", "CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 4 ELSE label END AS predicted")


@query(f"SELECT label, predicted, count(*) AS n FROM ({GUESS}) GROUP BY label, predicted")
def q_confusion(spark, sf_dir):
    return learning.confusion(guessed(spark, sf_dir))


_REPORT = f"""SELECT label, support, precision, recall, CASE WHEN precision + recall = 0 THEN 0e0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM (
    SELECT label, sum(s) AS support, CASE WHEN sum(p) = 0 THEN 0e0 ELSE sum(r) / sum(p) END AS precision, CASE WHEN sum(s) = 0 THEN 0e0 ELSE sum(r) / sum(s) END AS recall FROM (
        SELECT label, 1 AS s, 0 AS p, CAST(label = predicted AS INT) AS r FROM ({GUESS}) UNION ALL SELECT predicted, 0, 1, 0 FROM ({GUESS})) GROUP BY label)"""


@query(f"SELECT label, CAST(support AS BIGINT) AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ({_REPORT})")
def q_class_report(spark, sf_dir):
    return shown(learning.class_report(guessed(spark, sf_dir)), ["label", "support"], ["precision", "recall", "f1"], 6)


@query(f"SELECT round(sum(recall * support) / sum(support), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM ({_REPORT})")
def q_metrics(spark, sf_dir):
    return shown(learning.class_metrics(guessed(spark, sf_dir)), [], ["accuracy", "precision", "recall", "f1"], 6)


@query("""SELECT round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2,
    round(avg(CASE WHEN CASE WHEN y > 3e-1 THEN 1 WHEN y < -3e-1 THEN -1 ELSE 0 END = CASE WHEN p > 3e-1 THEN 1 WHEN p < -3e-1 THEN -1 ELSE 0 END THEN 1e0 ELSE 0e0 END), 6) AS category_accuracy
    FROM (SELECT l_discount * 2e1 - 1 AS y, l_tax * 25e0 - 1 AS p FROM (SELECT CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_tax AS DOUBLE) AS l_tax FROM lineitem))""")
def q_regression_metrics(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("CAST(l_discount AS DOUBLE) * 2e1 - 1 AS score", "CAST(l_tax AS DOUBLE) * 25e0 - 1 AS predicted")
    return shown(learning.regression_metrics(x), [], ["mae", "rmse", "r2", "category_accuracy"], 6)


EMBEDDED = [f"e{i}" for i in range(64)]


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(EMBEDDED)))


@query()
def q_rf_classify(spark, sf_dir):
    x = learning.split(embedded(spark, sf_dir), ["vec_id"], by="label")
    model = learning.train_classifier(x.filter("NOT is_test"), EMBEDDED, trees=20, depth=8)
    return learning.class_metrics(learning.predict(x.filter("is_test"), model, EMBEDDED), "label", "predicted_label")


@query()
def q_ridge(spark, sf_dir):
    x = learning.split(embedded(spark, sf_dir), ["vec_id"]).withColumn("score", F.col("e0") - F.col("e1"))
    model = learning.train_regressor(x.filter("NOT is_test"), EMBEDDED[2:])
    return learning.score(x.filter("is_test"), model, EMBEDDED[2:]).select("vec_id", "advantage", "category", "category_ja")


@query("SELECT source, count(DISTINCT object_id) AS aircraft_count, count(DISTINCT frame_idx) AS frame_count, count(*) AS state_count FROM ({}) GROUP BY source".format(o.said("SELECT * FROM frames")))
def q_file_summary(spark, sf_dir):
    return adapters.frames(spark, sf_dir).groupBy("source").agg(F.count_distinct("object_id").alias("aircraft_count"), F.count_distinct("frame_idx").alias("frame_count"), F.count("*").alias("state_count"))


@query("SELECT DISTINCT label FROM (SELECT CAST(quality AS INT) AS label FROM labels UNION ALL SELECT label FROM embeddings) WHERE label NOT IN (SELECT toxic FROM labels)")
def q_label_sets(spark, sf_dir):
    one = spark.read.parquet(f"{sf_dir}/labels.parquet")
    both = one.select(F.col("quality").cast("int").alias("label")).union(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").cast("int")))
    return both.distinct().exceptAll(one.select(F.col("toxic").cast("int").alias("label")).distinct())


_BEFORE = "lag({}) OVER (PARTITION BY user_id ORDER BY event_id)"
_DTS = f"(event_id - {_BEFORE.format('event_id')})"


@query(f"""SELECT session, time, has_enemy, round(distance, 4) AS distance, round(e, 4) AS self_specific_energy, CAST(coalesce((value - b) / dt, 0e0) + 0e0 AS FLOAT) AS self_speed_rate, CAST(coalesce((e - eb) / dt, 0e0) + 0e0 AS FLOAT) AS self_ps_estimate FROM (
    SELECT CAST(user_id AS STRING) AS session, CAST(event_id AS DOUBLE) AS time, event_id % 3 <> 0 AS has_enemy, CASE WHEN event_id % 3 <> 0 THEN 5000e0 ELSE 0e0 END AS distance, value, e, {_BEFORE.format('value')} AS b, {_BEFORE.format('e')} AS eb, {_DTS} AS dt
    FROM (SELECT *, 5000 + value + (200 + value) * (200 + value) / (2 * 980665e-5) AS e FROM events))""")
def q_stream_features(spark, sf_dir):
    return replay.table_of(spark, sf_dir, lambda events: packets.rates(packets.parsed(replay.packets(events)))).select("session", "time", "has_enemy", F.round("distance", 4).alias("distance"), F.round("self_specific_energy", 4).alias("self_specific_energy"), (F.col("self_speed_rate") + 0.0).cast("float").alias("self_speed_rate"), (F.col("self_ps_estimate") + 0.0).cast("float").alias("self_ps_estimate"))


@query("""WITH RECURSIVE kept AS (SELECT user_id, min(event_id / 1e4) AS t FROM events GROUP BY user_id
    UNION ALL SELECT k.user_id, min(e.event_id / 1e4) FROM kept k JOIN events e ON e.user_id = k.user_id AND e.event_id / 1e4 - k.t >= 1 / 30e0 - 1e-9 GROUP BY k.user_id, k.t)
    SELECT CAST(user_id AS STRING) AS session, t AS time FROM kept""")
def q_stream_throttle(spark, sf_dir):
    return replay.table_of(spark, sf_dir, lambda events: packets.throttled(events.selectExpr("CAST(user_id AS STRING) AS session", "event_id / 1e4 AS time"), 30.0))


@query("SELECT CAST(user_id AS STRING) AS session, max(CAST(event_id AS DOUBLE)) AS time FROM events GROUP BY user_id")
def q_latest_per_session(spark, sf_dir):
    x = adapters.events(spark, sf_dir).selectExpr("CAST(user_id AS STRING) AS session", "CAST(event_id AS DOUBLE) AS time")
    return packets.latest(x)


_TOLD = "SELECT CAST(user_id // 15 AS VARCHAR) AS session, event_id, 'A' || user_id AS object_id, event_id % 10 = 0 AS marks, event_id % 7 = 0 AS ends, 'T=' || event_id AS value FROM events"


@query(f"""WITH told AS ({_TOLD}), own AS (SELECT DISTINCT session, object_id FROM told)
    SELECT session, frame, object_id, value FROM (SELECT f.session, CAST(f.event_id AS VARCHAR) AS frame, o.object_id, f.event_id FROM told f JOIN own o ON o.session = f.session WHERE f.marks) f
    ASOF JOIN (SELECT session AS s, object_id AS o, event_id AS e, ends, value FROM told WHERE NOT marks) u ON u.s = f.session AND u.o = f.object_id AND f.event_id >= u.e WHERE NOT ends""")
def q_stream_locf(spark, sf_dir):
    raw = "CASE WHEN event_id % 10 = 0 THEN concat('#', event_id) WHEN event_id % 7 = 0 THEN concat('-A', user_id) ELSE concat('A', user_id, ',T=', event_id) END AS raw"
    return replay.table_of(spark, sf_dir, lambda events: packets.carried(events.selectExpr("CAST(user_id DIV 15 AS STRING) AS session", "event_id AS line_no", raw)))


_TOLD_KEYS = ["session", "time", "has_enemy", "self_object_id", "enemy_object_id"]


@query(o.said(f"SELECT {', '.join(_TOLD_KEYS)}, {o.rounded(PAIR_FEATURES, 3)} FROM rt_features"))
def q_stream_engagement(spark, sf_dir):
    x = replay.table_of(spark, sf_dir, lambda events: packets.realtime_rates(adapters.realtime_lines(events)))
    return shown(x, _TOLD_KEYS, PAIR_FEATURES, 3)
