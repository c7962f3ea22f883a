"""The driver's tables as telemetry.

Every user of ``events`` flies one of sixteen paths: ten smooth ones, and six with a
turning nose, readings out of range, missing readings, a climb between the rules,
one between two rules and a wave; half a second of flight is a day of events, so
the default windows and gaps all come to bear.  The SQL of the
path is plain enough for both engines and is used by both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerotrace.schema import LABELS

V = "CASE WHEN kind IN (3, 4, 5) THEN 150e0 WHEN kind = 8 THEN 80e0 ELSE 220e0 END"
TURN = "CASE WHEN kind IN (3, 4, 5) THEN 14e0 WHEN kind = 8 THEN 30e0 ELSE 0e0 END"
CLIMB = "CASE WHEN kind IN (1, 4) THEN 20e0 WHEN kind IN (2, 5) THEN -20e0 WHEN kind = 6 THEN -60e0 WHEN kind = 7 THEN 60e0 WHEN kind = 11 THEN 4e2 WHEN kind = 13 THEN 7e0 WHEN kind = 14 THEN 31e0 ELSE 0e0 END"
PITCH = "CASE WHEN kind IN (1, 4) THEN 6e0 WHEN kind IN (2, 5) THEN -6e0 WHEN kind = 6 THEN -25e0 WHEN kind = 7 THEN 25e0 WHEN kind = 11 THEN 12e1 WHEN kind = 14 THEN 46e0 ELSE 0e0 END"
#: Columns of the path from kind and t, for Spark and DuckDB alike.
PATH = f"""
    CASE WHEN kind IN (3, 4, 5, 8) THEN ({V}) / radians({TURN}) * sin(radians({TURN}) * t) ELSE ({V}) * t END AS world_x,
    5e3 + ({CLIMB}) * t + CASE WHEN kind = 15 THEN 172e0 * sin(2 * pi() * t / 24e0) ELSE 0e0 END AS world_y,
    CASE WHEN kind IN (3, 4, 5, 8) THEN ({V}) / radians({TURN}) * (1 - cos(radians({TURN}) * t)) ELSE 0e0 END AS world_z,
    (CASE WHEN kind = 10 THEN 3e1 ELSE {TURN} END * t) % 36e1 AS yaw, {PITCH} AS pitch,
    CASE WHEN kind = 9 THEN 8e1 * sin(2 * pi() * t / 16e-1) ELSE 0e0 END AS roll"""
PERSON = """CAST(user_id AS STRING) AS object_id, user_id, event_id, event_type, value,
    CAST(user_id % 16 AS INT) AS kind, CASE WHEN user_id % 11 = 0 THEN 'Sea+Watercraft+AircraftCarrier' ELSE 'Air+FixedWing' END AS obj_type,
    CASE user_id % 3 WHEN 0 THEN 'Blue' WHEN 1 THEN 'Red' ELSE '' END AS coalition, concat('P', CAST(user_id AS STRING)) AS name"""
#: One of the paths loses its pitch in every other reading.
SEEN = "CASE WHEN kind = 12 AND event_id % 2 = 0 THEN NULL ELSE pitch END"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, time and signals of every event, with who flies and what happened."""
    t = "5e-1 * timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) / 864e8 AS t"
    x = events(spark, sf_dir).selectExpr(*[p.strip() for p in _split(PERSON)], t)
    return x.selectExpr("object_id", "user_id", "event_id", "event_type", "value", "obj_type", "coalition", "name", "kind", "t AS time", *[p.strip() for p in _split(PATH)]).withColumns({"altitude": F.col("world_y"), "pitch": F.expr(SEEN)}).drop("kind")


def _split(text: str) -> list[str]:
    """The parts of a select list: cut at commas outside brackets and quotes."""
    out, depth, quoted, now = [], 0, False, ""
    for ch in text:
        quoted ^= ch == "'"
        depth += (not quoted) * ((ch == "(") - (ch == ")"))
        if ch == "," and depth == 0 and not quoted:
            out.append(now)
            now = ""
        else:
            now += ch
    return [*out, now]


def carriers_left_out(tele: DataFrame) -> DataFrame:
    return tele.filter(F.lower(F.trim("obj_type")) == "air+fixedwing")


#: Columns of a frame from kind, t, v and user_id, for both engines: twenty users share an arena, on a lattice, so that distances can be equal.
ARENA = f"""
    arena AS source, frame_idx, t AS time, CAST(user_id AS STRING) AS object_id, user_id AS ord, name, coalition, obj_type,
    world_x + (user_id % 7) * 9e2 + v * 5e1 AS world_x, world_y, world_z + (user_id % 5) * 7e2 AS world_z, world_y AS altitude, yaw, pitch, roll,
    sqrt(({V}) * ({V}) + ({CLIMB}) * ({CLIMB})) + v AS speed, 0e0 AS mach, 0e0 AS aoa, 1 + kind / 5e0 AS g_load, v"""
#: Microseconds of events in a frame, which lasts a second of flight.
FRAME_MICROS = 2 * 24 * 3600 * 1_000_000
_MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)"
_PLACE = "concat('arena', CAST(user_id DIV 20 AS STRING))"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every user in each frame of two days in which it has events, by the value of its last one; in arenas of twenty users."""
    x = events(spark, sf_dir).selectExpr("user_id", "event_id", "value", f"CAST({_MICROS} DIV {FRAME_MICROS} AS INT) AS frame_idx")
    x = x.groupBy("user_id", "frame_idx").agg(F.max_by("value", "event_id").alias("value"))
    x = x.selectExpr("user_id", "frame_idx", "CAST(floor(value) AS BIGINT) AS v", "frame_idx * 1e0 AS t", "CAST(user_id % 10 AS INT) AS kind", f"{_PLACE} AS arena", "concat('P', CAST(user_id AS STRING)) AS name", "CASE user_id % 3 WHEN 0 THEN 'Blue' WHEN 1 THEN 'Red' ELSE '' END AS coalition", "CASE WHEN user_id % 11 = 0 THEN 'Sea+Watercraft+AircraftCarrier' ELSE 'Air+FixedWing' END AS obj_type")
    return x.selectExpr("*", *[p.strip() for p in _split(PATH)]).selectExpr(*[p.strip() for p in _split(ARENA)])


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loss in the frame of every error of every user, once a frame: source, frame_idx, victim_id."""
    x = events(spark, sf_dir).filter("event_type = 'error'").selectExpr("user_id", f"CAST({_MICROS} DIV {FRAME_MICROS} AS INT) AS frame_idx").distinct()
    return x.selectExpr(f"{_PLACE} AS source", "frame_idx", "CAST(user_id AS STRING) AS victim_id")


def told_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log line after all others for every user with an error event: who was destroyed (even ids) or left (odd ones)."""
    x = events(spark, sf_dir).filter("event_type = 'error'").select("user_id").distinct()
    return x.selectExpr(f"{_PLACE} AS source", "100000 + user_id % 20 AS line_no", "concat('0,Event=', CASE WHEN user_id % 2 = 0 THEN 'Destroyed' ELSE 'LeftArea' END, '|A', CAST(user_id AS STRING), '|') AS raw")


def named_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames with the transform of a log line; every fourth object is removed in the eighth frame, if it has one, and tells nothing later."""
    x = frames(spark, sf_dir).filter("ord % 4 <> 0 OR frame_idx <= 7")
    return x.selectExpr("source", "frame_idx", "time", "ord", "concat('A', object_id) AS object_id", "name", "obj_type", "coalition", f"CASE WHEN ord % 4 = 0 AND frame_idx = 7 THEN NULL ELSE {TRANSFORM} END AS transform")


LON = "concat('44.', lpad(CAST(frame_idx * 7 + ord % 50 + v AS STRING), 4, '0'))"
LAT = "concat('41.', lpad(CAST(frame_idx * 5 + ord % 40 + 2 * v AS STRING), 4, '0'))"
ALT = "CAST(5000 + frame_idx * 3 + ord % 9 + v AS STRING)"
TRANSFORM = f"concat({LON}, '|', {LAT}, '|', {ALT}, '|', CASE WHEN frame_idx % 2 = 0 THEN CAST(ord % 30 AS STRING) ELSE '' END, '|2|', CAST(ord % 360 AS STRING))"


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of five seconds from each frame of each user on, with a label by the event's value: source, aircraft_id, window_start, window_end, label, label_name, row."""
    names = ", ".join(f"'{n}'" for n in LABELS)
    x = frames(spark, sf_dir).selectExpr("source", "concat('A', object_id) AS aircraft_id", "time AS window_start", "time + 5 AS window_end", "CAST((ord + v) % 12 AS INT) AS label", "ord * 100 + frame_idx AS row")
    return x.selectExpr("source", "aircraft_id", "window_start", "window_end", "label", f"element_at(array({names}), label + 1) AS label_name", "row")


def human_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """purchase sets a label, signup clears one, at the event's time; every thirteenth name is unknown and some objects and times are wrong."""
    names = ", ".join(f"'{n}'" for n in [*LABELS, "Bogus"])
    return events(spark, sf_dir).filter("event_type IN ('purchase', 'signup')").selectExpr(
        "event_id AS edit_index", "CASE event_type WHEN 'purchase' THEN 'set' ELSE 'clear' END AS edit_action", "concat('A', CAST(CASE WHEN event_id % 17 = 0 THEN user_id + 1000000 ELSE user_id END AS STRING)) AS aircraft_id",
        f"CASE WHEN event_id % 19 = 0 THEN NULL ELSE {_MICROS} / CAST({FRAME_MICROS} AS DOUBLE) END AS sample_time", f"element_at(array({names}), CAST(event_id % 13 AS INT) + 1) AS manual_label_name",
    )


#: Realtime lines of the events, for both engines: fifteen users share a session, an hour is a second, every tenth event ends a frame,
#: some events end an object, one user in fifteen is the player, one in five is parked and one in three tells its speed, now and then.
LINE = """
    concat('s', CAST(CAST(floor(user_id / 15) AS BIGINT) AS STRING)) AS session, event_id, user_id, event_id AS line_no, CAST(floor(value * 1e2) AS BIGINT) AS v,
    CASE WHEN event_id % 10 = 0 THEN 'mark' WHEN event_id % 97 = 1 THEN 'end' ELSE 'update' END AS line_kind,
    CASE WHEN user_id % 11 = 0 THEN 'Ground+Static' ELSE 'Air+FixedWing' END AS obj_type, CASE user_id % 3 WHEN 0 THEN 'Blue' WHEN 1 THEN 'Red' ELSE '' END AS coalition"""
MOVED = """
    concat('44.', lpad(CAST(v % 10000 AS STRING), 4, '0')) AS lon, concat('41.', lpad(CAST((v * 7 + event_id) % 1000 AS STRING), 4, '0')) AS lat, CAST(CASE WHEN user_id % 5 = 1 THEN 50 ELSE 3000 + v % 4000 END AS STRING) AS alt,
    CASE WHEN event_id % 2 = 0 THEN CAST(v % 60 AS STRING) ELSE '' END AS roll, CAST(v % 20 AS STRING) AS pitch, CASE WHEN event_id % 3 = 0 THEN CAST(v % 360 AS STRING) ELSE '' END AS yaw,
    CASE WHEN user_id % 3 = 0 AND event_id % 2 = 0 THEN v % 400 END AS knots"""


def realtime_lines(events: DataFrame) -> DataFrame:
    """session, line_no, raw: the events as the lines of realtime connections."""
    x = events.selectExpr(*[p.strip() for p in _split(LINE)], "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) DIV 3600000 AS ms").selectExpr("*", *[p.strip() for p in _split(MOVED)])
    named = "CASE WHEN user_id % 15 = 4 THEN ',Name=F/A-18C,Pilot=Ace' ELSE concat(',Name=P', user_id, ',Pilot=') END"
    update = f"concat('A', user_id, ',T=', concat_ws('|', lon, lat, alt, roll, pitch, yaw), ',Type=', obj_type, ',Coalition=', coalition, {named}, coalesce(concat(',TAS=', knots), ''))"
    return x.selectExpr("session", "line_no", f"CASE line_kind WHEN 'mark' THEN concat('#', ms DIV 1000, '.', lpad(CAST(ms % 1000 AS STRING), 3, '0')) WHEN 'end' THEN concat('-A', user_id) ELSE {update} END AS raw")
