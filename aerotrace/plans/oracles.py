"""DuckDB SQL that says the same as the queries, built from shared steps."""

from __future__ import annotations

from aerotrace.plans.adapters import PATH, PERSON, SEEN
from aerotrace.schema import ATTRIBUTES, FEATURES, LABELS, PRIORITY, RULE_LABELS, SIGNALS
from aerotrace.schema import THRESHOLDS as TH

STEPS: dict[str, str] = {}

STEPS["tele"] = f"""
    SELECT * REPLACE ({SEEN} AS pitch), t AS time, world_y AS altitude FROM (SELECT *, {PATH} FROM (
        SELECT {PERSON}, 5e-1 * (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 864e8 AS t FROM events))"""
STEPS["unwrapped"] = """
    SELECT object_id, time, altitude, world_x, world_y, world_z, pitch, CAST(pitch IS NULL AS DOUBLE) AS raw_missing_any,
        yaw + sum(yc) OVER o AS yaw, roll + sum(rc) OVER o AS roll
    FROM (SELECT *, CASE WHEN abs(dy) >= 180 THEN CASE WHEN my = -180 AND dy > 0 THEN 180e0 ELSE my END - dy ELSE 0e0 END AS yc,
                 CASE WHEN abs(dr) >= 180 THEN CASE WHEN mr = -180 AND dr > 0 THEN 180e0 ELSE mr END - dr ELSE 0e0 END AS rc
          FROM (SELECT *, ((dy + 180) % 36e1 + 36e1) % 36e1 - 180 AS my, ((dr + 180) % 36e1 + 36e1) % 36e1 - 180 AS mr
                FROM (SELECT *, yaw - lag(yaw) OVER o AS dy, roll - lag(roll) OVER o AS dr FROM tele WINDOW o AS (PARTITION BY object_id ORDER BY time))))
    WINDOW o AS (PARTITION BY object_id ORDER BY time ROWS UNBOUNDED PRECEDING)"""
STEPS["pitched"] = "SELECT object_id, time, pitch FROM unwrapped WHERE pitch IS NOT NULL"
STEPS["grid"] = """
    SELECT object_id, t0 + i * ((t0 + 2e-1) - t0) AS time
    FROM (SELECT object_id, min(time) AS t0, max(time) AS t1 FROM unwrapped GROUP BY object_id HAVING count(*) > 1),
         LATERAL (SELECT unnest(range(CAST(ceil((t1 + 2e-1 * 5e-1 - t0) / 2e-1) AS BIGINT))) AS i)"""
_LERP = ", ".join(f"CASE WHEN r.time IS NULL OR l.time = g.time THEN l.{s} ELSE (r.{s} - l.{s}) / (r.time - l.time) * (g.time - l.time) + l.{s} END AS {s}" for s in [*(s for s in SIGNALS if s != "pitch"), "raw_missing_any"])
_LERP += ", CASE WHEN lp.time IS NULL THEN rp.pitch WHEN rp.time IS NULL OR lp.time = g.time THEN lp.pitch ELSE (rp.pitch - lp.pitch) / (rp.time - lp.time) * (g.time - lp.time) + lp.pitch END AS pitch"
STEPS["resampled"] = f"""
    SELECT g.object_id, g.time, {_LERP},
        CASE WHEN r.time - l.time > 1 AND l.time < g.time AND g.time < r.time THEN 1e0 ELSE 0e0 END AS long_gap_flag
    FROM grid g ASOF JOIN unwrapped l ON g.object_id = l.object_id AND g.time >= l.time
    ASOF LEFT JOIN unwrapped r ON g.object_id = r.object_id AND g.time <= r.time
    ASOF LEFT JOIN pitched lp ON g.object_id = lp.object_id AND g.time >= lp.time
    ASOF LEFT JOIN pitched rp ON g.object_id = rp.object_id AND g.time <= rp.time"""
STEPS["smooth"] = f"""
    SELECT object_id, time, raw_missing_any, long_gap_flag, {", ".join(f"avg({'world_y' if s == 'altitude' else s}) OVER w AS {s}" for s in SIGNALS)}
    FROM resampled WINDOW w AS (PARTITION BY object_id ORDER BY time ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"""


def gradient(x: str, t: str = "time") -> str:
    h1, h2 = f"({t} - lag({t}) OVER o)", f"(lead({t}) OVER o - {t})"
    before, after = f"lag({x}) OVER o", f"lead({x}) OVER o"
    return f"""CASE WHEN {h1} IS NULL AND {h2} IS NULL THEN 0e0 WHEN {h1} IS NULL THEN ({after} - {x}) / {h2} WHEN {h2} IS NULL THEN ({x} - {before}) / {h1}
        ELSE ({h1} * {h1} * {after} - {h2} * {h2} * {before} + ({h2} * {h2} - {h1} * {h1}) * {x}) / ({h1} * {h2} * ({h1} + {h2})) END"""


_O = "WINDOW o AS (PARTITION BY object_id ORDER BY time)"
STEPS["first"] = f"SELECT *, {gradient('world_x')} AS vx, {gradient('world_y')} AS vy, {gradient('world_z')} AS vz, {gradient('yaw')} AS yaw_rate, {gradient('roll')} AS roll_rate, {gradient('pitch')} AS pitch_rate FROM smooth {_O}"
STEPS["second"] = f"SELECT *, {gradient('vx')} AS ax, {gradient('vy')} AS ay, {gradient('vz')} AS az FROM first {_O}"
STEPS["crossed"] = """
    SELECT *, vx * vx + vy * vy + vz * vz AS v2,
        sqrt((vy * az - vz * ay) * (vy * az - vz * ay) + (vz * ax - vx * az) * (vz * ax - vx * az) + (vx * ay - vy * ax) * (vx * ay - vy * ax)) AS cr FROM second"""
STEPS["processed"] = """
    SELECT *, avg(s) OVER w AS speed, avg(n) OVER w AS g_load, avg(tr) OVER w AS turn_rate, vy AS vertical_speed
    FROM (SELECT *, sqrt(v2) AS s, sqrt(1 + (CASE WHEN sqrt(v2) > 1e-6 THEN cr / sqrt(v2) ELSE 0e0 END / 9.80665e0) * (CASE WHEN sqrt(v2) > 1e-6 THEN cr / sqrt(v2) ELSE 0e0 END / 9.80665e0)) AS n,
              CASE WHEN v2 > 1e-6 THEN degrees(cr / v2) ELSE 0e0 END AS tr FROM crossed)
    WINDOW w AS (PARTITION BY object_id ORDER BY time ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"""
STEPS["windowed"] = """
    SELECT p.*, k AS win, t0 + k * 25e-1 AS window_start, t0 + k * 25e-1 + 5 AS window_end
    FROM (SELECT object_id, min(time) AS t0, max(time) AS t1 FROM processed GROUP BY object_id) e
    JOIN LATERAL (SELECT unnest(range(CAST(floor((t1 + 1e-9 - 5 - t0) / 25e-1) AS BIGINT) + 1)) AS k) ON t1 - t0 >= 5
    JOIN processed p ON p.object_id = e.object_id AND p.time >= t0 + k * 25e-1 - 1e-9 AND p.time <= t0 + k * 25e-1 + 5 + 1e-9"""


def changes(field: str, band: str, rows: str, keys: str) -> str:
    return f"""SELECT {keys}, count_if(sg <> before) AS n FROM (
        SELECT {keys}, sg, lag(sg) OVER (PARTITION BY {keys} ORDER BY time) AS before
        FROM (SELECT {keys}, time, sign({field}) AS sg FROM {rows} WHERE abs({field}) > {band})) GROUP BY {keys}"""


STEPS["basic"] = """
    SELECT object_id, win, any_value(window_start) AS window_start, any_value(window_end) AS window_end, CAST(count(*) AS INT) AS sample_count,
        avg(speed) AS speed_mean, arg_max(speed, time) - arg_min(speed, time) AS speed_delta, regr_slope(speed, time - window_start) AS speed_slope,
        avg(altitude) AS alt_mean, arg_max(altitude, time) - arg_min(altitude, time) AS alt_delta, regr_slope(altitude, time - window_start) AS alt_slope,
        avg(pitch) AS pitch_mean, avg(roll) AS roll_mean, avg(g_load) AS g_mean, stddev_pop(g_load) AS g_std,
        avg(abs(turn_rate)) AS turn_rate_mean, max(abs(turn_rate)) AS turn_rate_peak, avg(abs(roll_rate)) AS roll_rate_mean, max(abs(roll_rate)) AS roll_rate_peak,
        avg(abs(pitch_rate)) AS pitch_rate_mean, avg(vertical_speed) AS vertical_speed_mean, max(abs(vertical_speed)) AS vertical_speed_peak,
        abs(arg_max(yaw, time) - arg_min(yaw, time)) AS heading_delta,
        CASE WHEN count(*) < 3 THEN 0e0 ELSE sqrt(greatest(regr_syy(altitude, time - window_start) - pow(regr_sxy(altitude, time - window_start), 2) / regr_sxx(altitude, time - window_start), 0e0) / count(*)) END AS alt_residual_std,
        avg(raw_missing_any) AS missing_ratio, avg(long_gap_flag) AS long_gap_ratio,
        CAST(bool_or(speed < -1e-6 OR abs(pitch) > 100 OR g_load < -3 OR g_load > 12 OR abs(turn_rate) > 200) AS INT) AS sensor_conflict,
        CAST(bool_or(altitude < -1000 OR abs(vertical_speed) > 300 OR abs(turn_rate) > 300 OR abs(roll_rate) > 400 OR abs(pitch_rate) > 200) AS INT) AS feature_out_of_range,
        (min(time) + max(time)) / 2 AS mid, min(time) AS wt0, max(time) AS wt1
    FROM windowed GROUP BY object_id, win HAVING count(*) >= 2"""
STEPS["spacing"] = "SELECT object_id, win, median(d) AS dt FROM (SELECT object_id, win, time - lag(time) OVER (PARTITION BY object_id, win ORDER BY time) AS d FROM windowed) GROUP BY object_id, win"
STEPS["segments"] = """
    SELECT b.object_id, b.win, j, wt0 + j * dt AS s FROM basic b JOIN spacing USING (object_id, win),
        LATERAL (SELECT unnest(range(greatest(CAST(ceil((wt1 - 2 + 1e-9 - wt0) / dt) AS BIGINT), 1))) AS j)"""
STEPS["short_rows"] = "SELECT w.*, g.j FROM segments g JOIN windowed w ON w.object_id = g.object_id AND w.win = g.win AND w.time >= g.s - 1e-9 AND w.time <= g.s + 2 + 1e-9"
STEPS["short_basic"] = "SELECT object_id, win, j, max(abs(turn_rate)) AS tp, max(abs(roll_rate)) AS rp, stddev_pop(g_load) AS gs FROM short_rows GROUP BY object_id, win, j HAVING count(*) >= 2"
for _n, _f, _b in (("turn", "yaw_rate", "2e-1"), ("roll", "roll_rate", "1"), ("pitch", "pitch_rate", "5e-1")):
    STEPS[f"{_n}_sc"] = changes(_f, _b, "windowed", "object_id, win")
    STEPS[f"{_n}_short"] = f"SELECT object_id, win, max(n) AS n FROM ({changes(_f, _b, 'short_rows', 'object_id, win, j')}) GROUP BY object_id, win"
STEPS["short"] = "SELECT object_id, win, CAST(count(*) AS INT) AS short_window_count, max(tp) AS short_turn_rate_peak_max, max(rp) AS short_roll_rate_peak_max, max(gs) AS short_g_std_max FROM short_basic GROUP BY object_id, win"
STEPS["half"] = """
    SELECT w.object_id, w.win, """ + ", ".join(
    f"avg(abs(turn_rate)) FILTER (w.time {op} mid) AS {h}_half_turn_rate_mean, avg(vertical_speed) FILTER (w.time {op} mid) AS {h}_half_vertical_speed_mean, avg(pitch) FILTER (w.time {op} mid) AS {h}_half_pitch_mean, "
    f"abs(arg_max(yaw, w.time) FILTER (w.time {op} mid) - arg_min(yaw, w.time) FILTER (w.time {op} mid)) AS {h}_half_heading_delta"
    for h, op in (("first", "<="), ("second", ">="))
) + " FROM windowed w JOIN basic b ON w.object_id = b.object_id AND w.win = b.win GROUP BY w.object_id, w.win"
STEPS["features"] = """
    SELECT b.*, h.* EXCLUDE (object_id, win), s.* EXCLUDE (object_id, win), b.window_start AS window_start_time, b.window_end AS window_end_time, 5e0 AS window_duration,
        CAST(coalesce(t1.n, 0) AS INT) AS turn_sign_changes, CAST(coalesce(r1.n, 0) AS INT) AS roll_sign_changes, CAST(coalesce(p1.n, 0) AS INT) AS pitch_sign_changes,
        CAST(coalesce(t2.n, 0) AS DOUBLE) AS short_turn_sign_changes_max, CAST(coalesce(r2.n, 0) AS DOUBLE) AS short_roll_sign_changes_max, CAST(coalesce(p2.n, 0) AS DOUBLE) AS short_pitch_sign_changes_max,
        greatest(0e0, -pitch_mean) + greatest(0e0, -vertical_speed_mean) AS dive_score_raw, greatest(0e0, pitch_mean) + greatest(0e0, vertical_speed_mean) AS zoom_score_raw,
        1 / (1 + turn_rate_mean) AS straightness_score, turn_rate_mean / (abs(vertical_speed_mean) + 1e-3) AS turn_dominance
    FROM basic b JOIN half h USING (object_id, win) JOIN short s USING (object_id, win)
    LEFT JOIN turn_sc t1 USING (object_id, win) LEFT JOIN roll_sc r1 USING (object_id, win) LEFT JOIN pitch_sc p1 USING (object_id, win)
    LEFT JOIN turn_short t2 USING (object_id, win) LEFT JOIN roll_short r2 USING (object_id, win) LEFT JOIN pitch_short p2 USING (object_id, win)"""
STEPS["rule_in"] = """
    SELECT *, abs(turn_rate_mean) AS tr, vertical_speed_mean AS vs, pitch_mean AS p, abs(heading_delta) AS hd, g_mean AS g,
        greatest(roll_sign_changes, short_roll_sign_changes_max) AS rsc, greatest(turn_sign_changes, short_turn_sign_changes_max) AS tsc,
        greatest(roll_rate_peak, short_roll_rate_peak_max) AS rpk, greatest(g_std, short_g_std_max) AS gsd FROM features"""
_SCORES = {
    "Straight_Level": "(1 - tr / 3e0) + (1 - abs(vs) / 5e0) + (1 - abs(p) / 5e0)", "Straight_Climb": "(1 - tr / 3e0) + vs / 1e1", "Straight_Descent": "(1 - tr / 3e0) - vs / 1e1",
    "Level_Turn": "tr / 1e1 + (1 - abs(vs) / 5e0)", "Climbing_Turn": "tr / 1e1 + vs / 1e1", "Descending_Turn": "tr / 1e1 - vs / 1e1",
    "Dive": "-p / 15e0 - vs / 3e1 + greatest(0e0, 1 - g)", "Zoom_Climb": "p / 15e0 + vs / 3e1 + greatest(0e0, g - 1)", "Large_Heading_Change": "hd / 11e1",
    "Oscillatory_Maneuver": "greatest(rsc / 2e0, tsc / 2e0) + greatest(rpk / 6e1, gsd / 8e-1)",
}
STEPS["scored"] = "SELECT *, " + ", ".join(f"greatest(0e0, {s}) AS score_{k.lower()}" for k, s in _SCORES.items()) + " FROM rule_in"
_FLAGS = {
    "Straight_Level": "tr < 3 AND abs(vs) < 5 AND abs(p) < 5", "Straight_Climb": "tr < 3 AND vs > 10", "Straight_Descent": "tr < 3 AND vs < -10",
    "Level_Turn": "tr >= 10 AND abs(vs) < 5", "Climbing_Turn": "tr >= 10 AND vs > 10", "Descending_Turn": "tr >= 10 AND vs < -10",
    "Dive": "p < -15 AND vs < -30", "Zoom_Climb": "p > 15 AND vs > 30",
    "Large_Heading_Change": "hd >= 110 AND NOT ((rsc >= 2 OR tsc >= 2) AND (rpk >= 60 OR gsd >= 8e-1)) AND NOT (greatest(score_dive, score_zoom_climb) > score_large_heading_change + 25e-2)",
    "Oscillatory_Maneuver": "(rsc >= 2 OR tsc >= 2) AND (rpk >= 60 OR gsd >= 8e-1)",
}
_ATTRS = ["g >= 55e-1", "g <= 7e-1", "speed_slope > 1", "speed_slope < -1", "rpk >= 60", "turn_rate_peak >= 18", "abs(vs) >= 30", "hd >= 110", "(rsc >= 2 OR tsc >= 2)"]


def _half(h: str) -> str:
    t, v, p, d = (f"{h}_half_{n}" for n in ("turn_rate_mean", "vertical_speed_mean", "pitch_mean", "heading_delta"))
    return f"""CASE WHEN {p} < -15 AND {v} < -30 THEN 'Dive' WHEN {p} > 15 AND {v} > 30 THEN 'Zoom_Climb'
        WHEN {t} >= 10 OR {d} >= 55 THEN CASE WHEN {v} > 10 THEN 'Climbing_Turn' WHEN {v} < -10 THEN 'Descending_Turn' WHEN abs({v}) < 5 THEN 'Level_Turn' END
        WHEN {t} < 3 THEN CASE WHEN {v} > 10 THEN 'Straight_Climb' WHEN {v} < -10 THEN 'Straight_Descent' WHEN abs({v}) < 5 AND abs({p}) < 5 THEN 'Straight_Level' END END"""


STEPS["flagged"] = "SELECT *, " + ", ".join(f"({c}) AS flag_{k.lower()}" for k, c in _FLAGS.items()) + ", " + ", ".join(f"({c}) AS attr_{k.lower()}" for k, c in zip(ATTRIBUTES, _ATTRS, strict=True)) + f", {_half('first')} AS h1, {_half('second')} AS h2 FROM scored"
STEPS["reasoned"] = (
    "SELECT *, concat_ws(';', CASE WHEN missing_ratio >= 35e-2 THEN 'missing_ratio' END, CASE WHEN long_gap_ratio >= 25e-2 THEN 'long_gap_ratio' END, CASE WHEN sensor_conflict = 1 THEN 'sensor_conflict' END, CASE WHEN feature_out_of_range = 1 THEN 'feature_out_of_range' END) AS uncertain_reason, "
    "list_reverse_sort(list_filter([" + ", ".join(f"CASE WHEN flag_{k.lower()} THEN score_{k.lower()} END" for k in RULE_LABELS) + "], lambda x: x IS NOT NULL)) AS ranked FROM flagged"
)
STEPS["moved"] = "SELECT *, CASE WHEN uncertain_reason <> '' THEN '' WHEN len(ranked) = 0 THEN 'no_rule_matched' WHEN len(ranked) >= 2 AND ranked[1] - ranked[2] < 35e-2 THEN 'multiple_flags_no_dominant' WHEN h1 <> h2 THEN 'window_halves_disagree:' || h1 || '->' || h2 ELSE '' END AS transition_reason FROM reasoned"
STEPS["labeled"] = (
    "SELECT *, CASE WHEN uncertain_reason <> '' THEN 'Uncertain' WHEN transition_reason <> '' THEN 'Transition' " + " ".join(f"WHEN flag_{k.lower()} THEN '{k}'" for k in PRIORITY) + " END AS main_label, "
    "concat_ws(';', " + ", ".join(f"CASE WHEN attr_{k.lower()} THEN '{k}' END" for k in ATTRIBUTES) + ") AS attributes FROM moved"
)
LABEL_ID = "CASE main_label " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(LABELS)) + " END"


def said(select: str, *, more: dict[str, str] | None = None) -> str:
    """A query over the steps, with those that it needs."""
    import re

    steps = STEPS | (more or {})
    need: list[str] = []

    def add(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"(?:FROM|JOIN)\s+(\w+)", text)):
            if word in steps and word not in need:
                add(steps[word])
                need.append(word)

    add(select)
    return ("WITH " + ", ".join(f"{n} AS ({steps[n]})" for n in need) + " " if need else "") + select


def rounded(columns: list[str], digits: int = 4) -> str:
    return ", ".join(f"round({c}, {digits}) + 0e0 AS {c}" for c in columns)


NUMBERS = [f for f in FEATURES if f not in ("turn_sign_changes", "roll_sign_changes", "pitch_sign_changes", "short_window_count", "sensor_conflict", "feature_out_of_range")]
assert TH["turn_large"] == 10 and TH["vs_up"] == 10  # the SQL above holds the defaults

from aerotrace.plans.adapters import ARENA, FRAME_MICROS  # noqa: E402

_MICROS = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))"
_PLACE = "concat('arena', CAST(user_id // 20 AS STRING))"
STEPS["frames"] = f"""
    SELECT {ARENA} FROM (SELECT *, {PATH} FROM (
        SELECT user_id, frame_idx, v, frame_idx * 1e0 AS t, CAST(user_id % 10 AS INT) AS kind, {_PLACE} AS arena, concat('P', CAST(user_id AS STRING)) AS name,
            CASE user_id % 3 WHEN 0 THEN 'Blue' WHEN 1 THEN 'Red' ELSE '' END AS coalition, CASE WHEN user_id % 11 = 0 THEN 'Sea+Watercraft+AircraftCarrier' ELSE 'Air+FixedWing' END AS obj_type
        FROM (SELECT user_id, CAST({_MICROS} // {FRAME_MICROS} AS INT) AS frame_idx, CAST(floor(arg_max(value, event_id)) AS BIGINT) AS v FROM events GROUP BY 1, 2)))"""
STEPS["sided"] = "SELECT *, speed / 34e1 AS m, radians(yaw) AS h FROM frames WHERE contains(lower(obj_type), 'aircraft') OR contains(lower(obj_type), 'fixedwing')"
_OPPOSE = "NOT (a.coalition <> '' AND b.coalition <> '' AND a.coalition = b.coalition)"
STEPS["paired"] = f"""
    SELECT * FROM (SELECT a.source, a.frame_idx, a.time, a.object_id AS sid, b.object_id AS eid, a.name AS sname, b.name AS ename, a.ord AS so, b.ord AS eo,
        b.world_x - a.world_x AS dx, b.world_y - a.world_y AS dy, b.world_z - a.world_z AS dz, a.h AS sh, b.h AS eh, a.altitude AS sa, b.altitude AS ea, a.speed AS ss, b.speed AS es, b.m AS em, a.g_load AS sg,
        sqrt((b.world_x - a.world_x) * (b.world_x - a.world_x) + (b.world_y - a.world_y) * (b.world_y - a.world_y) + (b.world_z - a.world_z) * (b.world_z - a.world_z)) AS distance
    FROM sided a JOIN sided b ON a.source = b.source AND a.frame_idx = b.frame_idx AND a.ord < b.ord AND {_OPPOSE}
    WHERE a.altitude >= 100 AND b.altitude >= 100 AND a.speed >= 50 AND b.speed >= 50) WHERE distance <= 10000"""


def fold(x: str) -> str:
    return f"CASE WHEN abs(degrees({x})) > 180 THEN 360 - abs(degrees({x})) ELSE abs(degrees({x})) END"


STEPS["geometry"] = f"""
    SELECT *, {fold('atan2(0e0 - dz, 0e0 - dx) - eh')} AS aspect_angle, {fold('atan2(dz, dx) - sh')} AS antenna_train_angle, {fold('sh - eh')} AS heading_crossing_angle, sa - ea AS altitude_diff,
        (degrees(atan2(dz, dx)) % 36e1 + 36e1) % 36e1 AS bearing, sa + ss * ss / (2 * 980665e-5) AS self_specific_energy, ea + es * es / (2 * 980665e-5) AS enemy_specific_energy,
        ss AS self_speed, es AS enemy_speed, ss / es AS speed_ratio, CASE WHEN sg <= 1 OR ss < 30 THEN 0e0 ELSE degrees(980665e-5 * sqrt(sg * sg - 1) / ss) END AS self_turn_rate, sg AS self_g_load FROM paired"""
_DT = "(time - lag(time) OVER o)"
STEPS["pair_features"] = f"""
    SELECT *, self_turn_rate - enemy_turn_rate AS relative_turn_rate, self_specific_energy - enemy_specific_energy AS delta_specific_energy FROM (
    SELECT *, coalesce(abs(degrees((dh - 2 * pi() * ceil((dh - pi()) / (2 * pi()))) / dt)), 0e0) AS enemy_turn_rate FROM (
    SELECT *, eh - lag(eh) OVER o AS dh, {_DT} AS dt, coalesce((ss - lag(ss) OVER o) / {_DT}, 0e0) AS self_speed_rate, coalesce((distance - lag(distance) OVER o) / {_DT}, 0e0) AS distance_rate,
        coalesce((antenna_train_angle - lag(antenna_train_angle) OVER o) / {_DT}, 0e0) AS ata_rate, coalesce((self_specific_energy - lag(self_specific_energy) OVER o) / {_DT}, 0e0) AS self_ps_estimate
    FROM geometry WINDOW o AS (PARTITION BY source, sid, eid ORDER BY time)))"""
STEPS["losses"] = f"SELECT DISTINCT {_PLACE} AS source, CAST({_MICROS} // {FRAME_MICROS} AS INT) AS frame_idx, CAST(user_id AS STRING) AS victim_id FROM events WHERE event_type = 'error'"
_OFF = "(abs(degrees(atan2(v.world_x - a.world_x, v.world_z - a.world_z)) - a.yaw) % 36e1)"
STEPS["kills"] = f"""
    SELECT l.source, l.frame_idx, any_value(v.time) AS time, l.victim_id, any_value(v.name) AS victim_name,
        arg_min({{'id': a.object_id, 'name': a.name}}, {{'s': CASE WHEN {_OFF} > 180 THEN 360 - {_OFF} ELSE {_OFF} END + sqrt(pow(a.world_x - v.world_x, 2) + pow(a.world_y - v.world_y, 2) + pow(a.world_z - v.world_z, 2)) / 100, 'o': a.ord}}) AS k
    FROM losses l JOIN frames v ON v.source = l.source AND v.frame_idx = l.frame_idx AND v.object_id = l.victim_id
    JOIN sided a ON a.source = l.source AND a.frame_idx = l.frame_idx AND a.object_id <> l.victim_id AND NOT (a.coalition <> '' AND v.coalition <> '' AND a.coalition = v.coalition)
    GROUP BY l.source, l.frame_idx, l.victim_id"""
STEPS["outcome"] = """
    SELECT p.source, p.time, p.sid, p.eid, any_value(p.distance) AS distance, list_reduce(list_prepend({'at': 0e0, 'v': '', 'd': 0e0, 'k': '', 'l': '', 's': '', 'e': ''}, list_sort(list({'at': k.time, 'v': k.victim_id, 'd': exp(-(k.time - p.time) / 5), 'k': k.k.name, 'l': k.victim_name, 's': p.sname, 'e': p.ename}) FILTER (k.time IS NOT NULL))) ,
        lambda a, x: {'at': x.at, 'v': x.v, 'd': CASE
            WHEN contains(x.l, x.s) THEN least(CASE WHEN contains(x.k, x.s) THEN greatest(a.d, x.d) WHEN contains(x.k, x.e) THEN least(a.d, -x.d) ELSE a.d END, -x.d)
            WHEN contains(x.l, x.e) THEN greatest(CASE WHEN contains(x.k, x.s) THEN greatest(a.d, x.d) WHEN contains(x.k, x.e) THEN least(a.d, -x.d) ELSE a.d END, x.d)
            ELSE CASE WHEN contains(x.k, x.s) THEN greatest(a.d, x.d) WHEN contains(x.k, x.e) THEN least(a.d, -x.d) ELSE a.d END END, 'k': x.k, 'l': x.l, 's': x.s, 'e': x.e}).d AS score
    FROM paired p LEFT JOIN kills k ON k.source = p.source AND k.time >= p.time AND k.time - p.time <= 15 GROUP BY p.source, p.time, p.sid, p.eid, p.sname, p.ename"""

from aerotrace.plans.adapters import ALT, LAT, LON  # noqa: E402

STEPS["named"] = "SELECT * FROM frames WHERE ord % 4 <> 0 OR frame_idx <= 7"
STEPS["marks"] = "SELECT source, frame_idx AS f, time, row_number() OVER (PARTITION BY source ORDER BY frame_idx) AS n FROM (SELECT DISTINCT source, frame_idx, time FROM named)"
STEPS["placed"] = f"""
    SELECT *, frame_idx * 10000000 + ord AS k, ord % 4 = 0 AND frame_idx = 7 AS gone, 6378137e0 * radians(lon) * cos(radians(lat)) AS lx, 6378137e0 * radians(lat) AS lz, coalesce(last_value(told_roll IGNORE NULLS) OVER (PARTITION BY source, ord ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), 0e0) AS roll FROM (
        SELECT source, frame_idx, time, concat('A', object_id) AS object_id, ord, name, obj_type, coalition, CAST({LON} AS DOUBLE) AS lon, CAST({LAT} AS DOUBLE) AS lat, CAST({ALT} AS DOUBLE) AS alt,
            CASE WHEN frame_idx % 2 = 0 THEN CAST(ord % 30 AS DOUBLE) END AS told_roll, 2e0 AS pitch, CAST(ord % 360 AS DOUBLE) AS yaw
        FROM named)"""
# a removed object tells nothing later, so its changes before are all there are
STEPS["changes"] = """
    SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS speed, lag(vx) OVER o AS ux, lag(vy) OVER o AS uy, lag(vz) OVER o AS uz FROM (
        SELECT *, time - lag(time) OVER o AS dt, (lx - lag(lx) OVER o) / (time - lag(time) OVER o) AS vx, (alt - lag(alt) OVER o) / (time - lag(time) OVER o) AS vy, (lz - lag(lz) OVER o) / (time - lag(time) OVER o) AS vz FROM placed WINDOW o AS (PARTITION BY source, ord ORDER BY frame_idx))
    WINDOW o AS (PARTITION BY source, ord ORDER BY frame_idx)"""
STEPS["logged"] = """
    SELECT m.n AS frame_idx, m.time AS time, c.* EXCLUDE (frame_idx, time) FROM (SELECT m.source, m.f, m.n, m.time, o.ord FROM marks m JOIN (SELECT DISTINCT source, ord FROM placed) o USING (source)) m
    ASOF JOIN changes c ON c.source = m.source AND c.ord = m.ord AND m.f >= c.frame_idx WHERE NOT c.gone"""
# losses by removal, and those told after all other lines; what is known at a line is what lines before it told
STEPS["told"] = f"""
    SELECT source, time, ord, k AS at FROM placed WHERE gone
    UNION ALL SELECT m.source, max(m.time), e.ord, 9000000000000000000 FROM (SELECT DISTINCT {_PLACE} AS source, user_id AS ord FROM events WHERE event_type = 'error') e JOIN marks m ON m.source = e.source GROUP BY m.source, e.ord"""
STEPS["alive"] = """
    SELECT * FROM (SELECT t.at, t.ord AS victim, t.time AS lost, c.* FROM told t JOIN changes c ON c.source = t.source AND c.k < t.at QUALIFY row_number() OVER (PARTITION BY t.source, t.ord, t.at, c.ord ORDER BY c.k DESC) = 1)
    WHERE NOT gone AND (contains(lower(obj_type), 'aircraft') OR contains(lower(obj_type), 'fixedwing'))"""
_TURNED = "(abs(degrees(atan2(v.lx - a.lx, v.lz - a.lz)) - a.yaw) % 36e1)"
STEPS["log_kills"] = f"""
    SELECT v.source, v.lost AS time, v.object_id AS victim_id, v.name AS victim_name,
        arg_min({{'id': a.object_id, 'name': a.name}}, {{'s': CASE WHEN {_TURNED} > 180 THEN 360 - {_TURNED} ELSE {_TURNED} END + sqrt(pow(a.lx - v.lx, 2) + pow(a.alt - v.alt, 2) + pow(a.lz - v.lz, 2)) / 100, 'o': a.ord}}) AS k
    FROM alive v JOIN alive a ON v.ord = v.victim AND a.source = v.source AND a.victim = v.victim AND a.at = v.at AND a.ord <> v.ord AND NOT (a.coalition <> '' AND v.coalition <> '' AND a.coalition = v.coalition)
    GROUP BY v.source, v.lost, v.at, v.object_id, v.name"""
_LIST = "[" + ", ".join(f"'{n}'" for n in [*LABELS, "Bogus"]) + "]"
STEPS["own_windows"] = f"SELECT source, concat('A', object_id) AS aircraft_id, time AS window_start, time + 5 AS window_end, CAST((ord + v) % 12 AS INT) AS label, {_LIST}[CAST((ord + v) % 12 AS INT) + 1] AS label_name, ord * 100 + frame_idx AS row FROM frames"
STEPS["edited"] = f"""
    SELECT event_id AS edit_index, CASE event_type WHEN 'purchase' THEN 'set' ELSE 'clear' END AS edit_action, concat('A', CAST(CASE WHEN event_id % 17 = 0 THEN user_id + 1000000 ELSE user_id END AS STRING)) AS aircraft_id,
        CASE WHEN event_id % 19 = 0 THEN NULL ELSE {_MICROS} / CAST({FRAME_MICROS} AS DOUBLE) END AS sample_time, {_LIST}[CAST(event_id % 13 AS INT) + 1] AS name FROM events WHERE event_type IN ('purchase', 'signup')"""
STEPS["met"] = """
    SELECT e.*, s.row, CASE WHEN sample_time IS NULL THEN 'invalid_sample_time' WHEN s.row IS NULL THEN 'aircraft_not_found' WHEN away > 25e-1 THEN 'no_window_within_tolerance' WHEN edit_action = 'set' AND name = 'Bogus' THEN 'unknown_manual_label' END AS reason,
        sample_time IS NOT NULL AND s.row IS NOT NULL AND away <= 25e-1 AS hit
    FROM edited e LEFT JOIN (SELECT e.edit_index, s.row, abs((window_start + window_end) / 2 - e.sample_time) AS away,
        row_number() OVER (PARTITION BY e.edit_index ORDER BY abs((window_start + window_end) / 2 - e.sample_time), s.row) AS n FROM edited e JOIN own_windows s USING (aircraft_id)) s ON s.edit_index = e.edit_index AND s.n = 1"""
STEPS["applied"] = """
    SELECT s.row, s.label, s.label_name, m.i AS manual_edit_index, CASE WHEN t.a = 'set' THEN t.n ELSE s.label_name END AS training_label_name
    FROM own_windows s LEFT JOIN (SELECT row, max(edit_index) AS i FROM met WHERE hit GROUP BY row) m USING (row)
    LEFT JOIN (SELECT row, arg_max(edit_action, edit_index) AS a, arg_max(name, edit_index) AS n FROM met WHERE hit AND reason IS NULL GROUP BY row) t USING (row)"""
_NUM = lambda x: f"regexp_replace(printf('%.6f', {x}), '\\.?0+$', '')"
STEPS["anchored"] = """
    SELECT w.*, (window_start + window_end) / 2 AS sample_time, (SELECT arg_min(m.n, {'d': abs(m.time - (w.window_start + w.window_end) / 2), 't': m.time}) FROM marks m WHERE m.source = w.source) AS nearest FROM own_windows w"""
STEPS["seen"] = "SELECT c.source, c.object_id AS aircraft_id, min(m.n) AS first_frame FROM changes c JOIN marks m ON m.source = c.source AND m.f = c.frame_idx WHERE NOT c.gone GROUP BY c.source, c.object_id"
STEPS["lined"] = f"""
    SELECT source, frame_text, aircraft_id, arg_max("update", window_start) AS "update" FROM (
    SELECT a.source, printf('%.2f', m.time) AS frame_text, a.aircraft_id, window_start, concat(a.aircraft_id, ',Maneuver010PredLabel=', label_name, ',Maneuver011PredLabelId=', label, ',Maneuver070WindowStart=', {_NUM('window_start')}, ',Maneuver071WindowEnd=', {_NUM('window_end')}, ',Maneuver072SampleTime=', {_NUM('sample_time')},
        ',Maneuver020RuleLabel=', label_name, ',Maneuver021RuleLabelId=', label, ',Maneuver030MainLabel=', label_name, ',Maneuver031MainLabelId=', label, ',Maneuver052ComputedGSource=trajectory_curvature_estimate') AS "update"
    FROM anchored a JOIN seen s ON s.source = a.source AND s.aircraft_id = a.aircraft_id JOIN marks m ON m.source = a.source AND m.n = greatest(a.nearest, s.first_frame)) GROUP BY source, frame_text, aircraft_id"""

from aerotrace.plans.adapters import LINE, MOVED  # noqa: E402

STEPS["rt_lines"] = f"""
    SELECT *, coalesce(max(CASE WHEN line_kind = 'mark' THEN ms END) OVER (PARTITION BY session ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1e3 AS now,
        count(*) FILTER (line_kind = 'end') OVER (PARTITION BY session, user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS life
    FROM (SELECT *, {MOVED} FROM (SELECT {LINE}, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000 AS ms FROM events))"""
STEPS["rt_known"] = """
    SELECT session, event_id, user_id, life, obj_type, coalition, now, min(event_id) OVER o AS ord, 6378137e0 * radians(CAST(lon AS DOUBLE)) * cos(radians(CAST(lat AS DOUBLE))) AS x, CAST(alt AS DOUBLE) AS y, 6378137e0 * radians(CAST(lat AS DOUBLE)) AS z,
        coalesce(last_value(CAST(nullif(yaw, '') AS DOUBLE) IGNORE NULLS) OVER o, 0e0) AS yaw, last_value(knots IGNORE NULLS) OVER o * 514444e-6 AS tas
    FROM rt_lines WHERE line_kind = 'update' WINDOW o AS (PARTITION BY session, user_id, life ORDER BY event_id ROWS UNBOUNDED PRECEDING)"""
STEPS["rt_state"] = """
    SELECT *, coalesce(tas, last_value(moved IGNORE NULLS) OVER o, 0e0) AS speed FROM (
        SELECT *, CASE WHEN now > lag(now) OVER o THEN sqrt(pow(x - lag(x) OVER o, 2) + pow(y - lag(y) OVER o, 2) + pow(z - lag(z) OVER o, 2)) / (now - lag(now) OVER o) END AS moved FROM rt_known WINDOW o AS (PARTITION BY session, user_id, life ORDER BY event_id))
    WINDOW o AS (PARTITION BY session, user_id, life ORDER BY event_id ROWS UNBOUNDED PRECEDING)"""
# the last line of every user of the session before each mark: an update tells its state
STEPS["rt_frames"] = """
    SELECT f.session, f.frame, f.time, s.*, radians(s.yaw) AS h FROM (
        SELECT f.session, f.event_id AS frame, f.ms / 1e3 AS time, l.user_id, l.event_id AS told FROM (SELECT m.session, m.event_id, m.ms, u.user_id FROM rt_lines m JOIN (SELECT DISTINCT session, user_id FROM rt_lines) u USING (session) WHERE m.line_kind = 'mark') f
        ASOF JOIN (SELECT * FROM rt_lines WHERE line_kind <> 'mark') l ON l.session = f.session AND l.user_id = f.user_id AND f.event_id >= l.event_id) f
    JOIN (SELECT * EXCLUDE (session), session AS own FROM rt_state) s ON s.own = f.session AND s.user_id = f.user_id AND s.event_id = f.told WHERE s.obj_type = 'Air+FixedWing'"""
STEPS["rt_engaged"] = """
    SELECT a.session, a.time, a.x AS ax, a.y AS ay, a.z AS az, a.h AS sh, a.speed AS ss, a.user_id AS sid,
        arg_min({'id': b.user_id, 'x': b.x, 'y': b.y, 'z': b.z, 'h': b.h, 's': b.speed}, {'d': sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2)), 'o': b.ord}) FILTER (b.session IS NOT NULL) AS e
    FROM (SELECT * FROM rt_frames WHERE user_id % 15 = 4) a LEFT JOIN rt_frames b ON b.session = a.session AND b.frame = a.frame AND b.user_id <> a.user_id AND b.y >= 100 AND b.speed >= 20 AND NOT (a.coalition <> '' AND b.coalition <> '' AND a.coalition = b.coalition)
    GROUP BY ALL"""
STEPS["rt_statics"] = f"""
    SELECT *, {fold('atan2(0e0 - dz, 0e0 - dx) - eh')} AS aspect, {fold('atan2(dz, dx) - sh')} AS ata, {fold('sh - eh')} AS hca, (degrees(atan2(dz, dx)) % 36e1 + 36e1) % 36e1 AS bear, sqrt(dx * dx + dy * dy + dz * dz) AS dist,
        ay + ss * ss / (2 * 980665e-5) AS own_energy, e.y + e.s * e.s / (2 * 980665e-5) AS enemy_energy FROM (
    SELECT *, e IS NOT NULL AS has_enemy, e.x - ax AS dx, e.y - ay AS dy, e.z - az AS dz, e.h AS eh FROM rt_engaged)"""
STEPS["rt_rated"] = f"""
    SELECT *, coalesce((ss - lag(ss) OVER o) / dt, 0e0) AS speed_rate, coalesce((own_energy - lag(own_energy) OVER o) / dt, 0e0) AS ps, CASE WHEN again THEN (dist - lag(dist) OVER o) / dt ELSE 0e0 END AS dist_rate, CASE WHEN again THEN (ata - lag(ata) OVER o) / dt ELSE 0e0 END AS ata_speed,
        CASE WHEN again THEN abs(degrees(turned - 2 * pi() * ceil((turned - pi()) / (2 * pi())))) ELSE 0e0 END AS turn
    FROM (SELECT *, (eh - lag(eh) OVER o) / dt AS turned FROM (SELECT *, has_enemy AND coalesce(lag(has_enemy) OVER o, false) AS again, CASE WHEN {_DT} <= 0 THEN 1 / 30e0 ELSE {_DT} END AS dt FROM rt_statics WINDOW o AS (PARTITION BY session ORDER BY time)) WINDOW o AS (PARTITION BY session ORDER BY time))
    WINDOW o AS (PARTITION BY session ORDER BY time)"""
STEPS["rt_features"] = """
    SELECT session, time, has_enemy, concat('A', sid) AS self_object_id, CASE WHEN has_enemy THEN concat('A', e.id) END AS enemy_object_id, coalesce(dist, 0e0) AS distance, coalesce(aspect, 0e0) AS aspect_angle, coalesce(ata, 0e0) AS antenna_train_angle, coalesce(hca, 0e0) AS heading_crossing_angle,
        coalesce(ay - e.y, 0e0) AS altitude_diff, coalesce(bear, 0e0) AS bearing, own_energy AS self_specific_energy, coalesce(enemy_energy, 0e0) AS enemy_specific_energy, coalesce(own_energy - enemy_energy, 0e0) AS delta_specific_energy, ss AS self_speed,
        coalesce(e.s, 0e0) AS enemy_speed, coalesce(ss / e.s, 1e0) AS speed_ratio, 0e0 AS self_turn_rate, turn AS enemy_turn_rate, -turn AS relative_turn_rate, 0e0 AS self_g_load, speed_rate AS self_speed_rate, dist_rate AS distance_rate, ata_speed AS ata_rate, ps AS self_ps_estimate FROM rt_rated"""
