"""Opposing pairs, their geometry over time, losses and the score that follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerotrace.functions import geometry as g
from aerotrace.schema import PAIR_FEATURES, SOUND_SPEED

FRAME = ["source", "frame_idx"]
SIDE = ["object_id", "name", "coalition", "x", "y", "z", "altitude", "speed", "mach", "heading", "pitch", "bank", "aoa", "g_load"]


def is_aircraft(obj_type: Column) -> Column:
    t = F.lower(obj_type)
    return t.contains("air+fixedwing") | t.contains("aircraft") | t.contains("fixedwing")


def opposing(a: Column, b: Column) -> Column:
    """Coalitions that differ; an unknown one opposes anyone."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return ~((a != "") & (b != "") & (a == b))


def sides(state: DataFrame) -> DataFrame:
    """State rows as sides of a pair: positions, radians, Mach from speed where unknown."""
    mach = F.when(F.col("mach") > 0, F.col("mach")).otherwise(F.col("speed") / SOUND_SPEED)
    return state.select(
        "source", "frame_idx", "time", "ord", "object_id", "name", "coalition", "obj_type", F.col("world_x").alias("x"), F.col("world_y").alias("y"), F.col("world_z").alias("z"),
        "altitude", "speed", mach.alias("mach"), F.radians("yaw").alias("heading"), F.radians("pitch").alias("pitch"), F.radians("roll").alias("bank"), "aoa", "g_load",
    )


def cell(x: str, z: str, size: float) -> Column:
    """The cell of a horizontal grid that a point lies in."""
    return F.struct(F.floor(F.col(x) / size).alias("i"), F.floor(F.col(z) / size).alias("k"))


def neighbours(x: str, z: str, size: float, offsets: list[tuple[int, int]]) -> Column:
    """The cells at some offsets of the one that a point lies in."""
    at = cell(x, z, size)
    return F.array(*(F.struct((at["i"] + i).alias("i"), (at["k"] + k).alias("k")) for i, k in offsets))


#: The cells around one, itself included, and the half of them that meets every two cells once.
AROUND = [(i, k) for i in (-1, 0, 1) for k in (-1, 0, 1)]
HALF_AROUND = AROUND[4:]


def pairs(state: DataFrame, max_distance: float = 10_000.0, min_speed: float = 50.0, min_altitude: float = 100.0) -> DataFrame:
    """source, frame_idx, time, distance_raw, self_*, enemy_*: pairs of a frame, the earlier seen object first.

    The frame and a cell of a grid as wide as the greatest distance carry the join: one side stands in its own
    cell, the other in its own and the four before it, so two objects meet once and only if their cells touch.
    """
    s = sides(state).filter(is_aircraft(F.col("obj_type")) & (F.col("altitude") >= min_altitude) & (F.col("speed") >= min_speed))
    # flat columns, not structs: those that nobody asks for are left out of the join
    a = s.select(*FRAME, "time", cell("x", "z", max_distance).alias("__cell"), *(F.col(c).alias(f"__a_{c}") for c in ("ord", *SIDE)))
    b = s.select(*FRAME, F.explode(neighbours("x", "z", max_distance, HALF_AROUND)).alias("__cell"), cell("x", "z", max_distance).alias("__own"), *(F.col(c).alias(f"__b_{c}") for c in ("ord", *SIDE)))
    d = g.distance(*(F.col(f"__b_{c}") - F.col(f"__a_{c}") for c in "xyz"))
    first = F.col("__a_ord") < F.col("__b_ord")
    once = (F.col("__cell") != F.col("__own")) | first  # within one cell both ways meet
    x = a.join(b, [*FRAME, "__cell"]).filter(once & (F.col("__a_ord") != F.col("__b_ord")) & opposing(F.col("__a_coalition"), F.col("__b_coalition")) & (d <= max_distance))
    side = lambda one, two, c: F.when(first, F.col(f"__{one}_{c}")).otherwise(F.col(f"__{two}_{c}"))
    x = x.select(*FRAME, "time", *(side("a", "b", c).alias(f"self_{c}") for c in SIDE), *(side("b", "a", c).alias(f"enemy_{c}") for c in SIDE))
    return x.withColumn("distance_raw", g.distance(*(F.col(f"enemy_{c}") - F.col(f"self_{c}") for c in "xyz")))


def nearest_opponent(state: DataFrame, min_speed: float = 20.0, min_altitude: float = 100.0, rings: tuple[float, ...] = (20_000.0, 160_000.0)) -> DataFrame:
    """Each aircraft of a frame with its nearest opponent: source, frame_idx, object_id, enemy_id, distance; ties to the first seen.

    Looked for in rings: whoever has an opponent within a ring's width finds it in the cells of that width around
    its own, and all others as near; only the rest looks on in the next ring, at last in the whole frame.
    """
    s = sides(state).filter(is_aircraft(F.col("obj_type")))
    b = s.filter((F.col("altitude") >= min_altitude) & (F.col("speed") >= min_speed)).select(*FRAME, *(F.col(c).alias(f"enemy_{c}") for c in ("object_id", "coalition", "x", "y", "z", "ord")))
    own = ["object_id", "coalition", "x", "y", "z"]
    x = s.select(*FRAME, *own, F.lit(None).cast("struct<d:double,ord:long,id:string>").alias("best"))
    found = F.when(
        (F.col("object_id") != F.col("enemy_object_id")) & opposing(F.col("coalition"), F.col("enemy_coalition")),
        F.struct(g.distance(*(F.col(f"enemy_{c}") - F.col(c) for c in "xyz")).alias("d"), F.col("enemy_ord").cast("long").alias("ord"), F.col("enemy_object_id").alias("id")),
    )
    within = 0.0
    for width in (*rings, None):
        looks = F.col("best").isNull() | (F.col("best.d") > within)
        here = F.lit(0) if width is None else cell("x", "z", width)
        there = b.withColumn("__cell", F.lit(0)) if width is None else b.withColumn("__cell", F.explode(neighbours("enemy_x", "enemy_z", width, AROUND)))
        met = x.withColumn("__cell", F.when(looks, here)).join(there, [*FRAME, "__cell"], "left")
        x = met.groupBy(*FRAME, *own).agg(F.least(F.first("best"), F.min(found)).alias("best"))
        within = width or within
    return x.filter("best IS NOT NULL").select(*FRAME, "object_id", F.col("best.id").alias("enemy_id"), F.col("best.d").alias("distance"))


def step_seconds(t: Column, before: Column) -> Column:
    """Seconds since the row before, a thirtieth where time stands or runs back; null at the first row."""
    d = t - before
    return F.when(d <= 0, 1.0 / 30).otherwise(d)


def static_features() -> dict[str, Column]:
    s, e = ({c: F.col(f"{side}_{c}") for c in SIDE} for side in ("self", "enemy"))
    dx, dy, dz = (e[c] - s[c] for c in "xyz")
    speed = g.speed_or_estimate(e["speed"], e["mach"])
    own, theirs = g.specific_energy(s["altitude"], s["speed"]), g.specific_energy(e["altitude"], e["speed"])
    return {
        "distance": g.distance(dx, dy, dz), "aspect_angle": g.off_nose(-dx, -dz, e["heading"]), "antenna_train_angle": g.off_nose(dx, dz, s["heading"]), "heading_crossing_angle": g.folded(s["heading"] - e["heading"]),
        "altitude_diff": s["altitude"] - e["altitude"], "bearing": g.bearing(dx, dz), "self_specific_energy": own, "enemy_specific_energy": theirs, "delta_specific_energy": own - theirs,
        "self_speed_": s["speed"], "enemy_speed_": speed, "speed_ratio": F.when(speed > 1, s["speed"] / F.nullif(speed, F.lit(0.0))).otherwise(1.0), "self_turn_rate": g.turn_rate_from_load(s["g_load"], s["speed"]), "self_g_load_": s["g_load"],
    }


def pair_features(df: DataFrame, by: list[str] = ["source", "self_object_id", "enemy_object_id"]) -> DataFrame:  # noqa: B006
    """by, time and the 20 features of every pair row; rates against the pair's row before, 0 at its first."""
    order = W.partitionBy(*by).orderBy("time")
    x = df.withColumns(static_features())
    dt = step_seconds(F.col("time"), F.lag("time").over(order))
    was = lambda c: F.lag(c).over(order)
    rate = lambda c: F.coalesce((F.col(c) - was(c)) / F.col("__dt"), F.lit(0.0))
    x = x.withColumn("__dt", dt)
    turn = F.abs(F.degrees(g.wrapped(F.col("enemy_heading") - was("enemy_heading")) / F.col("__dt")))
    x = x.withColumns({"enemy_turn_rate": F.coalesce(turn, F.lit(0.0)), "self_speed_rate": rate("self_speed"), "distance_rate": rate("distance"), "ata_rate": rate("antenna_train_angle"), "self_ps_estimate": rate("self_specific_energy")})
    x = x.withColumn("relative_turn_rate", F.col("self_turn_rate") - F.col("enemy_turn_rate"))
    renamed = {"self_speed": "self_speed_", "enemy_speed": "enemy_speed_", "self_g_load": "self_g_load_"}
    return x.select(*by, "time", *(F.col(renamed.get(f, f)).alias(f) for f in PAIR_FEATURES))


def self_features(df: DataFrame, by: list[str]) -> DataFrame:
    """The features of a side alone: relative ones 0, speed_ratio 1."""
    order = W.partitionBy(*by).orderBy("time")
    x = df.withColumns({"e": g.specific_energy(F.col("altitude"), F.col("speed")), "__dt": step_seconds(F.col("time"), F.lag("time").over(order))})
    rate = lambda c: F.coalesce((F.col(c) - F.lag(c).over(order)) / F.col("__dt"), F.lit(0.0))
    known = {"self_specific_energy": F.col("e"), "self_speed": F.col("speed"), "speed_ratio": F.lit(1.0), "self_turn_rate": g.turn_rate_from_load(F.col("g_load"), F.col("speed")), "self_g_load": F.col("g_load"), "self_speed_rate": rate("speed"), "self_ps_estimate": rate("e")}
    return x.select(*by, "time", *(known.get(f, F.lit(0.0)).alias(f) for f in PAIR_FEATURES))


def attributed(events: DataFrame, candidates: DataFrame, by: list[str]) -> DataFrame:
    """Losses with who most likely caused each: the opponent with the least angle off its nose plus distance / 100.

    events: by, victim_id, victim_name, victim_coalition, vx, vy, vz, time.  candidates: by, ord
    and the sides alive then.  A loss without a candidate has no row.
    """
    x = events.join(candidates, by).filter((F.col("object_id") != F.col("victim_id")) & is_aircraft(F.col("obj_type")) & opposing(F.col("coalition"), F.col("victim_coalition")))
    d = g.distance(F.col("x") - F.col("vx"), F.col("y") - F.col("vy"), F.col("z") - F.col("vz"))
    off = F.abs(F.degrees(F.atan2(F.col("vx") - F.col("x"), F.col("vz") - F.col("z"))) - F.col("yaw")) % 360
    score = F.when(off > 180, 360 - off).otherwise(off) + d / 100
    best = F.min_by(F.struct("object_id", "name", "coalition"), F.struct(score, F.col("ord"))).alias("k")
    y = x.groupBy(*by, "victim_id", "victim_name", "victim_coalition", "time").agg(best)
    return y.select(*by, "time", "victim_id", "victim_name", F.col("k.object_id").alias("killer_id"), F.col("k.name").alias("killer_name"), "victim_coalition", F.col("k.coalition").alias("killer_coalition"))


def told_kills(rows: DataFrame, kills: DataFrame, by: list[str]) -> DataFrame:
    """by, self_name, enemy_name, __at, __sign, __run: what each kill says of every pair of names it concerns, with the time at which its run began.

    A kill lifts a pair's score to its decay (sign 1) or pushes it below the negative of
    that (-1).  Later kills have decayed less, so of kills of one sign in a row the earliest
    prevails, and a kill of the other sign starts anew; so does one that does both, as
    when a name stands in the killer's and the victim's: the last thing it says counts.
    """
    pair = [*by, "self_name", "enemy_name"]
    killing = ["__at", "__v", "killer_name", "victim_name"]
    k = kills.select(*by, F.col("time").alias("__at"), F.col("victim_id").alias("__v"), *(F.coalesce(c, F.lit("")).alias(c) for c in killing[2:])).distinct()
    side = F.explode(F.array(F.struct(F.lit(True).alias("own"), F.col("self_name").alias("name")), F.struct(F.lit(False).alias("own"), F.col("enemy_name").alias("name"))))
    sides = rows.select(*pair).distinct().select(*pair, side.alias("__s")).select(*pair, F.col("__s.own").alias("__own"), F.col("__s.name").alias("__name")).filter("length(__name) > 0")
    # kills meet the distinct names of their log, not its rows
    met = k.join(sides.select(*by, "__name").distinct(), by).withColumns({"__killed": F.col("killer_name").contains(F.col("__name")), "__died": F.col("victim_name").contains(F.col("__name"))}).filter("__killed OR __died")
    said = lambda own, what: F.max(F.col(what) & (F.col("__own") == own))
    x = sides.join(met, [*by, "__name"]).groupBy(*pair, *killing).agg(said(True, "__killed").alias("__ok"), said(True, "__died").alias("__od"), said(False, "__killed").alias("__ek"), said(False, "__died").alias("__ed"))
    x = x.withColumns({"__first": F.when(F.col("__ok"), 1).when(F.col("__ek"), -1), "__second": F.when(F.col("__od"), -1).when(F.col("__ed"), 1)})
    x = x.withColumns({"__sign": F.coalesce("__second", "__first"), "__anew": F.coalesce(F.col("__first") != F.col("__second"), F.lit(False))})
    order = W.partitionBy(*pair).orderBy(*killing)
    before = F.lag("__sign").over(order)
    x = x.withColumn("__start", F.when(before.isNull() | (before != F.col("__sign")) | F.col("__anew"), F.col("__at")))
    x = x.withColumns({"__run": F.last("__start", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)), "__n": F.row_number().over(order)})
    return x.select(*pair, "__at", "__n", "__sign", "__run")


def outcome_score(rows: DataFrame, kills: DataFrame, by: list[str] = ["source"], lookback: float = 15.0, tau: float = 5.0) -> DataFrame:  # noqa: B006
    """rows with score in -1..1: towards 1 before the self side wins, towards -1 before it is lost.

    A row's score is that of the last kill in the ``lookback`` seconds from it on, decayed from the
    start of that kill's run, or from the first kill that the row has ahead if the run began before
    it: see told_kills.  So no row meets more than two kills, found as of its time.  Names match as parts.
    """
    pair = [*by, "self_name", "enemy_name"]
    told = told_kills(rows, kills, by)
    # a kill stands at the time from which rows have it in view, with what it says, before the rows of that time, and at its own behind them
    kill = F.struct("__n", "__sign", "__run", "__at")
    stands = F.explode(F.array(F.struct((F.col("__at") - lookback).alias("on"), kill.alias("seen")), F.struct(F.col("__at").alias("on"), F.lit(None).cast("struct<__n:int,__sign:int,__run:double,__at:double>").alias("seen"))))
    unseen = F.col("__s.seen").isNull()
    marks = told.select(*pair, stands.alias("__s")).select(*pair, F.col("__s.on").alias("__on"), F.when(unseen, 2).otherwise(0).alias("__side"), F.col("__s.seen").alias("__seen"), F.when(unseen, F.col("__s.on")).alias("__next"))
    # rows in flat columns, so that only those that are asked for are sorted, and in one order
    rest = [c for c in rows.columns if c not in (*pair, "score")]
    x = rows.select(*pair, *rest, F.col("time").alias("__on"), F.lit(1).alias("__side")).unionByName(marks, allowMissingColumns=True)
    order = W.partitionBy(*pair).orderBy("__on", "__side", F.col("__seen.__n").asc_nulls_first())
    x = x.withColumns({"__k": F.last("__seen", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)), "__first": F.expr("lead(__next) IGNORE NULLS").over(order)}).filter("__side = 1")
    since = F.greatest("__k.__run", "__first")
    score = F.when(F.col("__k.__at") >= F.col("__on"), F.col("__k.__sign") * F.exp(-(since - F.col("__on")) / tau)).otherwise(F.lit(0.0))
    return x.withColumn("score", score).select(*(c for c in rows.columns if c != "score"), "score")


def score_stats(df: DataFrame) -> DataFrame:
    near = F.abs("score") > 0.1
    return df.agg(F.count("*").alias("n"), F.count_if(F.col("score") > 0.1).alias("n_advantage"), F.count_if(F.col("score") < -0.1).alias("n_disadvantage"), F.avg(F.when(near, F.col("score"))).alias("mean_labeled"), F.stddev_pop(F.when(near, F.col("score"))).alias("std_labeled"))


def self_aircraft(state: DataFrame, player: str = "", by: list[str] | None = None) -> DataFrame:
    """by, object_id: the player's own aircraft of each log, the first seen whose pilot holds the player's name, or an F/A-18 with any pilot."""
    by = by or ["source"]
    pilot, name = F.coalesce("pilot", F.lit("")), F.coalesce("name", F.lit(""))
    own = (F.lit(player) != "") & pilot.contains(player) | name.contains("F/A-18") & (pilot != "")
    return state.filter(is_aircraft(F.col("obj_type")) & own).groupBy(*by).agg(F.min_by("object_id", F.struct("frame_idx", "ord")).alias("object_id"))
