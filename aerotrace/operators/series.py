"""Irregular series to a regular grid with derived rates, by window functions alone.

All steps share one partitioning (``by``), so one exchange serves the whole chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerotrace.functions.geometry import finite
from aerotrace.schema import GRAVITY, SIGNALS

RATES = ["speed", "g_load", "yaw_rate", "turn_rate", "roll_rate", "pitch_rate", "vertical_speed"]


def source_rows(df: DataFrame, by: list[str], time: str = "time") -> DataFrame:
    """Rows with a numeric time; the signals as doubles, NaN as null, absent ones null; raw_missing_any."""
    x = df.withColumn("time", F.col(time).try_cast("double"))
    x = x.filter(F.col("time").isNotNull() & ~F.isnan("time"))
    x = x.withColumns({s: finite(F.col(s).try_cast("double")) if s in df.columns else F.lit(None).cast("double") for s in SIGNALS})
    missing = F.lit(False)
    for s in SIGNALS:
        missing = missing | F.col(s).isNull()
    return x.select(*by, "time", *SIGNALS, missing.cast("double").alias("raw_missing_any"))


def unwrapped(x: Column, order: W) -> Column:
    """Part of a running correction: what must be added from this row on."""
    d = x - F.last(x, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    m = F.pmod(d + 180, F.lit(360.0)) - 180
    m = F.when((m == -180) & (d > 0), 180.0).otherwise(m)
    return F.coalesce(F.when(F.abs(d) >= 180, m - d), F.lit(0.0))


def unwrap(df: DataFrame, by: list[str]) -> DataFrame:
    """yaw and roll made continuous; pitch only in series where it jumps by more than 150 degrees."""
    order = W.partitionBy(*by).orderBy("time")
    x = df.withColumns({f"__{s}": unwrapped(F.col(s), order) for s in ("yaw", "roll", "pitch")} | {"__jump": F.abs(F.col("pitch") - F.lag("pitch").over(order))})
    x = x.withColumns({f"__{s}": F.sum(f"__{s}").over(order.rowsBetween(W.unboundedPreceding, 0)) for s in ("yaw", "roll", "pitch")} | {"__jump": F.max("__jump").over(W.partitionBy(*by))})
    return x.withColumns({"yaw": F.col("yaw") + F.col("__yaw"), "roll": F.col("roll") + F.col("__roll"), "pitch": F.when(F.col("__jump") > 150, F.col("pitch") + F.col("__pitch")).otherwise(F.col("pitch"))}).drop("__yaw", "__roll", "__pitch", "__jump")


def resample(df: DataFrame, by: list[str], hz: float = 5.0, long_gap: float = 1.0) -> DataFrame:
    """Values at first time + i / hz up to the last time, interpolated, ends held; long_gap_flag inside gaps.

    A series of one row, or hz <= 0, stays as it is.  Every row knows the last
    and next values of each signal, in one order of the series, and yields the
    grid points from its own time up to the next row's, so nothing is joined,
    united or read twice.
    """
    values = [*SIGNALS, "raw_missing_any"]
    if hz <= 0:
        return df.withColumn("long_gap_flag", F.lit(0.0))
    period = 1.0 / hz
    whole = W.partitionBy(*by)
    order = whole.orderBy("time")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    ahead = lambda c: F.expr(f"lead({c}) IGNORE NULLS").over(order)
    x = df.withColumns({f"__p_{s}": F.expr(f"IF({s} IS NOT NULL, struct(time AS t, {s} AS v), NULL)") for s in values} | {"__t0": F.min("time").over(whole), "__t1": F.max("time").over(whole), "__n": F.count("*").over(whole)})
    x = x.withColumns({f"__l_{s}": F.last(f"__p_{s}", ignorenulls=True).over(upto) for s in values} | {f"__r_{s}": ahead(f"__p_{s}") for s in values} | {"__next": F.lead("time").over(order)})
    # number of the first grid point at a time or after it: its quotient, or a neighbour where rounding says so
    point = lambda i: f"(__t0 + ({i}) * ((__t0 + {period!r}D) - __t0))"
    least = lambda t, k: f"CASE WHEN {point(f'{k} - 1')} >= {t} THEN {k} - 1 WHEN {point(k)} >= {t} THEN {k} ELSE {k} + 1 END"
    guess = lambda t: F.expr(f"ceil(({t} - __t0) / ((__t0 + {period!r}D) - __t0))")
    x = x.withColumns({"__a": guess("time"), "__b": guess("__next")})
    end = f"ceil((__t1 + {period * 0.5!r}D - __t0) / {period!r}D)"
    x = x.withColumns({"__a": F.expr(least("time", "__a")), "__b": F.least(F.expr(end), F.expr(f"IF(__next IS NULL, {end}, {least('__next', '__b')})"))})
    x = x.withColumn("__at", F.explode(F.expr(f"IF(__n = 1, array(time), IF(__a < __b, transform(sequence(__a, __b - 1), i -> {point('i')}), array()))")))
    value = lambda s: F.expr(f"CASE WHEN __l_{s} IS NULL THEN __r_{s}.v WHEN __r_{s} IS NULL OR __l_{s}.t = __at THEN __l_{s}.v ELSE (__r_{s}.v - __l_{s}.v) / nullif(__r_{s}.t - __l_{s}.t, 0D) * (__at - __l_{s}.t) + __l_{s}.v END")
    flag = F.expr(f"coalesce(CAST(__next - time > {float(long_gap)!r}D AND time < __at AND __at < __next AS DOUBLE), 0D)")
    return x.select(*by, F.col("__at").alias("time"), *(value(s).alias(s) for s in values), flag.alias("long_gap_flag"))


def fill_gaps(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Nulls filled by row-wise linear interpolation, then from the nearest value at the ends."""
    at = W.partitionBy(*by).orderBy("time")
    x = df.withColumn("__i", F.row_number().over(at))
    point = lambda s: F.when(F.col(s).isNotNull(), F.struct(F.col("__i").alias("i"), F.col(s).alias("v")))
    x = x.withColumns({f"__l_{s}": F.last(point(s), ignorenulls=True).over(at.rowsBetween(W.unboundedPreceding, 0)) for s in columns})
    back = W.partitionBy(*by).orderBy(F.col("time").desc()).rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumns({f"__r_{s}": F.last(point(s), ignorenulls=True).over(back) for s in columns})
    out = {}
    for s in columns:
        left, right = F.col(f"__l_{s}"), F.col(f"__r_{s}")
        out[s] = F.when(left.isNull(), right["v"]).when(right.isNull() | (left["i"] == right["i"]), left["v"]).otherwise(left["v"] + (right["v"] - left["v"]) * (F.col("__i") - left["i"]) / F.nullif(right["i"] - left["i"], F.lit(0)))
    return x.withColumns(out).drop("__i", *(f"__{side}_{s}" for s in columns for side in "lr"))


def smoothing_width(seconds: float, hz: float) -> int:
    return max(1, round(seconds * hz))


def rolling_mean(x: Column, order: W, width: int) -> Column:
    """Centred mean over ``width`` rows, over fewer at the ends."""
    return x if width <= 1 else F.avg(x).over(order.rowsBetween(-(width // 2), (width - 1) // 2))


def gradient(x: Column, t: Column, order: W) -> Column:
    """Second-order differences inside, first-order at the ends, 0 for a single row."""
    before, after = F.lag(x).over(order), F.lead(x).over(order)
    h1, h2 = t - F.lag(t).over(order), F.lead(t).over(order) - t
    inner = (h1 * h1 * after - h2 * h2 * before + (h2 * h2 - h1 * h1) * x) / F.nullif(h1 * h2 * (h1 + h2), F.lit(0.0))
    no = lambda c: c.isNull()
    return F.when(no(h1) & no(h2), 0.0).when(no(h1), (after - x) / F.nullif(h2, F.lit(0.0))).when(no(h2), (x - before) / F.nullif(h1, F.lit(0.0))).otherwise(inner)


def smoothed(df: DataFrame, by: list[str], width: int) -> DataFrame:
    order = W.partitionBy(*by).orderBy("time")
    x = df.withColumns({s: rolling_mean(F.col(s), order, width) for s in SIGNALS})
    return x.withColumn("altitude", F.col("world_y"))


def derived(df: DataFrame, by: list[str], width: int) -> DataFrame:
    """Speed, load, rates and turn rate from positions and attitudes."""
    order = W.partitionBy(*by).orderBy("time")
    t = F.col("time")
    x = df.withColumns({"vx": gradient(F.col("world_x"), t, order), "vy": gradient(F.col("world_y"), t, order), "vz": gradient(F.col("world_z"), t, order), "yaw_rate": gradient(F.col("yaw"), t, order), "roll_rate": gradient(F.col("roll"), t, order), "pitch_rate": gradient(F.col("pitch"), t, order)})
    x = x.withColumns({f"a{c}": gradient(F.col(f"v{c}"), t, order) for c in "xyz"})
    vx, vy, vz, ax, ay, az = (F.col(c) for c in ("vx", "vy", "vz", "ax", "ay", "az"))
    cx, cy, cz = vy * az - vz * ay, vz * ax - vx * az, vx * ay - vy * ax
    x = x.withColumns({"__v2": vx * vx + vy * vy + vz * vz, "__c": F.sqrt(cx * cx + cy * cy + cz * cz)})
    speed = F.sqrt("__v2")
    normal = F.when(speed > 1e-6, F.col("__c") / F.nullif(speed, F.lit(0.0))).otherwise(0.0) / GRAVITY
    x = x.withColumns({"__speed": speed, "__g": F.sqrt(1 + normal * normal), "__turn": F.when(F.col("__v2") > 1e-6, F.degrees(F.col("__c") / F.nullif(F.col("__v2"), F.lit(0.0)))).otherwise(0.0)})
    x = x.withColumns({"speed": rolling_mean(F.col("__speed"), order, width), "g_load": rolling_mean(F.col("__g"), order, width), "turn_rate": rolling_mean(F.col("__turn"), order, width), "vertical_speed": vy})
    return x.withColumn("raw_missing_any", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "raw_missing_any"))).drop("__v2", "__c", "__speed", "__g", "__turn")


def preprocess(df: DataFrame, by: list[str], hz: float = 5.0, smoothing: float = 0.6, long_gap: float = 1.0) -> DataFrame:
    """by, time, the signals, raw_missing_any, long_gap_flag and the derived rates on a regular grid."""
    width = smoothing_width(smoothing, hz)
    x = derived(smoothed(resample(unwrap(source_rows(df, by), by), by, hz, long_gap), by, width), by, width)
    return x.select(*by, "time", *SIGNALS, *RATES, "raw_missing_any", "long_gap_flag")
