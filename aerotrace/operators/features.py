"""The 45 features of a sliding window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerotrace.operators.windows import EPS, sliding_windows
from aerotrace.schema import FEATURES

SHORT = 2.0
SAMPLE = ["time", "yaw", "pitch", "turn_rate", "vertical_speed", "g_load", "yaw_rate", "roll_rate", "pitch_rate"]
DEADBANDS = {"turn": ("yaw_rate", 0.2), "roll": ("roll_rate", 1.0), "pitch": ("pitch_rate", 0.5)}
#: What a sub-window from a sample on holds: changes of sign, peaks and the load's deviation.
AHEAD = ["turn_sign_changes", "roll_sign_changes", "pitch_sign_changes", "turn_rate_peak", "roll_rate_peak", "g_std"]
#: Samples this close to a grid are on it.
ON_GRID = 1e-10


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that later steps share: a generator keeps the optimizer from copying them into every use."""
    return df.withColumn("__once", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))).select(*df.columns, "__once.*")


def settled(df: DataFrame, by: list[str]) -> DataFrame:
    """df with all columns but ``by`` computed: what follows uses them, not the expressions they come from, however often."""
    rest = [c for c in df.columns if c not in by]
    return df.select(*by, F.explode(F.array(F.struct(*rest))).alias("__row")).select(*by, "__row.*")


def sign_changes(rows: Column, field: str, deadband: float) -> Column:
    """Changes of sign between neighbouring values outside the dead band."""
    signs = F.transform(F.filter(rows, lambda x: F.abs(x[field]) > deadband), lambda x: F.signum(x[field]))
    # the fold carries the sign before and the changes so far
    start = F.struct(F.lit(0.0).alias("sign"), F.lit(0).alias("n"))
    return F.aggregate(signs, start, lambda a, x: F.struct(x.alias("sign"), (a["n"] + ((a["sign"] != 0) & (a["sign"] != x)).cast("int")).alias("n")), lambda a: a["n"])


def with_ahead(df: DataFrame, by: list[str]) -> DataFrame:
    """df with what the sub-window from each sample on holds (AHEAD), and each sample's change of sign.

    A change is told once, at the sample outside the dead band whose sign differs from that of the one before;
    a window has the sum of its changes but for that of its first such sample, which is against one outside.
    Everything is a frame over the series, so samples that many windows share are looked at once.
    """
    order = W.partitionBy(*by).orderBy("time")
    x = settled(df, by).withColumns({f"__sign_{n}": F.when(F.abs(field) > band, F.signum(field)) for n, (field, band) in DEADBANDS.items()})
    before = {n: F.last(f"__sign_{n}", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)) for n in DEADBANDS}
    x = x.withColumns({f"__change_{n}": F.when(F.col(f"__sign_{n}").isNotNull(), (F.coalesce(before[n], F.col(f"__sign_{n}")) != F.col(f"__sign_{n}")).cast("int")) for n in DEADBANDS})
    frame = f"OVER (PARTITION BY {', '.join(f'`{c}`' for c in by)} ORDER BY time RANGE BETWEEN CURRENT ROW AND {SHORT + EPS}D FOLLOWING)"
    found = {f"{n}_sign_changes": f"coalesce(sum(__change_{n}) {frame} - first(__change_{n}, true) {frame}, 0)" for n in DEADBANDS}
    found |= {"turn_rate_peak": f"max(abs(turn_rate)) {frame}", "roll_rate_peak": f"max(abs(roll_rate)) {frame}", "g_std": f"stddev_pop(g_load) {frame}"}
    return x.withColumns({f"__{n}": F.expr(found[n]).cast("double") for n in AHEAD}).drop(*(f"__sign_{n}" for n in DEADBANDS))


def mean_of(rows: Column, value) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda a, x: a + value(x)) / F.nullif(F.size(rows), F.lit(0))


def std_of(rows: Column, field: str) -> Column:
    """Population deviation in two passes."""
    return let(mean_of(rows, lambda x: x[field]), lambda m: F.sqrt(mean_of(rows, lambda x: (x[field] - m) * (x[field] - m))))


def slope(y: Column, t: Column) -> Column:
    return F.coalesce(F.regr_slope(y, t), F.lit(0.0))


def residual_std(y: Column, t: Column) -> Column:
    n = F.regr_count(y, t)
    rest = F.regr_syy(y, t) - F.regr_sxy(y, t) * F.regr_sxy(y, t) / F.nullif(F.regr_sxx(y, t), F.lit(0.0))
    return F.when(n < 3, 0.0).otherwise(F.coalesce(F.sqrt(F.greatest(rest, F.lit(0.0)) / n), F.lit(0.0)))


def any_of(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False)).cast("int")


def odd(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def halves(samples: Column) -> tuple[Column, Column]:
    """The rows up to the middle time and those from it on; at least two each."""
    mid = (F.element_at(samples, 1)["time"] + F.element_at(samples, -1)["time"]) / 2
    least = F.greatest(F.lit(2), F.floor(F.size(samples) / 2).cast("int"))
    a, b = F.filter(samples, lambda x: x["time"] <= mid), F.filter(samples, lambda x: x["time"] >= mid)
    return F.when(F.size(a) < 2, F.slice(samples, 1, least)).otherwise(a), F.when(F.size(b) < 2, F.slice(samples, -F.least(least, F.size(samples)), least)).otherwise(b)


def window_features(df: DataFrame, by: list[str], size: float = 5.0, step: float = 2.5) -> DataFrame:
    """One row per window of each series of preprocessed rows: its bounds, its features; see schema.FEATURES.

    Each window's few samples are gathered once, sorted, for its halves; all else is aggregated, and sub-windows
    take what with_ahead found for their first samples.
    """
    x = sliding_windows(with_ahead(df, by), by, size, step)
    t = F.col("time") - F.col("window_start")
    c = {n: F.col(n) for n in ("speed", "altitude", "pitch", "roll", "g_load", "turn_rate", "roll_rate", "pitch_rate", "vertical_speed", "yaw")}
    wrong = F.lit(False)
    for n in ("altitude", "world_x", "world_y", "world_z", "yaw", "pitch", "roll", "speed", "g_load", "yaw_rate", "turn_rate", "roll_rate", "pitch_rate", "vertical_speed"):
        wrong = wrong | odd(F.col(n))
    wrong = wrong | (c["altitude"] < -1000) | (F.abs("vertical_speed") > 300) | (F.abs("turn_rate") > 300) | (F.abs("roll_rate") > 400) | (F.abs("pitch_rate") > 200)
    conflict = (c["speed"] < -1e-6) | (F.abs("pitch") > 100) | (c["g_load"] < -3) | (c["g_load"] > 12) | (F.abs("turn_rate") > 200)
    delta = lambda n: F.max_by(c[n], "time") - F.min_by(c[n], "time")
    g = x.groupBy(*by, "window", "window_start", "window_end").agg(
        F.count("*").cast("int").alias("sample_count"),
        F.avg("speed").alias("speed_mean"), delta("speed").alias("speed_delta"), slope(c["speed"], t).alias("speed_slope"),
        F.avg("altitude").alias("alt_mean"), delta("altitude").alias("alt_delta"), slope(c["altitude"], t).alias("alt_slope"),
        F.avg("pitch").alias("pitch_mean"), F.avg("roll").alias("roll_mean"), F.avg("g_load").alias("g_mean"), F.stddev_pop("g_load").alias("g_std"),
        F.avg(F.abs("turn_rate")).alias("turn_rate_mean"), F.max(F.abs("turn_rate")).alias("turn_rate_peak"),
        F.avg(F.abs("roll_rate")).alias("roll_rate_mean"), F.max(F.abs("roll_rate")).alias("roll_rate_peak"), F.avg(F.abs("pitch_rate")).alias("pitch_rate_mean"),
        F.avg("vertical_speed").alias("vertical_speed_mean"), F.max(F.abs("vertical_speed")).alias("vertical_speed_peak"),
        F.abs(delta("yaw")).alias("heading_delta"), residual_std(c["altitude"], t).alias("alt_residual_std"),
        F.avg("raw_missing_any").alias("missing_ratio"), F.avg("long_gap_flag").alias("long_gap_ratio"),
        any_of(conflict).alias("sensor_conflict"), any_of(wrong).alias("feature_out_of_range"),
        *((F.coalesce(F.sum(c := F.col(f"__change_{n}")) - F.min_by(c, F.when(c.isNotNull(), F.col("time"))), F.lit(0))).cast("int").alias(f"{n}_sign_changes") for n in DEADBANDS),
        F.sort_array(F.collect_list(F.struct(*SAMPLE, *(F.col(f"__{n}").alias(n) for n in AHEAD)))).alias("samples"),
    ).filter("sample_count >= 2")
    s = F.col("samples")
    g = g.withColumns({"window_start_time": F.col("window_start"), "window_end_time": F.col("window_end"), "window_duration": F.lit(size)})
    a, b = halves(s)
    g = once(g, {"first_half": a, "second_half": b, "starts": regular_starts(s)})
    g = once(g, {"short": F.when(F.col("starts").isNull(), short_segments(s))})
    for half in ("first_half", "second_half"):
        h = F.col(half)
        g = g.withColumns({
            f"{half}_turn_rate_mean": mean_of(h, lambda x: F.abs(x["turn_rate"])), f"{half}_vertical_speed_mean": mean_of(h, lambda x: x["vertical_speed"]), f"{half}_pitch_mean": mean_of(h, lambda x: x["pitch"]),
            f"{half}_heading_delta": F.abs(F.element_at(h, -1)["yaw"] - F.element_at(h, 1)["yaw"]),
        })
    g = short_windows(g)
    tr, vs, p = F.col("turn_rate_mean"), F.col("vertical_speed_mean"), F.col("pitch_mean")
    zero = F.lit(0.0)
    g = g.withColumns({"dive_score_raw": F.greatest(zero, -p) + F.greatest(zero, -vs), "zoom_score_raw": F.greatest(zero, p) + F.greatest(zero, vs), "straightness_score": 1 / (1 + tr), "turn_dominance": tr / (F.abs(vs) + 1e-3)})
    return g.select(*by, "window_start", "window_end", "window_start_time", "window_end_time", "window_duration", "sample_count", *FEATURES)


def short_segments(samples: Column) -> Column:
    """The sub-windows of a window's samples: one from each sample spacing on, with two samples at least."""
    n = F.size(samples)
    gaps = F.sort_array(F.zip_with(F.slice(samples, 2, n - 1), F.slice(samples, 1, n - 1), lambda a, b: a["time"] - b["time"]))
    first, last = F.element_at(samples, 1)["time"], F.element_at(samples, -1)["time"]
    median = let(gaps, lambda x: (F.element_at(x, F.floor((F.size(x) + 1) / 2).cast("int")) + F.element_at(x, F.floor((F.size(x) + 2) / 2).cast("int"))) / 2)

    def cut(dt: Column) -> Column:
        count = F.greatest(F.ceil((last - SHORT + EPS - first) / dt).cast("int"), F.lit(1))
        starts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: first + i * dt)
        return F.transform(starts, lambda s: F.filter(samples, lambda x: (x["time"] >= s - EPS) & (x["time"] <= s + SHORT + EPS)))

    segments = let(let(median, lambda d: F.when(d > 0, d).otherwise(SHORT)), cut)
    return F.when(last - first <= SHORT + EPS, F.array(samples)).otherwise(F.filter(segments, lambda seg: F.size(seg) >= 2))


def regular_starts(samples: Column) -> Column:
    """How many sub-windows start in a window whose samples are on a grid, each at one of them; null for other windows and short ones."""
    n = F.size(samples)
    first, last = F.element_at(samples, 1)["time"], F.element_at(samples, -1)["time"]
    dt = (last - first) / F.nullif(n - 1, F.lit(0))
    off = F.exists(F.transform(samples, lambda x, i: F.abs(x["time"] - first - i * dt) > ON_GRID), lambda wrong: wrong)
    return F.when((last - first > SHORT + EPS) & (dt <= SHORT) & ~off, F.ceil((last - SHORT + EPS - first) / dt).cast("int"))


def short_windows(g: DataFrame) -> DataFrame:
    """The sub-windows' extremes: those of the samples they start at, or of the gathered rows of each where samples aren't on a grid."""
    on_grid = lambda name: F.array_max(F.transform(F.slice("samples", 1, F.col("starts")), lambda x: x[name]))
    most = lambda name, value: F.coalesce(F.when(F.col("starts").isNotNull(), on_grid(name)).otherwise(F.array_max(F.transform("short", value)).cast("double")), F.lit(0.0))
    peak = lambda field: lambda seg: F.array_max(F.transform(seg, lambda x: F.abs(x[field])))
    out = {}
    for n, (field, band) in DEADBANDS.items():
        out[f"short_{n}_sign_changes_max"] = most(f"{n}_sign_changes", (lambda f, d: lambda seg: sign_changes(seg, f, d))(field, band))
    out |= {"short_window_count": F.coalesce("starts", F.size("short")), "short_turn_rate_peak_max": most("turn_rate_peak", peak("turn_rate")), "short_roll_rate_peak_max": most("roll_rate_peak", peak("roll_rate")), "short_g_std_max": most("g_std", lambda seg: std_of(seg, "g_load"))}
    return g.withColumns(out)
