"""Joins on ranges and nearest times, and sliding windows, with an equality to shuffle on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPS = 1e-9


def range_join(left: DataFrame, right: DataFrame, by: list[str], point: str, low: str, high: str, bucket: float, how: str = "inner") -> DataFrame:
    """Rows of left with those of right whose low..high holds point, with equal ``by`` columns.

    right is spread over the time buckets its range touches, so the join has an
    equality on by and bucket; every pair meets in the one bucket of its point.
    """
    spread = right.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor(F.col(high) / bucket))))
    return left.withColumn("__bucket", F.floor(F.col(point) / bucket)).alias("l").join(spread.alias("r"), [*by, "__bucket"], how).filter((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("__bucket")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], direction: str = "backward", tolerance: float | None = None, bucket: float | None = None) -> DataFrame:
    """left with the values of right's nearest row by ``on``: backward, forward or nearest (ties: the earlier).

    Both sides are united and running windows carry the last row of right; no rows
    are paired, so equal keys of any number stay linear.  Of right's rows at one
    time the last by value counts.  matched_on is the time of the match.  With a ``bucket`` (of the
    unit of ``on``) each stretch of that length is worked on by itself and gets right's last row before it and
    first row behind it, so the rows of one ``by`` are spread over many tasks; the result is the same.
    """
    r = right.select(*by, F.col(on).alias("__on"), F.struct(F.col(on).alias("t"), *values).alias("__v"), F.lit(0).alias("__side"))
    columns = [c for c in left.columns if c not in by]
    x = left.select(*by, F.col(on).alias("__on"), F.struct(*columns).alias("__row"), F.lit(1).alias("__side")).unionByName(r, allowMissingColumns=True)
    part = [*by]
    if bucket is not None:
        x, part = x.withColumn("__bucket", F.floor(F.col("__on") / bucket)), [*by, "__bucket"]
    ahead = W.partitionBy(*part).orderBy("__on", "__side", "__v").rowsBetween(W.unboundedPreceding, 0)
    behind = W.partitionBy(*part).orderBy(F.col("__on").desc(), F.col("__side"), F.col("__v").desc()).rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumns({"__b": F.last("__v", ignorenulls=True).over(ahead), "__f": F.last("__v", ignorenulls=True).over(behind)})
    if bucket is not None:
        # as above: of equal times the greatest value counts for what is before, the least for what is behind
        edges = x.groupBy(*part).agg(F.max("__v").alias("__last"), F.min("__v").alias("__first"))
        order = W.partitionBy(*by).orderBy("__bucket")  # one row a bucket
        edges = edges.select(*part, F.last("__last", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("__before"), F.last("__first", ignorenulls=True).over(W.partitionBy(*by).orderBy(F.col("__bucket").desc()).rowsBetween(W.unboundedPreceding, -1)).alias("__behind"))
        keys = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in part]
        x = x.filter("__side = 1").alias("l").join(edges.alias("r"), keys).select("l.*", "r.__before", "r.__behind")
        x = x.withColumns({"__b": F.coalesce("__b", "__before"), "__f": F.coalesce("__f", "__behind")})
    x = x.filter("__side = 1")
    b, f, t = F.col("__b"), F.col("__f"), F.col("__on")
    pick: Column = {"backward": b, "forward": f}.get(direction, F.when(b.isNull(), f).when(f.isNull() | (t - b["t"] <= f["t"] - t), b).otherwise(f))
    x = x.withColumn("__m", pick)
    if tolerance is not None:
        x = x.withColumn("__m", F.when(F.abs(t - F.col("__m.t")) <= tolerance, F.col("__m")))
    return x.select(*by, "__row.*", *(F.col(f"__m.{v}").alias(v) for v in values), F.col("__m.t").alias("matched_on"))


def sliding_windows(df: DataFrame, by: list[str], size: float = 5.0, step: float = 2.5, time: str = "time") -> DataFrame:
    """df spread over the windows that hold each row: window (number), window_start, window_end.

    Windows are anchored at a series' first time, closed at both ends within a
    tolerance, and whole: none reaches past the last time.  Which windows a row
    belongs to is arithmetic, so nothing is joined.
    """
    whole = W.partitionBy(*by)
    x = df.withColumns({"__t0": F.min(time).over(whole), "__t1": F.max(time).over(whole)})
    last = F.when(F.col("__t1") - F.col("__t0") >= size - EPS, F.floor((F.col("__t1") + EPS - size - F.col("__t0")) / step))
    at = F.col(time) - F.col("__t0")
    low, high = F.greatest(F.lit(0), F.ceil((at - size - EPS) / step)), F.least(last, F.floor((at + EPS) / step))
    x = x.filter(last.isNotNull() & (low <= high)).withColumn("window", F.explode(F.sequence(low, high)))
    start = F.col("__t0") + F.col("window") * step
    return x.withColumns({"window_start": start, "window_end": start + size}).drop("__t0", "__t1")
