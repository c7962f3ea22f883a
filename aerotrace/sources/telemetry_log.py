"""The telemetry text log: scan, line classes, object state, losses and writing back."""

from __future__ import annotations

import io
import zipfile
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerotrace.functions import geometry as g
from aerotrace.functions.text import number, properties, property_value
from aerotrace.operators.engagement import attributed, is_aircraft
from aerotrace.operators.windows import range_join
from aerotrace.schema import GRAVITY, KNOTS, STATE_NUMBER, STATE_TEXT

LINES = "source string, line_no long, raw string"
#: Lines that are scanned as one piece.
SEGMENT = 1 << 16
#: Frames that are numbered as one piece.
FRAMES_PER_PART = 64


def _lines(df: DataFrame, text: str = "value") -> DataFrame:
    clean = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r", "")
    return df.select("source", F.posexplode(F.split(clean, "\n")).alias("line_no", "raw")).select("source", F.col("line_no").cast("long"), "raw")


def before_parts(parts: DataFrame, by: list[str], part: str, totals: dict[str, Column]) -> DataFrame:
    """by, part and aggregates of the parts before each: parts holds one row per part, so the window over ``by`` sees those alone."""
    ahead = W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    return parts.select(*by, part, *(c.over(ahead).alias(n) for n, c in totals.items()))


def numbered(df: DataFrame, by: list[str], part: Column, order: list[str], name: str) -> DataFrame:
    """df with the place of each row from 0 among those of its ``by``, in ``order``; ``part`` grows with the order, so no task sees more than a part."""
    x = df.withColumn("__part", part)
    counts = before_parts(x.groupBy(*by, "__part").agg(F.count("*").alias("__n")), by, "__part", {"__before": F.sum("__n")})
    x = x.withColumn("__at", F.row_number().over(W.partitionBy(*by, "__part").orderBy(*order)) - 1).join(counts, [*by, "__part"])
    return x.withColumn(name, F.coalesce("__before", F.lit(0)).cast("long") + F.col("__at")).drop("__part", "__at", "__before")


def read_log(spark: SparkSession, paths: str | list[str], recursive: bool = False, pattern: str = "*.acmi") -> DataFrame:
    """source, line_no, raw of text logs (files, or folders of them); .zip and .zip.acmi archives go to read_zip_log.

    A log is read in splits, so a long one by many tasks.  A row's place in its split is its
    row id less the split's first; counts of the splits before it make that the line number.
    The splits' table, a row for each split of the scan that the driver plans, is broadcast.
    """
    reader = spark.read.option("recursiveFileLookup", recursive).option("lineSep", "\n")
    if all(not PurePosixPath(p).suffix for p in ([paths] if isinstance(paths, str) else paths)):
        reader = reader.option("pathGlobFilter", pattern)
    x = reader.text(paths).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_size").alias("__size"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"), "value")
    splits = x.groupBy("source", "__block").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"), F.sum(F.octet_length("value") + 1).alias("__bytes"), F.max("__size").alias("__size"))
    shift = before_parts(splits, ["source"], "__block", {"__before": F.sum("__n")}).join(splits.select("source", "__block", "__first"), ["source", "__block"])
    shift = shift.select("source", "__block", (F.coalesce("__before", F.lit(0)) - F.col("__first")).alias("__shift"))
    lines = x.join(F.broadcast(shift), ["source", "__block"]).select("source", (F.col("__id") + F.col("__shift")).alias("line_no"), "value")
    # a text that ends with a newline has an empty line behind it; the reader drops the three bytes of a byte-order mark
    ends = splits.groupBy("source").agg(F.sum("__n").alias("line_no"), F.sum("__bytes").alias("__bytes"), F.max("__size").alias("__size")).filter("__bytes IN (__size, __size - 3)")
    raw = F.regexp_replace(F.when(F.col("line_no") == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")), "\r", "")
    return lines.select("source", "line_no", raw.alias("raw")).union(ends.select("source", "line_no", F.lit("")))


def read_zip_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The same of the first member of each archive."""

    def first_member(batches):
        for pdf in batches:
            texts = []
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    texts.append(z.read(z.namelist()[0]).decode("utf-8-sig"))
            yield pd.DataFrame({"source": pdf["path"], "value": texts})

    return _lines(spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(first_member, "source string, value string"))


def classified(lines: DataFrame) -> DataFrame:
    """lines with kind (blank, header, frame, removal, global, update, other), frame_idx, t and the time of the last valid frame.

    Frames are counted, and the last time is carried on, inside segments of ``SEGMENT`` lines; what the
    segments before hold is joined to each.
    """
    s = F.trim("raw")
    kind = (
        F.when(s == "", "blank").when(s.startswith("FileType=") | s.startswith("FileVersion="), "header").when(s.startswith("#"), "frame")
        .when(s.startswith("-"), "removal").when(s.startswith("0,"), "global").when(s.contains(","), "update").otherwise("other")
    )
    x = lines.withColumns({"raw": s, "kind": kind})
    x = x.withColumns({"t": F.when(F.col("kind") == "frame", number(F.trim(F.substring("raw", 2, 1 << 30)))), "__part": F.floor(F.col("line_no") / SEGMENT)})
    mark = (F.col("kind") == "frame").cast("long")
    inside = W.partitionBy("source", "__part").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    parts = x.groupBy("source", "__part").agg(F.sum(mark).alias("__marks"), F.max_by("t", F.when(F.col("t").isNotNull(), F.col("line_no"))).alias("__t"))
    parts = before_parts(parts, ["source"], "__part", {"__marks": F.sum("__marks"), "__t": F.last("__t", ignorenulls=True)})
    x = x.withColumns({"__own": F.sum(mark).over(inside), "__now": F.last("t", ignorenulls=True).over(inside)}).join(parts, ["source", "__part"])
    x = x.withColumns({"frame_idx": F.coalesce("__marks", F.lit(0)).cast("long") + F.col("__own"), "now": F.coalesce("__now", "__t", F.lit(0.0))})
    return x.select(*lines.columns, "kind", "t", "frame_idx", "now")


def frames_of(x: DataFrame) -> DataFrame:
    return x.filter("kind = 'frame' AND t IS NOT NULL").select("source", "frame_idx", F.col("t").alias("time"), F.substring("raw", 2, 1 << 30).alias("frame_text"))


def global_properties(x: DataFrame) -> DataFrame:
    """The last value of each header property of a log."""
    keys = ["ReferenceTime", "ReferenceLongitude", "ReferenceLatitude", "RecordingTime", "Title", "Author"]
    p = x.filter("kind = 'global'").select("source", "line_no", F.explode(properties(F.substring("raw", 3, 1 << 30))).alias("p"))
    p = p.select("source", "line_no", F.trim(F.substring_index("p", "=", 1)).alias("key"), F.trim(F.regexp_replace("p", "^[^=]*=", "")).alias("value"))
    return p.groupBy("source").pivot("key", keys).agg(F.max_by("value", "line_no"))


def updates(x: DataFrame) -> DataFrame:
    """State after every update line: LOCF per life of an object; removal ends a life.

    _corrupt holds a line whose numbers don't parse; such numbers keep their
    previous values.
    """
    own = x.filter("kind IN ('update', 'removal')")
    own = own.withColumn("object_id", F.when(F.col("kind") == "removal", F.substring("raw", 2, 1 << 30)).otherwise(F.trim(F.substring_index("raw", ",", 1))))
    parts = properties(F.regexp_replace("raw", "^[^,]*,", ""))
    own = own.withColumn("p", F.when(F.col("kind") == "update", parts))
    v = lambda k: property_value(F.col("p"), k)
    own = own.withColumns({"T": F.split(v("T"), "\\|"), "ias": number(v("IAS")) * KNOTS, "tas": number(v("TAS")) * KNOTS, "mach": number(v("Mach")), "aoa": F.radians(number(v("AOA"))), "name": v("Name"), "pilot": v("Pilot"), "obj_type": v("Type"), "coalition": v("Coalition"), "country": v("Country")})
    at = lambda i, least: F.when(F.size("T") >= least, number(F.get("T", F.lit(i))))
    own = own.withColumns({n: at(i, 3 if i < 3 else 6) for i, n in enumerate(("longitude", "latitude", "altitude", "roll", "pitch", "yaw"))})
    bad = F.exists(F.slice(F.coalesce("T", F.array().cast("array<string>")), 1, 6), lambda s: (s != "") & number(s).isNull())
    own = own.withColumn("_corrupt", F.when(bad, F.col("raw")))

    life = W.partitionBy("source", "object_id").orderBy("line_no")
    own = own.withColumn("life", F.coalesce(F.sum((F.col("kind") == "removal").cast("int")).over(life.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    order = W.partitionBy("source", "object_id", "life").orderBy("line_no")
    so_far, before = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, -1)
    measured = [n for n in STATE_NUMBER if n not in ("speed", "g_load", "world_x", "world_y", "world_z")]
    y = own.withColumns({n: F.coalesce(F.last(n, ignorenulls=True).over(so_far), F.lit(STATE_NUMBER[n])) for n in measured} | {n: F.coalesce(F.last(n, ignorenulls=True).over(so_far), F.lit("")) for n in STATE_TEXT})
    seen = F.last(F.when(F.col("T").isNotNull(), F.lit(True)), ignorenulls=True).over(so_far)
    local = g.to_local(F.col("longitude"), F.col("latitude"), F.col("altitude"))
    y = y.withColumns({f"world_{c}": F.when(seen, p).otherwise(0.0) for c, p in zip("xyz", local, strict=True)})

    # speed and load from the positions at successive transforms
    point = F.when(F.col("T").isNotNull(), F.struct("now", "world_x", "world_y", "world_z"))
    y = y.withColumn("__was", F.last(point, ignorenulls=True).over(before))
    dt = F.col("now") - F.col("__was.now")
    moved = F.col("T").isNotNull() & (F.col("__was.now") >= 0) & (dt > 0)
    y = y.withColumn("__v", F.when(moved, F.struct(*(((F.col(f"world_{c}") - F.col(f"__was.world_{c}")) / F.nullif(dt, F.lit(0.0))).alias(c) for c in "xyz"), dt.alias("dt"))))
    y = y.withColumn("__u", F.last("__v", ignorenulls=True).over(before))
    a = {c: (F.col(f"__v.{c}") - F.col(f"__u.{c}")) / F.col("__v.dt") + (GRAVITY if c == "y" else 0.0) for c in "xyz"}
    y = y.withColumns({"speed": g.distance(*(F.col(f"__v.{c}") for c in "xyz")), "g_load": F.when(F.col("__u").isNotNull(), g.distance(*(a[c] for c in "xyz")) / GRAVITY)})
    y = y.withColumns({n: F.coalesce(F.last(n, ignorenulls=True).over(so_far), F.lit(STATE_NUMBER[n])) for n in ("speed", "g_load")})
    until = F.lead("line_no").over(life)
    y = y.withColumns({"until": until, "ord": F.min(F.when(F.col("kind") == "update", F.col("line_no"))).over(W.partitionBy("source", "object_id", "life"))})
    return y.select("source", "line_no", "until", "frame_idx", "now", "kind", "object_id", "life", "ord", "_corrupt", *STATE_TEXT, *STATE_NUMBER)


def frame_state(x: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """One row per frame and live object: its state at the end of the frame.

    A state lasts until the frame of the object's next change, so frames are filled
    by exploding ranges of frame numbers; a frame without a valid time has no rows.
    """
    changes = updates(x) if changes is None else changes
    block = F.greatest("frame_idx", F.lit(1))
    last = changes.withColumn("frame_idx", block)
    rows = W.partitionBy("source", "object_id", "frame_idx").orderBy(F.col("line_no").desc())
    last = last.withColumn("__n", F.row_number().over(rows)).filter("__n = 1").drop("__n")
    order = W.partitionBy("source", "object_id").orderBy("frame_idx")
    ends = x.groupBy("source").agg(F.max("frame_idx").alias("__last"))
    y = last.withColumn("__next", F.lead("frame_idx").over(order)).join(ends, "source").filter("kind = 'update'")
    stop = F.coalesce(F.col("__next") - 1, F.col("__last"))
    y = y.filter(stop >= F.col("frame_idx")).withColumn("frame_idx", F.explode(F.sequence("frame_idx", stop)))
    return y.join(frames_of(x), ["source", "frame_idx"]).select("source", "frame_idx", "time", "object_id", "ord", *STATE_TEXT, *STATE_NUMBER)


def kill_events(x: DataFrame, changes: DataFrame | None = None, dedup: bool = False, bucket: int = 4096) -> DataFrame:
    """source, line_no, time, victim and killer of every loss of an aircraft: removals, and Destroyed or LeftArea events.

    States alive at a loss are found by a range join on line numbers.  dedup
    keeps the first loss of each life.
    """
    changes = updates(x) if changes is None else changes
    told = x.filter("kind = 'global'").select("source", "line_no", "now", F.explode(properties(F.substring("raw", 3, 1 << 30))).alias("p")).filter(F.col("p").startswith("Event="))
    parts = F.split(F.substring("p", 7, 1 << 30), "\\|")
    lost = told.filter((F.size(parts) >= 2) & (F.get(parts, F.lit(0)).contains("Destroyed") | F.get(parts, F.lit(0)).contains("LeftArea"))).select("source", "line_no", "now", F.trim(F.get(parts, F.lit(1))).alias("victim_id"))
    gone = x.filter("kind = 'removal'").select("source", "line_no", "now", F.substring("raw", 2, 1 << 30).alias("victim_id"))
    ends = x.groupBy("source").agg((F.max("line_no") + 1).alias("__end"))
    alive = changes.filter("kind = 'update'").join(ends, "source").select("source", "object_id", "ord", "life", "name", "coalition", "obj_type", F.col("world_x").alias("x"), F.col("world_y").alias("y"), F.col("world_z").alias("z"), "yaw", (F.col("line_no") + 1).alias("__from"), F.coalesce("until", "__end").alias("__until")).filter("__from <= __until")
    met = range_join(lost.union(gone).withColumnRenamed("line_no", "event_line"), alive, ["source"], "event_line", "__from", "__until", bucket)
    victim = met.filter((F.col("object_id") == F.col("victim_id")) & is_aircraft(F.col("obj_type"))).select("source", "event_line", "victim_id", "life", F.col("name").alias("victim_name"), F.col("coalition").alias("victim_coalition"), F.col("x").alias("vx"), F.col("y").alias("vy"), F.col("z").alias("vz"), F.col("now").alias("time"))
    if dedup:
        first = W.partitionBy("source", "victim_id", "life").orderBy("event_line")
        victim = victim.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    others = met.select("source", "event_line", "object_id", "ord", "name", "coalition", "obj_type", "x", "y", "z", "yaw", "victim_id").withColumnRenamed("victim_id", "__of")
    return attributed(victim.drop("life"), others.drop("__of").distinct(), ["source", "event_line"])


def written(lines: DataFrame, scheduled: DataFrame) -> DataFrame:
    """lines with the scheduled updates (source, frame_text, rank, update) right after every matching frame line: source, line_no, rank, raw."""
    frames = lines.filter(F.trim("raw").startswith("#")).select("source", "line_no", F.trim(F.substring(F.trim("raw"), 2, 1 << 30)).alias("frame_text"))
    added = frames.join(scheduled, ["source", "frame_text"]).select("source", "line_no", "rank", F.col("update").alias("raw"))
    return lines.select("source", "line_no", F.lit(0).alias("rank"), "raw").union(added)


def write_log(rows: DataFrame, path: str) -> None:
    """One folder per source, each a single sorted text file; sources with one file name have different folders."""
    from aerotrace.sources.log_files import unique_stems

    x = rows.join(unique_stems(rows), "source")
    x.repartition("source_stem").sortWithinPartitions("source_stem", "line_no", "rank").select("source_stem", F.col("raw").alias("value")).write.mode("overwrite").partitionBy("source_stem").text(path)


def zipped(rows: DataFrame, member: str = "log.acmi") -> DataFrame:
    """source, content: each log as the bytes of a deflated archive with one member, text led by a byte-order mark."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(member, ("﻿" + "\n".join(pdf.sort_values(["line_no", "rank"])["raw"])).encode("utf-8"))
        return pd.DataFrame({"source": [pdf["source"].iloc[0]], "content": [out.getvalue()]})

    return rows.groupBy("source").applyInPandas(pack, "source string, content binary")


def as_lines(state: DataFrame) -> DataFrame:
    """Log lines of state rows (source, frame_idx, time, ord, object_id, name, obj_type, coalition and transform, null for a removal): the inverse of the scan."""
    head = state.select("source").distinct().select("source", F.posexplode(F.array(F.lit("FileType=text/acmi/tacview"), F.lit("FileVersion=2.2"), F.concat(F.lit("0,Title="), "source"))).alias("o", "raw")).select("source", F.lit(-1).alias("frame_idx"), F.col("o").cast("long").alias("ord"), "raw")
    marks = state.select("source", "frame_idx", "time").distinct().select("source", "frame_idx", F.lit(-1).cast("long").alias("ord"), F.concat(F.lit("#"), F.format_string("%.2f", "time")).alias("raw"))
    named = F.when(F.col("first"), F.concat(F.lit(",Name="), "name", F.lit(",Type="), "obj_type", F.lit(",Coalition="), "coalition")).otherwise("")
    first = F.row_number().over(W.partitionBy("source", "object_id").orderBy("frame_idx")) == 1
    rows = state.withColumn("first", first).select("source", "frame_idx", "ord", F.coalesce(F.concat("object_id", F.lit(",T="), "transform", named), F.concat(F.lit("-"), "object_id")).alias("raw"))
    every = head.union(marks).union(rows)
    return numbered(every, ["source"], F.floor(F.col("frame_idx") / FRAMES_PER_PART), ["frame_idx", "ord"], "line_no").select("source", "line_no", "raw")


def is_log(path: Column) -> Column:
    return F.lower(path).endswith(".acmi") | F.lower(path).endswith(".txt")
