"""CSV tables of the engine (labelled windows, edits, pairs, sessions, reports) and the expansion of input paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerotrace.functions.text import object_id
from aerotrace.operators.learning import cleaned
from aerotrace.schema import ATTRIBUTES, EDITS, FEATURES, LABELS, RULE_LABELS, require_columns

LOG_SUFFIX = ".acmi"


def expand_inputs(spark: SparkSession, paths: list[str], recursive: bool = False) -> list[str]:
    """The log files that paths name, through Spark's file systems: folders as their sorted logs, each file once.

    A path that doesn't exist and a folder without logs raise FileNotFoundError.
    """
    out: dict[str, None] = {}
    for raw in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(raw)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            raise FileNotFoundError(f"input path not found: {raw}")
        found = [system.makeQualified(path).toString()]
        if system.getFileStatus(path).isDirectory():
            files, found = system.listFiles(path, recursive), []
            while files.hasNext():
                name = files.next().getPath().toString()
                if name.endswith(LOG_SUFFIX):
                    found.append(name)
            if not found:
                raise FileNotFoundError(f"no logs found in directory: {raw}")
        out.update(dict.fromkeys(sorted(found)))
    return list(out)


def numbered_rows(df: DataFrame, name: str, place: tuple[str, ...] = ("__file", "__start")) -> DataFrame:
    """df, read from files, with the position of each row by file and place in it, from 0.

    Rows are numbered inside each split and the splits' counts are summed up, so
    no task sees all rows.
    """
    x = df.withColumns({"__file": F.col("_metadata.file_path"), "__start": F.col("_metadata.file_block_start"), "__row": F.monotonically_increasing_id()})
    sizes = x.groupBy(*place).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy(*place).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a split
    sizes = sizes.select(*place, before.alias("__before"))
    inside = F.row_number().over(W.partitionBy(*place).orderBy("__row")) - 1
    return x.withColumn("__at", inside).join(sizes, list(place)).withColumn(name, F.col("__before") + F.col("__at")).drop("__file", "__start", "__row", "__at", "__before")


def read_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All columns as text; an empty field is null."""
    return spark.read.csv(paths, header=True, inferSchema=False, multiLine=False, escape='"')


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """df with a header, quoted as CSV asks for; a null is an empty field."""
    df.write.mode(mode).csv(path, header=True, escape='"')


def label_names(column: Column) -> Column:
    names = F.create_map(*(F.lit(v) for i, k in enumerate(LABELS) for v in (i, k)))
    return F.coalesce(F.try_element_at(names, column.cast("int")), F.lit("Unknown"))


def read_labeled(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Labelled windows: numbers as numbers, flags as booleans, ids trimmed; absent label columns filled from those that are there.

    aircraft_id, window_start, window_end and label or label_name must be there.
    """
    df = require_columns(read_csv(spark, paths), ["aircraft_id", "window_start", "window_end"])
    kinds = {c: "double" for c in [*FEATURES, "window_start", "window_end", "window_duration", *(f"score_{k.lower()}" for k in RULE_LABELS)]}
    kinds |= {c: "int" for c in ("label", "main_label_id", "rule_based_label", "predicted_label", "attribute_count", "sample_count", "training_label")}
    kinds |= {c: "boolean" for c in [*(f"flag_{k.lower()}" for k in RULE_LABELS), *(f"attr_{k.lower()}" for k in ATTRIBUTES)]}
    df = df.withColumns({c: F.col(c).try_cast(kind) for c, kind in kinds.items() if c in df.columns} | {"aircraft_id": object_id(F.col("aircraft_id"))})
    has = df.columns
    if "label_name" not in has:
        if "label" not in has:
            raise ValueError("labelled windows must have label or label_name")
        df = df.withColumn("label_name", label_names(F.col("label")))
    for new, old in (("rule_based_label", "label"), ("rule_based_label_name", "label_name")):
        if new not in has and old in df.columns:
            df = df.withColumn(new, F.col(old))
    if "predicted_label" in has and "predicted_label_name" not in has:
        df = df.withColumn("predicted_label_name", label_names(F.col("predicted_label")))
    return df


def read_edits(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Human edits with edit_index, the order of the rows; names and aliases are resolved where they are applied."""
    df = numbered_rows(read_csv(spark, paths).drop("edit_index"), "edit_index").withColumn("edit_index", F.col("edit_index").cast("int"))
    return df.withColumns({f.name: F.col(f.name).try_cast(f.dataType) for f in EDITS if f.name in df.columns})


def append_edits(edits: DataFrame, path: str) -> None:
    """Adds edits to a folder of CSV files, in the order of their times; each gets the UTC stamp of now if it has none."""
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    columns = [f.name for f in EDITS if f.name != "edit_index"]
    x = edits.withColumns({c: F.lit(None).cast("string") for c in columns if c not in edits.columns})
    write_csv(x.withColumn("edited_utc", F.coalesce("edited_utc", stamp)).select(*columns).coalesce(1), path, "append")


def read_regression(spark: SparkSession, paths: str | list[str], columns: list[str], target: str = "score") -> DataFrame:
    """Training rows: columns and target as numbers, missing and infinite ones 0; rows without a target are left out."""
    df = require_columns(read_csv(spark, paths), [*columns, target])
    return cleaned(df.filter(F.col(target).try_cast("double").isNotNull()), [*columns, target])


#: Fields of a flattened session row: aircraft, field of the packet, columns that may hold it.
_OWN = {c: (f"self_aircraft_{c}",) for c in ("x", "y", "z", "heading", "pitch", "bank", "TAS", "mach", "alt_asl", "AoA", "Gy", "roll_rate", "pitch_rate", "yaw_rate", "throttle")}
_OTHER = {c: (f"enemy_aircraft_{c}",) for c in ("x", "y", "z", "heading", "pitch", "bank")} | {"alt": ("enemy_aircraft_alt", "enemy_aircraft_y")}


def read_sessions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Recorded sessions as packets: session (the file), timestamp, model_time, has_enemy, self_aircraft, enemy_aircraft; absent fields are 0."""
    df = read_csv(spark, paths).withColumn("session", F.col("_metadata.file_path"))
    has = set(df.columns)

    def value(names: tuple[str, ...]) -> Column:
        own = [F.col(c).try_cast("double") for c in names if c in has]
        return F.coalesce(*own, F.lit(0.0))

    fields = lambda table: F.struct(*(value(names).alias(c) for c, names in table.items()))
    enemy = F.lower("has_enemy").isin("true", "1") if "has_enemy" in has else F.lit(any(c.startswith("enemy_aircraft_") for c in has))
    return df.select("session", value(("timestamp", "model_time")).alias("timestamp"), value(("model_time", "timestamp")).alias("model_time"), F.coalesce(enemy, F.lit(False)).alias("has_enemy"), fields(_OWN).alias("self_aircraft"), fields(_OTHER).alias("enemy_aircraft"))
