"""Session settings, input columns and cutting lineage, shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside the operators: null sorts after every other id.
NO_ID = (1 << 63) - 1


def visible(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package wherever the driver was started."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    visible(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def key_of(column: str) -> Column:
    """The 64-bit id, with null as the largest."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def id_of(column: str) -> Column:
    """Undoes key_of."""
    return F.when(F.col(column) != NO_ID, F.col(column))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for what is written between steps: the session's spark.checkpoint.dir, one of our own where that is unset."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, its lineage cut there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: smaller there than saved() where columns repeat their values."""
    folder = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
