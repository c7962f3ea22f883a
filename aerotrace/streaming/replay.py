"""Tables replayed as streams until they are used up, and the result as a table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scratch(spark: SparkSession) -> str:
    """A folder below the session's shared checkpoint folder; a temporary one where none is set."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return f"{shared or tempfile.mkdtemp(prefix='stream')}/{uuid.uuid4().hex}"


def packets(events: DataFrame) -> DataFrame:
    """Events as JSON packets of sessions."""
    own = F.struct(F.col("value").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), (200 + F.col("value")).alias("TAS"), (5000 + F.col("value")).alias("alt_asl"), F.lit(2.0).alias("Gy"))
    other = F.struct((F.col("value") + 3000).alias("x"), F.lit(4000.0).alias("y"), F.lit(0.0).alias("z"))
    packet = F.struct(F.col("event_id").cast("double").alias("timestamp"), (F.col("event_id") % 3 != 0).alias("has_enemy"), own.alias("self_aircraft"), other.alias("enemy_aircraft"))
    return events.select(F.col("user_id").cast("string").alias("session"), F.to_json(packet).alias("value"))


def table_of(spark: SparkSession, sf_dir: str, query: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """query over the stream of the events table, run until all is read."""
    folder = scratch(spark)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
        # the file source lists folders, so the one table is picked by its name
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        run = query(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(f"{folder}/out")
