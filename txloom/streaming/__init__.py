"""Incremental node counts over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from txloom.functions.storage import scratch_path


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``start, <key>, n, total`` per tumbling window; rows later than ``late`` are left out of streams."""
    w = F.window(ts, window)
    return events.withWatermark(ts, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def degree_updates(edges: DataFrame) -> DataFrame:
    """Running degrees of a stream of edges ``src, dst`` (complete or update output)."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("d"))


def table_stream(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """A stream of the Parquet files of a folder whose name begins with ``name``."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*").parquet(folder)


def run_available(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """What a stream gives for the files there are; results and checkpoint are stored in the shared folder."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
