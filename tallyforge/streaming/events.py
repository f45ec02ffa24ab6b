"""Streaming forms of listing work; the tables' batch operators have no event time of their own, so this is an extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyforge.session import new_path


def read(spark: SparkSession, path: str, schema: StructType, name: str, files: int = 8) -> DataFrame:
    """A stream over the parquet files of a folder whose names fit; zone-less times become UTC instants."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", name).parquet(path)
    ntz = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def deduplicated(df: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first delivery of each key within the watermark; state is dropped behind it."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windows(df: DataFrame, time: str, late: str, width: str, by: list[str], slide: str | None = None) -> DataFrame:
    """Counts and sums of tumbling (or sliding) windows, each given out once the watermark has passed it."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return df.withWatermark(time, late).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), *by, "n", "value")


def sessions(df: DataFrame, time: str, late: str, gap: str, by: list[str]) -> DataFrame:
    """Sessions that end after a gap without rows."""
    return df.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def run_once(df: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Work through all that is there now and return what came out; the checkpoint lies in the shared folder."""
    spark = df.sparkSession
    out, state = new_path(spark, name), new_path(spark, f"{name}-state")
    q = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def upsert_each(df: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame], folder: str, name: str = "upsert") -> DataFrame:
    """Merge every micro-batch into a versioned table: ``merge(prior or None, batch)`` gives the next snapshot.  A batch that is replayed overwrites its own version, so it counts once."""
    spark = df.sparkSession

    def one(batch: DataFrame, epoch: int) -> None:
        prior = spark.read.parquet(f"{folder}/epoch={epoch - 1}") if epoch else None
        merge(prior, batch).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")
        one.last = epoch

    q = df.writeStream.foreachBatch(one).option("checkpointLocation", new_path(spark, f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/epoch={one.last}")
