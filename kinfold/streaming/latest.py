"""Beyond the reference, which has no streams: file streams reduced to the latest row a key, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinfold.operators.relational import dedupe_latest


def windowed_totals(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum per window and key; rows later than the watermark are left out. For streams and tables alike."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), key, "n", "total")


def keep_latest(stream: DataFrame, path: str, keys: list[str], by: str, checkpoint: str) -> StreamingQuery:
    """Fold each batch into the table of latest rows: a new version of it, read by latest_version.

    A batch that is run again writes the same version, so restarts change nothing. The version before stays for
    readers that have it open; older ones go. A batch costs a rewrite of the table.
    """
    spark = stream.sparkSession

    def fold(batch: DataFrame, number: int) -> None:
        rows = batch if number == 0 else batch.unionByName(spark.read.parquet(f"{path}/v{number - 1}"))
        dedupe_latest(rows, keys, by).write.mode("overwrite").parquet(f"{path}/v{number}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{number - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The table of the highest version that was written to its end."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    whole = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return spark.read.parquet(f"{path}/v{max(whole)}") if whole else None
