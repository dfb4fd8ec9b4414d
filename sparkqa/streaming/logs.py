"""The append-only run log as a stream: daily indicators with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def daily_indicators(log: DataFrame, time: str = "ts", late: str | None = "1 day", value: str = "value", status: str = "status", failed: str = "FAILED") -> DataFrame:
    """Per day: requests, failed requests and the mean value; rows later than ``late`` behind the newest are dropped
    (None: as the log's own watermark says). The same on a batch, where the watermark does nothing."""
    day = F.window(time, "1 day")
    sums = (log.withWatermark(time, late) if late else log).groupBy(day).agg(F.count("*").alias("requests"), F.count_if(F.col(status) == failed).alias("failed"), F.avg(value).alias("mean_value"))
    return sums.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "requests", "failed", "mean_value")


def closed_days(log: DataFrame, row_id: str, time: str = "ts", late: str = "1 day", **columns) -> DataFrame:
    """``daily_indicators`` for append mode: each day once, when the watermark has passed its end. Rows at or behind the
    watermark are dropped one by one before they are counted (so ``dropped`` tells their number), and a row that the log
    repeats within ``late`` counts once."""
    return daily_indicators(log.withWatermark(time, late).dropDuplicatesWithinWatermark([row_id]), time, None, **columns)


def dropped(query: StreamingQuery) -> int:
    """Rows that the first stateful operator of a query has dropped as late, over the batches that Spark still reports
    (``spark.sql.streaming.numRecentProgressUpdates``)."""
    told = {p["batchId"]: p for p in query.recentProgress if p["stateOperators"]}
    return sum(p["stateOperators"][-1]["numRowsDroppedByWatermark"] for p in told.values())


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> int:
    """Appends what a stream gives for all that is there now to Parquet files; gives the number of late rows dropped."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return dropped(query)
