"""Daily totals as a stream: event time windows with a watermark, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def totals(events: DataFrame, late: str | None = "2 days") -> DataFrame:
    """Events and cents per day and type.

    An endless stream drops rows later than the watermark ``late``, and so may forget old days;
    without one (a bounded backfill, whose files come in any order) no row is dropped.
    """
    cents = F.floor(F.col("value") * 100 + 0.5).cast("bigint")
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    days = (timed.withWatermark("ts", late) if late else timed).groupBy(F.window("ts", "1 day").alias("w"), "event_type")
    return days.agg(F.count("*").alias("events"), F.sum(cents).alias("cents")).select(F.to_date("w.start").alias("day"), "event_type", "events", "cents")


def daily_totals(spark: SparkSession, source: str, scratch: str) -> DataFrame:
    """Read a Parquet table as a stream, available rows only, and return what each day came to.

    Each batch replaces its days (update mode into versioned rows), so the last version of a
    day and type is its total.
    """
    table = spark.read.parquet(source)
    folder, _, name = source.rstrip("/").rpartition("/")
    plain_file = table.inputFiles()[0].endswith(f"/{name}")
    place = f"{folder}/{_glob(name)}" if plain_file else source
    stream = spark.readStream.schema(table.schema).parquet(place)

    def keep(batch: DataFrame, version: int) -> None:
        batch.withColumn("version", F.lit(version)).write.mode("append").parquet(f"{scratch}/totals")

    query = totals(stream, None).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{scratch}/state").foreachBatch(keep).start()
    query.awaitTermination()
    rows = spark.read.schema("day date, event_type string, events long, cents long, version int").parquet(f"{scratch}/totals")
    return rows.groupBy("day", "event_type").agg(F.max_by("events", "version").alias("events"), F.max_by("cents", "version").alias("cents"))


def _glob(name: str) -> str:
    """A pattern that only the file itself meets: a stream's source may not be a plain file."""
    return f"[{name[0]}]{name[1:]}"
