"""Index upkeep as a stream: new file versions arrive, each batch publishes a build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.plans.ingest import ingest
from quillstone.sources.snapshots import Builds

ARRIVAL = "filename string, version long, page long, text string, removed boolean"


def latest(arrivals: DataFrame) -> DataFrame:
    """The rows of each file's highest version."""
    newest = arrivals.withColumn("top", F.max("version").over(W.partitionBy("filename")))
    return newest.filter("version = top").drop("top")


def publish_batch(builds: Builds, batch: DataFrame, batch_id: int) -> None:
    """Merge a batch into the active build. A repeated batch id writes the same build again."""
    spark = batch.sparkSession
    rows, known = builds.read(spark, "chunks"), builds.read(spark, "manifest")
    now = latest(batch)
    digest = now.groupBy("filename").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\f"), 256).alias("sha256"), F.bool_or("removed").alias("removed"))
    seen = digest.filter("not removed").select("filename", "sha256")
    if known is not None:
        seen = seen.unionByName(known.join(digest, "filename", "left_anti").select("filename", "sha256"))
    units = now.filter("not removed").select(F.col("filename").alias("doc_name"), "page", "text")
    table, _ = ingest(units, seen, rows, known, batch_id)
    builds.publish(spark, f"build_{batch_id:012d}", {"chunks": table, "manifest": seen})


def run(spark: SparkSession, folder: str, builds: Builds, checkpoint: str, once: bool = True):
    """Follow a folder of JSON arrivals; ``once`` takes what is there and stops."""
    arrivals = spark.readStream.schema(ARRIVAL).json(folder)
    writer = arrivals.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: publish_batch(builds, df, i))
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime="30 seconds").start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event-time window and type, for batch and stream alike; later rows than ``late`` are dropped by a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
