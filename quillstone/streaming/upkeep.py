"""Index upkeep with state: the manifest lives in the stream, a batch of changes adds one segment.

Arrivals are versions of files, each version's pages together. A processor keyed by file holds its last version, digest and
whether it is removed, and passes on what changed. Versions that arrive again or late change nothing. A removed file is
remembered for ``keep_removed`` (a timer), so that a late version does not bring it back; after that its state goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import ExitStack

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillstone.config import CONFIG, Config
from quillstone.functions.embed import Embedder, embedded, hashed_ngrams, retried
from quillstone.operators import maintenance
from quillstone.plans.ingest import ORDER, chunk_units
from quillstone.sources.scratch import brief
from quillstone.sources.segments import Generation, Store, lean, whole
from quillstone.streaming.indexer import ARRIVAL

CHANGES = "filename string, version long, status string, sha256 string, units array<struct<page:long,text:string>>"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEW, CHANGED, REMOVED = "new", "changed", "removed"


def digest(units: list[tuple[int | None, str | None]]) -> str:
    """Of a file's pages in order (null pages and texts first)."""
    ordered = sorted(units, key=lambda u: (u[0] is not None, u[0] or 0, u[1] is not None, u[1] or ""))
    return hashlib.sha256("\f".join(t or "" for _, t in ordered).encode()).hexdigest()


def step(known: tuple[int, str, bool] | None, version: int, removed: bool, sha256: str) -> str | None:
    """What a version of a file changes, after what is known of it: (version, digest, removed). None if nothing."""
    if known and version <= known[0]:
        return None
    there = known is not None and not known[2]
    if removed:
        return REMOVED if there else None
    return NEW if not there else CHANGED if sha256 != known[1] else None


def newest(rows: list[Row]) -> tuple[int, bool, list[tuple[int | None, str | None]]]:
    """(version, removed, units) of the highest version; repeated pages once. A version is removed if a row of it says so."""
    version = max(r.version for r in rows)
    mine = [r for r in rows if r.version == version]
    return version, any(r.removed for r in mine), list(dict.fromkeys((r.page, r.text) for r in mine))


class Manifest(StatefulProcessor):
    """State of one file: (version, sha256, removed)."""

    def __init__(self, keep_removed: int):
        self.keep_removed = keep_removed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "version long, sha256 string, removed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        version, removed, units = newest(list(rows))
        known = tuple(self.last.get()) if self.last.exists() else None
        sha256 = "" if removed else digest(units)
        status = step(known, version, removed, sha256)
        if known is None or version > known[0]:
            self.last.update((version, sha256, removed))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if removed:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.keep_removed)
        if status:
            yield Row(filename=key[0], version=version, status=status, sha256=sha256, units=[] if removed else units)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists() and self.last.get()[2]:
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def changes(arrivals: DataFrame, keep_removed: int = 30 * 86_400) -> DataFrame:
    """CHANGES of a stream of ARRIVAL rows. Rows without a file name or version tell nothing."""
    real = arrivals.filter("filename is not null and version is not null").withColumn("removed", F.coalesce("removed", F.lit(False)))
    return real.groupBy("filename").transformWithState(Manifest(keep_removed), CHANGES, "append", "processingTime")


def batch_changes(arrivals: DataFrame, files: DataFrame | None) -> DataFrame:
    """The same for a batch, against the manifest of a store (``Store.files(removed=True)``): one row per changed file."""
    real = arrivals.filter("filename is not null and version is not null").withColumn("removed", F.coalesce("removed", F.lit(False)))
    top = real.groupBy("filename").agg(F.max("version").alias("version"))
    mine = real.join(top, ["filename", "version"]).groupBy("filename", "version").agg(F.bool_or("removed").alias("removed"), F.sort_array(F.collect_set(F.struct(F.col("page").cast("long").alias("page"), "text"))).alias("units"))
    sha = F.when(F.col("removed"), F.lit("")).otherwise(F.sha2(F.array_join(F.transform("units", lambda u: F.coalesce(u["text"], F.lit(""))), "\f"), 256))
    empty = arrivals.sparkSession.createDataFrame([], "filename string, version long, sha256 string, removed boolean")
    known = (empty if files is None else files).select("filename", F.col("version").alias("__version"), F.col("sha256").alias("__sha"), F.col("removed").alias("__gone"))
    both = mine.withColumn("sha256", sha).join(known, "filename", "left").filter(F.col("__version").isNull() | (F.col("version") > F.col("__version")))
    there = F.col("__gone").isNotNull() & ~F.col("__gone")
    status = F.when(F.col("removed"), F.when(there, REMOVED)).when(~there, NEW).when(F.col("sha256") != F.col("__sha"), CHANGED)
    return both.select("filename", "version", status.alias("status"), "sha256", F.when(F.col("removed"), F.array().cast("array<struct<page:bigint,text:string>>")).otherwise(F.col("units")).alias("units")).filter("status is not null")


def publish(store: Store, changed: DataFrame, batch: int, embedder: Embedder = hashed_ngrams, config: Config = CONFIG) -> Generation:
    """Add CHANGES as one segment: chunks and vectors of new and changed files, ids that changed and removed ones retire, and their manifest lines.

    What is written grows with the batch; of the store's rows, names and ids are read to find what retires. Units are kept until they
    are chunks, and chunks until they are a segment. Units are dealt out by range of their names, so that chunks lie in the order of their ids.
    """
    tasks = int(changed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with ExitStack() as held:
        with brief(changed) as now:
            if batch in (there := store.current()).batches:
                return there
            lines = held.enter_context(brief(now.drop("units")))
            units = now.filter(F.col("status") != REMOVED).select(F.col("filename").alias("doc_name"), F.inline("units")).repartitionByRange(tasks, "doc_name", "page")
            made = held.enter_context(brief(maintenance.placed(lean(chunk_units(units, config)), ORDER)))

        def make(after: Generation) -> tuple[dict[str, DataFrame | None], int]:
            numbered = whole(maintenance.numbered_by_place(made, after.next_id))
            rows, retired = store.chunks(after), None
            if rows is not None:
                gone = lines.filter(F.col("status") != NEW).select(F.col("filename").alias("doc_name"))
                retired = rows.filter("active").select("chunk_id", "doc_name").join(gone, "doc_name", "left_semi").select("chunk_id", F.lit(batch).cast("long").alias("deactivated_at"))
            vectors = numbered.select("chunk_id", embedded(F.col("embed_text"), retried(embedder, config.embed_tries, config.embed_wait), config.embed_chars).alias("embedding"))
            files = lines.select("filename", "version", "sha256", (F.col("status") == REMOVED).alias("removed"), F.lit(after.number + 1).cast("long").alias("seq"))
            return {"chunks": numbered, "vectors": vectors, "retired": retired, "files": files}, after.next_id + made.count()

        return store.publish(batch, make)


def prepare(spark: SparkSession) -> None:
    """Settings of a session whose stream has the manifest as state: timers need this store, and with timers on the clock, batches without data would follow one another for ever when a stream takes what is there and stops."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def run(spark: SparkSession, folder: str, store: Store, checkpoint: str, once: bool = True, keep_removed: int = 30 * 86_400):
    """Follow a folder of JSON arrivals; ``once`` takes what is there and stops. A batch that is repeated after a failure is in the store already and adds nothing."""
    prepare(spark)

    def add(df: DataFrame, i: int) -> None:
        publish(store, df, i)
        store.compact()

    writer = changes(spark.readStream.schema(ARRIVAL).json(folder), keep_removed).writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime="30 seconds").start()
