"""Line dedup with levelled sorted runs of line hashes.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys of ``least`` code points
and more that two documents hold lose all their lines but those of the least document.

``LineRuns`` is the index: unique 128-bit key hashes with the first document that held them, in runs that are
bucketed and sorted by hash. A new batch is combined by key (before it is sent), merge-anti-joins every run
as the runs lie, bucket by bucket, and what is left is written as a run of its own. ``fanout`` runs of a level are
merged into one of the next (full outer merge joins, again bucket by bucket), so a batch meets a number of runs that grows
with the logarithm of the batches. Every run holds keys that no other has. A line of a batch goes unless its document
is the first one of its key: an anti join on key *and* document, so that lines of a very common key spread over all tasks.

Documents are indexed in batches of ascending ids, cut at approximate quantiles; earlier batches are earlier documents.
Texts are read twice: for their keys, and to take lines out. They are sent once, by document.
No Python runs on executors.

Defined results: null and empty texts are one empty line; a null id is never earlier than another and loses nothing; rows
of one id are one document; equal rows get equal results; an empty table gives no rows; a text of any length is one row's work.
Columns pass through; one named like a result is returned as ``<name>_given``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm._shared import apart, n_shards, new_shared_path, table

SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST = 10
BATCHES = 4
FANOUT = 3
#: Keys of one bucket, about.
BUCKET_ROWS = 1 << 22
KEY = ["__h1", "__h2"]


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for jobs that run inside; back to what they were afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased. ``lower`` does just that to pure ASCII and is much faster than ``translate``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_keys(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(hash, hash, doc_id, row digest, position) of each line whose key is long enough, of rows with an id."""
    given = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("__row"), F.posexplode(F.split(ascii_lower(F.col("text")), "\n")).alias("__pos", "__line"))
    keys = given.withColumn("__key", F.btrim("__line", F.lit(SPACES))).filter(F.char_length("__key") >= least)
    return keys.select(F.xxhash64("__key").alias(KEY[0]), F.xxhash64(F.lit("second"), "__key").alias(KEY[1]), "doc_id", "__row", "__pos")


class LineRuns:
    """The runs, by level. Each run is a bucketed, sorted table in the shared folder; replaced runs stay readable until the folder is cleared."""

    def __init__(self, spark: SparkSession, root: str, buckets: int, fanout: int = FANOUT):
        self.spark, self.root, self.buckets, self.fanout = spark, root, buckets, fanout
        self.levels: list[list[str]] = [[]]
        self.written = 0

    @property
    def state(self) -> list[dict]:
        """Enough for ``opened`` in another session, after the folder."""
        return [{"level": i, "run": r, "columns": [(f.name, f.dataType.simpleString()) for f in self.spark.table(r).schema]} for i, runs in enumerate(self.levels) for r in runs]

    @classmethod
    def opened(cls, spark: SparkSession, root: str, buckets: int, state: list[dict], fanout: int = FANOUT) -> LineRuns:
        """The index that another session left, from its folder, buckets and ``state``."""
        made = cls(spark, root, buckets, fanout)
        made.levels = [[] for _ in range(1 + max((s["level"] for s in state), default=0))]
        for s in state:
            path = f"{root}/{s['run']}"
            columns = ", ".join(f"`{name}` {kind}" for name, kind in s["columns"])
            spark.sql(f"create table if not exists `{s['run']}` ({columns}) using parquet clustered by ({', '.join(KEY)}) sorted by ({', '.join(KEY)}) into {buckets} buckets location '{path}'")
            made.levels[s["level"]].append(s["run"])
        made.written = 1 + max((int(s["run"].rpartition("_")[2]) for s in state), default=-1)
        return made

    def close(self) -> None:
        """Forget the tables' names; the files stay."""
        for i in range(self.written):
            self.spark.sql(f"drop table if exists `{self.name(i)}`")

    def name(self, i: int) -> str:
        return f"line_run_{self.root.rpartition('-')[2]}_{i}"

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(r) for level in self.levels for r in level]

    def write(self, run: DataFrame) -> str:
        name = self.name(self.written)
        run.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.root}/{name}").mode("overwrite").saveAsTable(name)
        self.written += 1
        return name

    def add(self, keys: DataFrame) -> DataFrame:
        """Index a batch. Returns its lines that go: their key is in a run, or another document of the batch is the first with it."""
        with settings(self.spark, {"spark.sql.shuffle.partitions": str(self.buckets), "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}):
            fresh = keys.groupBy(*KEY).agg(F.min("doc_id").alias("__first"))
            for run in self.runs():
                fresh = fresh.join(run.hint("merge"), KEY, "left_anti")
            name = self.write(fresh)
            self.levels[0].append(name)
            self.compact()
        first = self.spark.read.schema(fresh.schema).parquet(f"{self.root}/{name}").withColumnRenamed("__first", "doc_id")
        return keys.join(first.hint("merge"), [*KEY, "doc_id"], "left_anti")

    def compact(self) -> None:
        """Merge a level's runs into one of the next as soon as it has ``fanout``."""
        for i in range(len(self.levels)):
            while len(self.levels[i]) >= self.fanout:
                runs = [self.spark.table(r).withColumnRenamed("__first", f"__first_{k}") for k, r in enumerate(self.levels[i])]
                merged = reduce(lambda a, b: a.join(b.hint("merge"), KEY, "full"), runs)
                name = self.write(merged.select(*KEY, F.coalesce(*[f"__first_{k}" for k in range(len(runs))]).alias("__first")))
                self.levels[i] = []
                self.levels += [[]] * (i + 2 > len(self.levels))
                self.levels[i + 1].append(name)


def in_batches(docs: DataFrame, batches: int, least: int = LEAST) -> list[DataFrame]:
    """Line keys by ranges of ids, ascending, written once: a batch reads its own part only."""
    borders = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    cuts = sorted(set(borders or []))
    keys = line_keys(docs, least).withColumn("batch", reduce(lambda n, b: n + (F.col("doc_id") > b).cast("int"), cuts, F.lit(0)))
    path = new_shared_path(docs.sparkSession, "line-keys")
    keys.write.partitionBy("batch").parquet(path)
    back = docs.sparkSession.read.schema(keys.schema).parquet(path)
    return [back.filter(F.col("batch") == i).drop("batch") for i in range(len(cuts) + 1)]


def without_repeated_lines(docs: DataFrame, batches: int = BATCHES, least: int = LEAST) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text."""
    spark = docs.sparkSession
    docs = apart(docs, "n_lines", "n_dropped", "kept_text")
    parts = in_batches(docs, batches, least)
    most = max(p.count() for p in parts)
    index = LineRuns(spark, new_shared_path(spark, "line-runs"), max(n_shards(spark), -(-most // BUCKET_ROWS)))
    gone = reduce(DataFrame.unionByName, [index.add(p).select("doc_id", "__row", "__pos") for p in parts])
    index.close()
    gone = gone.groupBy(F.col("doc_id").alias("__id"), "__row").agg(F.collect_set("__pos").alias("__gone"))
    others = [c for c in docs.columns if c != "text"]
    cut = docs.select(*others, F.xxhash64("text").alias("__row_of"), F.split("text", "\n").alias("__lines"))
    met = cut.filter("doc_id is not null").join(gone.hint("merge"), (F.col("doc_id") == F.col("__id")) & (F.col("__row_of") == F.col("__row")), "left").drop("__id", "__row", "__row_of")
    loose = cut.filter("doc_id is null").drop("__row_of").withColumn("__gone", F.lit(None).cast("array<int>"))
    both = met.unionByName(loose)
    lines = F.coalesce("__lines", F.array(F.lit("")))
    n, dropped = F.size(lines), F.coalesce(F.size("__gone"), F.lit(0))
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("__gone"))
    kept = F.when(F.col("__gone").isNull(), F.array_join(lines, "\n")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("__lines"), i)), "\n"))
    text = [F.array_join("__lines", "\n").alias(c) if c == "text" else F.col(c) for c in docs.columns]
    return both.select(*text, n.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), kept.alias("kept_text"))


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of all ``documents``."""
    made = without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


#: DuckDB: lines by position, the least document of each long key, and what is left.
ORACLE_OP11 = """
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, i, ls[i] as line, trim(translate(ls[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as key from (select *, unnest(range(1, len(ls) + 1)) as i from d)),
f as (select key, min(doc_id) as first from l where length(key) >= 10 group by key),
m as (select l.*, coalesce(doc_id > first, false) as gone from l left join f using (key))
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from m group by doc_id"""
