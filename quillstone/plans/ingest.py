"""Ingest: files or units to a chunk table, all anew or only what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.config import CONFIG, Config
from quillstone.functions import text as T
from quillstone.functions.embed import Embedder, embedded, hashed_ngrams, retried
from quillstone.lexicon import HEADER_MARKS, KEEP_MARKS, TAGS
from quillstone.operators import chunking, lines, maintenance, spelling
from quillstone.sources import hadoop, readers
from quillstone.sources.scratch import kept
from quillstone.sources.snapshots import Builds


def with_stripped_text(units: DataFrame) -> DataFrame:
    """Units whose text has lost the headers and footers that repeat on a document's pages, and page numbers."""
    left = lines.without_repeated(units, lines.repeated_lines(units, HEADER_MARKS))
    return left.withColumn("text", F.array_join("kept_lines", "\n")).drop("kept_lines", "n_lines")


def stripped_units(spark: SparkSession, folder: str) -> DataFrame:
    """Units of a folder without repeated headers and footers. They are found in a first pass that takes the edges of pages only; texts are read once, in the second."""
    def numbered(units: DataFrame) -> DataFrame:
        place = F.concat_ws("|", "doc_name", F.col("seq").cast("string"))
        return units.withColumnRenamed("loc_page", "page").withColumn("chunk_id", place)

    repeated = lines.repeated_lines(numbered(readers.read_units(spark, folder, edges=True)).filter("loc_kind = 'page'"), HEADER_MARKS)
    left = lines.without_repeated(numbered(readers.read_units(spark, folder)), repeated)
    page = F.when(F.col("loc_kind") == "page", F.array_join("kept_lines", "\n")).otherwise(F.col("text"))
    return left.withColumn("text", page).drop("kept_lines", "n_lines", "chunk_id")


#: What a source may know of a unit besides doc_name, page and text, and what is taken where it does not.
KNOWN = {
    "kind": lambda: F.when(F.col("page").isNotNull(), F.lit("page")).otherwise("section"),
    "anchor": lambda: F.lit(None).cast("string"),
    "source_type": lambda: F.lower(F.regexp_extract("doc_name", r"\.([^.]*)$", 1)),
    "doc_rank": lambda: T.book_rank(F.col("doc_name")),
    "seq": lambda: F.col("page").cast("long"),
}
ORDER = ["doc_name", "seq", "page", "anchor", "slice_no", "text_sha256"]


def with_known(units: DataFrame) -> DataFrame:
    """Units as chunking wants them: doc_name, page, text and KNOWN, whatever the source left out or called by a reader's names."""
    for old, new in (("loc_page", "page"), ("loc_kind", "kind"), ("loc_anchor", "anchor")):
        units = units.withColumnRenamed(old, new) if new not in units.columns else units
    return units.select("doc_name", F.col("page").cast("long").alias("page"), "text", *[(F.coalesce(c, make()) if c in ("doc_rank", "source_type", "kind") else F.col(c) if c != "seq" else F.col(c).cast("long")).alias(c) if c in units.columns else make().alias(c) for c, make in KNOWN.items()])


def chunk_units(units: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Units (doc_name, page, text; kind, anchor, source_type, doc_rank, seq where the source knows them) to chunks with tags and digests; ids are left to the caller.

    A chunk keeps what its source knew, and is labelled by page or by anchor. Units never mix. Null and empty units give no chunk; equal units give equal chunks.
    """
    parts = chunking.chunked(F.col("text"), config.chunk_max_chars, config.chunk_overlap_chars, config.chunk_min_chars, KEEP_MARKS)
    cut = with_known(units).select("doc_name", "page", *KNOWN, F.posexplode(parts).alias("slice_no", "text"))
    good = cut.filter(~T.is_low_signal(F.col("text"), KEEP_MARKS))
    label = T.loc_label(F.col("kind"), F.col("page"), F.lit(None).cast("long"), F.col("anchor"))
    tagged = good.withColumns({"tags": T.tags(F.col("text"), TAGS), "loc_label": label, "text_sha256": F.sha2(T.normal_space(F.col("text")), 256)})
    made = tagged.withColumns(maintenance.header_texts(config))
    return made.withColumns({"embed_sha256": F.sha2("embed_text", 256), "search_sha256": F.sha2("search_text", 256), "preview": F.left("text", F.lit(config.preview_chars)), "embed_version": F.lit(config.embed_version), "search_version": F.lit(config.search_version), "active": F.lit(True), "deactivated_at": F.lit(None).cast("long")})


def ingest(units: DataFrame, files: DataFrame, rows: DataFrame | None, manifest: DataFrame | None, at: int, config: Config = CONFIG) -> tuple[DataFrame, DataFrame]:
    """(chunk table, file status). Unchanged documents keep their rows and ids; changed and removed ones are deactivated.

    Chunking is work for the processors, not the disks, so changed units are dealt over all tasks first, however
    few bytes they have; chunks are made once and kept while they are numbered.
    """
    spark = units.sparkSession
    if manifest is None:
        manifest = spark.createDataFrame([], "filename string, sha256 string")
    status = maintenance.manifest_diff(files, manifest)
    fresh = status.filter("status in ('new', 'changed')").select(F.col("filename").alias("doc_name"))
    changed = with_known(units.join(fresh, "doc_name", "left_semi"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = kept(chunk_units(changed.repartition(tasks, "doc_name", "page", "text"), config))
    if rows is None:
        return maintenance.with_next_ids(made, spark.createDataFrame([], "chunk_id long"), ORDER), status
    gone = status.filter("status in ('changed', 'removed')").select(F.col("filename").alias("doc_name"))
    known = maintenance.soft_deleted(rows, gone, "doc_name", F.lit(at).cast("long"))
    return known.unionByName(maintenance.with_next_ids(made, rows, ORDER), allowMissingColumns=True), status


def embedded_rows(rows: DataFrame, embedder: Embedder = hashed_ngrams, config: Config = CONFIG) -> tuple[DataFrame, DataFrame]:
    """(vectors, failed) of (chunk_id, embed_text): chunk_id with its embedding, and the chunk_ids of batches that failed for good, to be tried another time.

    Each batch is tried ``embed_tries`` times. Texts are embedded once; the result is kept while both halves are read.
    """
    patient = retried(embedder, config.embed_tries, config.embed_wait)
    made = kept(rows.select("chunk_id", embedded(F.col("embed_text"), patient, config.embed_chars, mark_failed=True).alias("embedding")))
    return made.filter("embedding is not null"), made.filter("embedding is null").select("chunk_id")


def reindexed(rows: DataFrame, embedder: Embedder = hashed_ngrams, config: Config = CONFIG) -> tuple[DataFrame, DataFrame]:
    """(chunk table, vectors) made anew from the active rows: versions, digests and paths as ``maintenance.refreshed`` sets them, one vector per row. Inactive rows stay in the table as they are."""
    fresh = maintenance.refreshed(rows, config)
    vectors = fresh.select("chunk_id", embedded(F.col("embed_text"), retried(embedder, config.embed_tries, config.embed_wait), config.embed_chars).alias("embedding"))
    return rows.filter("not active").unionByName(fresh.drop("refreshed"), allowMissingColumns=True), vectors


def vocabulary(builds: Builds, chunks: DataFrame) -> DataFrame:
    """(word, n) of the chunks that belong to the active build: counted once, kept beside the build's tables and read from then on. Without an active build it is counted each time."""
    counted = chunks.select(F.explode(T.words_of(F.lower("text"))).alias("word")).filter("length(word) >= 3").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return beside(builds, "vocabulary", counted)


def spelling_index(builds: Builds, words: DataFrame) -> DataFrame:
    """(key, word): the deletion keys of a vocabulary, kept beside the active build in the same way."""
    return beside(builds, "spelling", spelling.keyed(words, "word"))


def beside(builds: Builds, name: str, made: DataFrame) -> DataFrame:
    """A table of the active build, written if it is not there as a whole."""
    build = builds.active()
    if not build:
        return made
    if "_SUCCESS" not in hadoop.names(made.sparkSession, builds.path(build, name)):
        made.write.mode("overwrite").parquet(builds.path(build, name))
    return builds.read(made.sparkSession, name)
