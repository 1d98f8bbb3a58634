"""Index maintenance: change detection, soft deletes, ids, versions, retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.config import CONFIG, Config
from quillstone.functions import text as T
from quillstone.operators.references import DATA_PATH


def manifest_diff(scanned: DataFrame, manifest: DataFrame, key: str = "filename", digest: str = "sha256") -> DataFrame:
    """(key, status): new, changed, unchanged or removed. The content digest decides; times are only recorded."""
    a = scanned.select(F.col(key), F.col(digest).alias("now"), F.lit(True).alias("here"))
    b = manifest.select(F.col(key), F.col(digest).alias("then"), F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "removed").when(F.col("now").eqNullSafe(F.col("then")), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, status.alias("status"))


def soft_deleted(rows: DataFrame, gone: DataFrame, key: str, at: Column) -> DataFrame:
    """Rows of the documents in ``gone`` become inactive; nothing is dropped."""
    hit = rows.join(gone.select(key).distinct().withColumn("__gone", F.lit(True)), key, "left")
    off = F.coalesce("__gone", F.lit(False)) & F.col("active")
    return hit.withColumn("deactivated_at", F.when(off, at).otherwise(F.col("deactivated_at"))).withColumn("active", F.col("active") & ~off).drop("__gone")


def purged(vectors: DataFrame, inactive: DataFrame, key: str = "chunk_id") -> DataFrame:
    return vectors.join(inactive.select(key), key, "left_anti")


RANGES = 64
SAMPLE = 100 * RANGES


def with_range(rows: DataFrame, order: list[str], out: str = "__range") -> DataFrame:
    """Adds the number of the range of ``order`` that a row lies in; ranges follow one another in that order (nulls first).

    Their borders are RANGES - 1 of a bounded sample of distinct keys (one of each of SAMPLE hash buckets, so that copies
    count once), brought to the driver and written into the plan, so that every use of the result cuts alike. Where they
    lie decides about balance and never about results.
    """
    keys = rows.select(*order)
    hashed = keys.select(F.struct(*order).alias("k"), F.xxhash64(*order).alias("h"))
    some = hashed.groupBy(F.pmod("h", F.lit(SAMPLE)).alias("b")).agg(F.min_by("k", "h").alias("k")).select("k.*").orderBy(*order).collect()
    types = [f.dataType for f in keys.schema]
    cuts = sorted({len(some) * i // RANGES for i in range(1, RANGES)}) if some else []
    borders = [F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(some[i], types, order, strict=True)]) for i in cuts]
    key = F.struct(*order)
    number = F.size(F.filter(F.array(*borders), lambda b: b <= key)) if borders else F.lit(0)
    return rows.withColumn(out, number)


def running_sums(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds for each name the sum of its column over all rows before, in the given order. No task sees all rows: ranges are summed by themselves and joined up over one row per range."""
    cut = with_range(rows, order)
    for name, c in sums.items():
        cut = cut.withColumn(f"__of_{name}", c)
    inside = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    along = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    whole = cut.groupBy("__range").agg(*[F.sum(f"__of_{n}").alias(f"__of_{n}") for n in sums])
    begins = whole.select("__range", *[F.coalesce(F.sum(f"__of_{n}").over(along), F.lit(0)).alias(f"__begin_{n}") for n in sums])
    made = cut.select("*", *[F.coalesce(F.sum(f"__of_{n}").over(inside), F.lit(0)).alias(f"__in_{n}") for n in sums]).join(F.broadcast(begins), "__range")
    return made.select(*rows.columns, *[(F.col(f"__in_{n}") + F.col(f"__begin_{n}")).alias(n) for n in sums])


def numbered(new: DataFrame, first: int, order: list[str]) -> DataFrame:
    """New rows get consecutive ids from ``first``, in the given order (nulls first)."""
    return running_sums(new, order, {"__before": F.lit(1).cast("long")}).withColumn("chunk_id", F.lit(first).cast("long") + F.col("__before")).drop("__before")


#: Where a row lies: its partition in the upper bits, its number in that in the lower 33 (``monotonically_increasing_id``).
PLACE, IN_PARTITION = "__place", 33


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows that were dealt out by range of the first columns of ``order``, sorted and with their places. They have to be kept before ``numbered_by_place``: made anew, they may lie elsewhere."""
    return rows.sortWithinPartitions(*order).withColumn(PLACE, F.monotonically_increasing_id())


def numbered_by_place(rows: DataFrame, first: int) -> DataFrame:
    """Placed rows get consecutive ids from ``first``: those of ``numbered``, but no row moves, and one row per partition is joined to them."""
    part = F.shiftrightunsigned(PLACE, IN_PARTITION)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    along = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    begins = sizes.select("__part", F.coalesce(F.sum("__n").over(along), F.lit(0)).alias("__begin"))
    at = F.lit(first).cast("long") + F.col("__begin") + F.col(PLACE).bitwiseAND(F.lit((1 << IN_PARTITION) - 1))
    return rows.join(F.broadcast(begins), part == F.col("__part")).withColumn("chunk_id", at).drop(PLACE, "__part", "__begin")


def with_next_ids(new: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """New rows get consecutive ids after the largest one, in the given order (nulls first)."""
    return numbered(new, rows.agg(F.coalesce(F.max("chunk_id"), F.lit(0))).first()[0] + 1, order)


def stale(rows: DataFrame, versions: dict[str, int]) -> DataFrame:
    """One row: for each version column, whether an active row has another version."""
    return rows.filter("active").agg(*[F.coalesce(F.bool_or(~F.col(c).eqNullSafe(F.lit(v))), F.lit(False)).alias(f"stale_{c}") for c, v in versions.items()])


def header_texts(config: Config = CONFIG) -> dict[str, Column]:
    """embed_text and search_text of chunk rows (doc_name, doc_rank, source_type, loc_label, tags, text)."""
    doc, rank, kind, loc, tags, text = (F.col(c) for c in ("doc_name", "doc_rank", "source_type", "loc_label", "tags", "text"))
    return {"embed_text": T.full_embed_text(doc, rank, kind, loc, tags, text, config.identity), "search_text": T.full_search_text(doc, kind, loc, tags, text)}


def refreshed(rows: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Active rows (chunk_id, doc_name, loc_label, tags, text, ... versions and digests as stored) brought up to date.

    Rows that know their source's type and rank get the whole headers. Versions, texts, digests and the public path are made anew; ``refreshed`` tells whether a stored one differed
    (null differs). Other columns stay. Vectors come from ``embed_text``: see ``plans.ingest.reindexed``.
    """
    parts = [F.col(c) for c in ("doc_name", "loc_label", "tags", "text")]
    whole = {"source_type", "doc_rank"} <= set(rows.columns)
    texts = header_texts(config) if whole else {"embed_text": T.embed_text(*parts), "search_text": T.search_text(*parts)}
    made = {
        "embed_version": F.lit(config.embed_version),
        "search_version": F.lit(config.search_version),
        "embed_sha256": F.sha2(texts["embed_text"], 256),
        "search_sha256": F.sha2(texts["search_text"], 256),
        "public_path": F.concat(F.lit(DATA_PATH), T.url_quoted(F.col("doc_name"))),
    }
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(v) for c, v in made.items()])
    return rows.filter("active").withColumn("refreshed", ~same).withColumns(made | texts)


MANIFEST_VERSION = 2


def manifest(files: DataFrame, config: Config = CONFIG) -> DataFrame:
    """One row per scanned file (filename, path, ext, mtime, size, rank, sha256) with the version and settings of its build; missing figures are 0, missing digests blank."""
    build = F.struct(F.lit(config.embed_version).alias("embed_text_version"), F.lit(config.search_version).alias("search_text_version"), F.lit(config.chunk_max_chars).alias("chunk_max_chars"), F.lit(config.chunk_overlap_chars).alias("chunk_overlap_chars"))
    figures = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("mtime", "size", "rank")]
    blank = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("ext", "sha256")]
    return files.select("filename", "path", *figures, *blank, F.lit(MANIFEST_VERSION).alias("version"), build.alias("build"))


def scanned(found: DataFrame, known: DataFrame, config: Config = CONFIG) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifest, status, counts) of a scan: the rows to save, filename and status of each file, and one row with found, new_or_changed, unchanged and removed.

    An unchanged file keeps its old row as far as the manifest knows it; removed files have none. ``found`` as in ``manifest``; ``known`` is the manifest of the last scan.
    """
    status = manifest_diff(found, known)
    same = status.filter("status = 'unchanged'").select("filename")
    fresh = manifest(found, config)
    rows = known.join(same, "filename", "left_semi").unionByName(fresh.join(same, "filename", "left_anti"), allowMissingColumns=True)
    n = lambda *names: F.count_if(F.col("status").isin(*names)).alias
    counts = status.agg(n("new", "changed", "unchanged")("found"), n("new", "changed")("new_or_changed"), n("unchanged")("unchanged"), n("removed")("removed"))
    return rows, status, counts


def to_delete(builds: DataFrame, keep: int) -> DataFrame:
    """Builds beyond the newest ``keep`` that are not active."""
    r = builds.withColumn("rn", F.row_number().over(W.orderBy(F.desc("build_id"))))
    return r.filter((F.col("rn") > keep) & ~F.col("is_active")).select("build_id")


def is_valid(rows: DataFrame) -> bool:
    """A build is usable if an active row has text."""
    return not rows.filter(F.col("active") & (F.length(F.btrim("text")) > 0)).limit(1).isEmpty()
