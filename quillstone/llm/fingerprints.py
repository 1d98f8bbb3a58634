"""Document fingerprints: bottom-k sketches of word-shingle hashes, as DataFrame expressions.

A sketch is the k least distinct 64-bit hashes of a text's shingles of ``width`` words,
in ascending order, and the size of the set if it is at most k. Sketches merge (the k
least of both), so a sketch of a text is the merge of the sketches of its parts, if the
parts overlap by width - 1 words; they estimate distinct shingles, resemblance and
containment. No Python runs on executors.

Defined results: null counts as empty; a text without words has an empty sketch; one with
fewer words than ``width`` has its whole word sequence as the one shingle; two empty
sketches are alike by 1, an empty and a filled one by 0. Where an id repeats, its rows are rows of their own, and the
text of least MD5 stands for the id as its neighbour's next; null ids come last in the order; a table of one id has itself as next.
Extra columns are ignored; an empty table gives no rows; a text of any length is one row's work, in memory of some times its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.llm._shared import persisted, table

K = 128
WIDTH = 5
RANGES = 256
#: Stands for a null id, which comes last in the order.
NULL_KEY = -(1 << 63)
SPACES = "[ \\t\\n\\x0B\\f\\r]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """Add the sketch of a text column. Words are hashed once, then runs of word hashes."""
    hashed = df.withColumn("__w", F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)))
    w, n = F.col("__w"), F.size("__w")
    runs = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + j) for j in range(width)]))
    whole = F.array(F.xxhash64(w))
    made = hashed.withColumn("__s", F.when(n >= width, runs).when(n > 0, whole).otherwise(F.array().cast("array<bigint>")))
    return made.withColumn(out, F.slice(F.sort_array(F.array_distinct("__s")), 1, k)).drop("__w", "__s")


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Exact below k, else (k - 1) over the share of the hash range below the last value."""
    share = (F.element_at(sketch, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Jaccard estimate: the share of the union's sketch that both have."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def shown(sketch: Column) -> Column:
    """A sketch as text: hexadecimal values joined by dots."""
    return F.array_join(F.transform(sketch, lambda v: F.hex(v)), ".")


def next_in_order(ids: DataFrame, key: str) -> DataFrame:
    """(key, next): for each distinct key the one below it, the largest for the smallest.

    Keys are cut into RANGES ranges at approximate quantiles (a list of RANGES numbers on
    the driver); each range is ordered by itself, and the ranges' ends are joined up over
    one row per range.
    """
    keys = ids.select(key).distinct()
    marks = keys.agg(F.percentile_approx(key, [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0]
    cuts = sorted(set(marks or []))
    within = F.lit(0)
    if cuts:
        known = F.array(*[F.lit(c).cast("long") for c in cuts])
        within = F.size(F.filter(known, lambda c: c < F.col(key)))
    ranged = persisted(keys.withColumn("part", within), "ordered-ids")
    ends = ranged.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    around = ends.select("part", F.coalesce(F.lag("high").over(W.orderBy("part")), F.max("high").over(W.partitionBy())).alias("beyond"))
    inner = ranged.withColumn("next", F.lag(key).over(W.partitionBy("part").orderBy(key)))
    return inner.join(F.broadcast(around), "part").select(key, F.coalesce("next", "beyond").alias("next"))


def edited_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text, prefix (of the next text, as long as an edit may need), sketch and next_sketch.

    Only ids are put in order. Texts are sent once, by id, to meet their neighbours' ids
    and lengths (both sides of the last join read that one exchange); each then sends the
    prefix that the document above it needs, and its sketch.
    """
    keyed = docs.select(F.coalesce("doc_id", F.lit(NULL_KEY)).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    lengths = persisted(keyed.groupBy("k").agg(F.max(F.length("text")).alias("most"), F.count(F.lit(1)).alias("n")), "lengths")
    repeats = not lengths.filter("n > 1").isEmpty()
    order = persisted(next_in_order(lengths, "k").join(lengths, "k").select(F.col("next").alias("k"), F.col("k").alias("above"), "most"), "order")
    met = keyed.join(order.hint("merge"), "k")
    prefix = F.substring("text", F.lit(1), F.floor(F.col("most") / 3).cast("int"))
    sent = with_sketch(met, "text", "next_sketch").select(F.col("above").alias("k"), prefix.alias("prefix"), "next_sketch", *([F.md5("text").alias("m")] if repeats else []))
    if repeats:  # ids that repeat: the least text stands for the id
        sent = sent.groupBy("k").agg(F.min(F.struct("m", "prefix", "next_sketch")).alias("x")).select("k", "x.prefix", "x.next_sketch")
    own = with_sketch(keyed, "text", "sketch") if repeats else with_sketch(met.select("k", "text"), "text", "sketch")
    return own.join(sent.hint("merge"), "k").select(F.nullif("k", F.lit(NULL_KEY)).alias("doc_id"), "text", "sketch", "prefix", "next_sketch")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint ``documents``, their edited texts and compare neighbours."""
    docs = table(spark, sf_dir, "documents")
    both = edited_documents(docs)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    made = both.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("prefix", F.lit(1), cut)))
    made = with_sketch(made, "edited", "edited_sketch")
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        shown(F.col("sketch")).alias("fingerprint"),
        shown(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
