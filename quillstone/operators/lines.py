"""Line operators: repeated headers and footers, joined lines, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.functions import text as T


def page_lines(units: DataFrame, text: str = "text") -> DataFrame:
    """One row per non-empty line: doc_name, page, line_no, line."""
    return units.select("doc_name", "page", F.posexplode(T.line_list(F.col(text))).alias("line_no", "line"))


def repeated_lines(units: DataFrame, marks: list[str], depth: int = 2, share: float = 0.6, least: int = 2, least_pages: int = 3) -> DataFrame:
    """(doc_name, norm, n): normalised first and last lines that recur on enough pages of a document."""
    per_page = units.select("doc_name", "page", T.line_list(F.col("text")).alias("ls")).filter(F.size("ls") > 0)
    edges = per_page.select("doc_name", "page", F.explode(F.array_distinct(F.transform(F.filter(F.concat(F.slice("ls", 1, depth), F.slice(F.reverse("ls"), 1, depth)), lambda x: T.is_header_candidate(x, marks)), T.normal_line))).alias("norm"))
    pages = per_page.groupBy("doc_name").agg(F.count(F.lit(1)).alias("pages"))
    counted = edges.groupBy("doc_name", "norm").agg(F.count(F.lit(1)).alias("n")).join(pages, "doc_name")
    return counted.filter((F.col("pages") >= least_pages) & (F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("pages") * share)))).select("doc_name", "norm", "n")


def without_repeated(units: DataFrame, repeated: DataFrame, share: float = 0.25, least: int = 3, text: str = "text") -> DataFrame:
    """units with n_lines and kept_lines: repeated lines and page numbers go, unless too little of the page would be left.

    Each document's repeated lines are one short list, joined to its pages; lines are never exploded.
    """
    lists = repeated.groupBy("doc_name").agg(F.collect_set("norm").alias("__norms"))
    joined = units.join(lists, "doc_name", "left").withColumn("__lines", T.line_list(F.col(text)))
    gone = lambda x: F.rlike(F.lower(x), F.lit(T.PAGE_NUMBER)) | F.coalesce(F.array_contains("__norms", T.normal_line(x)), F.lit(False))
    cut = joined.withColumn("__left", F.filter("__lines", lambda x: ~gone(x)))
    enough = F.size("__left") >= F.greatest(F.lit(least), F.floor(F.size("__lines") * share))
    return cut.select(*units.columns, F.size("__lines").cast("long").alias("n_lines"), F.when(enough, F.col("__left")).otherwise(F.col("__lines")).alias("kept_lines"))


def joined_lines(lines: DataFrame, key: str) -> DataFrame:
    """(key, seg, content): bullets and table rows stand alone, other lines merge, a trailing hyphen joins, a colon ends a paragraph."""
    by = W.partitionBy(key).orderBy("line_no")
    single = F.rlike("line", F.lit(T.BULLET)) | T.looks_like_row(F.col("line"))
    shaped = lines.withColumn("single", single).withColumn("line", F.when(T.looks_like_row(F.col("line")) & ~F.rlike("line", F.lit(T.BULLET)), T.normal_row(F.col("line"))).otherwise(F.col("line")))
    before = F.lag("line").over(by)
    breaks = F.col("single") | F.coalesce(F.lag("single").over(by), F.lit(True)) | F.endswith(before, F.lit(":"))
    cut = shaped.withColumns({"hyphen": F.coalesce(F.endswith(before, F.lit("-")) & ~F.lag("single").over(by), F.lit(False)), "brk": breaks})
    seg = cut.withColumn("seg", F.sum((F.col("brk") & ~(F.col("hyphen") & ~F.col("single"))).cast("long")).over(by))
    parts = seg.groupBy(key, "seg").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    glued = F.replace(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("-\n"), F.lit(""))
    return parts.select(key, "seg", F.replace(glued, F.lit("\n"), F.lit(" ")).alias("content"))
