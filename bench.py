"""Headline queries, an ingest batch and a batch of questions at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``value`` is the sum over HEADLINE, as in every round. ``batches`` are the whole paths: documents to chunks and
vectors, and all benchmark questions to answers and references. ``naive`` are plain single-threaded Python loops
over the same tables (no Spark, no NumPy) as a point of comparison; the keyword loop is measured on every
tenth question and multiplied by ten.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

HEADLINE = ["vec_topk", "keyword_scan", "keyword_semantic_fusion", "doc_grouping", "context_budget", "page_window_expand", "clean_text", "block_segments", "tag_multi_label", "window_slices", "header_footer_repeated", "manifest_diff", "history_gate", "pricing_summary"]


def timed(work) -> float:
    start = time.time()
    work()
    return round(time.time() - start, 3)


def done(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def batches(spark, d: str) -> dict[str, float]:
    """Seconds of the whole ingest path and of the whole ask path."""
    from pyspark.sql import functions as F

    from quillstone.functions.embed import embedded
    from quillstone.plans.ask import ask
    from quillstone.plans.ingest import ingest, with_stripped_text
    from quillstone.plans.queries import asked, units

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    pages = units(spark, d).select("chunk_id", "doc_name", "page", "text")
    files = pages.groupBy(F.col("doc_name").alias("filename")).agg(F.sha2(F.max("text"), 256).alias("sha256"))

    def build() -> None:
        chunks, _ = ingest(with_stripped_text(pages), files, None, None, 0)
        chunks.write.parquet(f"{folder}/chunks")
        made = spark.read.parquet(f"{folder}/chunks").select("chunk_id", embedded(F.col("embed_text")).alias("embedding"))
        made.write.parquet(f"{folder}/vectors")

    def answer() -> None:
        answers, references = ask(asked(spark, d), spark.read.parquet(f"{folder}/chunks"), spark.read.parquet(f"{folder}/vectors"))
        done(answers)
        done(references)

    return {"ingest": timed(build), "ask": timed(answer)}


def naive(d: str) -> dict[str, float]:
    """Seconds of plain Python loops for the work of vec_topk, keyword_scan and tag_multi_label with digests."""
    import pyarrow.parquet as pq

    from quillstone.plans.queries import STOP, TAGS

    rows = {t: pq.read_table(f"{d}/{t}.parquet").to_pylist() for t in ("documents", "benchmark", "embeddings")}
    texts = [(r["text"] or "").lower() for r in rows["documents"]]

    def vectors() -> None:
        for q in rows["embeddings"][::50]:
            scored = ((-round(sum(a * b for a, b in zip(q["embedding"], e["embedding"], strict=True)), 6), e["vec_id"]) for e in rows["embeddings"] if e is not q)
            sorted(scored)[:30]

    def keywords() -> None:
        for q in rows["benchmark"][::10]:
            words = [w for w in re.sub(r"[^\w\s-]", "", q["text"].lower()).split() if w not in STOP and len(w) > 1]
            phrase = " ".join(words)
            sum(phrase in t or 2 * sum(w in t for w in words) >= len(words) for t in texts)

    def tags() -> None:
        marks = [(re.compile(rf"(?<!\w)(?:{p})(?!\w)"), name) for p, name in TAGS]
        for t in texts:
            {name for mark, name in marks if mark.search(t)}
            hashlib.sha256(t.encode()).hexdigest()

    return {"vec_topk": timed(vectors), "keyword_scan": round(10 * timed(keywords), 3), "tag_multi_label": timed(tags)}


def main() -> None:
    from pyspark.sql import SparkSession

    from quillstone.plans.catalog import QUERIES

    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    done(QUERIES["vec_topk"](spark, d))  # warm-up
    took = {name: timed(lambda name=name: done(QUERIES[name](spark, d))) for name in HEADLINE}
    paths = batches(spark, d)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "batches": paths, "naive": naive(d), "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
