"""A corpus pipeline: language ID, near-dedup, substring dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All
but the last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import bpe, langid, mixing, neardup, substrings
from quillstone.llm._shared import clear_scratch, persisted, scratch_mark, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A prediction this sure that contradicts the declared language rejects a document.
SURE = 0.9


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter, and texts that are surely not in the language they declare, if the model has learned that one.

    Null and empty texts have no letter and go. A null ``lang`` declares nothing and is kept; where
    no row has a ``lang``, nothing is learned and every text with a letter is kept. Rows that
    repeat are judged each; null ids are kept like others.
    """
    model = langid.fit(docs)
    if not model.langs:
        return docs.filter(F.rlike("text", F.lit("\\p{L}")))
    judged = langid.predict(docs, model, keep=tuple(docs.columns))
    agrees = F.col("lang").isNull() | ~F.col("lang").isin(model.langs) | (F.col("lang_pred") == F.col("lang")) | (F.col("score") < SURE)
    found = (F.col("lang_pred") != langid.UND) & agrees
    return judged.filter(found).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: five-word shingles, similarity 0.8 or more.

    The one with the least id stays. Rows equal in id and text count once; unlike texts of one id, and
    texts without an id, are documents of their own; texts without words link with nothing.
    """
    return neardup.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages of 13 words or more that a document with a smaller id holds.

    Untouched texts stay as they are, others keep their line breaks; a text that loses all its
    words goes. Null and wordless texts and rows without an id lose nothing and stay.
    """
    made = substrings.remove_repeated(docs, as_written=True)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    left = made.filter("n_removed = 0 or n_removed < n_words")
    return left.select(*[(text if c == "text" else F.length(text).cast("long") if c == "n_chars" else F.col(c)).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emit each document as often as the mix takes it, up to three times.

    A null source is a source, the last one; rows that repeat are rows of their own; of a source without
    words nothing is taken.
    """
    mixed = mixing.mix(docs).filter("copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the text decoded from them; null and empty texts have no ids."""
    return bpe.transcode(docs, bpe.vocabulary(), keep=("doc_id", "source", "lang"), want=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


def shielded(stage):
    """Extra columns go through a stage under names that cannot clash with the ones it makes, and come back as they were."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        safe = {c: c if c in COLUMNS else f"__extra_{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.toDF(*safe.values()), sf_dir)
        back = {v: k for k, v in safe.items()}
        return out.toDF(*[back.get(c, c) for c in out.columns])

    return run_stage


STAGES = [(f.__name__, shielded(f)) for f in (language, near_duplicates, repeated_passages, mixture, tokens)]

#: The learned language model and the vocabulary are beyond SQL; tests compare with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again. What a stage wrote for itself goes once its result is written."""
    docs, begin = table(spark, sf_dir, "documents"), scratch_mark()
    for name, stage in STAGES[:-1]:
        docs = persisted(stage(spark, docs, sf_dir), f"stage-{name}")
        clear_scratch(spark, begin)
    return STAGES[-1][1](spark, docs, sf_dir)
