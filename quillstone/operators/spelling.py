"""Nearest known words by deletion neighbourhoods.

Two words within ``distance`` edits share a string that each becomes by ``distance`` deletions at most. So a vocabulary is
kept as rows (key, word), one for each deletion of a word, and a token meets only words that share a key: an equi-join on
hashes whose groups stay small whatever letter or length is common. Keys come from the first PREFIX letters: of an
alignment of two words within ``distance``, at most so many letters of either prefix stay without a partner in the other,
so the shared string exists there as well. Candidates are checked by their real distance.

Words and tokens are of the letters a to z; others have no neighbours. A word is not its own neighbour, and neighbours begin with the token's
letter. Ties go to the first by letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.sources.scratch import if_small

PREFIX = 10
LETTERS = "^[a-z]+$"


def deletions(word: Column, distance: int) -> Column:
    """Distinct strings that the prefix of a word becomes by up to ``distance`` deletions, itself included."""
    shorter = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.left(w, i - 1), F.substr(w, i + 1)))
    level = F.array(F.left(word, F.lit(PREFIX)))
    made = level
    for _ in range(distance):
        level = F.array_distinct(F.flatten(F.transform(level, shorter)))
        made = F.array_union(made, level)
    return made


def keyed(words: DataFrame, column: str, distance: int = 2) -> DataFrame:
    """(key, column): what is kept of a vocabulary."""
    real = words.select(column).filter(F.rlike(column, F.lit(LETTERS))).distinct()
    each = real.select(column, F.explode(deletions(F.col(column), distance)).alias("__s"))
    return each.select(F.xxhash64(F.left(column, F.lit(1)), "__s").alias("key"), column)


def neighbours(index: DataFrame, tokens: DataFrame, distance: int = 2, most: int = 3) -> DataFrame:
    """(tok, word, dist): the nearest words of (tok) in an index of (key, word) that was made with the same distance."""
    asked = keyed(tokens, "tok", distance)
    met = index.join(if_small(asked), "key").select("tok", "word").distinct().filter("tok <> word")
    near = met.withColumn("dist", F.levenshtein("tok", "word", distance)).filter("dist >= 0")
    first = F.row_number().over(W.partitionBy("tok").orderBy("dist", "word"))
    return near.withColumn("rn", first).filter(F.col("rn") <= most).drop("rn")
