"""File names as people and addresses write them, resolved against those of a collection by keys that must be equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T

SUFFIX = ".pdf"
#: The tiers of ``resolved``, best first, as the kind of key that a wanted name is looked up by.
NAME, NORMAL, BARE = "name", "normal", "bare"


def decoded(name: Column) -> Column:
    """Percent-decoded and stripped; a name that is not well encoded stays as it is, and so does '+'."""
    return T.stripped(F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name))


def hyphened(name: Column) -> Column:
    """En and em dashes as hyphens."""
    return F.translate(name, "–—", "--")


def normal(name: Column) -> Column:
    """Lower case, every dash a hyphen, white space single, no suffix."""
    low = F.lower(T.stripped(T.replaced(F.translate(name, "–—−", "---"), f"{T.WS}+", " ")))
    return T.replaced(low, "\\.pdf$", "")


def bare(name: Column) -> Column:
    """Of the normal form, only ASCII letters, digits and spaces."""
    return T.replaced(normal(name), "[^a-z0-9 ]", "")


def key(tier: int, kind: str, value: Column) -> Column:
    return F.struct(F.lit(tier).alias("tier"), F.lit(kind).alias("kind"), value.alias("key"))


def resolved(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """(wanted, name, tier) for each distinct ``wanted`` that a file of ``names`` (name) answers to.

    Tiers, of which the first that fits counts: 1 the name itself, 2 with hyphens for dashes, 3 and 4 the same with the suffix added,
    5 equal normal forms, 6 equal bare forms. Of several files in a tier, the first by name. Nulls and names whose key is
    blank (as the bare form of a name without ASCII letters) resolve to nothing by that key. Files are brought down to one a
    key before the join, so a row of ``wanted`` meets at most six.
    """
    w = F.col("wanted")
    said = decoded(w)
    flat = hyphened(said)
    asks = F.array(
        key(1, NAME, said), key(2, NAME, flat), key(3, NAME, F.concat(said, F.lit(SUFFIX))), key(4, NAME, F.concat(flat, F.lit(SUFFIX))),
        key(5, NORMAL, normal(said)), key(6, BARE, bare(said)),
    )
    n = F.col("name")
    has = F.array(key(0, NAME, n), key(0, NORMAL, normal(n)), key(0, BARE, bare(n)))
    files = names.select("name", F.inline(has)).filter("key <> ''").groupBy("kind", "key").agg(F.min("name").alias("name"))
    asked = wanted.select("wanted").distinct().filter(T.stripped(w) != "").select("wanted", F.inline(asks)).filter("key <> ''")
    best = asked.join(files, ["kind", "key"]).groupBy("wanted").agg(F.min(F.struct("tier", "name")).alias("b"))
    return best.select("wanted", "b.name", "b.tier")


def existing(rows: DataFrame, names: DataFrame, column: str = "doc_name") -> DataFrame:
    """The rows whose document is still among the files ``names`` (name), with or without its suffix. Null and blank documents are not."""
    n = F.col("name")
    known = F.when(F.endswith(n, F.lit(SUFFIX)), F.array(n, F.left(n, F.length(n) - len(SUFFIX)))).otherwise(F.array(n))
    there = names.select(F.explode(known).alias(column)).filter(F.col(column) != "").distinct()
    return rows.join(there, column, "left_semi")
