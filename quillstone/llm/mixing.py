"""Mixing sources to target weights by systematic sampling.

Each document has expected copies, the same for all of a source here (its target over
its size). Within a source, documents are put in an order, expected copies are summed
along it, one random offset is added, and a document is emitted once for each integer
that its part of the sum crosses. Sums are integers (units of 2**-24), so they are the
same however Spark adds them.

The order is by size class, then by a salt from id and text, then by size. A (source, size
class, salt) group is the unit of distribution: sums of groups are added up in one row
per group, and only rows of one group meet in one task, so a source that holds a third
of all rows is spread over all tasks. Number of salts grows with the input.

Targets: sources in code-point order (null last) weigh 1, 2, 3 and so on, repeating;
they share the total; a target stops at ``cap`` times its source's size and the excess
is shared again by weight. With r = cap * size / weight in ascending order, that is one
water level, found by running sums over one row per source, which are added up range by range.

Defined results: null text has size 0; a source without words has target 0; rows that
repeat are rows of their own; a null id sorts first; extra columns pass through; an empty
table gives no rows. Ties in the order are broken by size, id and the text's digest; what is
equal in all of them is interchangeable. A text of any length is counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.llm._shared import WORD, persisted, table
from quillstone.operators.maintenance import running_sums

UNIT_BITS = 24
BROADCAST_ROWS = 50_000
KEYS = ("__source", "__class", "__salt")


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: str = "source") -> Column:
    """Never null, so that joins need no null-safe comparison."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def draw(text: Column, digits: int = 4) -> Column:
    """A number from 0 to 16**digits - 1 from the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def targets(sizes: DataFrame, cap: int = 3) -> DataFrame:
    """From (__source, source, source_size): target and weight of each source. Sources may be many: they are summed along their order range by range."""
    named = running_sums(sizes.withColumn("__null", F.col("source").isNull()), ["__null", "source"], {"__at": F.lit(1).cast("long")})
    t = named.withColumn("weight", F.col("__at") % 3 + 1).withColumn("__ratio", F.lit(cap) * F.col("source_size") / F.col("weight"))
    t = running_sums(t, ["__ratio", "__null", "source"], {"__before": cap * F.col("source_size"), "__lighter": F.col("weight")})
    words, weights = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0], t.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    t = t.withColumn("__level", (F.lit(words) - F.col("__before")).cast("double") / (F.lit(weights) - F.col("__lighter")))
    level = t.filter("__level <= __ratio").agg(F.max("__level")).first()[0]
    capped = (cap * F.col("source_size")).cast("double")
    target = capped if level is None else F.least(capped, F.lit(level) * F.col("weight"))
    return t.withColumn("target", target).drop("__null", "__at", "__ratio", "__before", "__lighter", "__level")


def systematic_copies(rows: DataFrame, units: str, group: tuple[str, ...], order: list[Column], offset: Column) -> DataFrame:
    """Add ``copies``. ``group[0]`` is the source; the other group columns lead the order inside it."""
    sums = rows.groupBy(*group).agg(F.sum(units).alias("__sum"))
    along = W.partitionBy(group[0]).orderBy(*group[1:]).rowsBetween(W.unboundedPreceding, -1)
    begins = sums.select(*group, F.coalesce(F.sum("__sum").over(along), F.lit(0)).alias("__begin"))
    within = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    joined = rows.join(begins, list(group)).withColumn("__upto", F.sum(units).over(within) + F.col("__begin") + offset)
    crossed = F.shiftright(F.col("__upto"), UNIT_BITS) - F.shiftright(F.col("__upto") - F.col(units), UNIT_BITS)
    return joined.withColumn("copies", crossed.cast("long")).drop("__upto", "__begin")


def mix(docs: DataFrame, cap: int = 3) -> DataFrame:
    """docs with size, source_size, target and copies."""
    sized = docs.withColumns({"size": word_count(), "__source": source_key(), "__digest": F.md5(F.coalesce("text", F.lit("")))})
    known = persisted(sized.groupBy("__source").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "source-sizes")
    n_sources, n_rows = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    salts = max(16, -(-n_rows // 1_000_000))
    goal = targets(known.drop("n"), cap).select("__source", "source_size", "target")
    goal = F.broadcast(goal) if n_sources <= BROADCAST_ROWS else goal
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sized.join(goal, "__source").withColumns(
        {
            "__class": F.floor(F.log2(F.col("size") + F.lit(1)) * 4).cast("int"),
            "__salt": F.pmod(draw(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("__digest"))), F.lit(salts)),
            "__units": F.round(copies * F.lit(1 << UNIT_BITS)).cast("long"),
        }
    )
    order = [F.col("size"), F.col("doc_id").asc_nulls_first(), F.col("__digest")]
    out = systematic_copies(rows, "__units", KEYS, order, draw(F.col("__source"), 6))
    return out.select(*docs.columns, "size", "source_size", "target", "copies")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: DuckDB: the same level, units and order, without the split into groups.
ORACLE_OP4 = r"""
with d as (select doc_id, source, coalesce(text, '') as text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from s),
r as (select *, 3 * source_size / weight as ratio from w),
l as (select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
  / sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following)::double as level from r),
t as (select source, source_size, least((3 * source_size)::double, coalesce(max(case when level <= ratio then level end) over () * weight, (3 * source_size)::double)) as target from l),
n as (select greatest(16, (count(*) + 999999) // 1000000) as salts from d),
u as (select d.*, t.source_size, t.target,
  case when t.source_size > 0 then round(t.target / t.source_size * 16777216)::bigint else 0 end as units,
  floor(log2(size + 1) * 4)::int as class,
  ('0x' || md5(coalesce(doc_id::varchar, '') || md5(text))[1:4])::bigint % n.salts as salt,
  ('0x' || md5(case when d.source is null then 'n' else 's' || d.source end)[1:6])::bigint as start
  from d join t on d.source is not distinct from t.source, n),
p as (select *, start + sum(units) over (partition by source order by class, salt, size, doc_id nulls first, md5(text) rows unbounded preceding) as upto from u)
select doc_id, size, source_size, target, ((upto // 16777216 - (upto - units) // 16777216) * size)::bigint as taken from p"""
