"""Queries over a chunk store that three batches of arrivals were added to."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.plans.queries import query, read
from quillstone.sources.scratch import new_folder
from quillstone.sources.segments import Store
from quillstone.streaming import upkeep

#: A document is a file of one page. The second batch changes every fifth, removes every seventh, and sends every third again; the third brings an old version of every second.
EVENTS = """ev as (select 'd' || doc_id as filename, 1 as version, coalesce(text, '') as text, false as removed from documents union all
select 'd' || doc_id, 2, coalesce(text, '') || case when doc_id % 5 = 0 then ' and more of it' else '' end, doc_id % 7 = 0 from documents where doc_id % 3 = 0 or doc_id % 5 = 0 or doc_id % 7 = 0)"""


def store(spark, d) -> Store:
    made = Store(spark, new_folder(spark, "store"), fanout=2)
    docs = read(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("filename"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    i = F.col("doc_id")
    first = docs.select("filename", F.lit(1).cast("long").alias("version"), F.lit(1).cast("long").alias("page"), "text", F.lit(False).alias("removed"))
    changed = F.concat("text", F.when(i % 5 == 0, " and more of it").otherwise(""))
    second = docs.filter((i % 3 == 0) | (i % 5 == 0) | (i % 7 == 0)).select("filename", F.lit(2).cast("long").alias("version"), F.lit(1).cast("long").alias("page"), changed.alias("text"), (i % 7 == 0).alias("removed"))
    third = docs.filter(i % 2 == 0).select("filename", F.lit(1).cast("long").alias("version"), F.lit(1).cast("long").alias("page"), F.lit("an old version").alias("text"), F.lit(False).alias("removed"))
    for batch, arrivals in enumerate((first, second, third)):
        upkeep.publish(made, upkeep.batch_changes(arrivals, made.files(removed=True)), batch)
        made.compact()
        made.expire(keep=1)  # nobody else reads this store
    return made


@query(f"""with {EVENTS}, top as (select *, lag(sha256(text)) over (partition by filename order by version) as was from ev), last as (select * from top qualify row_number() over (partition by filename order by version desc) = 1)
select filename, case when version = 2 and sha256(text) = was then 1 else version end::bigint as version, sha256(text) as sha256 from last where not removed""")
def stored_files(spark, d):
    """The manifest of the store, put together from its segments: removed files are gone, unchanged ones keep their line."""
    return store(spark, d).files().select("filename", "version", "sha256")
