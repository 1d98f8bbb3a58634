"""Tables bucketed and sorted by an id, with what is needed to open them again: joins on the id then need no exchange of them."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from quillstone.sources import hadoop


def _name(path: str) -> str:
    return f"bucketed_{hashlib.md5(path.encode()).hexdigest()}"


def write(df: DataFrame, path: str, buckets: int, key: str = "chunk_id") -> DataFrame:
    """Write df as one sorted file a bucket, and open it."""
    spark = df.sparkSession
    spark.sql(f"drop table if exists `{_name(path)}`")
    dealt = df.repartition(buckets, key).sortWithinPartitions(key)
    dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(_name(path))
    hadoop.delete(spark, f"{path}.layout.json")
    hadoop.create_new(spark, f"{path}.layout.json", json.dumps({"buckets": buckets, "key": key, "columns": [(f.name, f.dataType.simpleString()) for f in df.schema]}))
    return spark.table(_name(path))


def opened(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as another session wrote it; None if it is not there as a whole."""
    try:
        layout = json.loads(hadoop.read_text(spark, f"{path}.layout.json") or "")
    except ValueError:
        return None
    columns = ", ".join(f"`{name}` {kind}" for name, kind in layout["columns"])
    spark.sql(f"create table if not exists `{_name(path)}` ({columns}) using parquet clustered by (`{layout['key']}`) sorted by (`{layout['key']}`) into {layout['buckets']} buckets location '{path}'")
    return spark.table(_name(path))
