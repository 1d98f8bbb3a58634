"""Vector code compression: product codes with codebooks that are exact to the last integer.

Vectors become integers, are cut into equal parts, and each part is coded by its nearest codebook entry.
Nearest entries are screened: one float32 matrix product gives every ||c||**2 - 2 x.c with an interval that surely holds the
exact value. With u = 2**-24, a product of d terms in any order of addition, over factors rounded to float32, is off by at most
g * ||x|| ||c||, g = (d + 2) u / (1 - (d + 2) u). Entries whose interval reaches below the least upper end are evaluated again
in int64; ties go to the lower index. So results equal those of exact arithmetic everywhere.

Codebooks are bounded (parts x entries x width of a part) and go out as one broadcast variable. A round is a pass over the integers, which are
written once: a task sends one row of sums for each part and entry that it met, Spark adds them up, and the sums of all come to the
driver, at most parts x entries rows. No task, and no row, grows with the input.

Defined results: rows without a vector, or with a null or non-finite component, go. The width is that of most vectors; zeros
fill the last part where it does not divide. A vector of another width, or with a component beyond ``limit`` (2**26 and more for up to
2,000 dimensions, so that squared distances fit a long), stays with null code and error and shapes no codebook; a label of such rows only
has a null label_error. Rows that repeat are rows of their own; ids that repeat, and null ids (last), are put in order by their
vectors; with fewer than 256 rows the codebooks have as many entries as there are rows. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm._shared import give_memory_back, persisted, table
from quillstone.llm._vectors import common_width, finite_rows, floors, matrix, usable

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Sums travel in pieces of so many components.
PIECE = 16
#: Components of candidates that are compared at a time, at most.
AT_ONCE = 1 << 23
#: Labels that may be broadcast; beyond, totals are joined by a shuffle.
BROADCAST_ROWS = 50_000


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry for each row; both arguments hold int64."""
    n, d = x.shape
    index, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    entry_size = np.einsum("ij,ij->i", book, book)
    entry_norm, book32 = np.sqrt(entry_size.astype(np.float64)), book.astype(np.float32).T
    g = (d + 2) * 2.0**-24 / (1 - (d + 2) * 2.0**-24)
    step = max(1, AT_ONCE // max(1, book.size))
    for at in range(0, n, step):
        rows = x[at : at + step]
        norm = np.sqrt(np.einsum("ij,ij->i", rows, rows).astype(np.float64))[:, None]
        score = entry_size - 2.0 * (rows.astype(np.float32) @ book32).astype(np.float64)
        slack = 2 * g * norm * entry_norm + 2.0**-48 * (entry_size + 2 * norm * entry_norm)  # the second term covers the float64 steps here
        row, column = np.nonzero(score - slack <= (score + slack).min(1, keepdims=True))
        off = rows[row] - book[column]
        exact = np.einsum("ij,ij->i", off, off)
        best = np.minimum.reduceat(exact, np.searchsorted(row, np.arange(len(rows))))
        hit = np.nonzero(exact == best[row])[0]
        index[at : at + step] = column[hit[np.unique(row[hit], return_index=True)[1]]]
        distance[at : at + step] = best
    return index, distance


def in_parts(x: np.ndarray, parts: int) -> np.ndarray:
    """(rows, parts, width of a part), filled up with zeros."""
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, width * parts - x.shape[1]))).reshape(len(x), parts, width)


def learned(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width of a part) from rows (vec_id, x): the vectors of the least ids to begin with, then means, floored."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    books = in_parts(np.array([r.x for r in first], np.int64).reshape(len(first), width), parts).transpose(1, 0, 2).copy()
    context, size = rows.sparkSession.sparkContext, books.shape[2]
    schema = "entry int, at int, n long, sums array<long>"
    for _ in range(rounds if len(first) else 0):
        sent = context.broadcast(books)

        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            give_memory_back()
            books = sent.value
            n, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for b in batches:
                x = in_parts(matrix(b.column(0), width), parts)
                for p in range(parts):
                    which, _ = nearest(np.ascontiguousarray(x[:, p]), books[p])
                    n[p] += np.bincount(which, minlength=books.shape[1])
                    np.add.at(sums[p], which, x[:, p])
            met = np.nonzero(n.ravel())[0]
            flat = sums.reshape(-1, size)
            for at in range(0, size, PIECE):
                out = [pa.array(met, pa.int32()), pa.array(np.full(len(met), at), pa.int32()), pa.array(n.ravel()[met]), pa.array(flat[met, at : at + PIECE].tolist(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(out, names=["entry", "at", "n", "sums"])

        added = rows.select("x").mapInArrow(task, schema).groupBy("entry", "at").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(min(PIECE, size))])
        for r in added.collect():
            part, entry = divmod(r.entry, books.shape[1])
            for i in range(min(PIECE, size - r.at)):
                books[part, entry, r.at + i] = r[f"s{i}"] // r.n
        sent.unpersist()
    return books


def coded(rows: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """rows with code and error instead of x; null where x is null."""
    sent, parts = rows.sparkSession.sparkContext.broadcast(books), len(books)
    others = [c for c in rows.columns if c != "x"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_memory_back()
        for b in batches:
            column = b.column(b.schema.get_field_index("x"))
            ok = column.is_valid().to_numpy(zero_copy_only=False)
            x = in_parts(matrix(column.drop_null(), width), parts)
            found = [nearest(np.ascontiguousarray(x[:, p]), sent.value[p]) for p in range(parts)] if len(x) else []
            digits = iter("".join(f"{i:02x}" for i in row) for row in zip(*[f[0].tolist() for f in found], strict=True))
            errors = iter(sum(f[1] for f in found).tolist() if found else [])
            made = [pa.array([next(digits) if v else None for v in ok], pa.string()), pa.array([next(errors) if v else None for v in ok], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in others] + made, names=[*others, "code", "error"])

    schema = rows.select(*others).schema.add("code", "string").add("error", "long")
    return rows.mapInArrow(task, schema)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """From (vec_id, embedding, label): (vec_id, label, code, error) written to the shared folder, and the codebooks.

    ``entries`` is 256 at most, for codes of two digits a part. ``scale`` is a power of two.
    """
    whole = persisted(finite_rows(rows).select("vec_id", "label", floors(scale).alias("x")), "integer-vectors")
    width = common_width(whole)
    limit = isqrt(((1 << 63) - 1) // max(1, -(-width // parts))) // 2 - 1
    ready = whole.withColumn("x", F.when(usable("x", width, limit), F.col("x")))
    books = learned(ready.filter("x is not null"), width, parts, entries, rounds)
    return persisted(coded(ready, books, width), "codes"), books


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all ``embeddings``. Errors are summed by label as one row a label; a broadcast is used only up to BROADCAST_ROWS of them."""
    codes, books = compressed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    key = F.coalesce(F.concat(F.lit("l"), F.col("label").cast("string")), F.lit("n"))
    keyed = codes.withColumn("__label", key)
    totals = persisted(keyed.groupBy("__label").agg(F.sum("error").alias("label_error")), "label-errors")
    totals = F.broadcast(totals) if totals.count() <= BROADCAST_ROWS else totals
    return keyed.join(totals, "__label").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(rounds: int = ROUNDS) -> str:
    """DuckDB: the same rounds in bigint arithmetic, components as rows."""
    sql = """
with e as (select vec_id, label, list_transform(embedding, lambda v: floor(v::double * 1024)::bigint) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
p as materialized (select vec_id, (i - 1) // (len(x) // 4) as part, (i - 1) % (len(x) // 4) as pos, x[i] as v from (select vec_id, x, unnest(range(1, len(x) + 1)) as i from e)),
k as (select vec_id, row_number() over (order by vec_id) - 1 as entry from e order by vec_id limit 256),
c0 as materialized (select part, entry, pos, v from p join k using (vec_id)),"""
    for r in range(rounds + 1):
        sql += f"""
a{r} as materialized (select vec_id, part, min(dist * 256 + entry) as best from (select vec_id, p.part, entry, sum((p.v - c.v) * (p.v - c.v))::bigint as dist from p join c{r} c on p.part = c.part and p.pos = c.pos group by vec_id, p.part, entry) group by vec_id, part),"""
        if r < rounds:
            sql += f"""
c{r + 1} as materialized (select part, entry, pos, coalesce(m.v, c.v) as v from c{r} c left join (select p.part, best % 256 as entry, pos, floor(sum(p.v)::double / count(*))::bigint as v from p join a{r} a on a.vec_id = p.vec_id and a.part = p.part group by p.part, best % 256, pos) m using (part, entry, pos)),"""
    return sql + f"""
s as (select vec_id, string_agg(printf('%02x', best % 256), '' order by part) as code, sum(best // 256)::bigint as error from a{rounds} group by vec_id)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, (select sha256(string_agg(v::varchar, ',' order by part, entry, pos)) from c{rounds}) as codebooks_sha256 from s join e using (vec_id)"""


ORACLE_OP12 = oracle()
