"""MinHash near-duplicate groups from bottom-k sketches of one hash function.

1. One pass makes each text's set of word shingles, its size, a 128-bit digest of the
   set and its bottom-k sketch. Equal sets become one class with the least id.
2. Sketch values that two or more classes share form inverted lists. A pair with
   Jaccard t or more shares at least ``floor`` of its k retained values, so a class is
   listed only under its ``size - floor + 1`` rarest values, values that nobody shares
   counting first. Most classes vanish here.
3. Each class is compared with the class that heads most of its lists, and with the
   others in its block of about BLOCK followers: first the sketches, with the estimate of the
   union sketch as a filter, then the full sets of those that pass, exactly. That is linear in
   the size of a group and joins nearly all copies of one text.
4. What is left are classes of different components that share a list. The classes that
   lists connect are compared as one group where that sends fewer rows than comparing each list by
   itself, so a long chain of lists costs what its lists cost, not the square of its length. Again sketches come first, and full sets only within the finer groups that
   pass. The largest component's blocks never meet one another.
5. Comparisons are matrix products over a block pair. Only a forest of the links leaves a
   task; components follow from the forests.

Pairs are never rows. No cap is set on lists, groups or partners. A link is lost only if a sketch misleads: for k=64
and floor=28, a pair at exactly 0.8 has less than 28 of 64 shared values with a chance
below 2e-9 (Chernoff), less for likelier pairs; sets of up to k shingles are exact.

Defined results: texts without words have an empty set and link with nothing; a null id
has a null component and is kept; rows that repeat an id and text share a class, and an
id with several texts belongs to the components of them all (the least one is given).
Extra columns are ignored by ``near_duplicates`` and kept by ``deduplicate``. An empty table
gives no rows. A text of any length is read whole; its set is held by the tasks that compare it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.llm._kernels import U, Words, mix, range_hashes, unique_pairs
from quillstone.llm._shared import blocks, n_shards, persisted, table
from quillstone.llm.graph import components
from quillstone.operators.maintenance import with_next_ids

K = 64
FLOOR = 28
BLOCK = 256
BROADCAST_ROWS = 500_000
COLUMNS_AT_ONCE = 8192


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, ordered by text and hash."""
    w = Words(texts, lower=True)
    h = w.hashes()
    at, run = w.runs(width, h)
    short = np.flatnonzero((w.count > 0) & (w.count < width))
    doc = np.concatenate((w.doc[at], short))
    run = np.concatenate((run, range_hashes(h, w.low[short], w.low[short] + w.count[short]) if len(short) else np.zeros(0, U)))
    return unique_pairs(doc, run)


def sketches(docs: DataFrame, width: int, k: int = K) -> DataFrame:
    """doc_id, n_shingles, digest of the set (two longs) and its k least hashes."""

    def task(batches):
        for batch, texts in blocks(batches, "text"):
            doc, run = shingle_sets(texts, width)
            n = np.bincount(doc, minlength=len(texts))
            ends = np.cumsum(n)
            starts = ends - n
            total = np.zeros((2, len(run) + 1), U)
            for i, salt in enumerate((U(0x9AE16A3B2F90404F), U(0xC949C7DEFA3B1A6D))):
                np.cumsum(mix(run ^ salt), out=total[i, 1:])
            digest = (total[:, ends] - total[:, starts]).view(np.int64)
            taken = np.minimum(n, k)
            offsets = np.concatenate(([0], np.cumsum(taken)))
            pick = np.repeat(starts - offsets[:-1], taken) + np.arange(offsets[-1])
            values = pa.array(run[pick].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(digest[0]), pa.array(digest[1]), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)], ["doc_id", "n_shingles", "d1", "d2", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, n_shingles long, d1 long, d2 long, sketch array<long>")


def listed(classes: DataFrame, k: int, floor: int, share: float) -> DataFrame:
    """(node, value): each class under its rarest shared values."""
    index = classes.select("node", F.size("sketch").alias("held"), "n_shingles", F.explode("sketch").alias("value"))
    shared = persisted(index.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shared-values")
    rarest = W.partitionBy("node").orderBy("df", "value")
    least = F.least(F.lit(floor), F.ceil(F.lit(share) * F.col("n_shingles") - F.lit(1e-9)))
    ranked = index.join(shared, "value").withColumn("at", F.row_number().over(rarest) + F.col("held") - F.count(F.lit(1)).over(W.partitionBy("node")))
    return ranked.filter(F.col("at") <= F.col("held") - least + 1).select("node", "value")


def forest(ids: np.ndarray, linked: np.ndarray) -> tuple[list[int], list[int]]:
    """Links (id, least id of its connected part) of a symmetric matrix; ids ascend."""
    n, label = len(ids), np.arange(len(ids))
    for i in range(n):
        if label[i] == i:
            part, front = np.zeros(n, bool), np.zeros(n, bool)
            part[i] = front[i] = True
            while front.any():
                front = linked[front].any(0) & ~part
                part |= front
            label[part] = i
    out = np.flatnonzero(label != np.arange(n))
    return ids[out].tolist(), ids[label[out]].tolist()


def overlaps(values: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of slices of the incidence matrix."""
    n = len(values)
    flat = np.concatenate(values) if n else np.zeros(0, U)
    row = np.repeat(np.arange(n), [len(v) for v in values])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    use = count[column] > 1
    row, column = row[use], rank[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS_AT_ONCE):
        lo, hi = np.searchsorted(column, (start, start + COLUMNS_AT_ONCE))
        m = np.zeros((n, int(column[hi - 1]) - start + 1), np.float32)
        m[row[lo:hi], column[lo:hi] - start] = 1
        out += m @ m.T
    return out.astype(np.int64)


def estimated(values: list[np.ndarray], k: int) -> np.ndarray:
    """Jaccard by the union sketch: both sketches are complete up to the lower of their last values."""
    n, both = len(values), overlaps(values)
    last = np.array([v[-1] if len(v) >= k else np.iinfo(np.uint64).max for v in values], U)
    below = np.stack([np.searchsorted(v, last, "right") for v in values]) if n else np.zeros((0, 0), np.int64)
    upto = np.where(last[:, None] <= last[None, :], np.array([len(v) for v in values])[:, None], below)
    return both / np.maximum(1, upto + upto.T - both)


def star_blocks(lists: DataFrame) -> DataFrame:
    """(grp, own, lo, hi, node, comp): each class with the class that heads most of its lists, in blocks that all hold that head.

    A head with g followers makes about g / BLOCK blocks and g + g / BLOCK rows.
    """
    heads = persisted(lists.groupBy("value").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "heads")
    met = lists.join(heads, "value").filter("node <> head").groupBy("node", "head").agg(F.count(F.lit(1)).alias("n"))
    star = persisted(met.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("fewer"), "head")).alias("x")).select("node", "x.head"), "star")
    parts = persisted(star.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")), "parts")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    members = star.join(parts, "head").select(F.col("head").alias("grp"), own.alias("own"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), "node", F.col("node").alias("comp"))
    return members.unionByName(parts.select(F.col("head").alias("grp"), F.lit(-1).alias("own"), F.lit(0).alias("lo"), (F.col("parts") - 1).alias("hi"), F.col("head").alias("node"), F.col("head").alias("comp")))


def cross_blocks(state: DataFrame) -> DataFrame:
    """(grp, own, lo, hi, node, comp) for the groups of (grp, node, comp) that hold more than one component.

    Blocks of the largest component meet only blocks of the rest, so a group that one
    component fills almost wholly costs hardly more than its size.
    """
    sizes = persisted(state.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("n")), "component-sizes")
    split = sizes.groupBy("grp").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    rest = F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int")
    most = F.ceil(F.col("top.n") / BLOCK).cast("int")
    split = persisted(split.select("grp", F.col("top.comp").alias("main"), rest.alias("rest"), most.alias("most")), "split-groups")
    inside = F.col("comp") == F.col("main")
    own = F.when(inside, F.col("rest") + F.pmod(F.xxhash64("node"), F.col("most"))).otherwise(F.pmod(F.xxhash64("node"), F.col("rest"))).cast("int")
    hi = F.when(inside, F.col("rest") - 1).otherwise(F.col("rest") + F.col("most") - 1)
    return state.join(split, "grp").select("grp", own.alias("own"), F.lit(0).alias("lo"), hi.alias("hi"), "node", "comp")


def block_pairs(rows: DataFrame) -> DataFrame:
    """(grp, i, j, …): each row once for every pair of blocks (i, j) that its own block is in."""
    spread = rows.withColumn("other", F.explode(F.sequence("lo", "hi")))
    spread = spread.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *[c for c in rows.columns if c not in ("grp", "lo", "hi")])
    return spread.repartition(n_shards(rows.sparkSession), "grp", "i", "j")  # else all blocks of a group would share a task


def _opened(block: pa.Table, payload: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row numbers in the order of nodes, and the payloads in that order."""
    order = np.argsort(block.column("node").to_numpy(), kind="stable")
    column = block.column(payload).combine_chunks()
    flat, offsets = column.values.to_numpy().view(U), column.offsets.to_numpy()
    return order, [flat[offsets[r] : offsets[r + 1]] for r in order]


def compared(rows: DataFrame, payload: str, test, name: str, cross: bool = True) -> DataFrame:
    """Links (a, b) that ``test`` finds between components, block by block; ``cross``: only between the two blocks of a pair."""

    def task(block: pa.Table) -> pa.Table:
        order, sets = _opened(block, payload)
        comp, side = block.column("comp").to_numpy()[order], block.column("own").to_numpy()[order]
        found = test(sets) & (comp[:, None] != comp[None, :])
        if cross and (side != side[0]).any():
            found &= side[:, None] != side[None, :]
        a, b = forest(block.column("node").to_numpy()[order], found)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return persisted(block_pairs(rows).groupBy("grp", "i", "j").applyInArrow(task, "a long, b long"), name)


def promising(rows: DataFrame, test, name: str) -> DataFrame:
    """(grp, own, lo, hi, node, comp) of the rows whose sketch ``test`` finds like another one in their block. Rows of no block partner go."""

    def task(block: pa.Table) -> pa.Table:
        order, sets = _opened(block, "sketch")
        found = test(sets)
        np.fill_diagonal(found, False)
        kept = block.take(pa.array(order[found.any(1)]))
        n, j = kept.num_rows, kept.column("j")
        own = np.where(kept.column("own").to_numpy() < 0, -1, j.to_numpy()).astype(np.int32)
        other = np.where(own < 0, j.to_numpy(), -1).astype(np.int32)
        return pa.table({"grp": kept.column("grp"), "own": own, "lo": other, "hi": other, "node": kept.column("node"), "comp": kept.column("comp")}) if n else pa.table({k: pa.array([], t) for k, t in zip(("grp", "own", "lo", "hi", "node", "comp"), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)})

    return persisted(block_pairs(rows).groupBy("grp", "i", "j").applyInArrow(task, "grp long, own int, lo int, hi int, node long, comp long"), name)


def with_full_sets(rows: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Rows with the whole shingle set of each node's text. Rows are broadcast up to BROADCAST_ROWS of them, else joined by shuffle."""
    rows = persisted(rows, "set-rows")
    small = rows.count() <= BROADCAST_ROWS
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(F.broadcast(rows) if small else rows, "node")

    def task(batches):
        for batch, some in blocks(batches, "text"):
            doc, run = shingle_sets(some, width)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(some))))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(6)], pa.ListArray.from_arrays(pa.array(offsets), pa.array(run.view(np.int64)))], ["grp", "own", "lo", "hi", "node", "comp", "shingles"])

    return texts.select("grp", "own", "lo", "hi", "node", "comp", "text").mapInArrow(task, "grp long, own int, lo int, hi int, node long, comp long, shingles array<long>")


def in_components(groups: DataFrame, found: DataFrame) -> DataFrame:
    """(grp, node, comp) of (grp, node): the component found so far, else the node itself."""
    return persisted(groups.join(found, "node", "left").select("grp", "node", F.coalesce("component", "node").alias("comp")), "state")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = K, floor: int = FLOOR) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of docs."""

    def linked(values: list[np.ndarray]) -> np.ndarray:
        size = np.array([len(v) for v in values], np.int64)
        both = overlaps(values)
        return 100 * both >= percent * (size[:, None] + size[None, :] - both)

    def likely(values: list[np.ndarray]) -> np.ndarray:
        return estimated(values, k) >= floor / k

    made = persisted(sketches(docs, width, k), "sketches")
    filled = made.filter("n_shingles > 0 and doc_id is not null")
    keys = ["n_shingles", "d1", "d2"]
    classes = persisted(filled.groupBy(*keys).agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n"), F.first("sketch").alias("sketch")), "classes")
    lists = persisted(listed(classes, k, floor, percent / 100), "lists")
    stars = persisted(star_blocks(lists), "stars")
    own_sketch = classes.select("node", "sketch")
    alike = promising(stars.join(own_sketch, "node"), likely, "star-alike")
    near = compared(with_full_sets(alike, docs, width), "shingles", linked, "star-links", cross=False)
    first = components(near)

    state = in_components(list_groups(lists), first)
    sketched = cross_blocks(state).join(own_sketch, "node")
    maybe = compared(sketched, "sketch", likely, "likely")
    fine = components(maybe.unionByName(state.select(F.col("node").alias("a"), F.col("comp").alias("b")).filter("a <> b"))).withColumnRenamed("component", "grp")
    more = compared(with_full_sets(cross_blocks(in_components(fine, first)), docs, width), "shingles", linked, "links")

    found = components(near.unionByName(more)).select(F.col("node").alias("least"), F.col("component").alias("joined"))
    repeated = persisted(classes.filter("n > 1").select(*keys, F.col("node").alias("class")), "repeated")
    rows = made.select("doc_id", *keys).join(repeated, keys, "left").withColumn("least", F.coalesce("class", "doc_id"))
    rows = rows.join(found, "least", "left").withColumn("component_id", F.coalesce("joined", "least"))
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def list_links(lists: DataFrame) -> DataFrame:
    """(a, b): each class of a list and the list's least class; a class that leads all of its lists has none."""
    least = persisted(lists.groupBy("value").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "least-of-lists")
    return lists.join(least, "value").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()


def list_groups(lists: DataFrame) -> DataFrame:
    """(grp, node): groups within which classes share lists. What lists connect is one group where that sends fewer rows, else each of its lists is a group."""
    blocks_of = lambda n: F.col(n) * F.ceil(F.col(n) / BLOCK)
    chained = persisted(components(list_links(lists)).withColumnRenamed("component", "chain"), "chains")
    members = persisted(lists.join(chained, "node").select("chain", "value", "node"), "list-members")
    by_list = members.groupBy("chain", "value").agg(F.count(F.lit(1)).alias("m")).groupBy("chain").agg(F.sum(blocks_of("m")).alias("by_list"))
    whole = chained.groupBy("chain").agg(F.count(F.lit(1)).alias("n")).join(by_list, "chain").filter(blocks_of("n") <= F.col("by_list")).select("chain")
    together = chained.join(whole, "chain", "left_semi").select(F.col("chain").alias("grp"), "node")
    # values are hashes and chains are named by ids: a clash only joins two groups, which is compared too
    return together.unionByName(members.join(whole, "chain", "left_anti").select(F.col("value").alias("grp"), "node"))


def with_keys(docs: DataFrame) -> DataFrame:
    """Adds __key, one for each id and text: the id for the text of least digest, a number beyond all ids for its other texts and for texts without an id."""
    named = F.col("doc_id").isNotNull()
    marked = docs.withColumn("__digest", F.coalesce(F.md5("text"), F.lit("")))
    texts = persisted(marked.select("doc_id", "__digest").distinct(), "texts")
    first = texts.filter(named).groupBy("doc_id").agg(F.min("__digest").alias("__first"))
    other = texts.filter(named).join(first, "doc_id").filter("__digest <> __first").drop("__first").unionByName(texts.filter(~named))
    new = persisted(with_next_ids(other, texts.select(F.col("doc_id").alias("chunk_id")), ["doc_id", "__digest"]), "keys")
    new = new.select(F.col("doc_id").alias("__id"), F.col("__digest").alias("__of"), F.col("chunk_id").alias("__new"))
    both = marked.join(new, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__of")), "left")
    return persisted(both.select(*docs.columns, F.coalesce("__new", "doc_id").alias("__key")), "keyed")


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component: that of the least id. Unlike texts of one id, and texts without an id, are documents of their own; texts without words and id all stay."""
    if docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        kept = near_duplicates(docs, width, percent).filter("kept").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    keyed = with_keys(docs)
    made = near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text"), width, percent)
    kept = made.filter("kept").select(F.col("doc_id").alias("__key"), F.col("n_shingles").alias("__n")).distinct()
    rows = persisted(keyed.join(kept, "__key"), "kept-rows")
    free = F.col("doc_id").isNull() & (F.col("__n") == 0)
    return rows.filter(~free).dropDuplicates(["__key"]).unionByName(rows.filter(free)).select(*docs.columns)


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all ``documents`` on distinct 4-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)
