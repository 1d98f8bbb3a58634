"""Substring dedup: remove passages that an earlier document already holds.

A window is ``width`` consecutive words of one document. A word goes if a window over it
also starts in a document with a smaller id.

Pass 1 counts windows in count-min sketches: ROWS rows of cells, counts stopping at 2.
A task sends, for each slice of the cells, the cells it met once and those it met more
often; slices are merged one at a time, and a bitmap of the cells that reached 2 is
written to the shared folder, where workers map it into memory. A window whose cells are
not all set occurs once: the sketch only overestimates, so no repeat is lost. Cells grow
with the input, four a window, up to ``most_cells`` a row: 2**33 by default, bitmaps of 2 GB
in all, mapped and not copied. Beyond about 10**10 windows more of them pass on to pass 2, up to
all; results stay the same.

Pass 2 takes only windows estimated repeated. Inside one flush of a task, equal windows
of later documents are decided at once; the first one goes to the task of its hash range,
which groups exactly by 128 bits and decides the rest. So a passage that a third of all
documents share sends one entry per flush, not one per document. Decisions come back to
the documents packed by buckets of ids, one row per document after that, and the words
are removed.

Defined results: null texts have no words; a null id is never earlier than another and
loses nothing; rows of one id are not earlier than one another; equal rows get equal
results; extra columns pass through ``remove_repeated``; an empty table gives no rows. A
very long text is one piece of work of its own, in memory of some times its size. The
number of hash ranges follows the input's size, so that a range's task stays the same.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm._kernels import U, Words, mix
from quillstone.llm._shared import blocks, n_ranges, n_shards, new_shared_path, table
from quillstone.llm.files import local_path

ROWS = 2
SLICE_BITS = 22
BITMAP = "cells.bits"
FLUSH = 1 << 19
MOST_CELLS = 1 << 33
#: Odd multipliers that give each row its own cells. Fixed values.
ROW_SALTS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def cell_bits(windows: int, most_cells: int = MOST_CELLS) -> int:
    """Bits of a cell number: about four cells a window."""
    return max(SLICE_BITS, min(most_cells.bit_length() - 1, (4 * max(1, windows)).bit_length()))


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(h * U(ROW_SALTS[row])) >> U(64 - bits)


def _deltas(sorted_cells: np.ndarray) -> tuple[int, bytes]:
    gaps = np.diff(sorted_cells, prepend=sorted_cells.dtype.type(0))
    kind = np.uint16 if not len(gaps) or gaps.max() < 1 << 16 else np.uint32
    return np.dtype(kind).itemsize, gaps.astype(kind).tobytes()


def _undeltas(size: int, data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, f"u{size}").astype(np.int64))


def partial_sketches(docs: DataFrame, width: int, bits: int, most_held: int = FLUSH) -> DataFrame:
    """(slice, once, more): cells of each slice that a flush of a task met once, and more than once."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate(held)
        for row in range(ROWS):
            c = np.sort(cells(h, row, bits))
            first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            times = np.diff(np.append(first, len(c)))
            c = c[first]
            cuts = np.searchsorted(c, np.arange(1 << (bits - SLICE_BITS), dtype=U) << U(SLICE_BITS))
            out: dict[str, list] = {k: [] for k in ("slice", "once_size", "once", "more_size", "more")}
            for s, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], len(c)], strict=True)):
                if hi > lo:
                    part, many = c[lo:hi] & U((1 << SLICE_BITS) - 1), times[lo:hi] > 1
                    one, two = _deltas(part[~many]), _deltas(part[many])
                    for k, v in zip(out, ((row << (bits - SLICE_BITS)) + s, *one, *two), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["slice"], pa.int32()), pa.array(out["once_size"], pa.int32()), pa.array(out["once"], pa.binary()), pa.array(out["more_size"], pa.int32()), pa.array(out["more"], pa.binary())], list(out))

    def task(batches):
        held, n = [], 0
        for _, texts in blocks(batches, "text"):
            w = Words(texts)
            held.append(w.runs(width, w.hashes())[1])
            n += len(held[-1])
            if n >= most_held:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return docs.select("text").mapInArrow(task, "slice int, once_size int, once binary, more_size int, more binary")


def merge_sketches(partials: DataFrame, folder: str, bits: int) -> int:
    """Add up the slices and write each one's bits, of cells that reached 2, into its place in the one file of all slices. Returns the number of slices written.

    Slices that nobody met are holes of zeros. A repeated task writes the same bytes to the same place.
    """
    size = (1 << SLICE_BITS) // 8
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{BITMAP}", "wb") as f:
        f.truncate(size * (ROWS << (bits - SLICE_BITS)))

    def write(number: int, count: np.ndarray) -> pa.RecordBatch:
        with open(f"{folder}/{BITMAP}", "r+b", buffering=0) as f:
            f.seek(number * size)
            f.write(np.packbits(count > 1, bitorder="little").tobytes())
        return pa.RecordBatch.from_pydict({"slice": pa.array([number], pa.int32())})

    def task(batches):
        now, count = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["slice"] != now:
                    if now is not None:
                        yield write(now, count)
                    now, count = r["slice"], np.zeros(1 << SLICE_BITS, np.uint8)
                for step, part in ((1, _undeltas(r["once_size"], r["once"])), (2, _undeltas(r["more_size"], r["more"]))):
                    count[part] = np.minimum(count[part] + step, 2)
        if now is not None:
            yield write(now, count)

    n = n_shards(partials.sparkSession)
    return partials.repartition(n, "slice").sortWithinPartitions("slice").mapInArrow(task, "slice int").count()


@lru_cache(2)
def _bitmap(folder: str) -> np.ndarray:
    """The bits of all slices: one map, one descriptor, whatever their number."""
    return np.memmap(f"{folder}/{BITMAP}", np.uint8, "r")


def maybe_repeated(h: np.ndarray, folder: str, bits: int) -> np.ndarray:
    """True where every row's cell reached 2."""
    held, out = _bitmap(folder), np.ones(len(h), bool)
    for row in range(ROWS):
        at = np.flatnonzero(out)
        place = cells(h[at], row, bits).astype(np.int64) + (row << bits)
        order = np.argsort(place, kind="stable")
        place = place[order]
        out[at[order]] = (held[place >> 3] >> (place & 7).astype(np.uint8)) & 1
    return out


ENTRY = "shard int, decided boolean, docs binary, counts binary, at binary, h1 binary, h2 binary"


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of consecutive numbers."""
    first = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1))) if len(at) else np.zeros(0, np.int64)
    return at[first], np.diff(np.append(first, len(at)))


def by_document(doc: np.ndarray, key: np.ndarray, at: np.ndarray) -> dict[str, bytes]:
    """Windows packed with each document's id and text key once; rows of a document are together."""
    edge = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))))
    return {"docs": np.stack([doc[edge], key[edge]]).astype(np.int64).tobytes(), "counts": np.diff(np.append(edge, len(doc))).astype(np.uint32).tobytes(), "at": at.astype(np.uint32).tobytes()}


def opened(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, key and at of a packed row."""
    count = np.frombuffer(r["counts"], np.uint32)
    doc, key = np.frombuffer(r["docs"], np.int64).reshape(2, -1)
    return np.repeat(doc, count), np.repeat(key, count), np.frombuffer(r["at"], np.uint32).astype(np.int64)


def candidates(docs: DataFrame, width: int, folder: str, bits: int, shards: int, most_held: int = FLUSH) -> DataFrame:
    """ENTRY rows: windows to group exactly, and windows already decided, packed by hash range."""

    def pack(shard: int, decided: bool, doc, key, at, h1, h2) -> dict:
        return {"shard": shard, "decided": decided, **by_document(doc, key, at), "h1": h1.tobytes(), "h2": h2.tobytes()}

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, key, at, h1, h2 = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, h2, h1))
        same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        group = np.cumsum(np.concatenate(([0], ~same)))
        least = doc[order][np.flatnonzero(np.concatenate(([True], ~same)))]
        later = np.empty(len(doc), bool)
        later[order] = doc[order] > least[group]
        rows = []
        use = np.flatnonzero(later)
        if len(use):
            rows.append(pack(int(mix(doc[use[:1]].astype(U))[0] % U(shards)), True, doc[use], key[use], at[use], np.zeros(0, U), np.zeros(0, U)))
        use = np.flatnonzero(~later)
        shard = ((h1[use] >> U(32)) * U(shards) >> U(32)).astype(np.int64)
        turn = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[turn], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            u = use[turn[cuts[s] : cuts[s + 1]]]
            rows.append(pack(int(s), False, doc[u], key[u], at[u], h1[u], h2[u]))
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("shard", pa.int32()), ("decided", pa.bool_()), *[(k, pa.binary()) for k in ("docs", "counts", "at", "h1", "h2")]]))

    def task(batches):
        held, n = [], 0
        for batch, texts in blocks(batches, "text"):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            w = Words(texts)
            a = w.hashes(0)
            at, h1 = w.runs(width, a, 0)
            use = np.flatnonzero(maybe_repeated(h1, folder, bits))
            if len(use):
                h2 = w.runs(width, w.hashes(1), 1)[1]
                doc = w.doc[at[use]]
                keys = batch.column(1).to_numpy(zero_copy_only=False)
                held.append((ids[doc].astype(np.int64), keys[doc].astype(np.int64), at[use] - w.low[doc], h1[use], h2[use]))
                n += len(use)
            if n >= most_held:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return docs.filter("doc_id is not null").select("doc_id", "text_key", "text").mapInArrow(task, ENTRY)


DECIDED = "bucket int, docs binary, counts binary, at binary"


def decide(entries: DataFrame, shards: int) -> DataFrame:
    """DECIDED rows: windows that an earlier document holds, packed by the hash of the document, at most one row per hash range and bucket."""

    def packed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, key, at = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = (mix(doc.astype(U)) % U(shards)).astype(np.int64)
        order = np.lexsort((at, key, doc, bucket))
        doc, key, at, bucket = doc[order], key[order], at[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(shards + 1))
        rows = [{"bucket": int(b), **by_document(*(x[cuts[b] : cuts[b + 1]] for x in (doc, key, at)))} for b in np.flatnonzero(np.diff(cuts))]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", pa.int32()), *[(k, pa.binary()) for k in ("docs", "counts", "at")]]))

    def grouped(held: list[tuple], done: list[tuple]) -> Iterator[pa.RecordBatch]:
        if held:
            doc, key, at, h1, h2 = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, h2, h1))
            new = np.concatenate(([True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])))
            least = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            use = order[doc[order] > least]
            done = [*done, (doc[use], key[use], at[use])]
        if done and sum(len(x[0]) for x in done):
            yield from packed(done)

    def task(batches):
        now, held, done = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != now:
                    yield from grouped(held, done)
                    now, held, done = r["shard"], [], []
                if r["decided"]:
                    done.append(opened(r))
                else:
                    held.append((*opened(r), np.frombuffer(r["h1"], U), np.frombuffer(r["h2"], U)))
        yield from grouped(held, done)

    return entries.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(task, DECIDED)


def gather(decided: DataFrame, shards: int) -> DataFrame:
    """(doc_id, text_key, spans): one row per document, with starts and lengths of its runs of windows."""

    def spans(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, key, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((at, key, doc))
        doc, key, at = doc[order], key[order], at[order]
        edge = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))))
        made = [np.stack(_runs(np.unique(at[lo:hi]))).astype(np.uint32).tobytes() for lo, hi in zip(edge, [*edge[1:], len(doc)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[edge]), pa.array(key[edge]), pa.array(made, pa.binary())], ["doc_id", "text_key", "spans"])

    def task(batches):
        now, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] != now:
                    if held:
                        yield from spans(held)
                    now, held = r["bucket"], []
                held.append(opened(r))
        if held:
            yield from spans(held)

    return decided.repartition(shards, "bucket").sortWithinPartitions("bucket").mapInArrow(task, "doc_id long, text_key long, spans binary")


def uncut(text: bytes, kept: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The runs of kept words as they are written, with one space, or a line break where the text between them has one, in between."""
    first, n = _runs(kept)
    parts: list[bytes] = []
    for a, b in zip(first.tolist(), (first + n - 1).tolist(), strict=True):
        if parts:
            parts.append(b"\n" if b"\n" in text[last : start[a]] else b" ")
        parts.append(text[start[a] : end[b]])
        last = end[b]
    return b"".join(parts)


def remove_repeated(docs: DataFrame, width: int = 13, most_cells: int = MOST_CELLS, most_held: int = FLUSH, as_written: bool = False) -> DataFrame:
    """All columns of docs, n_words, n_removed and kept_text: the words left, joined by one space.

    ``as_written`` keeps the white space between words that stay together, and puts a line
    break where one was cut out, else a space; texts that lose nothing stay as they are.
    """
    spark = docs.sparkSession
    shards, words = n_ranges(docs)
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    bits = cell_bits(words, most_cells)
    folder = local_path(new_shared_path(spark, "window-sketch"))
    merge_sketches(partial_sketches(docs, width, bits, most_held), folder, bits)
    decided = decide(candidates(keyed, width, folder, bits, shards, most_held), shards)
    found = gather(decided, shards).withColumnRenamed("spans", "__spans")
    columns = docs.columns
    joined = keyed.join(found, ["doc_id", "text_key"], "left").select(*columns, "__spans")

    def task(batches):
        for batch, texts in blocks(batches, "text"):
            w = Words(texts)
            spans = batch.column(len(columns)).to_pylist()
            gone = np.zeros(len(w.start) + 1, np.int64)
            for i, packed in enumerate(spans):
                if packed:
                    start, n = np.frombuffer(packed, np.uint32).astype(np.int64).reshape(2, -1)
                    np.add.at(gone, w.low[i] + start, 1)
                    np.add.at(gone, w.low[i] + start + n + width - 1, -1)
            gone = np.cumsum(gone[:-1]) > 0
            dropped = np.bincount(w.doc[gone], minlength=len(texts))
            kept = []
            for i, x in enumerate(texts):
                lo, hi = w.low[i], w.low[i] + w.count[i]
                base = w.first[i]
                if dropped[i] and as_written:
                    kept.append(uncut(x, (np.flatnonzero(~gone[lo:hi]) + lo), w.start - base, w.end - base))
                elif as_written:
                    kept.append(x)
                elif dropped[i]:
                    use = np.flatnonzero(~gone[lo:hi]) + lo
                    kept.append(b" ".join([x[a:b] for a, b in zip((w.start[use] - base).tolist(), (w.end[use] - base).tolist(), strict=True)]))
                else:
                    kept.append(b" ".join(x.split()))
            yield pa.RecordBatch.from_arrays([*[batch.column(j) for j in range(len(columns))], pa.array(w.count.astype(np.int64)), pa.array(dropped.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())], [*columns, "n_words", "n_removed", "kept_text"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["n_words long, n_removed long, kept_text string"])
    return joined.mapInArrow(task, schema)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words over all ``documents``."""
    made = remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
