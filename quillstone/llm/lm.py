"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and mapped by workers.

Tokens: lower-cased (A-Z) words and one end per text, after order - 1 begin marks.

Counting. A task combines the n-grams of each flush and sends them by the hash range of
their context, each context once per flush. The task of a range adds up, writes two
sorted hash arrays to the shared folder (n-grams with counts, contexts with totals and
numbers of successors seen once, twice, more) and passes the suffixes on, with the
number of distinct left neighbours, to the level below; this repeats down to words.
Everything gathered grows with the corpus and is spread over hash ranges, whose number
follows the input's size; the driver sees one line of totals per range.

Contexts made of common words only (begin marks among them) would fill one range. They are
split: each of their n-grams goes to one of ``splits`` ranges by its own hash, each range holds a
part of the context's totals, and readers add the parts up. Which words are common is
estimated from a 64th of the texts; it decides where things lie and never what is counted.

Scoring. Workers map the arrays into memory and look up each block's distinct n-grams in
sorted order, so a lookup walks an array instead of jumping about in it.

Hashes have 64 bits. A file is written under a name of its own and renamed, so a repeated
task leaves one file.

Defined results: a null or empty text is its end token alone; with nothing to learn from,
N and V are 0 and every token has probability 1; a null id is a training row; repeated
rows count each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm._kernels import U, Words, mix
from quillstone.llm._shared import blocks, crc_mod, n_ranges, new_shared_path, selected, table
from quillstone.llm.files import Maps, local_path, save_arrays

BEGIN, END = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)
FLUSH = 1 << 20
BIG = 255


def streams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of a block with begin marks and ends; positions of real tokens; their texts."""
    w = Words(texts, lower=True)
    n, pad = len(texts), order - 1
    size = w.count + pad + 1
    first = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64) if n else np.zeros(0, np.int64)
    tokens = np.full(int(size.sum()), BEGIN, U)
    tokens[np.arange(len(w.doc)) - w.low[w.doc] + first[w.doc] + pad] = w.hashes()
    tokens[first + size - 1] = END
    real = np.ones(len(tokens), bool)
    for p in range(pad):
        real[first + p] = False
    return tokens, np.flatnonzero(real), np.repeat(np.arange(n), w.count + 1)


def gram(words: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams from the hashes of their words."""
    out = words[0]
    for x in words[1:]:
        out = mix(out * U(0xD1342543DE82EF95) + x)
    return out


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> U(32)) * U(shards) >> U(32)).astype(np.int64)


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct sorted keys, a row of each, and sums of values by key."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[first], order[first], [np.add.reduceat(v[order], first) if len(k) else v for v in values]


MOST_SPLITS = 64


@lru_cache(4)
def _hashes(words: tuple[int, ...]) -> np.ndarray:
    return np.array(words, U)


@dataclass(frozen=True)
class Layout:
    """Where n-grams lie: the number of hash ranges, the common words (sorted hashes) and over how many ranges their contexts are split."""

    shards: int
    common: tuple[int, ...] = ()
    splits: int = 1

    def is_common(self, word: np.ndarray) -> np.ndarray:
        known = _hashes(self.common)
        if not len(known) or self.splits < 2:
            return np.zeros(len(word), bool)
        return known[np.minimum(np.searchsorted(known, word), len(known) - 1)] == word

    def is_split(self, context: list[np.ndarray]) -> np.ndarray:
        out = self.is_common(context[0])
        for w in context[1:]:
            out &= self.is_common(w)
        return out

    def range_of(self, context: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The range of a context's part: parts lie in ranges of their own, part 0 where a context that is not split lies."""
        return (shard_of(context, self.shards) + part.astype(np.int64)) % self.shards

    def of_gram(self, words: list[np.ndarray]) -> np.ndarray:
        """The range of each n-gram."""
        if len(words) == 1:
            return shard_of(words[0], self.shards)
        context = gram(words[:-1])
        part = np.where(self.is_split(words[:-1]), mix(gram([context, words[-1]])) % U(self.splits), U(0))
        return self.range_of(context, part)


def layout(docs: DataFrame) -> Layout:
    """Ranges by the size of docs; common are words that fill a quarter of a range or more, as a 64th of the texts tells."""
    shards, _ = n_ranges(docs)

    def task(batches):
        for _, texts in blocks(batches, "text"):
            word, n = np.unique(streams(texts, 1)[0], return_counts=True)
            use = n > n.sum() // (16 * shards)
            yield pa.RecordBatch.from_arrays([pa.array(word[use].view(np.int64)), pa.array(n[use])], ["word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n.sum()], pa.int64())], ["word", "n"])

    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(64)) == 0).select("text")
    counted = some.mapInArrow(task, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = counted.filter("word is null").agg(F.coalesce(F.max("n"), F.lit(0)).alias("total"))
    found = counted.filter("word is not null").join(F.broadcast(total)).filter(F.col("n") * 4 * shards > F.col("total")).select("word").collect()
    common = sorted({int(BEGIN), *(r["word"] % (1 << 64) for r in found)})
    return Layout(shards, tuple(common), min(shards, MOST_SPLITS))


PACKED = "shard int, firsts binary, repeats binary, rest binary, counts binary, raw binary"


def packed(words: list[np.ndarray], count: np.ndarray, raw: np.ndarray, lay: Layout) -> Iterator[pa.RecordBatch]:
    """PACKED rows by the hash range of the context (of the word itself, for single words)."""
    shards, shard = lay.shards, lay.of_gram(words)
    order = np.lexsort((words[0], shard))
    words, count, raw, shard = [w[order] for w in words], count[order], raw[order], shard[order]
    cuts = np.searchsorted(shard, np.arange(shards + 1))
    out: dict[str, list] = {k: [] for k in ("shard", "firsts", "repeats", "rest", "counts", "raw")}
    for s in np.flatnonzero(np.diff(cuts)):
        part = slice(cuts[s], cuts[s + 1])
        w = words[0][part]
        edge = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        row = (int(s), w[edge].tobytes(), np.diff(np.append(edge, len(w))).astype(np.uint32).tobytes(), b"".join(x[part].tobytes() for x in words[1:]), count[part].astype(np.uint32).tobytes(), raw[part].astype(np.int64).tobytes() if raw is not count else b"")
        for k, v in zip(out, row, strict=True):
            out[k].append(v)
    yield pa.RecordBatch.from_arrays([pa.array(out["shard"], pa.int32()), *[pa.array(out[k], pa.binary()) for k in list(out)[1:]]], list(out))


def unpacked(r: dict, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    first = np.repeat(np.frombuffer(r["firsts"], U), np.frombuffer(r["repeats"], np.uint32))
    rest = np.frombuffer(r["rest"], U).reshape(order - 1, -1) if order > 1 else []
    return [first, *rest], np.frombuffer(r["counts"], np.uint32).astype(np.int64), np.frombuffer(r["raw"], np.int64)


def raw_counts(docs: DataFrame, order: int, lay: Layout) -> DataFrame:
    """n-grams of the highest order with their counts, combined within each flush of a task."""

    def flush(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        words = [np.concatenate(x) for x in zip(*held, strict=True)]
        key = gram(words)
        _, row, (count,) = summed(key, np.ones(len(key), np.int64))
        yield from packed([w[row] for w in words], count, count, lay)

    def task(batches):
        held, n = [], 0
        for _, texts in blocks(batches, "text"):
            tokens, at, _ = streams(texts, order)
            held.append([tokens[at - order + 1 + j] for j in range(order)])
            n += len(at)
            if n >= FLUSH:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return docs.select("text").mapInArrow(task, PACKED)


def _note(folder: str, level: int, name: str, totals: dict) -> None:
    """Totals of a range as one line of JSON, which Spark adds up."""
    os.makedirs(f"{folder}/totals-{level}", exist_ok=True)
    own = f"{folder}/{name}.{uuid.uuid4().hex}"
    with open(own, "w") as f:
        json.dump(totals, f)
    os.replace(own, f"{folder}/totals-{level}/{name}.json")


def write_level(entries: DataFrame, order: int, lay: Layout, folder: str) -> DataFrame:
    """Add up n-grams of one order, write its arrays, and give the PACKED rows of the order below."""

    def write(number: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        words = [np.concatenate([h[0][j] for h in held]) for j in range(order)]
        key, row, (count, raw) = summed(gram(words), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
        words = [w[row] for w in words]
        name, big = f"{order}-{number:06d}", np.flatnonzero(count >= BIG)
        save_arrays(f"{folder}/{name}", keys=key, counts=np.minimum(count, BIG).astype(np.uint8), bigkeys=key[big], bigcounts=count[big], **({"raw": raw} if order == 1 else {}))
        if order > 1:
            context = gram(words[:-1])
            c, _, (total, one, two, more) = summed(context, count, (count == 1).astype(np.int64), (count == 2).astype(np.int64), (count > 2).astype(np.int64))
            save_arrays(f"{folder}/context-{name}", keys=c, totals=total.astype(np.int64), one=one.astype(np.uint32), two=two.astype(np.uint32), more=more.astype(np.uint32))
        kinds = {f"n{c}": int((count == c).sum()) for c in (1, 2, 3, 4)}
        _note(folder, order, name, kinds | {"more": int((count > 2).sum()), "total": int(count.sum()), "distinct": len(key), "raw": int(raw.sum())})
        if order > 1:
            _, row, (left, below) = summed(gram(words[1:]), np.ones(len(key), np.int64), raw)
            yield from packed([w[row] for w in words[1:]], left, below, lay)

    def task(batches):
        now, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != now:
                    if held:
                        yield from write(now, held)
                    now, held = r["shard"], []
                held.append(unpacked(r, order))
        if held:
            yield from write(now, held)

    return entries.repartition(lay.shards, "shard").sortWithinPartitions("shard").mapInArrow(task, PACKED)


def discounts(kinds: list[int]) -> list[float]:
    """D1, D2 and D3+ from the numbers of n-grams seen 1, 2, 3 and 4 times; 0.5, 1 and 1.5 where these tell nothing."""
    if not all(kinds[:3]):
        return [0.5, 1.0, 1.5]
    y = kinds[0] / (kinds[0] + 2 * kinds[1])
    return [min(c + 1.0, max(0.0, (c + 1) - (c + 2) * y * kinds[c + 1] / kinds[c])) for c in range(3)]


@dataclass(frozen=True)
class NgramModel:
    folder: str
    order: int
    layout: Layout
    n_tokens: int
    n_words: int
    total: tuple[int, ...]  # sum of counts by order
    discount: tuple[tuple[float, float, float], ...]
    spread: float  # share of the word level that goes to the uniform distribution


def fit(docs: DataFrame, order: int = 2, folder: str | None = None) -> NgramModel:
    """Count the whole of docs and write the model's arrays; ``folder`` is a new folder of the shared one by default."""
    spark = docs.sparkSession
    lay = layout(docs)
    folder = folder or local_path(new_shared_path(spark, "ngrams"))
    entries = raw_counts(docs, order, lay)
    for level in range(order, 0, -1):
        entries = write_level(entries, level, lay, folder)
    entries.count()
    fields = ("n1", "n2", "n3", "n4", "more", "total", "distinct", "raw")
    totals = []
    for level in range(1, order + 1):
        noted = f"{folder}/totals-{level}"
        found = spark.read.schema(", ".join(f"{k} long" for k in fields)).json(f"file://{noted}").agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in fields]).first().asDict() if os.path.isdir(noted) else dict.fromkeys(fields, 0)
        totals.append(found | {"kinds": [found[f"n{c}"] for c in (1, 2, 3, 4)]})
    d = [discounts(t["kinds"]) for t in totals]
    words = totals[0]
    held_back = d[0][0] * words["kinds"][0] + d[0][1] * words["kinds"][1] + d[0][2] * words["more"]
    return NgramModel(folder, order, lay, words["raw"], words["distinct"], tuple(t["total"] for t in totals), tuple(map(tuple, d)), held_back / words["total"] if words["total"] else 1.0)


class Reader:
    """The arrays of a model, mapped into memory as they are asked for; a file for each range and level, of which a bounded number is open."""

    def __init__(self, model: NgramModel):
        self.model, self.maps = model, Maps()

    def find(self, name: str, shard: np.ndarray, keys: np.ndarray, kinds: tuple[str, ...]) -> list[np.ndarray]:
        """Values of each kind for each key in its range, 0 where it is absent. Keys are sorted and distinct within a range."""
        out = [np.zeros(len(keys), np.int64) for _ in kinds]
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.model.layout.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            use = order[cuts[s] : cuts[s + 1]]
            arrays = self.maps.get(f"{self.model.folder}/{name}-{s:06d}")
            if arrays is None or not len(arrays["keys"]):
                continue
            held = arrays["keys"]
            at = np.minimum(np.searchsorted(held, keys[use]), len(held) - 1)
            hit = held[at] == keys[use]
            use, at = use[hit], at[hit]
            for o, kind in zip(out, kinds, strict=True):
                o[use] = arrays[kind][at]
            if "counts" in kinds:
                o = out[kinds.index("counts")]
                big = use[o[use] == BIG]
                if len(big):
                    o[big] = arrays["bigcounts"][np.searchsorted(arrays["bigkeys"], keys[big])]
        return out

    def context_totals(self, n: int, context: np.ndarray, split: np.ndarray) -> list[np.ndarray]:
        """totals, one, two and more of distinct sorted contexts; those that are split are added up over their parts."""
        kinds, lay = ("totals", "one", "two", "more"), self.model.layout
        out = self.find(f"context-{n}", lay.range_of(context, np.zeros(len(context), U)), context, kinds)
        at = np.flatnonzero(split)
        for part in range(1, lay.splits) if len(at) else ():
            more = self.find(f"context-{n}", lay.range_of(context[at], np.full(len(at), part, U)), context[at], kinds)
            for o, m in zip(out, more, strict=True):
                o[at] += m
        return out

    def score(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """n_tokens, n_known, base_score and score of each text."""
        m = self.model
        tokens, at, doc = streams(texts, m.order)
        word, inverse = np.unique(tokens[at], return_inverse=True)
        left, raw = self.find("1", m.layout.of_gram([word]), word, ("counts", "raw"))
        base = np.log10((raw + 0.5) / (m.n_tokens + 0.5 * (m.n_words + 1)))[inverse]
        cut = np.array([0.0, *m.discount[0]])
        p = (np.maximum(left - cut[np.minimum(left, 3)], 0) / max(1, m.total[0]) + m.spread / (m.n_words + 1))[inverse]
        for n in range(2, m.order + 1):
            words = [tokens[at - n + 1 + j] for j in range(n)]
            context = gram(words[:-1])
            key, row, back = np.unique(gram([context, words[-1]]), return_index=True, return_inverse=True)
            mine = [w[row] for w in words]
            (count,) = self.find(str(n), m.layout.of_gram(mine), key, ("counts",))
            ckey, first, cback = np.unique(context[row], return_index=True, return_inverse=True)
            total, *seen = self.context_totals(n, ckey, m.layout.is_split([w[first] for w in mine[:-1]]))
            spare = sum(d * s for d, s in zip(m.discount[n - 1], seen, strict=True))
            cut = np.array([0.0, *m.discount[n - 1]])
            own = np.maximum(count - cut[np.minimum(count, 3)], 0)
            known = total > 0
            share = np.where(known, spare / np.maximum(total, 1), 1.0)[cback]
            own = np.where(known[cback], own / np.maximum(total, 1)[cback], 0.0)
            p = own[back] + share[back] * p
        k = len(texts)
        return {"n_tokens": np.bincount(doc, minlength=k).astype(np.int64), "n_known": np.bincount(doc, weights=raw[inverse] > 0, minlength=k).astype(np.int64), "base_score": np.bincount(doc, weights=base, minlength=k), "score": np.bincount(doc, weights=np.log10(p), minlength=k)}


@lru_cache(2)
def reader(model: NgramModel) -> Reader:
    """One reader per Python worker."""
    return Reader(model)


def score(docs: DataFrame, model: NgramModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns, n_tokens, n_known, base_score and score; perplexity is 10 ** (-score / n_tokens)."""

    rows, column = selected(docs, keep, text)

    def task(batches):
        r = reader(model)
        for batch, texts in blocks(batches, column, 2 << 20):
            made = r.score(texts)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *[pa.array(v) for v in made.values()]], [*keep, *made])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + ["n_tokens long, n_known long, base_score double, score double"])
    return rows.mapInArrow(task, schema)


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the documents that are not held out; score all ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs.filter(crc_mod("doc_id", 5) != 1))
    made = score(docs, model)
    return made.select("doc_id", (crc_mod("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
