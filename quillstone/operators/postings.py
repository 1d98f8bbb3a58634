"""Posting lists of character grams: which chunks can hold a token, without reading their texts.

Grams are one to three code points of the lower-cased text, as numbers that are exact (21 bits a code point). Chunk ids
are cut into spans of 2**16; a row (gram, span) lists the ids of a span as gaps of two bytes. Rows are written by hash
range of the gram, sorted by gram, so a search opens only the ranges of its grams and skips most of their row groups. A
new batch of chunks adds files (``add``); nothing is rewritten, and several rows of one gram and span are read together.

A search brings the lists of its grams together by span, never by gram: a token's candidates are the intersection of
its grams' lists, and a question's candidates in a span are ids with enough candidate tokens to be a hit. Only
the texts of candidates are read, each with the questions that it is a candidate for. With ``best``, a text is not
searched for a question if even all its candidate tokens could not lift it into the question's best ones.

Defined results: those of ``keywords.scan`` with the same arguments. Null and empty texts have no grams; ids are not negative. Chunks that
are not in ``units`` any more are candidates without a text and give no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.keywords import HITS, MANY_TOKENS, SLACK, Asked, Best, Held, blocks_of, by_question, pieces, with_semantic
from quillstone.sources.scratch import if_small, kept, spread

SPAN_BITS = 16
#: Hash ranges of grams, one folder each.
PARTS = 64
#: No code point; marks grams of fewer than three.
NONE = (1 << 21) - 1
#: Candidates are looked up in granules of 2**10 ids; so many granules come to the driver at most, and so many ranges go into a filter.
GRANULE_BITS, MOST_GRANULES, MOST_RANGES = 10, 100_000, 64
#: Ids of a span that are counted at a time.
STEP = 1 << 11
#: Postings of a flush.
FLUSH = 1 << 21
ROWS = "part int, gram long, span long, n int, gaps binary"


def grams(text: str) -> np.ndarray:
    """The distinct grams of one, two and three code points."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    one, two, three = (NONE << 42) | (NONE << 21) | c, (NONE << 42) | (c[:-1] << 21) | c[1:], (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
    return np.unique(np.concatenate([one, two, three]))


def token_grams(token: str) -> np.ndarray:
    """The grams that a text with this token surely has, the longest that there are."""
    found = grams(token)
    return found[found < NONE << 42] if len(token) >= 3 else found[:1] if len(token) == 2 else found


def part_of(gram: np.ndarray) -> np.ndarray:
    return ((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % PARTS


def _gaps(ids: np.ndarray) -> bytes:
    return np.diff(ids, prepend=0).astype(np.uint16).tobytes()


def lists(units: DataFrame) -> DataFrame:
    """ROWS of (chunk_id, text), a row for each gram and span of a flush."""

    def flush(held: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        gram = np.concatenate([g for _, g in held])
        chunk = np.repeat(np.array([c for c, _ in held], np.int64), [len(g) for _, g in held])
        order = np.lexsort((chunk, gram, chunk >> SPAN_BITS))
        gram, chunk = gram[order], chunk[order]
        span, low = chunk >> SPAN_BITS, chunk & ((1 << SPAN_BITS) - 1)
        again = (gram[1:] == gram[:-1]) & (chunk[1:] == chunk[:-1])
        use = np.concatenate(([True], ~again))
        gram, span, low = gram[use], span[use], low[use]
        start = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (span[1:] != span[:-1]))))
        end = np.append(start[1:], len(gram))
        yield pa.RecordBatch.from_arrays([pa.array(part_of(gram[start]), pa.int32()), pa.array(gram[start]), pa.array(span[start]), pa.array(end - start, pa.int32()), pa.array([_gaps(low[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())], ["part", "gram", "span", "n", "gaps"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for chunk, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text:
                    held.append((chunk, grams(text)))
                    n += len(held[-1][1])
                if n > FLUSH:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return spread(units.select("chunk_id", F.lower("text").alias("t"))).mapInArrow(task, ROWS)


def add(units: DataFrame, path: str) -> None:
    """Append the lists of these chunks to the index at ``path``: a file for each part, sorted by gram."""
    lists(units).repartition(PARTS, "part").sortWithinPartitions("part", "gram", "span").write.mode("append").partitionBy("part").parquet(path)


def opened(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(", ".join(c for c in ROWS.split(", ") if not c.startswith("part ")) + ", part int").parquet(path)


def candidates(postings: DataFrame, asked: Asked) -> DataFrame:
    """(chunk_id, asked, bound): the questions, by number, that a chunk can be a hit for, and how many tokens it may have at most."""
    spark = postings.sparkSession
    words = sorted({t for toks in asked.tokens for t in toks})
    wanted = [token_grams(t) for t in words]
    every = np.unique(np.concatenate(wanted)) if wanted else np.zeros(0, np.int64)
    known = spark.createDataFrame([(int(g),) for g in every], "gram long")
    parts = sorted({int(p) for p in part_of(every)})
    mine = postings.filter(F.col("part").isin(parts)).join(if_small(known), "gram").select("span", "gram", "gaps")
    lookup, place = [np.searchsorted(every, g) for g in wanted], {t: i for i, t in enumerate(words)}
    of = [np.array([place[t] for t in toks]) for toks in asked.tokens]
    size = 1 << SPAN_BITS

    def found(span: int, bits: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(size // 8, np.uint8)
        token = [np.bitwise_and.reduce([bits.get(int(g), none) for g in gs]) for gs in lookup]
        for first in range(0, size, STEP):  # pairs of a step are few, whatever a token's share of the texts
            mine = [b[first // 8 : (first + STEP) // 8] for b in token]
            out = []
            for q, toks in enumerate(of):
                count = np.zeros(STEP, np.int32)
                for t in toks:
                    count += np.unpackbits(mine[t])
                at = np.flatnonzero(count >= asked.need[q])
                out.append((at, np.full(len(at), q), count[at]))
            at, q, count = (np.concatenate(x) for x in zip(*out, strict=True))
            order = np.argsort(at, kind="stable")
            chunk, start = np.unique(at[order], return_index=True)
            cut = pa.array(np.append(start, len(order)).astype(np.int32))
            as_list = lambda v: pa.ListArray.from_arrays(cut, pa.array(v[order], pa.int32()))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(chunk + span * size + first), as_list(q), as_list(count)], ["chunk_id", "asked", "bound"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = None, {}
        for b in batches:
            for span, gram, gaps in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if span != now:
                    if now is not None:
                        yield from found(now, bits)
                    now, bits = span, {}
                mask = np.zeros(size, bool)
                mask[np.cumsum(np.frombuffer(gaps, np.uint16).astype(np.int64))] = True
                packed, g = np.packbits(mask), int(np.searchsorted(every, gram))
                bits[g] = bits[g] | packed if g in bits else packed
        if now is not None:
            yield from found(now, bits)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mine.repartition(n, "span").sortWithinPartitions("span").mapInArrow(task, "chunk_id long, asked array<int>, bound array<int>")


def ranges(granules: list[int], most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges of ids that hold these sorted granules, cut at the widest gaps."""
    if not granules:
        return []
    widest = sorted(sorted(range(1, len(granules)), key=lambda i: granules[i - 1] - granules[i])[: most - 1])
    widest = [i for i in widest if granules[i] - granules[i - 1] > 1]
    cuts = [0, *widest, len(granules)]
    return [(granules[a] << GRANULE_BITS, ((granules[z - 1] + 1) << GRANULE_BITS) - 1) for a, z in zip(cuts, cuts[1:], strict=False)]


def covered(found: DataFrame) -> Column:
    """A condition on chunk_id that candidates meet, as few ranges: scans of tables in the order of their ids skip what lies between. True where candidates lie in too many places to say."""
    granules = found.select(F.shiftright("chunk_id", GRANULE_BITS).alias("g")).distinct().limit(MOST_GRANULES + 1).collect()
    if len(granules) > MOST_GRANULES:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.col("chunk_id").between(a, z) for a, z in ranges(sorted(r.g for r in granules))], F.lit(False))


def search(postings: DataFrame, units: DataFrame, queries: DataFrame, block: int = 5_000, least: int | None = None, best: Best | None = None, semantic: DataFrame | None = None) -> DataFrame:
    """HITS as ``keywords.scan`` finds them, from the texts of candidates only: their id ranges are a filter that reaches the scan."""
    spark = units.sparkSession
    out = None
    for asked in blocks_of(queries, block, least):

        def task(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            machine, held = None, Held(asked, best)
            for b in pieces(batches):
                semantic_of, found, only = [by_question(x) for x in b.column(3)], [], np.zeros((b.num_rows, len(asked.ids)), bool)
                for i, (text, qs, bounds) in enumerate(zip(b.column(2), b.column(4), b.column(5), strict=True)):
                    q = qs.values.to_numpy()
                    if best:
                        bound = bounds.values.to_numpy().astype(np.int64)
                        top = np.where((bound == asked.size[q]) & (asked.size[q] > 1), 0.75, asked.score(q, bound))
                        more = np.array([semantic_of[i].get(x, 0.0) for x in asked.ids[q].tolist()]) if semantic_of[i] else np.zeros(len(q))
                        q = q[best.key(bound, top, more) >= held.bar[q] - SLACK]
                    only[i, q] = True
                    words = frozenset().union(*(asked.wanted[x] for x in q.tolist())) if text.is_valid else ()
                    t = text.as_py() if words else ""
                    if len(words) > MANY_TOKENS:
                        machine = machine or asked.automaton()
                        found.append({v for _, v in machine.iter(t)})
                    else:
                        found.append({w for w in words if asked.words[w] in t})
                held.add(b.column(0).to_pylist(), b.column(1).to_pylist(), asked.hits(found, only), semantic_of)
                yield from held.batches(False)
            yield from held.batches(True)

        found = kept(candidates(postings, asked))
        rows = with_semantic(units.filter(covered(found)), semantic, deal=False)
        dealt = found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk_id")  # verifying is much work for few bytes
        made = rows.join(dealt.hint("merge"), "chunk_id").select("chunk_id", "doc_name", "t", "semantic", "asked", "bound").mapInArrow(task, HITS)
        out = made if out is None else out.unionByName(made)
    return spark.createDataFrame([], HITS) if out is None else out
