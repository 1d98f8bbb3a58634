"""Substring search for the tokens of many questions: what counts as a hit, and how few rows a task sends.

Full phrase of two or more tokens .75, all tokens .65, three quarters of three or more .60, half of two or more .55.
With ``least``, so many found tokens make a hit whatever their share (score 0 below one half). Questions are a stated
set, taken in blocks. ``Best`` says which hits are wanted; a task then sends only those that can still be among them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.sources.scratch import if_small, kept, spread

HITS = "query_id long, chunk_id long, n_found long, score double"
#: Tokens of a text's questions from which one automaton is quicker than a search for each.
MANY_TOKENS = 64
#: Texts whose counts are added up together: this many times the questions of a block are held.
AT_ONCE = 128
#: Hits that a task holds before it drops those that cannot be wanted.
HELD = 1 << 18
#: A hit this little below the bar is still held until its key is compared in whole digits.
SLACK = 2e-6


@dataclass(frozen=True)
class Best:
    """The ``most`` best hits of a question, of these ``per_doc`` of a document at most.

    ``key`` gives what they are ordered by, from (n_found, score, semantic score); ties go to smaller ids. Dropping within a task
    is safe: of the documents that beat a hit there, as many of their hits beat it in the whole.
    """

    most: int
    per_doc: int | None = None
    key: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] = field(default=lambda n, score, semantic: score)


class Lists:
    """Lists of questions by word, end to end."""

    def __init__(self, lists: list[list[int]]):
        self.size = np.array([len(x) for x in lists], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)[:-1])).astype(np.int64) if lists else np.zeros(0, np.int64)
        self.flat = np.array([q for x in lists for q in x], np.int64)

    def counts(self, text: np.ndarray, word: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        """How many of a text's words have a question on their list."""
        n = self.size[word]
        at = np.repeat(self.start[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(np.repeat(text, n) * shape[1] + self.flat[at], minlength=shape[0] * shape[1]).reshape(shape)


class Asked:
    """A block of questions: their tokens, and what a number of found tokens is worth."""

    def __init__(self, rows: list[tuple[int, list[str]]], least: int | None):
        self.ids = np.array([q for q, _ in rows], np.int64)
        self.tokens, self.least = [toks for _, toks in rows], least
        self.size = np.array([len(toks) for toks in self.tokens], np.int64)
        self.phrases = [" ".join(toks) if len(toks) > 1 else None for toks in self.tokens]
        self.number: dict[str, int] = {}
        for s in (*(t for toks in self.tokens for t in toks), *(p for p in self.phrases if p)):
            self.number.setdefault(s, len(self.number))
        self.words = list(self.number)
        having: list[list[int]] = [[] for _ in self.words]
        whole: list[list[int]] = [[] for _ in self.words]
        for q, toks in enumerate(self.tokens):
            for t in toks:
                having[self.number[t]].append(q)
            if self.phrases[q]:
                whole[self.number[self.phrases[q]]].append(q)
        self.having, self.whole = Lists(having), Lists(whole)
        self.wanted = [frozenset(self.number[w] for w in (*toks, *filter(None, [phrase]))) for toks, phrase in zip(self.tokens, self.phrases, strict=True)]
        half = np.where(self.size == 1, 1, -(-self.size // 2))
        self.need = half if least is None else np.minimum(half, least)

    def score(self, q: np.ndarray, count: np.ndarray) -> np.ndarray:
        n = self.size[q]
        share = count / n
        return np.select([share == 1, (share >= 0.75) & (n >= 3), (share >= 0.5) & (n >= 2)], [0.65, 0.60, 0.55], 0.0)

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for i, s in enumerate(self.words):
            machine.add_word(s, i)
        machine.make_automaton()
        return machine

    def hits(self, found: list[set[int]], only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, question, number of tokens, score) of texts that have these words; ``only`` marks the pairs that are asked for."""
        text = np.repeat(np.arange(len(found)), [len(f) for f in found])
        word = np.fromiter((v for f in found for v in f), np.int64, len(text))
        shape = len(found), len(self.ids)
        count = self.having.counts(text, word, shape)
        wanted = count > 0 if only is None else (count > 0) & only
        text_of, q = np.nonzero(wanted)
        n = count[text_of, q]
        score = self.score(q, n)
        score[self.whole.counts(text, word, shape)[text_of, q] > 0] = 0.75
        use = score > 0 if self.least is None else (score > 0) | (n >= self.least)
        return text_of[use], q[use], n[use], score[use]


class Held:
    """The hits of a task, cut down to those that ``best`` can want."""

    def __init__(self, asked: Asked, best: Best | None):
        self.asked, self.best, self.parts, self.n = asked, best, [], 0
        self.documents: dict[str | None, int] = {}
        self.bar = np.full(len(asked.ids), -np.inf)

    def add(self, chunks: list[int], documents: list[str | None], hits: tuple[np.ndarray, ...], semantic: list[dict[int, float] | None]) -> None:
        """Hits of some texts. ``semantic``: for each text, its scores by question id."""
        text, q, count, score = hits
        near = np.zeros(len(q))
        for t in [t for t, s in enumerate(semantic) if s]:
            mine = np.flatnonzero(text == t)
            near[mine] = [semantic[t].get(i, 0.0) for i in self.asked.ids[q[mine]].tolist()]
        key = np.round(self.best.key(count, score, near), 6) if self.best else score
        use = key >= self.bar[q] - SLACK
        number = np.array([self.documents.setdefault(d, len(self.documents)) for d in documents], np.int64)
        if use.any():
            self.parts.append((q[use], np.array(chunks, np.int64)[text[use]], count[use], score[use], key[use], number[text[use]]))
            self.n += int(use.sum())

    def cut(self) -> None:
        q, chunk, count, score, key, document = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        keep, exact = np.arange(len(q)), six_digits(key)
        if self.best.per_doc:
            keep = keep[leading((q, document), exact, chunk, self.best.per_doc)]
        keep = keep[leading((q[keep],), exact[keep], chunk[keep], self.best.most)]
        self.parts, self.n = [(q[keep], chunk[keep], count[keep], score[keep], key[keep], document[keep])], len(keep)
        order = np.lexsort((-key[keep], q[keep]))
        which, at = np.unique(q[keep][order], return_index=True)
        full = np.diff(np.append(at, len(order))) >= self.best.most
        self.bar[which[full]] = key[keep][order][at[full] + self.best.most - 1]

    def batches(self, last: bool) -> Iterator[pa.RecordBatch]:
        """What can be sent now: all of it without ``best``, else nothing before the end."""
        if self.parts and self.best and (last or self.n > HELD):
            self.cut()
        if self.parts and (last or not self.best):
            q, chunk, count, score = (np.concatenate(x) for x in list(zip(*self.parts, strict=True))[:4])
            self.parts, self.n = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(self.asked.ids[q]), pa.array(chunk), pa.array(count.astype(np.int64)), pa.array(score)], ["query_id", "chunk_id", "n_found", "score"])


def six_digits(key: np.ndarray) -> np.ndarray:
    """Millionths, halves rounded up as Spark's ``round`` does, so that a task and Spark see the same ties. Distinct keys are few."""
    value, back = np.unique(key, return_inverse=True)
    return np.array([int((Decimal(repr(v)) * 1_000_000).quantize(Decimal(1), ROUND_HALF_UP)) for v in value.tolist()], np.int64)[back]


def leading(groups: tuple[np.ndarray, ...], key: np.ndarray, chunk: np.ndarray, most: int) -> np.ndarray:
    """Rows that are among the first ``most`` of their group: largest key, then smallest chunk."""
    order = np.lexsort((chunk, -key, *groups[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for g in groups:
        new[1:] |= g[order][1:] != g[order][:-1]
    start = np.flatnonzero(new)
    return order[np.arange(len(order)) - start[np.cumsum(new) - 1] < most]


def blocks_of(queries: DataFrame, block: int, least: int | None) -> Iterator[Asked]:
    rows = queries.select("query_id", "toks").filter(F.size("toks") > 0).toLocalIterator()
    while some := [(r[0], r[1]) for r in islice(rows, block)]:
        yield Asked(some, least)


def with_semantic(units: DataFrame, semantic: DataFrame | None, deal: bool = True) -> DataFrame:
    """chunk_id, doc_name, t (lower case) and semantic (hits of the chunk, at most one a question)."""
    name = F.col("doc_name") if "doc_name" in units.columns else F.lit(None).cast("string")
    plain = units.select("chunk_id", name.alias("doc_name"), F.lower("text").alias("t"))
    plain = spread(plain) if deal else plain
    if semantic is None:
        return plain.withColumn("semantic", F.lit(None).cast("array<struct<query_id:bigint,score:double>>"))
    by_chunk = semantic.groupBy("chunk_id").agg(F.collect_list(F.struct("query_id", "score")).alias("semantic"))
    return plain.join(if_small(by_chunk), "chunk_id", "left").select("chunk_id", "doc_name", "t", "semantic")


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """AT_ONCE texts at a time."""
    for b in batches:
        for at in range(0, b.num_rows, AT_ONCE):
            yield b.slice(at, AT_ONCE)


def by_question(cell: pa.Scalar) -> dict[int, float] | None:
    return {x["query_id"]: x["score"] for x in cell.as_py()} if cell.is_valid else None


def scan(units: DataFrame, queries: DataFrame, block: int = 5_000, least: int | None = None, best: Best | None = None, semantic: DataFrame | None = None) -> DataFrame:
    """HITS of (query_id, toks) over (chunk_id, text, doc_name if documents count): every text is read once for all questions of a block.

    ``semantic`` (query_id, chunk_id, score) is only for the key of ``best``. Without it no row is sent anywhere before its hits are.
    """
    rows, out = with_semantic(units, semantic), None
    for asked in blocks_of(queries, block, least):

        def task(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            machine, held = asked.automaton(), Held(asked, best)
            for b in pieces(batches):
                found = [{v for _, v in machine.iter(t.as_py())} if t.is_valid else set() for t in b.column(2)]
                held.add(b.column(0).to_pylist(), b.column(1).to_pylist(), asked.hits(found), [by_question(x) for x in b.column(3)])
                yield from held.batches(False)
            yield from held.batches(True)

        made = rows.mapInArrow(task, HITS)
        out = made if out is None else out.unionByName(made)
    return units.sparkSession.createDataFrame([], HITS) if out is None else out


def best_hits(hits: DataFrame, best: Best, key, units: DataFrame | None = None) -> DataFrame:
    """What ``best`` asks for, of the tasks' candidates: (query_id, chunk_id, score) with ``key`` as the score."""
    s = hits.withColumn("score", key)
    if best.per_doc:
        s = s.join(units.select("chunk_id", "doc_name"), "chunk_id")
        s = s.withColumn("rn", F.row_number().over(W.partitionBy("query_id", "doc_name").orderBy(F.desc("score"), "chunk_id"))).filter(F.col("rn") <= best.per_doc)
    return s.withColumn("rn", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).filter(F.col("rn") <= best.most).select("query_id", "chunk_id", "score")


def fused(units: DataFrame, queries: DataFrame, semantic: DataFrame, weight: float, k: int, block: int = 5_000, find=scan) -> DataFrame:
    """(query_id, chunk_id, score): keyword hits, raised by a share of the semantic score where there is one; the k best of a question.

    The few semantic hits travel to the texts, and a task sends k hits of a question; ``find`` is ``scan`` or a search of postings.
    """
    best = Best(k, None, lambda n, score, near: score + weight * near)
    semantic = kept(semantic.select("query_id", "chunk_id", "score"))  # used twice
    near = semantic.withColumnRenamed("score", "__near")
    found = find(units, queries, block, best=best, semantic=semantic).join(near, ["query_id", "chunk_id"], "left")
    return best_hits(found, best, F.round(F.col("score") + F.coalesce(weight * F.col("__near"), F.lit(0.0)), 6))


def lexical(units: DataFrame, queries: DataFrame, per_doc: int = 3, most: int = 80, block: int = 5_000, find=scan) -> DataFrame:
    """(query_id, chunk_id, score) by words alone: two or more of a question's tokens, ``per_doc`` hits a document, ``most`` a question."""
    base = lambda n: 0.4 + np.minimum(0.28, 0.05 * n)
    best = Best(most, per_doc, lambda n, score, near: np.where(score == 0.75, np.maximum(0.62, base(n)), base(n)))
    found = find(units, queries, block, least=2, best=best).filter("n_found >= 2")
    plain = F.lit(0.4) + F.least(F.lit(0.28), F.lit(0.05) * F.col("n_found"))
    return best_hits(found, best, F.round(F.when(F.col("score") == 0.75, F.greatest(F.lit(0.62), plain)).otherwise(plain), 6), units)
