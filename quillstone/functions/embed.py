"""The embedder: a pluggable function from texts to vectors, with a deterministic offline default."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]


def mixed(x: np.ndarray) -> np.ndarray:
    """Every 64-bit number sent to another by multiplying and folding, so that all its bits count."""
    for by in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(by)
    return x ^ (x >> np.uint64(32))


def hashed_ngrams(texts: list[str], size: int = 64) -> np.ndarray:
    """Unit vectors of signed, hashed character 3-grams, all texts of a batch at once. Every text has at least the two spaces put around it; one without a 3-gram is all zeros."""
    around = [f" {t.lower()} " for t in texts]
    code = np.frombuffer("".join(around).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(t) for t in around], dtype=np.int64)
    out = np.zeros((len(texts), size))
    if len(code) > 2:
        owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        inside = owner[:-2] == owner[2:]
        h = mixed((code[:-2] << np.uint64(42) | code[1:-1] << np.uint64(21) | code[2:])[inside])
        at = owner[:-2][inside] * size + (h % np.uint64(size)).astype(np.int64)
        out = np.bincount(at, np.where(h >> np.uint64(63), 1.0, -1.0), len(texts) * size).reshape(len(texts), size)
    return (out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-12)).astype(np.float32)


def char_batches(texts: list[str], most: int = 40_000) -> Iterator[list[str]]:
    """Batches in order, each at most ``most`` characters or one text."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def retried(embedder: Embedder, tries: int = 4, wait: float = 0.8, sleep: Callable[[float], None] = time.sleep) -> Embedder:
    """An embedder that is called again when it fails: after ``wait`` seconds, then twice as long each time. What fails ``tries`` times, or gives another number of vectors than of texts, raises."""

    def call(texts: list[str]) -> np.ndarray:
        for n in range(max(1, tries)):
            try:
                made = embedder(texts)
                if len(made) != len(texts):
                    raise ValueError(f"{len(made)} vectors of {len(texts)} texts")
                return made
            except Exception as e:  # noqa: BLE001 - whatever a remote model raises
                last = e
                if n + 1 < tries:
                    sleep(wait * 2**n)
        raise RuntimeError(f"embedding failed {max(1, tries)} times: {last}") from last

    return call


def embedded(text: Column, embedder: Embedder = hashed_ngrams, most_chars: int = 12_000, mark_failed: bool = False) -> Column:
    """array<float> of the stripped text's first ``most_chars`` characters (a model's input limit). Null embeds as empty.

    An embedder that raises fails the task, and Spark tries it again; with ``mark_failed`` the texts of that batch get null instead,
    so that one of them does not hold up all others (``plans.ingest.embedded_rows`` splits them off).
    """

    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = [(t or "").strip()[:most_chars] for t in s]
            made: list[np.ndarray | None] = []
            for batch in char_batches(texts):
                try:
                    made += [np.asarray(v, np.float32) for v in embedder(batch)]
                except Exception:  # noqa: BLE001
                    if not mark_failed:
                        raise
                    made += [None] * len(batch)
            yield pd.Series(made, dtype=object)

    vectors.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(vectors, "array<float>")(text)
