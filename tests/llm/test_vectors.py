"""Vector codes and whitening against exact and plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest

from quillstone.llm import codes, whitening
from quillstone.llm._vectors import floors

NAN, INF = float("nan"), float("inf")


def plain_codes(vectors, parts, entries, rounds):
    """vectors: [(id, ints)] in order of id. Python integers throughout."""
    width = len(vectors[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v in vectors[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for _, v in vectors:
                held.setdefault(near(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            for i, xs in held.items():
                books[p][i] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = {i: [near(x, b) for x, b in zip(cut(v), books, strict=True)] for i, v in vectors}
    return {i: ("".join(f"{n:02x}" for _, n in f), sum(d for d, _ in f)) for i, f in found.items()}, books


def table(spark, folder, rows, kind="double"):
    spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, code string, component int, x int").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def odd(rng, n, width, scale):
    rows = [(3 * i + 1, [rng.gauss(0, 1) for _ in range(width)], i % 3 if i % 5 else None) for i in range(n)]
    rows += [(1000 + i, list(rows[0][1]), 1) for i in range(40)]  # a group of copies
    rows += [(0, [-1 / scale, -0.5 / scale, -0.0, *[0.5] * (width - 3)], 2)]
    rows += [(2, None, 1), (5, [None, *[0.0] * (width - 1)], 1), (8, [NAN, *[0.0] * (width - 1)], 1), (11, [INF, *[0.0] * (width - 1)], 2), (14, [*[0.0] * (width - 1), -INF], 2)]
    return [(*r, "k", 9, 5) for r in rows]


@pytest.mark.parametrize("n", [7, 300])
def test_codes(spark, tmp_path, n):
    rows = odd(random.Random(2), n, 8, 1024)
    kept = sorted((i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v))
    want, books = plain_codes(kept, 4, 256, 4)
    got = {r.vec_id: r for r in codes.op12_codes(spark, table(spark, tmp_path, rows)).collect()}
    assert {i: (r.code, r.error) for i, r in got.items()} == want
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    assert {r.codebooks_sha256 for r in got.values()} == {sha}
    labels = {i: g for i, _, g, *_ in rows}
    assert all(r.label_error == sum(e for j, (_, e) in want.items() if labels[j] == labels[i]) for i, r in got.items())


def test_nearest_is_exact_where_float32_is_not():
    rng = np.random.default_rng(1)
    for reach in (3, 1 << 10, 1 << 24, 1 << 28):
        book = rng.integers(-reach, reach, (64, 16))
        x = np.concatenate([book[rng.integers(0, 64, 200)] + rng.integers(-1, 2, (200, 16)), rng.integers(-reach, reach, (200, 16))])
        book[40], book[41] = book[3], book[7] + np.eye(16, dtype=int)[0]
        index, distance = codes.nearest(x, book)
        exact = ((x[:, None, :] - book[None]) ** 2).sum(2)
        assert (index == exact.argmin(1)).all() and (distance == exact.min(1)).all()


def test_codes_of_odd_widths(spark, tmp_path):
    rows = [(i, [float(i), 1.0, 2.0, 3.0, 4.0], None, "", 0, 0) for i in range(5)] + [(9, [1.0], 1, "", 0, 0), (10, [1e30, 0.0, 0.0, 0.0, 0.0], 2, "", 0, 0)]
    got = {r.vec_id: r for r in codes.op12_codes(spark, table(spark, tmp_path, rows, "float")).collect()}
    assert [(got[i].code, got[i].error, got[i].label_error) for i in (9, 10)] == [(None, None, None)] * 2
    # only the first part (two components) differs; ties go to the lower index, and unused entries stay
    assert [got[i].code for i in range(5)] == [f"{i:02x}000000" for i in range(5)] and all(got[i].error == 0 for i in range(5))


def test_floors_go_down(spark):
    df = spark.createDataFrame([([-0.5 / 1024, -0.0, 1.5 / 1024, -3.0],)], "embedding array<float>").select(floors(1024).alias("x"))
    assert df.first().x == [-1, 0, 1, -3072]


@pytest.mark.parametrize("name", ["op12", "op13"])
@pytest.mark.parametrize("rows", [[], [(1, None, 1, "", 0, 0)]])
def test_no_vectors(spark, tmp_path, name, rows):
    query = {"op12": codes.op12_codes, "op13": whitening.op13_whitening}[name]
    assert query(spark, table(spark, tmp_path, rows)).collect() == []


@pytest.mark.parametrize("n,width,fan", [(300, 8, 2), (40, 64, 16), (5, 3, 16)])
def test_whitening(spark, tmp_path, monkeypatch, n, width, fan):
    monkeypatch.setattr(whitening, "FAN_IN", fan)
    monkeypatch.setattr(whitening, "BLOCK", 20 * width)
    rows = odd(random.Random(4), n, width, 256)
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    fit = np.array(sorted({tuple(v) for _, v in kept}))
    total, m = fit.sum(0), len(fit)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    got = {(r.vec_id, r.component): r for r in whitening.op13_whitening(spark, table(spark, tmp_path, rows)).collect()}
    k = min(4, width)
    assert set(got) == {(i, c + 1) for i, _ in kept for c in range(k)}
    sign = [1] * k
    for c in range(k):
        z = {i: (np.array(v) - total / m) @ axes[:, c] / math.sqrt(values[c]) for i, v in kept}
        sign = np.sign(sum(z[i] * got[i, c + 1].whitened for i, _ in kept))
        for i, v in kept:
            r = got[i, c + 1]
            assert r.n == m and r.deviation == sum((m * int(x) - int(s)) ** 2 for x, s in zip(v, total, strict=True))
            assert abs(r.whitened - sign * z[i]) < 1e-9 and abs(r.explained / (values[c] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9


def test_merging_keeps_every_dimension():
    x = np.random.default_rng(0).normal(size=(500, 12)) * np.logspace(0, -6, 12) + 100
    found = None
    for part in np.array_split(x, 23):
        found = whitening.merged(found, whitening.summary(part)) if found else whitening.summary(part)
    n, mean, r = found
    off = x - x.mean(0)
    assert n == 500 and np.allclose(mean, x.mean(0)) and r.shape == (12, 12)
    assert np.allclose(np.linalg.svd(r)[1], np.linalg.svd(off)[1], rtol=1e-6)


def test_no_variance(spark, tmp_path):
    rows = [(1, [1.0, 2.0], 0, "", 0, 0), (1, [1.0, 2.0], 0, "", 0, 0), (None, [1.0, 2.0], 0, "", 0, 0), (4, [3.0], 0, "", 0, 0), (5, [1e300, 0.0], 0, "", 0, 0)]
    got = sorted(map(tuple, whitening.op13_whitening(spark, table(spark, tmp_path, rows)).collect()), key=repr)
    flat = [(i, c, 1, 0, None, None, None) for i in (1, 1, None) for c in (1, 2)]
    assert got == sorted(flat + [(i, c, 1, None, None, None, None) for i in (4, 5) for c in (1, 2)], key=repr)
    (tmp_path / "two").mkdir()
    two = [(1, [1.0, 2.0, 0.0], 0, "", 0, 0), (2, [2.0, 2.0, 0.0], 0, "", 0, 0)]
    got = sorted(map(tuple, whitening.op13_whitening(spark, table(spark, tmp_path / "two", two)).collect()))
    assert [(i, c, round(abs(w), 9) if w is not None else None, e) for i, c, _, _, w, e, _ in got] == [(i, c, 1.0 if c == 1 else None, 1.0 if c == 1 else 0.0) for i in (1, 2) for c in (1, 2, 3)]
