"""Mapped files stay few, however many ranges a model or a sketch has."""

import os
import random
import resource

import numpy as np
import pytest

from quillstone.llm import files, lm, substrings
from tests.llm import brute


@pytest.fixture
def few_descriptors():
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (256, hard))
    yield
    resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))


def test_arrays_come_back(tmp_path):
    made = {"keys": np.arange(7, dtype=np.uint64), "none": np.zeros(0, np.uint8), "big": np.array([2**62, -1])}
    files.save_arrays(f"{tmp_path}/deep/er/x", **made)
    got = files.open_arrays(f"{tmp_path}/deep/er/x")
    assert all((got[k] == v).all() and got[k].dtype == v.dtype for k, v in made.items())
    assert files.open_arrays(f"{tmp_path}/absent") is None


def test_maps_are_bounded(tmp_path, few_descriptors):
    for i in range(300):
        files.save_arrays(f"{tmp_path}/{i}", v=np.array([i]))
    maps = files.Maps()
    for _ in range(2):
        assert [int(maps.get(f"{tmp_path}/{i}")["v"][0]) for i in range(300)] == list(range(300))
    assert len(maps.held) == maps.most == 64
    assert sum(str(tmp_path) in line for line in open("/proc/self/maps")) <= 64


def test_model_of_many_ranges(spark, monkeypatch, few_descriptors):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(lm, "n_ranges", lambda docs: (300, 0))
    model = lm.fit(docs)
    assert sum(os.path.isfile(f"{model.folder}/{f}") for f in os.listdir(model.folder)) > 600
    made = lm.Reader(model).score([t.encode() for t in texts])
    p, raw = brute.kneser_ney([[*brute.words(t), "</s>"] for t in texts], 2, lm.discounts)
    for i, t in enumerate(texts):
        z = ["<s>", *brute.words(t), "</s>"]
        assert abs(made["score"][i] - sum(np.log10(p((a, b))) for a, b in zip(z, z[1:], strict=False))) < 1e-6
    assert model.n_words == len(raw)


def test_sketch_of_many_slices(spark, monkeypatch, tmp_path, few_descriptors):
    rng = random.Random(9)
    shared = " ".join(f"s{i}" for i in range(20))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) + (f" {shared}" if i % 2 else "")) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(substrings, "SLICE_BITS", 13)
    monkeypatch.setattr(substrings, "cell_bits", lambda *a: 13 + 8)  # 2 rows of 256 slices
    folder = str(tmp_path)
    assert substrings.merge_sketches(substrings.partial_sketches(docs, 13, 21), folder, 21) > 200
    h = np.array([rng.getrandbits(64) for _ in range(5000)], np.uint64)
    assert substrings.maybe_repeated(h, folder, 21).mean() < 0.01
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeated(docs).collect()}
    assert got == {i: (n, gone, kept) for i, n, gone, kept in brute.without_repeats(rows)}
