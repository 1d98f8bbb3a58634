"""Encoding and decoding against the library itself, with leaves small enough that trees and joins are used."""

import functools
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
pieces = st.lists(st.one_of(st.text(max_size=6), st.sampled_from(["'s", "'ll", "'", "  ", "\n\n", " \t", "the", " the", "éé", "ß", "日本", "😀", "123", "!!", "<|endoftext|>", "aaaa", "\u0085", "\x1c", "\xa0", "abc" * 9])), max_size=30).map("".join)


@functools.lru_cache
def library():
    return tokenizers.Tokenizer.from_file(bpe.vocabulary())


@functools.lru_cache
def ours(leaf):
    return bpe.Codec(bpe.vocabulary(), leaf)


@settings(max_examples=400, deadline=None)
@given(pieces, st.sampled_from([2, 3, 7, 16, 1 << 16]))
def test_same_ids_and_text_as_the_library(text, leaf):
    want = library().encode(text, add_special_tokens=False).ids
    assert ours(leaf).encode(text) == want
    assert ours(leaf).decode(want) == library().decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3001, " " * 4000, "x" + " \n" * 2000 + "y", "日本語" * 900, "1234567890" * 400, "a'sb" * 700, "-=" * 1500 + "'s" * 300, "thequickbrown" * 300])
def test_long_unsplit_text(text):
    assert ours(64).encode(text) == library().encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=20))
def test_decode_of_any_ids(ids):
    assert ours(64).decode(ids) == library().decode(ids, skip_special_tokens=False)


def test_long_texts_of_a_table_go_through_the_tree(spark, tmp_path):
    """Long texts with and without spaces, through the query, with its own leaf size."""
    rng = random.Random(9)
    words = " ".join("".join(rng.choice("abcdé ñ") for _ in range(rng.randrange(1, 9))).strip() + rng.choice(["", "\n", " ", ".", "'s"]) for _ in range(9000))
    rows = [(1, "a" * 50_000), (2, "ab1" * 30_000), (3, words), (4, "日本語" * 9000), (5, " " * 20_000 + "x"), (6, "short text"), (7, words.replace(" ", "") + "<|endoftext|>" + words)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in bpe.op10_bpe(spark, str(tmp_path)).collect()}
    for i, text in rows:
        ids = library().encode(text, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].n_joins >= -(-len(text) // bpe.LEAF) - 2 and (got[i].n_joins > 0) == (i != 6)


def test_whole_table_like_the_library(spark):
    """sf0.1: every row equals the library's, and thousands of texts are joined from leaves."""
    folder = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in bpe.op10_bpe(spark, folder).collect()}
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    for start in range(0, len(texts), 500):
        some = texts[start : start + 500]
        for r, e in zip(some, library().encode_batch([r.text or "" for r in some], add_special_tokens=False), strict=True):
            assert rows[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, e.ids)).encode()).hexdigest()
    assert sum(r.n_joins > 0 for r in rows.values()) > 100


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert bpe.op10_bpe(spark, str(tmp_path)).collect() == []


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello  world", "x"), (3, "Hello  world", "x"), (None, "<|endoftext|>a", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((repr(r[0]), *r[1:4]) for r in bpe.op10_bpe(spark, str(tmp_path)).collect())
    want = []
    for i, text, _ in rows:
        ids = library().encode(text or "", add_special_tokens=False).ids
        want.append((repr(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
