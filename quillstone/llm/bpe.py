"""Byte-level BPE: encoding by tree concatenation, and decoding.

The codec is read from a ``tokenizers`` JSON file (its path is a parameter) and
gives what that library gives with add_special_tokens=False. A text goes through
three steps:

1. Strings of added tokens are cut out.
2. What is longer than ``leaf`` characters is halved until its parts fit: at a single
   space without white space beside it near the middle, where there is one (a pre-token
   always ends there, so that join needs no repair), else right in the middle. The leaves
   of all texts of a block are encoded together, in parallel.
3. Neighbours are joined pairwise up the tree. Around a join, a window of whole
   tokens is encoded again and grows until its first tokens are the left side's
   and its last tokens are the right side's; then the window replaces what it
   covers. A window that reaches an end of its side needs no agreement there, so
   the last resort is encoding both sides whole.

Why agreement is enough: a token sequence is the BPE encoding of its bytes exactly
if each pair of neighbours is one; the left part, the window and the right part
overlap by whole tokens, so each pair lies inside one of the three encodings.

Defined results: null and empty texts have no tokens; repeated rows are encoded
each; extra columns stay where ``keep`` names them; an empty table gives no rows. A very
long text is one tree like any other, whether it has spaces or not.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillstone.llm._shared import blocks, selected, table

#: Characters of a leaf. Longer texts go through the tree.
LEAF = 1 << 12
AGREE = 2
#: How the ByteLevel pre-tokenizer splits a text. Fixed values.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def _byte_alphabet() -> dict[str, int]:
    """Character of the file's vocabulary -> byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    def __init__(self, path: str, leaf: int = LEAF, threads: int = 2):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        merged = [spec["model"]["vocab"]["".join(m)] for m in merges]
        if merged != sorted(merged) or spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: not a byte-level BPE whose ids follow its merges")
        self.bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})
        self.bytes = [b""] * (max(spec["model"]["vocab"].values(), default=0) + 1)
        for token, i in vocab.items():
            self.bytes[i] = token
        for token, i in self.added.items():
            self.bytes += [b""] * (i + 1 - len(self.bytes))
            self.bytes[i] = token.encode()
        self.shown = [str(i) for i in range(len(self.bytes))]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.leaf, self.threads = max(2, leaf), threads

    def _plain(self, text: str) -> list[int]:
        return self.bpe.encode_ordinary(text)

    def halves(self, text: str) -> int:
        """Where to cut: the first safe place in the middle half of the text, from its third eighth on, else the middle."""
        n = len(text)
        at = _SAFE.search(text, n * 3 // 8, n * 3 // 4)
        return at.start() if at else n // 2

    def leaves(self, text: str) -> list[str]:
        """The text in order, in parts of at most ``leaf`` characters."""
        parts, todo = [], [text]
        while todo:
            p = todo.pop()
            if len(p) > self.leaf:
                at = self.halves(p)
                todo += [p[at:], p[:at]]
            else:
                parts.append(p)
        return parts

    def joined_up(self, ids: list[list[int]]) -> list[int]:
        """The encoding of a text from those of its leaves, pairwise up the tree."""
        while len(ids) > 1:
            ids = [self.join(ids[i], ids[i + 1]) if i + 1 < len(ids) else ids[i] for i in range(0, len(ids), 2)]
        return ids[0]

    def encode_trees(self, texts: list[str]) -> list[tuple[list[int], int]]:
        """Tree concatenation of each text: its ids, and how many joins it took. All leaves are encoded at once."""
        parts = [self.leaves(t) if t else [] for t in texts]
        flat = iter(self.bpe.encode_ordinary_batch([x for p in parts for x in p], num_threads=self.threads))
        return [(self.joined_up([next(flat) for _ in p]) if p else [], max(0, len(p) - 1)) for p in parts]

    def _whole_chars(self, ids: list[int], n: int, last: bool) -> int:
        """The least count >= n of tokens at one end of ids that begins and ends between characters."""
        while n < len(ids):
            edge = self.bytes[ids[-n] if last else ids[n]]
            if edge and edge[0] & 0xC0 != 0x80:
                return n
            n += 1
        return len(ids)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring texts from their encodings."""
        n = 8
        while left and right:
            a, b = self._whole_chars(left, n, True), self._whole_chars(right, n, False)
            window = self._plain(b"".join([self.bytes[i] for i in left[len(left) - a :] + right[:b]]).decode())
            k = min(AGREE, len(window))
            if (a == len(left) or window[:k] == left[len(left) - a :][:k]) and (b == len(right) or window[-k:] == right[:b][-k:]):
                return left[: len(left) - a] + window + right[b:]
            n *= 2
        return left or right

    def encode_all(self, texts: list[str | None]) -> list[tuple[list[int], int]]:
        """(ids, joins) of each text."""
        plain, layout = [], []
        for text in texts:
            row, start = [], 0
            for m in self.cut.finditer(text) if self.cut and text else ():
                row += [len(plain), -self.added[m[0]] - 1]
                plain.append(text[start : m.start()])
                start = m.end()
            layout.append([*row, len(plain)])
            plain.append((text or "")[start:])
        made = self.encode_trees(plain)
        out = []
        for row in layout:
            if len(row) == 1:
                out.append(made[row[0]])
            else:
                out.append(([i for x in row for i in (made[x][0] if x >= 0 else [-x - 1])], sum(made[x][1] for x in row if x >= 0)))
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0][0]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")

    def joined(self, ids: list[int]) -> str:
        return ",".join([self.shown[i] for i in ids])


@lru_cache(4)
def codec(path: str, leaf: int = LEAF) -> Codec:
    """One codec per Python worker."""
    return Codec(path, leaf)


KINDS = {"n_tokens": ("long", pa.int64()), "n_joins": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}


def transcode(df: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), want: tuple[str, ...] = ("n_tokens", "ids"), text: str = "text", leaf: int = LEAF) -> DataFrame:
    """The ``keep`` columns and what ``want`` names: n_tokens, n_joins (of the text's tree), ids, decoded, ids_sha256, decoded_sha256."""

    rows, column = selected(df, keep, text)

    def task(batches):
        c = codec(path, leaf)
        for batch, texts in blocks(batches, column):
            made: dict[str, list] = {w: [] for w in want}
            for ids, joins in c.encode_all([x.decode("utf-8", "replace") for x in texts]):
                decoded = c.decode(ids) if "decoded" in made or "decoded_sha256" in made else ""
                for w, values in made.items():
                    if w == "n_tokens":
                        values.append(len(ids))
                    elif w == "n_joins":
                        values.append(joins)
                    elif w == "ids":
                        values.append(np.asarray(ids, np.int32))
                    elif w == "decoded":
                        values.append(decoded)
                    elif w == "ids_sha256":
                        values.append(hashlib.sha256(c.joined(ids).encode()).hexdigest())
                    else:
                        values.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(made[w], KINDS[w][1]) for w in want], [*keep, *want])

    fields = df.select(*keep).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{w} {KINDS[w][0]}" for w in want])
    return rows.mapInArrow(task, schema)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents``; ``n_joins`` counts the joins of its tree."""
    return transcode(table(spark, sf_dir, "documents"), vocabulary(), want=("n_tokens", "ids_sha256", "decoded_sha256", "n_joins"))
