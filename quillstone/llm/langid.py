"""Language identification by hierarchical discrimination.

Features are relative frequencies of hashed byte 2- and 3-grams of the lower-cased
text. A first linear support vector machine (one against the rest where there are
more than two families) predicts the language family; inside a family, one machine
for each pair of languages votes. Only whole texts are read, in training and in
prediction; ``lang``, ``source`` and the id never enter a prediction.

Training uses a bounded sample of the rows that are allowed: the ``per_lang`` documents
of each language (300 by default) whose hash of id and text is least. Rows that repeat
count once, so neither copies nor missing ids can fill it. Every language is learned: where
there are many, ``most_rows`` rows (9,000 by default) are divided among them, one a language
at least. The languages themselves are taken to be a list of codes (a row of each reaches the
driver). The model is a matrix of (families + pairs) x (bins + 1) floats and goes out with the task.

Defined results: null text, and text without a letter, gives ``und`` with score 0; so
does every text when there is nothing to learn from (an empty table, or no ``lang``). A
language that is not in ``FAMILIES`` is a family of its own. Ties go to the family, and to the
language, that comes first by code point. Repeated rows are predicted each, and a null id is an id
like others. A text of any length is read whole, in pieces of PIECE bytes. Extra columns stay
where ``keep`` names them and are ignored otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm._kernels import LOWER
from quillstone.llm._shared import SPAN, blocks, crc_mod, least_hash, selected, table

UND = "und"
BITS = 12
BINS = 1 << BITS
PIECE = 1 << 22
#: Families of common ISO 639-1 codes. Fixed values.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl".split(),
    "indic": "hi bn ur pa mr gu ne si".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "uralic": "fi et hu".split(),
    "semitic": "ar he mt am".split(),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower(), f"only {lang}")


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of the 2- and 3-grams that begin at each byte of a text and the space after it (BINS where there is none), and where each text begins."""
    buf = LOWER[np.frombuffer(b" ".join(texts) + b"   ", np.uint8)].astype(np.uint32)
    sizes = np.fromiter((len(x) for x in texts), np.int64, len(texts))
    first = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int64)
    n = int(sizes.sum() + len(texts))
    two = (buf[:n] << np.uint32(8)) | buf[1 : n + 1]
    three = (two << np.uint32(8)) | buf[2 : n + 2]
    two = ((two + np.uint32(1 << 25)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    three = (three * np.uint32(2246822519)) >> np.uint32(32 - BITS)
    last = first + sizes
    two[last] = three[last] = BINS
    some = sizes > 0
    three[(last - 1)[some]] = BINS
    return two, three, first


def profile(text: bytes) -> np.ndarray:
    """Relative frequencies over BINS of one whole text."""
    total = np.zeros(BINS + 1)
    for i in range(0, max(1, len(text)), PIECE):
        for bins in grams([text[i : i + PIECE + 2]])[:2]:
            total += np.bincount(bins if i + PIECE >= len(text) else bins[:PIECE], minlength=BINS + 1)
    total[BINS] = 0
    return (total[:BINS] / max(1.0, total.sum())).astype(np.float32)


def has_letter(text: bytes) -> bool:
    return bool(_LETTER[np.frombuffer(text, np.uint8)].any()) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 150) -> tuple[np.ndarray, float, float]:
    """Weights, bias and scale of a linear machine with squared hinge loss, y being +1 or -1 with equal total weight."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    bound = 2 * float((weight * ((x**2).sum(1) + 1)).sum()) + penalty
    w, b, prev = np.zeros(x.shape[1], np.float32), 0.0, None
    for t in range(steps):
        v, c = (w, b) if prev is None else (w + (t / (t + 3)) * (w - prev[0]), b + (t / (t + 3)) * (b - prev[1]))
        slack = np.maximum(0, 1 - y * (x @ v + c))
        pull = weight * slack * y
        prev = (w, b)
        w, b = v - (penalty * v - 2 * (x.T @ pull)) / bound, c + 2 * float(pull.sum()) / bound
    m = np.abs(x @ w + b)
    return w, float(b), 4.0 / max(1e-6, float(np.median(m)))


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    families: list[str] = field(default_factory=list)
    #: (kind, a, b): ("family", i, j) or ("pair", i, j): positive means a, over indices into families or langs.
    heads: list[tuple[str, int, int]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, BINS + 1), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Margin of each head (rows) for each text (columns)."""
        out = np.zeros((len(self.heads), len(texts)))
        long = [i for i, x in enumerate(texts) if len(x) > PIECE]
        for i in long:
            out[:, i] = self.weights[:, :BINS] @ profile(texts[i])
        short = [i for i in range(len(texts)) if len(texts[i]) <= PIECE]
        if short:
            two, three, first = grams([texts[i] for i in short])
            n = np.maximum(1, np.add.reduceat((two < BINS).astype(np.int64) + (three < BINS), first))
            for k in range(len(self.heads)):
                out[k, short] = np.add.reduceat((self.weights[k][two] + self.weights[k][three]).astype(np.float64), first) / n
        return out + self.bias[:, None]

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts))
        sure = 1 / (1 + np.exp(-np.clip(self.margins(texts) * self.scale[:, None], -30, 30)))
        n, f = len(texts), len(self.families)
        family = np.zeros((f, n))
        if f == 1:
            family[:] = 1
        for k, (kind, a, b) in enumerate(self.heads):
            if kind == "family":
                family[a] = sure[k]
                if b >= 0:
                    family[b] = 1 - sure[k]
        family = family / np.maximum(1e-12, family.sum(0))
        best = family.argmax(0)
        votes, belief, rivals = np.zeros((len(self.langs), n)), np.zeros((len(self.langs), n)), np.zeros(len(self.langs))
        for k, (kind, a, b) in enumerate(self.heads):
            if kind == "pair":
                votes[a] += sure[k] >= 0.5
                votes[b] += sure[k] < 0.5
                belief[a] += sure[k]
                belief[b] += 1 - sure[k]
                rivals[[a, b]] += 1
        belief = np.where(rivals[:, None] > 0, belief / np.maximum(1, rivals)[:, None], 1)
        inside = np.array([self.families.index(family_of(x)) for x in self.langs])[:, None] == best[None, :]
        pick = np.where(inside, votes + belief * 0.5, -1).argmax(0)
        score = family[best, np.arange(n)] * belief[pick, np.arange(n)]
        known = np.array([bool(x) and has_letter(x) for x in texts], bool)
        return [self.langs[p] if k else UND for p, k in zip(pick, known, strict=True)], np.where(known, score, 0.0)


def sampled(docs: DataFrame, per_lang: int, most_rows: int) -> DataFrame:
    """(lang, key, x): for each language the profiles of the rows with the least hashes of id and text, at most ``per_lang``, and about ``most_rows`` in all.

    Keys are chosen before any text moves; equal rows share a key and give one profile.
    """
    key = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), F.lit(SPAN))
    rows = docs.filter("text is not null and lang is not null").filter(F.rlike("text", F.lit("\\p{L}"))).select("lang", "text", key.alias("key"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()}
    each = max(1, min(per_lang, most_rows // max(1, len(counts))))
    shares = docs.sparkSession.createDataFrame([(lang, least_hash(each, n)) for lang, n in counts.items()], "lang string, share long")
    near = rows.select("lang", "key").join(F.broadcast(shares), "lang").filter(F.col("key") < F.col("share")).select("lang", "key").distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    chosen = near.withColumn("rn", first).filter(F.col("rn") <= each).drop("rn")

    def task(batches):
        seen = set()
        for batch, texts in blocks(batches, "text"):
            lang, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            use = [i for i in range(len(texts)) if (lang[i], keys[i]) not in seen and not seen.add((lang[i], keys[i]))]
            made = [profile(texts[i]) for i in use]
            at = [np.flatnonzero(x) for x in made]
            packed = [i.astype(np.uint16).tobytes() + x[i].tobytes() for i, x in zip(at, made, strict=True)]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang[i] for i in use], pa.string()), "key": pa.array([keys[i] for i in use], pa.int64()), "x": pa.array(packed, pa.binary())})

    texts = rows.join(F.broadcast(chosen), ["lang", "key"]).select("lang", "key", "text")
    return texts.mapInArrow(task, "lang string, key long, x binary").groupBy("lang", "key").agg(F.first("x").alias("x"))


def fit(docs: DataFrame, per_lang: int = 300, most_rows: int = 9_000) -> Model:
    """Learn every language of (doc_id, text, lang) from ``sampled`` rows."""
    got = sorted(sampled(docs, per_lang, most_rows).collect(), key=lambda r: (r["lang"], r["key"]))
    x = np.zeros((len(got), BINS), np.float32)
    for row, r in zip(x, got, strict=True):
        n = len(r["x"]) // 6
        row[np.frombuffer(r["x"], np.uint16, n)] = np.frombuffer(r["x"], np.float32, n, 2 * n)
    lang = np.array([r["lang"] for r in got])
    del got
    langs = sorted(set(lang.tolist()))
    if not langs:
        return Model()
    mean = x.mean(0, dtype=np.float64)
    x -= mean.astype(np.float32)  # in place: the sample is held once
    spread = (1 / np.maximum(np.sqrt(np.einsum("ij,ij->j", x, x, dtype=np.float64) / len(x)), 1e-4)).astype(np.float32)
    x *= spread / np.float32(np.sqrt(BINS))
    families = sorted({family_of(a) for a in langs})
    member = np.array([families.index(family_of(a)) for a in lang])
    jobs = [("family", 0, 1)] if len(families) == 2 else [("family", i, -1) for i in range(len(families))] if len(families) > 2 else []
    jobs += [("pair", i, j) for i in range(len(langs)) for j in range(i + 1, len(langs)) if family_of(langs[i]) == family_of(langs[j])]
    out = Model(langs, families, jobs, np.zeros((len(jobs), BINS + 1), np.float32), np.zeros(len(jobs)), np.zeros(len(jobs)))
    for k, (kind, a, b) in enumerate(jobs):
        use = slice(None) if kind == "family" else (lang == langs[a]) | (lang == langs[b])
        y = np.where(member[use] == a if kind == "family" else lang[use] == langs[a], 1.0, -1.0).astype(np.float32)
        w, bias, out.scale[k] = svm(x[use], y)
        out.weights[k, :BINS] = w * spread / np.sqrt(BINS)
        out.bias[k] = bias - float(mean @ out.weights[k, :BINS])
    return out


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns, lang_pred and score."""

    rows, column = selected(docs, keep, text)

    def task(batches):
        for batch, texts in blocks(batches, column):
            lang, score = model.predict(texts)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    fields = docs.select(*keep).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["lang_pred string", "score double"])
    return rows.mapInArrow(task, schema)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the rows that are not held out; predict all ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(crc_mod("doc_id", 4) != 2))
    return predict(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
