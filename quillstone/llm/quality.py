"""Quality rules: text statistics and a learned decision list.

The list is learned by sequential covering from a bounded sample of labelled documents
(``most``, 20,000 by default): a rule is grown on two thirds of them, one threshold
condition at a time by FOIL gain, pruned on the other third, and kept while it is
precise there; what it covers is set aside and the next rule is grown. The result
is an ordered Spark ``when`` chain over the statistics, with ``keep`` last.

Statistics are counted over whole texts. Runs of words are compared by 64-bit hash
within one text.

Defined results: a null or empty text has zeros everywhere and fails the base rule;
no labels give an empty list, which keeps all; a null ``quality`` is no label;
repeated rows are judged each; extra columns are ignored; empty tables give no rows
and no rules. Of conditions that gain equally the first feature by STATS order and its
lowest threshold wins, and '<=' before '>'; of rules that hold together the first decides. A
text of any length is read whole, in memory of a few times its size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm._kernels import U, Words, by_text, mix, range_hashes, unique_pairs
from quillstone.llm._shared import SPAN, blocks, least_hash, selected, table

SYMBOLS = b"#*$%&|<>"
_IS = {name: np.isin(np.arange(256), np.frombuffer(chars, np.uint8)) for name, chars in {"symbol": SYMBOLS, "digit": b"0123456789", "upper": bytes(range(65, 91)), "stop": b".!?"}.items()}
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_echoes", "n_distinct_words", "n_digits", "n_upper", "n_stops")


def text_stats(texts: list[bytes]) -> dict[str, np.ndarray]:
    """STATS of each text, as arrays."""
    n, w = len(texts), Words(texts)
    per_text = lambda flags: np.add.reduceat(flags.astype(np.int64), w.first) if n else np.zeros(0, np.int64)
    out = {"n_words": w.count.astype(np.int64), "word_chars": per_text(~w.space & (w.buf & 0xC0 != 0x80))}
    out |= {f"n_{k}s" if k != "upper" else "n_upper": per_text(flags[w.buf]) for k, flags in _IS.items()}
    stop = w.buf == 10
    stop[w.first + w.sizes] = True
    ends = np.flatnonzero(stop)
    starts = np.concatenate(([0], ends[:-1] + 1)).astype(np.int64)
    ink = np.concatenate(([0], np.cumsum(~w.space)))
    used = ink[ends] > ink[starts]
    doc = np.searchsorted(w.first, starts[used], "right") - 1
    out["n_lines"] = by_text(np.ones(len(doc)), doc, n)
    seen, _ = unique_pairs(doc, range_hashes(w.buf, starts, ends)[used])
    out["n_dup_lines"] = out["n_lines"] - by_text(np.ones(len(seen)), seen, n)
    h = w.hashes()
    seen, _ = unique_pairs(w.doc, h)
    out["n_distinct_words"] = by_text(np.ones(len(seen)), seen, n)
    echo = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    out["n_echoes"] = by_text(echo.astype(float), w.doc[1:], n)
    at, run = w.runs(5, h)
    key = mix(run ^ mix(w.doc[at].astype(U) + U(1)))
    order = np.argsort(key)
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    hit = at[order[same[1:] | same[:-1]]]
    cover = np.zeros(len(h) + 1, np.int64)
    cover[hit] += 1
    cover[hit + 5] -= 1
    out["n_repeat_words"] = by_text((np.cumsum(cover[:-1]) > 0).astype(float), w.doc, n)
    return out


def with_stats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns and STATS."""

    rows, column = selected(docs, keep, text)

    def task(batches):
        for batch, texts in blocks(batches, column):
            made = text_stats(texts)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(made[s]) for s in STATS], [*keep, *STATS])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + [f"{s} long" for s in STATS])
    return rows.mapInArrow(task, schema)


def features() -> dict[str, Column]:
    """Ratios that the rules test, over the statistics."""
    c = F.col
    share = lambda a, b: (c(a) / F.greatest(c(b), F.lit(1))).cast("double")
    return {
        "n_words": c("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct_words", "n_words"),
        "echo_share": share("n_echoes", "n_words"),
        "digit_share": share("n_digits", "word_chars"),
        "upper_share": share("n_upper", "word_chars"),
        "line_words": share("n_words", "n_lines"),
        "stops_per_word": share("n_stops", "n_words"),
    }


@dataclass(frozen=True)
class Rule:
    """Reject where all conditions (feature, '<=' or '>', threshold) hold."""

    conditions: tuple[tuple[str, str, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for f, op, t in self.conditions:
            out &= x[f] <= t if op == "<=" else x[f] > t
        return out

    def expression(self, columns: dict[str, Column]) -> Column:
        out = F.lit(True)
        for f, op, t in self.conditions:
            out = out & (columns[f] <= F.lit(t) if op == "<=" else columns[f] > F.lit(t))
        return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray], longest: int) -> Rule:
    rule, held = Rule(()), np.ones(len(bad), bool)
    while len(rule.conditions) < longest:
        p, n = (held & bad).sum(), (held & ~bad).sum()
        if not p or not n:
            break
        best = (1e-9, None, None)
        for f, ts in cuts.items():
            slot = np.searchsorted(ts, x[f][held], "left")  # value <= ts[i] iff slot <= i
            hits = [np.cumsum(np.bincount(slot[want], minlength=len(ts) + 1))[:-1] for want in (bad[held], ~bad[held])]
            for op, (ps, ns) in (("<=", hits), (">", [p - hits[0], n - hits[1]])):
                gain = np.where(ps > 0, ps * (np.log2(np.maximum(ps, 1e-9) / np.maximum(ps + ns, 1)) - np.log2(p / (p + n))), -1)
                if gain.max(initial=-1) > best[0]:
                    i = int(gain.argmax())
                    best = (gain[i], (f, op, float(ts[i])), None)
        if best[1] is None:
            break
        rule = Rule((*rule.conditions, best[1]))
        held = rule.covers(x)
    return rule


def learn_decision_list(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, least: int = 3, most_rules: int = 24, longest: int = 4) -> list[Rule]:
    """Sequential covering with reduced-error pruning; row i is in the pruning third if i mod 3 is 2."""
    rules, left = [], np.ones(len(bad), bool)
    pruning = np.arange(len(bad)) % 3 == 2
    # halfway between neighbouring quantiles, so that a threshold keeps a margin from both sides
    marks = {f: np.unique(np.quantile(v, np.linspace(0, 1, 257))) for f, v in x.items()} if len(bad) else {}
    cuts = {f: (m[1:] + m[:-1]) / 2 for f, m in marks.items()}
    while len(rules) < most_rules and (left & bad & ~pruning).sum() >= least:
        part = lambda rows: {f: v[rows] for f, v in x.items()}
        grow, prune = left & ~pruning, left & pruning
        rule = _grow(part(grow), bad[grow], cuts, longest)

        def worth(r: Rule) -> tuple[float, int]:
            got = bad[prune][r.covers(part(prune))]
            return (2 * got.sum() - len(got)) / (len(got) + 1), -len(r.conditions)

        rule = max((Rule(rule.conditions[: i + 1]) for i in range(len(rule.conditions))), key=worth, default=Rule(()))
        got = bad[left][rule.covers(part(left))]
        held = bad[prune][rule.covers(part(prune))]
        if not rule.conditions or len(got) < least or got.mean() < precision or (len(held) and held.mean() < precision):
            break
        rules.append(rule)
        left &= ~rule.covers(x)
    return rules


def decision_expression(rules: list[Rule], columns: dict[str, Column]) -> Column:
    """True to keep. The first rule that holds decides; none: keep."""
    out = None
    for r in rules:
        out = (F if out is None else out).when(r.expression(columns), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit_rules(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> list[Rule]:
    """Learn from at most ``most`` labelled documents, those with the least hashes of their ids; an id counts once, by its least label and its least statistics."""
    key = F.pmod(F.xxhash64("doc_id"), F.lit(SPAN))
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    if n > most:
        known = known.filter(key < least_hash(most, n)).orderBy(key, "doc_id").limit(most)
    stats = with_stats(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"), ("doc_id", "quality"))
    one = stats.groupBy("doc_id", "quality").agg(F.min(F.struct(*STATS)).alias("s")).select("doc_id", "quality", "s.*")
    rows = one.select("doc_id", "quality", *[e.alias(f"f_{f}") for f, e in features().items()]).orderBy(key, "doc_id").collect()
    x = {f: np.array([r[f"f_{f}"] for r in rows], float) for f in features()}
    return learn_decision_list(x, np.array([r["quality"] == 0 for r in rows], bool))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, STATS, base_failed and kept for every row."""
    stats = with_stats(docs)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & decision_expression(rules, features()))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn the list from ``labels`` and judge all ``documents``."""
    docs = table(spark, sf_dir, "documents")
    rules = fit_rules(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
