"""URL filters: allow and block rules, and gradient-boosted trees on lexical features.

All of it is DataFrame expressions and joins. The trees are fitted on the driver from a bounded
sample of labelled URLs (``most``, 4,000 by default: the distinct URLs of least hash) whose
features Spark computes, and become one nested CASE expression per tree, so scoring is a projection
without Python. Suffix statistics are counted over all labelled rows and joined.

A few rules are one CASE; more, however many, are joined on the host's last labels.

Defined results: a null URL, or one without ``://``, has empty host and path, fits no
rule and is judged by the trees over its features; without labelled URLs the trees
allow all; repeated rows are judged each; extra columns are ignored; an empty table gives
no rows. Of rules of equal length that fit, the one given first wins. A URL of any length is
read whole.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm._shared import SPAN, least_hash, persisted, table

#: Up to so many rules are written out as one expression.
INLINE_RULES = 200
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 << 20
RULE = "struct<verdict:string,rule:string>"
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits; null if none does."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = (host == F.lit(name)) | F.endswith(host, F.lit(f".{name}"))
        out = (F if out is None else out).when(fits & F.startswith(path, F.lit(slash + rest)), F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule")))
    return F.lit(None).cast(RULE) if out is None else out


def with_rule(rows: DataFrame, rules=RULES, inline: int = INLINE_RULES) -> DataFrame:
    """Adds ``__rule``, struct(verdict, rule), to rows of (host, path).

    Up to ``inline`` rules are one CASE. More are grouped by host and joined once for each
    number of labels that a rule's host has, on the host's last so many labels; the longest
    rule whose path fits is taken from the few that each join brings.
    """
    rules = list(rules)
    if len(rules) <= inline:
        return rows.withColumn("__rule", matching_rule(F.col("host"), F.col("path"), rules))
    by_host: dict[str, list[tuple[int, str, str, str]]] = {}
    for no, (verdict, rule) in enumerate(sorted(rules, key=lambda r: -len(r[1]))):
        name, slash, rest = rule.partition("/")
        by_host.setdefault(name, []).append((no, slash + rest, verdict, rule))
    kind = "array<struct<no:int,start:string,verdict:string,rule:string>>"
    columns, found = rows.columns, []
    for n in sorted({name.count(".") for name in by_host}):
        some = [(name, kept) for name, kept in by_host.items() if name.count(".") == n]
        held = rows.sparkSession.createDataFrame(some, f"__name{n} string, __rules{n} {kind}")
        size = sum(len(r) for _, kept in some for *_, r in kept)
        last = F.when(F.size(F.split("host", r"\.")) > n, F.substring_index(F.col("host"), ".", -n - 1))
        rows = rows.join(F.broadcast(held) if size <= BROADCAST_BYTES else held, last == F.col(f"__name{n}"), "left")
        found.append(F.filter(F.coalesce(f"__rules{n}", F.array().cast(kind)), lambda r: F.startswith(F.col("path"), r["start"])))
    best = F.array_min(F.concat(*found))
    rule = F.when(best.isNotNull(), F.struct(best["verdict"].alias("verdict"), best["rule"].alias("rule")))
    return rows.withColumn("__rule", rule).select(*columns, "__rule")


def suffix_of(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Length, depth, digits, entropy, parameters and host shape of a URL, as doubles."""
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    times = lambda c: F.length(u) - F.length(F.replace(u, c, F.lit("")))
    spread = F.aggregate(F.array_distinct(F.filter(F.split(u, ""), lambda c: c != "")), F.lit(0.0), lambda a, c: a - (times(c) / n) * F.log2(times(c) / n))
    made = {
        "url_length": F.length(u),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))),
        "digit_ratio": F.regexp_count(u, F.lit("[0-9]")) / n,
        "entropy": spread,
        "n_params": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1),
        "n_labels": F.size(F.split(host, r"\.")),
        "n_hyphens": F.regexp_count(u, F.lit("[-_]")),
        "secure": F.startswith(u, F.lit("https")).cast("int"),
    }
    return {k: v.cast("double") for k, v in made.items()}


@dataclass(frozen=True)
class Tree:
    """A leaf (value), or a test: feature <= cut goes left."""

    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    left: Tree | None = None
    right: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        go = x[:, self.feature] <= self.cut
        out = np.empty(len(x))
        out[go], out[~go] = self.left.predict(x[go]), self.right.predict(x[~go])
        return out

    def expression(self, columns: list[Column]) -> Column:
        if self.feature < 0:
            return F.lit(float(self.value))
        return F.when(columns[self.feature] <= F.lit(float(self.cut)), self.left.expression(columns)).otherwise(self.right.expression(columns))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int, rate: float, ridge: float, least: float) -> Tree:
    total_g, total_h = g.sum(), h.sum()
    best = (1e-6, -1, 0.0)
    for f, ts in enumerate(cuts if depth else ()):
        if len(ts):
            slot = np.searchsorted(ts, x[:, f], "left")
            gl = np.cumsum(np.bincount(slot, g, len(ts) + 1))[:-1]
            hl = np.cumsum(np.bincount(slot, h, len(ts) + 1))[:-1]
            gain = gl**2 / (hl + ridge) + (total_g - gl) ** 2 / (total_h - hl + ridge) - total_g**2 / (total_h + ridge)
            gain[(hl < least) | (total_h - hl < least)] = -1
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], f, float(ts[i]))
    if best[1] < 0:
        return Tree(value=float(-rate * total_g / (total_h + ridge)))
    go = x[:, best[1]] <= best[2]
    part = lambda m: _grow(x[m], g[m], h[m], cuts, depth - 1, rate, ridge, least)
    return Tree(0.0, best[1], best[2], part(go), part(~go))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, least: float = 1.0) -> tuple[float, list[Tree]]:
    """Gradient boosting with logistic loss: the starting margin and the trees."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    margin, out = np.full(len(y), start), []
    marks = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65))) for f in range(x.shape[1])]
    cuts = [(m[1:] + m[:-1]) / 2 for m in marks]
    for _ in range(trees if len(set(y.tolist())) == 2 else 0):
        p = 1 / (1 + np.exp(-margin))
        out.append(_grow(x, p - y, p * (1 - p), cuts, depth, rate, ridge, least))
        margin += out[-1].predict(x)
    return start, out


@dataclass
class UrlModel:
    start: float
    trees: list[Tree]
    #: (suffix, suffix_rate): smoothed share of blocked URLs over all labelled rows of each host suffix.
    suffixes: DataFrame
    n_suffixes: int
    prior: float

    def with_rates(self, rows: DataFrame) -> DataFrame:
        """Adds suffix_rate by the host's suffix: a broadcast join while the suffixes are few, a shuffle join beyond."""
        known = F.broadcast(self.suffixes) if self.n_suffixes <= BROADCAST_ROWS else self.suffixes
        keyed = rows.withColumn("__suffix", suffix_of(F.col("host"))).join(known, F.col("__suffix") == F.col("suffix"), "left")
        return keyed.withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(self.prior))).drop("__suffix", "suffix")

    def margin(self, columns: list[Column]) -> Column:
        out = F.lit(self.start)
        for t in self.trees:
            out = out + t.expression(columns)
        return out


def fit(labelled: DataFrame, most: int = 4_000) -> UrlModel:
    """Learn from (url, host, path, blocked).

    Suffix statistics count all labelled rows. The trees are fitted on the ``most`` distinct
    URLs of least hash, however often each occurs; a URL with both labels counts as blocked.
    """
    by_suffix = labelled.groupBy(suffix_of(F.col("host")).alias("suffix")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("blocked").cast("int")).alias("bad"))
    by_suffix = persisted(by_suffix, "suffixes")
    n_suffixes, n, bad = by_suffix.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    prior = (bad + 1) / (n + 2) if n else 0.0
    rates = by_suffix.select("suffix", ((F.col("bad") + F.lit(4 * prior)) / (F.col("n") + 4)).alias("suffix_rate"))
    if not n:
        return UrlModel(-1.0, [], rates, 0, 0.0)
    key = F.pmod(F.xxhash64("url"), F.lit(SPAN))
    distinct = labelled.agg(F.approx_count_distinct("url")).first()[0]
    drawn = labelled.filter(key < least_hash(most, distinct)).groupBy("url").agg(F.max(F.col("blocked").cast("int")).alias("y"))
    drawn = drawn.orderBy(key, "url").limit(most)
    model = UrlModel(0.0, [], rates, n_suffixes, float(prior))
    wide = model.with_rates(drawn.select("url", "y", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
    made = lexical(F.col("url"), F.col("host"), F.col("path"))
    rows = wide.select(key.alias("key"), "url", "y", *[e.alias(k) for k, e in made.items()], "suffix_rate").collect()
    rows = sorted(rows, key=lambda r: (r["key"], r["url"]))
    x = np.array([[r[k] for k in (*made, "suffix_rate")] for r in rows], float)
    model.start, model.trees = fit_trees(x, np.array([r["y"] for r in rows], float))
    return model


def judge(pages: DataFrame, model: UrlModel, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, block_margin and verdict."""
    split = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    made = lexical(F.col("url"), F.col("host"), F.col("path"))
    wide = model.with_rates(with_rule(split, rules)).select("page_id", "url", "host", "path", "__rule", *[e.alias(f"__f_{k}") for k, e in made.items()], F.col("suffix_rate").alias("__f_suffix_rate"))
    scored = wide.withColumn("block_margin", model.margin([F.col(f"__f_{k}") for k in (*made, "suffix_rate")]))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("block_margin") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "url", "host", "path", F.col("__rule.rule").alias("rule"), "block_margin", verdict.alias("verdict"))


def rule_labels(pages: DataFrame, rules=RULES) -> DataFrame:
    """The URLs that a rule decides, as labelled rows."""
    split = pages.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = with_rule(split, rules)
    return ruled.filter("__rule is not null").select("url", "host", "path", (F.col("__rule.verdict") == "block").alias("blocked"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every ``pages`` url by the rules, and by trees learned from the URLs that the rules label."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, fit(rule_labels(pages))).select("page_id", "host", "path", "rule", "verdict")
