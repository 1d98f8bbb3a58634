"""Views of the operators whose rows SQL can state: the columns that do not depend on what is learned or hashed.

Each query goes through its operator and drops the other columns. The SQL is DuckDB's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.bpe import op10_bpe
from quillstone.llm.fingerprints import op2_fingerprints
from quillstone.llm.lm import op9_lm
from quillstone.llm.quality import op8_quality
from quillstone.llm.urls import RULES, op6_urls
from quillstone.llm.whitening import op13_whitening

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32 of the id as text, bit by bit. The polynomial is a fixed value.
CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ord((doc_id::varchar)[i])::bigint)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

#: One row per document: shingle sets of four words, links by intersection and union, and the least id within reach.
ORACLE_OP5 = f"""
with recursive w as (select doc_id, {WORDS.replace("coalesce(text, '')", LOWER)} as ws from documents),
s as (select doc_id, case when len(ws) >= 4 then list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' '))) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as sh from w),
n as (select doc_id, len(sh)::bigint as n_shingles from s),
e as (select doc_id, unnest(sh) as sh from s),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as m from e a join e b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * m >= 80 * (x.n_shingles + y.n_shingles - m)),
two as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from n union select r.a, t.b from reach r join two t on t.a = r.b),
least as (select a as doc_id, min(b) as component_id from reach group by 1)
select doc_id, n_shingles, component_id, doc_id = component_id as kept from n join least using (doc_id)"""

#: Windows of 13 words by the least id that has them; words under a window of an earlier document go.
ORACLE_OP7 = f"""
with w as (select doc_id, {WORDS} as ws from documents),
win as (select doc_id, i, array_to_string(ws[i : i + 12], ' ') as win from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w)),
least as (select win, min(doc_id) as first from win group by win),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as i from win join least using (win) where doc_id > first),
cut as (select doc_id, list(i) as pos from gone group by doc_id),
kept as (select w.doc_id, ws, coalesce(pos, []) as pos from w left join cut using (doc_id))
select doc_id, len(ws)::bigint as n_words, len(pos)::bigint as n_removed,
  sha256(array_to_string(list_filter(ws, lambda x, i: not list_contains(pos, i)), ' ')) as kept_sha256 from kept"""

QUERIES, ORACLES = {}, {}


def view(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


@view("""with d as (select doc_id, coalesce(text, '') as t from documents), n as (select *, lead(t) over (order by doc_id desc) as next, first_value(t) over (order by doc_id desc) as top from d)
select doc_id, length(t)::bigint as n_chars, sha256(left(t, length(t) - length(t) // 3) || left(coalesce(next, top), length(t) // 3)) as edited_sha256 from n""")
def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def rule_sql() -> str:
    cases = []
    for _, rule in sorted(RULES, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        cases.append(f"when (host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '{slash}{rest}') then '{rule}'")
    return "case " + " ".join(cases) + " end"


@view(f"""with r as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from r)
select page_id, host, path, {rule_sql()} as rule from h""")
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_urls(spark, sf_dir).select("page_id", "host", "path", "rule")


@view(rf"""with w as (select doc_id, coalesce(text, '') as t, {WORDS} as ws from documents),
l as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from w),
win as (select doc_id, i, array_to_string(ws[i : i + 4], ' ') as win from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w)),
twice as (select doc_id, i from win qualify count(*) over (partition by doc_id, win) > 1),
rep as (select doc_id, count(distinct i) as n from (select doc_id, unnest(range(i, i + 5)) as i from twice) group by doc_id),
s as (select w.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words from w join l using (doc_id) left join rep using (doc_id))
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from s""")
def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_quality(spark, sf_dir).drop("kept")


@view(f"""with d as (select doc_id, {CRC} % 5 = 1 as held_out, list_append({WORDS.replace("coalesce(text, '')", LOWER)}, ' ') as ts from documents),
t as (select doc_id, held_out, unnest(ts) as tok from d), c as (select tok, count(*) as c from t where not held_out group by tok), a as (select coalesce(sum(c), 0) as n, count(*) as v from c)
select doc_id, held_out, count(*) as n_tokens, count(c) as n_known, max(n)::bigint as train_tokens, round(sum(log10((coalesce(c, 0) + 0.5::double) / (n + 0.5::double * (v + 1)))), 4) as base_score
from t left join c using (tok), a group by doc_id, held_out""")
def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_lm(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 4))


@view("select doc_id, sha256(coalesce(text, '')) as decoded_sha256 from documents")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


@view("""with e as (select vec_id, list_transform(embedding, lambda v: floor(v::double * 256)::bigint) as x from embeddings where embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
f as (select distinct x from e), n as (select count(*)::bigint as n from f), s as (select i, sum(x[i])::bigint as s from (select x, unnest(range(1, len(x) + 1)) as i from f) group by i),
d as (select vec_id, x, sum((n * x[i] - s) * (n * x[i] - s))::bigint as deviation from (select vec_id, x, unnest(range(1, len(x) + 1)) as i from e) join s using (i), n group by vec_id, x)
select vec_id, unnest([1, 2, 3, 4]) as component, n, deviation, true as is_white from d, n""")
def vector_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_whitening(spark, sf_dir).select("vec_id", "component", "n", "deviation", (F.col("identity_error") <= 1e-4).alias("is_white"))
