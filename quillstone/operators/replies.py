"""Replies and reports: question classes, rewriting, decisions, HTML, JSON, evaluation text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators.answers import any_of

#: Words that mark a question about pay, or about figures. Fixed values.
PAY = ["pay", "salary", "allowances", "tankhwah", "compensation", "remuneration"]
NUMBERS = ["number", "numerical", "kitni", "kitna", "amount", "figure"]


def question_types(q: Column, stop: list[str], short: list[str]) -> dict[str, Column]:
    low = F.lower(q)
    start = F.lower(F.trim(q))
    return {
        "short": F.size(T.overlap_tokens(q, stop, short)) <= 4,
        "schedule": F.rlike(low, F.lit("(^|[^a-z0-9_])(schedule|scheduled +laws|annex(ure)?|appendix)($|[^a-z0-9_])")),
        "yes_no": F.rlike(start, F.lit("^(is|are|was|were|do|does|did|can|could|should|will|would|has|have|had)($|[^a-z0-9_])")),
        "definition": F.rlike(start, F.lit("^(what +is|define|meaning +of)($|[^a-z0-9_])")),
    }


def with_pay_terms(q: Column) -> Column:
    """Questions about pay also name the schedule, and the columns of its table where figures are wanted."""
    low = F.lower(q)
    pay = any_of(low, PAY)
    schedule = F.when(pay & ~F.contains(low, F.lit("schedule")), " pay schedule").otherwise("")
    figures = F.when(pay & any_of(low, NUMBERS) & ~F.contains(low, F.lit("minimum")), " minimum pay maximum pay").otherwise("")
    return F.concat(q, schedule, figures)


def decision(answer: Column, refusals: list[str]) -> Column:
    return F.when(F.coalesce(answer, F.lit("")) == "", "error").when(any_of(F.lower(answer), refusals), "refuse").otherwise("answer")


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def extractive(context: DataFrame) -> DataFrame:
    """(query_id, answer): the text of the best evidence with its mark; the default where no model is plugged in."""
    return context.groupBy("query_id").agg(F.concat(F.min_by("snippet", "ref_id"), F.lit(" [1]")).alias("answer"))


def html(refs: DataFrame) -> DataFrame:
    """(query_id, html, keys): the extractive answer with its list of references; one without a page is named by its document alone."""
    item = F.concat(F.lit("<li>"), F.col("ref_id").cast("string"), F.lit(". "), "doc_name", F.coalesce(F.concat(F.lit(" p."), F.col("page").cast("string")), F.lit("")), F.lit(": "), escaped(F.left("snippet", F.lit(40))), F.lit("</li>"))
    key = F.concat("doc_name", F.coalesce(F.concat(F.lit("#"), F.col("page").cast("string")), F.lit("")))
    g = refs.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("ref_id", item.alias("li"), key.alias("key")))).alias("rs"), F.min_by("snippet", "ref_id").alias("top"))
    body = F.concat(F.lit("<p>"), escaped(F.col("top")), F.lit(" [1]</p><ol>"), F.array_join(F.transform("rs", lambda r: r["li"]), ""), F.lit("</ol>"))
    return g.select("query_id", body.alias("html"), F.array_join(F.transform("rs", lambda r: r["key"]), ",").alias("keys"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def inline_html(c: Column) -> Column:
    """Bold, emphasis and citation marks of a line."""
    strong = F.regexp_replace(c, r"\*\*(.*?)\*\*", "<strong>$1</strong>")
    return F.regexp_replace(F.regexp_replace(strong, r"\*(.*?)\*", "<em>$1</em>"), r"\[([0-9]+)\]", '<span class="cite-badge">[$1]</span>')


def answer_blocks(answer: Column) -> Column:
    """array<struct<kind, items>>: an answer's lines as headings, lists, paragraphs and spaces.

    Lines are stripped. Bullets that follow one another are one ``ul``, numbered lines one ``ol``; a blank line ends a list and is a
    ``space`` if the line before it is not blank. Everything happens in the row, each line is looked at once. Null and empty answers have no blocks.
    """
    kind = lambda x: F.when(x == "", "space").when(F.startswith(x, F.lit("## ")), "heading").when(F.rlike(x, F.lit("^[-•][\\x09-\\x0D ]")), "ul").when(F.rlike(x, F.lit("^[0-9]+[.)][\\x09-\\x0D ]")), "ol").otherwise("para")
    body = lambda k, x: inline_html(F.when(k == "heading", F.substr(x, F.lit(4))).when(k == "ul", F.regexp_replace(x, "^[-•][\\x09-\\x0D ]*", "")).when(k == "ol", F.regexp_replace(x, "^[0-9]+[.)][\\x09-\\x0D ]*", "")).otherwise(x))

    def grouped(marked: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("struct<kind:string,text:string>")), F.slice(marked, 1, F.size(marked) - 1))
        pairs = F.arrays_zip(marked.alias("x"), before.alias("b"))
        place = F.transform(pairs, lambda p, i: F.struct(i.alias("at"), p["x"]["kind"].alias("kind"), (~p["x"]["kind"].isin("ul", "ol") | ~p["x"]["kind"].eqNullSafe(p["b"]["kind"])).alias("new"), p["b"]["kind"].alias("last")))
        return bound(F.filter(place, lambda p: p["new"]), lambda starts: cut(marked, starts))

    def cut(marked: Column, starts: Column) -> Column:
        ends = F.concat(F.transform(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), lambda p: p["at"]), F.array(F.size(marked)))
        blocks = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda z: F.struct(z["s"]["kind"].alias("kind"), F.transform(F.slice(marked, z["s"]["at"] + 1, z["e"] - z["s"]["at"]), lambda m: m["text"]).alias("items"), z["s"]["last"].alias("last")))
        shown = F.filter(blocks, lambda b: (b["kind"] != "space") | (b["last"].isNotNull() & (b["last"] != "space")))
        return F.transform(shown, lambda b: F.struct(b["kind"].alias("kind"), F.when(b["kind"] == "space", F.array().cast("array<string>")).otherwise(b["items"]).alias("items")))

    def mark(line: Column) -> Column:
        return bound(kind(line), lambda k: F.struct(k.alias("kind"), body(k, line).alias("text")))

    lines = F.transform(F.split(F.coalesce(answer, F.lit("")), "\n"), lambda x: T.stripped(x))
    return bound(F.transform(lines, mark), grouped)


def as_json(answers: DataFrame, refs: DataFrame) -> DataFrame:
    """(query_id, response): answer, decision and references as one JSON object."""
    shown = [c for c in ("ref_id", "doc_name", "page", "snippet", "url") if c in refs.columns]
    g = refs.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*shown))).alias("references"))
    return answers.join(g, "query_id", "left").select("query_id", F.to_json(F.struct("answer", "decision", F.coalesce("references", F.array()).alias("references"))).alias("response"))


def report(cases: DataFrame) -> DataFrame:
    """(line_no, line): a report over one row per case, failures first. Cases are a stated set, so one order over all is meant."""
    line = F.concat(F.when(F.col("passed"), "PASS ").otherwise("FAIL "), "id", F.lit(" "), "note")
    return cases.select(F.row_number().over(W.orderBy("passed", "id")).cast("long").alias("line_no"), line.alias("line"))


def write_report(cases: DataFrame, path: str) -> None:
    """The report as one text file in a folder."""
    lines = report(cases).repartition(1).sortWithinPartitions("line_no")
    lines.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def time_ago(seconds: Column) -> Column:
    unit = lambda n, name: F.concat(F.floor(seconds / n).cast("string"), F.lit(f" {name} ago"))
    return F.when(seconds < 60, "just now").when(seconds < 3600, unit(60, "m")).when(seconds < 86_400, unit(3600, "h")).otherwise(unit(86_400, "d"))


#: Characters of a session's title. Fixed value.
TITLE_CHARS = 38


def session_title(first: Column) -> Column:
    """The first words of a session, marked where they were cut."""
    cut = F.left(first, F.lit(TITLE_CHARS))
    return F.when(F.length(cut) >= TITLE_CHARS, F.concat(cut, F.lit("..."))).otherwise(cut)


def sessions(turns: DataFrame) -> DataFrame:
    """(conv_id, title, n_turns) of (conv_id, turn, text): one session per conversation, titled by its first turn."""
    return turns.groupBy("conv_id").agg(session_title(F.min_by("text", "turn")).alias("title"), F.count(F.lit(1)).alias("n_turns"))


def upserted(history: DataFrame, saved: DataFrame) -> DataFrame:
    """(owner, conv_id, title, n_turns, place): saved sessions take the place of their old selves; new ones go before all others, latest first.

    ``history`` has (owner, conv_id, title, n_turns, place), ``saved`` (owner, conv_id, title, n_turns, saved_at). Places count from 0 for each owner.
    """
    old = history.select("owner", "conv_id", F.col("title").alias("o_title"), F.col("n_turns").alias("o_n"), "place")
    both = old.join(saved, ["owner", "conv_id"], "full")
    order = W.partitionBy("owner").orderBy(F.col("place").isNotNull(), F.when(F.col("place").isNull(), -F.col("saved_at")), "place", "conv_id")
    now = F.col("saved_at").isNotNull()
    kept = [F.when(now, F.col(new)).otherwise(F.col(was)).alias(new) for new, was in (("title", "o_title"), ("n_turns", "o_n"))]
    return both.select("owner", "conv_id", *kept, (F.row_number().over(order) - 1).cast("long").alias("place"))
