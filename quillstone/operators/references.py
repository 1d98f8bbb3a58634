"""References of an answer: pages and places, file names, addresses, containment, grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone import lexicon
from quillstone.functions import text as T

#: Where published files live. Fixed values.
DATA_PATH = "/assets/data/"
DOWNLOAD_PATH = "/download/"


def page_list(start: Column, end: Column) -> Column:
    """All pages from one to the other, both included, in rising order whichever comes first; no start, no pages."""
    last = F.coalesce(end, start)
    return F.when(start.isNull(), F.array().cast("array<bigint>")).otherwise(F.sequence(F.least(start, last), F.greatest(start, last)).cast("array<bigint>"))


def place_list(*places: Column) -> Column:
    """The distinct places that are not blank, stripped and sorted."""
    bare = F.transform(F.array(*[F.coalesce(p, F.lit("")) for p in places]), T.stripped)
    return F.array_sort(F.array_distinct(F.filter(bare, lambda p: p != "")))


def slashed(path: Column) -> Column:
    return F.replace(T.stripped(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/"))


def file_name(path: Column, document: Column) -> Column:
    """The bare name of a published or PDF/DOCX path, else that of the document."""
    p = slashed(path)
    named = F.rlike(p, F.lit(f"^/?{DATA_PATH[1:]}")) | F.rlike(F.lower(p), F.lit(r"\.(pdf|docx)$"))
    return F.element_at(F.split(F.when(named, p).otherwise(T.stripped(F.coalesce(document, F.lit("")))), "/"), -1)


def data_url(base: Column, name: Column) -> Column:
    return F.concat(base, F.lit(DATA_PATH), T.url_quoted(name))


def download_url(base: Column, name: Column) -> Column:
    return F.concat(base, F.lit(DOWNLOAD_PATH), T.url_quoted(name))


def joined_url(base: Column, path: Column) -> Column:
    """Absolute addresses stay; other paths hang below the base; a blank path gives none."""
    p = slashed(path)
    return F.when(p == "", "").when(F.rlike(p, F.lit("^https?://")), p).otherwise(F.concat(base, F.when(F.startswith(p, F.lit("/")), "").otherwise("/"), p))


def with_page_anchor(url: Column, pages: Column) -> Column:
    """The first page as an anchor, unless the address is blank or has one."""
    bare = (url == "") | F.contains(url, F.lit("#")) | (F.size(pages) == 0)
    return F.when(bare, url).otherwise(F.concat(url, F.lit("#page="), F.array_min(pages).cast("string")))


def open_url(base: Column, given: Column, path: Column, hint: Column, document: Column, pages: Column) -> Column:
    """The given address, else base, path and hint, else the published file of the document; with its page."""
    own, at = T.stripped(F.coalesce(given, F.lit(""))), T.stripped(F.coalesce(path, F.lit("")))
    below = F.concat(joined_url(base, at), T.stripped(F.coalesce(hint, F.lit(""))))
    name = file_name(F.lit(""), F.coalesce(document, F.lit("Unknown document")))
    return with_page_anchor(F.when(own != "", own).when(at != "", below).otherwise(data_url(base, name)), pages)


def resolved(path: Column) -> Column:
    """An absolute path without '.', '..' and empty parts; '..' stops at the root."""

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when((part == "") | (part == "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def is_contained(path: Column, root: str) -> Column:
    """Whether an absolute path leads to ``root`` or below it once its '..' are followed; null and relative paths do not."""
    at, top = resolved(path), root.rstrip("/")
    return F.coalesce(F.startswith(path, F.lit("/")) & ((at == top) | F.startswith(at, F.lit(top + "/"))), F.lit(False))


def grouped(refs: DataFrame) -> DataFrame:
    """(query_id, document, path, url, snippet, pages, places) of (query_id, ref_id, document, path, url, snippet, page_start, page_end, place).

    One row per document and path; the first address and snippet that are not blank, in the order of ref_id, and all
    pages and places. A null path is a blank one.
    """
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("ref_id"))), F.lit(""))
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    made = refs.withColumns({"path": F.coalesce("path", F.lit("")), "pages": page_list(F.col("page_start"), F.col("page_end")), "places": place_list(F.col("place"))})
    return made.groupBy("query_id", "document", "path").agg(first("url").alias("url"), first("snippet").alias("snippet"), every("pages").alias("pages"), every("places").alias("places"))


def page_url(base: Column, path: Column, document: Column, page: Column) -> Column:
    """Where a page of evidence can be opened: the published path, else the document's file, below the base. Without a page, no anchor."""
    at = F.when(F.coalesce(path, F.lit("")) != "", F.concat(base, path)).otherwise(F.concat(base, F.lit(DATA_PATH), F.coalesce(document, F.lit(""))))
    return F.concat(at, F.coalesce(F.concat(F.lit("#page="), page.cast("string")), F.lit("")))


def shown_places(places: Column, most: int = 6) -> Column:
    """The first places of a reference joined by '; ', and how many more there are."""
    more = F.when(F.size(places) > most, F.concat(F.lit("; +"), (F.size(places) - most).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return F.concat(F.array_join(F.slice(places, 1, most), "; "), more)


#: Marks that end a line of a snippet; a line, a phrase and a word that are marked are longer than these. Fixed values.
LINE_END = "[\\n.•]+"
SHORT_LINE, SHORT_PHRASE, SHORT_WORD = 10, 2, 2
#: A phrase longer than this is looked for by its beginning where the page does not have it as a whole. Fixed value.
BEGINNING = 20


def highlights(snippet: Column, question: Column) -> Column:
    """array<string>: what is marked on a page for a snippet and a question.

    The whole snippet on one line, its lines, then the question's words in lower case, without stop words; each in order, repeats kept.
    Nulls and blanks add nothing.
    """
    body = T.stripped(F.coalesce(snippet, F.lit("")))
    whole = F.filter(F.array(F.replace(body, F.lit("\n"), F.lit(" "))), lambda p: F.length(p) > SHORT_PHRASE)
    parts = F.filter(F.transform(F.split(body, LINE_END), T.stripped), lambda p: F.length(p) > SHORT_LINE)
    words = F.filter(F.split(F.lower(F.coalesce(question, F.lit(""))), "[^\\p{L}\\p{N}_]+"), lambda w: (F.length(w) > SHORT_WORD) & ~w.isin(lexicon.HIGHLIGHT_STOP))
    return F.concat(whole, parts, words)


def marks(page: Column, phrases: Column) -> Column:
    """array<string>: of the phrases, those that the page has (without regard to case); of a long one that it has not, the beginning, if it has that. Each once."""
    low = F.lower(F.coalesce(page, F.lit("")))
    has = lambda p: F.contains(low, F.lower(p))
    start = lambda p: F.left(p, F.lit(BEGINNING))
    found = F.transform(phrases, lambda p: F.when(has(p), p).when((F.length(p) > BEGINNING) & has(start(p)), start(p)))
    return F.array_distinct(F.array_compact(found))
