"""Text as Column -> Column functions: cleaning, line classes, signals, tags, tokens.

Character classes are spelled out, so that other engines agree: white space is
``[\\x09-\\x0D ]``, a word character is a letter, a number or ``_``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = "[\\x09-\\x0D ]"
EDGE_L, EDGE_R = "(^|[^\\p{L}\\p{N}_])", "($|[^\\p{L}\\p{N}_])"
LETTER = "[A-Za-z\\x{0600}-\\x{06FF}]"
PAGE_NUMBER = "^((page|p\\.?)?[ ]*[0-9]+([ ]*(of|/|-)[ ]*[0-9]+)?)$"
BULLET = "^[\\x09-\\x0D ]*(•|-|[0-9]+[).]|[a-zA-Z][).])[\\x09-\\x0D ]+"
HEADING = "^[\\x09-\\x0D ]*(schedule|annex|annexure|appendix|chapter|section)($|[^a-z0-9_])"
#: Lines that are the title of a role. Fixed values.
ROLE = "^[\\x09-\\x0D ]*(chief +technology +officer|chief +executive +officer|director +general|deputy +director|assistant +director|sub[- ]?divisional +enforcement +officer|enforcement +officer|android +developer|software +developer|database +administrator|system +administrator|network +administrator|manager *\\([^)]+\\)|[a-z]+ +manager|[a-z][a-z\\x09-\\x0D &]+[\\x09-\\x0D ]+(officer|developer|manager|director|engineer|specialist|administrator|coordinator))[\\x09-\\x0D ]*$"
REPORTS = "^[\\x09-\\x0D ]*(report *to|reporting *to|reports *to)($|[^a-z0-9_])"
TITLE_MARK = "(?i)^[\\x09-\\x0D ]*(position *title|job *title|role)[\\x09-\\x0D ]*[:-]+[\\x09-\\x0D ]*"


def replaced(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def stripped(c: Column) -> Column:
    return replaced(c, f"^{WS}+|{WS}+$")


def clean_general(c: Column) -> Column:
    """NUL runs to a space, line ends to \\n, at most three line ends in a row, every line and the whole stripped."""
    t = replaced(replaced(c, "\\x00+", " "), "\\r\\n?", "\n")
    t = replaced(t, "\\n{4,}", "\n\n\n")
    return stripped(F.array_join(F.transform(F.split(t, "\n"), stripped), "\n"))


def clean_chunk(c: Column) -> Column:
    return stripped(replaced(clean_general(c), "[ \\t]+", " "))


def normal_space(c: Column) -> Column:
    """Runs of white space as one space: what content digests are taken of."""
    return stripped(replaced(c, f"{WS}+", " "))


def line_list(c: Column) -> Column:
    """Stripped lines that are not empty."""
    return F.filter(F.transform(F.split(c, "\n"), stripped), lambda x: x != "")


def normal_line(c: Column) -> Column:
    """How lines are compared between pages: lower case, digit runs as 0, single spaces."""
    return stripped(replaced(replaced(F.lower(c), "[0-9]+", "0"), f"{WS}+", " "))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def letters(c: Column) -> Column:
    return count(c, LETTER)


def long_words(c: Column, least: int = 2) -> Column:
    return count(c, f"{LETTER}{{{least},}}")


def is_header_candidate(c: Column, marks: list[str] = ()) -> Column:
    """Short lines that may repeat on pages: page numbers, few letters, or a boilerplate word."""
    low = F.lower(c)
    said = reduce(lambda a, m: a | F.contains(low, F.lit(m)), marks, F.lit(False))
    return (c != "") & (F.length(c) <= 120) & (F.rlike(low, F.lit(PAGE_NUMBER)) | (letters(c) <= 6) | said)


def looks_like_row(c: Column) -> Column:
    return (F.length(c) >= 20) & F.rlike(c, F.lit("\\t|  ")) & (count(c, "[A-Za-z0-9\\x{0600}-\\x{06FF}]{2,}") >= 3)


def normal_row(c: Column) -> Column:
    return stripped(replaced(replaced(stripped(c), "\\t+", "  "), f"{WS}{{2,}}", " | "))


def is_structured(c: Column) -> Column:
    """A table or list line."""
    row = (F.length(c) >= 18) & (F.rlike(c, F.lit("\\t")) | (count(c, " \\| ") >= 2))
    return row | F.rlike(c, F.lit(BULLET))


def is_heading(c: Column) -> Column:
    capital = (c == F.upper(c)) & (c != F.lower(c)) & count(c, "[A-Za-z]").between(4, 40)
    return F.rlike(F.lower(c), F.lit(HEADING)) | capital


def role_heading(c: Column) -> Column:
    """The cleaned title where the line is one, else null."""
    marked = F.rlike(c, F.lit(TITLE_MARK))
    title = F.when(marked, replaced(replaced(c, TITLE_MARK), "^[\\x09-\\x0D •:-]+")).otherwise(stripped(c))
    fits = (F.length(title) <= 80) & F.rlike(F.lower(title), F.lit(ROLE)) & ~F.rlike(F.lower(c), F.lit(REPORTS))
    return F.when(fits, stripped(title))


def has_word(c: Column, pattern: str) -> Column:
    return F.rlike(F.lower(c), F.lit(f"{EDGE_L}({pattern}){EDGE_R}"))


def literal_starts(pattern: str) -> list[str]:
    """For each alternative of a pattern the letters it surely begins with; none where that is unknown."""
    out = []
    for part in pattern.split("|") if "(" not in pattern.replace("(s)?", "").replace("(ure)?", "").replace("(ual)?", "") else [pattern]:
        found = re.match(r"[a-z0-9]+(?![a-z0-9?*{])", part) or re.match(r"[a-z0-9]+(?=[a-z0-9][?*{])", part)
        if not found:
            return []
        out.append(found[0])
    return out


def tags(c: Column, patterns: list[tuple[str, str]]) -> Column:
    """Distinct tags in the order of the patterns. One projection; the text is lower-cased once, and a pattern is tried only where the letters it begins with occur."""

    def found(low: Column) -> Column:
        def hit(p: str) -> Column:
            exact = F.rlike(low, F.lit(f"{EDGE_L}({p}){EDGE_R}"))
            starts = literal_starts(p)
            return reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in starts]) & exact if starts else exact

        return F.array_distinct(F.array_compact(F.array(*[F.when(hit(p), F.lit(t)) for p, t in patterns])))

    return F.transform(F.array(F.lower(c)), found)[0]


def is_low_signal(c: Column, keep: list[str]) -> Column:
    t = stripped(F.coalesce(c, F.lit("")))
    low = F.lower(t)
    kept = reduce(lambda a, m: a | F.contains(low, F.lit(m)), keep, F.lit(False))
    thin = (F.length(t) < 60) & (long_words(t) < 6) & (letters(t) < 25)
    digits = (F.length(t) <= 16) & F.rlike(t, F.lit("^[0-9[:punct:]\\x09-\\x0D ]+$".replace("[:punct:]", "\\p{P}")))
    return (t == "") | (~kept & (F.rlike(low, F.lit(PAGE_NUMBER)) | digits | thin))


def loc_label(kind: Column, start: Column, end: Column, anchor: Column) -> Column:
    last = F.coalesce(end, start)
    page = F.when(start == last, F.concat(F.lit("Page "), start)).otherwise(F.concat(F.lit("Pages "), start, F.lit("-"), last))
    return F.when((kind == "page") & start.isNotNull(), page).otherwise(F.coalesce(anchor, F.lit("")))


def embed_text(doc: Column, loc: Column, tags: Column, text: Column) -> Column:
    """What is embedded: a header that names the document, the place and the tags, then the whole text."""
    return F.concat_ws("\n", F.concat(F.lit("DOCUMENT: "), doc), F.concat(F.lit("LOCATION: "), loc), F.concat(F.lit("TAGS: "), F.array_join(tags, ",")), text)


def search_text(doc: Column, loc: Column, tags: Column, text: Column) -> Column:
    """What is searched: the short header and the whole text."""
    return F.concat_ws("\n", F.concat(F.lit("DOC: "), doc), F.concat(F.lit("LOC: "), loc), F.concat(F.lit("TAGS: "), F.array_join(tags, ",")), text)


def full_embed_text(doc: Column, rank: Column, kind: Column, loc: Column, tags: Column, text: Column, identity: str = "") -> Column:
    """What is embedded, with the document's rank and type and a line that names the collection (left out where it is blank), a blank line, and the stripped text."""
    listed = F.when(F.size(tags) > 0, F.concat(F.lit("TAGS: "), F.array_join(tags, ", "))).otherwise("TAGS:")
    lines = [F.concat(F.lit("DOCUMENT: "), named(doc)), F.concat(F.lit("RANK: "), F.coalesce(rank.cast("string"), F.lit("0"))), F.concat(F.lit("TYPE: "), typed(kind)), F.concat(F.lit("LOCATION: "), loc), listed]
    return stripped(F.concat_ws("\n", *lines, *([F.lit(identity)] if identity else []), F.lit(""), stripped(F.coalesce(text, F.lit("")))))


def full_search_text(doc: Column, kind: Column, loc: Column, tags: Column, text: Column) -> Column:
    """What is searched, with the document's type, a blank line, and the stripped text."""
    listed = F.when(F.size(tags) > 0, F.concat(F.lit("TAGS: "), F.array_join(tags, ", "))).otherwise("TAGS:")
    lines = [F.concat(F.lit("DOC: "), named(doc)), F.concat(F.lit("TYPE: "), typed(kind)), F.concat(F.lit("LOC: "), loc), listed]
    return stripped(F.concat_ws("\n", *lines, F.lit(""), stripped(F.coalesce(text, F.lit("")))))


def named(doc: Column) -> Column:
    return stripped(F.when(F.coalesce(doc, F.lit("")) == "", F.lit("Unknown document")).otherwise(doc))


def typed(kind: Column) -> Column:
    return stripped(F.coalesce(kind, F.lit("")))


def matching_text(text: Column, search: Column) -> Column:
    """What fallbacks look through: the text, and the search text below it unless the text holds it already. Nulls are blank."""
    a, b = F.coalesce(text, F.lit("")), F.coalesce(search, F.lit(""))
    return F.when((b == "") | F.contains(a, b), a).otherwise(F.concat(a, F.lit("\n"), b))


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def query_words(c: Column, stop: list[str]) -> Column:
    """Words of a question that a keyword scan looks for."""
    plain = replaced(F.lower(c), "[^\\p{L}\\p{N}_\\x09-\\x0D -]")
    return F.filter(words_of(plain), lambda w: ~w.isin(stop) & (F.length(w) > 1))


def normal_text(c: Column) -> Column:
    return stripped(replaced(replaced(F.lower(c), "[^a-z0-9\\x{0600}-\\x{06FF}\\x09-\\x0D ]", " "), f"{WS}+", " "))


def expanded_text(c: Column, forms: dict[str, str], misspellings: dict[str, str] | None = None) -> Column:
    """The normal text of c with short forms written out, then misspellings put right, both word by word. Null is empty.

    Words are those of the text as it stands, so a short form that touches an underscore or a letter of another script stays; marks
    of the Arabic block belong to words.
    """
    written = F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^\\p{L}\\p{N}_\\x{0600}-\\x{06FF}]+"), lambda w: F.coalesce(lookup(w, forms), w))
    plain = normal_text(F.array_join(written, " "))
    return plain if not misspellings else F.array_join(F.transform(words_of(plain), lambda w: F.coalesce(lookup(w, misspellings), w)), " ")


def stem(t: Column) -> Column:
    n = F.length(t)
    return (
        F.when(n <= 3, t)
        .when(F.endswith(t, F.lit("ies")) & (n > 4), F.concat(F.substr(t, F.lit(1), n - 3), F.lit("y")))
        .when(F.endswith(t, F.lit("es")) & (n > 4), F.substr(t, F.lit(1), n - 2))
        .when(F.endswith(t, F.lit("s")) & ~F.endswith(t, F.lit("ss")) & (n > 4), F.substr(t, F.lit(1), n - 1))
        .otherwise(t)
    )


def overlap_tokens(c: Column, stop: list[str], short: list[str]) -> Column:
    return stems(words_of(normal_text(c)), stop, short)


def stems(words: Column, stop: list[str], short: list[str]) -> Column:
    """Stems of the words that count."""
    return F.transform(F.filter(words, lambda w: ~w.isin(stop) & ((F.length(w) >= 3) | w.isin(short))), stem)


def keywords(c: Column, stop: list[str], short: list[str], most: int = 12, drop: list[str] = ()) -> Column:
    toks = F.array_distinct(overlap_tokens(c, stop, short))
    return F.slice(F.filter(toks, lambda w: ~w.isin(list(drop))) if drop else toks, 1, most)


def lookup(word: Column, table: dict[str, str]) -> Column:
    """The dictionary's value, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), word)


def expand_words(c: Column, table: dict[str, str]) -> Column:
    return F.array_join(F.transform(words_of(c), lambda w: F.coalesce(lookup(F.lower(replaced(w, "[^a-zA-Z]")), table), w)), " ")


def fix_words(c: Column, table: dict[str, str]) -> Column:
    """Dictionary replacement that keeps an initial capital."""

    def fixed(w: Column) -> Column:
        to = lookup(F.lower(w), table)
        first = F.left(w, F.lit(1))
        return F.coalesce(F.when((first == F.upper(first)) & (first != F.lower(first)), F.concat(F.upper(F.left(to, F.lit(1))), F.substr(to, F.lit(2)))).otherwise(to), w)

    return F.array_join(F.transform(words_of(c), fixed), " ")


def schedule_number(c: Column, roman: dict[str, str]) -> Column:
    """'schedule 3' becomes 'Schedule-III', for the first such mention and numbers that have a numeral."""
    number = F.regexp_extract(c, "(?i)(?:^|[^a-z0-9_])schedule[ -]*([0-9]+)(?:$|[^a-z0-9_])", 1)
    to = F.when(number != "", lookup(number, roman))
    mention = F.regexp_extract(c, "(?i)(schedule[ -]*[0-9]+)", 1)
    at = F.instr(c, mention)
    out = F.concat(F.substr(c, F.lit(1), at - 1), F.lit("Schedule-"), to, F.substr(c, at + F.length(mention)))
    return F.coalesce(out, c)


def url_quoted(c: Column) -> Column:
    """Percent-encoding that keeps '/' and writes a space as %20."""
    return F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def book_rank(name: Column) -> Column:
    """The number after the word 'book', else 0."""
    return F.coalesce(F.regexp_extract(F.lower(name), "(?:^|[^a-z0-9_])book *([0-9]{1,9})", 1).try_cast("int"), F.lit(0))


def magic(content: Column) -> Column:
    """Audio kind from the first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(F.startswith(head, F.lit("52494646")) & F.endswith(head, F.lit("57415645")), "wav")
        .when(F.startswith(head, F.lit("494433")) | F.startswith(head, F.lit("FFFB")), "mp3")
        .when(F.startswith(head, F.lit("4F676753")), "ogg")
        .when(F.startswith(head, F.lit("1A45DFA3")), "webm")
        .when(F.substring(head, 9, 8) == "66747970", "m4a")
        .otherwise("bin")
    )
