"""Column functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from quillstone import lexicon
from quillstone.functions import text as T
from quillstone.operators import answers, chunking


@pytest.fixture(scope="module")
def value(spark):
    return lambda make, *args: spark.range(1).select(make(*[F.lit(a) for a in args]).alias("x")).first().x


def test_cleaning(value):
    assert value(T.clean_general, "a\0\0b\r\n  c  \n\n\n\n\n d") == "a b\nc\n\n\nd"
    assert value(T.clean_chunk, "a \t b") == "a b"
    assert value(T.normal_line, "Page 12  of 345") == "page 0 of 0"


@pytest.mark.parametrize("line,want", [("Page 3 of 9", True), ("12/2024", True), ("Regulation", False), ("", False)])
def test_header_candidates(value, line, want):
    assert value(T.is_header_candidate, line) is want


def test_rows_and_headings(value):
    assert value(T.looks_like_row, "Serial No\tName   Grade") and not value(T.looks_like_row, "Sr No\tName   Grade")
    assert value(T.normal_row, "Sr No\tName   Grade") == "Sr No | Name | Grade"
    assert [value(T.is_heading, x) for x in ("SCHEDULE II", "CONTENTS", "OK")] == [True, True, False]
    assert value(T.role_heading, "Position Title: - Database Administrator") == "Database Administrator"
    assert value(T.role_heading, "Report To: Director General") is None


@pytest.mark.parametrize("name,want", [("book21 Artificial.pdf", 21), ("My Book 7.pdf", 7), ("notebook3.pdf", 0), ("Annex 3.pdf", 0)])
def test_book_rank(value, name, want):
    assert value(T.book_rank, name) == want


@pytest.mark.parametrize("t,want", [("12 / 34", True), ("Page 4 of 10", True), ("Fees apply", True), ("Schedule I", False), ("", True)])
def test_low_signal(value, t, want):
    assert value(lambda c: T.is_low_signal(c, lexicon.KEEP_MARKS), t) is want


def test_tags_and_labels(value):
    assert value(lambda c: T.tags(c, lexicon.TAGS), "The body shall consist of members.") == ["composition", "members"]
    label = lambda a, b: T.loc_label(F.lit("page"), F.lit(a).cast("long"), F.lit(b).cast("long"), F.lit(None).cast("string"))
    assert [value(lambda: label(*x)) for x in ((3, 3), (3, 5), (None, None))] == ["Page 3", "Pages 3-5", ""]


@pytest.mark.parametrize("word,want", [("policies", "policy"), ("boxes", "box"), ("class", "class"), ("laws", "laws"), ("rules", "rul")])
def test_stem(value, word, want):
    assert value(T.stem, word) == want


def test_questions(value):
    assert value(lambda c: T.fix_words(c, lexicon.TYPOS), "Salery of offcer") == "Salary of officer"
    expand = lambda c: T.schedule_number(T.expand_words(c, lexicon.ABBREVIATIONS), lexicon.ROMAN)
    assert [value(expand, q) for q in ("schedule 3", "schedule 11", "cto?", "what is it")] == ["Schedule-III", "schedule 11", "Chief Technology Officer", "what is Information Technology"]


def test_bytes_and_urls(value):
    assert value(T.url_quoted, "/a b/c.pdf") == "/a%20b/c.pdf"
    assert value(T.magic, b"RIFF\0\0\0\0WAVE") == "wav" and value(T.magic, b"OggS") == "ogg" and value(T.magic, b"zz") == "bin"


@pytest.mark.parametrize("tail,want", [("ulatory Authority shall", "Authority shall"), (", then more", ", then more"), ("abc. Def", ". Def")])
def test_overlap_trim(value, tail, want):
    assert value(chunking.trimmed_overlap, tail) == want


def test_greetings_and_languages(value):
    split = lambda c: answers.greeting_split(c, lexicon.GREETINGS)
    assert [tuple(value(split, x)) for x in ("AOA what is section 3?", "hi", "", "what now")] == [("B", "what is section 3?"), ("A", ""), ("A", ""), ("C", "what now")]
    assert [value(answers.language, x) for x in ("क", "سلام", "ye kya hai", "hello")] == ["unsupported", "urdu", "roman_urdu", "english"]


def test_boosts(value):
    assert value(answers.boosts, "salary table", "Minimum Pay and Maximum Pay") == 5
    assert value(answers.boosts, "who is it", "Mr. Khan") == 3
    assert value(answers.boosts, "appeal procedure", "Position Title: x") == -2
    assert value(answers.boosts, "what of schedule-iii", "Schedule-III of") == 3
