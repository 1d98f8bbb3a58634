"""Chunking: windows over long texts, greedy packing, overlap, and the rules for short chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.functions import text as T


def window_slices(df: DataFrame, text: str = "text", most: int = 4500, overlap: int = 350, tail: bool = False) -> DataFrame:
    """(…, slice_no, begin, piece): steps of max(200, most - overlap). ``tail`` repeats the last ``most`` characters of oversize texts once more."""
    step = max(200, most - overlap)
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - most) / step)).cast("int")
    begins = F.transform(F.sequence(F.lit(0), last), lambda i: i * step)
    if tail:
        begins = F.when(F.length(text) > most, F.concat(begins, F.array(F.length(text) - most))).otherwise(begins)
    cut = df.select("*", F.posexplode(begins).alias("slice_no", "begin"))
    return cut.withColumn("piece", F.substr(F.col(text), F.col("begin") + 1, F.lit(most)))


def packed(blocks: DataFrame, key: str, order: str, size: str, most: int) -> DataFrame:
    """(key, order, chunk_no): greedy packing, a new chunk where size + 2 would pass ``most``.

    A true fold; it runs over (order, size) pairs only, so texts never enter it.
    """
    rows = blocks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), F.col(size).cast("long").alias("s")))).alias("bs"))
    start = F.struct(F.lit(0).cast("long").alias("no"), F.lit(0).cast("long").alias("size"), F.array().cast("array<struct<o:bigint,no:bigint>>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        over = (acc["size"] > 0) & (acc["size"] + b["s"] + 2 > most)
        no = acc["no"] + F.when(over, 1).otherwise(0)
        size_now = F.when(over | (acc["size"] == 0), b["s"]).otherwise(acc["size"] + b["s"] + 2)
        return F.struct(no.alias("no"), size_now.alias("size"), F.concat(acc["out"], F.array(F.struct(b["o"].alias("o"), no.alias("no")))).alias("out"))

    return rows.select(key, F.explode(F.aggregate("bs", start, step, lambda a: a["out"])).alias("x")).select(key, F.col("x.o").alias(order), F.col("x.no").alias("chunk_no"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def block_marks(lines: Column) -> Column:
    """What block boundaries depend on, for each line."""
    mark = lambda x: F.struct(x.alias("line"), (x == "").alias("blank"), T.role_heading(x).alias("title"), T.is_heading(x).alias("heading"), T.is_structured(x).alias("structured"))
    return F.transform(lines, mark)


def block_spans(marks: Column) -> Column:
    """array<struct<lo,hi,title>>: lines lo to hi - 1 are a block. Blocks end at blank lines, headings, role titles and switches between prose and structure."""
    n = F.size(marks)

    def begins(i: Column) -> Column:
        x, before = F.element_at(marks, i), F.get(marks, i - 2)
        return x["blank"] | x["title"].isNotNull() | x["heading"] | F.coalesce(before["blank"] | (x["structured"] != before["structured"]), F.lit(True))

    def spans(at: Column) -> Column:
        made = F.transform(at, lambda e, k: F.struct(e.alias("lo"), F.coalesce(F.get(at, k + 1), n + 1).alias("hi"), F.element_at(marks, e)["title"].alias("title"), F.element_at(marks, e)["blank"].alias("blank")))
        return F.filter(made, lambda b: ~b["blank"])

    return let(F.when(n > 0, F.filter(F.sequence(F.lit(1), n), begins)).otherwise(F.array().cast("array<int>")), spans)


def block_segments(text: Column) -> Column:
    """array<struct<role,structured,n_lines,n_chars>> of a text's non-empty lines, block by block; the text stays in its row."""

    def described(m: Column) -> Column:
        def block(b: Column) -> Column:
            part = F.slice(m, b["lo"], b["hi"] - b["lo"])
            return F.struct(b["title"].alias("role"), F.exists(part, lambda x: x["structured"]).alias("structured"), F.size(part).cast("long").alias("n_lines"), F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + F.length(x["line"])).alias("n_chars"))

        return F.transform(block_spans(m), block)

    return let(block_marks(T.line_list(text)), described)


def role_groups(text: Column) -> Column:
    """array<struct<role,texts>>: blocks of a cleaned text in order, those under one role title together."""

    def grouped(m: Column) -> Column:
        def of_blocks(blocks: Column) -> Column:
            at = F.sequence(F.lit(1), F.size(blocks))
            title = lambda b: F.element_at(blocks, b)["title"]
            named = F.filter(at, lambda b: title(b).isNotNull())
            turns = let(named, lambda r: F.filter(r, lambda b, k: F.coalesce(title(F.get(r, k - 1)) != title(b), F.lit(True)) | (k == 0)))
            starts = F.when(title(F.lit(1)).isNull(), F.concat(F.array(F.lit(1)), turns)).otherwise(turns)
            words = lambda b: F.array_join(F.transform(F.slice(m, b["lo"], b["hi"] - b["lo"]), lambda x: x["line"]), "\n")
            of = lambda s: F.transform(s, lambda lo, k: F.struct(title(lo).alias("role"), F.transform(F.slice(blocks, lo, F.coalesce(F.get(s, k + 1), F.size(blocks) + 1) - lo), words).alias("texts")))
            return F.when(F.size(blocks) > 0, let(starts, of))

        return let(block_spans(m), of_blocks)

    return let(block_marks(F.transform(F.split(text, "\n"), T.stripped)), grouped)


def packed_texts(texts: Column, most: int, overlap: int) -> Column:
    """array<string>: block texts packed greedily into chunks of up to ``most`` characters; a longer block is sliced by itself, and its end is repeated.

    The fold runs over lengths and keeps chunk borders only, so it copies nothing per block.
    """
    step = max(200, most - overlap)
    empty = F.array().cast("array<struct<lo:int,hi:int>>")
    start = F.struct(empty.alias("cuts"), F.lit(1).alias("lo"), F.lit(0).alias("size"))
    span = lambda lo, hi: F.array(F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi")))

    def add(acc: Column, i: Column) -> Column:
        n = F.length(F.element_at(texts, i))
        held = acc["size"] > 0
        done = F.when(held, F.concat(acc["cuts"], span(acc["lo"], i))).otherwise(acc["cuts"])
        alone = F.struct(F.concat(done, span(i, i + 1)).alias("cuts"), (i + 1).cast("int").alias("lo"), F.lit(0).alias("size"))
        fresh = F.struct(done.alias("cuts"), i.cast("int").alias("lo"), (n + 2).cast("int").alias("size"))
        more = F.struct(acc["cuts"].alias("cuts"), F.when(held, acc["lo"]).otherwise(i).cast("int").alias("lo"), (acc["size"] + n + 2).cast("int").alias("size"))
        return F.when(n > most, alone).when(held & (acc["size"] + n + 2 > most), fresh).otherwise(more)

    def finish(acc: Column) -> Column:
        return F.when(acc["size"] > 0, F.concat(acc["cuts"], span(acc["lo"], F.size(texts) + 1))).otherwise(acc["cuts"])

    def sliced(b: Column) -> Column:
        last = F.ceil((F.length(b) - most) / step).cast("int")
        return F.concat(F.transform(F.sequence(F.lit(0), last), lambda k: F.substr(b, k * step + 1, F.lit(most))), F.array(F.right(b, F.lit(most))))

    def made(c: Column) -> Column:
        first = F.element_at(texts, c["lo"])
        return F.when((c["hi"] - c["lo"] == 1) & (F.length(first) > most), sliced(first)).otherwise(F.array(F.array_join(F.slice(texts, c["lo"], c["hi"] - c["lo"]), "\n\n")))

    cuts = F.aggregate(F.sequence(F.lit(1), F.size(texts)), start, add, finish)
    return F.filter(F.transform(F.flatten(F.transform(cuts, made)), T.clean_chunk), lambda x: x != "")


def stitched(chunks: Column, overlap: int) -> Column:
    """Each chunk after the first begins with the trimmed end of the one before (80 to 500 characters)."""
    cap = max(80, min(overlap, 500))

    def begun(c: Column, i: Column) -> Column:
        tail = T.stripped(trimmed_overlap(T.stripped(F.right(F.get(chunks, i - 1), F.lit(cap)))))
        return F.when((i == 0) | (tail == ""), c).otherwise(T.clean_chunk(F.concat(tail, F.lit("\n\n"), c)))

    return F.transform(chunks, begun) if overlap else chunks


def chunked(text: Column, most: int = 4500, overlap: int = 350, least: int = 200, keep: list[str] = ()) -> Column:
    """array<string>: the chunks of a unit's text, all within its row.

    A short text is one chunk. Else: blocks, grouped under role titles, packed, stitched by their
    ends; a short chunk stays if it is alone in its group, marked, or last with ten long words; a
    role that the text does not name is put before it.
    """
    marked = lambda x: reduce(lambda a, m: a | F.contains(F.lower(x), F.lit(m)), keep, F.lit(False))

    def group(g: Column) -> Column:
        def kept(cs: Column) -> Column:
            good = lambda c, i: (F.length(c) >= least) | (F.size(cs) == 1) | marked(c) | ((i == F.size(cs) - 1) & (T.long_words(c, 3) >= 10))
            return F.transform(F.filter(cs, good), lambda c: with_context(c, g["role"]))

        return let(let(packed_texts(g["texts"], most, overlap), lambda cs: stitched(cs, overlap)), kept)

    def whole(t: Column) -> Column:
        long = F.flatten(F.transform(F.coalesce(role_groups(t), F.array().cast("array<struct<role:string,texts:array<string>>>")), group))
        return F.when(t == "", F.array().cast("array<string>")).when(F.length(t) < least, F.array(t)).otherwise(long)

    return let(T.clean_chunk(F.coalesce(text, F.lit(""))), whole)


def trimmed_overlap(tail: Column) -> Column:
    """A tail that begins inside a word starts at the first boundary within 20 characters."""
    at = F.regexp_instr(tail, F.lit("[^\\p{L}\\p{N}_]"))
    inside = F.rlike(tail, F.lit("^[\\p{L}\\p{N}_]")) & at.between(2, 20)
    return F.when(inside, T.replaced(F.substr(tail, at), f"^{T.WS}+")).otherwise(tail)


def with_overlap(pieces: DataFrame, key: str, order: str, piece: str, overlap: int) -> DataFrame:
    """Prefix each piece with the trimmed end of the one before."""
    before = F.lag(piece).over(W.partitionBy(key).orderBy(order))
    return pieces.withColumn("overlap", F.coalesce(trimmed_overlap(F.right(before, F.lit(overlap))), F.lit("")))


def kept_chunks(chunks: DataFrame, key: str, order: str, text: str, least: int, keep: list[str]) -> DataFrame:
    """Short chunks stay if alone, if marked, or if last with ten long words."""
    alone = F.count(F.lit(1)).over(W.partitionBy(key)) == 1
    last = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order))) == 1
    low = F.lower(text)
    marked = F.lit(False)
    for m in keep:
        marked = marked | F.contains(low, F.lit(m))
    flagged = chunks.withColumn("keep", (F.length(text) >= least) | alone | marked | (last & (T.long_words(F.col(text), 3) >= 10)))
    return flagged.filter("keep").drop("keep")


def with_context(c: Column, role: Column) -> Column:
    """Prefix the role unless the text already names it."""
    return F.when(role.isNotNull() & ~F.contains(F.lower(c), F.lower(role)), F.concat(F.lit("[Role: "), role, F.lit("]\n"), c)).otherwise(c)
