"""A chunk store that a batch adds to: segments, delete vectors and compaction, merged when read.

A batch writes one segment: its own chunks and vectors, the ids of chunks that it retires, and its lines of the file
manifest. Nothing that is there is rewritten. Readers put segments together: rows of all, less what any of them retires.
``compact`` merges ``fanout`` segments of a level into one of the next, so a row is rewritten as often as there are levels.
A chunk's text lies on disk once: of columns that repeat it a segment holds what they add (``lean``), and readers get them whole.

A generation is a small file that names its segments, created if absent under the next number, on any file system that Spark reaches.
Of two publishers with the same parent one wins and the other gets ``Conflict``: it reads again and repeats its batch. The active
generation is the highest whole one; a torn or lost file means the one before. A batch id that is in already is not added again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources import bucketed, hadoop
from quillstone.sources.scratch import if_small, written


class Conflict(RuntimeError):
    """Another publisher has taken the generation."""


@dataclass(frozen=True)
class Segment:
    id: str
    level: int
    rows: int
    retired: int
    vectors: int
    files: int
    batches: tuple[int, ...] = ()


@dataclass(frozen=True)
class Generation:
    number: int = 0
    next_id: int = 1
    segments: tuple[Segment, ...] = field(default=())

    @property
    def batches(self) -> set[int]:
        return {b for s in self.segments for b in s.batches}


#: What a segment may hold, and the figure that says whether it does.
TABLES = {"chunks": "rows", "retired": "retired", "vectors": "vectors", "files": "files"}


#: Ids of chunks that are merged at a time: so many retired ones at most are sent to every task, and no text is dealt out for them.
SPAN = 1 << 19

#: Columns of chunks that repeat the text, and what a segment holds instead: what stands before it, or how much of it there is.
ENDS_WITH_TEXT = {"embed_text": "__embed_before", "search_text": "__search_before"}
BEGINS_TEXT = {"preview": "__preview_chars"}


def lean(rows: DataFrame) -> DataFrame:
    """Chunks as a segment holds them. A column that does not repeat the text of its row stays in that row as it is."""
    text, made = F.col("text") if "text" in rows.columns else None, {}
    for c, short in ENDS_WITH_TEXT.items() if text is not None else ():
        if c in rows.columns:
            before = F.substr(c, F.lit(1), F.length(c) - F.length(text))
            same = F.concat(before, text) == F.col(c)
            made |= {c: F.when(same, F.lit(None).cast("string")).otherwise(F.col(c)), short: F.when(same, before)}
    for c, short in BEGINS_TEXT.items() if text is not None else ():
        if c in rows.columns:
            same = F.left(text, F.length(c)) == F.col(c)
            made |= {c: F.when(same, F.lit(None).cast("string")).otherwise(F.col(c)), short: F.when(same, F.length(c))}
    return rows.withColumns(made) if made else rows


def whole(rows: DataFrame) -> DataFrame:
    """Chunks with the columns that ``lean`` took apart."""
    made = {c: F.coalesce(c, F.concat(short, "text")) for c, short in ENDS_WITH_TEXT.items() if short in rows.columns}
    made |= {c: F.coalesce(F.col(c), F.left("text", F.col(short))) for c, short in BEGINS_TEXT.items() if short in rows.columns}
    return rows.withColumns(made).drop(*ENDS_WITH_TEXT.values(), *BEGINS_TEXT.values()) if made else rows


def with_retired(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunks, those of ``gone`` (chunk_id, __at) inactive."""
    made = {"deactivated_at": F.coalesce("deactivated_at", "__at"), "active": F.col("active") & F.col("__at").isNull()}
    return rows.join(gone, "chunk_id", "left").withColumns(made).select(*rows.columns)


def without_retired(vectors: DataFrame, gone: DataFrame) -> DataFrame:
    return vectors.join(gone, "chunk_id", "left_anti")


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str
    fanout: int = 4

    def path(self, segment: str, table: str) -> str:
        return f"{self.root}/segments/{segment}/{table}"

    # ---- generations

    def numbers(self) -> list[int]:
        """Taken generation numbers, ascending, broken ones included."""
        return [int(n[:-5]) for n in hadoop.names(self.spark, f"{self.root}/generations") if n.endswith(".json")]

    def generation(self, number: int) -> Generation | None:
        """None if its file is lost or torn."""
        try:
            found = json.loads(hadoop.read_text(self.spark, f"{self.root}/generations/{number:012d}.json") or "")
            return Generation(found["number"], found["next_id"], tuple(Segment(**{**s, "batches": tuple(s["batches"])}) for s in found["segments"]))
        except (ValueError, KeyError, TypeError):
            return None

    def current(self) -> Generation:
        """The highest whole generation; an empty one to begin with."""
        return next((g for n in reversed(self.numbers()) if (g := self.generation(n))), Generation())

    def commit(self, parent: Generation, segments: tuple[Segment, ...], next_id: int) -> Generation:
        """The next generation after ``parent``. Torn ones between are passed over; a whole one means that another publisher was first."""
        made = None
        for number in range(parent.number + 1, max([parent.number, *self.numbers()]) + 2):
            if self.generation(number):
                raise Conflict(f"generation {number} is there already")
            made = Generation(number, next_id, segments)
        if not hadoop.create_new(self.spark, f"{self.root}/generations/{made.number:012d}.json", json.dumps(asdict(made))):
            raise Conflict(f"generation {made.number} was created meanwhile")
        return made

    # ---- reading

    def table(self, name: str, of: tuple[Segment, ...]) -> DataFrame | None:
        """One scan over the segments that hold the table; None if none does."""
        paths = [self.path(s.id, name) for s in of if getattr(s, TABLES[name])]
        found = self.spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None
        return whole(found) if found is not None and name == "chunks" else found

    def retired(self, of: tuple[Segment, ...]) -> DataFrame | None:
        found = self.table("retired", of)
        return None if found is None else found.groupBy("chunk_id").agg(F.min("deactivated_at").alias("__at"))

    def chunks(self, at: Generation | None = None) -> DataFrame | None:
        """All rows, retired ones inactive, from the segments as they lie."""
        g = at or self.current()
        rows, gone = self.table("chunks", g.segments), self.retired(g.segments)
        return rows if rows is None or gone is None else with_retired(rows, if_small(gone))

    def vectors(self, at: Generation | None = None) -> DataFrame | None:
        """Vectors of chunks that are not retired."""
        g = at or self.current()
        rows, gone = self.table("vectors", g.segments), self.retired(g.segments)
        return rows if rows is None or gone is None else without_retired(rows, if_small(gone))

    def files(self, at: Generation | None = None, removed: bool = False) -> DataFrame | None:
        """(filename, version, sha256): the last line of each file; of removed ones too if asked for."""
        rows = self.table("files", (at or self.current()).segments)
        if rows is None:
            return None
        last = rows.groupBy("filename").agg(F.max_by(F.struct("version", "sha256", "removed"), F.col("seq")).alias("f")).select("filename", "f.*")
        return last if removed else last.filter("not removed").drop("removed")

    # ---- writing

    def write(self, tables: dict[str, DataFrame | list[DataFrame] | None], level: int, batches: tuple[int, ...]) -> Segment:
        """A new segment; a table that comes in parts is written part by part. Empty tables leave no folder behind that anybody reads."""
        made = Segment(uuid.uuid4().hex, level, 0, 0, 0, 0, batches)
        for name, given in tables.items():
            parts = given if isinstance(given, list) else [] if given is None else [given]
            for i, df in enumerate(parts):
                df = lean(df) if name == "chunks" else df
                written(df, self.path(made.id, name), more=i > 0)
            if parts:
                made = replace(made, **{TABLES[name]: self.spark.read.schema(df.schema).parquet(self.path(made.id, name)).count()})
        return made

    def publish(self, batch: int, make: Callable[[Generation], tuple[dict[str, DataFrame | None], int]], tries: int = 5) -> Generation:
        """Add a batch: ``make`` gives its tables and the next free id for the generation that it is to follow. A conflict has it made again."""
        for left in range(tries, 0, -1):
            now = self.current()
            if batch in now.batches:
                return now
            tables, next_id = make(now)
            try:
                return self.commit(now, (*now.segments, self.write(tables, 0, (batch,))), next_id)
            except Conflict:
                if left == 1:
                    raise
        raise AssertionError("no tries")

    def merged(self, name: str, of: tuple[Segment, ...], less: Callable[[DataFrame, DataFrame], DataFrame]) -> list[DataFrame] | None:
        """Chunks or vectors of some segments, after ``less`` took account of the ids that these retire: in parts of SPAN ids, to be written one after another."""
        rows, gone = self.table(name, of), self.retired(of)
        if rows is None or gone is None:
            return None if rows is None else [rows]
        low, high = rows.agg(F.coalesce(F.min("chunk_id"), F.lit(0)), F.coalesce(F.max("chunk_id"), F.lit(0))).first()
        spans = [F.col("chunk_id").between(i, i + SPAN - 1) for i in range(low, high + 1, SPAN)]
        return [less(rows.filter(s), F.broadcast(gone.filter(s))) for s in spans]

    def compact(self) -> Generation:
        """Merge segments until no level has ``fanout`` of them. Retired rows stay as inactive ones, their vectors go, of manifest lines the last of a file stays."""
        while True:
            now = self.current()
            level = next((k for k in sorted({s.level for s in now.segments}) if sum(s.level == k for s in now.segments) >= self.fanout), None)
            if level is None:
                return now
            mine = tuple(s for s in now.segments if s.level == level)
            gone, rows, files = self.table("retired", mine), self.table("chunks", mine), self.table("files", mine)
            elsewhere = gone if gone is None or rows is None else gone.join(rows.select("chunk_id"), "chunk_id", "left_anti")
            files = None if files is None else files.groupBy("filename").agg(F.max_by(F.struct("version", "sha256", "removed", "seq"), F.col("seq")).alias("f")).select("filename", "f.*")
            merged = self.write({"chunks": self.merged("chunks", mine, with_retired), "vectors": self.merged("vectors", mine, without_retired), "retired": elsewhere, "files": files}, level + 1, tuple(b for s in mine for b in s.batches))
            self.commit(now, (merged, *(s for s in now.segments if s.level != level)), now.next_id)

    def serve(self, buckets: int) -> tuple[DataFrame, DataFrame]:
        """Chunks and vectors of the current generation as tables bucketed by chunk_id, written once for each generation, for many batches of questions."""
        now = self.current()
        folder = f"{self.root}/serving/{now.number:012d}"
        made = {"chunks": self.chunks, "vectors": self.vectors}
        found = {n: bucketed.opened(self.spark, f"{folder}/{n}") for n in made}
        chunks, vectors = (bucketed.write(make(now), f"{folder}/{n}", buckets) if found[n] is None else found[n] for n, make in made.items())
        return chunks, vectors

    def expire(self, keep: int = 3) -> list[str]:
        """Delete generations beyond the newest ``keep``, and segments that none of these names."""
        numbers = self.numbers()
        for n in numbers[:-keep]:
            hadoop.delete(self.spark, f"{self.root}/generations/{n:012d}.json")
        used = {s.id for n in numbers[-keep:] if (g := self.generation(n)) for s in g.segments}
        for s in hadoop.names(self.spark, f"{self.root}/serving"):
            if int(s) not in numbers[-keep:]:
                hadoop.delete(self.spark, f"{self.root}/serving/{s}")
        old = [s for s in hadoop.names(self.spark, f"{self.root}/segments") if s not in used]
        for s in old:
            hadoop.delete(self.spark, f"{self.root}/segments/{s}")
        return old
