"""Chunks of sections: window chunking, ids and links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import content_id, stripped


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: parts of a lambda aren't shared."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _end(text: Column, n: Column, stop: Column, most: int) -> Column:
    """Where a window that reaches to ``stop`` ends."""
    look = stop - most // 5

    def broken(tail: Column) -> Column:
        line, sentence = F.instr(tail, F.lit("\n")), F.instr(tail, F.lit(" ."))
        return F.when(line > 0, stop - line).when(sentence > 0, stop - sentence - 1).otherwise(-1)

    tail = F.reverse(F.substring(text, look + 1, F.lit(most // 5)))
    cut = _let(_let(tail, broken), lambda found: F.when(found > look, found + 1).otherwise(stop))
    return F.when(stop < n, cut).otherwise(stop)


def windows(text: Column, most: int = 2000, overlap: int = 200) -> Column:
    """The chunks of one section, an array of texts.

    A section of at most ``most`` characters stays as it is.  A longer one is
    cut into windows; a window that isn't the last ends after its last line
    break, else after its last sentence end, if that stands in its last fifth.
    Windows are stripped, blank ones left out; the next begins ``overlap``
    characters before the end.
    """
    if not 0 <= overlap < most - most // 5:
        raise ValueError("the overlap must be below four fifths of the window")
    n = F.length(text)
    steps = F.sequence(F.lit(0), F.floor(n / (most - most // 5 - overlap)).cast("int") + 1)

    def cut(done: Column, _: Column) -> Column:
        return F.when(done["at"] >= n, done).otherwise(_let(F.least(done["at"] + most, n), lambda stop: _let(_end(text, n, stop, most), lambda end: put(done, end))))

    def put(done: Column, end: Column) -> Column:
        after = F.when(end < n, end - overlap).otherwise(n).cast("int").alias("at")
        return _let(stripped(F.substring(text, done["at"] + 1, end - done["at"])), lambda part: F.struct(after, F.when(part == "", done["out"]).otherwise(F.concat(done["out"], F.array(part))).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    blank = stripped(text) == ""
    return F.when(text.isNull() | blank, F.array().cast("array<string>")).when(n <= most, F.array(text)).otherwise(F.aggregate(steps, start, cut, lambda s: s["out"]))


def chunk(sections: DataFrame, most: int = 2000, overlap: int = 200) -> DataFrame:
    """document_id, position, heading, text, id from sections (document_id,
    section, heading, text); positions run on through a document's sections."""
    parts = sections.select("document_id", "section", "heading", F.posexplode(windows(F.col("text"), most, overlap)).alias("part", "text"))
    order = Window.partitionBy("document_id").orderBy("section", "part")
    parts = parts.withColumn("position", F.row_number().over(order) - 1)
    return parts.select("document_id", "position", "heading", "text", content_id(F.col("document_id"), F.col("position")).alias("id"))


def next_links(items: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """key and next_key of neighbours within a group."""
    after = F.lead(key).over(Window.partitionBy(group).orderBy(order, key))
    return items.select(F.col(key).alias("id"), after.alias("next_id")).where("next_id is not null")
