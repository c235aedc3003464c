"""Line dedup: drops lines that many documents share.

Texts are split at \\n.  A line's key is the line without white space at both
ends, with A-Z in lower case.  Keys of at least ``min_chars`` code points are
exploded and hashed (MD5, 16 bytes); the documents of each hash are counted.
Lines whose key is in at least ``min_docs`` documents are dropped from all of
them but the one with the largest id.  The places of the lines to drop go back
to their document, and the other lines are joined again in their order.

A hash that many lines share is counted by document first, so no task holds a
group; the text itself moves once, for the last join.

Edge cases.  Null and empty texts are one empty line, and stay empty.  A text
that loses all its lines becomes empty.  Rows that repeat an id count as one
document; if it is the largest, all of them keep their lines.  Rows without id
keep their lines and don't count.  A key that occurs several times in the
document that keeps it stays there each time.  Long texts are split whole.
Columns that come along do so in a struct, others aren't read, so none can
clash.  No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, input_columns, lowered, pinned


def key(line: Column) -> Column:
    return F.btrim(lowered(line), F.lit(SPACE))


def dedup_lines(
    docs: DataFrame,
    *,
    min_chars: int = 40,
    min_docs: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """id, text (the lines that stay), n_lines, n_dropped of every row.

    carry: columns of docs that come along in a struct named ``row``.
    """
    rest = F.struct(*[docs[c] for c in carry]) if carry else F.lit(None)
    rows = docs.select(*input_columns(docs, id=id_col, text=text_col), rest.alias("row")).withColumn("text", F.coalesce("text", F.lit("")))
    # The digest tells rows apart that repeat an id with another text.
    rows = rows.withColumn("digest", F.xxhash64("text"))

    line = F.explode(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("at"), key(x).alias("key")))).alias("line")
    lines = rows.where("id is not null").select("id", "digest", line).select("id", "digest", "line.at", "line.key")
    lines = lines.where(F.length("key") >= min_chars).select("id", "digest", "at", F.unhex(F.md5("key")).alias("hash"))
    counted = lines.groupBy("hash", "id").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("one").alias("n"), F.max("id").alias("keeper"))
    # Written first, so that Spark can split a frequent hash in the join.
    frequent = pinned(counted.where(F.col("n") >= min_docs).select("hash", "keeper"))
    places = lines.join(frequent, "hash").where("id <> keeper").groupBy("id", "digest").agg(F.array_sort(F.collect_set("at")).alias("drop"))
    # A flag for each line up to the last one to drop, "1" to drop: looked up
    # by position, so a long text costs no more than its length.
    gaps = F.transform("drop", lambda p, i: F.concat(F.repeat(F.lit("0"), p - F.when(i == 0, -1).otherwise(F.get("drop", i - 1)) - 1), F.lit("1")))
    flags = places.select(F.col("id").alias("of"), F.col("digest").alias("of_digest"), F.split(F.array_join(gaps, ""), "").alias("flags"), F.size("drop").alias("n"))
    joined = rows.join(flags.hint("merge"), (F.col("id") == F.col("of")) & (F.col("digest") == F.col("of_digest")), "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: F.coalesce(F.get("flags", i), F.lit("0")) != "1")
    text = F.when(F.col("n").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = [
        F.col("id").alias(id_col),
        text.alias("text"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long").alias("n_lines"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_dropped"),
    ]
    return joined.select(*out, *(["row"] if carry else []))
