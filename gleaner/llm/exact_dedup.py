"""Exact dedup by deterministic block naming, in DataFrame operations only.

Normalised texts are cut into blocks of ``block`` bytes.  The distinct blocks
are sorted and get integer names by their order; then adjacent pairs of names
are sorted and named in the same way, level by level, until each document has
one name.  Equal names mean equal bytes: a name belongs to one content, and
blocks whose hash meets another block's are told apart by the block itself.

Names are integers (partition number, place in the sorted partition), so
naming needs no task that sees all blocks.  Only the distinct blocks move with
their content: documents look up names by the blocks' hash, and by content
just where a hash has several blocks.

Edge cases.  Null counts as empty, and empty texts are equal to each other.
Of equal texts the row with the smallest id stays; rows without id come after
all others; of rows that share the smallest id one stays.  Long texts have more
blocks and levels.  Other columns are not read, so none can clash.  No rows, no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import input_columns, pinned, scope


#: Stands for the neighbour that the last block of an odd number lacks; no name
#: is equal to it: names are 0 and up, those of blocks that were looked up whole
#: -2 and down.
NONE = -1


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t-\\r]+", " ")


def _named(things: DataFrame) -> DataFrame:
    """Distinct things, sorted, with integer names; distinct() has brought
    equal ones to one partition, whose number is part of the names."""
    return things.distinct().sortWithinPartitions(*things.columns).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, *, block: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a number for each row), id, sha256 of the normalised text, level
    and name: equal texts, and no others, have the same level and name."""
    rows = docs.select(*input_columns(docs, id=id_col, text=text_col))
    rows = rows.select("id", normalised(F.col("text")).cast("binary").alias("text")).withColumn("row", F.monotonically_increasing_id())
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("text") / block), F.lit(1)) - 1), lambda i: F.substring(F.col("text"), (i * block + 1).cast("int"), F.lit(block)))
    blocks = rows.select("row", F.posexplode(cut).alias("at", "block"))
    hashed = blocks.select(F.xxhash64("block").alias("h"), "block")
    names = pinned(_named(hashed).select("h", "name"))
    # A row and its blocks' hashes: what the later levels work on.
    hashes = F.transform(cut, lambda b: F.xxhash64(b))
    base = pinned(rows.select("row", "id", F.sha2("text", 256).alias("sha256"), hashes.alias("hashes")))
    places = base.select("row", F.size("hashes").alias("n"), F.posexplode("hashes").alias("at", "h"))
    shared = pinned(names.groupBy("h").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1").select("h"))
    named = places.join(names, "h")
    if not shared.isEmpty():
        # Hashes that several blocks have: these blocks are looked up whole.
        again = _named(hashed.join(shared, "h", "left_semi")).select("h", "block", (NONE - 1 - F.col("name")).alias("name"))
        whole = blocks.withColumn("h", F.xxhash64("block")).join(again, ["h", "block"]).select("row", "at", "name")
        whole = places.join(shared, "h", "left_semi").join(whole, ["row", "at"])
        named = named.join(shared, "h", "left_anti").select("row", "n", "at", "name").unionByName(whole.select("row", "n", "at", "name"))
    named = named.select("row", "n", "at", "name")
    level, found = 0, None
    named = pinned(named)
    while True:
        done = named.where("n = 1").select("row", F.lit(level).alias("level"), "name")
        found = done if found is None else found.unionByName(done)
        named = named.where("n > 1")
        if named.isEmpty():
            break
        level += 1
        # Names of neighbours meet in one row; 2 * at is the left one.
        pairs = named.groupBy("row", F.floor(F.col("at") / 2).alias("at"), F.ceil(F.col("n") / 2).alias("n")).agg(
            F.min(F.struct("at", "name")).alias("x"), F.when(F.count(F.lit(1)) == 2, F.max(F.struct("at", "name"))).alias("y")
        )
        pairs = pinned(pairs.select("row", "n", "at", F.col("x.name").alias("a"), F.coalesce("y.name", F.lit(NONE)).alias("b")))
        new = pinned(_named(pairs.select("a", "b")))
        named = pinned(pairs.join(new, ["a", "b"]).select("row", "n", "at", "name"))
    return base.select("row", "id", "sha256").join(found, "row")


def dedup(docs: DataFrame, *, block: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256 of every row."""
    # Written first, so that Spark can split a large group in the join.
    # What named the texts goes when they have their names.
    with scope(docs.sparkSession) as kept:
        rows = pinned(identities(docs, block=block, id_col=id_col, text_col=text_col))
        kept.append(rows)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    groups = rows.groupBy("level", "name").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    out = rows.join(pinned(groups), ["level", "name"])
    return out.select(
        F.col("id").alias(id_col), F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), F.col("sha256").alias("text_sha256")
    )
