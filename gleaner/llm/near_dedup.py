"""MinHash near-dedup with circulant signatures.

1. Each text becomes the set of its distinct word shingles.  Texts of the same
   words form a class with one representative; the rest works on these.
2. Circulant MinHash: two permutations, one circularly shifted, give all
   coordinates of a signature.  Bands of ``rows`` coordinates are buckets; the
   number of bands follows from the threshold, so that a pair at the threshold
   shares no bucket with a probability of ``miss`` at most.
3. Representatives that share buckets, directly or through others, form a
   cluster.  Within it every pair that shares a bucket and isn't known to be in
   one component is confirmed on the full sets.  A cluster larger than a block
   is first thinned out: all its members are compared with a few pivots, and the
   largest component that this gives needs no comparison within itself.  The
   rest is compared block by block; a text goes to the blocks that hold one
   it shares a bucket with.  A block holds a bounded number of documents and
   shingles, so no task holds a cluster.
4. Components of the confirmed links; a document's component is the smallest
   id that can be reached.

Pairs are never written out: a block gives a spanning forest of its links.
Hashes only choose what is compared: sizes of sets are counted, and links are
confirmed, on numbers that stand for one shingle each; texts are one class if
a 128-bit cryptographic hash of their words is the same.

Edge cases.  Null and empty texts, and texts without words, have an empty set
and are linked with nothing.  Texts of fewer words than a shingle are one
shingle.  Rows that repeat an id count as one document, which has the links of
all of them.  Rows without id are linked with nothing and have no component;
they are kept.  Long texts are compared whole.  Other columns are not read, so
none can clash.  No rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import input_columns, package_on_workers, pinned, released, scope, small_batches
from .components import components
from .shingles import Circulant, digest, shingles, split

#: Documents and shingles of a block: two blocks are a task's share of a cluster.
BLOCK_DOCS = 144
BLOCK_SHINGLES = 1 << 20
#: Members of a large cluster that all others are compared with, and documents
#: that a block has for that.
PIVOTS = 3
PIVOT_DOCS = 48


def bands_for(percent: int, rows: int, miss: float) -> int:
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))


def features(rows: DataFrame, words: int, rows_of_band: int, bands: int) -> DataFrame:
    """id, h, n (size of the set), digest and bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = Circulant(rows_of_band * bands)
        for part in blocks(batches):
            texts = [split(x.as_py()) for x in part.column("text")]
            sets, hashes = shingles(texts, words)
            found = [minhash.bands(h, rows_of_band) if len(h) else None for h in hashes]
            n = pa.array(list(map(len, sets)), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), n, pa.array(list(map(digest, texts)), pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["id", "h", "n", "digest", "bands"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "h", "text").mapInArrow(released(run), f"id {kind}, h long, n long, digest binary, bands array<long>")


def blocks(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The rows in blocks of about ``most`` bytes of text."""
    for batch in batches:
        held = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)) // most
        cuts = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), len(batch)]
        yield from (batch.slice(x, y - x) for x, y in zip(cuts, cuts[1:]) if y > x)


def _forest(batch: pa.Table, words: int, percent: int) -> pa.Table:
    """Links between members that share a bucket and aren't in one component
    yet: a spanning forest.  side 0 is compared with all, side 1 just with side
    0; where blocks x and y of side 0 meet, just members of both."""
    v, side, own = (batch[c].to_numpy() for c in ("v", "side", "own"))
    order = np.lexsort((v, side))
    v, side, own = v[order], side[order], own[order]
    across = batch["kind"][0].as_py() == 0 and batch["x"][0].as_py() != batch["y"][0].as_py()
    texts = batch["text"].take(pa.array(order))
    sets = shingles([split(x.as_py()) for x in texts], words)[0]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    bands = np.stack(batch["bands"].take(pa.array(order)).combine_chunks().to_numpy(zero_copy_only=False))
    # Components so far, as places in this block, and dense numbers of shingles.
    comp = np.unique(batch["comp"].to_numpy()[order], return_inverse=True)[1]
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    has = np.zeros(codes.max(initial=0) + 1, np.bool_)
    links = []
    for i in range(int((side == 0).sum())):
        fits = (comp != comp[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
        fits[: i + 1] = False
        if across:
            fits &= own != own[i]
        near = np.flatnonzero(fits)
        near = near[(bands[near] == bands[i]).any(axis=1)]
        if not len(near):
            continue
        mine = codes[ends[i] - size[i] : ends[i]]
        has[mine] = True
        for j in near.tolist():
            if comp[j] == comp[i]:  # by a link that was just found
                continue
            both = int(np.count_nonzero(has[codes[ends[j] - size[j] : ends[j]]]))
            if 100 * both >= percent * (size[j] + size[i] - both):
                links.append((v[i], v[j]))
                comp[comp == comp[j]] = comp[i]
        has[mine] = False
    a, b = zip(*links) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _candidates(reps: DataFrame) -> DataFrame:
    """Edges (a, b) from each representative to the least one of its buckets."""
    buckets = reps.where("n > 0").select("v", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("v").alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket", "b")
    # Written first, so that Spark can split a large bucket in the join.
    return buckets.join(pinned(shared), "bucket").where("v <> b").select(F.col("v").alias("a"), "b").distinct()


def _rooted(vertices: DataFrame, stars: DataFrame, name: str) -> DataFrame:
    """vertices (v and more) with their root; alone, a vertex is its own."""
    return vertices.join(stars.withColumnRenamed("root", name), "v", "left").withColumn(name, F.coalesce(name, "v"))


#: What _forest gets of each member of a meeting.
MEETING = ["cluster", "x", "y", "kind", "v", "n", "comp", "side", "own", "bands", "text"]


def _met(meetings: DataFrame, words: int, percent: int) -> DataFrame:
    return meetings.select(*MEETING).groupBy("cluster", "x", "y", "kind").applyInArrow(lambda t: _forest(t, words, percent), "a long, b long")


def _blocks_of(docs: Column, shingles: Column, most: int | None = None) -> Column:
    return F.ceil(F.greatest(docs / (most or BLOCK_DOCS), shingles / BLOCK_SHINGLES)).cast("int")


def _dealt(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("v", F.lit(9)), F.greatest(blocks, F.lit(1))).cast("int")


def _main(held: DataFrame) -> DataFrame:
    """held (v, cluster, n, comp) with main: whether a member is in the largest
    component of its cluster."""
    sizes = held.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("docs"))
    largest = pinned(sizes.groupBy("cluster").agg(F.max(F.struct("docs", "comp")).getField("comp").alias("largest")))
    return pinned(held.join(largest, "cluster").select("v", "cluster", "n", "comp", (F.col("comp") == F.col("largest")).alias("main")))


def _with_pivots(rest: DataFrame, drawn_from: DataFrame, turn: int) -> DataFrame:
    """Meetings (without texts) of blocks of rest with a few pivots of the same
    cluster, which are drawn anew in each turn."""
    sizes = pinned(rest.groupBy("cluster").agg(_blocks_of(F.count(F.lit(1)), F.sum("n"), PIVOT_DOCS).alias("blocks")))
    order = lambda k: F.xxhash64("v", F.lit(turn * PIVOTS + k))
    drawn = [F.min(F.struct(order(k).alias("o"), "v", "n", "comp")).alias(f"p{k}") for k in range(PIVOTS)]
    chosen = drawn_from.groupBy("cluster").agg(*drawn).join(sizes, "cluster")
    chosen = chosen.select("cluster", "blocks", F.explode(F.array_distinct(F.transform(F.array(*[f"p{k}" for k in range(PIVOTS)]), lambda p: F.struct(p["v"].alias("v"), p["n"].alias("n"), p["comp"].alias("comp"))))).alias("p"))
    pivots = chosen.select("cluster", "p.*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"), F.lit(0).alias("side"))
    dealt = rest.join(sizes, "cluster").select("cluster", "v", "n", "comp", _dealt(F.col("blocks")).alias("y"), F.lit(1).alias("side"))
    return dealt.unionByName(pivots).select("*", F.lit(-1).alias("x"), F.lit(1).alias("kind"), F.col("y").alias("own"))


def _rest_of_large(held: DataFrame, bands: DataFrame) -> DataFrame:
    """Meetings (without texts) of what pivots left: each two blocks of the rest
    (kind 0), and each block of the rest with those of the main component (kind
    1).  held: v, cluster, n, comp, main; bands: v, bands."""
    sizes = held.groupBy("cluster").agg(*[_blocks_of(F.sum(F.when(F.col("main") == k, 1).otherwise(0)), F.sum(F.when(F.col("main") == k, F.col("n")).otherwise(0))).alias(f"b{int(k)}") for k in (False, True)])
    dealt = held.join(pinned(sizes.where("b0 > 0")), "cluster").withColumn("side", F.col("main").cast("int"))
    dealt = pinned(dealt.withColumn("own", _dealt(F.when(F.col("main"), F.col("b1")).otherwise(F.col("b0")))).select("v", "cluster", "n", "comp", "side", "own"))
    # A member goes to the blocks of the rest that have one of its buckets.
    buckets = dealt.join(bands, "v").select("v", "side", "own", F.explode("bands").alias("bucket"))
    to = pinned(buckets.where("side = 0").groupBy("bucket").agg(F.collect_set("own").alias("to")))
    asked = buckets.select("v", "bucket").join(to, "bucket").groupBy("v").agg(F.array_distinct(F.flatten(F.collect_list("to"))).alias("to"))
    met = dealt.join(asked, "v").withColumn("to", F.explode("to"))
    x = F.when(F.col("side") == 1, F.col("to")).otherwise(F.least("own", "to"))
    y = F.when(F.col("side") == 1, F.col("own")).otherwise(F.greatest("own", "to"))
    met = pinned(met.withColumns({"x": x, "y": y, "kind": F.col("side")}).drop("to"))
    # A block of the rest meets each block of the main component that comes to it.
    main_blocks = pinned(met.where("kind = 1").select("cluster", F.col("x").alias("own"), "y").distinct())
    others = dealt.where("side = 0").join(main_blocks, ["cluster", "own"]).withColumns({"x": F.col("own"), "kind": F.lit(1)})
    return met.unionByName(others.select(*met.columns))


def links(reps: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) that connect whatever can be connected.

    reps: v, n, bands and the key (id, h) of a text; texts: id, h, text.
    """
    clusters = pinned(components(_candidates(reps)))
    clustered = clusters.select("v", F.col("root").alias("cluster")).unionByName(clusters.select(F.col("root").alias("v"), F.col("root").alias("cluster")).distinct())
    keys = reps.select("v", "id", "h", "n", "bands").join(clustered, "v")
    # One text for each key, though rows may repeat.
    # Keys grow with the input, so the same join is asked for at every size.
    found = texts.join(keys.hint("merge"), ["id", "h"]).groupBy("v", "n", "cluster").agg(F.any_value("text").alias("text"), F.any_value("bands").alias("bands"))
    members = pinned(found)
    sizes = members.groupBy("cluster").agg(_blocks_of(F.count(F.lit(1)), F.sum("n")).alias("blocks"))
    large = pinned(sizes.where("blocks > 1").select("cluster"))
    zero = F.lit(0)
    small = members.join(large, "cluster", "left_anti").select("*", zero.alias("x"), zero.alias("y"), zero.alias("kind"), zero.alias("side"), zero.alias("own"), F.col("v").alias("comp"))
    confirmed = _met(small, words, percent)
    if large.isEmpty():
        return confirmed
    content = members.select("v", "text", "bands")
    start = pinned(members.select("v", "cluster", "n").join(large, "cluster", "left_semi"))
    everyone = start.withColumn("comp", F.col("v"))
    known = pinned(_met(_with_pivots(everyone, everyone, 0).join(content, "v"), words, percent))
    left, turn = start.count(), 1
    while True:
        held = _main(_rooted(start, components(known), "comp"))
        rest = held.where("not main")
        before, left = left, rest.count()
        if not left:
            return confirmed.unionByName(known)
        if 2 * left > before:
            break
        # As long as pivots halve the rest, others of the main component are tried.
        more = pinned(_met(_with_pivots(rest, held.where("main"), turn).join(content, "v"), words, percent))
        known, turn = pinned(known.unionByName(more)), turn + 1
    met = _rest_of_large(held, members.select("v", "bands"))
    return confirmed.unionByName(known).unionByName(_met(met.join(content, "v"), words, percent))


def classes(
    docs: DataFrame,
    *,
    words: int = 5,
    percent: int = 80,
    rows: int = 6,
    miss: float = 1e-6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, h, n_shingles, component_id, kept of every row; (id, h) is the
    row's key, h the hash of its text."""
    package_on_workers(docs.sparkSession)
    # Only the result stays; texts, sets and rounds go when it is written.
    with scope(docs.sparkSession) as kept:
        out = pinned(_classes(docs, words, percent, rows, miss, id_col, text_col))
        kept.append(out)
    return out


def _classes(docs: DataFrame, words: int, percent: int, rows: int, miss: float, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(*input_columns(docs, id=id_col, text=text_col)).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("h", F.xxhash64("text"))
    with small_batches(docs.sparkSession):
        feats = pinned(features(texts, words, rows, bands_for(percent, rows, miss)))
    usable = feats.where("n > 0 and id is not null")
    first = usable.groupBy("digest").agg(F.min(F.struct("id", "h")).alias("k"), F.min(F.struct("n", "bands")).alias("f"))
    reps = pinned(first.select("digest", "k.id", "k.h", "f.n", "f.bands").withColumn("v", F.monotonically_increasing_id()))
    edges = links(reps.drop("digest"), texts.where("id is not null"), words, percent)
    # Classes that have an id in common (rows that repeat it) are linked.
    several = usable.groupBy("id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("id")
    if not several.isEmpty():
        keyed = usable.join(several, "id").select("id", "digest").distinct().join(reps.select("v", "digest"), "digest")
        least_of = keyed.groupBy("id").agg(F.min("v").alias("b"))
        edges = edges.unionByName(keyed.join(least_of, "id").where("v <> b").select(F.col("v").alias("a"), "b"))
    roots = _rooted(reps.select("v", "digest", "id"), components(edges), "root")
    least = pinned(roots.groupBy("root").agg(F.min("id").alias("component")))
    of_digest = roots.join(least, "root").select("digest", "component")
    out = feats.join(of_digest.withColumn("some", F.lit(True)), (feats["digest"] == of_digest["digest"]) & (feats["n"] > 0) & feats["id"].isNotNull(), "left")
    component = F.coalesce("component", feats["id"])
    return out.select(feats["id"].alias(id_col), "h", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == feats["id"], F.lit(True)).alias("kept"))
