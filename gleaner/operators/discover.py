"""Discovery: similarity pairs, bridges, outliers, hubs, gaps, meta links."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from ..functions.columns import NOISE_PATTERNS, bridge_score, dot, entity_bridge_score, gap_kept, gap_score, hash_order, noisy, path_distance
from ..sources.staging import package_on_workers
from . import cells
from .graph import dealt

THRESHOLD = 0.65
#: Groups of vectors in the similarity join, and the most rows of one.
GROUPS, MOST = 24, 32_768
#: Cosines that are computed at once.
AT_ONCE = 2_000_000
#: Pairs that are sorted by tile at once, to be packed.
PACKED = 500_000
#: Sides of rows in a tile other than 0 and 1: of one group with itself; no vectors but pairs.
WITHIN, PAIRS = 2, 3


def sampled(chunks: DataFrame, raw: int, final: int, seed: int = 0, least_chars: int = 80, noise: tuple[str, ...] = NOISE_PATTERNS) -> DataFrame:
    """A reproducible sample: of ``raw`` chunks in hash order, the first
    ``final`` whose path (doc_path) is no noise and whose text is long enough."""
    drawn = chunks.where("embedding is not null").withColumn("o", hash_order(seed, F.col("id"))).orderBy("o").limit(raw)
    return drawn.where(~noisy(F.col("doc_path"), noise) & (F.length("text") >= least_chars)).orderBy("o").limit(final).drop("o")


class _Deal(NamedTuple):
    """How vectors are dealt to groups, two of which meet in a tile."""

    rows: DataFrame  # id, e, cell, group and what is carried
    tiles: list[tuple[int, int]]
    meets: np.ndarray | None  # which cells have to be compared; None: all
    compared: int
    by_id: Callable[[Column], Column] | None  # the group by the id alone, if it goes by that


def _deal(vectors: DataFrame, threshold: float, block: int, cell_rows: int, carry: Iterable[str | Column] = ()) -> _Deal:
    """Groups hold neighbouring cells, or parts of cells, of about equal numbers
    of rows.  There are GROUPS of them at most, so that a vector is copied no
    more often in a larger table, unless one had more than MOST rows."""
    narrow = vectors.schema["embedding"].dataType == ArrayType(FloatType())
    e = F.col("embedding") if narrow else F.col("embedding").cast("array<double>").alias("embedding")
    rows = vectors.where("embedding is not null").select("id", e, *carry)
    n = rows.count()
    counts, meets, compared, at = np.array([n]), None, n * (n - 1) // 2, rows.withColumn("cell", F.lit(0))
    if n > max(block, 2 * cell_rows):
        middle = cells.centres(rows, min(1024, n // cell_rows), n)
        placed = cells.placed(rows, middle)
        found = {r.cell: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect() if r.cell != cells.NOWHERE or threshold <= 0}
        names = sorted(found)
        kept = [c for c in names if c != cells.NOWHERE]
        # Vectors without a direction have cosine 0 with all; theirs is the first cell.
        near = np.ones((len(names), len(names)), bool)
        if kept:
            near[-len(kept) :, -len(kept) :] = cells.meeting(middle[kept], np.array([found[c].radius for c in kept]), threshold)
        sizes = np.array([found[c].n for c in names], np.int64)
        twice = int(sizes @ near @ sizes) - int(sizes[np.diag(near)].sum())
        # Cells that rule out less than half aren't worth their bounds.
        if twice // 2 <= compared // 2:
            counts, meets, compared = sizes, near, twice // 2
            known = vectors.sparkSession.createDataFrame([(c, i, int(o), int(k)) for i, (c, o, k) in enumerate(zip(names, np.cumsum(sizes) - sizes, sizes))], "cell int, at int, first long, size long")
            at = placed.drop("angle").join(F.broadcast(known), "cell").drop("cell").withColumnRenamed("at", "cell")
    total = int(counts.sum())
    g = max(min(GROUPS, -(-total // block)), -(-total // MOST))
    by_id = None
    if meets is None:
        by_id = lambda c: F.floor(F.pmod(F.xxhash64(c.cast("long")), F.lit(max(1, n))) * g / max(1, n)).cast("int")
        at = at.withColumn("group", by_id(F.col("id")))
    else:
        at = at.withColumn("group", F.floor((F.col("first") + F.pmod(F.xxhash64("id"), F.col("size"))) * g / total).cast("int")).drop("first", "size")
    tiles = [(x, y) for x in range(g) for y in range(x, g)]
    if meets is not None and total:
        first = np.cumsum(counts) - counts
        low, high = first * g // total, (first + counts - 1) * g // total
        holds = (low[None, :] <= np.arange(g)[:, None]) & (high[None, :] >= np.arange(g)[:, None])
        some = holds.astype(np.int64) @ meets @ holds.T.astype(np.int64) > 0
        tiles = [t for t in tiles if some[t]]
    return _Deal(at.withColumnRenamed("embedding", "e"), tiles, meets, compared, by_id)


def comparisons(vectors: DataFrame, threshold: float = THRESHOLD, block: int = 1024, cell_rows: int = 256) -> tuple[int, int]:
    """How many pairs similar_pairs compares, and how many there are."""
    n = vectors.where("embedding is not null").count()
    return _deal(vectors, threshold, block, cell_rows).compared, n * (n - 1) // 2


def _by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each tile, from batches that are sorted by it."""
    held, at = [], None
    for batch in batches:
        tile = batch.column("tile").to_numpy()
        cuts = (np.flatnonzero(np.diff(tile)) + 1).tolist()
        for i, j in zip([0, *cuts], [*cuts, len(tile)]):
            if i == j:
                continue
            if held and tile[i] != at:
                yield pa.Table.from_batches(held)
                held = []
            at = tile[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _hits(rows: pa.Table, meets: np.ndarray | None, threshold: float, most: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """p, q, similarity: places in a tile's rows of the pairs that pass, the
    smaller id first.  Single precision finds them, double precision decides."""
    e = rows["e"].combine_chunks()
    sizes = pc.list_value_length(e).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors have different lengths")
    side, cell, ids = (rows[c].to_numpy() for c in ("side", "cell", "id"))
    wide = cells.units(e.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(side), -1))
    d = wide.shape[1]
    order = np.lexsort((cell, side))
    within = bool(len(side)) and side[0] == WITHIN
    left, right = (order, order) if within else (order[side[order] == 0], order[side[order] == 1])
    if not len(left) or not len(right):
        return
    x, y = (wide[k].astype(np.float32) for k in (left, right))
    slack = 1e-6 + (d + 8) * 2.0**-23
    cuts = [] if meets is None else (np.flatnonzero(np.diff(cell[left])) + 1).tolist()
    for start, end in zip([0, *cuts], [*cuts, len(left)]):
        near = np.arange(len(right)) if meets is None else np.flatnonzero(meets[cell[left[start]], cell[right]])
        there = y if len(near) == len(right) else y[near]
        i = start
        while i < end:
            # Within a group each two meet once.
            skip = int(np.searchsorted(near, i)) if within else 0
            width = len(near) - skip
            if not width:
                break
            stop = min(end, i + max(1, min(256, AT_ONCE // width)))
            sims = x[i:stop] @ there[skip:].T
            fits = sims >= np.float32(threshold - slack)
            if most < 1:
                fits &= sims <= np.float32(most + slack)
            at, to = np.divmod(np.flatnonzero(fits), width)
            at, to = at + i, near[to + skip]
            if within:
                at, to = at[to > at], to[to > at]
            p, q = left[at], right[to]
            step = max(1, 4_000_000 // max(1, d))
            exact = [np.einsum("ij,ij->i", wide[p[k : k + step]], wide[q[k : k + step]]) for k in range(0, len(p), step)]
            if exact:
                sim = np.round(np.concatenate(exact), 6)
                keep = (sim >= threshold) & (sim <= most)
                p, q, sim = p[keep], q[keep], sim[keep]
                swap = ids[p] > ids[q]
                if len(p):
                    yield np.where(swap, q, p), np.where(swap, p, q), sim
            i = stop


def _tiled(deal: _Deal, threshold: float, most: float, fold: Callable, kinds: str, more: DataFrame | None = None) -> DataFrame:
    """What fold(rows, hits) gives for each tile.  more: tile, a, b of pairs,
    packed, that the fold gets with the tile's rows (side PAIRS)."""
    spark = deal.rows.sparkSession
    package_on_workers(spark)
    number = {t: k for k, t in enumerate(deal.tiles)}
    copies = [(x, number[x, y], WITHIN if x == y else 0) for x, y in deal.tiles] + [(y, number[x, y], 1) for x, y in deal.tiles if x < y]
    dealt = deal.rows.join(F.broadcast(spark.createDataFrame(copies, "group int, tile int, side int")), "group").drop("group")
    if more is not None:
        dealt = dealt.unionByName(more.withColumn("side", F.lit(PAIRS)), allowMissingColumns=True)
    meets, n = deal.meets, max(1, len(deal.tiles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_tile(batches):
            own, pairs = rows, None
            if "a" in rows.column_names:
                is_pair = pc.equal(rows["side"], PAIRS)
                own, packed = rows.filter(pc.invert(is_pair)), rows.filter(is_pair)
                pairs = pa.table({c: pc.list_flatten(packed[c]) for c in ("a", "b")})
            if len(own):
                hits = _hits(own, meets, threshold, most)
                yield from fold(own, hits) if pairs is None else fold(own, hits, pairs)

    # A tile is much work for little data, so it isn't put together with others.
    return dealt.repartitionById(n, F.col("tile")).sortWithinPartitions("tile").mapInArrow(run, kinds)


def _packed(pairs: DataFrame) -> DataFrame:
    """tile, a, b of pairs (tile, a, b), many of a tile in one row: a and b are
    lists.  A pair by itself would take the room of a row with all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def lists() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            tile = rows["tile"].to_numpy()
            order = np.argsort(tile, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(tile[order]) != 0))
            ends = pa.array(np.append(first, len(tile)).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(tile[order][first]), *[pa.ListArray.from_arrays(ends, pa.array(rows[c].to_numpy()[order])) for c in ("a", "b")]], names=["tile", "a", "b"])

        for batch in batches:
            if len(batch):
                held.append(batch)
                n += len(batch)
            if n >= PACKED:
                yield lists()
                held, n = [], 0
        if held:
            yield lists()

    package_on_workers(pairs.sparkSession)
    return pairs.select("tile", "a", "b").mapInArrow(run, "tile int, a array<long>, b array<long>")


def _six_places(x: np.ndarray) -> np.ndarray:
    """Numbers to six places as Spark's round gives them: half up, by the
    digits that a number is written with."""
    scaled = np.abs(x) * 1e6
    whole = np.floor(scaled)
    part = scaled - whole
    out = np.copysign((whole + (part >= 0.5)) / 1e6, x)
    # Rounding errors of the product decide these few.
    for i in np.flatnonzero(np.abs(part - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return np.where(scaled < 1e9, out + 0.0, x)


def _pairs_of(rows: pa.Table, hits: Iterator) -> Iterator[pa.RecordBatch]:
    ids = rows["id"].to_numpy()
    for p, q, sim in hits:
        yield pa.RecordBatch.from_arrays([pa.array(ids[p]), pa.array(ids[q]), pa.array(sim)], names=["a", "b", "similarity"])


def similar_pairs(vectors: DataFrame, threshold: float = THRESHOLD, most: float = 1.0, block: int = 1024, cell_rows: int = 256) -> DataFrame:
    """a, b, similarity of all pairs a < b of vectors (id long, embedding)
    whose cosine, to six places, is from threshold to most.

    Vectors are dealt to cells by direction; two cells are compared only if the
    angle between their centres, less both radii, allows the threshold.  Cells
    are put together to a fixed number of groups; each two groups are compared
    in a task, piece by piece, and only the pairs that pass come out.  Up to
    1024 cells and which of them meet are on the driver.
    """
    return _tiled(_deal(vectors, threshold, block, cell_rows), threshold, most, _pairs_of, "a long, b long, similarity double")


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """A number for each different value, -1 for null, and the values."""
    coded = column.combine_chunks().dictionary_encode()
    return pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _apart(code: np.ndarray, hits: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The hits of two different values, neither of them null."""
    for p, q, sim in hits:
        keep = (code[p] != code[q]) & (code[p] >= 0) & (code[q] >= 0)
        if keep.any():
            yield p[keep], q[keep], sim[keep]


def cross_document_pairs(chunks: DataFrame, threshold: float = THRESHOLD, most: float = 1.0, k: int | None = None) -> DataFrame:
    """a, b, similarity of the similar pairs whose chunks have different paths
    (doc_path); with k the k most similar, ties by a and b."""

    def fold(rows: pa.Table, hits: Iterator) -> Iterator[pa.RecordBatch]:
        apart = _apart(_codes(rows["doc_path"])[0], hits)
        if k is None:
            yield from _pairs_of(rows, apart)
            return
        ids, best, least = rows["id"].to_numpy(), None, -np.inf
        for p, q, sim in apart:
            keep = sim >= least
            new = [ids[p][keep], ids[q][keep], sim[keep]]
            best = new if best is None else [np.concatenate(x) for x in zip(best, new)]
            first = np.lexsort((best[1], best[0], -best[2]))[:k]
            best = [x[first] for x in best]
            least = best[2][-1] if len(first) == k and k else least
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], names=["a", "b", "similarity"])

    out = _tiled(_deal(chunks, threshold, 1024, 256, ["doc_path"]), threshold, most, fold, "a long, b long, similarity double")
    return out if k is None else out.orderBy(F.desc("similarity"), "a", "b").limit(k)


def _best_of_documents(rows: pa.Table, hits: Iterator) -> Iterator[pa.RecordBatch]:
    """Of each two documents the pairs that may be the best by bridge_score.

    Between two documents the distance is one, so what is left of the score
    decides; its rounding to six places isn't done here, so all pairs that come
    that near to the best stay, of equal ones the first.
    """
    ids, (code, paths) = rows["id"].to_numpy(), _codes(rows["doc_path"])
    length = rows["len"].cast(pa.float64()).to_numpy()
    held, waiting, n = None, [], 0

    def best(parts: list) -> list:
        key, value, p, q, sim = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ids[q], ids[p], -value, key))
        key, value = key[order], value[order]
        first = np.append(True, key[1:] != key[:-1])
        top = value[first][np.cumsum(first) - 1]
        keep = (value >= top - 3e-6) & (first | np.append(True, value[1:] != value[:-1]))
        return [key[keep], value[keep], *[x[order[keep]] for x in (p, q, sim)]]

    for p, q, sim in _apart(code, hits):
        value = sim * (0.6 + 0.4 * np.fmin((length[p] + length[q]) / 2 / 400, 1.0))
        key = np.minimum(code[p], code[q]) * len(paths) + np.maximum(code[p], code[q])
        waiting.append(best([[key, value, p, q, sim]]))
        n += len(waiting[-1][0])
        # Merged when as much is new as is held.
        if n > max(100_000, 0 if held is None else len(held[0])):
            held, waiting, n = best([*([held] if held else []), *waiting]), [], 0
    if held or waiting:
        _, _, p, q, sim = best([*([held] if held else []), *waiting])
        path, chars = rows["doc_path"].combine_chunks(), rows["len"].combine_chunks()
        at, to = pa.array(p), pa.array(q)
        out = [pa.array(ids[p]), pa.array(ids[q]), path.take(at), path.take(to), chars.take(at), chars.take(to), pa.array(sim)]
        yield pa.RecordBatch.from_arrays(out, names=["a", "b", "path_a", "path_b", "len_a", "len_b", "similarity"])


def bridges(chunks: DataFrame, threshold: float = THRESHOLD, k: int | None = 10) -> DataFrame:
    """Similar chunks of different documents, the best of each pair of documents."""
    deal = _deal(chunks, threshold, 1024, 256, ["doc_path", F.length("text").alias("len")])
    rows = _tiled(deal, threshold, 1.0, _best_of_documents, "a long, b long, path_a string, path_b string, len_a int, len_b int, similarity double")
    score = bridge_score(F.col("similarity"), path_distance(F.col("path_a"), F.col("path_b")), (F.col("len_a") + F.col("len_b")) / 2)
    rows = rows.select("a", "b", F.least("path_a", "path_b").alias("doc_a"), F.greatest("path_a", "path_b").alias("doc_b"), "similarity", F.round(score, 6).alias("score"))
    best = Window.partitionBy("doc_a", "doc_b").orderBy(F.desc("score"), "a", "b")
    rows = rows.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")
    return rows if k is None else rows.orderBy(F.desc("score"), "a", "b").limit(k)


def outliers(chunks: DataFrame) -> DataFrame:
    """The most isolated chunk of each document: 1 less the mean cosine to all
    other chunks, weighted by length.

    The mean comes from the sum of all unit vectors, so no pairs are made.
    """
    rows = chunks.where("embedding is not null").select("id", "doc_path", F.length("text").alias("len"), F.col("embedding").cast("array<double>").alias("e"))
    norm = F.sqrt(dot(F.col("e"), F.col("e")))
    rows = rows.withColumn("norm", norm).withColumn("u", F.when(F.col("norm") > 0, F.transform("e", lambda x: x / F.col("norm"))).otherwise(F.transform("e", lambda x: F.lit(0.0))))
    # One row: a vector of sums and a count.
    sums = rows.select(F.posexplode("u")).groupBy("pos").agg(F.sum("col").alias("s"))
    total = sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("total")).crossJoin(rows.agg(F.count(F.lit(1)).alias("n")))
    mean = F.when(F.col("n") > 1, (dot(F.col("u"), F.col("total")) - dot(F.col("u"), F.col("u"))) / F.greatest(F.col("n") - 1, F.lit(1))).otherwise(0.0)
    rows = rows.crossJoin(F.broadcast(total)).withColumn("mean", mean)
    score = F.round((1 - F.col("mean")) * (0.5 + 0.5 * F.least(F.col("len") / 400, F.lit(1.0))), 6)
    rows = rows.select("id", "doc_path", F.round("mean", 6).alias("avg_similarity"), score.alias("score"))
    best = Window.partitionBy("doc_path").orderBy(F.desc("score"), "id")
    return rows.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def _reach_of_chunks(rows: pa.Table, hits: Iterator) -> Iterator[pa.RecordBatch]:
    """For each chunk the other documents that it reaches in a tile, and the
    sum (in millionths) and the number of its similarities."""
    code, paths = _codes(rows["doc_path"])
    n, d = len(code), max(1, len(paths))
    total, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
    # Each chunk and document once: as a table, or sorted numbers where it would be large.
    seen = np.zeros((n, d), bool) if n * d <= 1 << 26 else None
    held, waiting, new = np.zeros(0, np.int64), [], 0
    for p, q, sim in _apart(code, hits):
        of, other = np.concatenate([p, q]), np.concatenate([code[q], code[p]])
        micro = np.round(sim * 1e6)
        # Sums of a piece are whole numbers far below 2^53.
        total += np.bincount(of, np.concatenate([micro, micro]), n).astype(np.int64)
        count += np.bincount(of, minlength=n)
        if seen is not None:
            seen[of, other] = True
            continue
        waiting.append(np.unique(of * d + other))
        new += len(waiting[-1])
        if new > max(1_000_000, len(held)):
            held, waiting, new = np.unique(np.concatenate([held, *waiting])), [], 0
    at = np.flatnonzero(count)
    if not len(at):
        return
    of, other = np.nonzero(seen) if seen is not None else np.divmod(np.unique(np.concatenate([held, *waiting])), d)
    ends = pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=n)[at])).astype(np.int32))
    others = pa.ListArray.from_arrays(ends, pa.array(paths, pa.string()).take(pa.array(other)))
    yield pa.RecordBatch.from_arrays([rows["id"].combine_chunks().take(pa.array(at)), rows["doc_path"].combine_chunks().take(pa.array(at)), others, pa.array(total[at]), pa.array(count[at])], names=["id", "doc_path", "others", "total", "n"])


def hubs(chunks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The best connected chunk of each document: reach over documents times strength."""
    found = _tiled(_deal(chunks, threshold, 1024, 256, ["doc_path"]), threshold, 1.0, _reach_of_chunks, "id long, doc_path string, others array<string>, total long, n long")
    docs = chunks.where("embedding is not null").agg(F.countDistinct("doc_path").alias("docs"))  # one row
    reach = F.size(F.array_distinct(F.flatten(F.collect_list("others")))).cast("long")
    stats = found.groupBy("id", "doc_path").agg(reach.alias("reach"), (F.round(F.sum("total") / F.sum("n")) / 1e6).alias("strength")).crossJoin(F.broadcast(docs))
    score = F.col("reach") / F.greatest(F.col("docs") - 1, F.lit(1)) * (0.4 + 0.6 * F.col("strength"))
    rows = stats.select("id", "doc_path", "reach", "strength", F.round(score, 6).alias("score"))
    best = Window.partitionBy("doc_path").orderBy(F.desc("score"), "id")
    return rows.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def cooccurrences(mentions: DataFrame, k: int | None = 50, seed: int = 0, parts: int | None = None) -> DataFrame:
    """Chunks of different documents that mention one entity, k of them drawn
    at random, with the bridge score.  mentions: chunk, doc, path, entity.

    An entity's pairs aren't all made: a document takes part with one chunk, and
    the first documents in hash order make at least k pairs among them.  Each of
    these stands for as many as the entity has, and the draw goes by that
    weight.  Without k all pairs of chunks come out.
    """
    m = dealt(mentions.select("chunk", "doc", "path", "entity"), parts, "entity").distinct()
    counts = m.groupBy("entity").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("doc").alias("docs"))
    if k is not None:
        most = math.ceil(0.5 + math.sqrt(0.25 + 2 * k))  # so many make k pairs
        order = hash_order(seed, F.concat_ws(":", "entity", "chunk"))
        m = m.withColumn("o", order).groupBy("entity", "doc").agg(F.min(F.struct("o", "chunk", "path")).alias("x")).select("entity", "doc", "x.*")
        m = m.withColumn("r", F.row_number().over(Window.partitionBy("entity").orderBy("o"))).where(F.col("r") <= most).drop("o", "r")
    other = m.select(F.col("chunk").alias("chunk_b"), F.col("doc").alias("doc_b"), F.col("path").alias("path_b"), "entity")
    pairs = m.join(other, "entity").where("chunk < chunk_b and doc <> doc_b").join(counts, "entity")
    if k is not None:
        # The k smallest of -ln(u) / weight are a draw by weight.
        u = (F.conv(F.left(hash_order(seed, F.concat_ws(":", "entity", "chunk", "chunk_b")), F.lit(13)), 16, 10).cast("double") + 1) / float(1 << 52)
        held = F.least(F.col("docs"), F.lit(most))
        weight = F.col("docs") * (F.col("docs") - 1) / (held * (held - 1))
        pairs = pairs.withColumn("key", -F.ln(u) / weight).orderBy("key", "entity", "chunk", "chunk_b").limit(k)
    score = entity_bridge_score(path_distance(F.col("path"), F.col("path_b")), F.col("mentions"))
    return pairs.select("entity", F.col("chunk").alias("a"), F.col("chunk_b").alias("b"), "mentions", F.round(score, 6).alias("score"))


def entity_hubs(mentions: DataFrame, least_docs: int = 3, k: int = 20) -> DataFrame:
    """Entities of many documents; the score's total is the number of
    documents among the rows that are returned."""
    top = mentions.groupBy("entity").agg(F.countDistinct("doc").alias("docs"), F.min("chunk").alias("sample_chunk")).where(F.col("docs") >= least_docs)
    top = top.orderBy(F.desc("docs"), "entity").limit(k)
    total = mentions.join(F.broadcast(top.select("entity")), "entity").agg(F.countDistinct("doc").alias("total"))  # k rows; one row
    return top.crossJoin(F.broadcast(total)).select("entity", "docs", "sample_chunk", F.round(F.least(F.lit(1.5) * F.col("docs") / F.col("total"), F.lit(1.0)), 6).alias("score"))


def entity_gaps(incoming: DataFrame, mentions: DataFrame, kinds: DataFrame, k: int = 15) -> DataFrame:
    """Entities that are referred to more than they are mentioned.

    incoming: entity of each typed relation; mentions: entity, chunk; kinds:
    entity, type.  Both sides are aggregated before they are joined.
    """
    i = incoming.groupBy("entity").agg(F.count(F.lit(1)).alias("incoming"))
    m = mentions.groupBy("entity").agg(F.countDistinct("chunk").alias("mentions"))
    rows = kinds.join(i, "entity").join(m, "entity", "left").fillna(0, ["mentions"]).where("incoming >= 2 and mentions < incoming")
    rows = rows.where(gap_kept(F.col("type"), F.col("incoming"), F.col("mentions")))
    rows = rows.select("entity", "type", "incoming", "mentions", F.round(gap_score(F.col("incoming"), F.col("mentions")), 6).alias("score"))
    return rows.orderBy(F.desc("score"), F.desc("incoming"), "entity").limit(k)


def bridged_pairs(sources: DataFrame, among: DataFrame) -> DataFrame:
    """a, b: the two of ``among`` (id) that an insight (insight, source) of the
    second layer is derived from, if it has exactly two of them."""
    found = sources.join(among.select(F.col("id").alias("source")), "source", "left_semi").groupBy("insight").agg(F.array_sort(F.collect_set("source")).alias("s"))
    return found.where(F.size("s") == 2).select(F.col("s")[0].alias("a"), F.col("s")[1].alias("b")).distinct()


def _not_bridged(rows: pa.Table, hits: Iterator, bridged: pa.Table) -> Iterator[pa.RecordBatch]:
    """The pairs of different strategies that aren't among the bridged ones."""
    ids, code = rows["id"].to_numpy(), _codes(rows["strategy"])[0]
    strategy, score = rows["strategy"].combine_chunks(), rows["score"].combine_chunks()
    unknown, score = score.is_null().to_numpy(zero_copy_only=False), pc.fill_null(score, 0.0).to_numpy()
    by_id = np.argsort(ids)
    places = [np.minimum(np.searchsorted(ids, bridged[c].to_numpy(), sorter=by_id), len(ids) - 1) for c in ("a", "b")]
    known = np.ones(len(bridged), bool)
    for c, at in zip(("a", "b"), places):
        known &= ids[by_id[at]] == bridged[c].to_numpy()
    done = np.unique(places[0][known] * len(ids) + places[1][known])
    rank = np.empty(len(ids), np.int64)
    rank[by_id] = np.arange(len(ids))
    for p, q, sim in _apart(code, hits):
        if len(done):
            key = rank[p] * len(ids) + rank[q]
            keep = done[np.minimum(np.searchsorted(done, key), len(done) - 1)] != key
            p, q, sim = p[keep], q[keep], sim[keep]
        at, to = pa.array(p), pa.array(q)
        # As numbers, here: a decimal for each pair is what takes longest in a plan.
        value = pa.array(_six_places(sim * (0.5 + 0.5 * (score[p] + score[q]) / 2)), mask=unknown[p] | unknown[q])
        yield pa.RecordBatch.from_arrays([pa.array(ids[p]), pa.array(ids[q]), strategy.take(at), strategy.take(to), pa.array(sim), value], names=["a", "b", "strategy_a", "strategy_b", "similarity", "score"])


def meta_pairs(insights: DataFrame, bridged: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Similar insights (id, strategy, score, embedding) of different
    strategies that no insight bridges yet.

    Bridged pairs are dealt to the tiles, so the similar pairs, of which there
    may be many more, aren't moved at all.
    """
    deal = _deal(insights, threshold, 1024, 256, ["strategy", F.col("score").cast("double").alias("score")])
    pairs = bridged.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    if deal.by_id is not None:
        pairs = pairs.withColumn("group_a", deal.by_id(F.col("a"))).withColumn("group_b", deal.by_id(F.col("b")))
    else:
        for c in ("a", "b"):
            pairs = pairs.join(deal.rows.select(F.col("id").alias(c), F.col("group").alias(f"group_{c}")), c)
    tiles = insights.sparkSession.createDataFrame([(x, y, t) for t, (x, y) in enumerate(deal.tiles)], "x int, y int, tile int")
    meet = (F.least("group_a", "group_b") == F.col("x")) & (F.greatest("group_a", "group_b") == F.col("y"))
    pairs = pairs.where("a < b").join(F.broadcast(tiles), meet).select("tile", "a", "b")
    return _tiled(deal, threshold, 1.0, _not_bridged, "a long, b long, strategy_a string, strategy_b string, similarity double, score double", _packed(pairs))


def spread_picks(candidates: list[dict], k: int, key: str = "pair") -> list[dict]:
    """The first k of a ranked list, where after two picks in a row with one
    key further ones with it wait until the others are used up."""
    picked, waiting = [], []
    for item in candidates:
        if len(picked) == k:
            return picked
        if len(picked) >= 2 and picked[-1][key] == picked[-2][key] == item[key]:
            waiting.append(item)
        else:
            picked.append(item)
    return picked + waiting[: k - len(picked)]


def shared_entities(mentions: DataFrame, sources: DataFrame, a: Column, b: Column, pairs: DataFrame, parts: int | None = None) -> DataFrame:
    """The entities that the first three chunks of two insights both mention."""
    first = sources.withColumn("r", F.row_number().over(Window.partitionBy("insight").orderBy("chunk"))).where("r <= 3")
    named = dealt(first, parts, "chunk").join(mentions.select("chunk", "entity").distinct(), "chunk")
    names = dealt(named, parts, "insight").groupBy("insight").agg(F.collect_set("entity").alias("names"))
    x = names.select(F.col("insight").alias("x"), F.col("names").alias("names_x"))
    y = names.select(F.col("insight").alias("y"), F.col("names").alias("names_y"))
    rows = pairs.join(x, a == F.col("x")).join(y, b == F.col("y"))
    return rows.select("a", "b", F.array_sort(F.array_intersect("names_x", "names_y")).alias("shared"))
