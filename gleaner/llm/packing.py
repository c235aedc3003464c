"""Best-fit packing: hierarchical residual packing.

Each partition tokenizes its documents and packs the pieces best-fit, the
longest first.  Bins that are nearly full are done.  The others go up a tree
of partitions: in each round the bins of ``fan_in`` neighbours meet and are
packed best-fit again, as items, until one partition is left.

A node hands on at most ``carry`` bins, those with the most room: of two bins
that are at most half full best-fit makes one, so a node has one such bin at
most, and the others only serve to take in small bins of other nodes.  What it
doesn't hand on is a finished sequence; no row is lost.  Without ``carry`` all
underfull bins go up, which is the method to the letter; the last node then has
to hold as many of them as there are.

Edge cases.  Null text counts as empty: one piece that holds the end id only.
Texts longer than the capacity are cut into pieces of the capacity, the last
may be shorter.  Rows that repeat an id are packed one by one.  Null ids are
packed like others.  Of bins that fit equally well any may be taken; the
number of sequences doesn't depend on names.  Other columns are not read, so
none can clash.  A table without rows gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import input_columns, package_on_workers, pinned, read_file, released, small_batches
from .bpe import Chunks, blocks, checked, kept

MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
BIN = pa.schema([("bin", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("done", pa.bool_()), ("members", pa.list_(MEMBER))])
BIN_DDL = "bin long, node long, size long, done boolean, members array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long, offset: long>>"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset there, and the bins' sizes.

    Open bins are kept by the room they have; a bitmap over the rooms gives
    the least room that an item fits in.
    """
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, filled = 0, []
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        if fits := rooms >> size:
            room = (fits & -fits).bit_length() - 1 + size
            k = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, k = capacity, len(filled)
            filled.append(0)
        bin_of[item], offset[item] = k, filled[k]
        filled[k] += size
        if left := room - size:
            by_room[left].append(k)
            rooms |= 1 << left
    return bin_of, offset, np.asarray(filled, np.int64)


def _library(file: str):
    """Encodes chunks with the tokenizers library."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    checked(file)
    library = Tokenizer.from_str(file)
    library.no_truncation()
    library.no_padding()

    def one_by_one(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [library.encode(x, add_special_tokens=False).ids for x in chunks]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for x in lists for i in x), np.int64, int(counts.sum())), counts

    # A word that stands between chunks, if it is one id: a whole list is then
    # encoded in one call.  Lists with a chunk that holds it are encoded singly.
    between = library.encode("\0", add_special_tokens=False).ids

    def together(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = " \0 ".join(chunks)
        if len(between) != 1 or text.count("\0") != len(chunks) - 1:
            return one_by_one(chunks)
        ids = np.array(library.encode(text, add_special_tokens=False).ids, np.int64)
        ends = np.append(np.flatnonzero(ids == between[0]), len(ids))
        if len(ends) != len(chunks):
            return one_by_one(chunks)
        return ids[ids != between[0]], np.diff(np.append(-1, ends)) - 1

    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [together(chunks[k : k + 500]) for k in range(0, len(chunks), 500)]
        ids, counts = zip(*parts) if parts else ([np.empty(0, np.int64)], [np.empty(0, np.int64)])
        return np.concatenate(ids), np.concatenate(counts)

    return encode


def pieces_of(ids: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """piece, start, length, crc32 of the little-endian ids."""
    return [(k, at, len(x), zlib.crc32(x.astype("<u4").tobytes())) for k, at in enumerate(range(0, len(ids), capacity)) for x in [ids[at : at + capacity]]]


def _bins(rows: list[np.ndarray], bin_of: np.ndarray, ids: np.ndarray, node: int, filled: np.ndarray, done: np.ndarray) -> pa.RecordBatch:
    """Arrow rows of bins; rows: the columns of all members, bin_of: theirs."""
    order = np.lexsort((rows[-1], bin_of))
    ends = np.append(0, np.cumsum(np.bincount(bin_of, minlength=len(filled))))
    fields = [pa.array(column[order], kind.type) for column, kind in zip(rows, MEMBER)]
    members = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(MEMBER)))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.full(len(filled), node), pa.int64()), pa.array(filled), pa.array(done), members], schema=BIN)


def _finished(filled: np.ndarray, capacity: int, slack: int, carry: int | None, last: bool = False) -> np.ndarray:
    """Nearly full bins, and those beyond the ``carry`` with the most room."""
    done = (filled >= capacity - slack) | last
    return done if carry is None else done | (np.argsort(np.argsort(filled, kind="stable"), kind="stable") >= carry)


def pack(
    docs: DataFrame,
    path: str,
    *,
    capacity: int = 4096,
    end_id: int = 1,
    slack: int = 8,
    fan_in: int = 16,
    carry: int | None = 1024,
    reuse: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset.  path: a tokenizers file; ids: an integer column.

    carry: None hands on every underfull bin.  reuse: so many bytes of chunks
    and ids stay in a worker for its later tasks, which is faster; 0: every task
    starts afresh.
    """
    spark = docs.sparkSession
    package_on_workers(spark)
    file = spark.sparkContext.broadcast(read_file(path))
    rows = docs.select(*input_columns(docs, id=id_col, text=text_col)).select(F.col("id").cast("long").alias("id"), "text")

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId()
        own = kept("library", file.value, _library, reuse) if reuse else Chunks(_library(file.value))
        doc_ids: list[int | None] = []
        parts: list[tuple[int, int, int, int]] = []
        for rows_of, texts in blocks(batches):
            ids, ends = own.ids(texts)
            for doc_id, begin, end in zip(rows_of.column("id").to_pylist(), np.append(0, ends).tolist(), ends.tolist()):
                cut = pieces_of(np.append(ids[begin:end], np.uint32(end_id)), capacity)
                doc_ids += [doc_id] * len(cut)
                parts += cut
        if not parts:
            return
        cols = np.asarray(parts, np.int64).T
        bin_of, offset, filled = best_fit(cols[2], capacity)
        ids = np.int64(node << 31) + np.arange(len(filled))
        yield _bins([np.asarray(doc_ids, object), *cols, offset], bin_of, ids, node, filled, _finished(filled, capacity, slack, carry))

    def merge(last: bool):
        def run(table: pa.Table) -> pa.Table:
            table = table.combine_chunks().sort_by([("size", "descending"), ("bin", "ascending")])
            sizes = table["size"].to_numpy()
            bin_of, offset, filled = best_fit(sizes, capacity)
            host = np.unique(bin_of, return_index=True)[1]  # a bin keeps the id of its first part
            lists = table["members"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            counts = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            cols = [pa.compute.struct_field(flat, k.name).to_numpy(zero_copy_only=False) for k in MEMBER]
            cols[0] = np.asarray(pa.compute.struct_field(flat, "doc_id").to_pylist(), object)
            cols[-1] = cols[-1] + np.repeat(offset, counts)
            node = int(table["node"][0].as_py()) if len(table) else 0
            done = _finished(filled, capacity, slack, carry, last)
            return pa.Table.from_batches([_bins(cols, np.repeat(bin_of, counts), table["bin"].to_numpy()[host], node, filled, done)])

        return run

    with small_batches(spark):
        level = pinned(rows.mapInArrow(released(leaf), BIN_DDL))
    levels = [level]
    nodes = (level.agg(F.max("node")).first()[0] or 0) + 1
    while len(levels) == 1 or nodes > 1:
        nodes = -(-nodes // fan_in)
        open_bins = level.where("not done").withColumn("node", F.floor(F.col("node") / fan_in))
        level = pinned(open_bins.groupBy("node").applyInArrow(merge(nodes == 1), BIN_DDL))
        levels.append(level)
    made = levels[0].where("done")
    for x in levels[1:]:
        made = made.unionByName(x.where("done"))
    m = F.col("m")
    return made.select(F.col("bin").alias("sequence_id"), F.explode("members").alias("m")).select(
        m["doc_id"].alias(id_col), m["piece"].alias("piece"), m["start"].alias("start"), m["length"].alias("length"), m["ids_crc32"].alias("ids_crc32"), "sequence_id", m["offset"].alias("offset")
    )
