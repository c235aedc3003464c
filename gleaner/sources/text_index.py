"""A persisted inverted index for BM25.

Postings (term, id, tf, and the length of the text) lie in buckets by term and
are sorted by term within them, so a query reads the buckets of its own words
and, by the files' statistics, the row groups that hold these.  An update adds a
generation: postings of the texts that are new, ids whose older postings don't
count any more, and by how much the document frequency of each term changes.
Many generations are merged into one, from postings, without reading a text.

A term that most texts hold is split by id, so no task writes all its postings.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import tokens
from .staging import package_on_workers, pinned, scope
from .store import BUCKET, Folder

K1, B = 1.2, 0.75


#: Words that are counted at once, or those of one text.
AT_ONCE = 200_000


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in a row with AT_ONCE words at most, or one row."""
    total = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(total):
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + AT_ONCE, "right")))
        yield batch.slice(start, end - start)
        start = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, id, size, tf of each different word of rows (id, words, size)."""
    for batch in (piece for whole in batches for piece in _pieces(whole)):
        words = batch.column("words")
        # Words by number, so that rows and words are counted as one number.
        coded = words.flatten().dictionary_encode()
        row = pc.list_parent_indices(words).to_numpy()
        each, tf = np.unique(row * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), return_counts=True)
        row, word = np.divmod(each, max(1, len(coded.dictionary)))
        row = pa.array(row)
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(word)), batch.column("id").take(row), batch.column("size").take(row), pa.array(tf.astype(np.int64))], names=["term", "id", "size", "tf"])


class TextIndex(Folder):
    """texts are rows (id, text) whose ids are unique."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, most: int = 8, split_rows: int = 100_000, keep: int = 2, grace: float = 3600.0):
        super().__init__(spark, path, keep, grace)
        self._buckets, self._most, self._split_rows = buckets, most, split_rows

    # Writing

    def _words(self, texts: DataFrame) -> DataFrame:
        words = texts.select("id", tokens(F.coalesce("text", F.lit(""))).alias("words"))
        return words.select("id", "words", F.size("words").cast("long").alias("size"))

    def _written(self, rows: DataFrame, kind: str) -> str:
        folder = self.new(kind)
        rows.write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        return folder

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self._buckets)).cast("int")

    def _split(self, n: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // self._split_rows))))

    def _generation(self, added: DataFrame, removed: DataFrame | None, version: int) -> tuple[dict, int, int]:
        """The folders of a generation, and how the number of texts and of their
        words changes."""
        package_on_workers(self.spark)
        id_kind = added.schema["id"].dataType.simpleString()
        with scope(self.spark):
            n = added.count()
            each = self._words(added).mapInArrow(_counted, f"term string, id {id_kind}, size long, tf long")
            dealt = each.repartition(self._bucket(), self._split(n)).withColumn("since", F.lit(version).cast("long")).withColumn(BUCKET, self._bucket())
            postings = self._written(dealt.sortWithinPartitions(BUCKET, "term", "id"), "postings")
            made = {"postings": postings, "dead": None}
            written = self._read("postings", postings, id_kind)
            size = written.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
            change = written.groupBy(BUCKET, "term").agg(F.count(F.lit(1)).alias("df"))
            if removed is not None:
                gone = pinned(self._words(removed).select("id", "size", F.array_distinct("words").alias("words")))
                n_gone, size_gone = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
                n, size = n - n_gone, size - size_gone
                if n_gone:
                    made["dead"] = self.new("dead")
                    gone.select("id", F.lit(version).cast("long").alias("dead_since")).write.parquet(f"{self.path}/{made['dead']}")
                    less = gone.select(F.explode("words").alias("term")).groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
                    change = change.unionByName(less.withColumn(BUCKET, self._bucket()))
                    change = change.groupBy(BUCKET, "term").agg(F.sum("df").alias("df")).where("df <> 0")
            made["terms"] = self._written(change.repartition(BUCKET).sortWithinPartitions(BUCKET, "term"), "terms")
        return made, n, size

    def _named(self, generations: list[dict], **content) -> dict:
        return {**content, "buckets": self._buckets, "generations": generations, "folders": [f for g in generations for f in (g["postings"], g["terms"], g["dead"]) if f]}

    def build(self, texts: DataFrame, of: int = 0) -> None:
        """Indexes all texts anew.  of: a number that the index is known by, for
        instance the version of the table that the texts are from."""
        v, kind = self.version() + 1, texts.schema["id"].dataType.simpleString()
        made, n, size = self._generation(texts, None, v)
        self.commit(v, self._named([made], n=n, size=size, of=of, id=kind), [f for f in made.values() if f])

    def update(self, added: DataFrame, removed: DataFrame, of: int = 0) -> None:
        """Takes away the texts of removed, as they were indexed, and adds those
        of added; a text that changes is in both."""
        last, found = self.latest()
        made, n, size = self._generation(added, removed, last + 1)
        content = {"n": found["n"] + n, "size": found["size"] + size, "of": of, "id": found["id"]}
        self.commit(last + 1, self._named([*found["generations"], made], **content), [f for f in made.values() if f])
        if len(found["generations"]) >= self._most:
            self.compact()

    def renamed(self, of: int) -> None:
        """The same index, known by another number."""
        last, found = self.latest()
        self.commit(last + 1, found | {"of": of}, [])

    def compact(self) -> None:
        """One generation in place of all."""
        last, found = self.latest()
        live = self._live(found, self._parts(found, "postings")).repartition(F.col(BUCKET), self._split(found["n"]))
        made = {"dead": None}
        made["postings"] = self._written(live.withColumn("since", F.lit(last + 1).cast("long")).sortWithinPartitions(BUCKET, "term", "id"), "postings")
        terms = self._parts(found, "terms").groupBy(BUCKET, "term").agg(F.sum("df").alias("df")).where("df > 0")
        made["terms"] = self._written(terms.repartition(BUCKET).sortWithinPartitions(BUCKET, "term"), "terms")
        self.commit(last + 1, found | self._named([made]), [made["postings"], made["terms"]])

    # Reading

    def _read(self, kind: str, folder: str, id_kind: str) -> DataFrame:
        columns = {"postings": f"term string, id {id_kind}, size long, tf long, since long", "terms": "term string, df long"}[kind]
        return self.spark.read.schema(f"{columns}, {BUCKET} int").parquet(f"{self.path}/{folder}")

    def _parts(self, found: dict, kind: str) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, [self._read(kind, g[kind], found["id"]) for g in found["generations"]])

    def _live(self, found: dict, postings: DataFrame) -> DataFrame:
        """Without the postings of texts that were changed or removed later."""
        dead = [g["dead"] for g in found["generations"] if g["dead"]]
        if not dead:
            return postings
        last = functools.reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{f}") for f in dead]).groupBy("id").agg(F.max("dead_since").alias("dead_since"))
        return postings.join(last.withColumnRenamed("id", "dead_id"), (F.col("id") == F.col("dead_id")) & (F.col("since") < F.col("dead_since")), "left_anti")

    def of(self) -> int | None:
        """The number that the index is known by; None if there is no index."""
        found = self.latest()[1]
        return found and found["of"]

    def search(self, query: str, k: int | None = 10) -> DataFrame:
        """id, score as search.bm25 gives them."""
        found = self.latest()[1]
        one = self.spark.range(1).select(F.array_distinct(tokens(F.lit(query))).alias("words"))
        asked = one.select(F.transform("words", lambda w: F.struct(w.alias("w"), F.pmod(F.xxhash64(w), F.lit(found["buckets"])).cast("int").alias("b")))).first()[0]
        if not asked or not found["n"]:
            return self.spark.createDataFrame([], f"id {found['id']}, score double")
        own = lambda df: df.where(F.col(BUCKET).isin(sorted({x.b for x in asked})) & F.col("term").isin([x.w for x in asked]))
        # As many rows as the query has words.
        df = {r.term: r.df for r in own(self._parts(found, "terms")).groupBy("term").agg(F.sum("df").alias("df")).collect()}
        n, mean = found["n"], found["size"] / found["n"]
        frequency = F.coalesce(*[F.when(F.col("term") == w, F.lit(d)) for w, d in df.items()], F.lit(0))
        idf = F.ln(1 + (F.lit(n) - frequency + 0.5) / (frequency + 0.5))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(mean)))
        scored = self._live(found, own(self._parts(found, "postings"))).groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))
        return scored if k is None else scored.orderBy(F.desc("score"), "id").limit(k)
