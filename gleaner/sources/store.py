"""Keyed tables: merges that give the same result when they are repeated.

A table is a folder of files; a writer adds its own and then names them in a
file CURRENT.<version>, so a reader never sees half a merge.
"""

from __future__ import annotations

import functools
import json
import math
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import type_name


def last_write(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """new replaces rows of old with the same key, whole."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def insert_only(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of new whose key old doesn't have; old rows never change."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"))


def require(rows: DataFrame, column: str, parents: DataFrame, key: str = "id") -> DataFrame:
    """rows, or an error if one's parent is missing."""
    lost = rows.join(parents.select(F.col(key).alias(column)), column, "left_anti").select(column).limit(5).collect()
    if lost:
        raise ValueError(f"unknown {column}: {[r[0] for r in lost]}")
    return rows


def known(rows: DataFrame, column: str, parents: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose parent exists; the others are left out silently."""
    return rows.join(parents.select(F.col(key).alias(column)), column, "left_semi")


def _sides(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))


def _in_order(column: str):
    """All values of a list column in order, each once; a null list holds none."""
    empty = F.array().cast("array<string>")
    lists = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.coalesce(F.col(column), empty).alias("v")))), lambda x: x["v"])
    return F.array_distinct(F.flatten(lists))


def merge_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """On a match the aliases are united in order and the longer description
    wins, the old one on a tie; nothing else changes."""
    rest = [c for c in old.columns if c not in ("id", "aliases", "description")]
    aggs = [F.min_by(F.struct(c), "_n").getField(c).alias(c) for c in rest]
    longest = F.max_by("description", F.struct(F.length(F.coalesce("description", F.lit(""))), -F.col("_n")))
    return _sides(old, new).groupBy("id").agg(*aggs, longest.alias("description"), _in_order("aliases").alias("aliases")).select(*old.columns)


def merge_relations(old: DataFrame, new: DataFrame, entities: DataFrame) -> DataFrame:
    """On a match the chunks are united in order and the confidence is the
    larger; the evidence stays.  Relations without both ends are left out."""
    new = new.withColumn("type", type_name(F.col("type")))
    new = known(known(new, "source_id", entities), "target_id", entities).select(*old.columns)
    rest = [c for c in old.columns if c not in ("id", "source_chunks", "confidence")]
    aggs = [F.min_by(F.struct(c), "_n").getField(c).alias(c) for c in rest]
    return _sides(old, new).groupBy("id").agg(*aggs, F.max("confidence").alias("confidence"), _in_order("source_chunks").alias("source_chunks")).select(*old.columns)


def update(old: DataFrame, changes: DataFrame, key: str = "id", only_null: bool = False, touched: bool = False) -> DataFrame:
    """Sets the columns of changes where the key is known; only_null keeps
    values that are there.  touched: of old, only the rows that have changes."""
    columns = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    rows = old.join(renamed, key, "inner" if touched else "left")
    value = lambda c: F.coalesce(c, f"_{c}") if only_null else F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c))
    return rows.select(*[value(c).alias(c) if c in columns else F.col(c) for c in old.columns])


class Folder:
    """A folder of files that only come and go: each version is a file
    CURRENT.<version> that says, as JSON, what belongs to it.

    Of two writers that began from one version the later one fails.  What the
    last ``keep`` versions don't name goes when it is older than ``grace``
    seconds, so whoever has just read a version can go on with it.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2, grace: float = 3600.0):
        self.spark, self.path = spark, path.rstrip("/")
        self._keep, self._grace = keep, grace
        self._jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("x").getFileSystem(conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _listed(self) -> list:
        return list(self._fs.listStatus(self._at("."))) if self._fs.exists(self._at(".")) else []

    def version(self) -> int:
        """0 before the first write."""
        names = [x.getPath().getName() for x in self._listed()]
        return max([int(n[8:]) for n in names if n.startswith("CURRENT.")], default=0)

    def content(self, version: int) -> dict | None:
        """What a version says; None if it isn't there or if its writer died at
        the last step."""
        if not self._fs.exists(self._at(f"CURRENT.{version}")):
            return None
        stream = self._fs.open(self._at(f"CURRENT.{version}"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if text.startswith("v"):  # once, a version was the name of one folder
            raise ValueError(f"{self.path} is of an older layout")
        try:
            return json.loads(text)
        except ValueError:
            return None

    def latest(self) -> tuple[int, dict | None]:
        """The number of the last version, and the last that can be read."""
        v = last = self.version()
        while v > 0:
            if (found := self.content(v)) is not None:
                return last, found
            v -= 1
        return last, None

    def commit(self, version: int, content: dict, made: list[str]) -> None:
        """Names what was made as a version; if there is one already, what was
        made goes and it is an error."""
        try:
            named = self._fs.create(self._at(f"CURRENT.{version}"), False)
        except Py4JJavaError as e:
            for folder in made:
                self._fs.delete(self._at(folder), True)
            raise RuntimeError(f"another writer has made version {version} of {self.path}") from e
        named.write(bytearray(json.dumps(content).encode()))
        named.close()
        self.clean(version)

    def clean(self, version: int) -> None:
        """Removes what no version that is kept names."""
        kept, stay, v = 0, set(), version
        while v > 0 and kept < self._keep:
            if (found := self.content(v)) is not None:
                stay |= {f"CURRENT.{v}", *found["folders"]}
                kept += 1
            v -= 1
        old = time.time() - self._grace
        for x in self._listed():
            name = x.getPath().getName()
            newer = name.startswith("CURRENT.") and int(name[8:]) > v
            if name not in stay and not newer and x.getModificationTime() / 1000 <= old:
                self._fs.delete(x.getPath(), True)

    def bytes(self, folders: list[str]) -> int:
        return sum(self._fs.getContentSummary(self._at(f)).getLength() for f in folders)

    def new(self, kind: str) -> str:
        return f"{kind}-{uuid.uuid4().hex}"

    def drop(self, folder: str) -> None:
        self._fs.delete(self._at(folder), True)


#: Column of a table's files: the bucket of a row's key, a folder each.
BUCKET = "at_bucket"
#: Columns of change files: whether the row is gone, and since which version.
GONE, SINCE = "is_gone", "since_version"


class Table(Folder):
    """Rows by key, in a base and in files of changes, merged when they are read.

    A change writes only the rows that it names.  Base and changes lie in
    buckets by key, so a look-up by key reads one of them.  When the changes are
    more than ``share`` of the base in bytes, the next version is a new base;
    when there are ``most`` folders of changes of about one size they become
    one.  So a byte is written a bounded number of times, and folders are few.

    key: the columns that tell rows apart; none of them null.
    """

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...] = ("id",), keep: int = 2, grace: float = 3600.0, share: float = 0.25, most: int = 8, bucket_bytes: int = 128 << 20):
        super().__init__(spark, path, keep, grace)
        self.key, self._share, self._most, self._bucket_bytes = key, share, most, bucket_bytes
        self._seen: int | None = None

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(buckets)).cast("int").alias(BUCKET)

    def read(self, keys: list[tuple] | None = None) -> DataFrame | None:
        """All rows; of the buckets that hold the keys only, if there are some."""
        self._seen, found = self.latest()
        return self._rows(found, keys) if found else None

    def _rows(self, found: dict, keys: list[tuple] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(found["schema"])
        own = None
        if keys is not None:
            one = self.spark.createDataFrame(keys, T.StructType([schema[k] for k in self.key]))
            own = sorted(r[0] for r in one.select(self._bucket(found["buckets"])).distinct().collect())
        at = lambda df: df if own is None else df.where(F.col(BUCKET).isin(own))
        base = at(self._part(found["base"], schema))
        if not found["changes"]:
            return base.select(*schema.names)
        parts = [at(self._part(f, self._wide(found))) for f in found["changes"]]
        changes = functools.reduce(DataFrame.unionByName, parts)
        rest = [c for c in schema.names if c not in self.key]
        last = changes.groupBy(*self.key).agg(F.max_by(F.struct(*rest, GONE), SINCE).alias("last"))
        here = last.where(f"not last.{GONE}").select(*[F.col(c) if c in self.key else F.col(f"last.{c}").alias(c) for c in schema.names])
        return base.select(*schema.names).join(changes.select(*self.key).distinct(), list(self.key), "left_anti").select(*schema.names).unionByName(here)

    def _wide(self, found: dict) -> T.StructType:
        """The columns of change files."""
        return T.StructType([*T.StructType.fromJson(found["schema"]).fields, T.StructField(GONE, T.BooleanType()), T.StructField(SINCE, T.LongType())])

    def _part(self, folder: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(f"{self.path}/{folder}")

    def _written(self, rows: DataFrame, kind: str, buckets: int) -> tuple[str, int]:
        """A new folder of rows, and how many they are."""
        counted, folder = Observation(), self.new(kind)
        rows = rows.withColumn(BUCKET, self._bucket(buckets))
        rows = rows.repartition(BUCKET) if buckets > 1 else rows
        rows.observe(counted, F.count(F.lit(1)).alias("n")).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        return folder, counted.get["n"]

    def write(self, rows: DataFrame) -> int:
        """Replaces all rows; the new version."""
        v, found = self.version() + 1, self.latest()[1]
        size = self.bytes(found["folders"]) if found else 0
        buckets = 1 << max(0, min(12, (size // self._bucket_bytes).bit_length()))
        base, _ = self._written(rows, "base", buckets)
        self.commit(v, {"schema": rows.schema.jsonValue(), "buckets": buckets, "base": base, "changes": [], "folders": [base]}, [base])
        return v

    def change(self, rows: DataFrame | None = None, gone: DataFrame | None = None, note: dict | None = None) -> int:
        """Puts rows in place of those with their keys, and takes away those
        with the keys of gone that aren't in rows; how many rows this writes.

        What the rows were computed from is the version of the last read():
        if another writer has made one since, it is an error.  note: what the
        version says beside its rows, from now on."""
        note = note or {}
        last, found = self.latest()
        v = (last if self._seen is None else self._seen) + 1
        if not found:
            if rows is None:
                return 0
            base, n = self._written(rows, "base", 1)
            self.commit(v, {"schema": rows.schema.jsonValue(), "buckets": 1, "base": base, "changes": [], "folders": [base]} | note, [base])
            self._seen = v
            return n
        schema = T.StructType.fromJson(found["schema"])
        parts = [] if rows is None else [rows.select(*schema.names).withColumn(GONE, F.lit(False))]
        if gone is not None:
            parts.append(gone.select(*[F.col(c) if c in self.key else F.lit(None).cast(schema[c].dataType).alias(c) for c in schema.names], F.lit(True).alias(GONE)))
        rest = [c for c in schema.names if c not in self.key]
        one = functools.reduce(DataFrame.unionByName, parts).groupBy(*self.key).agg(F.min_by(F.struct(*rest, GONE), GONE).alias("one"))
        made = one.select(*[F.col(c) if c in self.key else F.col(f"one.{c}").alias(c) for c in schema.names], f"one.{GONE}", F.lit(v).cast("long").alias(SINCE))
        folder, n = self._written(made, "change", found["buckets"])
        if not n and not note:
            self.drop(folder)
            return 0
        now = found | {"changes": [*found["changes"], folder], "folders": [*found["folders"], folder]} | note
        self.commit(v, now, [folder])
        self._seen = v
        self._tidy(now)
        return n

    def _tidy(self, found: dict) -> None:
        sizes = {f: self.bytes([f]) for f in found["changes"]}
        if sum(sizes.values()) > self._share * self.bytes([found["base"]]):
            self.compact()
            return
        tiers: dict[int, list[str]] = {}
        for f, size in sizes.items():
            tiers.setdefault(int(math.log(size + 1, 8)), []).append(f)
        if full := [t for t in tiers.values() if len(t) >= self._most]:
            self._join(found, full[0])

    def _join(self, found: dict, folders: list[str]) -> None:
        """One folder of changes in place of some; each row stays of its version."""
        schema = self._wide(found)
        rows = functools.reduce(DataFrame.unionByName, [self._part(f, schema) for f in folders])
        rest = [c for c in schema.names if c not in self.key]
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), SINCE).alias("last"))
        made, _ = self._written(last.select(*[F.col(c) if c in self.key else F.col(f"last.{c}").alias(c) for c in schema.names]), "change", found["buckets"])
        changes = [f for f in found["changes"] if f not in folders] + [made]
        self._try(found | {"changes": changes, "folders": [found["base"], *changes]}, made)

    def _try(self, content: dict, made: str) -> None:
        """Commits what has the same rows; if another writer comes first, that
        is left to a later change."""
        v = self.version() + 1
        try:
            if self._seen in (None, v - 1):
                self.commit(v, content, [made])
                self._seen = v
            else:
                self.drop(made)
        except RuntimeError:
            pass

    def compact(self) -> None:
        """A new base in place of base and changes."""
        self._seen, found = self.latest()
        if not found or not found["changes"]:
            return
        size = self.bytes(found["folders"])
        buckets = 1 << max(0, min(12, (size // self._bucket_bytes).bit_length()))
        base, _ = self._written(self._rows(found), "base", buckets)
        self._try(found | {"buckets": buckets, "base": base, "changes": [], "folders": [base]}, base)
