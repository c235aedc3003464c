"""The graph tables as views of the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import fingerprint, forget_at_end, shared_dir
from ..sources.text_index import TextIndex
from ..sources.vector_index import VectorIndex


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, corpus (lang), path (lang/source/doc_id.txt), text."""
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("corpus"), path.alias("path"), "text")


def _built(spark: SparkSession, index, rows: DataFrame):
    if index.of() is None:
        forget_at_end(spark, index.path)
        try:
            index.build(rows)
        except RuntimeError:  # another query built it meanwhile
            if index.of() is None:
                raise
    return index


def text_index(spark: SparkSession, sf_dir: str, name: str, texts: DataFrame) -> TextIndex:
    """The index of texts of a table, kept in the shared folder for as long as
    the table's files stay as they are and the driver lives."""
    index = TextIndex(spark, f"{shared_dir(spark)}/text-{name}-{fingerprint(spark, f'{sf_dir}/{name}.parquet')}")
    return _built(spark, index, texts)


def vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The index of all vectors, kept like text_index."""
    index = VectorIndex(spark, f"{shared_dir(spark)}/vectors-{fingerprint(spark, f'{sf_dir}/embeddings.parquet')}")
    return _built(spark, index, vectors(spark, sf_dir).select("id", "embedding", "doc_path"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, embedding, doc_path (dNN/f.md from the label), text (of 0 to 449 letters)."""
    path = F.concat(F.lit("d"), (F.col("label") % 3).cast("string"), F.lit("/f"), F.col("label").cast("string"), F.lit(".md"))
    text = F.repeat(F.lit("x"), (F.col("vec_id") % 450).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", path.alias("doc_path"), text.alias("text"))


#: Rows of lineitem in a task that goes by its keys.
TASK_ROWS = 400_000


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for rows that come from lineitem: a number that grows with it, so
    that a task's memory doesn't (the count is in the files' footers)."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, "lineitem").count() // TASK_ROWS))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity (part), chunk (order), doc (customer), path."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("entity"))
    # By chunk, which the join goes by too: rows are moved once, and first.
    lines = lines.repartition(parts(spark, sf_dir), "chunk").distinct()
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk"), F.col("o_custkey").alias("doc"))
    path = F.concat(F.lit("c"), (F.col("doc") % 10).cast("string"), F.lit("/"), F.col("doc").cast("string"))
    return lines.join(orders, "chunk").withColumn("path", path)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source (supplier, negative), target (part), type (return flag), confidence."""
    lines = table(spark, sf_dir, "lineitem").select((-F.col("l_suppkey")).alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("type"), "l_discount")
    lines = lines.repartition(parts(spark, sf_dir), "target")
    return lines.groupBy("source", "target", "type").agg(F.max("l_discount").alias("confidence"))


def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, arm, at, score, weight."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("arm"), F.col("ts").alias("at"), (F.col("value") / 100).alias("score"), F.lit(1.0).alias("weight"))


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, strategy, score, embedding: vectors as findings."""
    strategy = F.element_at(F.array(*map(F.lit, ("bridge", "outlier", "hub", "gap"))), (F.col("label") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), strategy.alias("strategy"), F.round((F.col("vec_id") % 17) / 17, 6).alias("score"), "embedding")


def tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A forest of conversations (a turn hangs on the turn before) and a score for each node."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", F.length("text").alias("n"))
    have = turns.select(F.col("id").alias("parent"), F.col("conv_id"), (F.col("turn") + 1).alias("turn"))
    nodes = turns.join(have, ["conv_id", "turn"], "left").select("id", "parent")
    return nodes, turns.select("id", F.round(F.coalesce("n", F.lit(0)) % 101 / 100, 6).alias("score"))


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractions of chunks (orders) of documents (customers): parts as
    entities with an alias that several parts share, claims between neighbours.

    Numbers are dealt, by document; names are made from them in each chunk."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "p_size", "l_returnflag").alias("x")
    rows = lines.select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("chunk_ord"), x).repartition("document")
    got = rows.groupBy("document", "chunk_ord").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    alias = lambda x: F.concat(F.lit("alias"), (x["l_partkey"] % 7).cast("string"))
    entity = lambda x: F.struct(F.concat(F.lit(" part "), x["l_partkey"].cast("string")).alias("name"), F.when(x["p_size"] % 2 == 0, "Thing").otherwise("odd-kind").alias("type"), F.repeat(F.lit("d"), (x["l_quantity"] % 9).cast("int")).alias("description"), F.array(alias(x)).alias("aliases"))
    other = lambda i: F.concat(F.lit("PART "), F.get("xs", i + 1)["l_partkey"].cast("string"))
    claim = lambda x, i: F.struct(alias(x).alias("source"), F.coalesce(other(i), F.lit("nobody")).alias("target"), F.lit("goes with").alias("type"), F.concat(F.lit("quote "), x["l_returnflag"]).alias("evidence"), (x["l_quantity"] / 40).alias("confidence"))
    return got.select("document", "chunk_ord", F.col("chunk_ord").cast("string").alias("chunk_id"), F.transform("xs", entity).alias("entities"), F.transform("xs", claim).alias("relations"))
