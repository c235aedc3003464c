"""A training-data pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import line_dedup, near_dedup, packing, secrets, toxicity
from gleaner.llm._common import pinned, scope, table, tokenizer_path
from gleaner.sources.staging import drop

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(rows: DataFrame, changed: bool) -> DataFrame:
    """The columns of documents from a struct ``row``, and from text where a
    stage has changed it; a null text that lost nothing stays null."""
    if not changed:
        return rows.select("row.*").select(*COLUMNS)
    same = F.col("text") == F.coalesce("row.text", F.lit(""))
    text = F.when(same, F.col("row.text")).otherwise(F.col("text")).alias("text")
    n_chars = F.when(same, F.col("row.n_chars")).otherwise(F.length("text").cast("long")).alias("n_chars")
    return rows.select("row.doc_id", text, "row.lang", "row.source", n_chars)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier calls toxic go.  It learns from the labels
    of the table documents' rows that are still there and aren't held out."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return docs.select(*COLUMNS).where(toxicity.scorer(docs, model)(F.col("text")) < 0.5)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more that 5 documents or more hold stay in
    one of them."""
    return _documents(line_dedup.dedup_lines(docs, carry=COLUMNS), True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more of their shingles of
    five words, the one with the smallest id stays."""
    kept = near_dedup.classes(docs, words=5, percent=80).where("not kept").select("doc_id", "h").distinct()
    rows = docs.select(*COLUMNS).withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    return rows.join(kept, ["doc_id", "h"], "left_anti").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that look like secrets are replaced by a mark."""
    found = secrets.scan(docs, carry=COLUMNS)
    return _documents(found.withColumn("text", secrets.redacted(F.col("text"), F.col("spans"))), True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        if name == STAGES[-1][0]:
            return stage(spark, docs, sf_dir)
        # A stage's own tables go when its result is written, and so does the
        # result of the stage before it.
        before = docs
        with scope(spark) as kept:
            docs = pinned(stage(spark, docs, sf_dir))
            kept.append(docs)
        drop(before)


#: The classifier, the signatures and the tokenizer have no SQL form.
ORACLE_SQL = None
