"""Readers: a folder of files into sections.

Files are read as binary rows, decoded as UTF-8 with replacement characters,
and split by the rule of their suffix: Markdown by headings, JSON by keys or
items, everything else by blank lines.  Spark's reader leaves out files of no
bytes; they would have no chunk.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import content_id, stripped

# The suffixes that are read, and how.
SUFFIXES = {".md": "markdown", ".markdown": "markdown", ".json": "json", ".txt": "text", ".csv": "text", ".yaml": "text", ".yml": "text", ".sh": "text", ".ts": "text", ".js": "text", ".py": "text", ".tsx": "text", ".jsx": "text"}
_HEADING = r"(?m)^(?=#{1,6}\s+.+$)"


def _chosen(files: DataFrame, root: str) -> DataFrame:
    """files (path) with name, suffix and place (the path below root) of those
    with a known suffix; hidden names and .git are left out."""
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^.*?" + "\\Q" + root.rstrip("/").split("://")[-1] + "/\\E", "")
    rows = files.withColumn("place", rel).withColumn("name", F.element_at(F.split("place", "/"), -1))
    rows = rows.withColumn("suffix", F.lower(F.regexp_extract("name", r"(?<=.)(\.[^.]+)$", 1)))
    return rows.where(F.col("suffix").isin(*SUFFIXES) & ~F.col("name").startswith(".") & ~F.array_contains(F.split("place", "/"), ".git"))


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path (whole), length, modified of the files that scan reads; their
    contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return _chosen(files.select("path", "length", F.unix_micros("modificationTime").alias("modified")), root).select("path", "length", "modified")


def scan(spark: SparkSession, root: str, done: DataFrame | None = None, paths: list[str] | None = None) -> DataFrame:
    """path (below root), stem, suffix, content, content_hash of the files with
    a known suffix; hidden names and .git are left out, and the files of done
    (path, content_hash).  paths: only these files are opened."""
    names = [root] if paths is None else [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(names)
    rows = _chosen(files.select("path", "content"), root)
    rows = rows.select(F.col("place").alias("path"), F.regexp_replace("name", r"(?<=.)\.[^.]+$", "").alias("stem"), "suffix", "content", F.left(F.sha2("content", 256), F.lit(16)).alias("content_hash"))
    return rows if done is None else rows.join(done.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def decoded(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def markdown(stem: Column, text: Column) -> Column:
    """Sections at headings; what comes before the first has the file's stem."""
    parts = F.transform(F.split(text, _HEADING), lambda p: F.struct(p.alias("p"), F.regexp_extract(p, r"^#{1,6}\s+.+", 0).alias("h")))
    parts = F.transform(parts, lambda x: F.struct(F.when(x["h"] == "", stem).otherwise(stripped(F.regexp_replace(stripped(x["h"]), "^#+", ""))).alias("heading"), stripped(F.substring(x["p"], F.length(x["h"]) + 1, F.length(x["p"]))).alias("text")))
    kept = F.filter(parts, lambda x: x["text"] != "")
    return F.when(F.size(kept) == 0, F.array(F.struct(stem.alias("heading"), stripped(text).alias("text")))).otherwise(kept)


def paragraphs(stem: Column, text: Column) -> Column:
    kept = F.filter(F.transform(F.split(text, "\n\n"), stripped), lambda p: p != "")
    kept = F.when(F.size(kept) == 0, F.array(F.lit(""))).otherwise(kept)
    return F.transform(kept, lambda p: F.struct(stem.alias("heading"), p.alias("text")))


def _json_parts(stem: str, text: str) -> list[dict]:
    try:
        data = json.loads(text)
    except ValueError:
        return [{"heading": stem, "text": text}]
    shown = lambda v: v if isinstance(v, str) else json.dumps(v, indent=2, ensure_ascii=False)
    if isinstance(data, dict):
        return [{"heading": k, "text": shown(v)} for k, v in data.items()]
    if not isinstance(data, list):
        return [{"heading": stem, "text": str(data)}]
    heads = [next((str(item[c]) for c in ("name", "id", "title") if c in item), "") if isinstance(item, dict) else "" for item in data]
    return [{"heading": head or f"item_{k}", "text": shown(item)} for k, (head, item) in enumerate(zip(heads, data))]


def json_sections(stem: Column, text: Column) -> Column:
    """Sections of a JSON file; Python keeps the order of keys and numbers as
    they are written."""

    @F.pandas_udf("array<struct<heading: string, text: string>>")
    def of(stems: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([_json_parts(s, t) for s, t in zip(stems, texts)])

    return of(stem, text)


def sections(files: DataFrame, corpus: str) -> DataFrame:
    """document_id, path, section, heading, text of scanned files."""
    rows = files.withColumn("text", decoded(F.col("content"))).withColumn("document_id", content_id(F.lit(corpus), F.col("path")))
    kinds = F.col("suffix")
    of = lambda kind: kinds.isin(*[s for s, k in SUFFIXES.items() if k == kind])
    stem, text = F.col("stem"), F.col("text")
    parts = [rows.where(of("markdown")).withColumn("s", markdown(stem, text)), rows.where(of("json")).withColumn("s", json_sections(stem, text)), rows.where(of("text")).withColumn("s", paragraphs(stem, text))]
    every = parts[0].select("document_id", "path", "s").union(parts[1].select("document_id", "path", "s")).union(parts[2].select("document_id", "path", "s"))
    return every.select("document_id", "path", F.posexplode("s").alias("section", "s")).select("document_id", "path", "section", "s.heading", "s.text")
