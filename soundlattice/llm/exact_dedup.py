"""Exact duplicates through an extendible-hash index on shared files.

Directory.  Each text has a 64-bit hash, and the leading bits choose its bucket.  The directory starts with as many
bits as let the distinct hashes fill its buckets by half, and wherever a bucket holds more than ``capacity`` hashes it
doubles there: the bucket splits by the next bit, as often as needed.  What is stored is the starting depth and the
prefixes that were split, so it is as small as the hash is even.

Index.  Rows are addressed to their bucket by the directory; copies combine on the way, by bucket, hash and the text's
bytes, so a text with a third of all rows sends one row per map task.  Owner tasks hold ranges of buckets, in key order,
and chain the different texts of one hash; the entries are written to the shared folder.

Lookup.  Each row goes through the directory to its bucket and takes its verdict from the entry of its hash and text there.
Everything is DataFrame code.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from soundlattice.llm.shared import materialize, text_or_empty, whole_row

CAPACITY = 4096


class Directory(NamedTuple):
    """Buckets of ``depth`` leading bits, but those of ``splits`` (depth, prefix) are split by the next bit, down to ``deepest``."""

    depth: int
    splits: DataFrame | None
    deepest: int


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("long")


def make_directory(hashes: DataFrame, capacity: int = CAPACITY) -> Directory:
    """The directory of distinct hashes (hash).  Distinct ones part at 64 bits at the latest, so splitting ends."""
    total = hashes.count()
    depth = bits = max(0, math.ceil(math.log2(2 * total / capacity))) if total else 0
    splits, left = None, hashes
    while True:
        counted = left.groupBy(_prefix(bits).alias("prefix")).agg(F.count("*").alias("held"))
        full = materialize(counted.where(F.col("held") > capacity).select(F.lit(bits).alias("depth"), "prefix"), "hash-splits")
        if bits == 64 or full.isEmpty():
            return Directory(depth, splits, bits)
        splits = full if splits is None else splits.unionByName(full)
        left = left.withColumn("prefix", _prefix(bits)).join(full.select("prefix"), "prefix", "left_semi").drop("prefix")
        bits += 1


def address(rows: DataFrame, directory: Directory) -> DataFrame:
    """``rows`` (with hash) and the bucket of each: its depth, and ``low``, the first hash of its range."""
    rows = rows.withColumn("depth", F.lit(directory.depth))
    for bits in range(directory.depth, directory.deepest):
        full = directory.splits.where(F.col("depth") == bits).select(F.col("prefix").alias("__prefix"), F.lit(True).alias("__full"))
        rows = rows.withColumn("__prefix", F.when(F.col("depth") == bits, _prefix(bits))).join(full, "__prefix", "left")
        rows = rows.withColumn("depth", F.when(F.col("__full"), F.lit(bits + 1)).otherwise(F.col("depth"))).drop("__prefix", "__full")
    return rows.withColumn("low", F.expr("CASE WHEN depth = 0 THEN 0L ELSE shiftleft(shiftrightunsigned(hash, 64 - depth), 64 - depth) END"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> tuple[Directory, DataFrame]:
    """The directory, and an entry for each distinct text: low, depth, hash, chain, text_sha256, keep_id, group_size.

    ``low`` and ``depth`` name the bucket, ``chain`` is the text's place among those of equal hash, from 1.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    directory = make_directory(materialize(rows.select("hash").distinct(), "hash-keys"), capacity)
    combined = address(rows, directory).groupBy("low", "depth", "hash", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = combined.select("low", "depth", "hash", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    entries = materialize(entries, "hash-entries")  # ranges are sampled: texts are read once
    owned = entries.repartitionByRange("low", "hash")
    chain = F.row_number().over(Window.partitionBy("low", "depth", "hash").orderBy("text_sha256"))
    return directory, materialize(owned.withColumn("chain", chain), "hash-index")


def look_up(docs: DataFrame, directory: Directory, index: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False) -> DataFrame:
    """As ``exact_dedup``, from an index."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("hash"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), *whole_row(docs, with_row))
    out = ["id", "keep_id", "group_size", "kept", "text_sha256", *(["row"] if with_row else [])]
    entries = index.select("low", "depth", "hash", "text_sha256", "keep_id", "group_size")
    found = address(rows, directory).join(entries, ["low", "depth", "hash", "text_sha256"]).withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))
    twice = materialize(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("__twice")), "hash-repeated")
    if not twice.isEmpty():
        # Of rows that repeat an id and a text one is kept: the first of its task, then the first task.
        same = F.col("id").eqNullSafe(F.col("__twice"))
        often = found.join(twice, same, "left_semi").withColumn("__task", F.spark_partition_id())
        often = often.withColumn("__nth", F.row_number().over(Window.partitionBy("id", "text_sha256", "__task").orderBy("hash")))
        often = often.withColumn("__first", F.row_number().over(Window.partitionBy("id", "text_sha256", "__nth").orderBy("__task")))
        often = often.withColumn("kept", F.col("kept") & (F.col("__nth") == 1) & (F.col("__first") == 1))
        found = found.join(twice, same, "left_anti").select(*out).unionByName(often.select(*out))
    return found.select(*out).withColumnRenamed("id", id_col)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256; ``with_row`` adds the input row as
    the struct ``row``.

    Texts are equal when their bytes are; null counts as empty.  Of equal texts the row with the largest id is
    kept; of repeated rows of that id and text, one.  Null ids lose to any other; if a group has only null ids,
    one of its rows is kept.  Empty tables give no rows.  Texts of any length are hashed and compared whole.  Other
    columns are ignored, whatever their names.
    """
    return look_up(docs, *build_index(docs, id_col, text_col, capacity), id_col, text_col, with_row)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates among all documents."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
