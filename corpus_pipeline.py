"""A training corpus from the documents table: five stages, each written as Parquet and read again.

All stages read whole tables and whole texts.  Null texts count as empty; rows with null ids or other nulls pass like
others; repeated rows are judged each; empty tables stay empty; extra columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from soundlattice.llm.exact_dedup import exact_dedup
from soundlattice.llm.mixing import place
from soundlattice.llm.packing import default_tokenizer, pack
from soundlattice.llm.shared import drop, folders, materialize, written, written_place
from soundlattice.llm.simhash import near_duplicates
from soundlattice.llm.toxicity import score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; empty texts and those without a matching clause stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, labels, with_row=True).where("predicted = 0").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest id; of several null ids or equal rows, one.  Empty texts are one text."""
    return exact_dedup(docs, with_row=True).where("kept").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id; a group of null ids keeps one.

    Texts without words share a fingerprint and so a group.
    """
    found = near_duplicates(docs, with_row=True).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    nth = F.row_number().over(Window.partitionBy("component").orderBy("fingerprint", F.col("row.text")))
    return found.withColumn("nth", nth).where("nth = 1").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each copy at its position: range-sorted.  Texts without words may be taken."""
    copies = place(docs, with_row=True).select("row", F.posexplode("positions").alias("copy", "position"))
    return copies.orderBy(F.col("position").asc_nulls_last(), "row.doc_id", "copy").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: ``place`` is the document's place along the schedule, by which each bucket is numbered.

    An empty text is the end id alone, one sequence of one id.
    """
    placed = docs.select("doc_id", "text", written_place(docs).alias("place"))
    return pack(placed, *default_tokenizer(), keep=("doc_id", "place"), order=("place",))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: Toxicity, fingerprints and token ids are no SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the sequences of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    old: set[str] = set()
    for name, stage in STAGES[:-1]:
        with written() as made:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        own = folders(docs)
        drop(spark, *(p for p in made | old if p.rpartition("/")[2] not in own))
        old = made
    return STAGES[-1][1](spark, docs, sf_dir)
