"""Lineage cuts in the cluster's shared folder, and other helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Word separators of every operator here: space, and tab to carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where that is unset in local mode (tests) a temporary folder is made and stored in the setting.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="soundlattice-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


_WRITTEN: list[set[str]] = []


@contextmanager
def written() -> Iterator[set[str]]:
    """Collects the folders that are handed out within: what is not needed any more can be dropped."""
    made: set[str] = set()
    _WRITTEN.append(made)
    try:
        yield made
    finally:
        _WRITTEN.pop()


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _WRITTEN:
        made.add(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: executors may be lost without recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = StructType.fromJson(df.schema.jsonValue())
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def folders(df: DataFrame) -> set[str]:
    """The names, without the way to them, of the folders that a table is read from."""
    return {f.split("/")[-2] for f in df.inputFiles()}


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete written folders that nothing reads any more."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list[Column], number: str, name: str) -> DataFrame:
    """``df`` with its rows numbered from 0, without gaps, along ``order``; equal rows in any order.

    Rows are range-partitioned and written once with their place in their partition; only a count for each
    partition is gathered, and sent back to all tasks.  No order of a tie crosses a task's memory: equal rows may
    spread over partitions.
    """
    spread = df.withColumn("__tie", F.monotonically_increasing_id())
    spread = spread.repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    placed = materialize(spread.withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))
    before = counts.select("__part", (F.sum("__rows").over(Window.orderBy("__part")) - F.col("__rows")).alias("__before"))
    out = placed.withColumn("__part", part).join(F.broadcast(before), "__part")  # a row for each partition
    return out.withColumn(number, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__before")


def on_file(df: DataFrame, name: str) -> tuple[DataFrame, Column, Column]:
    """(df, file, row): a table read from files, written first if need be, and the columns that name a row's place there."""
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException as error:
        if not str(error.getCondition()).startswith("UNRESOLVED_COLUMN"):
            raise
        df = materialize(df, name)
    return df, F.col("_metadata.file_path"), F.col("_metadata.row_index")


def written_place(docs: DataFrame) -> Column:
    """A row's place in the table as it was written: by part file, then by row.

    Rows that come from no file have their place in the plan.
    """
    try:
        docs.select("_metadata.row_index", "_metadata.file_name")
    except AnalysisException as error:
        if not str(error.getCondition()).startswith("UNRESOLVED_COLUMN"):
            raise
        return F.monotonically_increasing_id()
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long")
    return F.shiftleft(F.coalesce(part, F.lit(0).cast("long")), 33) + F.col("_metadata.row_index")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(column):
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def whole_row(df: DataFrame, wanted: bool = True) -> list:
    """The input row as one struct column, so that its names meet no others; an empty list if not wanted."""
    return [F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")] if wanted else []


def chosen(wanted: int, total: int, *columns: str):
    """A condition that about ``wanted`` of ``total`` rows meet, by a hash of their values: nothing is sorted."""
    share = min(1.0, wanted / max(1, total))
    return F.pmod(F.xxhash64(F.lit(17), *columns), F.lit(1 << 30)) < int(share * (1 << 30))
