"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a share of all words; a target is at most ``max_repeats`` times its source, and
what is over is shared anew by weight.  A source's weight at time t in [0, 1] follows a line from ``start`` to
``end``; its integral is the source's cumulative demand.  A document is needed when the demand reaches the words
before it, so inverting the integral gives its training position; each copy has its own.  Everything is DataFrame code.

No source is gathered in one task: documents are dealt by hash into buckets of about ``BUCKET_ROWS`` within
their source, running sums go first over buckets, then within each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from soundlattice.llm.shared import WORD_GAP, materialize, whole_row

BUCKET_ROWS = 1024
WEIGHTS = (5.0, 2.0, 1.0)


def words(text_col: str = "text"):
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_GAP.replace("[", "[^", 1))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: float = 3.0) -> DataFrame:
    """Targets from (source_key, source_size, n): a row per source, with rank, weight, target, start and end.

    Sources rank by code point, null last; ``weights`` repeat along the ranks.  With sources ordered by
    cap / weight, those before the first uncapped one take their caps and the rest share what is left by weight.
    ``start`` and ``end`` are the weight's multipliers at times 0 and 1: early ranks fade, late ranks grow.
    """
    every = Window.orderBy("source_key")
    ranked = sizes.withColumn("rank", F.row_number().over(every))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_repeats)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = ranked.withColumn("level", level)
    free = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level").alias("level")))
    levels = levels.withColumn("shared", F.min(free).over(whole)["level"])
    target = F.coalesce(F.least(F.col("shared") * F.col("weight"), F.col("cap")), F.col("cap"))
    late = F.when(F.max("rank").over(whole) > 1, (F.col("rank") - 1) / (F.max("rank").over(whole) - 1)).otherwise(F.lit(0.5))
    return levels.select("source_key", "n", "source_size", "rank", "weight", target.cast("double").alias("target"), (1.5 - late).alias("start"), (0.5 + late).alias("end"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_row: bool = False, weights: tuple[float, ...] = WEIGHTS, max_repeats: float = 3.0) -> DataFrame:
    """The mix, a row per input row, range-sorted by position: as of ``place``."""
    return place(docs, id_col, text_col, source_col, with_row, weights, max_repeats).orderBy(F.col("position").asc_nulls_last(), F.col(id_col))


def place(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_row: bool = False, weights: tuple[float, ...] = WEIGHTS, max_repeats: float = 3.0) -> DataFrame:
    """A row per input row, in no order.

    id, size (words), source_size, target, taken (words taken, repeats counted), copies, time, position, positions;
    ``with_row`` adds the input row as the struct ``row``.  A source's documents are taken whole, each floor(target / source_size) times, and once
    more along a hash order until the rest of the target is met; a source misses its target by half a document at
    most.  ``time`` is the share of training before the first copy, ``position`` the words of all sources before
    it; both are null where no copy is taken, and such rows come last.  ``positions`` has the position of each copy:
    copy k of a source's document follows k times the source's words.  Null texts and texts without words have
    size 0, and texts of any length are counted whole; null sources form one source, last in order.  Repeated rows count each.  Empty tables give no rows.  Other columns are ignored, whatever their names.
    """
    key = F.coalesce(F.concat(F.lit("0"), F.col(source_col).cast("string")), F.lit("1"))
    sized = docs.select(F.col(id_col).alias("__id"), key.alias("source_key"), words(text_col).alias("size"), *whole_row(docs, with_row))
    sized = sized.withColumn("order", F.xxhash64("__id", "size"))
    slim = materialize(sized.select("source_key", "size", "order"), "mix-sizes")
    totals = slim.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = materialize(source_targets(totals, weights, max_repeats), "mix-sources")

    place = F.floor(F.shiftrightunsigned("order", 40) * F.ceil(F.col("n") / BUCKET_ROWS) / F.lit(1 << 24)).alias("bucket")
    of = sources.select("source_key", "n")
    dealt = slim.join(of, "source_key").select("source_key", "size", place)
    sums = dealt.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    running = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialize(sums.select("source_key", "bucket", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)).alias("words_before")), "mix-buckets")

    within = Window.partitionBy("source_key", "bucket").orderBy(F.shiftrightunsigned("order", 1), "order", "__id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.join(sources, "source_key").withColumn("bucket", place).withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(sums, ["source_key", "bucket"]).withColumn("at", F.col("words_before") + F.col("inside"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    rows = rows.withColumn("whole", whole)
    rows = rows.withColumn("copies", (F.col("whole") + F.when(F.col("at") + F.col("size") / 2 <= rest, 1).otherwise(0)).cast("int"))

    demand = sources.agg(
        F.coalesce(F.sum(F.col("target") * 2 * F.col("start") / (F.col("start") + F.col("end"))), F.lit(0.0)).alias("linear"),
        F.coalesce(F.sum(F.col("target") * (F.col("end") - F.col("start")) / (F.col("start") + F.col("end"))), F.lit(0.0)).alias("square"),
    ).first()

    def time_of(copy: Column) -> Column:
        spent = F.when(F.col("target") > 0, F.least((F.col("at") + copy * F.col("source_size")) / F.col("target"), F.lit(1.0)))
        need = spent * (F.col("start") + F.col("end")) / 2
        root = F.sqrt(F.col("start") * F.col("start") + 2 * (F.col("end") - F.col("start")) * need)
        return 2 * need / (F.col("start") + root)

    def position_of(time: Column) -> Column:
        return F.lit(demand["linear"]) * time + F.lit(demand["square"]) * time * time

    rows = rows.withColumn("times", F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), time_of)))
    rows = rows.withColumn("positions", F.transform("times", position_of)).withColumn("time", F.get("times", F.lit(0))).withColumn("position", F.get("positions", F.lit(0)))
    return rows.select(F.col("__id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "time", "position", "positions", *(["row"] if with_row else []))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
