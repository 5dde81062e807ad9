"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint's 64 bits form 32 segments of two bits; its embedding is the vector of their bit counts.  Flipping
a bit moves one count by one, so the Manhattan distance of two embeddings is at most the Hamming distance of the
fingerprints.  The counts form eight groups of four; if the distance is at most four, at least four groups have
distance zero.  So fingerprints meet in a grid with one cell for each choice of four groups and their counts,
70 cells each.  Within a cell they are ordered by their total count, which is a Manhattan distance as well; of those
within the threshold along that axis the Manhattan distance of all 32 counts is taken, and what is within the threshold there
too is verified bit by bit.  Each cell yields a spanning forest of
its links, never all pairs.  Texts of one fingerprint are folded before the grid.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soundlattice.llm.components import components
from soundlattice.llm.shared import materialize, on_file, text_or_empty, whole_row

GROUPS = 8
#: Rows of a cell that one task compares at once; larger cells are split into pairs of blocks.
CELL_ROWS = 8192
BATCH_ROWS = 200_000
#: Blocks of a cell that are compared pair by pair; the fingerprints of larger cells meet half-way.
PAIRED_BLOCKS = 64


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """The fingerprint of a UTF-8 text, unsigned; 0 for a text without words."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = np.array([digest(b" ".join(words), seed)], dtype="<u8")
    else:
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - width + 1].tolist()
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, *others: Column) -> DataFrame:
    """(id, others, fp), fp as signed 64-bit integers."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), *others, text_or_empty(text_col).cast("binary").alias("text"))
    names = rows.columns[:-1]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", fp bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x) for x in batch.column(batch.num_columns - 1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], [*names, "fp"])

    return rows.mapInArrow(run, schema)


LOW_BITS = np.uint64(0x5555555555555555)


def unary(fp: np.ndarray) -> np.ndarray:
    """Each segment's count in unary, so that the Manhattan distance of two embeddings is the Hamming distance of these."""
    bits = fp.view(np.uint64)
    a, b = bits & LOW_BITS, (bits >> np.uint64(1)) & LOW_BITS
    return (a | b) | ((a & b) << np.uint64(1))


def forest(cell: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of each cell's graph of fingerprints within ``distance`` of each other."""
    total = np.bitwise_count(fp.view(np.uint64)).astype(np.int16)
    order = np.lexsort((total, cell))
    cell, fp, total = cell[order], fp[order], total[order]
    counts = unary(fp)
    root = np.arange(len(fp))
    left, right = [], []
    at = np.arange(len(fp) - 1) if len(fp) else np.arange(0)
    gap = 1
    while len(at):
        at = at[at + gap < len(fp)]
        at = at[(cell[at] == cell[at + gap]) & (total[at + gap] - total[at] <= distance)]
        near = at[np.bitwise_count(counts[at] ^ counts[at + gap]) <= distance]  # the embedding's bound
        near = near[np.bitwise_count((fp[near] ^ fp[near + gap]).view(np.uint64)) <= distance]
        near = near[root[near] != root[near + gap]]
        if len(near):
            parent: dict[int, int] = {}

            def find(x: int, parent: dict[int, int] = parent) -> int:
                while x in parent:
                    x = parent[x]
                return x

            for i in near.tolist():
                a, b = find(int(root[i])), find(int(root[i + gap]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    left.append(i)
                    right.append(i + gap)
            table = np.arange(len(fp))
            for k in parent:
                table[k] = find(k)
            root = table[root]
        gap += 1
    return fp[np.array(left, np.int64)], fp[np.array(right, np.int64)]


def _link(distance: int, limit: int | None):
    """A mapInArrow function over rows (cell, fp) sorted by cell.

    It gives links (u, v, null), and rows (null, fp, cell) for cells above ``limit`` rows, which another pass splits.
    """

    def out(u, v, cell):
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(cell, pa.int64())], ["u", "v", "cell"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, fps, held, large = [], [], 0, None

        def done(cell: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            u, v = forest(cell, fp, distance)
            if len(u):
                yield out(u, v, [None] * len(u))

        for batch in batches:
            cell, fp = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            if large is not None:  # the rest of a cell that is being handed on
                more = int(np.searchsorted(cell, large, "right"))
                if more:
                    yield out([None] * more, fp[:more], cell[:more])
                cell, fp = cell[more:], fp[more:]
                if not len(cell):
                    continue
                large = None
            cells.append(cell)
            fps.append(fp)
            held += len(cell)
            if held < BATCH_ROWS and not (limit and held > limit):
                continue
            cell, fp = np.concatenate(cells), np.concatenate(fps)
            cut = int(np.searchsorted(cell, cell[-1], "left"))
            if limit and len(cell) - cut > limit:
                large = cell[-1]
                yield out([None] * (len(cell) - cut), fp[cut:], cell[cut:])
                cells, fps, held = [], [], 0
                yield from _whole(cell[:cut], fp[:cut], limit, out, done)
            elif cut:
                yield from _whole(cell[:cut], fp[:cut], limit, out, done)
                cells, fps, held = [cell[cut:]], [fp[cut:]], len(cell) - cut
        if held:
            yield from _whole(np.concatenate(cells), np.concatenate(fps), limit, out, done)

    return run


def _whole(cell: np.ndarray, fp: np.ndarray, limit: int | None, out, done) -> Iterator[pa.RecordBatch]:
    """Complete cells: those within ``limit`` are linked, others handed on."""
    if limit and len(cell):
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        size = np.diff(np.r_[first, len(cell)])
        big = np.repeat(size > limit, size)
        if big.any():
            yield out([None] * int(big.sum()), fp[big], cell[big])
            cell, fp = cell[~big], fp[~big]
    if len(cell):
        yield from done(cell, fp)


def halfway_links(prints: DataFrame, distance: int) -> DataFrame:
    """Links (u, v) whose closure is that of all pairs of ``prints`` (fp, distinct) within ``distance`` bits, in linear work.

    Two fingerprints are within the distance just if some word differs from the one in at most half of it, rounded up, and
    from the other in at most half, rounded down.  All that reach a word are tied to the least that is within the lesser
    half: each such link holds, and any two that are close share a word.
    """
    far, near = (distance + 1) // 2, distance // 2
    masks = [sum(1 << b for b in bits) for k in range(far + 1) for bits in combinations(range(64), k)]
    signed = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in masks))  # some two thousand for a distance of four
    reached = prints.select("fp", F.explode(signed).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("word"), (F.bit_count("mask") <= near).alias("near"))
    least = reached.groupBy("word").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("least"), F.count("*").alias("n")).where("n > 1")
    return reached.join(least.select("word", "least"), "word").where("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct()


def links(prints: DataFrame, distance: int = 4, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (u, v) whose closure is that of all pairs of ``prints`` (fp, distinct) within ``distance`` bits."""
    if not 0 <= distance < GROUPS:
        raise ValueError(f"distance must be from 0 to {GROUPS - 1}")
    spark = prints.sparkSession
    low = "6148914691236517205L"  # 0x5555...: a segment's count is its two bits' sum, a binary number of two bits
    counts = F.expr(f"((fp & {low}) ^ (shiftrightunsigned(fp, 1) & {low})) | shiftleft(fp & shiftrightunsigned(fp, 1) & {low}, 1)")
    masks = []
    for chosen in combinations(range(GROUPS), GROUPS - distance):
        mask = sum(0xFF << (8 * g) for g in chosen)
        masks.append(F.lit(mask - (1 << 64) if mask >> 63 else mask))
    grid = prints.select("fp", counts.alias("embedded"))
    grid = grid.select("fp", "embedded", F.posexplode(F.array(*masks)).alias("choice", "mask"))
    cells = grid.select(F.xxhash64("choice", F.col("embedded").bitwiseAND(F.col("mask"))).alias("cell"), "fp")
    schema = "u bigint, v bigint, cell bigint"
    found = materialize(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_link(distance, cell_rows), schema), "simhash-links")
    near = found.where("cell IS NULL").select("u", "v")
    crowded = found.where("cell IS NOT NULL").select("cell", F.col("v").alias("fp"))
    if crowded.isEmpty():
        return near
    blocks = materialize(crowded.groupBy("cell").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("blocks")), "simhash-blocks")
    huge = blocks.where(F.col("blocks") > PAIRED_BLOCKS)
    if not huge.isEmpty():
        met = crowded.join(huge.select("cell"), "cell", "left_semi").select("fp").distinct()
        near = near.unionByName(materialize(halfway_links(materialize(met, "simhash-met"), distance), "simhash-links"))
    dealt = crowded.join(blocks.where(F.col("blocks") <= PAIRED_BLOCKS), "cell").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = dealt.select("cell", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select(F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), "fp")
    more = pairs.repartition("cell").sortWithinPartitions("cell").mapInArrow(_link(distance, None), schema)
    return near.unionByName(materialize(more, "simhash-links").select("u", "v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, with_row: bool = False, cell_rows: int = CELL_ROWS) -> DataFrame:
    """A row per input row: id, fingerprint, component_id, component (the component's fingerprint name, unique).

    ``with_row`` adds the input row as the struct ``row``.  component_id is the smallest id reachable over links of at most ``distance`` differing bits; null ids are
    never smallest, and a component with no other id has a null one.  Null and empty texts, and those without
    words, have fingerprint zero and link like any other.  Texts of up to four words are one shingle; longer
    ones are read whole.  Repeated rows keep a row each.  Empty tables give no rows.  Other columns are ignored, whatever
    their names.
    """
    if with_row:
        docs, file, place = on_file(docs, "simhash-rows")
        where = [file.alias("__file"), place.alias("__place")]
    printed = materialize(fingerprints(docs, id_col, text_col, *(where if with_row else ())), "simhash-prints")
    distinct = materialize(printed.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), distance, cell_rows))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-roots")
    smallest = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-smallest")
    known = materialize(rooted.join(smallest, "root").select("fp", "component_id", "root"), "simhash-components")
    rows = printed
    if with_row:  # texts are printed once; rows come back by their place
        rows = printed.join(docs.select(*where, *whole_row(docs)), ["__file", "__place"])
    name = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return rows.join(known, "fp").select(F.col("id").alias(id_col), name("fp").alias("fingerprint"), "component_id", name("root").alias("component"), *(["row"] if with_row else []))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
