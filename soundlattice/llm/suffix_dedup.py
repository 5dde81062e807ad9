"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if it lies in a string of ``SPAN`` bytes that starts anywhere else too.  Only such suffixes matter, and
only their first SPAN bytes.

Copies of a whole text are folded first, by their bytes.

Buckets.  A suffix falls into the bucket of its anchor: the gram of ``GRAM`` bytes with the least checksum among those
of its SPAN bytes (the last of equals).  Equal strings have equal anchors at the same place, so they meet in one
bucket; an anchor is shared by many neighbouring suffixes, whose bytes together are its context.  An anchor that occurs
once in the corpus proves all its suffixes unique, and only the others go on.  A bucket of more than
``BUCKET_ROWS`` contexts is split by the next bytes: its columns are halved, and a half's bucket is named by the bytes
that all its suffixes have in common.  Equal contexts are folded before each split, so a passage of millions of
documents is one context within and splits fast at its edges; at one column all contexts of a bucket are equal.

Order.  One bucket at a time is sorted in a task.  Equal contexts are repeated as a whole.  The orders of the others to
the right of their anchor and, reversed, to the left bound from above what a context shares with any other, which leaves the
columns where SPAN bytes may be shared.  The suffixes there are sorted by their first ``PERIOD`` bytes; longer
ties are resolved by the ranks of a difference-cover sample: the columns whose remainder by PERIOD is in ``COVER``, ranked
before by doubling.  For any two columns some step below PERIOD leads both into the sample, so a tie is settled by two ranks,
however long it is.  Neighbours in the order that share SPAN bytes are marked.

Checksums only choose buckets; all else compares bytes, or ranks that come from bytes.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundlattice.llm.shared import drop, folders, materialize, shared_dir, text_or_empty

SPAN, GRAM = 200, 48
LEFT = SPAN - GRAM  # the anchor's column
#: Differences of members of COVER give every remainder of PERIOD.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Columns of a context, a multiple of PERIOD, at least LEFT + SPAN.
WIDTH = 372
#: Columns of suffixes, a power of two above LEFT.
COLUMNS = 256
#: Contexts of a bucket that one task sorts; larger buckets are split.
BUCKET_ROWS = 1024
#: Contexts in memory at once, if no bucket is larger.
BATCH_ROWS = 8_000
#: Bytes that are hashed at once; longer texts are hashed piece by piece.
SLAB = 1 << 20
PLACE = np.uint64((1 << 32) - 1)
SPANS = "tid bigint, first bigint, last bigint"
CONTEXTS = ("key", "lo", "hi", "bytes", "tid", "at", "copies")


def _mix(a: np.ndarray, b: np.ndarray, level: int, seed: int = 0) -> np.ndarray:
    out = a * np.uint64(0x9E3779B97F4A7C15 + 2 * level + 1024 * seed) + b
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def string_hashes(data: np.ndarray, sizes: tuple[int, ...], seed: int = 0) -> np.ndarray:
    """64-bit hashes of all strings of sum(sizes) bytes; sizes are descending powers of two."""
    h = data.astype(np.uint64) + np.uint64(1)
    levels, size = {1: h}, 1
    while size < sizes[0]:
        h = _mix(h[:-size], h[size:], size, seed)
        size *= 2
        if size in sizes:
            levels[size] = h
    out, done = levels[sizes[0]], sizes[0]
    for size in sizes[1:]:
        out = _mix(out[: len(data) - done - size + 1], levels[size][done:], done + size, seed)
        done += size
    return out


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, place, first, last) of the anchors of concatenated texts; first and last are the suffixes' range.

    ``ends`` holds the text end for each byte.  Suffixes whose SPAN bytes leave their text are left out.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return empty.view(np.uint64), empty, empty, empty
    h = string_hashes(data, (32, 16))
    key = (h & ~PLACE) | (PLACE - np.arange(len(h), dtype=np.uint64))
    size = 1
    low = key
    while size < 128:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    reach = LEFT + 1 - 128
    low = np.minimum(low[: len(low) - reach], low[reach:])
    place = (PLACE - (low & PLACE)).astype(np.int64)
    start = np.arange(len(place))
    start = start[start + SPAN <= ends[: len(place)]]
    place = place[start]
    if not len(place):
        return empty.view(np.uint64), empty, empty, empty
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)])
    last = np.r_[first[1:], len(place)] - 1
    return h[place[first]], place[first], start[first], start[last]


def text_anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """As ``anchors``, for data of any length: pieces of SLAB bytes overlap, and a run cut by them is one again."""
    if len(data) <= 2 * SLAB:
        return anchors(data, ends)
    parts = []
    for at in range(0, len(data) - SPAN + 1, SLAB):
        to = min(len(data), at + SLAB + SPAN - 1)
        h, place, first, last = anchors(data[at:to], np.minimum(ends[at:to], to) - at)
        parts.append((h, place + at, first + at, last + at))
    h, place, first, last = (np.concatenate([p[i] for p in parts]) for i in range(4))
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (first[1:] != last[:-1] + 1)])
    return h[new], place[new], first[new], last[np.r_[new[1:], len(place)] - 1]


def slabs(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, starts, data, ends) of consecutive texts of a binary column, about SLAB bytes at once."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLAB, "right")) - 1)
        cut = offsets[at : to + 1] - offsets[at]
        part = data[offsets[at] : offsets[to]]
        yield np.arange(at, to), cut[:-1], part, np.repeat(cut[1:], np.diff(cut))
        at = to


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (tid, text): (h, tid, pos, lo, hi) of anchors; lo and hi are the columns of its first and last suffix."""
    for batch in batches:
        tid = batch.column(0).to_numpy(zero_copy_only=False)
        for rows, starts, data, ends in slabs(batch.column(1)):
            h, place, first, last = text_anchors(data, ends)
            if len(h):
                text = np.searchsorted(starts, place, "right") - 1
                lo, hi = ((x - place + LEFT).astype(np.int16) for x in (first, last))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), tid[rows[text]], place - starts[text], lo, hi)], ["h", "tid", "pos", "lo", "hi"])


#: For each pair of remainders the step that leads both into the cover; for each remainder its own step.
STEP = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])
OWN_STEP = np.array([STEP[a, a] for a in range(PERIOD)])


def _ranks(parts: list[np.ndarray]) -> np.ndarray:
    """Ranks, from 0 and equal for equals, of rows given by columns of descending weight."""
    order = np.lexsort(parts[::-1])
    new = np.zeros(len(order), bool)
    for p in parts:
        q = p[order]
        new[1:] |= q[1:] != q[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _words(table: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[np.ndarray]:
    """The PERIOD bytes from each (row, column) as four numbers that compare as the bytes do."""
    windows = np.lib.stride_tricks.sliding_window_view(table, PERIOD, axis=1)[rows, columns]
    held = np.zeros((len(rows), 32), np.uint8)
    held[:, :PERIOD] = windows
    return list(held.view(">u8").astype(np.uint64).T)


def cover_ranks(table: np.ndarray) -> np.ndarray:
    """Ranks of the strings of 8 * PERIOD bytes, zeros beyond the row, from each sampled column; -1 elsewhere."""
    rows, width = len(table), table.shape[1] - PERIOD
    columns = np.flatnonzero(np.isin(np.arange(width) % PERIOD, COVER))
    r, c = np.repeat(np.arange(rows), len(columns)), np.tile(columns, rows)
    ranks = np.full((rows, width + 8 * PERIOD), -1, np.int64)
    ranks[r, c] = _ranks(_words(table, r, c))
    size = PERIOD
    while size < 8 * PERIOD:
        ranks[r, c] = _ranks([ranks[r, c], ranks[r, c + size]])
        size *= 2
    return ranks


def suffix_order(table: np.ndarray, bucket: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The order of the suffixes at (row, column) by bucket and their first SPAN bytes at least.

    ``table`` has WIDTH columns of bytes and PERIOD zeros.  Ties of PERIOD bytes are settled by sample ranks: where
    all members of a tie have one remainder, by one rank each, else pair by pair with the pair's own step.
    """
    keys = [bucket[rows], *_words(table, rows, columns)]
    order = np.lexsort(keys[::-1])
    same = np.ones(len(order), bool)
    same[:1] = False
    for k in keys:
        q = k[order]
        same[1:] &= q[1:] == q[:-1]
    tie = np.cumsum(~same) - 1
    size = np.bincount(tie, minlength=1)
    long = size[tie] > 1
    if not long.any():
        return order
    ranks = cover_ranks(table)
    at = order[long]
    group, rest = tie[long], columns[at] % PERIOD
    rank = ranks[rows[at], columns[at] + OWN_STEP[rest]]
    settled = np.lexsort((rank, group))
    at, group, rest = at[settled], group[settled], rest[settled]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    mixed = np.maximum.reduceat(rest, first) != np.minimum.reduceat(rest, first)
    last = np.r_[first[1:], len(group)]
    for a, b in zip(first[mixed].tolist(), last[mixed].tolist(), strict=True):

        def compare(x: int, y: int) -> int:
            step = STEP[columns[x] % PERIOD, columns[y] % PERIOD]
            return int(ranks[rows[x], columns[x] + step]) - int(ranks[rows[y], columns[y] + step])

        at[a:b] = sorted(at[a:b].tolist(), key=functools.cmp_to_key(compare))
    order[long] = at
    return order


def _shared(side: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The longest common beginning of each row of bytes with another of its bucket, 0 where it is alone."""
    named = np.concatenate([bucket.astype(">u4").view(np.uint8).reshape(-1, 4), side], axis=1)
    order = np.argsort(np.ascontiguousarray(named).view(f"S{named.shape[1]}").ravel(), kind="stable")
    by = side[order]
    differ = by[1:] != by[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), side.shape[1])
    common[bucket[order[1:]] != bucket[order[:-1]]] = 0
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(np.r_[0, common], np.r_[common, 0])
    return out


def repeated(table: np.ndarray, bucket: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether the suffix at each column up to LEFT of each row shares its SPAN bytes with another row of its bucket."""
    out = np.zeros((len(table), LEFT + 1), bool)
    right = _shared(table[:, LEFT : LEFT + SPAN], bucket)
    left = _shared(table[:, :LEFT][:, ::-1], bucket)
    lo, hi = np.maximum(lo, LEFT - left), np.minimum(hi, LEFT + right - SPAN)
    alive = np.flatnonzero(lo <= hi)
    if len(alive) < 2:
        return out
    few, size = table[alive], (hi - lo + 1)[alive]
    rows = np.repeat(np.arange(len(alive)), size)
    columns = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[alive], size)
    own = bucket[alive]
    order = suffix_order(few, own, rows, columns)
    rows, columns = rows[order], columns[order]
    near = np.flatnonzero((own[rows[1:]] == own[rows[:-1]]) & (columns[1:] == columns[:-1]))
    spans = np.lib.stride_tricks.sliding_window_view(few, SPAN, axis=1)
    equal = np.zeros(max(0, len(rows) - 1), bool)
    for k in range(0, len(near), 65536):
        i = near[k : k + 65536]
        equal[i] = (spans[rows[i], columns[i]] == spans[rows[i + 1], columns[i + 1]]).all(axis=1)
    marked = np.r_[False, equal] | np.r_[equal, False]
    out[alive[rows[marked]], columns[marked]] = True
    return out


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of true columns."""
    edge = np.diff(np.pad(marks.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    _, after = np.nonzero(edge == -1)
    return row, first, after - 1


def sort_buckets(contexts: pa.Table) -> pa.RecordBatch:
    """(tid, first, last), the bytes of the repeated suffixes of whole buckets, from contexts sorted by key.

    Contexts that stand for several copies give partners, not results.
    """
    key, tid, at, copies = (contexts.column(c).to_numpy() for c in ("key", "tid", "at", "copies"))
    los, his = (contexts.column(c).to_pylist() for c in ("lo", "hi"))
    ordinal = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
    seen: dict[tuple, int] = {}
    of = [seen.setdefault(x, len(seen)) for x in zip(ordinal.tolist(), los, contexts.column("bytes").to_pylist(), strict=True)]
    of = np.array(of, np.int64)
    weight = np.bincount(of, copies, minlength=len(seen))
    lo, hi = np.array(los, np.int64), np.array(his, np.int64)
    whole = np.flatnonzero((weight[of] > 1) & (copies == 1))
    out = [(tid[whole], (at + lo)[whole], (at + hi)[whole] + SPAN)]
    first = np.zeros(len(seen), np.int64)
    first[of[::-1]] = np.arange(len(of))[::-1]
    bucket = ordinal[first]
    several = np.flatnonzero(np.bincount(bucket)[bucket] > 1)
    if len(several) and (weight[several] == 1).any():
        names, table = list(seen), np.zeros((len(several), WIDTH + PERIOD), np.uint8)
        for i, k in enumerate(several.tolist()):
            _, a, blob = names[k]
            table[i, a : a + len(blob)] = np.frombuffer(blob, np.uint8)
        r = first[several]
        row, begin, end = _runs(repeated(table, bucket[several], lo[r], hi[r]))
        single = weight[several][row] == 1
        r, begin, end = r[row[single]], begin[single], end[single]
        out.append((tid[r], at[r] + begin, at[r] + end + SPAN))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]), pa.int64()) for i in range(3)], ["tid", "first", "last"])


def _sort_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``sort_buckets`` over contexts sorted by key, some whole buckets at once."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            held.append(batch.slice(at, BATCH_ROWS))
            size += held[-1].num_rows
            if size < BATCH_ROWS:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut:
                yield sort_buckets(table.slice(0, cut))
                rest = table.slice(cut)
                held, size = rest.combine_chunks().to_batches(), len(rest)
    if size:
        yield sort_buckets(pa.Table.from_batches(held))


def order_buckets(contexts: DataFrame) -> DataFrame:
    """(tid, first, last) from contexts whose buckets each fit a task."""
    return contexts.select(*CONTEXTS).repartition("key").sortWithinPartitions("key").mapInArrow(_sort_all, SPANS)


def order_large_buckets(contexts: DataFrame, bucket_rows: int) -> DataFrame:
    """As ``order_buckets`` for buckets of any size: equal contexts are folded, and full buckets split by further bytes.

    Each level halves a bucket's columns, so eight levels leave one column, where a bucket's contexts are equal.
    A context goes to a next level only where its bucket is still full, which is at the edges of what is repeated.
    """
    found = []
    width = COLUMNS
    while True:
        contexts = materialize(contexts.select(*CONTEXTS, F.sha2("bytes", 256).alias("digest")), "suffix-split")
        folded = contexts.groupBy("key", "lo", "hi", "bytes").agg(F.sum("copies").alias("copies"), F.max("tid").alias("tid"), F.max("at").alias("at"))
        folded = materialize(folded, "suffix-folded")  # tid and at matter for single contexts
        twice = folded.where("copies > 1").select("key", "lo", "hi", F.sha2("bytes", 256).alias("digest"))
        whole = contexts.where("copies = 1").join(twice, ["key", "lo", "hi", "digest"], "left_semi")
        found.append(materialize(whole.select("tid", (F.col("at") + F.col("lo")).alias("first"), (F.col("at") + F.col("hi") + SPAN).alias("last")), "suffix-whole"))
        sizes = materialize(folded.groupBy("key").agg(F.count("*").alias("size"), F.min("copies").alias("least")).where("size > 1 AND least = 1").select("key", ((F.col("size") > bucket_rows) & F.lit(width > 1)).alias("full")), "suffix-sizes")
        found.append(materialize(order_buckets(folded.join(sizes.where("NOT full"), "key")), "suffix-sorted"))
        full = sizes.where("full")
        if full.isEmpty():
            return functools.reduce(DataFrame.unionByName, found)
        width //= 2
        blocks = F.sequence(F.floor(F.col("lo") / width).cast("int"), F.floor(F.col("hi") / width).cast("int"))
        halves = folded.join(full, "key").withColumn("block", F.explode(blocks)).withColumns({"a": F.greatest("lo", F.col("block") * width), "b": F.least("hi", (F.col("block") + 1) * width - 1)})
        part = lambda a, b: F.expr(f"substring(bytes, CAST({a} - lo + 1 AS int), CAST({b} - {a} AS int))")
        common = part(f"((block + 1) * {width} - 1)", f"(block * {width} + {SPAN})")  # the bytes of every suffix of the block
        contexts = halves.select(F.xxhash64("key", "block", common).alias("key"), F.col("a").cast("short").alias("lo"), F.col("b").cast("short").alias("hi"), part("a", f"(b + {SPAN})").alias("bytes"), "tid", "at", "copies")


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (sha, text, spans): (sha, n_removed, n_spans, kept_sha256)."""
    for batch in batches:
        rows = []
        for sha, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            merged: list[list[int]] = []
            for s in sorted((x["first"], x["last"]) for x in spans):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            digest, at = hashlib.sha256(), 0
            for a, b in merged:
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            rows.append((sha, sum(b - a for a, b in merged), len(merged), digest.hexdigest()))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["sha", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A row per input row: id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, null ones empty; strings never cross texts and are judged on the input.  A text with a
    copy, its own row repeated included, loses all its bytes from SPAN bytes on.  Shorter texts lose nothing.
    Empty tables give no rows.  Copies are folded by their bytes and go by their SHA-256.  Long texts are hashed in
    pieces and cut as a whole.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col).cast("binary")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.sha2(text, 256).alias("sha"), F.octet_length(text).cast("long").alias("n"), text.alias("text"))
    texts = rows.groupBy("sha", "text").agg(F.count("*").alias("copies"))
    texts = materialize(texts.select(F.monotonically_increasing_id().alias("tid"), "sha", "copies", "text"), "suffix-texts")
    long = texts.where(F.octet_length("text") >= SPAN)
    found = materialize(long.select("tid", "text").mapInArrow(_emit_anchors, "h bigint, tid bigint, pos bigint, lo smallint, hi smallint"), "suffix-anchors")
    members = found.groupBy("h").agg(F.count("*").alias("members")).where("members > 1")
    several = materialize(members.select("h", (F.col("members") > bucket_rows).alias("large")), "suffix-several")
    places = found.join(several, "h").groupBy("tid").agg(F.collect_list(F.struct("h", "pos", "lo", "hi", "large")).alias("places"))
    known = materialize(long.drop("sha").join(places, "tid"), "suffix-known")  # read for each kind of bucket

    def contexts(large: str) -> DataFrame:
        each = known.select("tid", "copies", "text", F.explode(F.filter("places", lambda p: p["large"] if large else ~p["large"])).alias("p"))
        at = F.col("p.pos") - LEFT
        cut = F.expr("substring(text, CAST(p.pos + p.lo - %d AS int), CAST(p.hi - p.lo + %d AS int))" % (LEFT - 1, SPAN))
        return each.select(F.col("p.h").alias("key"), "p.lo", "p.hi", cut.alias("bytes"), "tid", at.alias("at"), F.least(F.lit(2), "copies").cast("long").alias("copies"))

    spans = order_buckets(contexts(""))
    if not several.where("large").isEmpty():
        spans = spans.unionByName(order_large_buckets(contexts("large"), bucket_rows))
    spans = materialize(spans, "suffix-spans")
    drop(spark, *(f"{shared_dir(spark)}/{name}" for name in folders(found) | folders(known)))
    listed = spans.groupBy("tid").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    cut = texts.where("copies = 1").join(listed, "tid").select("sha", "text", "spans")
    cut = materialize(cut.mapInArrow(_clean, "sha string, n_removed bigint, n_spans bigint, kept_sha256 string"), "suffix-cut")
    gone = texts.where("copies > 1").where(F.octet_length("text") >= SPAN).select("sha", F.octet_length("text").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256().hexdigest()).alias("kept_sha256"))
    changed = cut.unionByName(gone)
    out = rows.select("id", "sha", "n").join(changed, "sha", "left")
    none = F.lit(0).cast("long")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_bytes"), F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 200-byte strings of all documents."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
