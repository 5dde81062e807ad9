"""Packing by power-of-two decomposition.

A document's token ids are cut into pieces whose lengths are the powers of two of the binary form of its
length, whole sequences of ``max_len`` first.  A piece is a training sequence of its own: pieces of equal
length share a bucket and are written together, so that batches are drawn from one bucket; nothing is padded and
no sequence crosses documents.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundlattice.llm.shared import materialize, numbered, text_or_empty

#: Distinct words whose ids a Python worker remembers; further words are encoded each time.
MEMORY_WORDS = 1_000_000
SPECIAL = {"<|endoftext|>": 50256}
PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def cuts(length: int, max_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``length`` ids, longest first."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    out = [(start, max_len) for start in range(0, length - length % max_len, max_len)]
    at, rest = length - length % max_len, length % max_len
    while rest:
        piece = 1 << (rest.bit_length() - 1)
        out.append((at, piece))
        at, rest = at + piece, rest - piece
    return out


#: White space of either library beside the plain space and the line feed; a superset is safe.
ODD_SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
#: Where a character that is no white space stands before one that is.
BOUNDARY = re.compile(f"(?<=[^\\s{ODD_SPACES}])(?=[\\s{ODD_SPACES}])")


class Encoder(dict):
    """Byte-level BPE ids as little-endian unsigned 32-bit bytes.

    No pre-token of the pattern goes on from a character that is no white space to one that is, and the pattern
    looks behind nowhere, so a text may be parted between two such characters; a letter and a stop or comma after it
    are parted too.  Parts are encoded one by one and remembered.  Texts with a special token's string are encoded whole.
    """

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)

    def __missing__(self, word: str) -> bytes:
        """Ids of a part of a text; a part may still hold boundaries at line feeds."""
        parts = BOUNDARY.split(word) if "\n" in word else [word]
        if len(parts) > 1:
            ids = b"".join([self[p] for p in parts])
        elif word[-1] in ".," and word[-2:-1].isalpha():
            ids = self[word[:-1]] + self[word[-1]]
        else:
            ids = np.array(self.coder.encode_ordinary(word), dtype="<u4").tobytes()
        if len(word) < 64 and len(self) < MEMORY_WORDS:
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if "<|endoftext|>" in text:
            return np.array(self.coder.encode(text, allowed_special="all"), dtype="<u4").tobytes()
        if "  " in text or "\n " in text or "\0" in text or any(c in text for c in ODD_SPACES):
            return b"".join([self[w] for w in BOUNDARY.split(text) if w])
        # Here each space stands after a character that is no white space, or at the text's start.
        return b"".join([self[w] for w in text.replace(" ", "\0 ").split("\0") if w])


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder_for(ranks_path: str, pattern: str) -> Encoder:
    """The worker's encoder; it outlives a task."""
    if (ranks_path, pattern) not in _ENCODERS:
        _ENCODERS[ranks_path, pattern] = Encoder(ranks_path, pattern)
    return _ENCODERS[ranks_path, pattern]


def pack(docs: DataFrame, ranks_path: str, pattern: str, max_len: int = 2048, end_id: int = 1, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", with_ids: bool = False, order: tuple[str, ...] | None = None) -> DataFrame:
    """One row per piece: the ``keep`` columns, start, length, ids_crc32, doc_tokens, bucket, sequence_id, offset.

    Every id of every document lies in exactly one piece, the added ``end_id`` included; a null or empty text
    is that id alone.  Lengths are powers of two up to ``max_len``, so no sequence has padding.  ``bucket`` is
    the binary logarithm of the length.  Pieces of a bucket are written together and number ``sequence_id`` without
    gaps, longest first, within a bucket by ``order`` (of the ``keep`` columns, all by default; nulls first) and
    start: the numbers are the same for any splits of the input.  ``offset`` is 0, since a piece fills its sequence.
    Repeated rows are packed once per row, empty tables give no rows, other columns are ignored, whatever their
    names.  Texts of any length are encoded whole.  ``with_ids`` adds the ids themselves.
    """
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", {PIECES}, ids binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(ranks_path, pattern)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row, start, length, crc, total, blobs = [], [], [], [], [], []
                for i, text in enumerate(part.column(part.num_columns - 1).to_pylist()):
                    ids = encoder.ids(text) + end
                    for s, n in cuts(len(ids) // 4, max_len):
                        piece = ids[4 * s : 4 * (s + n)]
                        row.append(i)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(piece))
                        total.append(len(ids) // 4)
                        blobs.append(piece if with_ids else None)
                kept = [part.column(k).take(pa.array(row, pa.int64())) for k in range(len(fields))]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array(blobs, pa.binary())],
                    [*keep, "start", "length", "ids_crc32", "doc_tokens", "ids"],
                )

    source = docs.select(*(F.col(f"`{c}`") for c in keep), text_or_empty(text_col).alias("__text"))
    pieces = materialize(source.mapInArrow(cut, schema), "pack-pieces")  # ranges are sampled: texts are encoded once
    pieces = pieces.withColumn("bucket", F.log2("length").cast("int"))
    along = [F.desc("bucket"), *(F.col(f"`{c}`") for c in (keep if order is None else order)), F.col("start"), F.col("ids_crc32")]
    out = numbered(pieces, along, "sequence_id", "pack-sequences").withColumn("offset", F.lit(0).cast("long"))
    return out if with_ids else out.drop("ids")


def default_tokenizer() -> tuple[str, str]:
    """The byte-level vocabulary as ranks, and its pre-tokenizer's pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut into power-of-two sequences of at most 2048 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), *default_tokenizer())
