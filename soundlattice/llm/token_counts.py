"""Token counts through a digest cache.

A text is known by the SHA-256 of its UTF-8 bytes, a tokenizer by the SHA-256 of its model file.  The
cache is a Parquet table of (tokenizer, digest, n_tokens).  Counting joins the corpus's distinct digests to the
cache, encodes each distinct missing text once, appends the new counts, and reads every count from the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundlattice.llm.shared import fresh_path, materialize, text_or_empty

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens bigint"
#: Texts handed to the tokenizer at once.
ENCODE_ROWS = 128


def model_bytes(path: str) -> tuple[bytes, str]:
    """A tokenizer file and its digest, the version that keys the cache."""
    with open(path, "rb") as f:
        raw = f.read()
    return raw, hashlib.sha256(raw).hexdigest()


def counter(raw: bytes, kind: str):
    """A function from a list of texts to their token counts, without begin, end or added special tokens."""
    if kind == "model":
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=raw)
        return lambda texts: [len(x) for x in processor.encode(texts, out_type=int, num_threads=1)]
    if kind == "json":
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(raw.decode("utf-8"))
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(x) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    raise ValueError(f"unknown tokenizer kind {kind!r}")


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame | None:
    """Counts stored for one tokenizer version, or None where nothing was ever stored."""
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return cache.where(F.col("tokenizer") == version).select("digest", "n_tokens")


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of whole texts: (id, n_bytes, n_tokens, over_limit), a row per input row.

    Null texts count as empty (no bytes, no tokens).  Repeated rows and ids each keep a row.  A table without
    rows gives none.  Other columns are ignored, whatever their names.  Texts of any length are encoded whole.
    ``cache_path`` must lie in storage that driver and executors share; a second call with the same cache and
    tokenizer encodes nothing.
    """
    spark = docs.sparkSession
    raw, version = model_bytes(tokenizer_path)
    kind = tokenizer_path.rpartition(".")[2]
    sent = spark.sparkContext.broadcast(raw)
    text = text_or_empty(text_col)
    digest = F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    keyed = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), digest)
    texts = docs.select(digest, text.alias("text"))
    stored = read_cache(spark, cache_path, version)
    if stored is not None:  # texts meet the missing digests, which are few where the cache is warm
        fresh = materialize(texts.select("digest").distinct().join(stored, "digest", "left_anti"), "token-misses")
        texts = texts.join(fresh, "digest", "left_semi")
    missing = texts.groupBy("digest").agg(F.first("text").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(sent.value, kind)
        for batch in batches:
            counts: list[int] = []
            for at in range(0, batch.num_rows, ENCODE_ROWS):
                counts += count(batch.column(1).slice(at, ENCODE_ROWS).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([version] * batch.num_rows, pa.string()), batch.column(0), pa.array(counts, pa.int64())], ["tokenizer", "digest", "n_tokens"])

    missing.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    # Two callers may have appended the same digest.  Written, so that the join is of two plain exchanges and a hot digest splits.
    counts = materialize(read_cache(spark, cache_path, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    return keyed.join(counts, "digest").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents by piece_bpe_32k.model; the cache starts empty for each call."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), fresh_path(spark, "token-cache"))
