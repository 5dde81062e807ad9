"""The pipeline's stages against brute-force versions, each on its own input."""

import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from soundlattice.llm import mixing, packing, queries, toxicity
from soundlattice.llm.shared import materialize, written

from .test_operators import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.where("doc_id < 6").withColumn("doc_id", F.col("doc_id") + 5000)
    odd = spark.createDataFrame([(7000, None, None, None, None), (7001, "", "en", "src1", 0), (7001, "", "en", "src1", 0), (7002, "long words " * 30_000, "en", "src1", 0)], docs.schema)
    docs = docs.unionByName(extra).unionByName(odd)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, before, SF), name)
        if name != "packing":
            assert out.columns == list(COLUMNS)
        given = before.collect()
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.score_toxicity(before, labels).where("predicted = 1").collect()}
            want = [r for r in given if r["doc_id"] not in bad]
        elif name == "exact_dedup":
            best = {}
            for r in given:
                best[r["text"] or ""] = max(best.get(r["text"] or "", r), r, key=lambda x: x["doc_id"])
            want = list(best.values())
        elif name == "simhash_near_dedup":
            prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in given}
            least = {}
            for i, f in prints.items():
                least[f] = min(least.get(f, i), i)
            component = plain_components(list(least), least)
            want = [r for r in given if component[prints[r["doc_id"]]] == r["doc_id"]]
        elif name == "mixing":
            copies = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect()}
            want = [r for r in given for _ in range(copies[r["doc_id"]])]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            pieces = Counter()
            for r in given:
                ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
                for s, n in packing.cuts(len(ids), 2048):
                    pieces[r["doc_id"], s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())] += 1
            assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in out.collect()) == pieces
            break
        assert rows(out) == sorted((tuple(r[c] for c in COLUMNS) for r in want), key=repr)
        before = out


def test_empty_table_passes_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_odd_rows_pass_all_stages(spark):
    """Null ids, extra columns with names that operators use, ties and repeated rows."""
    prose = " ".join(f"w{i}" for i in range(80))
    rows = [(None, prose, "en", "a", 1, 5, "x"), (None, prose, "en", "a", 1, 5, "x"), (None, None, None, None, None, None, None), (3, "other " * 60, "de", None, 2, 6, "y"), (3, "other " * 60, "de", None, 2, 6, "y"), (4, prose + " end", "en", "a", 1, 7, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int, bucket string")
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF), name)
        if name != "packing":
            assert out.columns == docs.columns
        if name == "exact_dedup":
            assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter({(None, prose): 1, (None, None): 1, (3, "other " * 60): 1, (4, prose + " end"): 1})
        docs = out
    assert docs.count() > 0


def test_run_leaves_no_intermediate_tables(spark):
    with written() as made:
        out = corpus_pipeline.run(spark, SF)
        rows = out.count()
    left = [p for p in made if Path(p.removeprefix("file:")).exists()]
    assert rows > 0 and {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in left} <= {"pipeline-mixing", "pack-pieces", "pack-sequences"}


def test_registered():
    names = set(__spark_entry__.queries())
    assert {*queries.QUERIES, "pipeline"} <= names and set(queries.SQL) <= set(__spark_entry__.oracle_sql())
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_copies_are_written_along_the_schedule(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    placed = {r["doc_id"]: r["positions"] for r in mixing.mix(docs).collect() if r["copies"]}
    want = [i for _, i, _ in sorted((p, i, k) for i, places in placed.items() for k, p in enumerate(places))]
    assert max(map(len, placed.values())) > 1
    assert [r["doc_id"] for r in corpus_pipeline.mixing(spark, docs, SF).collect()] == want
