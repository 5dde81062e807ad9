"""Registered queries: each applies an operator to whole tables; ``SQL`` states the same for DuckDB."""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundlattice.functions import text as T
from soundlattice.functions import vectors as V
from soundlattice.operators import distances as D
from soundlattice.operators import features, framing, knn, models, pooling, relational
from soundlattice.session import scratch, table
from soundlattice.sources import readers, writers
from soundlattice.streaming import pools

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# Nearest neighbours ---------------------------------------------------------------------------------------------

NUM = {"p_size": 2.0, "p_retailprice": 0.5}
DIM = {"embedding": 5.0}
TRACKS = "t AS (SELECT p_partkey AS id, p_size::DOUBLE AS s, p_retailprice AS p, embedding::DOUBLE[] AS e FROM part JOIN embeddings ON vec_id = p_partkey), q AS (SELECT * FROM t WHERE id % 20 = 0)"
COS_E = "list_cosine_similarity(q.e, c.e)"


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").join(table(spark, sf, "embeddings"), F.col("p_partkey") == F.col("vec_id")).select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_type", "p_size", "p_retailprice", "embedding")


def pairs_query(name: str, value: str, num=None, dim=None, numeric=None, dimensional=None) -> None:
    @query(name, f"WITH {TRACKS} SELECT c.id, q.id AS query_id, round({value}, 6) AS distance FROM t c, q")
    def run(spark, sf):
        t = tracks(spark, sf)
        return knn.cross_score(t, t.where("id % 20 = 0"), "id", num, dim, numeric, dimensional, digits=6)


COS_N = "(q.s * c.s + q.p * c.p) / (sqrt(q.s * q.s + q.p * q.p) * sqrt(c.s * c.s + c.p * c.p))"
EUCLID = "sqrt(2 * (q.s - c.s) ** 2 + 0.5 * (q.p - c.p) ** 2)"
pairs_query("dist_minkowski", "pow(2 * pow(q.s - c.s, 4) + 0.5 * pow(q.p - c.p, 4), 0.25)", num=NUM, numeric=D.minkowski(4))
pairs_query("dist_euclidean", EUCLID, num=NUM, numeric=D.euclidean)
pairs_query("dist_manhattan_signed", "2 * (q.s - c.s) + 0.5 * (q.p - c.p)", num=NUM, numeric=D.manhattan_signed)
pairs_query("dist_manhattan", "2 * abs(q.s - c.s) + 0.5 * abs(q.p - c.p)", num=NUM, numeric=D.manhattan)
pairs_query("dist_cosine_num", f"1 - greatest(-1, least(1, {COS_N}))", num=NUM, numeric=D.cosine_num)
pairs_query("dist_euclidean_dim", "5 * list_distance(q.e, c.e)", dim=DIM, dimensional=D.euclidean_dim)
pairs_query("dist_cosine_dim", f"5 * (1 - greatest(-1, least(1, {COS_E})))", dim=DIM, dimensional=D.cosine_dim)
pairs_query("dist_total", f"{EUCLID} + 5 * (1 - greatest(-1, least(1, {COS_E})))", num=NUM, dim=DIM, numeric=D.euclidean, dimensional=D.cosine_dim)

NEAREST = """
WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0),
p AS (SELECT c.vec_id, list_cosine_similarity(q.e, c.embedding::DOUBLE[]) AS s FROM embeddings c, q),
d AS (SELECT vec_id, min(CASE WHEN s IS NULL OR isnan(s) THEN NULL ELSE 5 * (1 - greatest(-1, least(1, s))) END) AS d FROM p GROUP BY 1)
SELECT vec_id, round(coalesce(d, 'infinity'::DOUBLE), 6) AS distance FROM d"""


def best(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return knn.best_distance(e, e.where("vec_id % 20 = 0"), "vec_id", dim=DIM)


def rounded_best(spark, sf) -> DataFrame:
    return knn.rounded(best(spark, sf), 6)


@query("knn_topk", NEAREST + " ORDER BY round(d, 6) NULLS LAST, vec_id LIMIT 10")
def knn_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    return knn.knn_topk(e, e.where("vec_id % 20 = 0"), "vec_id", 10, dim=DIM, digits=6)


@query("join_cross_score", "SELECT c.vec_id, q.vec_id AS query_id, round(5 * (1 - greatest(-1, least(1, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])))), 6) AS distance FROM embeddings c, embeddings q WHERE q.vec_id % 20 = 0")
def join_cross_score(spark, sf):
    e = table(spark, sf, "embeddings")
    return knn.cross_score(e, e.where("vec_id % 20 = 0"), "vec_id", dim=DIM, digits=6)


QUERIES["join_min_over_queries"], SQL["join_min_over_queries"] = rounded_best, NEAREST


@query("sort_distance", NEAREST + " ORDER BY d NULLS LAST, vec_id")
def sort_distance(spark, sf):
    path = scratch(spark, "distances")
    best(spark, sf).write.parquet(path)  # a range sort reads its input twice
    return knn.rounded(spark.read.parquet(path).orderBy("distance", "vec_id"), 6)


@query("limit_topn", NEAREST + " ORDER BY round(d, 6) NULLS LAST, vec_id LIMIT 20")
def limit_topn(spark, sf):
    return knn.topn(rounded_best(spark, sf), 20, tie="vec_id")


@query("recommend", f"""WITH {TRACKS}, d AS (SELECT c.id, min({EUCLID} + 5 * (1 - greatest(-1, least(1, {COS_E})))) AS d FROM t c, q GROUP BY 1)
SELECT p_brand AS track_artist, p_type AS track_album, p_name AS track_title, 'uri:' || id AS spotify_uri, round(d, 6) AS track_distance FROM d JOIN part ON p_partkey = id ORDER BY round(d, 6), id LIMIT 10""")
def recommend(spark, sf):
    t = tracks(spark, sf).select(F.col("id").alias("filename"), F.col("p_brand").alias("artist"), F.col("p_type").alias("album"), F.col("p_name").alias("title"), F.concat(F.lit("uri:"), "id").alias("uri"), "p_size", "p_retailprice", "embedding")
    return knn.recommend(t, t.where("filename % 20 = 0"), 10, NUM, DIM, digits=6)


@query("proj_result", "SELECT p_brand AS track_artist, p_type AS track_album, p_name AS track_title, 'uri:' || p_partkey AS spotify_uri, p_retailprice AS track_distance FROM part")
def proj_result(spark, sf):
    p = table(spark, sf, "part")
    return knn.as_recommendations(p.select(F.col("p_brand").alias("artist"), F.col("p_type").alias("album"), F.col("p_name").alias("title"), F.concat(F.lit("uri:"), "p_partkey").alias("uri"), F.col("p_retailprice").alias("distance")))


@query("norm_zscore", "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice FROM part")
def norm_zscore(spark, sf):
    (scaled,) = knn.zscore(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return scaled.select("p_partkey", r6(F.col("p_size"), "p_size"), r6(F.col("p_retailprice"), "p_retailprice"))


# Vectors ---------------------------------------------------------------------------------------------------------


def vector_query(name: str, sql: str, build) -> None:
    @query(name, f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, {sql} AS value FROM v")
    def run(spark, sf):
        e = V.doubles("embedding")
        return table(spark, sf, "embeddings").select("vec_id", build(e).alias("value"))


vector_query("vec_norm", "round(sqrt(list_dot_product(e, e)), 6)", lambda e: F.round(V.norm(e), 6))
vector_query("vec_dot", "round(list_dot_product(e, list_reverse(e)), 6)", lambda e: F.round(V.dot(e, F.reverse(e)), 6))
vector_query("vec_clip", "round(greatest(-1, least(1, 10 * e[1])), 6)", lambda e: F.round(V.clip(10 * e[0], -1.0, 1.0), 6))
def placed_sum(a):
    """The sum of an array's elements, each times its place from 1: any element in a wrong place changes it."""
    return F.aggregate(F.transform(a, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)


vector_query("vec_parse", "round(list_sum(list_transform(e, lambda x, i: x * i)), 6)", lambda e: F.round(placed_sum(V.parse(F.to_json(e))), 6))
vector_query("arr_mean", "round(list_avg(e), 6)", lambda e: F.round(V.mean(e), 6))
vector_query("arr_std", "round(list_stddev_pop(e), 6)", lambda e: F.round(V.std(e), 6))
vector_query("arr_max", "round(list_max(e), 6)", lambda e: F.round(F.array_max(e), 6))
vector_query("arr_argsort", "array_to_string(list_transform(list_grade_up(e), lambda x: x - 1), ',')", lambda e: F.array_join(V.argsort(e, equals_as_sql=True).cast("array<string>"), ","))
vector_query("sort_pairs", "array_to_string(list_transform(list_grade_up(e), lambda x: (64 - x)), ',')", lambda e: F.array_join(F.transform(V.sort_pairs(e, F.reverse(F.sequence(F.lit(0), F.lit(63))), equals_as_sql=True), lambda p: p["v"].cast("string")), ","))


@query("vec_expand", "SELECT vec_id, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 6) AS embedding_{i}" for i in range(64)) + " FROM embeddings")
def vec_expand(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", *V.expand("embedding", 64))
    return e.select("vec_id", *(r6(F.col(c), c) for c in e.columns[1:]))


# Pooling ---------------------------------------------------------------------------------------------------------

LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate"


@query("agg_pool_segments", f"SELECT l_orderkey, first(l_returnflag ORDER BY {LINE_ORDER}) AS l_returnflag, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS v0, round(avg(l_extendedprice), 6) AS v1 FROM lineitem GROUP BY 1")
def agg_pool_segments(spark, sf):
    df = table(spark, sf, "lineitem").withColumns({"v": F.array("l_tax", "l_extendedprice"), "ord": F.struct(*LINE_ORDER.split(", "))})
    out = pooling.pool_segments(df, "l_orderkey", "ord", ("l_quantity", "l_discount"), {"v": 2}, ("l_returnflag",))
    return out.select("l_orderkey", "l_returnflag", r6(F.col("l_quantity"), "l_quantity"), r6(F.col("l_discount"), "l_discount"), r6(F.col("v")[0], "v0"), r6(F.col("v")[1], "v1"))


@query("agg_pool_dataframe", f"SELECT l_partkey, first(nullif(l_returnflag, 'N') ORDER BY {LINE_ORDER}) FILTER (WHERE l_returnflag <> 'N') AS flag, round(avg(l_quantity) FILTER (WHERE l_quantity <= 45), 6) AS quantity, round(avg(l_tax), 6) AS v0 FROM lineitem GROUP BY 1")
def agg_pool_dataframe(spark, sf):
    df = table(spark, sf, "lineitem").select("l_partkey", F.nullif("l_returnflag", F.lit("N")).alias("flag"), F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).otherwise(float("nan")).alias("quantity"), F.array("l_tax").alias("v"), *LINE_ORDER.split(", ")[:1], *LINE_ORDER.split(", ")[2:])
    out = pooling.pool_dataframe(df, ["quantity"], {"v": 1}, LINE_ORDER.replace("l_partkey, ", "").split(", "), "l_partkey")
    return out.select("l_partkey", "flag", r6(F.col("quantity"), "quantity"), r6(F.col("v")[0], "v0"))


ELEMENTS = "SELECT label, i - 1 AS i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)"


@query("agg_vec_mean", f"SELECT label, i, round(avg(x), 6) AS mean FROM ({ELEMENTS}) GROUP BY 1, 2")
def agg_vec_mean(spark, sf):
    out = pooling.vector_mean(table(spark, sf, "embeddings"), "label", "embedding", 64)
    return out.select("label", F.posexplode("embedding").alias("i", "m")).select("label", F.col("i").cast("long").alias("i"), r6(F.col("m"), "mean"))


@query("agg_vec_stats", f"SELECT label, i, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(max(x), 6) AS max FROM ({ELEMENTS}) GROUP BY 1, 2")
def agg_vec_stats(spark, sf):
    out = pooling.vector_stats(table(spark, sf, "embeddings"), "label", "embedding", 64)
    z = out.select("label", F.posexplode(F.arrays_zip("embedding_mean", "embedding_std", "embedding_max")).alias("i", "z"))
    return z.select("label", F.col("i").cast("long").alias("i"), r6(F.col("z.embedding_mean"), "mean"), r6(F.col("z.embedding_std"), "std"), r6(F.col("z.embedding_max"), "max"))


@query("agg_mean_std_max", "SELECT event_type, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std, round(max(value), 6) AS value_max FROM events GROUP BY 1")
def agg_mean_std_max(spark, sf):
    out = table(spark, sf, "events").groupBy("event_type").agg(*pooling.mean_std_max("value", "value"))
    return out.select("event_type", *(r6(F.col(c), c) for c in out.columns[1:]))


@query("agg_nanmean_nanstd", "SELECT event_type, round(avg(value) FILTER (WHERE value >= 10), 6) AS value_mean, round(stddev_pop(value) FILTER (WHERE value >= 10), 6) AS value_std FROM events GROUP BY 1")
def agg_nanmean_nanstd(spark, sf):
    e = table(spark, sf, "events").withColumn("value", F.when(F.col("value") >= 10, F.col("value")).otherwise(float("nan")))
    out = e.groupBy("event_type").agg(*pooling.nanmean_nanstd("value", "value"))
    return out.select("event_type", *(r6(F.col(c), c) for c in out.columns[1:]))


@query("agg_topk_mode", "WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS o FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, o) AS r FROM c) SELECT user_id, string_agg(event_type, ',' ORDER BY r) AS modes FROM r WHERE r <= 5 GROUP BY 1")
def agg_topk_mode(spark, sf):
    return pooling.top_modes(table(spark, sf, "events"), "user_id", "event_type", "event_id").select("user_id", F.array_join("modes", ",").alias("modes"))


POSITIVE = "SELECT label, list_filter(embedding::DOUBLE[], lambda x: x > 0) AS l FROM embeddings"


@query("agg_flat_mean", f"SELECT label, round(sum(list_sum(l)) / sum(len(l)), 6) AS flat_mean, round(avg(len(l)), 6) AS mean_count FROM ({POSITIVE}) GROUP BY 1")
def agg_flat_mean(spark, sf):
    df = table(spark, sf, "embeddings").select("label", F.filter(V.doubles("embedding"), lambda x: x > 0).alias("l"))
    return pooling.flat_mean(df, "label", "l").select("label", r6(F.col("flat_mean"), "flat_mean"), r6(F.col("mean_count"), "mean_count"))


HISTOGRAM = f"WITH s AS (SELECT label, i, sum(abs(x)) AS s FROM ({ELEMENTS}) GROUP BY 1, 2), h AS (SELECT label, i, s / sum(s) OVER (PARTITION BY label) AS h FROM s)"


@query("agg_norm_hist", f"{HISTOGRAM} SELECT label, i::INTEGER AS i, round(h, 9) AS h FROM h")
def agg_norm_hist(spark, sf):
    df = table(spark, sf, "embeddings").select("label", F.transform(V.doubles("embedding"), F.abs).alias("v"))
    return pooling.normalized_histogram(df, "label", "v", 64).select("label", F.posexplode("hist").alias("i", "h")).select("label", "i", F.round("h", 9).alias("h"))


@query("agg_max_avg_flat", f"SELECT label, round(max(x), 6) AS peak, round(avg(x), 6) AS mean FROM ({ELEMENTS}) GROUP BY 1")
def agg_max_avg_flat(spark, sf):
    return pooling.max_mean_flat(table(spark, sf, "embeddings"), "label", "embedding").select("label", r6(F.col("peak"), "peak"), r6(F.col("mean"), "mean"))


@query("agg_min", "SELECT user_id, min(value) FILTER (WHERE value >= 10) AS best FROM events GROUP BY 1")
def agg_min(spark, sf):
    e = table(spark, sf, "events").withColumn("value", F.when(F.col("value") >= 10, F.col("value")).otherwise(float("nan")))
    return e.groupBy("user_id").agg(F.min(pooling.no_nan("value")).alias("best"))


# Names, fields, dates, lists ---------------------------------------------------------------------------------------

NAME_SQL = r"""regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(
regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(strip_accents(replace(lower({0}), '℮', 'e')), '$', '_'), '\(.*?\)', '', 'g'), '\[.*?\]', '', 'g'),
'([A-Za-z])\.([A-Za-z])', '\1_\2', 'g'), '([A-Za-z])\.([A-Za-z])', '\1_\2', 'g'), '.', ' '), '&', 'and'), '[^\p{{L}}\p{{N}}_\s\-–]', '', 'g'),
'\s*([-–])\s*', '\1', 'g'), '\s+', ' ', 'g')), ' ', '-', 'g')"""


@query("str_process_name", f"SELECT doc_id, {NAME_SQL.format('text')} AS name FROM documents")
def str_process_name(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.process_name("text").alias("name"))


@query("str_strip_accents", "SELECT doc_id, strip_accents(lower(text)) AS name FROM documents")
def str_strip_accents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.strip_accents("text").alias("name"))


FIELD_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, '\([^)\n]*\)', '', 'g'), '(?i)\b(?:feat|ft)\b[^\n]*', '', 'g'), '\s+', ' ', 'g'))"


@query("str_process_field", f"SELECT doc_id, {FIELD_SQL.format('text')} AS a, {FIELD_SQL.format('''text || ' (live) FEAT. x' || chr(10) || 'b' ''')} AS b FROM documents")
def str_process_field(spark, sf):
    marked = F.concat("text", F.lit(" (live) FEAT. x\nb"))
    return table(spark, sf, "documents").select("doc_id", T.process_field(F.col("text")).alias("a"), T.process_field(marked).alias("b"))


@query("str_album_artist", "SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN c_mktsegment END, ''), c_name) AS artist FROM customer")
def str_album_artist(spark, sf):
    k = F.col("c_custkey") % 3
    return table(spark, sf, "customer").select("c_custkey", T.album_artist(F.col("c_name"), F.when(k == 0, "").when(k == 1, F.col("c_mktsegment"))).alias("artist"))


@query("str_clean_keys", f"WITH m AS (SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END, ''), p_brand) AS artist, nullif(p_name, '') AS title, CASE WHEN p_size % 7 > 0 THEN p_type END AS album FROM part) SELECT p_partkey, {NAME_SQL.format('title')} AS clean_title, {NAME_SQL.format('artist')} AS clean_artist, {NAME_SQL.format('album')} AS clean_album FROM m WHERE artist IS NOT NULL AND title IS NOT NULL AND album IS NOT NULL")
def str_clean_keys(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("artist"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_type")).alias("album_artist"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 7 > 0, F.col("p_type")).alias("album"))
    return relational.clean_metadata(p)[0].select("p_partkey", "clean_title", "clean_artist", "clean_album")


@query("date_extract_year", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y') END AS year FROM orders")
def date_extract_year(spark, sf):
    k, d = F.col("o_orderkey") % 4, "o_orderdate"
    text = F.when(k == 0, F.date_format(d, "yyyy")).when(k == 1, F.date_format(d, "yyyy-MM-dd")).when(k == 2, F.date_format(d, "dd-MM-yyyy")).otherwise(F.date_format(d, "yyyy/MM"))
    return table(spark, sf, "orders").select("o_orderkey", T.extract_year(text).alias("year"))


@query("json_load_list", "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN event_type || ',x' ELSE '' END AS items FROM events")
def json_load_list(spark, sf):
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.col("props")).when(k == 1, F.to_json(F.array("event_type", F.lit("x")))).otherwise("not json")
    return table(spark, sf, "events").select("event_id", F.array_join(T.load_list(text), ",").alias("items"))


@query("json_dump_list", "SELECT p_partkey, to_json(string_split(p_type, ' '))::VARCHAR AS items FROM part")
def json_dump_list(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.to_json(F.split("p_type", " ")).alias("items"))


@query("pred_is_missing", "SELECT event_id, event_id % 6 < 4 AS missing FROM events")
def pred_is_missing(spark, sf):
    cases = F.array(*map(F.lit, ["[]", '[" ", "\\t"]', "{}", "bad", "[null]", '["", "a"]']))
    return table(spark, sf, "events").select("event_id", T.is_missing(T.load_list(F.get(cases, (F.col("event_id") % 6).cast("int")))).alias("missing"))


@query("str_split_tags", "SELECT p_partkey, lower(replace(p_type, ' ', '|')) AS tags FROM part")
def str_split_tags(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(T.split_tags(F.replace("p_type", F.lit(" "), F.lit("\t, "))), "|").alias("tags"))


@query("str_release_url", "SELECT p_partkey, 'https://example.org/release/' || k || '/' || lower(p_brand) || '/' || replace(lower(p_type), ' ', '-') || '/' AS url FROM part, (VALUES ('album'), ('ep'), ('mixtape'), ('comp')) v(k)")
def str_release_url(spark, sf):
    urls = T.release_urls("https://example.org", F.lower("p_brand"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("-")))
    return table(spark, sf, "part").select("p_partkey", F.explode(urls).alias("url"))


@query("str_basename", "SELECT page_id, string_split(url, '/')[-1] AS name FROM pages")
def str_basename(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.basename(F.col("url")).alias("name"))


@query("math_bpm_norm", "SELECT event_id, round(value / 208, 6) AS bpm FROM events")
def math_bpm_norm(spark, sf):
    return table(spark, sf, "events").select("event_id", r6(T.bpm_norm(F.col("value")), "bpm"))


@query("math_floor_len", "SELECT o_orderkey, floor(o_totalprice)::BIGINT AS length FROM orders")
def math_floor_len(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.floor_len(F.col("o_totalprice")).alias("length"))


# Filters and projections ----------------------------------------------------------------------------------------------


@query("filter_mask", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def filter_mask(spark, sf):
    return table(spark, sf, "orders").where("o_totalprice > 100000 AND o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("filter_not_none", "SELECT event_id FROM events WHERE value >= 10")
def filter_not_none(spark, sf):
    return table(spark, sf, "events").select("event_id", F.when(F.col("value") >= 10, F.col("value")).alias("v")).where(F.col("v").isNotNull()).select("event_id")


@query("filter_ext", "SELECT p_partkey FROM part WHERE p_partkey % 5 IN (0, 1, 4)")
def filter_ext(spark, sf):
    ends = F.array(*map(F.lit, [".mp3", ".FLAC", ".wav", "mp3", ".a.Mp3"]))
    p = table(spark, sf, "part").withColumn("file", F.concat("p_name", F.get(ends, (F.col("p_partkey") % 5).cast("int"))))
    return p.where(T.allowed_file(F.col("file"))).select("p_partkey")


@query("filter_empty_peaks", "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.3)) > 0")
def filter_empty_peaks(spark, sf):
    return table(spark, sf, "embeddings").where(F.size(F.filter(V.doubles("embedding"), lambda x: x > 0.3)) > 0).select("vec_id")


@query("proj_columns", "SELECT c_name, c_mktsegment FROM customer")
def proj_columns(spark, sf):
    return table(spark, sf, "customer").select("c_name", "c_mktsegment")


@query("proj_rename", "SELECT c_name AS clean_artist, c_mktsegment AS clean_album FROM customer")
def proj_rename(spark, sf):
    return table(spark, sf, "customer").select("c_name", "c_mktsegment").withColumnsRenamed({"c_name": "clean_artist", "c_mktsegment": "clean_album"})


@query("meta_vs_feature_cols", "SELECT p_name, p_brand, p_type FROM part")
def meta_vs_feature_cols(spark, sf):
    p = table(spark, sf, "part")
    return p.select(*pooling.metadata_columns(p, ["p_size", "p_retailprice"], [], "p_partkey"))


# Joins and sets ------------------------------------------------------------------------------------------------------


@query("join_anti_exclude", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'R' AND b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey)")
def join_anti_exclude(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    return relational.exclude(l.select("l_orderkey", "l_partkey", "l_suppkey"), l.where("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"])


LATEST = "SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders"


@query("join_lookup_enrich", f"SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN ({LATEST}) ON o_custkey = c_custkey AND r = 1")
def join_lookup_enrich(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return relational.lookup(table(spark, sf, "customer").select("c_custkey"), orders, ["c_custkey"], [F.desc("o_orderdate"), "o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query("src_catalog_search", f"SELECT c_custkey, 'uri:' || o_orderkey AS uri, o_orderpriority AS sp_name, o_totalprice AS popularity FROM customer LEFT JOIN ({LATEST}) ON o_custkey = c_custkey AND r = 1")
def src_catalog_search(spark, sf):
    catalogue = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", F.concat(F.lit("uri:"), "o_orderkey").alias("uri"), F.col("o_orderpriority").alias("sp_name"), F.col("o_totalprice").alias("popularity"))
    return readers.catalogue_search(table(spark, sf, "customer").select("c_custkey"), catalogue, ["c_custkey"], [F.desc("o_orderdate"), "o_orderkey"])


@query("set_union_all", "SELECT r_regionkey AS k, r_name AS name, NULL::INTEGER AS region FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def set_union_all(spark, sf):
    a = table(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k"))
    b = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return relational.union_by_name(a, b)


@query("set_union_keys", "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'")
def set_union_keys(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    return relational.union_keys(*(l.where(F.col("l_returnflag") == f).select("l_partkey", "l_suppkey") for f in "RA"))


@query("set_distinct_on", "SELECT o_custkey, o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def set_distinct_on(spark, sf):
    return relational.distinct_on(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderstatus", "o_orderkey")


@query("set_flatten", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part")
def set_flatten(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.explode(F.split("p_type", " ")).alias("word"))


@query("crawl_worklist", """WITH a AS (SELECT DISTINCT c_name AS clean_artist, c_mktsegment AS clean_album FROM customer), o AS (SELECT c_name, c_mktsegment, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM o WHERE c_name = clean_artist AND c_mktsegment = clean_album) UNION ALL SELECT c_name, c_mktsegment FROM o WHERE o_orderkey % 3 = 0""")
def crawl_worklist(spark, sf):
    c = table(spark, sf, "customer")
    done = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    lists = F.when(F.col("o_orderkey") % 3 == 0, "[]").otherwise('["a"]')
    progress = done.select(F.col("c_name").alias("artist"), F.col("c_mktsegment").alias("album"), lists.alias("pri_genres"), F.lit('["b"]').alias("sec_genres"), F.lit('["c"]').alias("pri_desc"))
    albums = c.select(F.col("c_name").alias("clean_artist"), F.col("c_mktsegment").alias("clean_album"), "c_custkey")
    return relational.worklist(albums, progress, progress.select("artist", "album").where("false"), ["c_custkey"])


# Sources and sinks ---------------------------------------------------------------------------------------------------

PART = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


@query("src_csv", "SELECT * FROM part")
def src_csv(spark, sf):
    path = scratch(spark, "csv")
    writers.write_csv(table(spark, sf, "part"), path)
    return readers.track_table(spark, path, PART)


@query("src_csv_multi", "SELECT n_nationkey AS k, n_name AS name, NULL AS extra FROM nation UNION ALL SELECT r_regionkey, r_name, 'r' FROM region")
def src_csv_multi(spark, sf):
    a, b = scratch(spark, "csv"), scratch(spark, "csv")
    writers.write_csv(table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), a)
    writers.write_csv(table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"), F.lit("r").alias("extra")), b)
    return readers.track_tables(spark, [a, b], ["k int, name string", "k int, name string, extra string"])


@query("src_csv_optional", "SELECT c_name AS artist, c_mktsegment AS album FROM customer")
def src_csv_optional(spark, sf):
    path = scratch(spark, "log")
    missing = readers.optional_table(spark, path, readers.FAILURES)
    writers.append_log(table(spark, sf, "customer").select(F.col("c_name").alias("artist"), F.col("c_mktsegment").alias("album")), path)
    return missing.unionByName(readers.optional_table(spark, path, readers.FAILURES))


TAGS = {"artist": "c_name", "title": "c_mktsegment", "album": "c_mktsegment"}


def tagged(spark, sf) -> DataFrame:
    """Customers as files: even keys with FLAC tags, odd ones with ID3 frames, every fifth with another suffix."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    flac = F.create_map(F.lit("artists"), "c_name", F.lit("song_name"), F.concat("c_mktsegment", F.lit(" (live) ft. x")), F.lit("album"), F.col("c_mktsegment"), F.lit("date"), F.lit("2001-02-03"), F.lit("seconds"), F.col("c_acctbal").cast("string"))
    mp3 = F.create_map(F.lit("TPE1"), "c_name", F.lit("TIT2"), F.col("c_mktsegment"), F.lit("TALB"), F.col("c_mktsegment"), F.lit("TPE2"), F.lit("main"), F.lit("TDRC"), F.lit("1999"))
    suffix = F.when(k % 5 == 0, ".ogg").when(k % 2 == 0, ".FLAC").otherwise(".mp3")
    return c.select("c_custkey", F.concat(F.lit("/a.b/"), k.cast("string"), suffix).alias("path"), F.when(k % 2 == 0, flac).otherwise(mp3).alias("tags"))


@query("src_flac_meta", "SELECT c_custkey, c_name AS artist, c_mktsegment AS title, c_mktsegment AS album, NULL AS album_artist, '2001' AS release_year, floor(c_acctbal)::INTEGER AS length FROM customer WHERE c_custkey % 2 = 0")
def src_flac_meta(spark, sf):
    return tagged(spark, sf).where("c_custkey % 2 = 0").select("c_custkey", *readers.flac_tags(F.col("tags")))


@query("src_mp3_meta", "SELECT c_custkey, c_name AS artist, c_mktsegment AS title, c_mktsegment AS album, 'main' AS album_artist, '1999' AS release_year, NULL::INTEGER AS length FROM customer WHERE c_custkey % 2 = 1")
def src_mp3_meta(spark, sf):
    return tagged(spark, sf).where("c_custkey % 2 = 1").select("c_custkey", *readers.mp3_tags(F.col("tags")))


@query("src_meta_dispatch", "SELECT '/a.b/' || c_custkey || CASE WHEN c_custkey % 5 = 0 THEN '.ogg' WHEN c_custkey % 2 = 0 THEN '.FLAC' ELSE '.mp3' END AS path, CASE WHEN c_custkey % 5 > 0 THEN c_name END AS artist, CASE WHEN c_custkey % 5 > 0 AND c_custkey % 2 = 0 THEN floor(c_acctbal)::INTEGER END AS length FROM customer")
def src_meta_dispatch(spark, sf):
    return readers.metadata(tagged(spark, sf)).select("path", "artist", "length")


def touch(spark, folder: str, names: list[str]) -> None:
    """Files of one byte, by the file system that the folder names."""
    jvm = spark._jvm
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(0)
        out.close()


@query("src_dir_list", "SELECT name, 1::BIGINT AS length FROM (VALUES ('a.flac'), ('b.mp3')) v(name)")
def src_dir_list(spark, sf):
    folder = scratch(spark, "audio")
    touch(spark, folder, ["a.flac", "b.mp3", "c.MP3", "d.txt", "below/e.mp3"])
    return readers.audio_files(spark, folder).select(T.basename(F.col("path")).alias("name"), "length")


@query("src_upload", "SELECT 'x.Mp3' AS name, 1::BIGINT AS length")
def src_upload(spark, sf):
    folder = scratch(spark, "upload")
    touch(spark, folder, ["x.Mp3"])
    return readers.upload(spark, f"{folder}/x.Mp3").select(T.basename(F.col("path")).alias("name"), "length")


@query("src_audio_window", "SELECT s AS segment_start, 160000 AS n, round(s / 32.0, 4) AS level FROM (VALUES (0), (2), (4)) v(s)")
def src_audio_window(spark, sf):
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as f:  # 14 seconds, two channels, the level of a second is its number
        f.setnchannels(2), f.setsampwidth(2), f.setframerate(44_100)
        f.writeframes(np.repeat(np.arange(14), 44_100 * 2).astype("<i2").__mul__(1024).tobytes())
    files = spark.createDataFrame([("x.wav", bytearray(buffer.getvalue()), s) for s in (0, 2, 4)], "path string, content binary, segment_start int")
    return readers.audio_windows(files).select("segment_start", F.size("signal").alias("n"), F.round(F.col("signal")[0].cast("double"), 4).alias("level"))


@query("src_html_spans", r"SELECT page_id, array_to_string(regexp_extract_all(html, '(?s)<li(?:\s[^>]*)?>(.*?)</li>', 1), '|') AS items, regexp_extract(html, '(?s)<title(?:\s[^>]*)?>(.*?)</title>', 1) AS title FROM pages")
def src_html_spans(spark, sf):
    titled = readers.page_tags(table(spark, sf, "pages"), "html", "title").withColumnRenamed("texts", "titles")
    return readers.page_tags(titled, "html", "li").select("page_id", F.array_join("texts", "|").alias("items"), F.coalesce(F.get("titles", F.lit(0)), F.lit("")).alias("title"))


@query("sink_csv", "SELECT p_partkey, '[\"' || replace(p_type, ' ', '\",\"') || '\"]' AS words FROM part")
def sink_csv(spark, sf):
    path = scratch(spark, "csv")
    writers.write_csv(table(spark, sf, "part").select("p_partkey", F.split("p_type", " ").alias("words")), path)
    return readers.track_table(spark, path, "p_partkey bigint, words string")


@query("sink_pooled_csv", f"SELECT label, i::INTEGER AS i, round(avg(x), 6) AS mean FROM ({ELEMENTS}) GROUP BY 1, 2")
def sink_pooled_csv(spark, sf):
    path = scratch(spark, "csv")
    writers.write_csv(pooling.vector_mean(table(spark, sf, "embeddings"), "label", "embedding"), path)
    return readers.track_table(spark, path, "label int, embedding string", ("embedding",)).select("label", F.posexplode("embedding").alias("i", "mean")).select("label", "i", r6(F.col("mean"), "mean"))


@query("sink_append_log", "SELECT r_name AS artist, 'x' AS album FROM region UNION ALL SELECT n_name, 'y' FROM nation")
def sink_append_log(spark, sf):
    path = scratch(spark, "log")
    writers.append_log(table(spark, sf, "region").select(F.col("r_name").alias("artist"), F.lit("x").alias("album")), path)
    writers.append_log(table(spark, sf, "nation").select(F.col("n_name").alias("artist"), F.lit("y").alias("album")), path)
    return readers.optional_table(spark, path, readers.FAILURES)


@query("sink_json", """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS value FROM nation""")
def sink_json(spark, sf):
    return writers.as_json(table(spark, sf, "nation").select("n_nationkey", "n_name"))


@query("sink_playlist", "WITH r AS (SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 100 AS b FROM part) SELECT b::BIGINT AS batch, count(*) AS n, min(p_partkey) AS first, max(p_partkey) AS last FROM r GROUP BY 1")
def sink_playlist(spark, sf):
    out = writers.playlist_batches(table(spark, sf, "part"), "p_partkey", "p_partkey")
    return out.select("batch", F.size("items").cast("long").alias("n"), F.element_at("items", 1).alias("first"), F.element_at("items", -1).alias("last"))


@query("sink_frame", "SELECT p_partkey, p_name, p_retailprice AS p_size FROM part")
def sink_frame(spark, sf):
    p = table(spark, sf, "part").select(F.struct("p_partkey", "p_name", "p_size").alias("metadata"), F.struct(F.col("p_retailprice").alias("p_size")).alias("features"))
    return writers.track_frame(p)


# Framing, segments, signal features --------------------------------------------------------------------------------------


def frame_query(name: str, frame: int, hop: int, exclusive: bool) -> None:
    last = 64 - frame - (1 if exclusive else 0)

    @query(name, f"SELECT vec_id, s::INTEGER AS start, {frame} AS n, round(list_sum(list_transform(embedding[s + 1:s + {frame}]::DOUBLE[], lambda x, i: x * i)), 6) AS placed FROM embeddings, range(0, {last + 1}, {hop}) r(s)")
    def run(spark, sf):
        e = table(spark, sf, "embeddings")
        both = F.arrays_zip(framing.starts(F.size("embedding"), frame, hop, exclusive).alias("s"), framing.frames(F.col("embedding"), frame, hop, exclusive).alias("f"))
        return e.select("vec_id", F.explode(both).alias("z")).select("vec_id", F.col("z.s").alias("start"), F.size("z.f").alias("n"), r6(placed_sum(V.doubles("z.f")), "placed"))


frame_query("frame_exclusive", 16, 16, True)
frame_query("frame_inclusive", 16, 16, False)
frame_query("frame_overlap50", 32, 16, False)
frame_query("filter_incomplete_frame", 24, 16, False)

SEGMENTS = """WITH t AS (SELECT o_orderkey AS k, floor(o_totalprice / 500)::INTEGER AS n FROM orders), s AS (SELECT k, n, unnest(range(0, n, 60)) AS sec FROM t)
SELECT k, (sec // 60)::INTEGER AS segment_num, (sec + (k * 31 + sec // 60 * 17) % (least(sec + 50, n - 10) - sec + 1))::INTEGER AS segment_start FROM s WHERE n - sec >= 10"""


def segments(spark, sf) -> DataFrame:
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 500).alias("length"))
    pick = lambda k, s, width: F.pmod(k * 31 + s * 17, width.cast("bigint"))
    return framing.minute_segments(t, "k", "length", pick=pick)


@query("seg_minute_sample", SEGMENTS)
def seg_minute_sample(spark, sf):
    return segments(spark, sf).select("k", "segment_num", "segment_start")


@query("filter_short_segment", f"SELECT k, count(*) AS n FROM ({SEGMENTS}) GROUP BY 1")
def filter_short_segment(spark, sf):
    return segments(spark, sf).groupBy("k").agg(F.count("*").alias("n"))


BINS = 16 // 2 + 1
SPECTRUM = f"""WITH x AS (SELECT vec_id, f, n, embedding[f * 16 + n + 1]::DOUBLE * (0.5 - 0.5 * cos(2 * pi() * n / 15)) AS x FROM embeddings, range(0, 3) a(f), range(0, 16) b(n)),
m AS (SELECT vec_id, f, k, sqrt(sum(x * cos(2 * pi() * k * n / 16)) ** 2 + sum(x * sin(2 * pi() * k * n / 16)) ** 2) AS m FROM x, range(0, {BINS}) c(k) GROUP BY 1, 2, 3)"""


def per_frame(value: str, prefix: str, with_max: bool = False, source: str = "m") -> str:
    most = f", round(max(v), 6) AS {prefix}_max" if with_max else ""
    return f"{SPECTRUM}, v AS (SELECT vec_id, f, {value} AS v FROM {source} GROUP BY 1, 2) SELECT vec_id, round(avg(v), 6) AS {prefix}_mean, round(stddev_pop(v), 6) AS {prefix}_std{most} FROM v GROUP BY 1"


def feature_query(name: str, feature: str, sql: str | None = None) -> None:
    @query(name, sql)
    def run(spark, sf):
        out = features.extract(table(spark, sf, "embeddings"), "vec_id", "embedding", (feature,), frame=16)
        rounded = {f.name: F.round(f.name, 6) for f in out.schema if f.dataType.typeName() == "double"}
        joined = {f.name: F.array_join(F.transform(f.name, lambda x: F.round(x, 6).cast("string") if "double" in f.dataType.simpleString() else x), ",") for f in out.schema if f.dataType.typeName() == "array"}
        return out.withColumns(rounded | joined)


feature_query("dsp_energy", "energy", "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) / 64, 6) AS avg_energy FROM embeddings")
feature_query("dsp_centroid", "centroid", per_frame("sum(k * 2756.25 * m) / sum(m)", "spectral_centroid", True))
feature_query("dsp_hfc", "hfc", per_frame("sum(k * m * m)", "hfc"))
feature_query("dsp_flatness", "flatness", per_frame("10 * log10(exp(avg(ln(greatest(m, 1e-12)))) / avg(greatest(m, 1e-12)))", "flatness_db"))
feature_query("dsp_rolloff", "rolloff", per_frame("count(*) FILTER (WHERE c < 0.85 * t) * 2756.25", "rolloff", True, "(SELECT *, sum(m * m) OVER (PARTITION BY vec_id, f ORDER BY k) AS c, sum(m * m) OVER (PARTITION BY vec_id, f) AS t FROM m)"))
feature_query("dsp_flux", "flux", per_frame("sqrt(sum(d * d))", "flux", False, "(SELECT *, m - coalesce(lag(m) OVER (PARTITION BY vec_id, k ORDER BY f), 0) AS d FROM m)"))
_BAND_SQL = ", ".join(f"round(avg({b}), 6) AS {b}_mean, round(stddev_pop({b}), 6) AS {b}_std" for b in features.S.BANDS)
_SHARE_SQL = ", ".join(f"coalesce(sum(m * m) FILTER (WHERE k * 2756.25 >= {lo} AND k * 2756.25 < {hi}), 0) / sum(m * m) AS {b}" for b, (lo, hi) in features.S.BANDS.items())
feature_query("dsp_energy_ratio", "energy_ratio", f"{SPECTRUM}, v AS (SELECT vec_id, f, {_SHARE_SQL} FROM m GROUP BY 1, 2) SELECT vec_id, {_BAND_SQL} FROM v GROUP BY 1")
for _name in ("bpm", "loudness", "tonal"):
    feature_query(f"dsp_{_name}", _name)


def magnitudes(size: int, frames: int, window: str) -> str:
    """The CTE m (vec_id, f, k, fr, m): spectra of frames of ``size`` every 16 samples, fr in Hz."""
    return f"""x AS (SELECT vec_id, f, n, embedding[f * 16 + n + 1]::DOUBLE * ({window}) AS x FROM embeddings, range(0, {frames}) a(f), range(0, {size}) b(n)),
m AS (SELECT vec_id, f, k, k * 44100.0::DOUBLE / {size} AS fr, sqrt(sum(x * cos(2 * pi() * k * n / {size})) ** 2 + sum(x * sin(2 * pi() * k * n / {size})) ** 2) AS m FROM x, range(0, {size // 2 + 1}) c(k) GROUP BY 1, 2, 3)"""


def hann_sql(size: int) -> str:
    return f"0.5 - 0.5 * cos(2 * pi() * n / {size - 1})"


_BH = "0.35875 - 0.48829 * cos(2 * pi() * n / 15) + 0.14128 * cos(4 * pi() * n / 15) - 0.01168 * cos(6 * pi() * n / 15)"
feature_query("dsp_peaks", "peaks", f"""WITH {magnitudes(16, 4, _BH)}, p AS (SELECT *, k BETWEEN 1 AND 7 AND m > 1e-9 AND m > lag(m) OVER w AND m >= lead(m) OVER w AS peak FROM m WINDOW w AS (PARTITION BY vec_id, f ORDER BY k))
SELECT vec_id, round(avg(fr) FILTER (WHERE peak), 6) AS spectral_peaks_avg_freq, round(avg(m) FILTER (WHERE peak), 6) AS spectral_peaks_avg_mag, round(count(*) FILTER (WHERE peak) / 4.0::DOUBLE, 6) AS spectral_peaks_count FROM p GROUP BY 1""")


def long_query(name: str, feature: str, sql: str) -> None:
    """A query of a feature with lists as rows (vec_id, name, i, value)."""

    @query(name, sql)
    def run(spark, sf):
        out = features.extract(table(spark, sf, "embeddings"), "vec_id", "embedding", (feature,), frame=16)
        lists = [F.struct(F.lit(c).alias("name"), F.col(c).alias("values")) for c in out.columns if c != "vec_id"]
        each = out.select("vec_id", F.explode(F.array(*lists)).alias("z")).select("vec_id", "z.name", F.posexplode("z.values").alias("i", "value"))
        return each.select("vec_id", "name", "i", r6(F.col("value"), "value"))


def bands_sql(edge: str) -> str:
    """The CTEs b (vec_id, f, i, v), 40 triangular bands between the edges given by i, and c, 13 cepstral coefficients."""
    return f"""e AS (SELECT i, {edge} AS hz FROM range(0, 42) r(i)),
t AS (SELECT a.i, a.hz AS lo, b.hz AS mid, c.hz AS hi FROM e a JOIN e b ON b.i = a.i + 1 JOIN e c ON c.i = a.i + 2),
b AS (SELECT vec_id, f, i, sum(m * m * greatest(0, least((fr - lo) / (mid - lo), (hi - fr) / (hi - mid)))) AS v FROM m, t GROUP BY 1, 2, 3),
c AS (SELECT vec_id, f, j AS i, sum(ln(greatest(v, 1e-10)) * cos(pi() * j * (b.i + 0.5) / 40)) AS v FROM b, range(0, 13) r(j) GROUP BY 1, 2, 3)"""


def list_stats(*parts: tuple[str, str, str]) -> str:
    """Rows (vec_id, name, i, value) from (CTE, name, aggregate)."""
    return " UNION ALL ".join(f"SELECT vec_id, '{name}' AS name, i::INTEGER AS i, round({how}(v), 6) AS value FROM {cte} GROUP BY 1, 2, 3" for cte, name, how in parts)


_MEL = "700 * (pow(10, i * 2595 * log10(1 + 22050.0::DOUBLE / 700) / 41 / 2595) - 1)"
_ERB = "(pow(10, i * 21.4 * log10(1 + 0.00437 * 22050.0::DOUBLE) / 41 / 21.4) - 1) / 0.00437"
long_query("dsp_mfcc", "mfcc", f"WITH {magnitudes(32, 3, hann_sql(32))}, {bands_sql(_MEL)} " + list_stats(("c", "mfcc_mean", "avg"), ("c", "mfcc_std", "stddev_pop"), ("b", "band_mean", "avg"), ("b", "band_std", "stddev_pop")))
long_query("dsp_gfcc", "gfcc", f"WITH {magnitudes(16, 3, hann_sql(16))}, {bands_sql(_ERB)} " + list_stats(("b", "erb_bands_mean", "avg"), ("b", "erb_bands_std", "stddev_pop"), ("c", "gfcc_mean", "avg"), ("c", "gfcc_peak", "max")))
long_query("dsp_contrast", "contrast", f"""WITH {magnitudes(16, 3, hann_sql(16))}, g AS (SELECT vec_id, f, i, 10 * log10(greatest(max(m), 1e-10)) AS top, 10 * log10(greatest(min(m), 1e-10)) AS low
FROM m JOIN (VALUES (0, 1, 2), (1, 2, 3), (2, 3, 4), (3, 4, 6), (4, 6, 9)) o(i, a, b) ON k >= a AND k < b GROUP BY 1, 2, 3), b AS (SELECT vec_id, f, i, top - low AS v FROM g), c AS (SELECT vec_id, f, i, low AS v FROM g) """
+ list_stats(("b", "spectral_contrast_mean", "avg"), ("b", "spectral_contrast_std", "stddev_pop"), ("c", "spectral_valley_mean", "avg"), ("c", "spectral_valley_std", "stddev_pop")))


@query("dsp_window_spectrum", f"{SPECTRUM} SELECT vec_id, f, k, round(m, 6) AS m FROM m")
def dsp_window_spectrum(spark, sf):
    own = {"spectrum": (lambda x, rate, frame: {"magnitudes": features._spectra(x, frame).ravel().tolist()}, "magnitudes array<double>")}
    out = features.extract(table(spark, sf, "embeddings"), "vec_id", "embedding", (), frame=16, extra=own)
    flat = out.select("vec_id", F.posexplode("magnitudes").alias("i", "m"))
    return flat.select("vec_id", F.floor(F.col("i") / BINS).alias("f"), (F.col("i") % BINS).cast("long").alias("k"), r6(F.col("m"), "m"))


@query("dsp_resample_mono", """WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS e, j, floor(j * 2.75625::DOUBLE)::INTEGER AS k, j * 2.75625::DOUBLE - floor(j * 2.75625::DOUBLE) AS part FROM embeddings, range(0, 23) r(j))
SELECT vec_id, j::INTEGER AS j, round((e[k + 1] + (e[k + 2] - e[k + 1]) * part)::FLOAT::DOUBLE, 6) AS x FROM t""")
def dsp_resample_mono(spark, sf):
    own = {"resample": (lambda x, rate, frame: {"signal": features.S.resample(features.S.mono(x)).astype(float).tolist()}, "signal array<double>")}
    out = features.extract(table(spark, sf, "embeddings"), "vec_id", "embedding", (), extra=own)
    return out.select("vec_id", F.posexplode("signal").alias("j", "x")).select("vec_id", "j", r6(F.col("x"), "x"))


@query("dsp_pitch", f"{HISTOGRAM}, t AS (SELECT label, 440 * pow(2, embedding[1]::DOUBLE) AS f FROM embeddings), p AS (SELECT label, avg(f) AS m, var_pop(f) AS v FROM t GROUP BY 1) SELECT h.label, i::INTEGER AS i, round(h, 9) AS pitch_hist, round(m, 6) AS pitch_mean, round(v, 6) AS pitch_var FROM h JOIN p ON p.label = h.label")
def dsp_pitch(spark, sf):
    """Each row is a frame: its activations, and a frequency made from the first of them."""
    frames = table(spark, sf, "embeddings").select("label", F.transform(V.doubles("embedding"), F.abs).alias("v"), (440 * F.pow(F.lit(2.0), F.col("embedding")[0].cast("double"))).alias("f"))
    found = pooling.pitch_features(frames, "label", "f", "v", 64)
    return found.select("label", F.posexplode("pitch_hist").alias("i", "h"), "pitch_mean", "pitch_var").select("label", "i", F.round("h", 9).alias("pitch_hist"), r6(F.col("pitch_mean"), "pitch_mean"), r6(F.col("pitch_var"), "pitch_var"))


# Models ----------------------------------------------------------------------------------------------------------------

ROWS = "r AS (SELECT vec_id, r, j, sum(embedding[r * 8 + i + 1]::DOUBLE * cos((i + 0.5) * j * pi() / 8)) AS e FROM embeddings, range(0, 8) a(r), range(0, 8) b(i), range(0, 8) c(j) GROUP BY 1, 2, 3)"


@query("ml_embed", f"WITH {ROWS} SELECT vec_id, j::BIGINT AS j, round(avg(e), 6) AS e FROM r GROUP BY 1, 2")
def ml_embed(spark, sf):
    out = models.infer(table(spark, sf, "embeddings"), "vec_id", "embedding", ())
    return out.select("vec_id", F.posexplode("discogs_effnet_embeddings").alias("j", "e")).select("vec_id", F.col("j").cast("long").alias("j"), r6(F.col("e"), "e"))


@query("ml_classify", f"""WITH {ROWS}, z AS (SELECT vec_id, r, k, exp(sum(e * ((j + 2 * k) % 5 - 2) / 4.0)) AS z FROM r, range(0, 2) d(k) GROUP BY 1, 2, 3),
p AS (SELECT vec_id, r, k, z / sum(z) OVER (PARTITION BY vec_id, r) AS p FROM z)
SELECT vec_id, round(avg(p) FILTER (WHERE k = 0), 6) AS danceable_effnet, round(avg(p) FILTER (WHERE k = 1), 6) AS party_effnet FROM p GROUP BY 1""")
def ml_classify(spark, sf):
    out = models.infer(table(spark, sf, "embeddings"), "vec_id", "embedding", ("danceability", "party"))
    return out.select("vec_id", r6(F.col("danceable_effnet"), "danceable_effnet"), r6(F.col("party_effnet"), "party_effnet"))


def registry(spark) -> DataFrame:
    return spark.createDataFrame([(m.name, list(m.classes), m.target, m.family, m.feature) for m in models.REGISTRY.values()], "name string, classes array<string>, target int, family string, feature string")


# The heads once more, as the SQL states them: name, classes, target, family.
HEADS = """VALUES ('approachability_2c', 'not_approachable,approachable', 1, 'effnet'), ('approachability_3c', 'not_approachable,moderately_approachable,approachable', 0, 'effnet'),
('approachability_regression', 'approachability', 0, 'effnet'), ('engagement_2c', 'not_engaging,engaging', 1, 'effnet'), ('engagement_3c', 'not_engaging,moderately_engaging,engaging', 0, 'effnet'),
('engagement_regression', 'engagement', 0, 'effnet'), ('danceability', 'danceable,not_danceable', 0, 'effnet'), ('aggressive', 'aggressive,non_aggressive', 0, 'effnet'), ('happy', 'happy,non_happy', 0, 'effnet'),
('party', 'non_party,party', 1, 'effnet'), ('relaxed', 'non_relaxed,relaxed', 1, 'effnet'), ('sad', 'non_sad,sad', 1, 'effnet'), ('acoustic', 'acoustic,non_acoustic', 0, 'effnet'),
('electronic', 'electronic,non_electronic', 0, 'effnet'), ('instrumental', 'instrumental,voice', 0, 'effnet'), ('gender', 'female,male', 0, 'effnet'), ('tonal', 'tonal,atonal', 0, 'effnet'),
('timbre', 'bright,dark', 0, 'effnet'), ('nsynth_timbre', 'bright,dark', 0, 'nsynth_effnet'), ('musicnn_danceability', 'danceable,not_danceable', 0, 'MusiCNN'), ('musicnn_instrumental', 'instrumental,voice', 0, 'MusiCNN'),
('musicnn_happy', 'happy,non_happy', 0, 'MusiCNN'), ('musicnn_aggressive', 'aggressive,not_aggressive', 0, 'MusiCNN')"""
STAGES = ("bpm", "energy", "loudness", "mfcc", "centroid", "rolloff", "contrast", "hfc", "flux", "flatness", "energy_ratio", "peaks", "gfcc", "tonal")


@query("ml_registry", f"SELECT * FROM ({HEADS}) h(name, classes, target, family)")
def ml_registry(spark, sf):
    return registry(spark).select("name", F.array_join("classes", ",").alias("classes"), "target", "family")


@query("ml_feature_name", f"SELECT name, split_part(classes, ',', target + 1) || '_' || family AS feature FROM ({HEADS}) h(name, classes, target, family)")
def ml_feature_name(spark, sf):
    return registry(spark).select("name", "feature")


@query("ml_task_dispatch", f"SELECT name AS task, 'model' AS kind FROM ({HEADS}) h(name, classes, target, family) UNION ALL SELECT unnest({list(STAGES)!r}), 'algorithm'")
def ml_task_dispatch(spark, sf):
    """Each registered head and feature function with the kind of stage that runs it."""
    tasks = [(n, models.stage_kind(n)) for n in models.REGISTRY] + [(n, models.stage_kind(f)) for n, (f, _) in features.FEATURES.items()]
    return spark.createDataFrame(tasks, "task string, kind string")


@query("cfg_conflict", "SELECT e AS expand, n AS normalize, e AND n AS refused FROM (VALUES (false), (true)) a(e), (VALUES (false), (true)) b(n)")
def cfg_conflict(spark, sf):
    rows = []
    for expand in (False, True):
        for normalize in (False, True):
            try:
                knn.check_config(expand, normalize)
                rows.append((expand, normalize, False))
            except ValueError:
                rows.append((expand, normalize, True))
    return spark.createDataFrame(rows, "expand boolean, normalize boolean, refused boolean")


# Streams ---------------------------------------------------------------------------------------------------------------

DAYS = "SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2"


@query("batch_pool_windows", DAYS)
def batch_pool_windows(spark, sf):
    out = pools.pool_windows(table(spark, sf, "events"))
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", r6(F.col("mean"), "mean"))


@query("stream_pool_windows", DAYS)
def stream_pool_windows(spark, sf):
    """The stream read to its end, in update mode: the last row of each window counts."""
    events = table(spark, sf, "events")
    path = scratch(spark, "stream")
    source = spark.readStream.schema(events.schema).parquet(f"{sf.rstrip('/')}/[e]vents.parquet")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("number", F.lit(number)).write.mode("append").parquet(path)

    run = pools.pool_windows(source).writeStream.outputMode("update").option("checkpointLocation", scratch(spark, "state")).foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()
    last = relational.distinct_on(spark.read.parquet(path), ["event_type", "start"], [-F.col("number")])
    return last.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", r6(F.col("mean"), "mean"))


@query("stream_append_log", "SELECT event_id, event_type FROM events")
def stream_append_log(spark, sf):
    events = table(spark, sf, "events")
    path, state = scratch(spark, "log"), scratch(spark, "state")
    source = spark.readStream.schema(events.schema).parquet(f"{sf.rstrip('/')}/[e]vents.parquet").select("event_id", "event_type")
    for _ in range(2):  # the second run finds nothing new
        pools.append_stream(source, path, state).awaitTermination()
    return spark.read.parquet(path)


assert math.isclose(44_100 / 16, 2756.25)  # a bin of the SQL above
