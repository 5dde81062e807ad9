"""Quality rules whose cutoffs limit false rejection.

A rule rejects a document whose figure exceeds its cutoff.  The cutoffs of all rules grow stricter together, in ``STEPS``
steps.  Labelled documents choose the step: per stratum, steps are tried from the most lenient on, each against the
hypothesis that more than ``risk`` of the good documents would be rejected by any rule, with the exact binomial tail as
its p-value; trying stops at the first step that is not significant.  A fixed order needs no correction within a
stratum, and Bonferroni's covers the strata.  So with probability 1 - ``error`` no more than ``risk`` of any
stratum's good documents are rejected.  Strata whose good labels could not certify anything, even without a
rejection, are tested together as one stratum, whose guarantee is that of all of them together.
Everything is DataFrame code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soundlattice.llm.shared import WORD_GAP, materialize, text_or_empty

#: Rule: (figure, most lenient cutoff, strictest cutoff).  Cutoffs between them form a geometric series.
RULES = {
    "symbols": ("n_symbols / word_chars", 0.5, 0.02),
    "dup_lines": ("n_dup_lines / n_lines", 0.9, 0.05),
    "repeats": ("n_repeat_words / n_words", 0.5, 0.02),
    "long_words": ("word_chars / n_words", 60.0, 8.0),
}
STEPS = 20


def cutoffs(lenient: float, strict: float) -> list[float]:
    return [round(lenient * (strict / lenient) ** (i / (STEPS - 1)), 6) for i in range(STEPS)]


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words), a row per row."""
    text = text_or_empty(text_col)
    df = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).cast("string").alias("stratum"), text.alias("t"))
    gap = r"[^\x20\x09-\x0D]"
    df = df.select(
        "id",
        "stratum",
        F.filter(F.split("t", WORD_GAP), lambda w: w != "").alias("words"),
        F.length(F.translate("t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda line: F.regexp_like(line, F.lit(gap))).alias("lines"),
    )
    df = df.select(
        "id",
        "stratum",
        "words",
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    windows = F.expr("CASE WHEN size(hashes) >= 3 THEN transform(sequence(0, size(hashes) - 3), i -> xxhash64(hashes[i], hashes[i + 1], hashes[i + 2])) ELSE CAST(array() AS array<bigint>) END")
    df = df.withColumn("windows", windows)
    # Windows of equal hash are sorted together and compared word by word; most documents have none.
    ordered = F.expr("""CASE WHEN size(array_distinct(windows)) < size(windows)
        THEN array_sort(transform(windows, (h, i) -> struct(h AS h, concat_ws(' ', words[i], words[i + 1], words[i + 2]) AS w, i AS i))) END""")
    df = df.withColumn("ordered", ordered)
    found = F.expr("""array_sort(transform(filter(ordered, (x, k) ->
        coalesce(get(ordered, k - 1).h = x.h AND get(ordered, k - 1).w = x.w, false)
        OR coalesce(get(ordered, k + 1).h = x.h AND get(ordered, k + 1).w = x.w, false)), x -> x.i))""")
    covered = F.expr("""coalesce(aggregate(found, struct(0L AS n, 0L AS upto),
        (a, i) -> struct(a.n + i + 3 - greatest(CAST(i AS bigint), a.upto) AS n, CAST(i AS bigint) + 3L AS upto), a -> a.n), 0L)""")
    df = df.withColumn("found", found).withColumn("n_repeat_words", covered)
    return df.select("id", "stratum", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def figure(rule: str) -> Column:
    """A rule's figure; 0 where its denominator is."""
    above, below = RULES[rule][0].split(" / ")
    return F.when(F.col(below) > 0, F.col(above) / F.col(below)).otherwise(F.lit(0.0))


def _first_exceeded(grid: Column, value: Column) -> Column:
    """The place, from 1, of the first of descending cutoffs that is below the value; past the end if none is."""
    return F.size(F.filter(grid, lambda c: c >= value)) + 1


def _log_gamma(x: str) -> str:
    """ln gamma(x) for x >= 1 by Stirling's series at x + 8; its error is below 1e-13."""
    y = f"({x} + 8)"
    shift = " * ".join(f"({x} + {i})" for i in range(8))
    return f"(({y} - 0.5D) * ln({y}) - {y} + {0.5 * math.log(2 * math.pi)!r}D + 1D / (12 * {y}) - 1D / (360 * pow({y}, 3)) + 1D / (1260 * pow({y}, 5)) - ln({shift}))"


def binomial_tail(n: str, k: str, risk: float) -> str:
    """SQL for P(X <= k) where X counts n trials of chance ``risk``; 1 where k / n >= risk.

    Terms fall at least as fast as those of a normal tail, so beyond 12 deviations below k they are less than a double
    can tell apart; they are bounded by a geometric series all the same.
    """
    terms = f"CAST(12 * sqrt(CAST({n} AS double) * {risk * (1 - risk)!r}D) + 64 AS int)"
    n, k, odds = f"CAST({n} AS double)", f"CAST({k} AS double)", (1 - risk) / risk
    log_top = f"{_log_gamma(f'({n} + 1D)')} - {_log_gamma(f'({k} + 1D)')} - {_log_gamma(f'({n} - {k} + 1D)')} + {k} * {math.log(risk)!r}D + ({n} - {k}) * {math.log1p(-risk)!r}D"
    terms = f"""aggregate(sequence(0, CAST(least({k}, {terms}) AS int)), struct(1D AS term, 0D AS total),
        (a, i) -> struct(a.term * ({k} - i) / ({n} - {k} + i + 1) * {odds!r}D AS term, a.total + a.term AS total),
        a -> a.total + a.term / (1D - {k} / ({n} - {k} + 1) * {odds!r}D))"""
    return f"CASE WHEN {k} >= {n} * {risk!r}D OR {k} * {odds!r}D >= {n} - {k} + 1 THEN 1D ELSE least(1D, exp({log_top}) * {terms}) END"


def first_step() -> Column:
    """The first step, from 1, at which any rule rejects a measured document; past the last if none does."""
    return F.least(*(_first_exceeded(F.array(*map(F.lit, cutoffs(lenient, strict))), figure(rule)) for rule, (_, lenient, strict) in RULES.items()))


def calibrate(measured: DataFrame, labels: DataFrame, id_col: str, label_col: str, risk: float, error: float) -> DataFrame:
    """(stratum, n_good, step): the strictest certified step of each stratum with good labels, 0 where there is none.

    A document with contrary labels counts as good; null labels don't count.
    """
    good = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label")).where("label = 1").select("id")
    counts = measured.join(good, "id").groupBy("stratum", first_step().alias("first")).agg(F.count("*").alias("c"))
    counts = materialize(counts, "quality-counts")  # a row for each stratum and step
    sizes = counts.groupBy("stratum").agg(F.sum("c").alias("n"))
    alone = F.pow(F.lit(1 - risk), F.col("n")) <= error / max(1, sizes.count())
    sizes = sizes.select("stratum", alone.alias("alone"), F.when(alone, F.col("stratum")).alias("tested"))
    grouped = counts.alias("c").join(sizes.alias("s"), F.expr("c.stratum <=> s.stratum")).groupBy("alone", "tested", "first").agg(F.sum("c").alias("c"))
    tests = materialize(grouped.groupBy("alone", "tested").agg(F.sum("c").alias("n_good"), F.collect_list(F.struct("first", "c")).alias("hits")), "quality-tests")
    level = error / max(1, tests.count())
    p = binomial_tail("n_good", "k", risk)
    tried = tests.withColumn("rejected", F.expr(f"transform(sequence(1, {STEPS}), j -> aggregate(filter(hits, x -> x.first <= j), 0L, (a, x) -> a + x.c))"))
    tried = tried.withColumn("failed", F.expr(f"array_position(transform(rejected, k -> {p} <= {level!r}D), false)"))
    tried = tried.withColumn("step", F.expr(f"CASE WHEN failed = 0 THEN {STEPS} ELSE failed - 1 END").cast("int"))
    return sizes.alias("s").join(tried.alias("t"), F.expr("s.alone = t.alone AND s.tested <=> t.tested")).select("s.stratum", "t.n_good", "t.step")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", risk: float = 0.01, error: float = 0.05) -> DataFrame:
    """Verdicts: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept; a row per row.

    Null texts have no words and so fail the base rule.  Null strata form a stratum of their own.  Repeated rows
    are judged each.  Without good labels in their stratum, documents are kept unless they fail the base rule.  Empty
    tables give no rows.  Windows are compared by their words, so no hash collision counts as a repetition.  Texts are
    measured whole; a very long one is an array of its words in one row.  Other columns are ignored.
    """
    measured = materialize(signals(docs, id_col, text_col, stratum_col), "quality-signals")
    chosen = materialize(calibrate(measured, labels, id_col, label_col, risk, error), "quality-steps")
    judged = measured.withColumn("first", first_step()).alias("m").join(chosen.alias("c"), F.expr("m.stratum <=> c.stratum"), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rejected = F.col("first") <= F.coalesce("step", F.lit(0))
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all documents, strata by language, cutoffs from the quality labels."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _op2_sql(risk: float = 0.01, error: float = 0.05) -> str:
    firsts = ", ".join(f"1 + len(list_filter({cutoffs(lenient, strict)!r}::DOUBLE[], lambda c: c >= CASE WHEN {x.split(' / ')[1]} > 0 THEN {x.replace(' / ', '::DOUBLE / ')} ELSE 0 END))" for x, lenient, strict in RULES.values())
    word = r"[^\x20\x09-\x0D]"
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}+') AS ws FROM documents),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w FROM pos),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM win),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) o(k) WHERE c > 1 GROUP BY doc_id),
lin AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM d),
s AS (SELECT d.doc_id, lang, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
      FROM d JOIN lin USING (doc_id) LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, least({firsts}) AS first FROM s),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1),
h AS (SELECT lang, first FROM f JOIN good USING (doc_id)),
n AS (SELECT lang, count(*) AS n FROM h GROUP BY 1),
own AS (SELECT lang, pow(1 - {risk!r}::DOUBLE, n) <= {error!r}::DOUBLE / (SELECT count(*) FROM n) AS alone FROM n),
g AS (SELECT alone, CASE WHEN alone THEN h.lang END AS tested, first FROM h JOIN own ON h.lang IS NOT DISTINCT FROM own.lang),
t AS (SELECT alone, tested, count(*) AS n FROM g GROUP BY 1, 2),
k AS (SELECT t.alone, t.tested, n, j, (SELECT count(*) FROM g WHERE g.alone = t.alone AND g.tested IS NOT DISTINCT FROM t.tested AND first <= j) AS k
      FROM t, range(1, {STEPS + 1}) r(j)),
p AS (SELECT alone, tested, j, k < n * {risk!r}::DOUBLE AND
             (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk!r}) + (n - i) * ln(1 - {risk!r})))
              FROM (SELECT unnest(range(0, k + 1)) AS i)) <= {error!r}::DOUBLE / (SELECT count(*) FROM t) AS ok FROM k),
c AS (SELECT alone, tested, coalesce(min(j) FILTER (WHERE NOT ok) - 1, {STEPS}) AS step FROM p GROUP BY 1, 2),
cut AS (SELECT own.lang, step FROM own JOIN c ON own.alone = c.alone AND c.tested IS NOT DISTINCT FROM CASE WHEN own.alone THEN own.lang END)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND first > coalesce(step, 0) AS kept
FROM f LEFT JOIN cut ON f.lang IS NOT DISTINCT FROM cut.lang
"""


OP2_SQL = _op2_sql()
