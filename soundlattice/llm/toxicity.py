"""Toxicity by a weighted grammar of finite-state transducers over clauses.

Words are read as classes: insult, threat, target, negation, reported speech, or other.  Five small transducers
read the classes of a clause side by side: their composition is one machine whose states are tuples of theirs and
whose arcs multiply their weights.  An insult weighs more once a target was named, less within the reach of a
negation or of reported speech; a threat arms its machine, and a target within its reach has the output.
Only clauses that hold an insult or a threat are read.  A document's figures (sum and largest clause weight, how many
clauses matched, their share) enter a logistic curve.

Insults are a fixed seed list and units learned from labels: words and word beginnings whose presence separates
the toxic from the other training documents by a likelihood ratio; their weight is their log odds.  A beginning is a unit
only if the documents beside those of its best word are toxic ones too, so that it says more than that word.  Units
beyond what is broadcast meet the documents' units in a join.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soundlattice.llm.shared import chosen, materialize, text_or_empty, whole_row

# General words of each class, in English, German, Spanish and French.
INSULTS = ["bastard", "clown", "creep", "disgusting", "dumb", "fool", "garbage", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "pig", "scum", "stupid", "trash", "ugly", "vermin", "worthless"]
THREATS = ["beat", "burn", "crush", "destroy", "hurt", "kill", "murder", "punch", "shoot", "stab", "strangle", "schlage", "töte", "verbrenne", "vernichte", "aplastaré", "mataré", "quemaré", "brûlerai", "frapperai", "tuerai"]
TARGETS = ["he", "her", "him", "she", "them", "they", "you", "your", "yours", "yourself", "dich", "dir", "du", "euch", "ihn", "ihr", "sie", "él", "ella", "ellos", "te", "ti", "tú", "usted", "elle", "eux", "il", "ils", "toi", "tu", "vous"]
NEGATIONS = ["isn't", "never", "no", "not", "wasn't", "without", "kein", "keine", "nicht", "nie", "ohne", "jamás", "nunca", "sin", "jamais", "ne", "non", "pas", "sans"]
REPORTS = ["alleged", "called", "claimed", "quoted", "reported", "said", "says", "wrote", "behauptet", "nannte", "sagt", "sagte", "schrieb", "dice", "dijo", "escribió", "llamó", "appelé", "déclaré", "disait", "écrit"]
#: Weight of a threat that meets its target.
THREAT = 3.0

#: Units sent to the executors at most, those in the most toxic documents first; the others stay a distributed table.
BROADCAST_UNITS = 16_384
#: Bits of the filter that tells which words may be in that table.
FILTER_BITS = 1 << 26
#: Least log likelihood ratio of a learned unit against the base rate.
MIN_RATIO = 10.0
#: Least share of toxic documents among those of a unit, and least number of them.
MIN_RATE, MIN_DOCUMENTS = 0.7, 3
#: Beginnings of words that may be units, in characters.
STEMS = (4, 5, 6)
#: Labelled rows that fit the logistic curve, about, chosen by hash.
FIT_ROWS = 20_000
FIGURES = ("total", "largest", "matched", "share")

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
CLAUSE_END = re.compile(r"[.!?;:\n]")


class Machine:
    """A transducer: ``step(state, class) -> (state, weight)`` over a finite set of states, the first is initial."""

    def __init__(self, states, step):
        self.states, self.step = list(states), step

    def __mul__(self, other: Machine) -> Machine:
        """Both machines read the same classes; weights multiply."""

        def step(state, kind):
            (a, x), (b, y) = self.step(state[0], kind), other.step(state[1], kind)
            return (a, b), x * y

        return Machine(product(self.states, other.states), step)

    def table(self, classes: str) -> dict:
        """All transitions, so that reading a clause is one lookup for each word."""
        number = {s: i for i, s in enumerate(self.states)}
        out = {}
        for s in self.states:
            for c in classes:
                to, weight = self.step(s, c)
                out[number[s], c] = (number[to], weight)
        return out


def grammar(reach: int = 3) -> dict:
    """The composed transducer.  Classes: I insult, T threat, Y target, N negation, R report, O other.

    A word's output is the product of all weights: that of an insult, and that of a target while a threat is armed.
    A threat within a negation's reach carries the negation on to its target.
    """
    base = Machine([0], lambda s, c: (0, {"I": 1.0, "Y": 0.5}.get(c, 0.0)))
    target = Machine([0, 1], lambda s, c: (1 if c == "Y" else s, 1.5 if s and c == "I" else 1.0))
    threat = Machine(range(reach + 1), lambda s, c: (reach if c == "T" else 0 if c == "Y" else max(0, s - 1), float(s > 0) if c == "Y" else 1.0))
    negation = Machine(range(reach + 1), lambda s, c: (reach if c == "N" or (s and c == "T") else max(0, s - 1), 0.3 if s and c in "IY" else 1.0))
    report = Machine([0, 1], lambda s, c: (int(s or c == "R"), 0.5 if s and c in "IY" else 1.0))
    return (base * target * threat * negation * report).table("ITYNRO")


def clause_weight(kinds: list[tuple[str, float]], table: dict) -> float:
    """The weight of a clause given as (class, weight of the word)."""
    state, total = 0, 0.0
    for kind, weight in kinds:
        state, factor = table[state, kind]
        total += factor * weight
    return total


#: Marks of a tree's nodes where a word or a beginning of words ends.
WHOLE, BEGINNING = r"(?![^\W\d_])", ""


def branches(tree: dict) -> str:
    """The expression of a tree of characters; what goes on after a beginning adds nothing."""
    if BEGINNING in tree:
        return ""
    parts = [c if c == WHOLE else re.escape(c) + branches(rest) for c, rest in sorted(tree.items())]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


class Scorer:
    """Reads documents with a lexicon of units: words as they are, beginnings of words after a caret."""

    def __init__(self, units: dict[str, float]):
        self.words = {w: 3.0 for w in INSULTS} | {u: x for u, x in units.items() if u[0] != "^"}
        self.stems = {u[1:]: x for u, x in units.items() if u[0] == "^"}
        self.kinds = {w: "T" for w in THREATS} | {w: "Y" for w in TARGETS} | {w: "N" for w in NEGATIONS} | {w: "R" for w in REPORTS}
        self.table = grammar()
        tree: dict = {}
        for w, end in [*((w, WHOLE) for w in [*self.words, *THREATS]), *((s, BEGINNING) for s in self.stems)]:
            at = tree
            for c in w:
                at = at.setdefault(c, {})
            at[end] = {}
        self.hit = re.compile(rf"(?<![^\W\d_]){branches(tree)}")

    def read(self, word: str, rare: dict[str, float] | None = None) -> tuple[str, float]:
        weight = self.words.get(word, 0.0)
        for n in STEMS:
            weight = max(weight, self.stems.get(word[:n], 0.0))
        if rare:
            weight = max(weight, *(rare.get(u, 0.0) for u in units_of_word(word)))
        if weight:
            return "I", weight
        kind = self.kinds.get(word, "O")
        return kind, THREAT if kind == "Y" else 0.0

    def first(self, text: str, at: int, rare: dict[str, float] | None) -> re.Match | None:
        """The first insult or threat from ``at`` on."""
        if not rare:
            return self.hit.search(text, at)
        return next((m for m in WORD.finditer(text, at) if self.read(m[0], rare)[0] in "IT"), None)

    def figures(self, text: str, rare: dict[str, float] | None = None) -> tuple[float, float, float, float]:
        """FIGURES of a text; ``rare`` holds those of its units that are in no lexicon."""
        text = text.lower()
        weights, at = [], 0
        while found := self.first(text, at, rare):
            begin = max(text.rfind(c, at, found.start()) for c in ".!?;:\n") + 1
            begin = begin or at
            end = CLAUSE_END.search(text, found.end())
            at = end.start() if end else len(text)
            weight = clause_weight([self.read(w, rare) for w in WORD.findall(text, begin, at)], self.table)
            if weight > 0:
                weights.append(weight)
        if not weights:
            return 0.0, 0.0, 0.0, 0.0
        clauses = 1 + sum(map(text.count, ".!?;:\n"))
        return math.log1p(sum(weights)), math.log1p(max(weights)), math.log1p(len(weights)), math.sqrt(len(weights) / clauses)


def units_of_word(word: str) -> list[str]:
    return [word, *(f"^{word[:n]}" for n in STEMS if len(word) >= n)]


def units_of(text: str) -> set[str]:
    return {u for w in set(WORD.findall(text.lower())) for u in units_of_word(w)}


def _training(column: Column) -> Column:
    """Rows to learn from: crc32 of the id as text, modulo 3, is not 1.  A null id counts as an empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % 3 != 1


def learn_units(labelled: DataFrame) -> tuple[dict[str, float], DataFrame | None]:
    """Units and weights from (text, label) rows; counts cover all rows.

    All units that pass the tests are kept, but beginnings that say nothing beyond their best word, and those that
    say nothing beyond a shorter beginning of at least their weight.  The first BROADCAST_UNITS come as a dictionary,
    the others, if any, as a table (unit, weight).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def flush():
            names = list(held)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([held[u][0] for u in names], pa.int64()), pa.array([held[u][1] for u in names], pa.int64())], ["unit", "toxic", "clean"])

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                side = 0 if label == 1 else 1
                for unit in units_of(text):
                    if unit in held:
                        held[unit][side] += 1
                    else:
                        held[unit] = [1 - side, side]
                if len(held) > 1_000_000:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    sizes = labelled.agg(F.coalesce(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)), F.lit(0)).alias("toxic"), F.count("*").alias("all")).first()
    if not 0 < sizes["toxic"] < sizes["all"]:
        return {}, None
    base = sizes["toxic"] / sizes["all"]
    counts = labelled.select("text", "label").mapInArrow(count, "unit string, toxic bigint, clean bigint").groupBy("unit").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where(F.col("t") >= MIN_DOCUMENTS)
    counts = materialize(counts, "toxic-counts")
    prior = math.log(base / (1 - base))

    def rate(t: str, c: str) -> Column:
        return (F.col(t) + 0.5) / (F.col(t) + F.col(c) + 1)

    plain = F.expr("CASE WHEN unit LIKE '^%' THEN substring(unit, 2) ELSE unit END")
    beginnings = F.filter(F.array(*(F.when(F.length("unit") >= n, F.concat(F.lit("^"), F.substring("unit", 1, n))) for n in STEMS)), lambda u: u.isNotNull())
    ratio = F.col("t") * F.log(F.col("rate") / base) + F.col("c") * F.log((1 - F.col("rate")) / (1 - base))
    passed = counts.withColumn("rate", rate("t", "c")).where((ratio >= MIN_RATIO) & (F.col("rate") >= MIN_RATE))
    passed = passed.select("unit", "t", "c", F.least(F.lit(6.0), F.log(F.col("rate") / (1 - F.col("rate"))) - prior).alias("weight"))
    words = counts.where("unit NOT LIKE '^%'").select("t", "c", F.explode(beginnings).alias("unit"))
    best = words.groupBy("unit").agg(F.max(F.struct("t", "c")).alias("best"))  # a word that occurs in fewer documents takes less away
    wider = passed.where("unit LIKE '^%'").join(best.hint("merge"), "unit", "left")
    wider = wider.withColumns({"t1": F.col("t") - F.coalesce("best.t", F.lit(0)), "c1": F.greatest(F.lit(0), F.col("c") - F.coalesce("best.c", F.lit(0)))})
    wider = wider.where((F.col("t1") >= MIN_DOCUMENTS) & (rate("t1", "c1") >= MIN_RATE))
    passed = passed.where("unit NOT LIKE '^%'").select("unit", "t", "weight").unionByName(wider.select("unit", "t", "weight"))
    passed = materialize(passed, "toxic-units")
    size = F.length(plain) - F.col("unit").startswith("^").cast("int")  # a beginning is no shorter one of itself
    shorter = F.filter(F.array(*(F.when(size >= n, F.concat(F.lit("^"), F.substring(plain, 1, n))) for n in STEMS)), lambda u: u.isNotNull())
    stems = passed.where("unit LIKE '^%'").select(F.col("unit").alias("stem"), F.col("weight").alias("of"))
    seeds = F.col("unit").isin(INSULTS)  # a learned weight replaces the fixed one
    covered = passed.where(~seeds).select("unit", "weight", F.explode(shorter).alias("stem")).join(stems.hint("merge"), "stem").where("of >= weight").select("unit").distinct()
    kept = materialize(passed.join(covered.hint("merge"), "unit", "left_anti"), "toxic-kept")
    top = kept.where(~seeds).orderBy(F.desc("t"), "unit").limit(BROADCAST_UNITS).collect()
    units = {r["unit"]: r["weight"] for r in [*kept.where(seeds).collect(), *top]}
    if len(top) < BROADCAST_UNITS:
        return units, None
    last = top[-1]
    rare = kept.where(~seeds & ((F.col("t") < last["t"]) | ((F.col("t") == last["t"]) & (F.col("unit") > last["unit"])))).select("unit", "weight")
    return units, None if rare.isEmpty() else rare


def _bit(unit: str) -> int:
    return zlib.crc32(unit.encode()) % FILTER_BITS


def rare_units(docs: DataFrame, text_col: str, rare: DataFrame) -> DataFrame:
    """(key, rare) of the texts that hold units of the table ``rare`` (unit, weight); the key is the text's SHA-256.

    Only units whose bit is set in a filter of FILTER_BITS leave the text's task, distinct ones of each text.
    """
    spark = docs.sparkSession
    width = FILTER_BITS // 4096  # the filter comes in pieces of bounded size
    slot = F.crc32(F.col("unit").cast("binary")) % FILTER_BITS
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rare.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / width).alias("piece")).agg(F.collect_set((F.col("slot") % width).cast("int")).alias("at")).toLocalIterator():
        at = np.array(r["at"], np.int64) + r["piece"] * width
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    held = spark.sparkContext.broadcast(bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            keys, units = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(WORD.findall(text.lower()))
                found = [u for u in {u for w in words for u in units_of_word(w)} if bits[(at := _bit(u)) >> 3] >> (at & 7) & 1]
                keys += [key] * len(found)
                units += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(units, pa.string())], ["key", "unit"])

    texts = docs.select(F.sha2(text_or_empty(text_col).cast("binary"), 256).alias("key"), text_or_empty(text_col).alias("text"))
    pairs = texts.mapInArrow(run, "key string, unit string").distinct().join(rare.hint("merge"), "unit")
    return pairs.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("unit", "weight"))).alias("rare"))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights, the constant first, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
    return w


#: Used where labels can't fit a curve: the constant, then a weight for each of FIGURES.
DEFAULT_CURVE = (-3.0, 1.0, 1.0, 1.0, 1.0)


def read_figures(docs: DataFrame, id_col: str, text_col: str, units, with_row: bool = False, rare: DataFrame | None = None) -> DataFrame:
    """(id, FIGURES) of each document, and the input row if asked for; ``units`` is a broadcast lexicon.

    ``rare`` holds (key, rare) as of ``rare_units``.
    """
    rows = docs.select(F.col(id_col).alias("id"), *whole_row(docs, with_row), text_or_empty(text_col).alias("text"))
    names = rows.columns[:-1]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:-1]), *(f"{f} double" for f in FIGURES)])
    if rare is None:
        rows = rows.withColumn("rare", F.lit(None).cast("map<string,double>"))
    else:
        rows = rows.withColumn("key", F.sha2(F.col("text").cast("binary"), 256)).join(rare.hint("merge"), "key", "left").select(*names, "text", "rare")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(units.value)
        for batch in batches:
            *_, texts, rare = batch.columns
            read = [scorer.figures(t, dict(u) if u else None) for t, u in zip(texts.to_pylist(), rare.to_pylist(), strict=True)]
            found = np.array(read, dtype=np.float64).reshape(-1, len(FIGURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *(pa.array(found[:, i]) for i in range(len(FIGURES)))], [*names, *FIGURES])

    return rows.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", with_row: bool = False) -> DataFrame:
    """A row per input row: id, held_out, score in [0, 1], predicted (1 from 0.7 on).  Documents are scored in one reading.

    ``with_row`` adds the input row as the struct ``row``.  Labels are learned from training rows only; scores come
    from the text alone.  Null and empty texts, and those without a matching clause, get the curve's constant.
    Null labels are ignored, contrary ones count as toxic.  Without labels of both kinds the seed lists and a fixed
    curve serve.  Repeated rows are scored each; empty tables give no rows.  Texts of any length are read whole.  Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    marks = labels.where(F.col(label_col).isNotNull() & _training(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    labelled = docs.where(_training(F.col(id_col))).select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(marks.hint("merge"), "id")  # one plan at every size: labels grow with the documents
    frequent, others = learn_units(labelled)
    units = spark.sparkContext.broadcast(frequent)  # BROADCAST_UNITS entries at most
    rare = None if others is None else materialize(rare_units(docs, text_col, others), "toxic-rare")
    some = materialize(marks.where(chosen(FIT_ROWS, marks.count(), "id")).limit(2 * FIT_ROWS), "toxic-sample")
    sample = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(some), "id").select("label", "text")
    fit = read_figures(sample, "label", "text", units, rare=rare).limit(2 * FIT_ROWS).toPandas()  # 2 * FIT_ROWS rows at most, there and back
    if 0 < (fit["id"] == 1).sum() < len(fit):
        curve = fit_logistic(fit[list(FIGURES)].to_numpy(), (fit["id"] == 1).to_numpy(dtype=float)).tolist()
    else:
        curve = DEFAULT_CURVE
    read = read_figures(docs, id_col, text_col, units, with_row, rare)
    line = F.lit(float(curve[0]))
    for w, f in zip(curve[1:], FIGURES, strict=True):
        line = line + float(w) * F.col(f)
    score = 1 / (1 + F.exp(-line))
    return read.select(F.col("id").alias(id_col), (~_training(F.col("id"))).alias("held_out"), score.alias("score"), (score >= 0.7).cast("int").alias("predicted"), *(["row"] if with_row else []))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
