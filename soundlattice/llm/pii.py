"""Personal data by bootstrapped contextual extraction.

Base patterns give seed entities.  Other tokens of the shape of a kind, such as a number of 12 digits or more without
a valid checksum, are candidates of that kind, and so are runs of digits written with spaces.  Other tokens with a digit are
of no kind, and speak against the patterns around them.  The lexical patterns of an instance are the words around it: the
two before, the one before, the one before with the one after, or the key of key=value and key:value.

Spark scores the graph of patterns and instances in rounds: a pattern is as good for a kind as the mean belief that what
stands in it is of that kind, over all its instances of any kind or none, shrunk by a prior; an instance is believed by the
best of its patterns; seeds are believed fully.  So a word that stands before anything is good for nothing, and a word that
stands before telephone numbers only is good wherever it stands.  Candidates in a pattern of high confidence are new
spans of their kind, and raise the patterns that they stand in elsewhere.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundlattice.llm.shared import materialize, text_or_empty

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The lookbehind only spares starts within a run of digits, where the run's first digit has failed already.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
SIGN = re.compile(r"[0-9@]")
#: Digits with the separators that base cards and phones allow.
RUN = re.compile(r"(?<![\w@.-])[+(]{0,2}[0-9](?:[\x20().-]*[0-9])+(?![\w@])")
GROUPED_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
SHAPES = (("email", re.compile(r"[^@]+@[^@]+")), ("ip", re.compile(r"[0-9]+(?:[.:][0-9A-Fa-f]+){3,}")), ("card", re.compile(r"(?:[0-9]-?){12,}")), ("phone", re.compile(r"\+?(?:[0-9][().-]*){7,}")))
GAPS = " \t\n\x0b\f\r"
EDGE = ".,;:!?()[]{}\"'"
#: What may stand right before a value, also after a key's sign, and what ends a key on its left.
OPENING = "([{\"'"
KEY_END = GAPS + "&;,?|"
#: Characters of a context word in a pattern: those nearest to the instance, so that no text is walked twice.
CONTEXT_CHARS = 32


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches: each starts where the run of local characters before its @ does."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at)):
            found.append((begin, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all kinds, by start, then kind; code points, end exclusive."""
    out = [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _near(word: str) -> str:
    word = word.strip(EDGE).lower()
    return "#" if SIGN.search(word) else word  # another identifier tells nothing of its own


def _word_before(text: str, at: int) -> tuple[str, int]:
    """The word before ``at``, its nearest characters at most, and where it starts; -1 if it goes on to the left."""
    end = at
    while end and text[end - 1] in GAPS:
        end -= 1
    begin, floor = end, max(0, end - CONTEXT_CHARS)
    while begin > floor and text[begin - 1] not in GAPS:
        begin -= 1
    return text[begin:end], -1 if begin and text[begin - 1] not in GAPS else begin


def _word_after(text: str, at: int) -> str:
    size = len(text)
    while at < size and text[at] in GAPS:
        at += 1
    end, top = at, min(size, at + CONTEXT_CHARS)
    while end < top and text[end] not in GAPS:
        end += 1
    return text[at:end]


def _key_before(text: str, at: int) -> str | None:
    """The key of a value that starts at ``at``, if = or : stands there; a key has no digits."""
    while at and text[at - 1] in OPENING:
        at -= 1
    if not at or text[at - 1] not in "=:":
        return None
    begin = end = at - 1
    floor = max(0, end - CONTEXT_CHARS)
    while begin > floor and text[begin - 1] not in KEY_END:
        begin -= 1
        if text[begin] in "0123456789@":
            return None
    return _near(text[begin:end]) or None


def patterns(text: str, begin: int, end: int) -> list[str]:
    """The lexical patterns around text[begin:end], of seeds, candidates and others alike."""
    key = _key_before(text, begin)
    if key is not None:
        return [f"{key} = _"]
    while begin and text[begin - 1] in OPENING:
        begin -= 1
    one, at = _word_before(text, begin)
    two = "" if at < 0 else _near(_word_before(text, at)[0])
    after, one = _near(_word_after(text, end)), _near(one)
    return [f"{two} {one} _", f"{one} _ {after}", *([f"{one} _"] if one and one != "#" else [])]


def shape(token: str) -> str | None:
    """The kind that a token looks like, if any."""
    return next((kind for kind, form in SHAPES if form.fullmatch(token)), None)


def _value_start(text: str, begin: int, end: int) -> int:
    """Where the value of the token text[begin:end] starts: after the last = or : before its first digit or @."""
    first = SIGN.search(text, begin, end).start()
    sign = max(text.rfind("=", begin, first), text.rfind(":", begin, first))
    if sign <= begin:
        return begin
    begin = sign + 1
    while begin < end and text[begin] in OPENING:
        begin += 1
    return begin


def _runs(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of runs of digits with spaces within, between base spans; cards have 12 digits at least, phones 7 to 15."""
    at = 0
    for a, b in [*sorted((a, b) for _, a, b in base), (len(text), len(text))]:
        for m in RUN.finditer(text, at, a) if at < a else ():
            begin, end = m.span()
            while begin < end and text[begin] == "(" and ")" not in m[0]:
                begin += 1  # opened before the run, closed after it
            digits = sum(map(str.isdigit, m[0]))
            if " " in m[0]:
                if 12 <= digits <= 19 and GROUPED_CARD.fullmatch(text, begin, end):
                    yield "card", begin, end
                if 7 <= digits <= 15:
                    yield "phone", begin, end
        at = max(at, b)


def candidates(text: str, base: list[tuple[str, int, int]]) -> tuple[list[tuple[str, bool, int, int, list[str]]], list[str]]:
    """(kind, is a seed, start, end, patterns) of seeds and of tokens and runs of digits outside them that look like a kind;
    and the patterns around other tokens with a digit."""
    out = [(k, True, a, b, patterns(text, a, b)) for k, a, b in base]
    runs = list(_runs(text, base))
    others, at, run = [], 0, 0
    covered = sorted((a, b) for _, a, b in base)
    for m in TOKEN.finditer(text):
        a, b = m.span()
        if not SIGN.search(text, a, b):
            continue
        while a < b and text[a] in EDGE:
            a += 1
        while b > a and text[b - 1] in EDGE:
            b -= 1
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        if b > a and not (at < len(covered) and covered[at][0] < b):
            a = _value_start(text, a, b)
            kind = shape(text[a:b])
            if kind:
                out.append((kind, False, a, b, patterns(text, a, b)))
                continue
            while run < len(runs) and runs[run][2] <= a:
                run += 1
            if not (run < len(runs) and runs[run][1] < b):  # parts of a run are no tokens of their own
                others += patterns(text, a, b)
    out += [(k, False, a, b, patterns(text, a, b)) for k, a, b in runs]
    return out, others


def _digest(instance: str) -> str:
    """Instances are known by digest: personal data does not travel further than it must."""
    return hashlib.sha256(instance.encode()).hexdigest()[:24]


READ = "rid string, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, others array<string>, found array<struct<kind:string,seed:boolean,instance:string,first:bigint,last:bigint,patterns:array<string>>>"


def read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Base figures and candidates of each document."""
    kind = docs.schema[id_col].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("seed", pa.bool_()), ("instance", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("patterns", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, found, others = [], [], [], []
            for text in batch.column(1).to_pylist():
                spans = base_spans(text)
                counts.append([sum(k == s[0] for s in spans) for k in KINDS])
                base.append(shown(spans))
                rows, rest = candidates(text, spans) if spans or "@" in text or DIGIT.search(text) else ([], [])
                found.append([{"kind": k, "seed": s, "instance": _digest(text[a:b]), "first": a, "last": b, "patterns": p} for k, s, a, b, p in rows])
                others.append(rest)
            columns = [pa.array([c[j] for c in counts], pa.int64()) for j in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(base, pa.string()), pa.array(others, pa.list_(pa.string())), pa.array(found, pa.list_(item))], ["id", *(f"n_{k}" for k in KINDS), "base", "others", "found"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, " + READ.partition(", ")[2])


def score_patterns(edges: DataFrame, others: DataFrame, rounds: int, prior: float) -> DataFrame:
    """(pattern, kind, confidence) from edges (pattern, kind, instance, seed) and others (pattern), a row for each token of no kind.

    Each round is two joins and two aggregations of the graph; an instance's belief is the best of its patterns.
    """
    edges = materialize(edges.groupBy("pattern", "kind", "instance").agg(F.max(F.col("seed").cast("double")).alias("seed")), "pii-edges")
    all_in = edges.select("pattern").unionByName(others.select("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    sizes = materialize(all_in.join(edges.select("pattern").distinct(), "pattern", "left_semi"), "pii-sizes")
    beliefs = edges.groupBy("kind", "instance").agg(F.max("seed").alias("belief"))
    scores = None
    for _ in range(rounds):
        beliefs = materialize(beliefs, "pii-beliefs")
        believed = edges.join(beliefs, ["kind", "instance"]).groupBy("pattern", "kind").agg(F.sum("belief").alias("belief"))
        scores = materialize(believed.join(sizes, "pattern").select("pattern", "kind", (F.col("belief") / (F.col("n") + prior)).alias("confidence")), "pii-scores")
        beliefs = edges.join(scores, ["pattern", "kind"]).groupBy("kind", "instance").agg(F.max(F.greatest("seed", "confidence")).alias("belief"))
    return scores


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, prior: float = 2.0, confidence: float = 0.6) -> DataFrame:
    """A row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans.

    The counts and the digest cover base spans; ``spans`` lists base and discovered ones by start, then kind, each once, and
    ``n_spans`` counts them.  Null and empty texts have no spans and the digest of an empty text.  Repeated rows are read each;
    an instance counts once for a pattern.  Texts are read whole, in time that grows with their length; of a context word the
    nearest CONTEXT_CHARS characters count.  Empty tables give no rows.  A pattern without a seed, or with seeds
    among many other tokens, discovers nothing.  Other columns are ignored, whatever their names.
    """
    rows = materialize(read(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "pii-read")
    seen = rows.select("rid", F.posexplode("found").alias("nth", "f")).select("rid", "nth", "f.kind", "f.seed", "f.instance", F.explode(F.array_distinct("f.patterns")).alias("pattern"))
    others = rows.select(F.explode("others").alias("pattern"))
    scores = score_patterns(seen.select("pattern", "kind", "instance", "seed"), others, rounds, prior)
    good = materialize(scores.where(F.col("confidence") >= confidence).select("pattern", "kind"), "pii-patterns")
    new = materialize(seen.where("NOT seed").join(good, ["pattern", "kind"]).groupBy("rid").agg(F.collect_set("nth").alias("new")), "pii-new")
    order = F.array(*(F.lit(k) for k in KINDS))
    found = rows.join(new, "rid", "left").withColumn(
        "all",
        F.expr("array_distinct(filter(transform(found, (f, i) -> struct(f.first AS first, f.last AS last, CASE WHEN f.seed OR coalesce(array_contains(new, i), false) THEN f.kind END AS kind)), x -> x.kind IS NOT NULL))"),
    )
    found = found.withColumn("order", order)
    placed = F.expr("array_sort(transform(all, x -> struct(x.first AS first, array_position(order, x.kind) AS k, x.last AS last, x.kind AS kind)))")
    spans = F.array_join(F.transform(placed, lambda x: F.concat_ws(":", x["kind"], x["first"].cast("string"), x["last"].cast("string"))), ",")
    return found.select(F.col("id").alias(id_col), *(f"n_{k}" for k in KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), F.coalesce(spans, F.lit("")).alias("spans"), F.size("all").cast("long").alias("n_spans"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
