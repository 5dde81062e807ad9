"""Scores by a gated recurrent language model with a class-factored softmax.

Counts: every distinct token of the training documents is counted, and the counts stay a distributed table.

Outcomes: the ``HEAD`` most frequent tokens by rank, and ``TAIL`` groups of the other words, by the checksum of their
last two bytes.  Outcomes fall into classes of ``PER_CLASS`` in this order; the network predicts the class and the outcome
within it.  Within a tail group a word has the share (count + 0.5) of the group's mass, where one slot of mass
0.5 * (1 + words seen once) stands for all unseen words.  So each step is a distribution over all known words and
one unseen slot for each tail group.

Documents are encoded once and written as ids of two bytes.

Training: a gated recurrent unit in numpy, truncated backpropagation over windows of ``WINDOW`` tokens with the
state carried on between windows of a document and reset between documents.  Training documents are dealt to shards of
about ``SHARD_TOKENS`` tokens by a hash, and each shard trains by itself, in the order of hashes; the weights are averaged
by tokens.  A first round over a part ``FIRST_PART`` of the documents gives the start of a second one over the others, so
every training document is read once, and neither the input's splits nor the number of executors matter.  Sums of
weights are added along the shards, in pieces, so their memory does not grow with the number of shards.

Scoring: all tokens of a document with the state carried through.  Words among the ``LOCAL`` most frequent are
resolved in place; the rest meet their counts in a join, whose most frequent key is rare by construction.

Matrices hold a token in each column, so that every pass over them runs along memory.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soundlattice.llm.shared import materialize, text_or_empty

HEAD, TAIL = 2048, 48
OUTCOMES = HEAD + TAIL
#: Near the root of OUTCOMES, so that both softmaxes of a step are short.
PER_CLASS = 46
CLASSES = -(-OUTCOMES // PER_CLASS)
#: Tokens whose counts are sent to the workers, at most.
LOCAL = 200_000
HIDDEN = 16
WINDOW = 32
FIRST_LANES, LANES, SCORE_LANES = 64, 256, 1024
#: Tokens of a training shard, about.
SHARD_TOKENS = 4_000_000
#: The part of the training documents that fits the start, as one in so many.
FIRST_PART = 16
#: Tokens that a worker holds at once, one document at least.
HELD_TOKENS = 4_000_000
#: Tokens whose softmax is taken at once when scoring.
SCORED_TOKENS = 16_384
#: Columns of a class softmax at once: they stay in the cache.
BLOCK = 2048
#: Floats of a weight vector in one row.
CHUNK = 512
#: Logits are kept within this distance of 0, so that no exponential is denormal, which would be slow.
REACH = 30
END = b"\n"  # no word holds a line feed


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL


def tokens_of(text: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text (A-Z only), without the end."""
    return text.lower().split()


class Network:
    """The weights as one float32 vector with named views, and the passes over windows."""

    def __init__(self, flat: np.ndarray | None = None, priors: tuple[np.ndarray, np.ndarray] | None = None):
        h = HIDDEN
        shapes = {"embed": (OUTCOMES, h), "wx": (h, 3 * h), "u": (h, 3 * h), "b": (3 * h,), "wc": (CLASSES, h), "bc": (CLASSES,), "wo": (CLASSES, PER_CLASS, h), "bo": (CLASSES, PER_CLASS)}
        size = sum(math.prod(s) for s in shapes.values())
        self.flat = np.zeros(size, np.float32) if flat is None else np.array(flat, np.float32)
        self.shapes = shapes
        self.view = self.views(self.flat)
        if flat is None:
            rng = np.random.default_rng(7)
            for name in ("embed", "wx", "u"):
                self.view[name][:] = rng.normal(0, 0.5 if name == "embed" else 0.25, shapes[name])
            if priors is not None:
                self.view["bc"][:], self.view["bo"][:] = priors

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            n = math.prod(shape)
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The gates' input of each outcome, and the recurrent weights; those of sigmoids halved, since they are taken by tanh."""
        half = np.full((3 * HIDDEN, 1), 0.5, self.flat.dtype)
        half[2 * HIDDEN :] = 1
        w = self.view
        return half * (w["embed"] @ w["wx"] + w["b"]).T, half * w["u"].T

    def states(self, x: np.ndarray, reset: np.ndarray, h: np.ndarray, keep: bool, tables: tuple[np.ndarray, np.ndarray] | None = None):
        """Hidden states (HIDDEN, steps, lanes) of a window, x and reset of shape (steps, lanes), h (HIDDEN, lanes).

        ``keep`` holds what backward needs.
        """
        n = HIDDEN
        inputs, u = tables or self.tables()
        gates = inputs.take(x, axis=1)
        hs = np.empty((n, *x.shape), gates.dtype)
        before, zr, new, hun = (np.empty((len(x), k, x.shape[1]), gates.dtype) for k in (n, 2 * n, n, n)) if keep else [None] * 4
        starts = reset.any(axis=1).tolist()
        for t in range(len(x)):
            if starts[t]:
                h = h * ~reset[t]
            hu = u @ h
            a = np.add(gates[: 2 * n, t], hu[: 2 * n], out=zr[t] if keep else None)
            np.tanh(a, out=a)
            a *= 0.5
            a += 0.5
            c = np.multiply(a[n:], hu[2 * n :], out=new[t] if keep else None)
            c += gates[2 * n :, t]
            np.tanh(c, out=c)
            if keep:
                before[t] = h
                hun[t] = hu[2 * n :]
            h = h - c
            h *= a[:n]
            h += c
            hs[:, t] = h
        return hs, h, (before, zr, new, hun)

    def log_probabilities(self, hs: np.ndarray, cls: np.ndarray, word: np.ndarray, grads: dict | None = None, weight: np.ndarray | None = None):
        """ln P(class) + ln P(outcome in class) for columns of hidden states; with ``grads``, also d(-sum)/d(hs)."""
        w = self.view
        out = np.empty(hs.shape[1], hs.dtype)
        back = np.empty_like(hs) if grads is not None else None

        def softmax(seen, weights, biases, place, far, share):
            """ln P(place) for the columns of ``seen``; with ``share``, the logits' gradient too."""
            k = np.arange(seen.shape[1])
            logits = weights @ seen
            logits += biases[:, None]
            if far > REACH:
                np.clip(logits, -REACH, REACH, out=logits)
            taken = logits[place, k]
            np.exp(logits, out=logits)
            total = logits.sum(axis=0)
            if share is not None:
                logits *= share / total
                logits[place, k] -= share
            return taken - np.log(total), logits

        far = float((np.abs(w["wc"]).sum(axis=1) + np.abs(w["bc"])).max())  # hidden states lie between -1 and 1
        for a in range(0, hs.shape[1], BLOCK):
            at = slice(a, a + BLOCK)
            out[at], slope = softmax(hs[:, at], w["wc"], w["bc"], cls[at], far, None if grads is None else weight[at])
            if grads is not None:
                grads["wc"] += slope @ hs[:, at].T
                grads["bc"] += slope.sum(axis=1)
                back[:, at] = w["wc"].T @ slope
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        edges = np.searchsorted(cls[order], np.arange(CLASSES + 1)).tolist()
        sorted_hs, places = hs[:, order], word[order]
        share = None if grads is None else weight[order]
        inner, inner_back = np.empty_like(out), np.empty_like(hs) if grads is not None else None
        fars = (np.abs(w["wo"]).sum(axis=2) + np.abs(w["bo"])).max(axis=1).tolist()
        for c in range(CLASSES):
            at = slice(edges[c], edges[c + 1])
            if edges[c] == edges[c + 1]:
                continue
            size = min(PER_CLASS, OUTCOMES - c * PER_CLASS)
            wo, bo = w["wo"][c, :size], w["bo"][c, :size]
            inner[at], slope = softmax(sorted_hs[:, at], wo, bo, places[at], fars[c], None if grads is None else share[at])
            if grads is not None:
                grads["wo"][c, :size] += slope @ sorted_hs[:, at].T
                grads["bo"][c, :size] += slope.sum(axis=1)
                inner_back[:, at] = wo.T @ slope
        out[order] += inner
        if grads is not None:
            back[:, order] += inner_back
        return out, back

    def gradient(self, x, reset, cls, word, weight, h):
        """Gradient of a window's mean negative log likelihood, and the state to carry on."""
        n, steps, lanes = HIDDEN, *x.shape
        flat = np.zeros_like(self.flat)
        g, w = self.views(flat), self.view
        hs, h_end, (before, zr, new, hun) = self.states(x, reset, h, True)
        count = max(1.0, float(weight.sum()))
        _, back = self.log_probabilities(hs.reshape(n, -1), cls.ravel(), word.ravel(), g, (weight / count).ravel().astype(hs.dtype))
        back = back.reshape(n, steps, lanes)
        z, r = zr[:, :n], zr[:, n:]
        rest = 1 - z
        to_z = (before - new) * z * rest
        to_new = rest * (1 - new * new)
        to_r = hun * r * (1 - r)
        dhu = np.empty((steps, 3 * n, lanes), hs.dtype)
        dgate = np.empty_like(dhu)
        carry = np.zeros((n, lanes), hs.dtype)
        starts = reset.any(axis=1).tolist()
        for t in range(steps - 1, -1, -1):
            dh = back[:, t] + carry
            d = dhu[t]
            np.multiply(dh, to_z[t], out=d[:n])
            dn = np.multiply(dh, to_new[t], out=dgate[t, 2 * n :])
            np.multiply(dn, to_r[t], out=d[n : 2 * n])
            np.multiply(dn, r[t], out=d[2 * n :])
            carry = w["u"] @ d
            dh *= z[t]
            carry += dh
            if starts[t]:
                carry *= ~reset[t]
        dgate[:, : 2 * n] = dhu[:, : 2 * n]
        g["u"] += np.matmul(before, dhu.transpose(0, 2, 1)).sum(axis=0)
        seen = np.ascontiguousarray(w["embed"].T).take(x, axis=1).transpose(1, 0, 2)
        g["wx"] += np.matmul(seen, dgate.transpose(0, 2, 1)).sum(axis=0)
        g["b"] += dgate.sum(axis=(0, 2))
        order = np.argsort(x.ravel().astype(np.uint16), kind="stable")
        ids = x.ravel()[order]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        g["embed"][ids[first]] += np.add.reduceat(np.matmul(w["wx"], dgate).transpose(0, 2, 1).reshape(-1, n)[order], first, axis=0)
        return flat, h_end


def lanes_of(lengths: list[int], lanes: int) -> list[list[int]]:
    """Documents dealt to lanes, longest first to the shortest lane; longest lane first.

    Fewer lanes are used where one document is so long that most would stay empty.
    """
    if not lengths:
        return []
    lanes = max(1, min(lanes, len(lengths), 5 * sum(lengths) // max(lengths)))
    heap = [(0, i) for i in range(lanes)]
    dealt: list[list[int]] = [[] for _ in heap]
    for d in sorted(range(len(lengths)), key=lambda d: -lengths[d]):
        load, lane = heapq.heappop(heap)
        dealt[lane].append(d)
        heapq.heappush(heap, (load + lengths[d], lane))
    return sorted((lane for lane in dealt if lane), key=lambda lane: -sum(lengths[d] for d in lane))


def windows(ids: list[np.ndarray], lanes: int) -> Iterator[tuple]:
    """(x, reset, y, where, live) by window; ``where`` is a token's place in the concatenation of ``ids``, -1 none.

    The input of a step is the token before, the end at a document's start.  ``live`` lanes have tokens left;
    lanes are ordered by length, so those that have ended drop off the end.
    """
    dealt = lanes_of([len(x) for x in ids], lanes)
    if not dealt:
        return
    offset = np.cumsum([0, *(len(x) for x in ids)])
    length = np.array([sum(len(ids[d]) for d in lane) for lane in dealt])
    tokens = np.zeros((int(length[0]), len(dealt)), np.int32)
    places = np.full(tokens.shape, -1, np.int32)
    starts = np.zeros(tokens.shape, bool)
    for j, lane in enumerate(dealt):
        at = 0
        for d in lane:
            to = at + len(ids[d])
            tokens[at:to, j] = ids[d]
            places[at:to, j] = np.arange(offset[d], offset[d + 1])
            starts[at, j] = True
            at = to
    for begin in range(0, len(tokens), WINDOW):
        live = int((length > begin).sum())
        y = tokens[begin : begin + WINDOW, :live]
        reset = starts[begin : begin + WINDOW, :live]
        x = np.zeros_like(y)
        x[1:] = y[:-1]
        if begin:
            x[0] = tokens[begin - 1, :live]
        x[reset] = 0
        yield x, reset, y, places[begin : begin + WINDOW, :live], live


def split_ids(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and place within it."""
    return y // PER_CLASS, y % PER_CLASS


def train(net: Network, ids: list[np.ndarray], squares: np.ndarray, rate: float, lanes: int = LANES) -> int:
    """One pass of truncated backpropagation with Adagrad; returns the number of tokens."""
    seen = 0
    h = None
    for x, reset, y, where, wide in windows(ids, lanes):
        h = np.zeros((HIDDEN, wide), np.float32) if h is None else np.ascontiguousarray(h[:, :wide])
        cls, word = split_ids(y)
        weight = (where >= 0).astype(np.float32)
        grad, h = net.gradient(x, reset, cls, word, weight, h)
        norm = float(np.sqrt(grad @ grad))
        if norm > 1:
            grad /= norm
        grad[np.abs(grad) < 1e-15] = 0  # its square would be denormal
        squares += grad * grad
        net.flat -= rate * grad / (np.sqrt(squares) + 1e-6)
        seen += int(weight.sum())
    return seen


def score_ids(net: Network, ids: list[np.ndarray]) -> np.ndarray:
    """The sum of the natural logs of the network's probabilities for each document."""
    total = sum(map(len, ids))
    found = np.zeros(total, np.float64)
    tables = net.tables()
    h, held = None, []

    def done():
        hs, cls, word, where = (np.concatenate([x[i] for x in held], axis=-1) for i in range(4))
        found[where] = net.log_probabilities(hs, cls, word)[0]
        held.clear()

    for x, reset, y, where, wide in windows(ids, SCORE_LANES):
        h = np.zeros((HIDDEN, wide), np.float32) if h is None else np.ascontiguousarray(h[:, :wide])
        hs, h, _ = net.states(x, reset, h, False, tables)
        live = where.ravel() >= 0
        cls, word = split_ids(y.ravel()[live])
        held.append((hs.reshape(HIDDEN, -1)[:, live], cls, word, where.ravel()[live]))
        if sum(x[1].size for x in held) >= SCORED_TOKENS:
            done()
    if held:
        done()
    starts = np.cumsum([0, *map(len, ids)])[:-1]
    return np.add.reduceat(found, starts) if total else np.zeros(len(ids))


def _held_out(column: Column) -> Column:
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % 5 == 1


def count_tokens(training: DataFrame) -> DataFrame:
    """(word, n) over all rows (text binary); each text's end is the token END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(tokens_of(text))
                held[END] += 1
                if len(held) > 1_000_000:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    return training.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """What the workers know of the counts; bounded by LOCAL and TAIL whatever the corpus."""

    def __init__(self, local: list[tuple[bytes, int]], total: int, distinct: int, tail: dict[int, tuple[float, int]]):
        self.total, self.distinct, self.local = total, distinct, [r for r in local if r[0] == END]
        ranked = sorted((r for r in local if r[0] != END), key=lambda r: (-r[1], r[0]))
        ends = [r for r in local if r[0] == END] or [(END, 0)]
        head = ends + ranked[: HEAD - 1]
        self.ids = {w: i for i, (w, _) in enumerate(head)}
        counts = np.zeros(HEAD)
        counts[: len(head)] = [n for _, n in head]
        # ``tail`` holds all words but the end; the head's leave it.
        mass, once = np.zeros(TAIL), np.zeros(TAIL)
        for k, (m, ones) in tail.items():
            mass[k], once[k] = m, ones
        for w, n in head[1:]:
            mass[tail_class(w)] -= n + 0.5
            once[tail_class(w)] -= n == 1
        self.unseen = 0.5 * (1 + np.maximum(once, 0))
        self.mass = np.maximum(mass, 0) + self.unseen
        self.floor = total + 0.5 * (distinct + 1)
        # One lookup for each token: its place here, and arrays of what is known of it.
        self.place = {w: i for i, (w, _) in enumerate(local)}
        self.id_of = np.array([self.ids[w] if w in self.ids else HEAD + tail_class(w) for w, _ in local], np.int32)
        self.base_of = np.array([math.log10((n + 0.5) / self.floor) for _, n in local])
        self.rest_of = np.array([0.0 if w in self.ids else math.log10((n + 0.5) / self.mass[tail_class(w)]) for w, n in local])
        share = np.zeros(CLASSES * PER_CLASS)
        share[:OUTCOMES] = np.concatenate([counts + 0.5, self.mass])
        share = share.reshape(CLASSES, PER_CLASS)
        classes = share.sum(axis=1)
        within = np.log(np.maximum(share / classes[:, None], math.exp(-REACH)))
        self.priors = (np.log(classes / classes.sum()), within)

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words and the end, and their places among the local ones, -1 for others."""
        get = self.place.get
        places = np.array([get(w, -1) for w in words] + [get(END, -1)], np.int32)
        ids = np.zeros(len(places), np.int32)
        known = places >= 0
        ids[known] = self.id_of[places[known]]
        others = np.flatnonzero(~known)
        ids[others] = [HEAD + tail_class(words[i]) if i < len(words) else 0 for i in others.tolist()]
        return ids, places

    def encode(self, words: list[bytes]) -> np.ndarray:
        return self.look_up(words)[0]


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From (word, n), written: its totals, its most frequent words, and the tail classes' masses."""
    octave = F.floor(F.log2("n") * 8)
    steps = sorted(((r["o"], r["c"]) for r in counts.groupBy(octave.alias("o")).agg(F.count("*").alias("c")).collect()), reverse=True)
    least, held = math.inf, 0
    for o, c in steps:  # some 8 steps for each doubling of the counts
        held += c
        if held > LOCAL:
            break
        least = o
    local = [(bytes(r["word"]), r["n"]) for r in counts.where((octave >= least) | (F.col("word") == F.lit(END))).collect()] if least < math.inf else [(bytes(r["word"]), r["n"]) for r in counts.where(F.col("word") == F.lit(END)).collect()]
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    cut = F.expr("substring(word, -2, 2)")
    classes = counts.where(F.col("word") != F.lit(END)).groupBy((F.crc32(cut) % TAIL).cast("int").alias("k"))
    tail = {r["k"]: (r["m"], r["ones"]) for r in classes.agg(F.sum(F.col("n") + 0.5).alias("m"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("ones")).collect()}
    return Vocabulary(local, whole["n"], whole["v"], tail)


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u2").astype(np.int32) for x in column]


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of batches of about HELD_TOKENS tokens with the ids of their first column."""
    for batch in batches:
        sizes = np.cumsum([len(x.as_buffer()) // 2 for x in batch.column(0)])
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + HELD_TOKENS, "right")))
            part = batch.slice(at, to - at)
            yield part, _arrays(part.column(0))
            at = to


def train_shards(training: DataFrame, start: np.ndarray, lanes: int) -> np.ndarray:
    """The state averaged over the shards of ``training`` (ids binary, shard, place), each trained from ``start``.

    The state is the weights, then Adagrad's sums of squares.
    """
    sent = training.sparkSession.sparkContext.broadcast(start)  # a network of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        now, size, net, sums, seen = None, 0, None, None, 0

        def step():
            nonlocal ids, size, seen
            seen += train(net, ids, sums, 0.05, lanes)
            ids, size = [], 0

        def out():
            flat = np.concatenate([net.flat, sums]).astype(np.float64) * seen
            cut = [flat[i : i + CHUNK] for i in range(0, len(flat), CHUNK)]
            return pa.RecordBatch.from_arrays([pa.array([now] * len(cut), pa.int32()), pa.array(range(len(cut)), pa.int32()), pa.array([seen] * len(cut), pa.int64()), pa.array([c.tobytes() for c in cut], pa.binary())], ["shard", "chunk", "seen", "sums"])

        for batch in batches:
            for x, shard in zip(_arrays(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                if shard != now:
                    if now is not None:
                        step()
                        yield out()
                    flat, sums = np.split(sent.value, 2)
                    now, net, sums, seen = shard, Network(flat), sums.copy(), 0
                ids.append(x)
                size += len(x)
                if size >= HELD_TOKENS:
                    step()
        if now is not None:
            step()
            yield out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for _, chunk, seen, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = held.setdefault(chunk, [0, 0.0])
                at[0] += seen
                at[1] = at[1] + np.frombuffer(sums)
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(held), pa.int32()), pa.array(list(held), pa.int32()), pa.array([x[0] for x in held.values()], pa.int64()), pa.array([x[1].tobytes() for x in held.values()], pa.binary())], ["shard", "chunk", "seen", "sums"])

    schema = "shard int, chunk int, seen bigint, sums binary"
    trained = training.sortWithinPartitions("shard", "place").select("ids", "shard").mapInArrow(run, schema)
    rows = trained.repartition("chunk").sortWithinPartitions("chunk", "shard").mapInArrow(add, schema).collect()  # one network
    sent.unpersist()
    if not rows:
        return start
    found = {r["chunk"]: np.frombuffer(r["sums"]) / r["seen"] for r in rows}
    return np.concatenate([found[i] for i in range(len(found))]).astype(np.float32)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Null and empty texts are the end alone.  Texts are scored whole, however long.  Repeated rows count and score
    each; a null id counts as an empty text in the fold's checksum.  Without training rows no token is known
    and the untrained network scores.  Empty tables give no rows.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    column = F.col(f"`{id_col}`")
    rows = docs.select(column.alias("id"), _held_out(column).alias("held_out"), text_or_empty(text_col).cast("binary").alias("text"))
    counts = materialize(count_tokens(rows.where("NOT held_out").select("text")), "lm-counts")
    words = vocabulary(counts)
    known = spark.sparkContext.broadcast(words)  # LOCAL words
    kind = docs.schema[id_col].dataType.simpleString()
    item = pa.struct([("word", pa.binary()), ("times", pa.int32())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, n, n_known, base, rest, open_words = [], [], [], [], [], []
                for text in part.column(2).to_pylist():
                    found = tokens_of(text)
                    own, places = words.look_up(found)
                    ids.append(own.astype("<u2").tobytes())
                    here = places[places >= 0]
                    n.append(len(own))
                    n_known.append(len(here))
                    base.append(float(words.base_of[here].sum()))
                    rest.append(float(words.rest_of[here].sum()))
                    missing = [found[i] if i < len(found) else END for i in np.flatnonzero(places < 0).tolist()]
                    open_words.append([{"word": w, "times": k} for w, k in Counter(missing).items()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(rest, pa.float64()), pa.array(open_words, pa.list_(item)), pa.array(ids, pa.binary())],
                    ["id", "held_out", "n_tokens", "n_known", "base", "rest", "open", "ids"],
                )

    schema = f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, rest double, open array<struct<word:binary,times:int>>, ids binary"
    read = materialize(rows.mapInArrow(encode, schema).withColumn("rid", F.monotonically_increasing_id()), "lm-encoded")

    shards = max(1, math.ceil(words.total / shard_tokens))
    place = F.xxhash64("id", "ids")  # equal rows are interchangeable
    dealt = read.where("NOT held_out").select("ids", place.alias("place")).withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int"))
    first = F.pmod("place", F.lit(FIRST_PART)) == 0
    flat = Network(priors=words.priors).flat
    state = np.concatenate([flat, np.full_like(flat, 1e-6)])
    for part, lanes in ((first, FIRST_LANES), (~first, LANES)):
        state = train_shards(dealt.where(part).repartitionById(shards, "shard"), state, lanes)
    ready = spark.sparkContext.broadcast(np.split(state, 2)[0])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(ready.value)
        for part, ids in _held(batches):
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(score_ids(net, ids) / math.log(10))], ["rid", "network"])

    scored = read.select("ids", "rid").mapInArrow(score, "rid bigint, network double")
    asked = read.select("rid", F.explode("open").alias("o")).select("rid", "o.word", "o.times")
    met = asked.join(counts, "word", "left")
    k = (F.crc32(F.expr("substring(word, -2, 2)")) % TAIL).cast("int")
    mass = F.get(F.array(*(F.lit(float(m)) for m in words.mass)), k)
    unseen = F.get(F.array(*(F.lit(float(m)) for m in words.unseen)), k)
    is_end = F.col("word") == F.lit(END)
    met = met.select(
        "rid",
        F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("known"),
        (F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / float(words.floor))).alias("base"),
        F.when(is_end, 0.0).otherwise(F.col("times") * F.log10(F.coalesce(F.col("n") + 0.5, unseen) / mass)).alias("score"),
    )
    more = met.groupBy("rid").agg(F.sum("known").alias("known"), F.sum("base").alias("more_base"), F.sum("score").alias("more_score"))
    out = read.select("rid", "id", "held_out", "n_tokens", "n_known", "base", "rest").join(scored, "rid").join(more, "rid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("known")).cast("long").alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base")).cast("double").alias("base_score"),
        (F.col("network") + F.col("rest") + zero("more_score")).cast("double").alias("score"),
    )


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
