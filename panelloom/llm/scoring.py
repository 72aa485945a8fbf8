"""Log probability of texts by logistic mixing of hashed-context bit predictors.

Texts are tokens: words with A-Z in lower case, then one end. The most frequent ``head`` tokens of the
training texts and an escape for all others have Huffman codes, and a token is coded bit by bit.
Every bit is predicted in several contexts (none; the token before; the two before; the one before
that), each hashed with the node of the code into its own table of ones and zeros counted over all
training texts. The predictions are mixed in the logistic domain by weights that a gate chooses (how
often the longer contexts have been seen), then refined by adaptive probability maps per depth of
the code and averaged with the mixture. An escaped token is coded by its smoothed share among the
tokens beyond the head. With the model fixed, all probabilities given one past add up to one, and the
sum of the logs is the score.

Weights and maps are learned online from every training text, whole, in ``ROUNDS`` rounds that a hash of
the row deals the texts to, each twice as large as the one before. In a round the tasks predict every bit
with what earlier rounds have learned, the bit's own counts taken out, and Spark adds up what the step
needs: per gate the gradient and the curvature of the log loss (an online Newton step), per depth and
knot the bits seen there. What a round sends is a table of ``GATES`` and ``DEPTHS`` x ``KNOTS`` sums whatever
the input, and no text ever leaves the tasks. The model does not depend on partitions, but for the last
digits of sums.

Counts of tokens and of bits are aggregated by Spark. Sent to the driver, and from it to the tasks, are only tables
whose size is a parameter: the head, the ``common`` most frequent counts, 2 ** ``slot_bits`` slots per context. Counts
of all other tokens are joined by token. A long text's bits are worked on in slices when learning.

Nulls: a null text is an empty one, its only token is the end. A null ``doc_id`` is hashed like an
empty one and trained on or not by that. Repeated rows are scored each. Without any training text all
counts are 0 and every token gets the smoothed share. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import HashIndex, kept_table, lower_words, mixed, small_batches, text_pieces, word_hashes

HELD_OUT = 2
FOLDS = 7
END = "\n"  # no word holds a line break
GATES, DEPTHS, KNOTS = 25, 24, 33
REACH = 8.0
CONTEXTS = 4
PAIRS = [(i, j) for i in range(CONTEXTS) for j in range(i, CONTEXTS)]
ROUNDS = 4
PIECE_BYTES = 300_000
SLICE_BITS = 400_000


@dataclass(frozen=True)
class Setting:
    head: int = 4_095
    common: int = 200_000
    slot_bits: int = 18
    ridge: float = 10.0
    prior: float = 200.0
    seed: int = 11


def huffman(counts: list[int]) -> list[str]:
    """A prefix code for the symbols 0, 1, ...; ties go to the symbol with the smaller number."""
    heap: list[tuple] = [(max(n, 1), i, i) for i, n in enumerate(counts)]
    heapq.heapify(heap)
    if len(heap) == 1:
        return ["0"]
    mark = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], mark, (a[2], b[2])))
        mark += 1
    codes, stack = [""] * len(counts), [(heap[0][2], "")]
    while stack:
        node, code = stack.pop()
        if isinstance(node, int):
            codes[node] = code
        else:
            stack += [(node[0], code + "0"), (node[1], code + "1")]
    return codes


class Coder:
    """Texts to symbols, bits and hashed contexts. ``known`` are the most frequent tokens; the first ``setting.head`` of
    them are symbols, in order, then the escape."""

    def __init__(self, known: pa.Array, counts: np.ndarray, beyond: int, setting: Setting):
        self.setting = setting
        self.index = HashIndex(word_hashes(known))
        head = counts[: setting.head].tolist()
        codes = huffman([*head, beyond])
        self.escape = len(head)
        self.length = np.array([len(c) for c in codes], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.bit = np.array([c == "1" for code in codes for c in code], bool)
        names: dict[str, int] = {}
        self.node = np.array([names.setdefault(code[:i], len(names)) for code in codes for i in range(len(code))], np.int64)
        self.nodes = len(names)
        self.salt = self.node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.depth = np.minimum(np.array([i for code in codes for i in range(len(code))], np.int32), DEPTHS - 1)

    def tokens(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All tokens of the texts, each text's words followed by an end, and where each text starts."""
        flat, at = lower_words(texts)
        n = len(at) - 1
        order = np.insert(np.arange(len(flat)), at[1:], len(flat))
        return pa.concat_arrays([flat.cast(pa.string()), pa.array([END])]).take(pa.array(order)), at + np.arange(n + 1)

    def bits(self, flat: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """The place of each token among the known ones; and per bit its token, value, depth and slot in each context's table."""
        own = word_hashes(flat)
        place = self.index.find(own)
        symbol = np.where((place >= 0) & (place < self.escape), place, self.escape)
        one = np.empty(len(own), np.uint64)
        one[1:] = own[:-1]
        one[at[:-1]] = 1
        two = np.empty(len(own), np.uint64)
        two[1:] = one[:-1]
        two[at[:-1]] = 1
        many = self.length.take(symbol)
        step = np.arange(many.sum()) + np.repeat(self.start.take(symbol) - np.cumsum(many) + many, many)
        salt = self.salt.take(step)
        slots = [self.node.take(step)]
        for h in (one, mixed(one + np.uint64(3) * two), ~two):
            slot = np.repeat(h, many)
            slot ^= salt
            slot *= np.uint64(0xD6E8FEB86659FD93)
            slot >>= np.uint64(64 - self.setting.slot_bits)
            slots.append(slot.view(np.int64))
        return place, np.repeat(np.arange(len(own)), many), self.bit.take(step), self.depth.take(step), slots

    @property
    def sizes(self) -> list[int]:
        return [max(self.nodes, 1), *[1 << self.setting.slot_bits] * 3]


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def levels(seen: np.ndarray) -> np.ndarray:
    """How often a context was seen, in five levels."""
    return np.minimum(np.log2(seen + 1) / 2, 4).astype(np.int8)


def stretch(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    return np.log((ones + 0.4) / (zeros + 0.4)).astype(np.float32)


def without_own(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The predictions of every slot for a bit that was counted in it: at ``2 * slot + bit``, that bit taken out."""
    return np.stack([stretch(ones, np.maximum(zeros - 1, 0)), stretch(np.maximum(ones - 1, 0), zeros)], axis=1).ravel()


class Mixer:
    """Weights per gate and refining maps per depth over the predictions of the contexts."""

    def __init__(self, ones: list[np.ndarray], zeros: list[np.ndarray], ridge: float = 10.0, prior: float = 200.0):
        self.stretch = [stretch(a, b) for a, b in zip(ones, zeros)]
        self.without = [without_own(a, b) for a, b in zip(ones, zeros)]
        seen = [ones[i] + zeros[i] for i in (1, 2)]
        self.level = [levels(seen[0]) * np.int8(5), levels(seen[1])]
        self.level_without = [levels(np.maximum(seen[0] - 1, 0)) * np.int8(5), levels(np.maximum(seen[1] - 1, 0))]
        self.weight = np.tile(np.array([[0.4], [0.3], [0.2], [0.1]], np.float32), (1, GATES))
        self.start = np.tile(squash(np.linspace(-REACH, REACH, KNOTS)), DEPTHS)
        self.map = self.start.astype(np.float32)
        self.curve = np.tile(ridge * np.eye(CONTEXTS), (GATES, 1, 1))
        self.prior = prior
        self.hit, self.mass = np.zeros(len(self.map)), np.zeros(len(self.map))

    def inputs(self, slots: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        return [s.take(i) for s, i in zip(self.stretch, slots)], self.level[0].take(slots[1]) + self.level[1].take(slots[2])

    def inputs_without(self, bit: np.ndarray, slots: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """As :meth:`inputs`, for bits that are among the counts."""
        gate = self.level_without[0].take(slots[1]) + self.level_without[1].take(slots[2])
        return [s.take(2 * i + bit) for s, i in zip(self.without, slots)], gate

    def mix(self, x: list[np.ndarray], gate: np.ndarray, depth: np.ndarray):
        """The mixture's probability of a one, and where it lies in the maps: the lower knot and the part of the step beyond."""
        dot = self.weight[0].take(gate)
        dot *= x[0]
        for w, v in zip(self.weight[1:], x[1:]):
            part = w.take(gate)
            part *= v
            dot += part
        np.clip(dot, -REACH, REACH, out=dot)
        place = (dot + np.float32(REACH)) * np.float32((KNOTS - 1) / (2 * REACH))
        at = np.minimum(place.astype(np.int32), KNOTS - 2)
        part = place - at
        at += depth * KNOTS
        return squash(dot), at, part

    def predict(self, x: list[np.ndarray], gate: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Probability of a one."""
        p, at, part = self.mix(x, gate, depth)
        low = self.map.take(at)
        refined = self.map.take(at + 1)
        refined -= low
        refined *= part
        refined += low
        refined += p
        refined *= np.float32(0.5)
        return np.clip(refined, np.float32(1e-6), np.float32(1 - 1e-6), out=refined)

    def sums(self, bit: np.ndarray, depth: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
        """What these bits add to a step: gradient and curvature of every gate, then ones and mass of every knot."""
        x, gate = self.inputs_without(bit, slots)
        p, at, part = self.mix(x, gate, depth)
        order = np.argsort(gate, kind="stable")
        ends = np.cumsum(np.bincount(gate, minlength=GATES))
        v = np.stack([k.take(order) for k in x])
        p = p.take(order)
        wrong, sure = bit.take(order) - p, p * (1 - p)
        slope, curve = np.zeros((GATES, CONTEXTS)), np.zeros((GATES, len(PAIRS)))
        for g, (lo, hi) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends)):
            if lo < hi:
                mine = v[:, lo:hi]
                slope[g] = mine @ wrong[lo:hi]
                bend = (mine * sure[lo:hi]) @ mine.T
                curve[g] = [bend[i, j] for i, j in PAIRS]
        n = len(self.map)
        upper = at + 1
        ones = np.flatnonzero(bit)
        at1, up1, part1 = at.take(ones), upper.take(ones), part.take(ones)
        hit = np.bincount(at1, 1 - part1, n) + np.bincount(up1, part1, n)
        mass = np.bincount(at, 1 - part, n) + np.bincount(upper, part, n)
        return np.concatenate([slope.ravel(), curve.ravel(), hit, mass])

    def step(self, sums: np.ndarray) -> None:
        """Learn from one round. Curvature adds up over the rounds; the maps' earlier rounds, under older weights, count half."""
        slope, curve, hit, mass = np.split(sums, np.cumsum([GATES * CONTEXTS, GATES * len(PAIRS), len(self.map)]))
        for k, (i, j) in enumerate(PAIRS):
            bend = curve.reshape(GATES, -1)[:, k]
            self.curve[:, i, j] += bend
            if i != j:
                self.curve[:, j, i] += bend
        move = np.linalg.solve(self.curve, slope.reshape(GATES, CONTEXTS, 1))[:, :, 0]
        self.weight = (self.weight + move.T).astype(np.float32)
        self.hit, self.mass = self.hit / 2 + hit, self.mass / 2 + mass
        self.map = ((self.prior * self.start + self.hit) / (self.prior + self.mass)).astype(np.float32)


def fold() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def token_counts(texts: DataFrame) -> DataFrame:
    """``token``, ``c`` over all rows' ``text``, counted by batch before the shuffle."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_pieces(batch):
                flat, at = lower_words(piece.column("text"))
                found = flat.cast(pa.string()).value_counts()
                token = pa.concat_arrays([found.field("values"), pa.array([END])])
                n = pa.concat_arrays([found.field("counts"), pa.array([len(at) - 1], pa.int64())])
                yield pa.RecordBatch.from_arrays([token, n], names=["token", "c"])

    return texts.select("text").mapInArrow(each, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def most_common(counts: DataFrame, most: int) -> tuple[pa.Array, np.ndarray]:
    """Tokens and counts, the largest first, of all tokens from a count on that at most ``most`` tokens reach.

    The count is read off a histogram with a fixed number of steps, so only what is wanted is sent.
    """
    step = F.floor(F.log2("c") * 8)
    sizes = sorted(((r["step"], r["n"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    kept, lowest = 0, None
    for at, n in sizes:
        if kept + n > most:
            break
        kept, lowest = kept + n, at
    got = counts.filter(step >= lowest).select("token", "c").toArrow() if kept else pa.table({"token": pa.array([], pa.string()), "c": pa.array([], pa.int64())})
    got = got.sort_by([("c", "descending"), ("token", "ascending")])
    return got.column("token").combine_chunks().cast(pa.string()), got.column("c").to_numpy()


def bit_counts(texts: DataFrame, coder: Coder) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ones and zeros of every slot of every context, over all texts; tables of a fixed size."""
    sizes = coder.sizes
    offset = np.concatenate([[0], np.cumsum(sizes)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(2 * offset[-1], np.int64)
        for batch in batches:
            for piece in text_pieces(batch, most=PIECE_BYTES):
                _, _, bit, _, slots = coder.bits(*coder.tokens(piece.column("text")))
                for o, size, s in zip(offset, sizes, slots):
                    seen[2 * o : 2 * (o + size)] += np.bincount(2 * s + bit, minlength=2 * size)
        zeros, ones = seen[::2], seen[1::2]
        used = np.flatnonzero(zeros + ones)
        for i in range(0, len(used), 100_000):
            u = used[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int32)), pa.array(ones[u]), pa.array(zeros[u])], names=["slot", "n1", "n0"])

    sums = texts.select("text").mapInArrow(each, "slot int, n1 long, n0 long").groupBy("slot").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    got = sums.toArrow()  # at most the slots of the tables
    slot = got.column("slot").to_numpy()
    tables = []
    for name in ("n1", "n0"):
        full = np.zeros(offset[-1], np.float64)
        full[slot] = got.column(name).to_numpy()
        tables.append([full[offset[i] : offset[i + 1]] for i in range(len(sizes))])
    return list(zip(*tables))


def dealt_round(seed: int) -> Column:
    """The learning round of a row, 0 to ``ROUNDS`` - 1; each has twice the texts of the one before."""
    key = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit((1 << ROUNDS) - 1))
    return sum(((key >= (1 << r) - 1).cast("int") for r in range(1, ROUNDS)), F.lit(0))


def round_sums(texts: DataFrame, coder: Coder, mixer: Mixer) -> np.ndarray:
    """What all bits of ``texts`` add to a step, summed by Spark."""
    spark = texts.sparkSession
    size = GATES * (CONTEXTS + len(PAIRS)) + 2 * DEPTHS * KNOTS
    model = spark.sparkContext.broadcast((coder, mixer))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, mixer = model.value
        total = np.zeros(size)
        for batch in batches:
            for piece in text_pieces(batch, most=PIECE_BYTES):
                _, _, bit, depth, slots = coder.bits(*coder.tokens(piece.column("text")))
                for lo in range(0, len(bit), SLICE_BITS):
                    part = slice(lo, lo + SLICE_BITS)
                    total += mixer.sums(bit[part], depth[part], [s[part] for s in slots])
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], names=["cell", "v"])

    got = texts.select("text").mapInArrow(each, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()  # at most ``size`` rows
    model.destroy()
    out = np.zeros(size)
    out[got.column("cell").to_numpy()] = got.column("v").to_numpy()
    return out


def learned(training: DataFrame, coder: Coder, tables: list[tuple[np.ndarray, np.ndarray]], setting: Setting) -> Mixer:
    """The mixer after a pass over all training texts, a round at a time."""
    mixer = Mixer([a for a, _ in tables], [b for _, b in tables], setting.ridge, setting.prior)
    dealt = training.withColumn("_round", dealt_round(setting.seed))
    for r in range(ROUNDS):
        mixer.step(round_sums(dealt.filter(F.col("_round") == r), coder, mixer))
    return mixer


#: A row with a token is a rare token of a text, any other one the sums of a text.
PART = "row long, doc_id long, held_out boolean, token string, n long, n_tokens long, n_known long, log_counts double, n_tail long, log_bits double, n_bytes long"
NAMES = [c.split()[0] for c in PART.split(", ")]


def score_documents(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` (both log10) and
    ``bits_per_byte``: one row per document."""
    spark = docs.sparkSession
    small_batches(spark)
    held = fold() == HELD_OUT
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held.alias("held_out"))
    training = rows.filter(~F.col("held_out"))
    counts = kept_table(token_counts(training), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    known, c = most_common(counts, setting.common)
    head_total = int(c[: setting.head].sum())
    coder = Coder(known, c, total - head_total, setting)
    tables = bit_counts(training, coder)
    mixer = learned(training, coder, tables, setting)
    log_known = np.log10(c + 1.0)
    model = spark.sparkContext.broadcast((coder, mixer, log_known))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, mixer, log_known = model.value
        for batch in batches:
            for piece in text_pieces(batch, most=PIECE_BYTES):
                flat, at = coder.tokens(piece.column("text"))
                n = len(at) - 1
                text = np.repeat(np.arange(n), np.diff(at))
                where, token, bit, depth, slots = coder.bits(flat, at)
                x, gate = mixer.inputs(slots)
                p = mixer.predict(x, gate, depth)
                log_bits = np.bincount(text.take(token), np.log10(np.where(bit, p, 1 - p)), n)
                found = where >= 0
                logs = np.where(found, log_known.take(where, mode="clip") if len(log_known) else 0.0, 0.0)
                escaped = (where < 0) | (where >= coder.escape)
                sums = [np.bincount(text, w, n) for w in (found, logs, np.where(escaped & found, logs, 0.0), escaped)]
                row, doc, out = (piece.column(c) for c in ("row", "doc_id", "held_out"))
                none = lambda k: pa.nulls(k, pa.int64())
                ints = lambda v: pa.array(np.rint(v).astype(np.int64))
                size = pc.fill_null(pc.binary_length(piece.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [row, doc, out, pa.nulls(n, pa.string()), none(n), ints(np.diff(at)), ints(sums[0]), pa.array(sums[1]), ints(sums[3]), pa.array(log_bits + sums[2]), size],
                    names=NAMES,
                )
                rare = np.flatnonzero(~found)
                if len(rare):
                    coded = flat.take(pa.array(rare)).dictionary_encode()
                    pair, times = np.unique(text[rare] * np.int64(len(coded.dictionary)) + coded.indices.to_numpy(), return_counts=True)
                    of, word = np.divmod(pair, len(coded.dictionary))
                    m = len(pair)
                    zero = pa.nulls(m, pa.float64())
                    yield pa.RecordBatch.from_arrays(
                        [row.take(pa.array(of)), none(m), pa.nulls(m, pa.bool_()), coded.dictionary.take(pa.array(word)), pa.array(times.astype(np.int64)), none(m), none(m), zero, none(m), zero, none(m)],
                        names=NAMES,
                    )

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    parts = kept_table(numbered.mapInArrow(each, PART), "token-parts")
    rare = parts.filter("token IS NOT NULL").select("row", "token", "n").join(counts, "token", "left")
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("rare_logs"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    whole = parts.filter("token IS NULL").drop("token", "n").join(rare, "row", "left")
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    base = F.col("log_counts") + rare_logs - F.col("n_tokens") * math.log10(total + distinct + 1)
    tail = math.log10(total - head_total + distinct - min(setting.head, len(c)) + 1)
    score = F.col("log_bits") + rare_logs - F.col("n_tail") * tail
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"), score.alias("score"), F.try_divide(-score * math.log2(10), F.col("n_bytes").cast("double")).alias("bits_per_byte"),
    )
