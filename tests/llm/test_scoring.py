from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelloom.llm import scoring
from panelloom.llm.common import HashIndex, lower_words, word_hashes
from panelloom.llm.queries import QUERIES
from tests.llm.helpers import DOCS, docs, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER)), None]


def base(table):
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in table]
    c = Counter(t for (_, text), h in zip(table, held) if not h for t in tokens(text))
    n, v = sum(c.values()), len(c)
    out = []
    for (i, text), h in zip(table, held):
        t = tokens(text)
        out.append((i, h, len(t), sum(x in c for x in t), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)))
    return out


def check(table, got):
    key = lambda r: (str(r[0]), *r[1:5], round(r[5], 6))
    want = sorted(base(table), key=key)
    have = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
    assert [w[:5] for w in want] == [h[:5] for h in have]
    assert np.allclose([w[5] for w in want], [h[5] for h in have], rtol=1e-9, atol=1e-6)
    assert all(r["score"] < 0 for r in got)


def test_base_on_odd_texts(spark):
    table = [(1, None), (2, ""), (3, " \t"), (4, "A a É é"), (5, "a\x1cb a"), (None, "null id"), (6, "same"), (6, "same"), (7, "x" * 50_000), (8, "é " * 20_000)] + [(i, f"word{i % 5} the {i}") for i in range(20, 60)]
    extra = docs(spark, table).withColumns({"token": F.lit("t"), "row": F.lit(1), "c": F.lit(2)})
    for setting in (scoring.Setting(), scoring.Setting(head=3, common=5, slot_bits=8)):
        check(table, rows(scoring.score_documents(extra, setting)))


def test_empty_and_without_training_texts(spark):
    assert scoring.score_documents(spark.createDataFrame([], DOCS)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = rows(scoring.score_documents(docs(spark, [(held, "a b")])))
    assert got[0]["n_known"] == 0 and got[0]["train_tokens"] == 0 and got[0]["base_score"] == 0


def test_probabilities_of_the_next_symbol_add_up():
    """With the model fixed, the symbols that can follow a past have probabilities that add up to one."""
    known = pa.array([scoring.END, "a", "b", "c"])
    coder = scoring.Coder(known, np.array([40, 30, 20, 10]), 25, scoring.Setting(slot_bits=6))
    rng = np.random.default_rng(0)
    mixer = scoring.Mixer(*[[rng.integers(0, 30, s).astype(float) for s in coder.sizes] for _ in range(2)])
    mixer.weight[:] = rng.normal(0.3, 0.2, mixer.weight.shape)
    for past in ([], ["a"], ["a", "c"], ["zzz", "b", "b"]):
        total = 0.0
        for nxt in ("a", "b", "c", "other", None):
            words = [*past, *([nxt] if nxt else [])]
            flat, at = coder.tokens(pa.array([" ".join(words)]))
            _, token, bit, depth, slots = coder.bits(flat, at)
            p = mixer.predict(*mixer.inputs(slots), depth)
            total += float(np.prod(np.where(bit, p, 1 - p)[token == len(past)].astype(float)))
        assert abs(total - 1) < 1e-4


def test_huffman_is_a_prefix_code():
    codes = scoring.huffman([5, 1, 1, 9, 0, 3])
    assert sum(2.0 ** -len(c) for c in codes) == 1 and len(codes[3]) == min(map(len, codes))
    assert scoring.huffman([0]) == ["0"]


def test_words_hashes_and_index():
    flat, at = lower_words(pa.array([" A b\x0bb", None, "", "É x"]))
    assert flat.to_pylist() == ["a", "b", "b", "É x"] and at.tolist() == [0, 3, 3, 3, 4]
    h = word_hashes(flat)
    assert h[1] == h[2] and len(set(h.tolist())) == 3
    many = word_hashes(pa.array([f"w{i}" for i in range(5_000)]))
    index = HashIndex(many[:3_000])
    assert index.find(many).tolist() == [*range(3_000), *[-1] * 2_000]
    assert HashIndex(many[:0]).find(many[:2]).tolist() == [-1, -1]


def test_query_beats_the_base_on_held_out_texts(spark):
    folder = "/root/testdata/sf0.01"
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = rows(QUERIES["op2_lm_scoring"](spark, folder))
    check(table, got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def plain_step(mixer, seen):
    """One learning round in plain Python: ``seen`` holds (bit, depth, slots) of every bit; counts are the mixer's own."""
    ones, zeros = mixer["counts"]
    n = len(ones)
    slope, bend = defaultdict(lambda: np.zeros(n)), defaultdict(lambda: np.zeros((n, n)))
    hit, mass = defaultdict(float), defaultdict(float)
    for bit, depth, slots in seen:
        a = [ones[k][s] - bit for k, s in enumerate(slots)]
        b = [zeros[k][s] - (1 - bit) for k, s in enumerate(slots)]
        x = np.array([math.log((p + 0.4) / (q + 0.4)) for p, q in zip(a, b)])
        gate = plain_gate(a, b)
        p, at, part = plain_mix(mixer, x, gate, depth)
        slope[gate] += (bit - p) * x
        bend[gate] += p * (1 - p) * np.outer(x, x)
        for knot, share in ((at, 1 - part), (at + 1, part)):
            hit[knot] += share * bit
            mass[knot] += share
    for g in slope:
        mixer["curve"][g] = mixer["curve"][g] + bend[g]
        mixer["weight"][g] = mixer["weight"][g] + np.linalg.solve(mixer["curve"][g], slope[g])
    for knot in range(len(mixer["map"])):
        mixer["hit"][knot] = mixer["hit"][knot] / 2 + hit[knot]
        mixer["mass"][knot] = mixer["mass"][knot] / 2 + mass[knot]
        mixer["map"][knot] = (200 * identity(knot) + mixer["hit"][knot]) / (200 + mixer["mass"][knot])


def identity(knot):
    return 1 / (1 + math.exp(-(-8 + 0.5 * (knot % scoring.KNOTS))))


def plain_gate(a, b):
    return sum(m * min(int(math.log2(a[k] + b[k] + 1) / 2), 4) for k, m in ((1, 5), (2, 1)))


def plain_mix(mixer, x, gate, depth):
    dot = min(8.0, max(-8.0, float(mixer["weight"][gate] @ x)))
    place = (dot + 8) * 2
    at = min(int(place), scoring.KNOTS - 2)
    return 1 / (1 + math.exp(-dot)), at + depth * scoring.KNOTS, place - at


def plain_scores(table, coder, setting, turn):
    """log10 of the probability of all coded bits of each text; ``turn`` gives each training row's round."""
    bits = []
    for _, text in table:
        _, _, bit, depth, slots = coder.bits(*coder.tokens(pa.array([text])))
        bits.append([(int(b), int(d), [int(s[i]) for s in slots]) for i, (b, d) in enumerate(zip(bit, depth))])
    ones, zeros = ([Counter() for _ in range(4)] for _ in range(2))
    for row, r in zip(bits, turn):
        for bit, _, slots in row if r is not None else ():
            for k, s in enumerate(slots):
                (ones if bit else zeros)[k][s] += 1
    knots = range(scoring.KNOTS * scoring.DEPTHS)
    mixer = {
        "counts": (ones, zeros), "weight": {g: np.array([0.4, 0.3, 0.2, 0.1]) for g in range(scoring.GATES)}, "curve": {g: setting.ridge * np.eye(4) for g in range(scoring.GATES)},
        "map": {k: identity(k) for k in knots}, "hit": dict.fromkeys(knots, 0.0), "mass": dict.fromkeys(knots, 0.0),
    }
    for r in range(scoring.ROUNDS):
        plain_step(mixer, [b for row, own in zip(bits, turn) if own == r for b in row])
    out = []
    for row in bits:
        total = 0.0
        for bit, depth, slots in row:
            a, b = [ones[k][s] for k, s in enumerate(slots)], [zeros[k][s] for k, s in enumerate(slots)]
            p, at, part = plain_mix(mixer, np.array([math.log((i + 0.4) / (j + 0.4)) for i, j in zip(a, b)]), plain_gate(a, b), depth)
            refined = mixer["map"][at] * (1 - part) + mixer["map"][at + 1] * part
            p = min(1 - 1e-6, max(1e-6, (p + refined) / 2))
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def test_score_equals_a_plain_version(spark):
    rng = np.random.default_rng(5)
    table = [(i, " ".join(rng.choice(["a", "b", "c", "d", "e f", "g"], rng.integers(0, 40)))) for i in range(60)] + [(60, "a b c " * 3_000), (3, "a b"), (61, "")]
    setting = scoring.Setting(head=100, slot_bits=10)
    frame = docs(spark, table).select("doc_id", "text").repartition(5)
    turn = {(r["doc_id"], r["text"]): r["r"] for r in rows(frame.select("doc_id", "text", scoring.dealt_round(setting.seed).alias("r")))}
    assert set(turn.values()) == set(range(scoring.ROUNDS))
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in table]
    c = Counter(("\n" if t is None else t) for (_, text), h in zip(table, held) if not h for t in tokens(text))
    order = sorted(c, key=lambda t: (-c[t], t))
    coder = scoring.Coder(pa.array(order), np.array([c[t] for t in order]), 0, setting)
    want = plain_scores(table, coder, setting, [None if h else turn[row] for row, h in zip(table, held)])
    got = rows(scoring.score_documents(frame, setting))
    have = {(r["doc_id"], r["n_tokens"]): r["score"] for r in got}
    for (i, text), w in zip(table, want):
        assert have[i, len(tokens(text))] == pytest.approx(w, rel=1e-3, abs=1e-4)


def test_learning_covers_every_training_text_and_ignores_partitions(spark):
    table = [(i, f"the {'quick ' * (i % 7)}fox number{i % 11} jumps") for i in range(300)] + [(300, "a very long text " * 20_000)]
    frame = docs(spark, table)
    turns = frame.select(scoring.dealt_round(11).alias("r")).groupBy("r").count().collect()
    assert sum(t["count"] for t in turns) == len(table) and {t["r"] for t in turns} == set(range(scoring.ROUNDS))
    a, b = ({r["doc_id"]: r["score"] for r in rows(scoring.score_documents(frame.repartition(n)))} for n in (1, 7))
    assert all(a[i] == pytest.approx(b[i], rel=1e-4) for i in a)
