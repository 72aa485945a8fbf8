"""Tokens of two tokenizers aligned by pointer jumping over their byte ranges.

Every token points to the farthest-right token of the other side that overlaps it: the one that covers its last
byte. Where both sides end at the same byte, the second side's token points to itself. Pointers never go left, so
doubling them (every token takes its successor's successor) reaches the terminal token of each group after
as many steps as the longest group's length has bits. Tokens with one terminal are one group.

A text is cut before every space that follows no space and precedes no white space; both tokenizers begin a new unit
there, so a batch encodes each distinct chunk once and gathers the rest (a plain version in the tests encodes
whole texts). Every document gives its distinct linked id pairs. They are summed per block of documents and then
over the corpus; each block gets back the counts of just its own pairs, so no task and no broadcast holds the
table of all pairs.

Results: null or empty texts, and texts that the joined tokens of a side do not spell byte by byte, have no tokens
and zeros. Repeated rows and null keys keep a row of their own each, and each counts as a document. Extra columns
are ignored; an empty table gives an empty result. Memory: a batch's texts and a few arrays as long as its
tokens. A very long text is a batch of its own; in a group of many tokens the distinct ids are paired, not the tokens.
"""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import arrow_schema, forget, kept_table, small_batches, text_pieces
from panelloom.llm.pieces import ragged

FIRST = "/opt/tokenizers/byte_bpe_50k.json"
SECOND = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: how the published byte-level tokenizer cuts a text into units.
UNITS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct chunks a Python worker remembers before it starts anew.
REMEMBERED = 600_000
LONG_CHUNK = 1_000
#: Bytes of text whose documents share one slice of the corpus counts.
BLOCK_BYTES = 32 << 20
#: Bytes of text that are aligned together: a worker's arrays take about a hundred times as much.
PIECE_BYTES = 1_000_000
#: A group with more pairs than this has its ids collapsed before they are paired.
PLAIN_PAIRS = 256
SPACE = 0x20


def byte_letters() -> dict[str, int]:
    """The published byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def opens_unit() -> np.ndarray:
    """Bytes that begin a character which is surely no white space; others leave a text uncut, with the same tokens."""
    ok = np.zeros(256, bool)
    for lo, hi in ((0x21, 0x7E), (0xC3, 0xDF), (0xE4, 0xF4)):
        ok[lo : hi + 1] = True
    return ok


class TwoTokenizers:
    """Both tokenizers with the bytes of their ids, and the chunks encoded so far."""

    def __init__(self, first: str = FIRST, second: str = SECOND):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        letters = byte_letters()
        vocabulary = self.first.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b_bytes = [piece_bytes(self.second.id_to_piece(i)) for i in range(self.second.vocab_size())]
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.apart = not any("▁" in p.lstrip("▁") for p in map(self.second.id_to_piece, range(self.second.vocab_size())))
        self.printed = pa.array([f"{i}{s}" for n, end in ((len(self.a_bytes), "|"), (len(self.b_bytes), ";")) for i in range(n) for s in (",", end)])
        self.opens = opens_unit()
        ranks = {self.a_bytes[i]: i for token, i in vocabulary.items() if i < self.first.get_vocab_size(with_added_tokens=False)}
        self.quick = tiktoken.Encoding("first", pat_str=UNITS, mergeable_ranks=ranks, special_tokens={})
        self.forget_chunks()

    def first_ids(self, chunks: list[str]) -> list[list[int]]:
        """Ids of the first side. Long chunks go to the library whose matching needs no stack; both know the same merges."""
        quick = self.quick.encode_ordinary
        out = [quick(c) if len(c) <= LONG_CHUNK else None for c in chunks]
        long = [i for i, ids in enumerate(out) if ids is None]
        for i, x in zip(long, self.first.encode_batch_fast([chunks[i] for i in long], add_special_tokens=False)):
            out[i] = x.ids
        return out

    def forget_chunks(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = [np.empty(0, np.int32), np.empty(0, np.int32)]
        self.at = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.fits = np.empty(0, bool)

    def places(self, chunks: list[str]) -> np.ndarray:
        """Where the ids of each chunk are: entries of ``at`` (of both sides) and ``fits``. A chunk begins with its space."""
        if len(self.place) > REMEMBERED:
            self.forget_chunks()
        place = self.place
        new = [c for c in chunks if c not in place]
        place.update(zip(new, range(len(place), len(place) + len(new))))
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            spelled = [c.encode() for c in part]
            width = np.fromiter(map(len, spelled), np.int64, len(part))
            fits = np.ones(len(part), bool)
            sides = self.first_ids(part), self.second.encode([c[1:] for c in part], num_threads=1)
            for side, (lists, table, size) in enumerate(zip(sides, (self.a_bytes, self.b_bytes), (self.a_size, self.b_size))):
                n = np.fromiter(map(len, lists), np.int64, len(part))
                ids = np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(n.sum()))
                ends = np.cumsum(n)
                wide = np.diff(np.concatenate([[0], np.cumsum(size[ids])])[np.concatenate([[0], ends])])
                if (wide != width).any() or b"".join([table[k] for k in ids.tolist()]) != b"".join(spelled):
                    fits &= [b"".join([table[k] for k in own]) == x for own, x in zip(lists, spelled)]
                self.flat[side] = np.concatenate([self.flat[side], ids])
                self.at[side] = np.concatenate([self.at[side], self.at[side][-1] + ends])
            self.fits = np.concatenate([self.fits, fits])
        return np.fromiter(map(place.__getitem__, chunks), np.int64, len(chunks))

    def tokens(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides in a row, how many each text has of them, and the bytes of each text with its space.

        A text that one side does not spell has no tokens and no bytes. Texts are not null and not empty.
        """
        spaced = pc.binary_join_element_wise(pa.scalar(""), texts, pa.scalar(" "))
        at = np.frombuffer(spaced.buffers()[1], np.int32)[spaced.offset : spaced.offset + len(spaced) + 1].astype(np.int64)
        data = np.frombuffer(spaced.buffers()[2], np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        cut = np.zeros(len(data), bool)
        if self.apart:
            space = data == SPACE
            cut[1:-1] = space[1:-1] & ~space[:-2] & self.opens[data[2:]]
        cut[at[:-1]] = True
        starts = np.append(np.flatnonzero(cut), len(data)).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        which = self.places(chunks.dictionary.to_pylist())[chunks.indices.to_numpy()]
        chunk_at = np.searchsorted(starts, at)
        sides = []
        for side in (0, 1):
            start = self.at[side][which]
            size = self.at[side][which + 1] - start
            ids = self.flat[side][ragged(start, size)].astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(size)])
            sides.append((ids, np.diff(ends[chunk_at])))
        (a, n_a), (b, n_b) = sides
        width = np.diff(at)
        odd = np.add.reduceat(~self.fits[which], chunk_at[:-1])
        bad = [i for i in np.flatnonzero(odd) if not self.spells(data[at[i] : at[i + 1]].tobytes(), a, n_a, b, n_b, i)]
        if bad:
            good = np.ones(len(texts), bool)
            good[bad] = False
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b, width = n_a * good, n_b * good, width * good
        return a, b, n_a, n_b, width

    def spells(self, text: bytes, a, n_a, b, n_b, i: int) -> bool:
        """Whether the tokens of text ``i`` spell it as a whole, though some chunk's do not."""
        mine, theirs = a[n_a[:i].sum() :][: n_a[i]], b[n_b[:i].sum() :][: n_b[i]]
        return b"".join([self.a_bytes[k] for k in mine]) == text and b"".join([self.b_bytes[k] for k in theirs]) == text


def groups(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The group of each token of both sides, by pointer jumping, and the byte at which each group ends.

    ``a_end`` and ``b_end`` are ascending end offsets over the same bytes, the last of each being their number.
    """
    n_a, n_b = len(a_end), len(b_end)
    if not n_a or not n_b:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def covering(ends: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The token of ``ends`` that covers the last byte of each of ``others``."""
        mark = np.zeros(ends[-1] + 1, np.int32)
        mark[ends] = 1
        return np.cumsum(mark, dtype=np.int64)[others - 1]

    to_b, to_a = covering(b_end, a_end), covering(a_end, b_end)
    last = a_end[to_a] == b_end
    successor = np.concatenate([n_a + to_b, np.where(last, n_a + np.arange(n_b), to_a)])
    live = np.arange(n_a + n_b)
    while len(live):
        now = successor[live]
        doubled = successor[now]
        moved = doubled != now
        live = live[moved]
        successor[live] = doubled[moved]
    number = np.cumsum(last) - 1
    label = number[successor - n_a]
    return label[:n_a], label[n_a:], b_end[last]


def products(a_group, a_id, a_times, b_group, b_id, b_times, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of entries of one group: group, both ids, times. Entries are in the order of their groups."""
    n_a, n_b = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
    a_at, b_at = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    n = n_a * n_b
    group = np.repeat(np.arange(n_groups), n)
    inside = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    i = a_at[group] + inside // n_b[group]
    j = b_at[group] + inside % n_b[group]
    return group, a_id[i], b_id[j], a_times[i] * b_times[j]


def collapsed(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id) in order, and how often each occurs."""
    base = int(ids.max(initial=0)) + 1
    key, times = np.unique(group * base + ids, return_counts=True)
    return key // base, key % base, times


def linked_pairs(a, b, a_group, b_group, doc_of_group, n_second: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, pair) in order, the pair as ``a * n_second + b``, and the number of its links."""
    n_groups = len(doc_of_group)
    size = np.bincount(a_group, minlength=n_groups) * np.bincount(b_group, minlength=n_groups)
    large = size > PLAIN_PAIRS
    base = int(a.max(initial=0) + 1) * n_second
    parts = []
    for some in (~large, large):
        if not some.any():
            continue
        rank = np.cumsum(some) - 1
        in_a, in_b = some[a_group], some[b_group]
        ga, gb, ia, ib = rank[a_group[in_a]], rank[b_group[in_b]], a[in_a], b[in_b]
        if some is large:
            (ga, ia, ta), (gb, ib, tb) = collapsed(ga, ia), collapsed(gb, ib)
        else:
            ta, tb = np.ones(len(ia), np.int64), np.ones(len(ib), np.int64)
        group, x, y, times = products(ga, ia, ta, gb, ib, tb, int(some.sum()))
        key = doc_of_group[some][group] * base + x * n_second + y
        if some is large:
            parts.append((key, times))
        else:
            key = np.sort(key)
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
            parts.append((key[first], np.diff(np.append(first, len(key)))))
    if not parts:
        return (np.empty(0, np.int64),) * 3
    key, times = parts[0]
    if len(parts) == 2:
        key, place = np.unique(np.concatenate([parts[0][0], parts[1][0]]), return_inverse=True)
        merged = np.zeros(len(key), np.int64)
        np.add.at(merged, place, np.concatenate([parts[0][1], parts[1][1]]))
        times = merged
    return key // base, key % base, times


def group_digests(both: TwoTokenizers, a, b, a_group, b_group, n_a, n_b) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each text; '' where there are no tokens."""
    n_groups = int(a_group[-1]) + 1 if len(a_group) else 0
    per_a, per_b = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
    ends = np.cumsum(per_a), np.cumsum(per_b)
    order = np.empty(len(a) + len(b), np.int64)
    closes_a, closes_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    closes_a[ends[0] - 1], closes_b[ends[1] - 1] = 1, 1
    order[np.arange(len(a)) + (ends[1] - per_b)[a_group]] = 2 * a + closes_a
    order[np.arange(len(b)) + ends[0][b_group]] = 2 * (len(both.a_bytes) + b) + closes_b
    line = both.printed.take(pa.array(order))
    offsets = np.frombuffer(line.buffers()[1], np.int32)[line.offset :]
    data = memoryview(line.buffers()[2]) if len(order) else memoryview(b"")
    cut = np.concatenate([[0], np.cumsum(n_a + n_b)])
    edge = offsets[cut].tolist() if len(order) else [0] * len(cut)
    return [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(edge[:-1], edge[1:])]


def packed(values: np.ndarray, at: np.ndarray) -> list[bytes]:
    return [values[x:y].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist())]


DIGEST = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
ALIGNED = f"block long, {DIGEST}, pairs binary, times binary"


def _read_tokenizers(first: str, second: str) -> TwoTokenizers:
    """Loaded once in each Python worker."""
    key = first, second
    if key not in _loaded:
        _loaded[key] = TwoTokenizers(first, second)
    return _loaded[key]


_loaded: dict[tuple[str, str], TwoTokenizers] = {}


def aligned_batch(both: TwoTokenizers, texts: pa.Array) -> dict[str, list | np.ndarray]:
    """The columns of ``DIGEST`` for each text, and its distinct pairs with their numbers of links, packed as differences."""
    n = len(texts)
    live = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False))
    a, b, n_a, n_b, width = both.tokens(texts.take(pa.array(live))) if len(live) else (np.empty(0, np.int64),) * 5
    a_group, b_group, end = groups(np.cumsum(both.a_size[a]), np.cumsum(both.b_size[b]))
    doc_of_group = np.searchsorted(np.cumsum(width), end, side="left")
    links = np.bincount(a_group, minlength=len(end)) * np.bincount(b_group, minlength=len(end))
    doc, pair, times = linked_pairs(a, b, a_group, b_group, doc_of_group, len(both.b_bytes))
    at = np.searchsorted(doc, np.arange(len(live) + 1))
    step = np.diff(pair, prepend=0)
    first = at[:-1][np.diff(at) > 0]
    step[first] = pair[first]
    out = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    out["n_a"][live], out["n_b"][live] = n_a, n_b
    out["n_groups"][live] = np.bincount(doc_of_group, minlength=len(live))
    out["n_links"][live] = np.diff(np.concatenate([[0], np.cumsum(links)])[np.searchsorted(doc_of_group, np.arange(len(live) + 1))])
    out |= {"groups_sha256": [""] * n, "pairs": [b""] * n, "times": [b""] * n}
    cells = zip(group_digests(both, a, b, a_group, b_group, n_a, n_b), packed(step.astype(np.int64), at), packed(times.astype(np.int64), at))
    for i, (digest, p, t) in zip(live.tolist(), cells):
        out["groups_sha256"][i], out["pairs"][i], out["times"][i] = digest, p, t
    return out


def aligned_pieces(both: TwoTokenizers, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, dict[str, list | np.ndarray]]]:
    """Slices of a batch beside their aligned columns, so that memory follows neither the batch nor the number of its rows."""
    for part in text_pieces(batch, most=PIECE_BYTES):
        yield part, aligned_batch(both, part.column("text"))


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", first: str = FIRST, second: str = SECOND, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``key``, the ``DIGEST`` columns, its ``block`` and its distinct linked id pairs with
    the number of links of each (``pairs``, ``times``: packed 64-bit integers, pairs as differences)."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    ddl = f"key {own.schema['key'].dataType.simpleString()}, {ALIGNED}"
    schema = arrow_schema(ddl)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, done = _read_tokenizers(first, second), 0
        task = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, out in aligned_pieces(both, batch):
                block = np.full(part.num_rows, task + done // block_bytes)
                done += int(pc.sum(pc.binary_length(part.column("text"))).as_py() or 0)
                columns = {"key": part.column("key"), "block": block} | out
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name != "key" else columns["key"].cast(f.type) for f in schema], schema=schema)

    return own.mapInArrow(each, ddl).withColumnRenamed("key", key)


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The integers of a column of packed rows, and where each row's start."""
    cells = column.to_pylist()
    at = np.concatenate([[0], np.cumsum([len(c) >> 3 for c in cells])]).astype(np.int64)
    return np.frombuffer(b"".join(cells), np.int64), at


def summed(steps: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Differences back to values, row by row."""
    total = np.cumsum(steps)
    return total - np.repeat(np.concatenate([[0], total])[at[:-1]], np.diff(at))


def block_pairs(aligned: DataFrame) -> DataFrame:
    """``block``, ``pair``, ``n``: how many documents of each block hold a pair."""
    schema = arrow_schema("block long, pair long, n long")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_pieces(batch, "pairs", 16_000_000):
                steps, at = unpacked(part.column("pairs"))
                pair = summed(steps, at)
                block = np.repeat(part.column("block").to_numpy(), np.diff(at))
                for one in np.unique(block):
                    found, n = np.unique(pair[block == one], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), one)), pa.array(found), pa.array(n)], schema=schema)

    return aligned.select("block", "pairs").mapInArrow(each, "block long, pair long, n long").groupBy("block", "pair").agg(F.sum("n").alias("n"))


def pair_counts(pairs: DataFrame, n_second: int) -> DataFrame:
    """``pair``, ``count``: the documents that hold it, and ``top``: no pair with the same first id has more."""
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.floor(F.col("pair") / n_second))
    return counts.join(counts.groupBy("a").agg(F.max("count").alias("most")), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("top"))


def scored(aligned: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """``key``, the ``DIGEST`` columns, ``n_best`` and ``count_sum`` of every aligned document.

    ``counts`` has the rows ``block, pair, count, top`` a block needs. They come before its documents, which then pass one batch at a time.
    """
    digest = [c.split()[0] for c in DIGEST.split(", ")]
    own = aligned.schema[key].dataType.simpleString()
    ddl = f"key {own}, {DIGEST}, n_best long, count_sum long"
    schema = arrow_schema(ddl)
    none = {c: F.lit(None).cast(aligned.schema[c].dataType) for c in (key, *digest, "pairs", "times")}
    wanted = counts.select("block", F.lit(0).alias("kind"), "pair", "count", "top", *(none[c].alias(f"d{i}") for i, c in enumerate(none)))
    empty = [F.lit(None).cast("long").alias("pair"), F.lit(None).cast("long").alias("count"), F.lit(None).cast("boolean").alias("top")]
    documents = aligned.select("block", F.lit(1).alias("kind"), *empty, *(F.col(c).alias(f"d{i}") for i, c in enumerate(none)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, got, table = None, [], None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            kinds = batch.column("kind").to_numpy()
            edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            for x, y in zip([0, *edges.tolist()], [*edges.tolist(), len(blocks)]):
                if x == y:
                    continue
                if blocks[x] != block:
                    block, got, table = blocks[x], [], None
                part = batch.slice(x, y - x)
                if kinds[x] == 0:
                    got.append([part.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "count", "top")])
                    continue
                if table is None:
                    table = [np.concatenate(c) for c in zip(*got)] if got else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]
                for some in text_pieces(part, "d6", 16_000_000):
                    yield finished(some, table)

    def finished(part: pa.RecordBatch, table: list[np.ndarray]) -> pa.RecordBatch:
        steps, at = unpacked(part.column("d6"))
        times, _ = unpacked(part.column("d7"))
        place = np.searchsorted(table[0], summed(steps, at))
        best = np.concatenate([[0], np.cumsum(times * table[2][place])])
        total = np.concatenate([[0], np.cumsum(times * table[1][place])])
        sums = [pa.array(np.diff(s[at])) for s in (best, total)]
        return pa.RecordBatch.from_arrays([*(part.column(f"d{i}") for i in range(6)), *sums], schema=schema)

    both = documents.union(wanted).repartition("block").sortWithinPartitions("block", "kind", "pair")
    return both.mapInArrow(each, ddl).withColumnRenamed("key", key)


def alignment_digest(docs: DataFrame, key: str = "doc_id", text: str = "text", first: str = FIRST, second: str = SECOND, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``, a row per row of ``docs``."""
    n_second = len(_read_tokenizers(first, second).b_bytes)
    aligned = kept_table(align(docs, key, text, first, second, block_bytes), "aligned")
    pairs = kept_table(block_pairs(aligned), "block_pairs")
    wanted = pairs.join(pair_counts(pairs, n_second), "pair").select("block", "pair", "count", "top")
    return scored(aligned, wanted, key).select(key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
