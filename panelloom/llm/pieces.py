"""SentencePiece segmentations, sampled without replacement and decoded exactly.

A space becomes the mark U+2581, and a text starts with one; pieces hold the mark only in front, so
the lattice of a text is the chain of the lattices of its units (a mark and what follows it). A
segmentation has the product of its pieces' probabilities, normalised over all segmentations of the
text. Each segmentation is thought to be perturbed by a Gumbel of its own, and the ``samples`` largest
are wanted: sampling without replacement. They are found by A* from the root of the lattice: a node
(a prefix) is worth the largest perturbed value below it, which is a Gumbel at the log mass of the
node. Expanding a node hands its value to one child, drawn by mass; every other child gets a Gumbel
truncated at that value and waits. The best waiting node is always expanded next, so its value is
the next largest of all. Rows advance together in arrays; words that occur often share a lattice.

A waiting node's value is at most its log mass plus 23 (the smallest exponential that 32 bits can
give), so nodes too light to come up are never drawn; the bound is checked and widened per row.

``log_inclusion`` is the log probability that the segmentation is among those kept, given the
threshold, the value of the first one left out. All draws come from a hash of the row key, the sample and the place.

Piece probabilities follow the rank of a piece in the vocabulary; no tokenizer is trained. Characters
without a piece, and U+2581 itself, are spelled in byte pieces.

Nulls: a null text is an empty one: a single segmentation without pieces. Texts with fewer than ``samples``
segmentations give all they have. Rows with equal keys and texts get equal samples. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import HashIndex, mixed, small_batches, text_pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK, SPACE = 0x2581, 0x20
NO_CHARACTER = 0x110000
LIGHT = 23.0
PIECE_BYTES = 500_000
GOLD = 0x9E3779B97F4A7C15


class Vocabulary:
    """Pieces, their log probabilities and a table of all their prefixes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.byte = np.zeros(256, np.int64)
        pieces: dict[str, int] = {}
        self.surface: list[bytes] = [b""] * self.size
        for i in range(self.size):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(p[1:-1], 16)] = i
                self.surface[i] = bytes([int(p[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.surface[i] = p.replace(chr(MARK), " ").encode()
                if chr(MARK) not in p[1:]:
                    pieces[p] = i
        ordered = sorted(pieces.values())
        weight = 1.0 / (np.arange(len(ordered)) + 50.0)
        total = weight.sum() + 256.0 / (len(ordered) + 50.0)
        logs = dict(zip(ordered, np.log(weight / total)))
        self.byte_log = float(-np.log((len(ordered) + 50.0) * total))
        prefixes: dict[int, tuple[int, float]] = {}
        names: dict[int, str] = {}
        for p, i in sorted(pieces.items()):
            h = 0
            for n, ch in enumerate(p, 1):
                h = int(step_hash(np.array([h], np.uint64), np.array([ord(ch)], np.uint64))[0])
                if names.setdefault(h, p[:n]) != p[:n]:
                    raise ValueError("two prefixes share a hash")
                prefixes.setdefault(h, (-1, 0.0))
            prefixes[h] = (i, logs[i])
        keys = sorted(prefixes)
        self.index = HashIndex(np.array(keys, np.uint64))
        self.piece = np.array([prefixes[k][0] for k in keys], np.int64)
        self.log = np.array([prefixes[k][1] for k in keys])
        self.longest = max(map(len, pieces))
        flat = b"".join(self.surface)
        self.bytes = np.frombuffer(flat, np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(s) for s in self.surface])])


def step_hash(h: np.ndarray, cp: np.ndarray) -> np.ndarray:
    return mixed(h * np.uint64(GOLD) + cp + np.uint64(1))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    total = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - np.repeat(total - starts, counts)


class Lattices:
    """The lattices of distinct units, as one graph: nodes in a row, edges by node, the longest piece first.

    ``chars`` are the units' code points one after the other, ``at`` their starts (one more than units).
    Node ``at[u] + u + j`` stands after j characters of unit u.
    """

    def __init__(self, vocabulary: Vocabulary, chars: np.ndarray, at: np.ndarray):
        units = len(at) - 1
        size = np.diff(at)
        unit = np.repeat(np.arange(units), size)
        node = np.arange(len(chars)) + unit
        left = np.repeat(at[1:], size) - np.arange(len(chars))
        self.first_node = at[:-1] + np.arange(units)
        self.last_node = at[1:] + np.arange(units)
        cp = chars.astype(np.uint64)
        live, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        by_length = []
        alone = np.zeros(len(chars), bool)
        for n in range(1, vocabulary.longest + 1):
            inside = left.take(live) >= n
            live, h = live[inside], h[inside]
            if not len(live):
                break
            h = step_hash(h, cp.take(live + (n - 1)))
            k = vocabulary.index.find(h)
            found = k >= 0
            live, h, k = live[found], h[found], k[found]
            piece = vocabulary.piece.take(k)
            whole = piece >= 0
            by_length.append((live[whole], n, piece[whole], vocabulary.log.take(k[whole])))
            if n == 1:
                alone[live[whole]] = True
        spelled = np.flatnonzero(~alone)
        point = np.where(chars[spelled] == NO_CHARACTER, MARK, chars[spelled]).astype(np.int64)
        bytes_ = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
        by_length.append((spelled, 1, vocabulary.size + point, vocabulary.byte_log * bytes_))
        # a place has one edge of a length at most: edges fall into their node's part, the longest first
        nodes = len(chars) + units
        count = np.zeros(nodes, np.int64)
        for src, *_ in by_length:
            count[node.take(src)] += 1
        self.edge_at = np.concatenate([[0], np.cumsum(count)])
        edges = int(self.edge_at[-1])
        self.begin, self.end, self.piece, self.share = np.empty(edges, np.int64), np.empty(edges, np.int64), np.empty(edges, np.int64), np.empty(edges)
        free = self.edge_at[:-1].copy()
        for src, n, piece, log in reversed(by_length):
            begin = node.take(src)
            place = free.take(begin)
            free[begin] += 1
            self.begin[place], self.end[place], self.piece[place], self.share[place] = begin, begin + n, piece, log
        # log masses from the ends of the units backwards, all nodes at one distance together
        mass = np.zeros(nodes)
        longest_first = np.argsort(-size, kind="stable")
        ends = self.last_node[longest_first]
        as_long = np.cumsum(np.bincount(size)[::-1])[::-1] if units else [0]  # units of a size or more
        for far in range(1, len(as_long)):
            here = ends[: as_long[far]] - far
            n = count.take(here)
            which = ragged(self.edge_at.take(here), n)
            mass[here] = np.logaddexp.reduceat(self.share.take(which) + mass.take(self.end.take(which)), np.cumsum(n) - n)
        self.share += mass.take(self.end) - mass.take(self.begin)
        total = np.cumsum(np.exp(self.share))
        base = np.concatenate([[0.0], total])[self.edge_at[:-1]]
        self.upto = total - base.take(self.begin)
        self.upto[self.edge_at[1:][count > 0] - 1] = np.inf  # the last edge takes what rounding leaves


def uniform(key: np.ndarray) -> np.ndarray:
    """In (0, 1), on a grid of 2 ** -53."""
    return ((mixed(key) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def exponential(key: np.ndarray) -> np.ndarray:
    """Of rate 1, from a grid of 2 ** -32: never below exp(-LIGHT)."""
    return -np.log(((mixed(key) >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32)


class Batch:
    """The texts of one batch: rows of units, and their sampled paths."""

    def __init__(self, vocabulary: Vocabulary, texts: list[str], keys: np.ndarray):
        self.vocabulary, self.keys = vocabulary, keys
        full = [" " + t if t else "" for t in texts]
        cp = np.frombuffer("".join(full).encode("utf-32-le"), np.uint32)
        cp = np.where(cp == MARK, np.uint32(NO_CHARACTER), np.where(cp == SPACE, np.uint32(MARK), cp))
        sizes = np.array([len(t) for t in full], np.int64)
        starts = np.flatnonzero(cp == MARK)
        row_at = np.concatenate([[0], np.cumsum(sizes)])
        self.occ_at = np.searchsorted(starts, row_at)  # occurrences of units of each row
        ends = np.append(starts[1:], len(cp)) if len(starts) else starts
        within = np.arange(len(cp)) - np.repeat(starts, ends - starts)
        one = mixed((cp.astype(np.uint64) << np.uint64(32)) + within.astype(np.uint64))
        name = np.add.reduceat(one, starts) if len(starts) else np.empty(0, np.uint64)
        _, first, self.unit = np.unique(name, return_index=True, return_inverse=True)
        size = (ends - starts)[first] if len(first) else np.empty(0, np.int64)
        self.graph = Lattices(vocabulary, cp[ragged(starts[first], size)] if len(first) else cp[:0], np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.occ_at))
        self.rows = len(texts)

    def draw(self, sample: int, node: np.ndarray, occ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges from ``node`` to the end of each occurrence's unit, by mass; and how many each occurrence got."""
        g = self.graph
        last = g.last_node[self.unit[occ]]
        place = (occ - self.occ_at[self.row[occ]]).astype(np.uint64)
        key = mixed(self.keys[self.row[occ]] + np.uint64(GOLD * (sample + 1) % 2**64)) + place * np.uint64(0xD1B54A32D192ED03)
        live = np.flatnonzero(node != last)
        node = node.copy()
        got = np.zeros(len(occ), np.int64)
        taken = []
        step = 0
        while len(live):
            e = g.edge_at[node[live]]
            u = uniform(key[live] + np.uint64(0x8CB92BA72F3D8DD7 * (step + 1) % 2**64))
            more = np.flatnonzero(g.upto[e] < u)
            while len(more):
                e[more] += 1
                more = more[g.upto[e[more]] < u[more]]
            taken.append((live, e))
            got[live] += 1
            node[live] = g.end[e]
            live = live[node[live] != last[live]]
            step += 1
        at = np.cumsum(got) - got
        out = np.empty(got.sum(), np.int64)
        for s, (who, e) in enumerate(taken):
            out[at[who] + s] = e
        return out, got

    def waiting(self, path: np.ndarray, path_at: np.ndarray, fixed: np.ndarray, value: np.ndarray, sample: int, wanted: int, rows: np.ndarray):
        """The ``wanted`` best siblings of each row's path beyond its first ``fixed`` edges, as (row, value, step, edge).

        Nodes are looked at in the order of the path, ``reach`` steps and down to a log mass of ``floor``, both widened
        for the rows where a node beyond them could still come up.
        """
        g = self.graph
        counts = np.diff(path_at)
        floor, reach = -30.0, 1_024
        left, found = np.arange(len(rows)), []
        while len(left):
            taken = np.minimum(counts[left], reach)
            at = ragged(path_at[left], taken)
            edge_on = path.take(at)
            of = np.repeat(np.arange(len(left)), taken)
            start = np.cumsum(taken) - taken
            total = np.cumsum(g.share.take(edge_on))
            before = np.concatenate([[0.0], total])[:-1]
            before -= before.take(np.minimum(start, max(len(before) - 1, 0))).take(of) if len(before) else 0.0
            step = np.arange(len(at)) - start.take(of)
            heavy = before >= floor
            todo = np.flatnonzero(heavy & (step >= fixed[left].take(of)))
            begin = g.begin.take(edge_on.take(todo))
            n = g.edge_at.take(begin + 1) - g.edge_at.take(begin)
            edge, node = ragged(g.edge_at.take(begin), n), np.repeat(todo, n)
            other = edge != edge_on.take(node)
            node, edge = node[other], edge[other]
            mu, r = before.take(node) + g.share.take(edge), of.take(node)
            row = left.take(r)
            key = mixed(self.keys[rows[row]] ^ np.uint64(GOLD * (2 * sample + 1) % 2**64)) + step.take(node).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
            e = exponential(mixed(key) + (edge - g.edge_at.take(g.begin.take(edge))).astype(np.uint64))
            x = mu - np.log(np.exp(np.minimum(mu - value.take(row), 700.0)) + e)
            order = np.lexsort((-x, r))
            r, x, s, edge = r[order], x[order], step.take(node)[order], edge[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            best = rank < wanted
            r, x, s, edge, rank = r[best], x[best], s[best], edge[best], rank[best]
            # a row is settled if all its nodes were drawn, or its last wanted value beats any node left out
            all_heavy = np.bincount(of[heavy], minlength=len(left)) == taken
            worst = np.full(len(left), -np.inf)
            full = rank == wanted - 1
            worst[r[full]] = x[full]
            settled = (all_heavy & (taken == counts[left])) | (~all_heavy & (worst >= floor + LIGHT))
            take = settled[r]
            found.append((rows[left[r[take]]], x[take], s[take], edge[take]))
            left = left[~settled]
            floor, reach = 2 * floor, 4 * reach
        empty = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))
        return tuple(np.concatenate(c) for c in zip(*found)) if found else empty

    def samples(self, k: int):
        """For each sample: the rows that have it, edges of all of them, where each row's start, and values; at last the thresholds."""
        g = self.graph
        occ = np.arange(len(self.unit))
        path, got = self.draw(0, g.first_node[self.unit], occ)
        counts = np.bincount(self.row, got, self.rows).astype(np.int64)
        rows = np.arange(self.rows)
        value = -np.log(-np.log(uniform(self.keys)))
        fixed = np.zeros(self.rows, np.int64)
        got_by_occ = [got]
        paths = [(rows, path, np.concatenate([[0], np.cumsum(counts)]))]
        queue = tuple(np.empty(0, t) for t in (np.int64, np.float64, np.int64, np.int64, np.int64))
        for s in range(k):
            rows, path, at = paths[s]
            new = self.waiting(path, at, fixed, value, s, k - s, rows) if len(path) else tuple(c[:0] for c in queue[:4])
            queue = tuple(np.concatenate([a, b]) for a, b in zip(queue, (*new, np.full(len(new[0]), s))))
            order = np.lexsort((-queue[1], queue[0]))
            queue = tuple(c[order] for c in queue)
            top = np.flatnonzero(np.concatenate([[True], queue[0][1:] != queue[0][:-1]])) if len(queue[0]) else np.empty(0, np.int64)
            if s == k - 1:
                threshold = np.full(self.rows, -np.inf)
                threshold[queue[0][top]] = queue[1][top]
                return paths, threshold
            rows, value, fixed, edge, base = (c[top] for c in queue)
            rest = np.ones(len(queue[0]), bool)
            rest[top] = False
            queue = tuple(c[rest] for c in queue)
            paths.append(self.branch(s + 1, paths, got_by_occ, rows, fixed, edge, base))
            fixed = fixed + 1
        raise AssertionError

    def branch(self, sample: int, paths, got_by_occ, rows, step, edge, base):
        """New paths: a path's first ``step`` edges, then ``edge``, then fresh draws."""
        g = self.graph
        head = np.empty(len(rows), np.int64)
        occ = np.empty(len(rows), np.int64)
        source = np.concatenate([p for _, p, _ in paths])
        shift = np.cumsum([0] + [len(p) for _, p, _ in paths])
        for b in range(len(paths)):
            mine = np.flatnonzero(base == b)
            if not len(mine):
                continue
            has, _, at = paths[b]
            where = np.searchsorted(has, rows[mine])
            head[mine] = shift[b] + at[where]
            ends = np.cumsum(got_by_occ[b])  # edges up to and with each occurrence, over the rows of that sample
            occ_rows = self.occ_of(has)
            first = at[where]
            occ[mine] = occ_rows[np.searchsorted(ends, first + step[mine], side="right")]
        prefix = source[ragged(head, step)]
        # what is drawn anew: the rest of the branching unit, and all units after it
        counts = self.occ_at[rows + 1] - occ
        again = ragged(occ, counts)
        node = g.first_node[self.unit[again]]
        opening = np.cumsum(counts) - counts
        node[opening] = g.end[edge]
        tail, got = self.draw(sample, node, again)
        tail_n = np.add.reduceat(got, opening) if len(opening) else np.empty(0, np.int64)
        sizes = step + 1 + tail_n
        at = np.concatenate([[0], np.cumsum(sizes)])
        path = np.empty(at[-1], np.int64)
        path[ragged(at[:-1], step)] = prefix
        path[at[:-1] + step] = edge
        path[ragged(at[:-1] + step + 1, tail_n)] = tail
        per_occ = self.count_by_occ(path, at, rows)
        got_by_occ.append(per_occ)
        return rows, path, at

    def occ_of(self, rows: np.ndarray) -> np.ndarray:
        return ragged(self.occ_at[rows], self.occ_at[rows + 1] - self.occ_at[rows])

    def count_by_occ(self, path: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Edges of each occurrence: a unit is over where an edge reaches a last node."""
        g = self.graph
        is_last = np.zeros(len(g.edge_at), bool)
        is_last[g.last_node] = True
        over = np.flatnonzero(is_last[g.end[path]])
        return np.diff(np.concatenate([[-1], over]))

    def spelled(self, path: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids, characters without a piece in bytes; and where each row's start."""
        ids = self.graph.piece[path]
        v = self.vocabulary
        rare = np.flatnonzero(ids >= v.size)
        if not len(rare):
            return ids, at
        codes, which = np.unique(ids[rare], return_inverse=True)
        spelled = [v.byte[np.frombuffer(chr(c - v.size).encode(), np.uint8)] for c in codes.tolist()]
        width = np.array([len(x) for x in spelled])
        n = np.ones(len(ids), np.int64)
        n[rare] = width[which]
        end = np.concatenate([[0], np.cumsum(n)])
        out = np.empty(end[-1], np.int64)
        plain = ids < v.size
        out[end[:-1][plain]] = ids[plain]
        flat, flat_at = np.concatenate(spelled), np.cumsum(width) - width
        out[ragged(end[rare], width[which])] = flat[ragged(flat_at[which], width[which])]
        return out, end[at]


def decoded(vocabulary: Vocabulary, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The texts of rows of piece ids: surfaces one after the other, without the space in front."""
    size = np.diff(vocabulary.at)[ids]
    data = vocabulary.bytes[ragged(vocabulary.at[ids], size)].tobytes()
    cut = np.concatenate([[0], np.cumsum(size)])[at]
    return [data[a + 1 : b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


ENCODED = "key long, sample int, pieces array<int>, n_pieces int, log_prob double, log_inclusion double, exact boolean"


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = 2, model: str = MODEL, seed: int = 5, carry: str | None = None) -> DataFrame:
    """One row per row of ``docs`` and sample: ``key``, ``sample`` (1 is the largest perturbed one), ``pieces``, ``n_pieces``,
    ``log_prob`` and ``log_inclusion`` (natural logs), ``exact``: the pieces decode to the text byte by byte. ``carry`` names a column of longs that
    every row keeps."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))  # as large as the vocabulary

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            for piece in text_pieces(batch, most=PIECE_BYTES):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                doc = piece.column("key")
                b = Batch(vocabulary, texts, piece.column("draw").to_numpy(zero_copy_only=False).view(np.uint64))
                paths, threshold = b.samples(samples)
                raw = [t.encode() for t in texts]
                for s, (rows, path, at) in enumerate(paths):
                    total = np.concatenate([[0.0], np.cumsum(b.graph.share[path])])
                    log = total[at[1:]] - total[at[:-1]]
                    z = log - threshold[rows]
                    with np.errstate(over="ignore", divide="ignore"):
                        inclusion = np.where(z < -30, z, np.log(-np.expm1(-np.exp(np.maximum(z, -30)))))
                    ids, ends = b.spelled(path, at)
                    same = [x == raw[r] for x, r in zip(decoded(vocabulary, ids, ends), rows.tolist())]
                    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                    n = len(rows)
                    kept = [piece.column("carried").take(pa.array(rows))] if carry else []
                    yield pa.RecordBatch.from_arrays(
                        [doc.take(pa.array(rows)), pa.array(np.full(n, s + 1, np.int32)), lists, pa.array(np.diff(ends).astype(np.int32)), pa.array(log), pa.array(inclusion), pa.array(same, pa.bool_()), *kept],
                        names=["key", "sample", "pieces", "n_pieces", "log_prob", "log_inclusion", "exact", *(["carried"] if carry else [])],
                    )

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.lit(seed)).alias("draw"), *([F.col(carry).cast("long").alias("carried")] if carry else []))
    out = rows.mapInArrow(each, ENCODED + (", carried long" if carry else "")).withColumnRenamed("key", key)
    return out.withColumnRenamed("carried", carry) if carry else out


def decode(encoded: DataFrame, pieces: str = "pieces", out: str = "text", model: str = MODEL) -> DataFrame:
    """``encoded`` with the text of its pieces; null pieces have a null text, ids out of range are refused."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model))

    @F.pandas_udf("string")
    def text(lists):
        import pandas as pd

        v = shared.value
        return pd.Series([None if x is None else b"".join([v.surface[i] for i in x])[1:].decode() for x in lists], dtype=object)

    return encoded.withColumn(out, text(F.col(pieces)))
