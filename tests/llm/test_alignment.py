from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelloom.llm import alignment
from panelloom.llm.queries import QUERIES
from tests.llm.helpers import DOCS, docs, rows


@pytest.fixture(scope="module")
def tokenizers():
    first = Tokenizer.from_file(alignment.FIRST)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=alignment.SECOND)


def byte_table():
    """The byte of each letter, by the definition of the byte-level alphabet."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def plain_tokens(tokenizers, text):
    """Ids and bytes of both sides of a whole text; none where they do not spell it."""
    first, second = tokenizers
    if not text:
        return [], [], [], []
    table, spelled = byte_table(), (" " + text).encode()
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    of_a = [bytes(table[c] for c in first.id_to_token(i)) for i in a]
    of_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(second.id_to_piece, b)]
    if b"".join(of_a) != spelled or b"".join(of_b) != spelled:
        return [], [], [], []
    return a, b, of_a, of_b


def plain_groups(of_a, of_b):
    """Groups as lists of token indices, by walking both sides."""
    ends_a, ends_b = np.cumsum([len(x) for x in of_a]).tolist(), np.cumsum([len(x) for x in of_b]).tolist()
    both, out, i, j = sorted(set(ends_a) & set(ends_b)), [], 0, 0
    for end in both:
        x, y = i, j
        while i < len(ends_a) and ends_a[i] <= end:
            i += 1
        while j < len(ends_b) and ends_b[j] <= end:
            j += 1
        out.append((range(x, i), range(y, j)))
    return out


def plain(tokenizers, pairs):
    found, count = [], Counter()
    for key, text in pairs:
        a, b, of_a, of_b = plain_tokens(tokenizers, text)
        groups = plain_groups(of_a, of_b) if a else []
        links = Counter()
        for x, y in groups:
            for (i, n), (j, m) in ((p, q) for p in Counter(a[i] for i in x).items() for q in Counter(b[j] for j in y).items()):
                links[i, j] += n * m
        count.update(links.keys())
        line = ";".join(",".join(str(a[i]) for i in x) + "|" + ",".join(str(b[j]) for j in y) for x, y in groups)
        found.append((key, a, b, groups, links, hashlib.sha256(line.encode()).hexdigest() if line else ""))
    best = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for key, a, b, groups, links, digest in found:
        n_best = sum(n for p, n in links.items() if count[p] == best[p[0]])
        out.append((key, len(a), len(b), len(groups), sum(links.values()), n_best, sum(n * count[p] for p, n in links.items()), digest))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r.values()) for r in rows(df)), key=repr)


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b c", "\n", "\n\n a\n b \n", "\t\tx", "it's what's  's 's", "don't  'll  x", "été Élan ÿ", "日本語 の テキスト 日本",
    "😀 😀😀 a😀b", "x\x85y z\xa0w", "a b  c", "▁ x", "x ▁y", "<|endoftext|> <s> </s> <unk> <0x41>", " <0x41>", "\x00 \x01", "a\r\nb\r c", "0123456789 12 345", "=" * 300 + " " + "-" * 77,
    " " * 500 + "x", "é" * 400, "नमस्ते दुनिया", "שלום עולם", "á é", "ﬁ ﬂ", "﻿x ﻿y", "foo.\nBar baz", "x " * 50, "a\x1cb \x1cc", "​ ​z", "ab" * 3000,
]


def test_equals_whole_text_encodings(spark, tokenizers):
    rng = random.Random(12)
    letters = "ab cd  e\n\té日😀'.=1▁ "
    pairs = list(enumerate(ODD)) + [(100 + i, "".join(rng.choice(letters) for _ in range(rng.randrange(1, 120)))) for i in range(120)]
    pairs += [(7, ODD[12]), (300, " ".join(ODD[12] for _ in range(400))), (None, "a null id")]
    df = docs(spark, pairs).repartition(5)
    want = plain(tokenizers, pairs)
    assert got(alignment.alignment_digest(df)) == want
    assert got(alignment.alignment_digest(df, block_bytes=200)) == want  # many blocks
    assert any(w[1] == 0 and w[0] is not None and w[0] in (19, 20) for w in want)  # texts that are not spelled


def test_columns_of_the_operator(spark):
    df = docs(spark, [(1, "two words"), (1, "two words"), (2, None)]).withColumn("block", F.lit("clash")).withColumn("pairs", F.lit(1))
    out = alignment.align(df)
    assert out.columns[0] == "doc_id" and {"n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "pairs", "times"} <= set(out.columns)
    digest = rows(alignment.alignment_digest(df))
    assert sorted(r["doc_id"] for r in digest) == [1, 1, 2]
    assert next(r for r in digest if r["doc_id"] == 1)["count_sum"] == 4  # two links, each in both repeated rows


def test_empty_table_and_other_key(spark):
    assert rows(alignment.alignment_digest(spark.createDataFrame([], DOCS))) == []
    named = spark.createDataFrame([("k", "text here")], "name string, body string")
    (row,) = rows(alignment.alignment_digest(named, "name", "body"))
    assert row["name"] == "k" and row["n_a"] > 0 and row["n_best"] == row["n_links"]


def test_pointer_jumping_labels_groups():
    rng = random.Random(3)
    for _ in range(200):
        total = rng.randrange(1, 60)
        ends = [sorted({total, *(rng.randrange(1, total + 1) for _ in range(rng.randrange(0, 30)))}) for _ in range(2)]
        a, b, cut = alignment.groups(np.array(ends[0]), np.array(ends[1]))
        both = sorted(set(ends[0]) & set(ends[1]))
        assert cut.tolist() == both
        assert a.tolist() == [next(k for k, e in enumerate(both) if e >= x) for x in ends[0]]
        assert b.tolist() == [next(k for k, e in enumerate(both) if e >= x) for x in ends[1]]


def test_large_groups_are_collapsed():
    a, b = np.array([3, 3, 4] * 40 + [9]), np.array([5, 6] * 30 + [1])
    ga, gb = np.array([0] * 120 + [1]), np.array([0] * 60 + [1])
    doc, pair, times = alignment.linked_pairs(a, b, ga, gb, np.array([0, 0]), 10)
    want = Counter((i, j) for i in a[:120].tolist() for j in b[:60].tolist()) + Counter([(9, 1)])
    assert dict(zip(zip((pair // 10).tolist(), (pair % 10).tolist()), times.tolist())) == dict(want) and set(doc) == {0}


def test_query_equals_brute_force(spark, tokenizers):
    folder = "/root/testdata/sf0.001"
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op12_tokenizer_alignment"](spark, folder)) == plain(tokenizers, pairs)


def test_a_batch_of_many_texts_is_aligned_in_small_pieces():
    """Two workers of an executor begin with full batches at once: their arrays must not follow the batch."""
    import tracemalloc

    import pyarrow as pa

    both = alignment._read_tokenizers(alignment.FIRST, alignment.SECOND)
    text = " ".join(f"word{i % 50} of a line" for i in range(500))
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 480)], names=["text"])  # about 4 MB
    whole = alignment.aligned_batch(both, batch.column("text"))
    tracemalloc.start()
    got = [out["groups_sha256"] for _, out in alignment.aligned_pieces(both, batch)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(got, []) == whole["groups_sha256"]
    tracemalloc.start()
    alignment.aligned_batch(both, batch.column("text"))
    all_at_once = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < all_at_once / 2
