from __future__ import annotations

import binascii
import itertools
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from panelloom.llm import spelling
from panelloom.llm.queries import QUERIES
from tests.llm.helpers import DOCS, docs, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(pairs):
    count = Counter()
    for key, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = binascii.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(words):
    near = {w: set() for w in words}
    if len(words) <= 1500:
        for a, b in itertools.combinations(words, 2):
            if one_edit(a, b):
                near[a].add(b)
                near[b].add(a)
    else:  # the same by all strings with one code point left out
        rest = {}
        for w in words:
            for i in range(len(w)):
                rest.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
                if w[:i] + w[i + 1 :] in words:
                    near[w].add(w[:i] + w[i + 1 :])
                    near[w[:i] + w[i + 1 :]].add(w)
        for group in rest.values():
            for a, b in itertools.combinations(group, 2):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None
    return out


def got(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows(df)}


def test_words_are_thinned_and_counted(spark):
    rng = random.Random(2)
    some = ["garantie", "Garantie", "ÉLÉPHANT", "éléphant", "short", "x" * 40, "naïveté", "d×e÷fghij", "straße7straße", "forty-seven", "ÿÿÿÿÿÿÿÿ", "日本日本日本日"]
    pairs = [(i, " ".join(rng.choice(some) for _ in range(30))) for i in range(80)] + [(5, None), (6, ""), (None, "garantie garantie"), (3, "naïveté"), (3, "naïveté")]
    found = rows(spelling.corpus_words(docs(spark, pairs).withColumn("word", F.lit(1)).withColumn("n", F.lit(2)), least_count=1))
    want = plain_words(pairs)
    assert {r["word"]: r["n"] for r in found if r["n"] >= 2} == want
    assert any(len(w) == 7 and w not in " ".join(some).lower() for w in want)


def test_forms_equal_all_pairs(spark):
    rng = random.Random(11)
    letters = "abé"
    words = {}
    while len(words) < 700:
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(7, 11)))
        words[w] = rng.choice([2, 3, 20, 30, 200, 2000, 30000])
    words |= {"aaaaaaa": 5, "aaaaaaaa": 50, "aaaaaaaaa": 500, "aaaaaaaaaa": 5000, "ababababab": 7, "bababababa": 7, "zzzzzzz": 2}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(7)
    want = plain_forms(words)
    assert got(spelling.spelling_forms(df)) == want
    assert max(len(w) for w in want) > 8 and any(f and want[f][0] for f, *_ in want.values())  # chains of forms


def test_chain_is_followed_to_its_end(spark):
    words = {"a" * (7 + i): 2 * 10**i for i in range(8)}
    found = got(spelling.spelling_forms(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert {r[1] for r in found.values()} == {"a" * 14}


def test_ties_take_the_smallest_and_ten_times_is_enough(spark):
    words = {"zabcdefg": 20, "zabcdefé": 20, "zabcdef": 2, "zabcdefgé": 2, "zabcdefh": 21}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    found = got(spelling.spelling_forms(df))
    assert found["zabcdef"][0] == "zabcdefh" and found["zabcdefgé"][0] == "zabcdefg" and found["zabcdefg"][0] is None
    assert found == plain_forms(words)


def test_pivots_are_disjoint_and_cheapest():
    rng = random.Random(8)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randrange(3, 8)))
        weight = [rng.randrange(1, 20) for _ in places]
        a, b = spelling.pivots(places, weight)
        best = min(weight[i] + weight[j] for i, j in itertools.combinations(range(len(places)), 2) if places[j] - places[i] >= 2)
        assert places[b] - places[a] >= 2 and weight[a] + weight[b] == best


def test_empty(spark):
    assert rows(spelling.corpus_spellings(spark.createDataFrame([], DOCS))) == []
    assert rows(spelling.corpus_spellings(docs(spark, [None, "", "one of each"]))) == []


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op11_spelling_variants"](spark, folder)) == plain_forms(plain_words(pairs))
