"""Spelling variants of the words of a corpus: near words within one edit, found by pivotal grams.

Bigrams have one order over the corpus, the rarest first. A word's gram prefix are its three first bigrams in it, and
all others that equal the third. Among them two disjoint ones with the smallest total frequency are the word's pivots,
chosen by dynamic programming along the word. One edit breaks at most one of two disjoint bigrams. So of two words one edit
apart, the one whose prefix ends first in the order has a pivot that also stands in the other's prefix.

Position limits: an unbroken pivot has the edit on one side of it, and the other side is equal in full. Two words
are compared only where pivot and prefix gram agree in the head of the word up to the gram's end, or in the tail
from its start on, and, if much is left beside that, in one half of the rest, which the edit must leave as it is. Lengths differ
by one at most. What meets is verified by edit distance inside the join, so no candidate leaves it. The join is a plain equi-join whose skewed keys adaptive execution splits; a word has a
bounded number of near words (one edit over the alphabet), so no group behind it grows with the corpus.

Words are counted over all texts by partial aggregation. Their letters are A-Z, a-z and U+00C0 to U+00FF, so there are at most
8,100 lower-case bigrams (116 squared with upper-case beyond A-Z): that table alone goes through the driver.

Results: null or empty texts have no words; a null key is the empty string before the colon. Repeated rows count again.
Ties: the near word of largest count, then the smallest in code-point order. Extra columns are ignored; an empty
table has no words. A text's runs are held as one array in a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import arrow_schema, ascii_lower, kept_table
from panelloom.session import checkpointed

LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: One run in so many loses a code point.
THINNED = 31
GRAM = 2
#: A rest of so many code points is looked up by its halves.
SHORT_REST = 4


def corpus_words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word``, ``n``: the distinct words of ``least_length`` code points and ``least_count`` occurrences or more.

    A run whose digest (with its key) ``THINNED`` divides loses the code point at digest modulo length.
    Shorter runs than ``least_length`` give no word, so only longer ones are taken out of the texts.
    """
    runs = F.regexp_extract_all(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    run = docs.select(name.alias("name"), F.explode(runs).alias("run")).select("name", ascii_lower(F.col("run")).alias("run"))
    run = run.withColumn("h", F.crc32(F.concat_ws(":", "name", "run").cast("binary"))).withColumn("at", (F.col("h") % F.length("run")).cast("int"))
    thinned = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    word = F.when(F.col("h") % THINNED == 0, thinned).otherwise(F.col("run")).alias("word")
    return run.select(word).filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def gram_frequencies(words: DataFrame) -> dict[str, int]:
    """How often each bigram stands in the words: a bounded table, see above."""
    place = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.filter(F.length("word") >= GRAM).select(F.explode(F.transform(place, lambda i: F.substring("word", i, F.lit(GRAM)))).alias("gram"))
    return {r.gram: r.n for r in grams.groupBy("gram").agg(F.count("*").alias("n")).collect()}


def pivots(places: Sequence[int], weight: Sequence[float], wanted: int = 2) -> list[int]:
    """Indices of ``wanted`` disjoint grams with the smallest total weight; ``places`` are ascending starts.

    ``best[k]`` holds, for the grams so far, the cheapest choice of k of them; a gram extends choices that end before it.
    """
    done: list[list[tuple[float, tuple[int, ...]] | None]] = []
    for i, at in enumerate(places):
        apart = i
        while apart and places[apart - 1] > at - GRAM:
            apart -= 1
        before = done[i - 1] if i else [(0, ())] + [None] * wanted
        earlier = done[apart - 1] if apart else [(0, ())] + [None] * wanted
        now = list(before)
        for k in range(1, wanted + 1):
            if earlier[k - 1] is not None:
                cost = earlier[k - 1][0] + weight[i], (*earlier[k - 1][1], i)
                if now[k] is None or cost < now[k]:
                    now[k] = cost
        done.append(now)
    return list(done[-1][wanted][1])


def gram_prefix(word: str, rank: dict[str, int]) -> tuple[list[int], int]:
    """Starts of the grams of the prefix, ascending, and the place of its last gram in the order of the corpus."""
    ranks = [rank[word[i : i + GRAM]] for i in range(len(word) - 1)]
    last = sorted(ranks)[GRAM]
    return [i for i, r in enumerate(ranks) if r <= last], last


def keys_of(word: str, start: int, head: bool, size: int) -> list[str]:
    """Where a word that agrees with ``word`` in the head up to the gram at ``start`` (or the tail from it on) and has ``size``
    more code points is found: a short rest by the head alone, a longer one also by one of its halves, since an edit leaves one as it is.
    """
    part, rest = (word[: start + GRAM], word[start + GRAM :]) if head else (word[start:], word[:start])
    mark = "<" if head else ">"
    if size < SHORT_REST:
        return [mark + part]
    first, last = rest[: size - size // 2], rest[max(0, len(rest) - size // 2) :]
    return [f"{mark}{part}+{first}", f"{mark}{part}-{last}"]


SIDES = "key string, last int, word string, n long, pivot boolean"


def gram_sides(words: DataFrame) -> DataFrame:
    """``key``, ``last``, ``word``, ``n``: the index of all prefix grams, and with ``pivot`` the keys a word's pivots look under.

    A gram weighs its frequency by what head and tail leave of it: every further letter is taken to leave a quarter.
    """
    frequency = gram_frequencies(words)
    rank = {g: i for i, g in enumerate(sorted(frequency, key=lambda g: (frequency[g], g)))}
    schema = arrow_schema(SIDES)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [], [], [], [], []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                places, last = gram_prefix(word, rank)
                weight = [frequency[word[p : p + GRAM]] * (0.25**p + 0.25 ** (len(word) - GRAM - p)) for p in places]
                chosen = [places[i] for i in pivots(places, weight)]
                ends = [(p, head, len(word) - p - GRAM if head else p) for p in places for head in (True, False)]
                index = {k for p, head, rest in ends for k in keys_of(word, p, head, rest)}
                looked = {k for p, head, rest in ends if p in chosen for size in (rest - 1, rest, rest + 1) for k in keys_of(word, p, head, size)}
                for keys, pivot in ((index, False), (looked, True)):
                    for column, value in zip(out, (keys, [last] * len(keys), [word] * len(keys), [n] * len(keys), [pivot] * len(keys))):
                        column.extend(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return words.select("word", "n").mapInArrow(each, SIDES).withColumn("key", F.xxhash64("key"))


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``near``, ``near_n``: both directions of every pair of words exactly one edit apart. Words have 4 code points or more."""
    sides = kept_table(gram_sides(words), "sides")
    a, b = (sides.filter(F.col("pivot") == (x == "a")).select("key", *(F.col(c).alias(f"{x}_{c}") for c in ("last", "word", "n"))) for x in "ab")
    close = (F.col("a_last") <= F.col("b_last")) & (F.abs(F.length("a_word") - F.length("b_word")) <= 1) & (F.levenshtein("a_word", "b_word", 1) == 1)
    met = a.join(b, (a.key == b.key) & close)
    ways = F.array(
        F.struct(F.col("a_word").alias("word"), F.col("b_word").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b_word").alias("word"), F.col("a_word").alias("near"), F.col("a_n").alias("near_n")),
    )
    return met.select(F.explode(ways).alias("w")).select("w.*").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: where following ``form`` from ``word`` ends. Counts grow along forms, so there are no circles.

    Every round takes each word's target's target, so rounds are the bits of the longest chain.
    """
    now = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        then = checkpointed(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = then.select("word", "root")
        if then.filter("moved").isEmpty():
            return now


def spelling_forms(words: DataFrame, times: int = TIMES) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for ``words`` (``word``, ``n``; words distinct)."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(near, "word", "left")
    enough = -F.col("best.less") >= times * F.col("n")
    formed = kept_table(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")
        ),
        "forms",
    )
    last = roots(formed.filter("form IS NOT NULL"))
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def corpus_spellings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The spelling forms of all words of ``docs``."""
    return spelling_forms(kept_table(corpus_words(docs, key, text), "words"))
