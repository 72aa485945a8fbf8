"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule rejects documents whose metric lies above a cutoff. For every rule, stratum and candidate
cutoff the good documents it would reject are counted over all labelled documents. A cutoff may be
used only if the exact binomial tail says the false rejection rate is below ``risk`` shared among the rules, at the level
``level`` divided by the number of tests (Bonferroni over rules, strata and cutoffs, so that
choosing among the cutoffs afterwards keeps the guarantee). All rules together then reject less than ``risk`` of the good
documents of a stratum, since a verdict's risk is at most the sum of its rules'. Among those the one is taken that
rejects the largest share of bad documents less the share of good ones, on ties the loosest. A
stratum without such a cutoff has no rule.

Nulls: a null text has no words; a null stratum is a stratum of its own; a null label says nothing.
A document labelled twice is good only if every label says so. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelloom.llm.common import SPACE, words
from panelloom.session import checkpointed

SYMBOLS = "#*$%&|<>"
CUTOFFS = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0, 2.0, 20.0)
#: Rule: numerator and denominator among the counts.
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "marks": ("n_marks", "n_words"),
    "word_length": ("word_chars", "n_words"),
}
#: Of the verdict; a rule has its share of it.
RISK, LEVEL = 0.02, 0.05


def text_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts the rules read. Windows of three words are compared by 64-bit hashes."""
    body = F.coalesce(F.col(text), F.lit(""))
    line = F.filter(F.split(body, "\n", -1), lambda x: F.trim(x, F.lit(SPACE)) != "")
    df = df.withColumn("_w", words(F.col(text))).withColumn("_lines", line)
    n = F.size("_w")
    at = lambda i: F.get(F.col("_w"), i)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
    df = df.withColumn("_h", F.when(n >= 3, windows).otherwise(F.array().cast("array<long>")))
    df = df.withColumn("_again", F.size("_h") > F.size(F.array_distinct("_h")))
    ordered = F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.col("_again"), ordered))
    same = lambda i, j: F.get(F.col("_s"), i)["h"] == F.get(F.col("_s"), j)["h"]
    twin = lambda x, k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False))
    covered = F.flatten(F.transform(F.filter("_s", twin), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    bare = lambda chars: F.char_length(F.translate(body, chars, ""))
    chars = F.char_length(body)
    return df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": bare(SPACE).cast("long"),
            "n_symbols": (chars - bare(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(F.size(F.array_distinct(covered)), F.lit(0)).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_capitals": (chars - bare("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long"),
            "n_marks": (chars - bare("!")).cast("long"),
        }
    ).drop("_w", "_lines", "_h", "_again", "_s")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def metric(rule: str) -> Column:
    top, bottom = RULES[rule]
    return F.coalesce(F.try_divide(F.col(top).cast("double"), F.col(bottom)), F.lit(0.0))


def log_gamma(x: Column) -> Column:
    """Stirling's series eight steps up, where it is exact to double precision."""
    z = x + 8.0
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    steps = functools.reduce(operator.add, [F.log(x + float(i)) for i in range(8)])
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series - steps


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k below n * p: terms downwards from k, as far as double precision sees them."""
    n, k = n.cast("double"), k.cast("double")
    at_k = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    steps = F.least(k, F.ceil(12 * F.sqrt(n) + 60)).cast("int")
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))

    def add(acc, d):
        return F.struct((acc["term"] * (k - d) / (n - k + d + 1) * ((1 - p) / p)).alias("term"), (acc["sum"] + acc["term"]).alias("sum"))

    return F.exp(at_k) * F.aggregate(F.sequence(F.lit(0), steps), zero, add)["sum"]


def choose_cutoffs(counted: DataFrame, labels: DataFrame, stratum: str, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """``stratum``, ``rule``, ``cutoff`` for the rules that may be used; one row per rule and stratum at most.

    ``counted`` has ``doc_id`` and the counts; ``labels`` has ``doc_id`` and ``quality`` 0 or 1.
    """
    risk = risk / len(RULES)
    marks = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("good"))
    known = counted.filter(~base_failed()).join(marks, "doc_id").withColumn("_g", F.col("good") == 1)
    tests = [(r, c) for r in RULES for c in CUTOFFS]
    over = [F.count_if((metric(r) > c) & F.col("_g") if g else (metric(r) > c) & ~F.col("_g")).alias(f"{'g' if g else 'b'}{i}") for i, (r, c) in enumerate(tests) for g in (1, 0)]
    sums = known.groupBy(F.col(stratum).alias("stratum")).agg(F.count_if("_g").alias("n_good"), F.count_if(~F.col("_g")).alias("n_bad"), *over)
    cells = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"g{i}").alias("g"), F.col(f"b{i}").alias("b")) for i, (r, c) in enumerate(tests)])
    strata = Window.partitionBy(F.lit(0))  # one row per stratum
    rows = sums.withColumn("n_tests", F.count("*").over(strata) * len(tests)).select("stratum", "n_good", "n_bad", "n_tests", F.inline(cells))
    below = F.col("g") < F.col("n_good") * risk
    tail = F.when(below, binomial_tail(F.col("n_good"), F.col("g"), risk)).otherwise(1.0)
    allowed = rows.filter((F.col("b") > 0) & below & (tail <= level / F.col("n_tests")))
    gain = F.col("b") / F.col("n_bad") - F.col("g") / F.col("n_good")
    best = allowed.groupBy("stratum", "rule").agg(F.max(F.struct(F.round(gain, 9).alias("gain"), F.col("cutoff"))).alias("best"))
    return best.select("stratum", "rule", F.col("best.cutoff").alias("cutoff"))


def verdicts(counted: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """``counted`` with ``base_failed``, ``failed_rules`` and ``kept``. One row of cutoffs per stratum is joined."""
    wide = cutoffs.groupBy(F.col("stratum").alias("_stratum")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_cut_{r}") for r in RULES])
    joined = counted.join(wide, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    failed = F.filter(F.array(*[F.when(metric(r) > F.col(f"_cut_{r}"), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    out = joined.withColumn("base_failed", base_failed()).withColumn("failed_rules", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_stratum", *[f"_cut_{r}" for r in RULES])


def judge_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """One row per document with its counts and verdict; texts are counted once."""
    counted = checkpointed(text_counts(docs.select("doc_id", stratum, "text")).select("doc_id", stratum, *COUNTS))
    out = verdicts(counted, choose_cutoffs(counted, labels, stratum), stratum)
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept", stratum, "n_lines", "n_capitals", "n_marks", "failed_rules")


def passing_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, whole and with their own columns whatever these are called.

    Texts are counted once; the verdicts are found again by stratum, length and two hashes of text and id.
    """
    body = F.coalesce(F.col("row.text"), F.lit(""))
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    key = {"k1": F.xxhash64("row.doc_id", body), "k2": F.hash(body, "row.doc_id"), "k3": F.octet_length(body), "k4": F.coalesce(F.col(f"row.{stratum}").cast("string"), F.lit(""))}
    packed = packed.select("row", *(c.alias(n) for n, c in key.items()))
    rows = packed.select(*key, F.col("row.doc_id").alias("doc_id"), F.col(f"row.{stratum}").alias("stratum"), F.col("row.text").alias("text"))
    counted = checkpointed(text_counts(rows).select(*key, "doc_id", "stratum", *COUNTS))
    judged = verdicts(counted, choose_cutoffs(counted, labels, "stratum"), "stratum")
    return packed.join(judged.filter("kept").select(*key).distinct(), list(key), "left_semi").select("row.*")
