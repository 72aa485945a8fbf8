from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from panelloom.llm import quality
from panelloom.llm.queries import ORACLES, QUERIES
from tests.check_oracle import compare, connect
from tests.llm.helpers import DOCS, by, docs

GOOD = " ".join(f"word{i}" for i in range(60))
BAD = " ".join(f"word{i}###" for i in range(60))
LABELS = "doc_id long, quality int"


def counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)


def test_counts_on_odd_texts(spark):
    texts = [None, "", " \n\t\x0b", "a", "a b", "a b c a b c", "a\n\na\n a\nb\nb", "#* $% & 漢字 |<>", "x x x x x", "a b c\r\nd a b c\r\n", "é " * 400 + "\x00 z", "A!B! C\n" * 3]
    got = by(quality.text_counts(docs(spark, texts)))
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts(t), t


def test_binomial_tail(spark):
    cases = [(n, k, p) for n in (1, 40, 430, 5_000) for k in (0, 1, 7, 60) for p in (0.02, 0.3) if k < n * p]
    for n, k, p in cases:
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        got = spark.range(1).select(quality.binomial_tail(F.lit(n), F.lit(k), p).alias("t")).first().t
        assert math.isclose(got, exact, rel_tol=1e-9)


def test_rule_needs_enough_labels_and_keeps_clean_documents(spark):
    def judged(n):
        table = docs(spark, [GOOD + f" x{i}" if i % 3 else BAD + f" x{i}" for i in range(n)] + [None, "short"])
        labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(n)] + [(None, 1), (0, None)], LABELS)
        return by(quality.judge_documents(table, labels))

    few, many = judged(60), judged(4_000)
    assert all(few[i]["kept"] for i in range(60))  # no cutoff can be vouched for
    assert [many[i]["kept"] for i in range(6)] == [False, True, True, False, True, True]
    assert many[0]["failed_rules"] == ["symbols"] and not many[0]["base_failed"]
    assert many[4_000]["base_failed"] and not many[4_000]["kept"] and many[4_001]["base_failed"]


def test_cutoffs_hold_their_bound(spark):
    """A rule that would reject more good documents than allowed is not used, whatever it would gain."""
    table = docs(spark, [(GOOD if i % 10 else BAD) + f" x{i}" for i in range(2_000)])
    labels = spark.createDataFrame([(i, int(i >= 20)) for i in range(2_000)], LABELS)
    counted = quality.text_counts(table)
    chosen = quality.choose_cutoffs(counted, labels, "lang").collect()
    assert "symbols" not in {r.rule for r in chosen}


def test_empty_tables_nulls_and_clashing_names(spark):
    none = spark.createDataFrame([], LABELS)
    assert quality.judge_documents(spark.createDataFrame([], DOCS), none).count() == 0
    odd = docs(spark, [(None, GOOD), (1, GOOD), (1, GOOD), (2, "a")]).withColumns({"n_words": F.lit("x"), "kept": F.lit(0), "_w": F.lit(1), "row": F.lit(2)}).withColumn("lang", F.lit(None).cast("string"))
    kept = quality.passing_documents(odd, none)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.orderBy("doc_id").collect()] == [None, 1, 1]
    assert quality.judge_documents(odd, none).count() == 4


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["op9_quality_rules"](spark, folder).toPandas()
    assert not compare(got, connect(folder).execute(ORACLES["op9_quality_rules"]).df())


def test_the_verdict_as_a_whole_keeps_its_risk(spark):
    """Six rules that each reject their own share of the good documents: together they may reject no more than the risk."""
    n = 12_000

    def flawed(i):
        kind = i % 1_000
        if kind < 8:
            return GOOD + " ###" * 8 + f" x{i}"
        if kind < 16:
            return "\n".join([GOOD, *["same line here"] * 9, f"x{i}"])
        if kind < 24:
            return GOOD.upper() + f" x{i}"
        return GOOD + f" x{i}"

    rows = [(i, flawed(i) if i % 4 else BAD.upper() + "\nsame\nsame\nsame !!!!!!!!!!!!!! x" + str(i)) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(n)], LABELS)
    judged = quality.judge_documents(docs(spark, rows), labels).filter("NOT base_failed AND doc_id % 4 > 0")
    lost = judged.agg(F.avg(F.when(F.col("kept"), 0).otherwise(1))).first()[0]
    assert lost < quality.RISK
