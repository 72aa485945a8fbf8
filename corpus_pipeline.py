"""A training-corpus pipeline over ``documents``: each stage works on all its predecessor kept.

Rows without ``doc_id`` cannot be named: no stage but the quality rules removes or changes them. A
document of which nothing is left after the passages are cut stays, with an empty text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.llm import mixing, passages, pieces, quality, simhash
from panelloom.llm.common import forget, kept_table, table

#: SimHash links, shingle chains and sampled segmentations are no SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def quality_rules(spark, docs, sf_dir):
    """Documents that the quality rules reject go."""
    return quality.passing_documents(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark, docs, sf_dir):
    """One document of each group of near copies stays: the one with the smallest id. Rows that share its id stay with it."""
    groups = simhash.simhash_components(docs)
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    firsts = groups.filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(gone.join(firsts, "doc_id", "left_anti"), "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark, docs, sf_dir):
    """Passages of 50 words or more that an earlier document holds are cut out; ``n_chars`` follows."""
    cut = passages.without_repeats(docs, passages.repeated_passages(docs))
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixed(docs, out="position"):
    """``docs`` packed in ``packed``, with the place of each row in the mixture of the sources: a function of the rows alone."""
    packed = docs.select(F.struct(*docs.columns).alias("packed"), "source", "doc_id")
    return mixing.mix(packed, "source", ["doc_id"], out=out)


def source_mixing(spark, docs, sf_dir):
    """All documents, in the order of a mixture of their sources. Many files are not read in the order they were written in, so
    the last stage gives every row its place again."""
    return mixed(docs).orderBy("position").select("packed.*")


def sentencepiece(spark, docs, sf_dir):
    """Two sampled segmentations of each text, with the document's ``position`` in the mixture: in its order the result is the mixture."""
    rows = mixed(docs).select(F.col("packed.doc_id").alias("doc_id"), F.col("packed.text").alias("text"), "position")
    return pieces.encode(rows, carry="position")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = kept_table(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
