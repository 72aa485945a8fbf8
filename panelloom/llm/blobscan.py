"""Secrets in every version of every text, by an incremental blob ledger.

A text is addressed by the SHA-256 of its bytes: equal versions under many paths are one blob. The ledger, a Parquet
folder, has a row for each blob and scan: the rule versions applied and the spans they found. A rule's version is the
digest of its definition. A scan looks up which pairs of blob and rule version are new, scans those blobs only, each
once and by the missing rules only, and appends them. Findings are joined back to all paths from the ledger.

Rows of the ledger say what they cover, so a torn or repeated append is harmless: what is missing is scanned again,
what is there twice counts once. Blobs are thinned to one copy a task before they are shuffled, so copies of
one text that make up a third of all rows do not meet in one task; the join back to the paths is a plain equi-join.

Results: a null text is the empty text, which is a blob like any other. Null and repeated keys keep a row each. Spans
are in code points, end exclusive, ordered by start and then by rule as listed. Extra columns are ignored. An empty
table gives an empty result and an unchanged ledger. A text is scanned whole; patterns are linear in its length.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelloom.llm.common import arrow_schema, kept_table, small_batches
from panelloom.session import shared_folder


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches, leftmost and apart, count if ``group`` has ``least`` code points or more."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    any_case: bool = False

    @property
    def key(self) -> str:
        """The kind with the version: a changed definition is another version."""
        told = repr((self.pattern, self.least, self.group, self.any_case))
        return f"{self.kind}@{hashlib.sha256(told.encode()).hexdigest()[:12]}"

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        flags = re.ASCII | (re.IGNORECASE if self.any_case else 0)
        for m in re.compile(self.pattern, flags).finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.span()


#: The kinds every scan reports by number.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 16),  # a shorter run holds no longer one
    Rule("hex", r"[0-9a-f]{32,}", 32),
)
RULES = BASE + (
    Rule("private", r"-----BEGIN (?:[A-Z0-9]{1,20} ){0,3}PRIVATE KEY-----"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"),
    Rule("code_host", r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})"),
    Rule("chat_bot", r"(?<![A-Za-z0-9])xox[abposr]-[A-Za-z0-9-]{20,}"),
    Rule("cloud", r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}"),
    Rule("url_login", r"://[^\s/:@]{1,64}:[^\s/:@]{8,128}@"),
)

LEDGER = "blob binary, rules array<string>, spans array<struct<rule: string, start: long, end: long>>"


def blob_id(text) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; one that does not exist yet is empty."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def missing(history: DataFrame, ledger: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """``blob``, ``todo``: the blobs of ``history`` with the rule versions never applied to them, where there are any."""
    wanted = F.array(*(F.lit(r.key) for r in rules))
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
    blobs = history.select(blob_id(F.col(text)).alias("blob")).distinct().join(seen, "blob", "left")
    left = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.select("blob", left.alias("todo")).filter(F.size("todo") > 0)


def one_text_each(history: DataFrame, text: str = "text") -> DataFrame:
    """``blob``, ``text``: a blob once for each task that holds it."""
    schema = arrow_schema("blob binary, text string")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            first, blobs = [], []
            for i, x in enumerate(batch.column(0)):
                blob = hashlib.sha256((x.as_py() or "").encode()).digest()
                if blob not in seen:
                    seen.add(blob)
                    first.append(i)
                    blobs.append(blob)
            texts = batch.column(0).take(pa.array(first, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), texts.cast(pa.string())], schema=schema)

    return history.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(each, "blob binary, text string")


def scanned(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows of the ledger for ``blob``, ``text``, ``todo``."""
    schema = arrow_schema(LEDGER)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_key = {r.key: r for r in rules}
        for batch in batches:
            todo = batch.column("todo").to_pylist()
            found = [
                [{"rule": key, "start": a, "end": b} for key in keys for a, b in by_key[key].spans(text.as_py())]
                for text, keys in zip(batch.column("text"), todo)
            ]
            columns = [batch.column("blob"), pa.array(todo, schema.field("rules").type), pa.array(found, schema.field("spans").type)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return blobs.select("blob", "text", "todo").mapInArrow(each, LEDGER)


def update_ledger(history: DataFrame, path: str, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Scan what the ledger at ``path`` lacks of ``history``, append it, and return the ledger."""
    spark = history.sparkSession
    small_batches(spark)
    todo = kept_table(missing(history, read_ledger(spark, path), rules, text), "unseen")
    first = F.row_number().over(Window.partitionBy("blob").orderBy("blob"))
    blobs = one_text_each(history, text).join(todo, "blob").withColumn("n", first).filter("n = 1")
    scanned(blobs, rules).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def findings(history: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys``, ``blob`` and ``spans`` (``start``, ``rank``, ``end``, ``kind``; in order) of every row of ``history``.

    ``rank`` is the place of the kind in ``rules``. Findings of other rules or versions in the ledger do not count.
    """
    ranks = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.key, i)))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    single = ledger.select("blob", F.explode("spans").alias("s")).filter(F.col("s.rule").isin([r.key for r in rules]))
    ranked = single.select("blob", F.col("s.start").alias("start"), ranks[F.col("s.rule")].alias("rank"), F.col("s.end").alias("end")).distinct()
    span = F.struct("start", "rank", "end", kinds[F.col("rank")].alias("kind"))
    by_blob = ranked.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    paths = history.select(*keys, blob_id(F.col(text)).alias("blob"))
    none = F.array().cast(by_blob.schema["spans"].dataType)
    return paths.join(by_blob, "blob", "left").select(*keys, "blob", F.coalesce("spans", none).alias("spans"))


def written(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_documents(docs: DataFrame, path: str | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``doc_id``, the number of spans of each base kind, the digest of the base spans, and all ``spans``.

    ``path`` is the ledger to continue; without one a new ledger is begun in the shared folder.
    """
    path = path or f"{shared_folder(docs.sparkSession)}/ledger-{uuid.uuid4().hex}"
    found = findings(docs, update_ledger(docs, path, rules), rules)
    numbers = [F.size(F.expr(f"filter(spans, s -> s.kind = '{r.kind}')")).cast("long").alias(f"n_{r.kind}") for r in BASE]
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *numbers, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
