"""The operators as registered queries over the driver tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelloom.llm import alignment, blobscan, embeddings, licenses, mixing, passages, pieces, quality, scoring, sharding, simhash, spelling, toolcalls
from panelloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


@query("op1_substring_dedup")
def substring_dedup(spark, folder):
    return passages.repeated_passages(table(spark, folder, "documents"))


@query("op2_lm_scoring")
def lm_scoring(spark, folder):
    return scoring.score_documents(table(spark, folder, "documents"))


@query("op3_source_mixing")
def source_mixing(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return mixing.mix(docs, "source", ["doc_id"])


EMBEDDING_SQL = """WITH RECURSIVE
v AS (
  SELECT row_number() OVER () AS i, vec_id, label, embedding::DOUBLE[] AS e,
         coalesce(label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0, FALSE) AS valid
  FROM embeddings
),
links AS (
  SELECT a.i AS a, b.i AS b FROM v a JOIN v b ON a.label = b.label AND a.i <> b.i AND a.valid AND b.valid AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
),
reach AS (SELECT i, i AS j FROM v UNION SELECT reach.i, links.b FROM reach JOIN links ON reach.j = links.a),
least AS (SELECT reach.i, min(v.vec_id) AS component_id FROM reach JOIN v ON v.i = reach.j GROUP BY reach.i),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, FALSE) AS kept
FROM v JOIN least USING (i) LEFT JOIN degree ON a = i"""


@query("op4_embedding_dedup", EMBEDDING_SQL)
def embedding_dedup(spark, folder):
    return embeddings.near_vectors(table(spark, folder, "embeddings"))


@query("op5_sentencepiece")
def sentencepiece(spark, folder):
    return pieces.encode(table(spark, folder, "documents"))


@query("op6_license_scan")
def license_scan(spark, folder):
    return licenses.scan_licenses(table(spark, folder, "documents"))


@query("op7_tool_calls")
def tool_calls(spark, folder):
    return toolcalls.link_conversations(table(spark, folder, "conversations"))


@query("op8_simhash_dedup")
def simhash_dedup(spark, folder):
    return simhash.simhash_components(table(spark, folder, "documents"))


QUALITY_COUNTS = r"""
d AS (
  SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS body,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM {docs}
),
win AS (SELECT row, unnest(generate_series(1, len(w) - 2)) AS i, w FROM d WHERE len(w) >= 3),
grams AS (SELECT row, i, count(*) OVER (PARTITION BY row, w[i], w[i + 1], w[i + 2]) AS n FROM win),
again AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE n > 1) GROUP BY row),
counted AS (
  SELECT d.row, doc_id, lang, len(w)::BIGINT AS n_words,
         length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words,
         len(l)::BIGINT AS n_lines, length(regexp_replace(body, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
         length(regexp_replace(body, '[^!]', '', 'g'))::BIGINT AS n_marks
  FROM d LEFT JOIN again USING (row)
),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
measured AS (
  SELECT row, rule, CASE WHEN b = 0 THEN 0.0 ELSE a::DOUBLE / b END AS m FROM based, LATERAL (
    VALUES ('symbols', n_symbols, n_words), ('dup_lines', n_dup_lines, n_lines), ('repeats', n_repeat_words, n_words),
           ('capitals', n_capitals, word_chars), ('marks', n_marks, n_words), ('word_length', word_chars, n_words)) AS r(rule, a, b)
),
marks AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
cuts AS (SELECT unnest({cutoffs}) AS cutoff),
known AS (SELECT based.* , good FROM based JOIN marks USING (doc_id) WHERE NOT base_failed),
cells AS (
  SELECT lang, rule, cutoff::DOUBLE AS cutoff, count(*) FILTER (good = 1) AS n_good, count(*) FILTER (good = 0) AS n_bad,
         count(*) FILTER (good = 1 AND m > cutoff) AS g, count(*) FILTER (good = 0 AND m > cutoff) AS b
  FROM known JOIN measured USING (row) CROSS JOIN cuts GROUP BY ALL
),
tested AS (SELECT *, count(*) OVER () AS n_tests FROM cells),
terms AS (
  SELECT lang, rule, cutoff, n_tests, n_good, n_bad, g, b, i,
         exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({risk}) + (n_good - i) * ln(1 - {risk})) AS p
  FROM tested, LATERAL (SELECT unnest(generate_series(0, g)) AS i) WHERE g < n_good * {risk} AND b > 0
),
allowed AS (
  SELECT lang, rule, cutoff, any_value(round(b::DOUBLE / n_bad - g::DOUBLE / n_good, 9)) AS gain
  FROM terms GROUP BY lang, rule, cutoff, n_tests HAVING sum(p) <= {level} / n_tests
),
best AS (SELECT lang, rule, max({{'gain': gain, 'cutoff': cutoff}}).cutoff AS cutoff FROM allowed GROUP BY lang, rule),
failed AS (
  SELECT row, list(best.rule ORDER BY list_position({rules}, best.rule)) AS failed_rules
  FROM based JOIN measured USING (row) JOIN best ON best.lang IS NOT DISTINCT FROM based.lang AND best.rule = measured.rule
  WHERE m > best.cutoff GROUP BY row
),
judged AS (
  SELECT based.*, coalesce(failed_rules, []::VARCHAR[]) AS failed_rules, NOT base_failed AND failed_rules IS NULL AS kept
  FROM based LEFT JOIN failed USING (row)
)"""


def quality_sql(docs: str) -> str:
    return QUALITY_COUNTS.format(
        docs=docs, cutoffs=list(quality.CUTOFFS), rules=list(quality.RULES), risk=f"{quality.RISK / len(quality.RULES)!r}::DOUBLE", level=f"{quality.LEVEL}::DOUBLE"
    )


@query(
    "op9_quality_rules",
    f"""WITH {quality_sql("documents")}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lang, n_lines, n_capitals, n_marks, failed_rules
    FROM judged""",
)
def quality_rules(spark, folder):
    return quality.judge_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_jump_sharding")
def jump_sharding(spark, folder):
    return sharding.shard_documents(table(spark, folder, "documents"))


@query("op12_tokenizer_alignment")
def tokenizer_alignment(spark, folder):
    return alignment.alignment_digest(table(spark, folder, "documents"))


@query("op13_secret_scan")
def secret_scan(spark, folder):
    return blobscan.scan_documents(table(spark, folder, "documents"))


SPELLING_SQL = r"""WITH RECURSIVE
crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, x)) AS t
),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL
),
hashed AS (
  SELECT run, n, xor(list_reduce(
    flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
            lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 | (unicode(c)::BIGINT >> 6), 128 | (unicode(c)::BIGINT & 63)] END)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM runs, crc
),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2
),
less AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON w.word = l.rest
  UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON w.word = l.rest
),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS most FROM near GROUP BY word),
named AS (SELECT best.word, n_near, most, min(near.near) AS near FROM best JOIN near ON near.word = best.word AND near_n = most GROUP BY ALL),
formed AS (
  SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 10 * n THEN near END AS form, CASE WHEN most >= 10 * n THEN most END AS form_n
  FROM words LEFT JOIN named USING (word)
),
walk AS (
  SELECT word, word AS root, 0 AS hops FROM formed
  UNION ALL SELECT walk.word, formed.form, hops + 1 FROM walk JOIN formed ON formed.word = walk.root WHERE formed.form IS NOT NULL
),
ends AS (SELECT word, max({'hops': hops, 'root': root}).root AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""


@query("op11_spelling_variants", SPELLING_SQL)
def spelling_variants(spark, folder):
    return spelling.corpus_spellings(table(spark, folder, "documents"))
