"""The queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, html_extract, mixing, packing, quality, secrets, simhash, substring_dedup, toxicity
from .common import table


def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.with_paths(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack_documents(table(spark, sf_dir, "documents")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), digest=True)


OPS = (
    op1_entropy_mix,
    op2_exact_dedup,
    op3_quality_divergence,
    op4_html_extract,
    op5_toxicity,
    op6_simhash,
    op7_substring_dedup,
    op8_secrets,
    op9_packing,
    op10_bpe,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPS}


OP2_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM n
WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""


OP7_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (
  SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(*) > 1)),
each_word AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
kept AS (
  SELECT e.r, string_agg(e.word, ' ' ORDER BY e.j) AS t
  FROM each_word e LEFT JOIN gone g ON e.r = g.r AND e.j = g.j WHERE g.r IS NULL GROUP BY e.r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""


def _quality_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    lists = " ".join(f"WHEN {quote(k)} THEN [{', '.join(map(quote, ws))}]" for k, ws in quality.COMMON_WORDS.items())
    known = ", ".join(map(quote, quality.COMMON_WORDS))
    special = ", ".join(f"length(regexp_replace(t, {quote(f'[{c}]+')}, '', 'g'))" for c in quality.CLASSES)
    half = lambda a, m: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / {m}) ELSE 0 END"

    def distance(n: str, ref: str) -> str:
        pairs = f"list_transform(list_zip({n}, {ref}), lambda z: [z[1] / list_sum({n})::DOUBLE, z[2] / list_sum({ref})::DOUBLE])"
        part = f"({half('z[1]', '((z[1] + z[2]) / 2)')} + {half('z[2]', '((z[1] + z[2]) / 2)')}) / 2"
        return f"CASE WHEN list_sum({n}) > 0 AND list_sum({ref}) > 0 THEN sqrt(greatest(0, list_sum(list_transform({pairs}, lambda z: {part})))) END"

    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN lang IN ({known}) THEN lang ELSE 'other' END AS ref, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
grams AS (SELECT r, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r),
own AS (SELECT *, CASE ref {lists} END AS listed, [{special}] AS special FROM w),
counted AS (
  SELECT *, list_prepend(length(t) - list_sum(special), special) AS class_n, list_transform(listed, lambda x: len(list_filter(ws, lambda y: y = x))) AS hits FROM own),
hist AS (SELECT *, list_append(hits, len(ws) - list_sum(hits)) AS word_n FROM counted),
class_ref AS (
  SELECT ref, list(s ORDER BY k) AS class_ref FROM (SELECT ref, k, sum(v) AS s FROM (SELECT ref, unnest(class_n) AS v, generate_subscripts(class_n, 1) AS k FROM hist) GROUP BY ref, k) GROUP BY ref),
word_ref AS (
  SELECT ref, list(s ORDER BY k) AS word_ref FROM (SELECT ref, k, sum(v) AS s FROM (SELECT ref, unnest(word_n) AS v, generate_subscripts(word_n, 1) AS k FROM hist) GROUP BY ref, k) GROUP BY ref),
judged AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^{quality.SYMBOLS}]+', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, length(t) AS chars,
         {distance('class_n', 'class_ref')} AS class_distance, {distance('word_n', 'word_ref')} AS word_distance
  FROM hist LEFT JOIN covered USING (r) LEFT JOIN class_ref USING (ref) LEFT JOIN word_ref USING (ref)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM judged)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (chars >= {quality.MIN_CHARS} AND (coalesce(class_distance, 0) > {quality.MAX_CLASS_DISTANCE} OR (n_words >= {quality.MIN_WORDS} AND coalesce(word_distance, 0) > {quality.MAX_WORD_DISTANCE}))) AS kept
FROM base
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op3_quality_divergence": _quality_sql(), "op7_substring_dedup": OP7_SQL}
