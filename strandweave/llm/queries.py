"""The registered queries of this subpackage, and their DuckDB forms where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandweave.core.session import read
from strandweave.llm import ann, decontaminate, langid, linededup, packing, repeats, sharding, simhash, suffixes, toxicity


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(read(spark, sf_dir, "documents"), window=50)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(read(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(read(spark, sf_dir, "documents"), window=13).drop("kept")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(read(spark, sf_dir, "documents"), k=4, radius=4)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"), 16)


QUERIES = {f.__name__: f for f in (
        op1_ann, op2_toxicity, op3_suffix_array, op4_language_id, op5_packing, op6_line_dedup, op7_substring_dedup, op8_decontamination,
        op9_simhash, op10_sharding,
    )}



def _windows(n: int) -> str:
    """Words of the documents, and each window of n words with the least document that holds an equal one."""
    ahead = ", ".join(["x", *(f"lead(x, {i}) OVER w" for i in range(1, n))])
    return f"""WITH words AS (
  SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) - 1 AS p
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)),
win AS (
  SELECT doc_id, p, CASE WHEN lead(x, {n - 1}) OVER w IS NOT NULL THEN concat_ws(' ', {ahead}) END AS k
  FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
least AS (SELECT k, min(doc_id) AS d FROM win WHERE k IS NOT NULL GROUP BY k),
late AS (SELECT win.doc_id, p, d FROM win JOIN least USING (k) WHERE win.doc_id > d)"""


ORACLES = {
    "op3_suffix_array": _windows(50)
    + """,
cut AS (SELECT *, CASE WHEN p <= lag(p) OVER w + 50 THEN 0 ELSE 1 END AS new FROM late WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
span AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM cut)
SELECT doc_id, min(p) AS start, max(p) + 50 - min(p) AS length, min(d) AS earlier_doc_id FROM span GROUP BY doc_id, n
""",
    "op7_substring_dedup": _windows(13)
    + """,
judged AS (
  SELECT words.doc_id, words.p, x, max(late.p) OVER (PARTITION BY words.doc_id ORDER BY words.p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM words LEFT JOIN late ON late.doc_id = words.doc_id AND late.p = words.p),
done AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY p) FILTER (NOT gone), '') AS kept
  FROM judged GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM (SELECT doc_id FROM documents) LEFT JOIN done USING (doc_id)
""",
    "op6_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
}
