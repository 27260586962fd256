"""The package's queries by name, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrarium.llm import op1_decontaminate, op2_secret_scan, op3_byte_bpe, op4_simhash_dedup, op5_token_counts, op6_line_dedup, op7_substring_dedup, op8_suffix_dedup, op9_nearest, op10_language_id, op11_sharding, op12_lexical_search, op13_hard_negatives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_leaks(spark: SparkSession, folder: str) -> DataFrame:
    found = op1_decontaminate.leaks(read(spark, folder), read(spark, folder, "benchmark"), size=5, similarity=0.8, radius=23, short=True)
    return found.drop("row_key", "row_key2")


def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return op2_secret_scan.secrets(read(spark, folder), q=0.05, alpha=0.01)


def op3_byte_bpe_digests(spark: SparkSession, folder: str) -> DataFrame:
    return op3_byte_bpe.digests(read(spark, folder), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return op4_simhash_dedup.near_duplicates(read(spark, folder), shingle=4, radius=4)


def op5_token_count(spark: SparkSession, folder: str) -> DataFrame:
    return op5_token_counts.token_counts(read(spark, folder), op5_token_counts.json_tokenizer(public_tokenizers.path("word_bpe_49k.json")), limit=2048)


def op6_lines(spark: SparkSession, folder: str) -> DataFrame:
    return op6_line_dedup.digests(read(spark, folder), least=40, documents=5)


def op7_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return op7_substring_dedup.digests(read(spark, folder), window=35)


def op8_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return op8_suffix_dedup.digests(read(spark, folder), window=200)


def op9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return op9_nearest.nearest(read(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op10_languages(spark: SparkSession, folder: str) -> DataFrame:
    return op10_language_id.languages(read(spark, folder), most_docs=40, most_chars=120_000)


def op11_shards(spark: SparkSession, folder: str) -> DataFrame:
    return op11_sharding.digests(read(spark, folder), shards=16)


def op12_search(spark: SparkSession, folder: str) -> DataFrame:
    return op12_lexical_search.ranked(read(spark, folder), read(spark, folder, "benchmark"), k=20)


def op13_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return op13_hard_negatives.hard_negatives(read(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label, positives=5, negatives=10, low=30, high=90)


QUERIES["op1_decontaminate"] = op1_leaks
QUERIES["op2_secret_scan"] = op2_secrets
QUERIES["op3_byte_bpe"] = op3_byte_bpe_digests
QUERIES["op4_simhash_dedup"] = op4_near_duplicates
QUERIES["op5_token_counts"] = op5_token_count
QUERIES["op6_line_dedup"] = op6_lines
QUERIES["op7_substring_dedup"] = op7_substrings
QUERIES["op8_suffix_dedup"] = op8_suffixes
QUERIES["op9_nearest"] = op9_neighbours
QUERIES["op10_language_id"] = op10_languages
QUERIES["op11_sharding"] = op11_shards
QUERIES["op12_lexical_search"] = op12_search
QUERIES["op13_hard_negatives"] = op13_negatives

ORACLES["op6_line_dedup"] = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
lines AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
held AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, line, pos, last IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN held USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id
"""
ORACLES["op7_substring_dedup"] = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS x FROM documents),
words AS (SELECT doc_id, unnest(x) AS word, generate_subscripts(x, 1) AS pos FROM split),
windows AS (SELECT *, string_agg(word, ' ') OVER w AS g, count(*) OVER w AS n FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
again AS (SELECT g FROM windows WHERE n = 35 GROUP BY 1 HAVING count(*) > 1),
marked AS (SELECT doc_id, word, pos, n = 35 AND again.g IS NOT NULL AS dup FROM windows LEFT JOIN again USING (g)),
covered AS (SELECT doc_id, word, pos, bool_or(dup) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM marked),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS text FROM covered GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)
"""
# Texts as hexadecimal digits, two a byte, in blocks of 256 bytes and the 200 after them.
ORACLES["op8_suffix_dedup"] = r"""
WITH raw AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
blocks AS (SELECT doc_id, x, length(x) // 2 AS n, unnest(range(0, length(x) // 2, 256)) AS b FROM raw),
pieces AS (SELECT doc_id, n, b, substr(x, 2 * b + 1, 912) AS x FROM blocks),
places AS (SELECT doc_id, n, b, x, unnest(range(0, least(256, n - b))) AS i FROM pieces),
windows AS (SELECT doc_id, b + i AS p, substr(x, 2 * i + 1, 2) AS byte, CASE WHEN b + i + 200 <= n THEN md5_number(substr(x, 2 * i + 1, 400)) END AS g FROM places),
again AS (SELECT g FROM windows WHERE g IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
marked AS (SELECT doc_id, p, byte, CASE WHEN g IN (SELECT g FROM again) THEN p END AS start FROM windows),
covered AS (SELECT doc_id, p, byte, coalesce(p - max(start) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) < 200, false) AS gone FROM marked),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM covered),
kept AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(byte, '' ORDER BY p) FILTER (NOT gone) AS rest FROM edges GROUP BY 1)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, ''))) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)
"""
ORACLES["op12_lexical_search"] = r"""
WITH both_tables AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark),
words AS (SELECT side, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM both_tables),
lengths AS (SELECT id AS doc_id, count(*) AS n FROM words WHERE side = 'd' GROUP BY 1),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
asked AS (SELECT id AS item_id, term, count(*) AS times FROM words WHERE side = 'q' GROUP BY 1, 2),
freq AS (SELECT id AS doc_id, term, count(*) AS tf FROM words WHERE side = 'd' AND term IN (SELECT term FROM asked) GROUP BY 1, 2),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM freq, corpus GROUP BY term, docs),
impacts AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms)) AS impact FROM freq JOIN lengths USING (doc_id), corpus),
scores AS (SELECT item_id, doc_id, sum(times * w * impact)::BIGINT AS score FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY 1, 2),
placed AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= 20
"""
ORACLES["op13_hard_negatives"] = r"""
WITH used AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score FROM used a JOIN used b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
near AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM pairs WHERE same),
far AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM near JOIN pairs USING (anchor_id) WHERE r <= 5 AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM far WHERE rank <= 10
"""
