"""Registered queries of the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.llm import bpe, gru_lm, kneser_ney, lexical_search, mixing, ngram_join, phrase_mining, quality_rules, secret_scan, suffix_dedup, token_count, topk_search, warc_zip


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labelled = secret_scan.samples(docs)
    generated = secret_scan.random_strings(spark).withColumn("n", F.lit(1).cast("long"))
    return secret_scan.digest(secret_scan.scan(docs, secret_scan.train(labelled.unionByName(generated))))


def op2_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk_search.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1
    return gru_lm.score_documents(table(spark, folder, "documents"), held_out)


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    packages = warc_zip.archive(table(spark, folder, "pages"))
    return warc_zip.read(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.apply(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = suffix_dedup.remove_repeated(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.classes(table(spark, folder, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    trusted = kneser_ney.trusted_of(table(spark, folder, "labels"))
    return kneser_ney.classify(table(spark, folder, "documents"), trusted).drop("text_hash")


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, folder, "documents"))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=50)


def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_count.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_topk": op2_topk,
    "op3_lm_score": op3_lm_score,
    "op4_warc": op4_warc,
    "op5_quality_rules": op5_quality_rules,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_ngram_join": op7_ngram_join,
    "op8_mixing": op8_mixing,
    "op9_bpe": op9_bpe,
    "op10_kneser_ney": op10_kneser_ney,
    "op11_collocations": op11_collocations,
    "op12_ranked_search": op12_ranked_search,
    "op13_token_counts": op13_token_counts,
}
ORACLE: dict[str, str] = {
    "op2_topk": """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
""",
    "op4_warc": """
WITH p AS (
    SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS h FROM pages
), d AS (
    SELECT *, octet_length(encode(h)) AS n, sha256(h) AS digest FROM p
), f AS (
    SELECT *, row_number() OVER (PARTITION BY digest ORDER BY page_id, r) AS place,
           first_value(page_id) OVER (PARTITION BY digest ORDER BY page_id, r) AS first_id
    FROM d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND place > 1 THEN first_id END AS refers_to
FROM f
""",
    "op11_collocations": r"""
WITH d AS (
    SELECT coalesce(lang, 'und') AS lang, string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
    FROM documents
), p AS (
    SELECT lang, unnest(pieces) AS piece FROM d
), q AS (
    SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p
), w AS (
    SELECT lang, id, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM q
), g AS (
    SELECT lang, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY id ORDER BY i)
), f AS (
    SELECT lang, [a] AS words, 1 AS k, count(*) AS f FROM g GROUP BY lang, a UNION ALL
    SELECT lang, [a, b], 2, count(*) FROM g WHERE b IS NOT NULL GROUP BY lang, a, b UNION ALL
    SELECT lang, [a, b, c], 3, count(*) FROM g WHERE c IS NOT NULL GROUP BY lang, a, b, c
), t AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
    SELECT lang, words, k, f AS a FROM f WHERE k > 1 AND f >= 10
), s AS (
    SELECT c.lang, c.words, c.a, x.f AS l, y.f AS r, cut,
           CAST((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
    FROM c JOIN (VALUES (1), (2)) AS v(cut) ON cut < c.k
    JOIN f x ON x.lang = c.lang AND x.words = c.words[1:cut] JOIN f y ON y.lang = c.lang AND y.words = c.words[cut + 1:c.k]
), b AS (
    SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1
), x AS (
    SELECT lang, words[1:2] AS words, a FROM c WHERE k = 3 UNION ALL SELECT lang, words[2:3], a FROM c WHERE k = 3
), o AS (
    SELECT lang, words, max(a) AS longer FROM x GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.words, ' ')) AS rank,
       array_to_string(b.words, ' ') AS phrase, a, l, r, n, score
FROM b JOIN t ON t.lang = b.lang LEFT JOIN o ON o.lang = b.lang AND o.words = b.words
WHERE longer IS NULL OR 100 * longer < 50 * a QUALIFY rank <= 2000
""",
    "op12_ranked_search": r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), c AS (
    SELECT count(*) FILTER (len(terms) > 0) AS nn, CAST(sum(len(terms)) AS BIGINT) AS ll FROM d
), t AS (
    SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d
), tf AS (
    SELECT r, doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL
), df AS (
    SELECT term, count(*) AS df FROM tf GROUP BY term
), q AS (
    SELECT row_number() OVER () AS i, item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM benchmark
), qt AS (
    SELECT DISTINCT i, item_id, unnest(terms) AS term FROM q
), s AS (
    SELECT i, item_id, r, doc_id,
           CAST(sum(CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT)
                    * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
    FROM qt JOIN tf USING (term) JOIN df USING (term), c GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
""",
}
