"""One query per operator, over whole tables with production parameters, and SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm import alignment, collocations, embedding_dedup, exact_dedup, language_id, lm_scoring, mixing, order_minhash, packing
from logwarden.llm import sharding, simhash, token_counts, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_range_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.range_shards(documents(spark, sf_dir), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_linked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity(docs, toxicity.fit(docs, labels, toxicity.label_categories()))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.identify(docs, language_id.fit(docs.where(~language_id.held_out())))


def op5_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(documents(spark, sf_dir), ~lm_scoring.held_out())


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op7_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(documents(spark, sf_dir))


def op13_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_range_shards, op2_linked_vectors, op3_toxicity_chain, op4_language, op5_attention_scores, op6_token_counts, op7_exact_duplicates, op8_pareto_mix, op9_pack_documents, op10_simhash_groups, op11_collocations, op12_token_alignment, op13_order_minhash)}

ORACLE: dict[str, str] = {
    "op7_exact_duplicates": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, text_sha256
        FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
              FROM documents)
        WINDOW same AS (PARTITION BY text_sha256)
    """,
    "op11_collocations": r"""
        WITH words AS (
          SELECT lang, list_filter(string_split_regex(unnest(string_split_regex(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')), '[ \t]'), lambda w: w <> '') AS ws
          FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)
        ), starts AS (
          SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM words
        ), totals AS (
          SELECT lang, count(*) AS n FROM starts GROUP BY lang
        ), counts AS (
          SELECT lang, array_to_string(ws[i : i + size - 1], ' ') AS phrase, size, count(*) AS f
          FROM starts, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE i + size - 1 <= len(ws)
          GROUP BY ALL HAVING count(*) >= 30
        ), candidates AS (
          SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE size >= 2
        ), cuts AS (
          SELECT lang, phrase, size, a, ws, unnest(range(1, size)) AS k FROM candidates
        ), both_parts AS (
          SELECT c.lang, c.phrase, c.size, c.a, c.k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f::HUGEINT + r.f) AS score
          FROM cuts c
          JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1 : c.k], ' ')
          JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.k + 1 : c.size], ' ')
        ), lowest AS (
          SELECT * FROM both_parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), spans AS (
          SELECT lang, a, ws, size, len, unnest(range(1, size - len + 2)) AS i
          FROM candidates, (SELECT unnest([2, 3]) AS len) WHERE len < size
        ), longer AS (
          SELECT lang, array_to_string(ws[i : i + len - 1], ' ') AS phrase, max(a) AS most FROM spans GROUP BY ALL
        ), kept AS (
          SELECT x.* FROM lowest x LEFT JOIN longer g ON g.lang = x.lang AND g.phrase = x.phrase
          WHERE g.most IS NULL OR 100::HUGEINT * g.most < 80::HUGEINT * x.a
        )
        SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        JOIN totals USING (lang) WHERE rank <= 2000
    """,
}
