"""Registered queries of the operators in this package."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.embeddings import near_duplicates
from strandmill.llm.exact_dedup import exact_groups
from strandmill.llm.jaccard import link_components
from strandmill.llm.language import language_of_documents
from strandmill.llm.mixing import mix_sources
from strandmill.llm.packing import pack_documents
from strandmill.llm.quality import score_quality
from strandmill.llm.ranking import rank
from strandmill.llm.sharding import shard_documents
from strandmill.llm.spelling import spelling_groups
from strandmill.llm.token_counts import count_tokens
from strandmill.llm.url_filter import judge_pages, parse_rules
from strandmill.llm.warc import archive_and_read
from strandmill.sources.tables import table

URL_RULES = ["block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/"]


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file lies."""
    return importlib.import_module("public_tokenizers").path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, targets, _ = mix_sources(table(spark, sf_dir, "documents"))
    known = targets.select("source", F.col("size").alias("source_size"), "target")
    met = rows.join(known, F.element_at("members", 1).eqNullSafe(F.col("source")))
    return met.select("doc_id", rows["size"], "source_size", "target", "taken")


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(), 1024)


def op4_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 40)


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of_documents(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op6_url_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages"), parse_rules(URL_RULES))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))


def op8_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


def op12_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), 4096)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mix_sources, op2_warc_index, op3_pack_documents, op4_shard_documents, op5_language_mixture, op6_url_link_graph, op7_jaccard_join, op8_embedding_near_dups, op9_exact_dedup, op10_quality_rules, op11_spelling_variants, op12_block_max_search, op13_token_counts)}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_index": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             q AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM q)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f
    """,
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
             g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
        FROM d JOIN g ON d.body = g.body
    """,
    "op12_block_max_search": """
        WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS terms FROM documents),
             sized AS (SELECT row_id, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
             whole AS (SELECT count(*) AS docs, sum(n) AS all_terms FROM sized),
             m AS (SELECT row_id, doc_id, CAST(50 + (50 * n * docs) // all_terms AS BIGINT) AS m FROM sized, whole),
             tf AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(terms) AS term FROM d) GROUP BY row_id, term),
             w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term),
             q AS (SELECT DISTINCT item_row, item_id, term FROM (
                     SELECT row_number() OVER () AS item_row, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM benchmark)),
             s AS (SELECT item_row, any_value(item_id) AS item_id, row_id, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
                   FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (row_id) GROUP BY item_row, row_id),
             r AS (SELECT *, row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id) AS place FROM s WHERE score > 0)
        SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM r WHERE place <= 50
    """,
}
