"""Queries of the operators in this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm import decontaminate, filter_audit, merkle, mixing, nearest, neardup, pii, quality, secrets, substring, tokens, toxicity, warc
from thicket.llm.shared import table


SQL = {
    "op6_hierarchical_mixing": mixing.sql(),
    "op7_warc_revisits": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        h AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
        o AS (SELECT digest, max(page_id) AS original FROM h WHERE n >= 1000 GROUP BY digest HAVING count(*) > 1)
        SELECT h.page_id, CAST(h.n AS BIGINT) AS payload_bytes, h.digest AS payload_digest,
               CASE WHEN o.original <> h.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN o.original <> h.page_id THEN o.original END AS refers_to
        FROM h LEFT JOIN o ON h.digest = o.digest AND h.n >= 1000
    """,
    "op11_merkle_manifest": merkle.sql(),
    "op12_filter_audit": filter_audit.sql(),
}


def _digest(spans: str, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of all spans (or those of some kinds), joined by commas."""
    column = F.col(spans)
    if kinds:
        column = F.filter(column, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(_count("base", k) for k in pii.BASE), F.sha2(_digest("base"), 256).alias("base_sha256"), _digest("spans").alias("spans"))


def op2_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(table(spark, sf_dir, "documents"))


def op3_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_copies(table(spark, sf_dir, "documents"))


def op5_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = secrets.KINDS[:3]
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(_count("spans", k) for k in base), F.sha2(_digest("spans", base), 256).alias("base_sha256"), _digest("spans").alias("spans"))


def op6_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixing.mix(table(spark, sf_dir, "documents"))
    words = F.coalesce(F.regexp_count("text", F.lit(mixing.WORDS)), F.lit(0)).cast("long")
    return chosen.select("doc_id", "epoch", F.col("_mix_domain").alias("domain"), "lang", "source", words.alias("n_tokens"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(merkle.tampering(table(spark, sf_dir, "documents"))).drop("group", "proof")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = filter_audit.failures(table(spark, sf_dir, "documents"))
    return filter_audit.audit(filter_audit.cells(masks, table(spark, sf_dir, "labels")))


def op13_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_weak_supervision_pii, op2_simple8b, op3_knn_quality, op4_order_minhash, op5_markov_secrets, op6_hierarchical_mixing, op7_warc_revisits, op8_winnowing, op9_adaptive_scan, op10_substring_dedup,
            op11_merkle_manifest, op12_filter_audit, op13_counterfactual_toxicity,
        )
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
