"""The registered queries of the training-data operators, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_round_trip
from .chat import ROTATION_SQL, rotate_perspectives
from .common import in_fold, table
from .decontaminate import contaminated
from .embedding_dedup import embedding_groups
from .langid import fit_languages, identify
from .line_dedup import dedup_lines, line_dedup_sql
from .periodic import periodic_runs, planted_runs, run_digests
from .quality import fit_quality, score_quality
from .resample import resample, resample_sql
from .run_index import keyed, repeated_texts
from .sharding import place, placement_sql
from .simhash import simhash_groups
from .toxicity import fit_toxicity, score_toxicity


def op1_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_quality(docs, fit_quality(docs, labels), threshold=0.3)
    return scored.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def op2_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, labels), threshold=0.5)
    return scored.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"), cosine=0.95)


#: Bytes that a passage of over 50 words of a European language reaches.
PASSAGE_BYTES = 200


def op4_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cuts = repeated_texts(docs, length=400, shorter=PASSAGE_BYTES).select(
        "h", "n", F.col("n_removed").alias("_removed"), F.size("spans").cast("bigint").alias("_spans"),
        F.sha2("kept", 256).alias("_sha"), F.col("n_covered").alias("_covered"))
    rows = keyed(docs).select("doc_id", F.col("_n").alias("n_bytes"), "_h",
                              F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256).alias("_own"))
    joined = rows.join(cuts, (F.col("_h") == F.col("h")) & (F.col("n_bytes") == F.col("n")), "left")
    nothing = F.lit(0).cast("bigint")
    return joined.select("doc_id", "n_bytes", F.coalesce("_removed", nothing).alias("n_removed"),
                         F.coalesce("_spans", nothing).alias("n_spans"),
                         F.coalesce("_sha", "_own").alias("kept_sha256"),
                         F.coalesce("_covered", nothing).alias("n_repeated_200"))


def op5_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"), words=3, max_bits=2)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


SHARDS = [f"shard-{k:02d}" for k in range(32)]
SLOTS = 4099


def op6_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS, SLOTS)


def op7_perspective_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


def op8_edit_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), max_edit=0.1)
    return found.select("doc_id", "item_id", "edits", "word")


def op9_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = docs.where(F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), 3, 1))
    found = identify(docs, fit_languages(known), reject=False)
    return found.select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def op10_matrix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe_round_trip(table(spark, sf_dir, "documents"),
                           public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"), min_docs=2, min_chars=10)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", planted_runs(F.col("doc_id"), F.col("text")).alias("text"))
    return run_digests(periodic_runs(docs, min_length=12))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), share=(10, 100), min_words=20,
                     seed="2024", buckets=10_000, max_words=1)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_compression_quality": op1_compression_quality,
    "op2_ngram_toxicity": op2_ngram_toxicity,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_run_length_index": op4_run_length_index,
    "op5_golay_simhash": op5_golay_simhash,
    "op6_lookup_sharding": op6_lookup_sharding,
    "op7_perspective_chat": op7_perspective_chat,
    "op8_edit_decontamination": op8_edit_decontamination,
    "op9_kneser_ney_langid": op9_kneser_ney_langid,
    "op10_matrix_bpe": op10_matrix_bpe,
    "op11_line_dedup": op11_line_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_importance_resampling": op13_importance_resampling,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"op6_lookup_sharding": placement_sql("documents", "doc_id", SHARDS, SLOTS),
            "op7_perspective_chat": ROTATION_SQL,
            "op11_line_dedup": line_dedup_sql("documents", 2, 10),
            "op13_importance_resampling": resample_sql("documents", "benchmark", "2024", 10_000, (10, 100), 20)}
