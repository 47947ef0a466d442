"""The training-data pipeline: toxic documents go, one document of each near-duplicate group stays,
passages repeated across documents are cut, documents with benchmark passages go, and the rest
is encoded.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept.  All but the
last return the columns of ``documents`` (others are left out).  Null and empty texts pass every stage
unless they are near duplicates of each other (no word: one fingerprint); an empty table gives an
empty one.  Rows with equal ids and one text are one document: kept once by the near-duplicate
stage, alike by the others."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.bpe import bpe_round_trip
from turnlake.llm.common import shared_folder, table
from turnlake.llm.decontaminate import decontaminate
from turnlake.llm.run_index import keyed, repeated_texts
from turnlake.llm.simhash import simhash_groups
from turnlake.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None  # the classifier, fingerprints and tokenizer are beyond SQL; tests hold stages to brute force


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents scored below 0.5 by a classifier fitted on the labelled ones among ``docs``
    in the training folds."""
    docs = docs.select(*COLUMNS)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, threshold=0.5).where("predicted = 0").select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group linked by fingerprints at most 2 bits apart the document with the smallest id,
    and of its repeated rows one."""
    groups = simhash_groups(docs, words=3, max_bits=2)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id"))
    once = keyed(docs.select(*COLUMNS)).dropDuplicates(["doc_id", "_h", "_n"])
    return once.join(kept.distinct(), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(*COLUMNS)


#: Bytes that a passage of over 50 words of a European language reaches.
PASSAGE_BYTES = 200


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every byte covered by a string of ``PASSAGE_BYTES`` that also starts elsewhere, and what is then left of a
    divided character.  Every row stays; ``n_chars`` follows the text."""
    cuts = repeated_texts(docs, length=PASSAGE_BYTES).select("h", "n", "kept_text")
    joined = keyed(docs.select(*COLUMNS)).join(cuts, (F.col("_h") == F.col("h")) & (F.col("_n") == F.col("n")), "left")
    cut = F.col("h").isNotNull()
    size = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return joined.withColumns({"text": F.when(cut, F.col("kept_text")).otherwise(F.col("text")),
                               "n_chars": F.when(cut, size).otherwise(F.col("n_chars"))}).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without a passage within a benchmark item's word edits."""
    return decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), max_edit=0.1)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded_sha256)``: packed ids of every document, and the digest of what they
    decode to."""
    import public_tokenizers

    coded = bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
