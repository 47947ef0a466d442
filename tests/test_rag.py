"""Retrieval contexts and generation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from .paths import SF001
from turnlake.operators.embed import embed
from turnlake.operators.rag import NO_RECORDS_MESSAGE, ask_contexts, complete, summarize, summary_contexts
from turnlake.sources.tables import doc_records, table, turn_records


def counter():
    """A generator in place of a model; made in a function, so that it travels by value."""
    return lambda systems, prompts: [f"{sum(x.startswith('[') for x in p.splitlines())} context entries" for p in prompts]


def test_summarize_empty_selection_gives_fixed_message(spark):
    recs = doc_records(spark, SF001)
    out = summarize(recs, counter(), tags=["no-such-tag"]).collect()
    assert [(r.record_count, r.answer) for r in out] == [(0, NO_RECORDS_MESSAGE)]
    some = summarize(recs, counter(), tags=["en"], top=3).collect()
    assert len(some) == 1 and some[0].record_count == 3 and some[0].answer.startswith("3 context")


def test_summary_is_first_in_insertion_order(spark):
    recs = doc_records(spark, SF001)
    s = summary_contexts(recs, tags=["en"], top=4, topic="tests").first()
    first4 = [r.id for r in recs.where(F.array_contains("tags", "en")).orderBy("seq").limit(4).collect()]
    assert s.source_ids == ",".join(first4) and s.context.startswith("[1] ") and "about tests." in s.instruction
    with pytest.raises(ValueError):
        summary_contexts(recs, top=201)


def test_ask_bounds_and_body(spark):
    recs = turn_records(spark, SF001).withColumn("vector", F.array(*[F.lit(float(i % 3 == 0)) for i in range(4)]))
    q = spark.createDataFrame([(1, "what?", [1.0, 0.0, 0.0, 0.0])], "qid long, question string, vector array<float>")
    with pytest.raises(ValueError):
        ask_contexts(recs, q, top=21)
    raw = ask_contexts(recs, q, top=2).first()
    body = ask_contexts(recs, q, top=2, use_body=True).first()
    assert raw.n_sources == 2 and raw.context.count("\n") == 1
    assert "hook_event_name" not in body.context  # classified bodies, not envelopes
    ans = complete(ask_contexts(recs, q, top=2), counter()).first().answer
    assert "2 context entries" in ans


def test_embed_unit_norm_and_deterministic(spark):
    docs = table(spark, SF001, "documents").limit(20)
    a = [r.vector for r in embed(docs).orderBy("doc_id").collect()]
    b = [r.vector for r in embed(docs).orderBy("doc_id").collect()]
    assert a == b and all(abs(np.linalg.norm(v) - 1.0) < 1e-5 for v in a)
