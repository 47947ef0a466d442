"""Retrieval contexts, prompts and pluggable generation.

Contexts are built per question/group with ``listagg ... WITHIN GROUP (ORDER BY rank)``;
each group holds at most ``top`` rows (<= 20 for ask, <= 200 for summaries), so no group is
unbounded.  Generation is a user-given batch callable run by ``mapInPandas``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.classify import classify
from .predicates import has_all_tags, in_time_range
from .search import search_batch

# Fixed texts of the reference's prompts.
SYSTEM_PROMPT = (
    "You are a helpful assistant. Answer the question based solely on the provided context. "
    "If the answer is not in the context, say so clearly."
)
SUMMARY_INSTRUCTION = (
    "Summarize the following records about {topic}. Identify key themes, patterns, and notable items. "
    "Be concise but comprehensive."
)
DEFAULT_TOPIC = "the stored records"
NO_RECORDS_MESSAGE = "No records found matching the given filters."


def user_prompt(context: F.Column, question: F.Column) -> F.Column:
    """``Context:\\n{context}\\n\\nQuestion: {question}``."""
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question)


def _numbered_context(rows: DataFrame, key: str, rank: str, text: str) -> DataFrame:
    item = F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] "), F.col(text))
    return rows.select(key, rank, item.alias("_item"), "id").groupBy(key).agg(
        F.count(F.lit(1)).alias("n_sources"),
        F.expr(f"listagg(id, ',') WITHIN GROUP (ORDER BY `{rank}`)").alias("source_ids"),
        F.expr(f"listagg(_item, '\\n') WITHIN GROUP (ORDER BY `{rank}`)").alias("context"),
    )


def ask_contexts(
    corpus: DataFrame,
    questions: DataFrame,
    top: int = 5,
    *,
    question_id: str = "qid",
    question_text: str = "question",
    question_vec: str = "vector",
    use_body: bool = False,
    **kernel_opts,
) -> DataFrame:
    """V10 retrieval: the ``top`` (1..20) nearest records of each question, numbered
    ``[i] text`` and joined by newlines; ``prompt`` is the user message for E2.
    ``use_body=True`` uses the classified body instead of the raw (envelope) text."""
    if not (1 <= top <= 20):
        raise ValueError("top must be between 1 and 20")
    hits = search_batch(corpus, questions.select(F.col(question_id).alias("qid"), F.col(question_vec).alias("vector")), top, **kernel_opts)
    text = classify("text", "tags").getField("body") if use_body else F.col("text")
    docs = corpus.select("seq", text.alias("_text"))
    rows = hits.join(docs, "seq")  # J1: only the k hits per question meet their text
    ctx = _numbered_context(rows, "qid", "rank", "_text")
    q = questions.select(F.col(question_id).alias("qid"), F.col(question_text).alias("question"))
    out = q.join(ctx, "qid", "left").select(
        "qid", "question", F.coalesce("n_sources", F.lit(0)).alias("n_sources"),
        F.coalesce("source_ids", F.lit("")).alias("source_ids"), F.coalesce("context", F.lit("")).alias("context"),
    )
    return out.withColumn("system", F.lit(SYSTEM_PROMPT)).withColumn("prompt", user_prompt(F.col("context"), F.col("question")))


def summary_contexts(
    records: DataFrame,
    *,
    group_by: str | F.Column | None = None,
    topic: str | None = None,
    tags: Sequence[str] | None = None,
    after: int | None = None,
    before: int | None = None,
    top: int = 20,
) -> DataFrame:
    """Filters, then the *first* ``top`` (1..200) records in insertion order (per group
    when ``group_by`` is given: a ``row_number`` cut, planned as WindowGroupLimit), numbered
    context, instruction with the topic and the user message."""
    if not (1 <= top <= 200):
        raise ValueError("top must be between 1 and 200")
    r = records.where(has_all_tags(tags) & in_time_range(after, before))
    g = F.lit("") if group_by is None else (F.col(group_by) if isinstance(group_by, str) else group_by)
    r = r.withColumn("_g", g)
    w = Window.partitionBy("_g").orderBy("seq")
    firsts = r.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= top)
    ctx = _numbered_context(firsts, "_g", "_rank", "text")
    if topic is not None:
        t = F.lit(topic)
    elif group_by is not None:
        t = F.col("_g")  # one summary per group, about that group
    else:
        t = F.lit(DEFAULT_TOPIC)
    ctx = ctx.withColumn("topic", t)
    instr = F.format_string(SUMMARY_INSTRUCTION.replace("{topic}", "%s"), F.col("topic"))
    return ctx.select(
        F.col("_g").alias("group"), F.col("n_sources").alias("record_count"), "source_ids", "context",
        instr.alias("instruction"), user_prompt(F.col("context"), instr).alias("prompt"),
    )


Generator = Callable[[list[str], list[str]], list[str]]


def complete(df: DataFrame, generate: Generator, *, prompt_col: str = "prompt",
             system_col: str | None = "system", out_col: str = "answer", batch_rows: int = 16) -> DataFrame:
    """Run ``generate(systems, prompts) -> answers`` over Arrow batches of ``batch_rows``
    prompts on the executors (the callable is shipped once per task)."""
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out_col, T.StringType())])
    sys_default = SYSTEM_PROMPT

    def part(it):
        for pdf in it:
            for s in range(0, len(pdf), batch_rows):
                chunk = pdf.iloc[s:s + batch_rows].copy()
                systems = chunk[system_col].tolist() if system_col and system_col in chunk else [sys_default] * len(chunk)
                chunk[out_col] = generate(systems, chunk[prompt_col].tolist())
                yield chunk

    return df.mapInPandas(part, schema)


def summarize(records: DataFrame, generate: Generator, **opts) -> DataFrame:
    """V11 + E2; an empty selection gives the reference's fixed message with count 0."""
    ctx = summary_contexts(records, **opts).withColumn("system", F.lit(SYSTEM_PROMPT))
    answered = complete(ctx, generate)
    empty = records.sparkSession.range(1).select(
        F.lit("").alias("group"), F.lit(0).cast("long").alias("record_count"), F.lit("").alias("source_ids"),
        F.lit("").alias("context"), F.lit("").alias("instruction"), F.lit("").alias("prompt"),
        F.lit(SYSTEM_PROMPT).alias("system"), F.lit(NO_RECORDS_MESSAGE).alias("answer"),
    )
    # the fallback row only survives when no group exists (a scalar subquery, no join)
    fallback = empty.where(ctx.select(F.count(F.lit(1))).scalar() == 0)
    return answered.unionByName(fallback)
