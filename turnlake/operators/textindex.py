"""Keyword search through a trigram index.

The keyword score counts the query's tokens that are substrings of the lower-cased text.  A text holds a token only
if it holds all of the token's trigrams, so posting lists by trigram name the candidates, and only their texts are
looked at.

* ``build_trigrams``: ``(part, gram, block, ids)``, one row for each gram and block of ``BLOCK`` ids, so that no list
  grows with the table.  Every position of a text begins a gram (the last two are filled up), so a token of one or two
  characters is the beginning of some gram of each text that holds it.
* ``write_trigrams`` / ``read_trigrams``: stored by ``part`` (a hash of the gram's first character) and sorted by gram;
  a token's lists are found by partition and by the files' statistics.
* ``candidates``: a token's lists are intersected block by block; a short token's are united.
* ``keyword_rank_indexed``: candidates in levels by the number of tokens they may hold, best level first; the
  texts of a level are read only while its bound can still reach the top."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import keyword_score, tokenize_py
from ..session import checkpointed

BLOCK = 8192  # consecutive ids of one posting list
PARTS = 64
GRAM = 3
_FILL = "\x00" * (GRAM - 1)


def _part(first: Column) -> Column:
    return F.pmod(F.xxhash64(first), F.lit(PARTS)).cast("int")


def _postings(batches):
    for pdf in batches:
        lists: dict[tuple[str, int], list[int]] = {}
        for seq, text in zip(pdf["seq"].tolist(), pdf["low"], strict=True):
            if not text:
                continue
            filled, block = text + _FILL, seq // BLOCK
            for gram in {filled[k:k + GRAM] for k in range(len(text))}:
                lists.setdefault((gram, block), []).append(seq)
        if lists:
            yield pd.DataFrame({"gram": [g for g, _ in lists], "block": [b for _, b in lists], "ids": list(lists.values())})


def build_trigrams(records: DataFrame, id_col: str = "seq", text_col: str = "text") -> DataFrame:
    """Posting lists of all texts; ids are whole numbers of 0 or more.  Null texts hold nothing.  Lists are joined
    inside each Arrow batch before they are shuffled."""
    rows = records.select(F.col(id_col).cast("bigint").alias("seq"), F.lower(text_col).alias("low"))
    found = rows.mapInPandas(_postings, "gram string, block long, ids array<long>")
    whole = found.groupBy("gram", "block").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    return whole.select(_part(F.substring("gram", 1, 1)).alias("part"), "gram", "block", "ids")


def write_trigrams(index: DataFrame, path: str) -> None:
    """Store an index by part, sorted by gram."""
    index.repartitionByRange("part", "gram", "block").sortWithinPartitions("part", "gram", "block").write.partitionBy("part").parquet(path)


def read_trigrams(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("gram string, block long, ids array<long>, part int").parquet(path)


def _lists(index: DataFrame, part: int, condition: Column) -> DataFrame:
    return index.where((F.col("part") == part) & condition)


def candidates(index: DataFrame, words: list[str]) -> DataFrame:
    """``(seq, bound)``: the ids whose texts may hold some of the tokens, and how many of them (repeats counted).  The
    words are a query's, lower-cased and not empty."""
    spark = index.sparkSession
    number = Counter(words)
    parts = {r["c"]: r["p"] for r in spark.createDataFrame([(w[0],) for w in number], "c string").select("c", _part(F.col("c")).alias("p"))
             .distinct().collect()} if number else {}
    grams_of = {w: sorted({w[k:k + GRAM] for k in range(len(w) - GRAM + 1)}) for w in number if len(w) >= GRAM}
    firsts = sorted({g[0] for grams in grams_of.values() for g in grams} - set(parts))
    if firsts:
        parts |= {r["c"]: r["p"] for r in spark.createDataFrame([(c,) for c in firsts], "c string").select("c", _part(F.col("c")).alias("p")).collect()}
    found = spark.createDataFrame([], "seq long, times long")
    for word, times in number.items():
        if len(word) < GRAM:
            ids = _lists(index, parts[word[0]], F.col("gram").startswith(word)).select(F.explode("ids").alias("seq")).distinct()
        else:
            grams = grams_of[word]
            where = None
            for p in sorted({parts[g[0]] for g in grams}):
                own = (F.col("part") == p) & F.col("gram").isin([g for g in grams if parts[g[0]] == p])
                where = own if where is None else where | own
            lists = index.where(where).groupBy("block").agg(F.collect_list("ids").alias("lists")).where(F.size("lists") == len(grams))
            both = F.aggregate(F.slice("lists", 2, len(grams)), F.element_at("lists", 1), F.array_intersect)
            ids = lists.select(F.explode(both).alias("seq"))
        found = found.unionByName(ids.withColumn("times", F.lit(times).cast("bigint")))
    return found.groupBy("seq").agg(F.sum("times").alias("bound"))


def keyword_rank_indexed(records: DataFrame, index: DataFrame, query: str, top: int = 20, id_col: str = "seq",
                         text_col: str = "text") -> DataFrame:
    """``(rank, <id>, score)``: the ``top`` records by keyword score, ties to the smaller id, as a scan of all texts gives
    them; records without a token fill the list up where too few hold one."""
    words = tokenize_py(query)
    rows = records.select(F.col(id_col), F.col(text_col))
    named = checkpointed(candidates(index, words))
    levels = [r["bound"] for r in named.select("bound").distinct().orderBy(F.desc("bound")).collect()]  # one for each token at most
    best = None
    for k, level in enumerate(levels):
        chosen = named.where(F.col("bound") == level).select(F.col("seq").alias("_named"))
        scored = rows.join(chosen, F.col(id_col) == F.col("_named"), "left_semi").select(
            id_col, keyword_score(text_col, words).alias("score")).where("score > 0")
        both = scored if best is None else best.unionByName(scored)
        best = checkpointed(both.orderBy(F.desc("score"), id_col).limit(top))
        following = levels[k + 1] / len(words) if k + 1 < len(levels) else -1.0
        if best.where(F.col("score") > following).count() >= top:
            break
    held = 0 if best is None else best.count()
    if held < top:
        others = rows.select(id_col).where(F.col(id_col).isNotNull())
        others = others.join(best.select(F.col(id_col).alias("_id")), F.col(id_col) == F.col("_id"), "left_anti") if held else others
        zeros = others.orderBy(id_col).limit(top - held).select(id_col, F.lit(0.0).alias("score"))
        best = zeros if best is None else best.unionByName(zeros)
    order = Window.orderBy(F.desc("score"), id_col)  # ``top`` rows
    return best.select(F.row_number().over(order).alias("rank"), id_col, "score")
