"""Preparation of queries: vocabulary, spelling, expansion."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T


def vocabulary(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct tokens of the corpus in lower case."""
    return chunks.select(F.explode(F.array_distinct(F.transform(T.tokens(F.col(text_col)), F.lower))).alias("token")).distinct()


def corrections(queries: DataFrame, vocab: DataFrame, raw_col: str = "raw", most: int = 2) -> DataFrame:
    """``(token, correction, distance)`` for query tokens that the corpus does not know.

    Candidates have one of ``most + 1`` segments, shifted by at most ``most``: within that many edits one segment stays
    whole. So each token meets a few words and not a block of the vocabulary, and the bounded edit distance stops early.
    """
    words, unknown = _words(vocab), _unknown(queries, vocab, raw_col)
    begin = lambda seg: f"cast(floor(({seg}) * len / {most + 1}) as int)"
    size = f"({begin('seg + 1')} - {begin('seg')})"
    asked = unknown.select("token", "low", F.explode(F.expr(f"sequence(length(low) - {most}, length(low) + {most})")).alias("len"))
    asked = asked.withColumn("seg", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("shift", F.explode(F.sequence(F.lit(-most), F.lit(most))))
    asked = asked.where(f"{begin('seg')} + shift >= 0 and {begin('seg')} + shift + {size} <= length(low)").withColumn("piece", F.expr(f"substring(low, {begin('seg')} + shift + 1, {size})"))
    index = words.select("word", F.length("word").alias("len"), F.explode(F.sequence(F.lit(0), F.lit(most))).alias("seg"))
    index = index.withColumn("piece", F.expr(f"substring(word, {begin('seg')} + 1, {size})"))
    met = asked.select("token", "low", "len", "seg", "piece").distinct().join(index, ["len", "seg", "piece"]).select("token", "low", "word").distinct()
    near = met.withColumn("distance", F.levenshtein("low", "word", most)).where("distance >= 0")
    return near.groupBy("token").agg(F.min(F.struct("distance", "word")).alias("b")).select("token", F.col("b.word").alias("correction"), F.col("b.distance").alias("distance"))


def _words(vocab: DataFrame) -> DataFrame:
    return vocab.where(F.col("token").rlike("^[a-z0-9]+$")).select(F.col("token").alias("word"))


def _unknown(queries: DataFrame, vocab: DataFrame, raw_col: str) -> DataFrame:
    """(token, low) of the Latin query tokens of four or more characters that the vocabulary does not hold."""
    toks = queries.select(F.explode(T.tokens(F.col(raw_col))).alias("token")).distinct().where(F.col("token").rlike("^[A-Za-z0-9]{4,}$")).withColumn("low", F.lower("token"))
    return toks.join(_words(vocab).withColumnRenamed("word", "low"), "low", "left_anti")


def ratio_corrections(queries: DataFrame, vocab: DataFrame, raw_col: str = "raw", cutoff: float = 0.85) -> DataFrame:
    """``(token, correction, ratio)``: the word with the highest matching ratio of at least ``cutoff``, ties to the later word.

    The ratio 2 M / (a + b) of two words counts what is left and right of their longest common parts. A ratio of ``cutoff`` leaves
    at most (1 - cutoff) (a + b) insertions and deletions, so a word is cut into one segment more than that for each length its
    partner may have, and candidates share a whole segment. The ratio itself is computed on the few candidates.
    """
    slack = 1 - cutoff
    # edits between words of lengths a and b, and the lengths that a partner may have
    edits = lambda a, b: f"cast(floor({slack} * ({a} + {b}) + 1e-9) as int)"
    lengths = lambda n: f"sequence(cast(ceil({n} * {cutoff} / {1 + slack} - 1e-9) as int), cast(floor({n} * {1 + slack} / {cutoff} + 1e-9) as int))"
    begin = lambda seg: f"cast(floor(({seg}) * len / parts) as int)"
    size = f"({begin('seg + 1')} - {begin('seg')})"
    index = _words(vocab).where("length(word) > 2").select("word", F.length("word").alias("len"), F.explode(F.expr(lengths("length(word)"))).alias("other"))
    index = index.withColumn("parts", F.expr(f"{edits('len', 'other')} + 1")).withColumn("seg", F.explode(F.expr("sequence(0, parts - 1)")))
    index = index.select("word", "len", "other", "seg", F.expr(f"substring(word, {begin('seg')} + 1, {size})").alias("piece")).where("piece <> ''")
    asked = _unknown(queries, vocab, raw_col).select("token", "low", F.length("low").alias("other"), F.explode(F.expr(lengths("length(low)"))).alias("len"))
    asked = asked.withColumn("parts", F.expr(f"{edits('len', 'other')} + 1")).withColumn("seg", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("shift", F.explode(F.expr("sequence(1 - parts, parts - 1)")))
    asked = asked.where(f"{begin('seg')} + shift >= 0 and {begin('seg')} + shift + {size} <= other and {size} > 0")
    asked = asked.select("token", "low", "len", "other", "seg", F.expr(f"substring(low, {begin('seg')} + shift + 1, {size})").alias("piece")).distinct()
    met = asked.join(index, ["len", "other", "seg", "piece"]).select("token", "low", "word").distinct()

    @F.pandas_udf("double")
    def ratio(low: pd.Series, word: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, w, x).ratio() for x, w in zip(low, word, strict=True)], dtype=float)

    near = met.withColumn("ratio", ratio("low", "word")).where(F.col("ratio") >= cutoff)
    return near.groupBy("token").agg(F.max(F.struct("ratio", "word")).alias("b")).select("token", F.col("b.word").alias("correction"), F.round("b.ratio", 6).alias("ratio"))


def expansion_pairs(spark: SparkSession, text: str) -> DataFrame:
    """``(term, ix, extra)`` of a JSON object that maps a term to its expansions."""
    raw = spark.range(1).select(F.from_json(F.lit(text), "map<string,array<string>>").alias("m"))
    return raw.select(F.explode("m").alias("term", "extras")).select("term", F.posexplode("extras").alias("ix", "extra"))


def preprocess(queries: DataFrame, vocab: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(query_id, dense_query, bm25_query)``: the dense channel keeps the raw text."""
    q = queries.select("query_id", "raw").distinct()
    fixes = corrections(q, vocab).select("token", "correction")
    toks = q.select("query_id", F.posexplode(T.tokens(F.col("raw"))).alias("pos", "token"))
    terms = toks.join(fixes, "token", "left").select("query_id", "pos", F.lower(F.coalesce("correction", "token")).alias("term"))
    extra = terms.join(pairs, "term").groupBy("query_id", "extra").agg(F.min(F.col("pos") * 100 + F.col("ix")).alias("at"))
    extra = extra.join(terms.select("query_id", F.col("term").alias("extra")), ["query_id", "extra"], "left_anti")
    both = terms.select("query_id", (F.col("pos") * 100).alias("at"), "term").union(extra.select("query_id", F.col("at") + 1_000_000, "extra"))
    joined = both.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x.term), " ").alias("bm25"))
    return q.join(joined, "query_id", "left").select("query_id", F.col("raw").alias("dense_query"), F.coalesce("bm25", "raw").alias("bm25_query"))
