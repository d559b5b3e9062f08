"""Keywords of texts and the footer that carries them into the index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T


def _top(counted: DataFrame, id_col: str, k: int) -> DataFrame:
    """The ``k`` most frequent tokens of each row, ties by first place."""
    w = Window.partitionBy(id_col).orderBy(F.desc("n"), "first")
    ranked = counted.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return ranked.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "tok"))), lambda x: x.tok).alias("keywords"))


def keywords_en(df: DataFrame, id_col: str, text_col: str, k: int = 8) -> DataFrame:
    """``(id, keywords)``: tokens of three or more characters that are no stop words, case kept."""
    toks = df.select(id_col, F.posexplode_outer(T.tokens(T.strip_images(F.col(text_col)))).alias("pos", "tok"))
    toks = toks.where(F.col("tok").isNotNull() & (F.length("tok") >= 3) & ~F.lower("tok").isin(*T.EN_STOPWORDS))
    return _top(toks.groupBy(id_col, "tok").agg(F.count("*").alias("n"), F.min("pos").alias("first")), id_col, k)


_SINGLE, _DOUBLE = ([w for w in T.ZH_STOPWORDS if len(w) == n] for n in (1, 2))


def _stop(pair: Column) -> Column:
    return pair.isin(*_DOUBLE) | (F.substring(pair, 1, 1).isin(*_SINGLE) & F.substring(pair, 2, 1).isin(*_SINGLE))


def _pairs(text: Column) -> Column:
    """Pairs of neighbouring Han characters of a text, in order."""
    han = F.regexp_replace(T.strip_images(text), "[^一-鿿]", "")
    return F.when(F.length(han) > 1, F.regexp_extract_all(han, F.lit("(?=(..))"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def keywords_zh(df: DataFrame, id_col: str, text_col: str, k: int = 8) -> DataFrame:
    """``(id, keywords)``: pairs of neighbouring Han characters, without stop words."""
    pairs = df.select(id_col, F.posexplode_outer(_pairs(F.col(text_col))).alias("pos", "tok"))
    pairs = pairs.where(F.col("tok").isNotNull() & ~_stop(F.col("tok")))
    return _top(pairs.groupBy(id_col, "tok").agg(F.count("*").alias("n"), F.min("pos").alias("first")), id_col, k)


def keywords_some(df: DataFrame, id_col: str, text_col: str, k: int = 8) -> DataFrame:
    """``(id, keywords)`` of the rows that have any: Chinese keywords where a text has a pair for one, else English ones.

    Rows are told apart by their text, so each is tokenised for its own sort alone and nothing is joined.
    """
    chinese = F.exists(_pairs(F.col(text_col)), lambda t: ~_stop(t))
    return keywords_zh(df.where(chinese), id_col, text_col, k).unionByName(keywords_en(df.where(~chinese), id_col, text_col, k))


def keywords(df: DataFrame, id_col: str, text_col: str, k: int = 8) -> DataFrame:
    """``(id, keywords)`` of every row; an empty list where a text has none."""
    found = keywords_some(df, id_col, text_col, k)
    return df.select(id_col).join(found, id_col, "left").select(id_col, F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))


def enrich(df: DataFrame, id_col: str, text_col: str, k: int = 8) -> DataFrame:
    """All columns and ``keywords`` and ``enriched``: the text with its keyword footer."""
    rows = df.join(keywords_some(df, id_col, text_col, k), id_col, "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    return rows.withColumn("enriched", T.keyword_footer(F.col(text_col), F.col("keywords")))


def textrank(df: DataFrame, id_col: str, text_col: str, k: int = 8, window: int = 5, damping: float = 0.85, rounds: int = 30) -> DataFrame:
    """``(id, keywords)``: tokens of three or more characters, and pairs of Han characters, ranked by the graph of those that stand
    within ``window`` places of each other; ties by first place. A text is ranked by itself, in Arrow batches."""
    han = F.filter(T.zh_tokens(T.strip_images(F.col(text_col))), lambda t: t.rlike("^[一-鿿]{2}$") | ((F.length(t) >= 3) & t.rlike("^[A-Za-z]") & ~F.lower(t).isin(*T.EN_STOPWORDS)))

    @F.pandas_udf("array<string>")
    def rank(lists: pd.Series) -> pd.Series:
        return lists.map(lambda toks: _ranked(list(toks), k, window, damping, rounds))

    return df.select(id_col, rank(han).alias("keywords"))


def _ranked(toks: list[str], k: int, window: int, damping: float, rounds: int) -> list[str]:
    names = list(dict.fromkeys(toks))
    if not names:
        return []
    place = {t: i for i, t in enumerate(names)}
    at = np.array([place[t] for t in toks])
    one, two = (np.concatenate(x) for x in zip(*((at[:-d], at[d:]) for d in range(1, min(window, len(at)))), strict=True)) if len(at) > 1 else (np.zeros(0, int), np.zeros(0, int))
    apart = one != two
    a, b = np.concatenate((one[apart], two[apart])), np.concatenate((two[apart], one[apart]))
    out = np.bincount(a, minlength=len(names)).astype(float)
    score = np.ones(len(names))
    for _ in range(rounds):
        score = 1 - damping + damping * np.bincount(b, (score / np.maximum(out, 1))[a], len(names))
    return [names[i] for i in np.lexsort((np.arange(len(names)), -np.round(score, 9)))[:k]]
