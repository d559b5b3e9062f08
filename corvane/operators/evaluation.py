"""Ranking quality: matching of ids, greedy claims, and the metrics of every case.

A case is one row (case_id, grp, actual ARRAY<STRING> in rank order, expected ARRAY<STRING>). All metrics of a case come from
its own arrays, so nothing is shuffled before the mean over the groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T

K_VALUES = (1, 3, 5, 10)


def matches(a: Column, b: Column) -> Column:
    """Slugs match if one holds the other and neither is empty."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def slugs(ids: Column) -> Column:
    return F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: T.slug(x))


def prepare(cases: DataFrame) -> DataFrame:
    """Adds ``acts``, ``exps`` (distinct, without blanks), ``hits`` (0/1, any match) and ``flags`` (0/1, greedy claims).

    Greedy: in rank order each actual claims the first expected one that matches and is still free.
    """
    rows = cases.select("case_id", "grp", slugs(F.col("actual")).alias("acts"), F.array_distinct(F.filter(slugs(F.col("expected")), lambda x: x != "")).alias("exps"))
    # Which expected ones each actual could claim: the only step that compares texts, so it is done once.
    places = F.when(F.size("exps") > 0, F.sequence(F.lit(1), F.size("exps"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("cand", F.transform("acts", lambda a: F.filter(places, lambda j: matches(a, F.element_at("exps", j)))))
    rows = rows.withColumn("hits", F.transform("cand", lambda c: (F.size(c) > 0).cast("int")))
    empty = F.struct(F.array().cast("array<int>").alias("claimed"), F.array().cast("array<int>").alias("flags"))

    def claim(state: Column, cand: Column) -> Column:
        free = F.filter(cand, lambda j: ~F.array_contains(state.claimed, j))
        got = F.size(free) > 0
        return F.struct(F.when(got, F.array_append(state.claimed, F.get(free, 0))).otherwise(state.claimed).alias("claimed"), F.array_append(state.flags, got.cast("int")).alias("flags"))

    return rows.withColumn("flags", F.aggregate("cand", empty, claim).flags)


def _sum(col: Column) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda a, x: a + x)


def reciprocal_rank(hits: Column) -> Column:
    at = F.array_position(hits, F.lit(1))
    return F.when(at > 0, 1.0 / at).otherwise(F.lit(0.0))


def average_precision(flags: Column, exps: Column) -> Column:
    hits_to = lambda i: _sum(F.slice(flags, F.lit(1), i))
    parts = F.transform(flags, lambda f, i: F.when(f == 1, hits_to(i + 1) / (i + 1)).otherwise(F.lit(0.0)))
    return F.when((F.size(exps) > 0) & (F.size(flags) > 0), _sum(parts) / F.size(exps)).otherwise(F.lit(0.0))


def dcg(flags: Column) -> Column:
    return _sum(F.transform(flags, lambda f, i: f / F.log2(i + 2.0)))


def at_k(prepared: DataFrame, k_values: tuple[int, ...] = K_VALUES) -> DataFrame:
    """One row for each case and k with hit rate, precision, recall, F1 and NDCG, besides RR and AP of the case."""
    rows = prepared.withColumn("k", F.explode(F.array(*[F.lit(k) for k in k_values])))
    flags, hits, n = F.slice("flags", F.lit(1), F.col("k")), F.slice("hits", F.lit(1), F.col("k")), F.size("exps")
    some = (n > 0) & (F.size("acts") > 0)
    precision, recall = _sum(flags) / F.least(F.size("acts"), F.col("k")), _sum(flags) / n
    ideal = _sum(F.transform(F.sequence(F.lit(1), F.least(n, F.col("k"))), lambda i: 1.0 / F.log2(i + 1.0)))
    rows = rows.withColumns({
        "hit_rate": F.coalesce(F.array_max(hits), F.lit(0)).cast("double"),
        "rr": reciprocal_rank(F.col("hits")),
        "ap": average_precision(F.col("flags"), F.col("exps")),
        "precision": F.when(some, precision).otherwise(F.lit(0.0)),
        "recall": F.when(n > 0, recall).otherwise(F.lit(0.0)),
        "ndcg": F.when(some, dcg(flags) / ideal).otherwise(F.lit(0.0)),
    })
    total = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(F.lit(0.0)))


def report(metrics: DataFrame, digits: int = 6) -> DataFrame:
    """Means by group and k; the row of all groups is called 'all'."""
    names = ("hit_rate", "precision", "recall", "f1", "ndcg", "rr", "ap")
    both = metrics.rollup("k", "grp").agg(F.count("*").alias("n"), *[F.round(F.avg(x), digits).alias(x) for x in names], F.grouping("k").alias("top"))
    return both.where("top = 0").drop("top").withColumn("grp", F.coalesce("grp", F.lit("all")))


def expand_prefixes(prefixes: DataFrame, ids: DataFrame) -> DataFrame:
    """(prefix, id): every known id that starts with the prefix, or the prefix itself.

    Ids meet whole prefixes: an id goes out with those of its own beginnings whose length some prefix has, so no two
    strings are compared that do not match.
    """
    lengths = prefixes.select(F.length("prefix").alias("n")).distinct()
    i = ids.select("id", F.explode(F.sequence(F.lit(0), F.length("id"))).alias("n")).join(lengths, "n").select("id", F.expr("substring(id, 1, n)").alias("prefix"))
    return prefixes.join(i, "prefix", "left").select("prefix", F.coalesce("id", "prefix").alias("id"))


def nearest_rank(values: Column, q: int) -> Column:
    """The percentile of a collected array: element int(q/100 n), counted from 1 and at least the first."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, F.greatest(F.floor(F.lit(q) / 100 * F.size(ordered)), F.lit(1)).cast("int"))


def stat_block(df: DataFrame, keys: list[str], value: str, digits: int = 6, buckets: int = 1024) -> DataFrame:
    """n, mean, p50, p95, p99, min and max of each group, by nearest rank.

    Values are counted by bucket between the extremes of their group, and equal ones together; places come from running sums
    over the buckets and inside each bucket, so no group is gathered in one place.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    whole = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg("v"), digits).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    span = F.col("max") - F.col("min")
    at = F.when(span > 0, F.floor((F.col("v") - F.col("min")) / span * (buckets - 1))).otherwise(0).cast("int")
    counts = rows.groupBy(*keys, "v").agg(F.count("*").alias("c")).join(whole.select(*keys, "min", "max"), keys).withColumn("b", at).select(*keys, "b", "v", "c")
    sums = counts.groupBy(*keys, "b").agg(F.sum("c").alias("c"))
    before = sums.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    placed = counts.join(before, [*keys, "b"]).withColumn("place", F.col("before") + F.sum("c").over(Window.partitionBy(*keys, "b").orderBy("v")))
    rank = lambda q: F.greatest(F.floor(F.lit(q) / 100 * F.col("n")), F.lit(1))
    points = placed.join(whole.select(*keys, "n"), keys).groupBy(*keys).agg(*[F.min(F.when(F.col("place") >= rank(q), F.col("v"))).alias(f"p{q}") for q in (50, 95, 99)])
    return whole.join(points, keys).select(*keys, "n", "mean", "p50", "p95", "p99", "min", "max")


def throughput(runs: DataFrame, keys: list[str], seconds: str, items: str, digits: int = 6) -> DataFrame:
    """(*keys, runs, per_second, runs_per_second) of timed runs: items and runs by the time that was spent; untimed runs are left out."""
    timed = runs.where(F.col(seconds) > 0)
    spent = F.sum(seconds)
    return timed.groupBy(*keys).agg(F.count("*").alias("runs"), F.round(F.sum(items) / spent, digits).alias("per_second"), F.round(F.count("*") / spent, digits).alias("runs_per_second"))
