"""The retrieval engine: search modes over batches of queries, evaluation runs, and registries for extensions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import evaluation, fusion

MODES = ("text", "text-to-image", "image-to-image", "hybrid")


@dataclass(frozen=True)
class EngineConfig:
    """Settings of a search: weights of the routes, how many hits to fetch and keep, and the blend of the reader."""

    text_weight: float = 0.6
    text_to_image_weight: float = 0.4
    image_to_image_weight: float = 0.5
    top_k: int = 10
    fetch_k: int = 30
    least_score: float = 0.0
    blend: float = 0.7
    image_floor: float = 0.24
    prefetch: int = 50
    options: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not 1 <= self.top_k <= 200:
            raise ValueError("top_k lies between 1 and 200")


@dataclass
class Registry:
    """Extensions by kind (parser, embedder, reader, backend, aggregate) and name."""

    kinds: dict[str, dict[str, Callable]] = field(default_factory=dict)

    def register(self, kind: str, name: str, item: Callable) -> None:
        self.kinds.setdefault(kind, {})[name] = item

    def names(self, kind: str) -> list[str]:
        return sorted(self.kinds.get(kind, ()))

    def get(self, kind: str, name: str) -> Callable:
        found = self.kinds.get(kind, {}).get(name)
        if found is None:
            raise KeyError(f"{kind} {name} is not registered; there are: {", ".join(self.names(kind)) or "none"}")
        return found


#: Aggregates are expressions over partial sums, so they combine before the shuffle.
registry = Registry()
registry.register("aggregate", "rms", lambda c: F.sqrt(F.sum(c * c) / F.count(c)))


def search(mode: str, routes: dict[str, DataFrame], config: EngineConfig | None = None) -> DataFrame:
    """Ranked assets of a batch of queries in one of the modes.

    ``routes`` holds hits (query_id, chunk_id, asset_id, title, evidence, score, images) by route. A single mode ranks its own
    route; hybrid merges text and text-to-image, and image-to-image where it is given and has weight.
    """
    c = config or EngineConfig()
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    weights = {"text": c.text_weight, "text-to-image": c.text_to_image_weight, "image-to-image": c.image_to_image_weight} if mode == "hybrid" else {mode: 1.0}
    used = [(name, w) for name, w in weights.items() if w > 0 and name in routes]
    if not used:
        raise ValueError(f"no hits for the mode {mode}")
    hits = None
    for name, _ in used:
        part = routes[name].withColumn("route", F.lit(name))
        hits = part if hits is None else hits.unionByName(part)
    return fusion.merge_hits(hits, used, c.top_k, c.least_score)


def evaluate(results: DataFrame, cases: DataFrame, k_values: tuple[int, ...] = evaluation.K_VALUES) -> DataFrame:
    """The report of search results (query_id, rank, asset_id) against cases (query_id, grp, expected); no hits is a miss."""
    lists = results.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "asset_id"))), lambda x: x.asset_id).alias("actual"))
    joined = cases.join(lists, "query_id", "left").select(F.col("query_id").alias("case_id"), "grp", "actual", "expected")
    return evaluation.report(evaluation.at_k(evaluation.prepare(joined), k_values))


def run_cases(results: DataFrame, cases: DataFrame) -> DataFrame:
    """(query_id, grp, returned, rank, passed) of each case (query_id, grp, expected): the rank of its first hit.

    A case of the group 'negative' passes if nothing is returned, any other if there is a hit.
    """
    lists = results.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "asset_id"))), lambda x: x.asset_id).alias("actual"))
    rows = evaluation.prepare(cases.join(lists, "query_id", "left").select(F.col("query_id").alias("case_id"), "grp", "actual", "expected"))
    rank = F.nullif(F.array_position("hits", F.lit(1)), F.lit(0)).cast("int")
    passed = F.when(F.col("grp") == "negative", F.size("acts") == 0).otherwise(rank.isNotNull())
    return rows.select(F.col("case_id").alias("query_id"), "grp", F.size("acts").alias("returned"), rank.alias("rank"), passed.alias("passed"))
