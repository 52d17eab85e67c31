"""When to rerank: triggers out of first-stage features only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICIES = ("never", "always", "margin", "disagreement", "either")


def features(first: DataFrame, second: DataFrame, query_key: str, key: str, head: int = 5) -> DataFrame:
    """(query, top, margin, overlap): best score, its share over the next, and the heads' common share of two rankings."""
    a = first.groupBy(query_key).agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("__next"), F.collect_set(F.when(F.col("rank") <= head, F.col(key))).alias("__a"))
    b = second.groupBy(query_key).agg(F.collect_set(F.when(F.col("rank") <= head, F.col(key))).alias("__b"))
    margin = F.round(F.try_divide(F.col("top") - F.coalesce("__next", F.lit(0.0)), F.col("top")), 6)
    overlap = F.round(F.size(F.array_intersect("__a", F.coalesce("__b", F.array().cast(b.schema["__b"].dataType)))) / F.lit(head), 6)
    return a.join(b, query_key, "left").select(query_key, "top", margin.alias("margin"), overlap.alias("overlap"))


def triggered(policy: str, margin: float = 0.1, overlap: float = 0.4) -> Column:
    """Whether a policy reranks a query of ``features``."""
    small, apart = F.col("margin") < margin, F.col("overlap") <= overlap
    return {"never": F.lit(False), "always": F.lit(True), "margin": small, "disagreement": apart, "either": small | apart}[policy]
