"""Differences between two states of a relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """``keys…, status, changed``: added and removed keys, and common ones whose attributes differ (null-safe)."""
    a = old.select(*keys, *[F.col(c).alias(f"__a_{c}") for c in attributes], F.lit(True).alias("__a"))
    b = new.select(*keys, *[F.col(c).alias(f"__b_{c}") for c in attributes], F.lit(True).alias("__b"))
    both = a.join(b, keys, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}")), F.lit(c)) for c in attributes])) if attributes else F.array().cast("array<string>")
    status = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.size(changed) > 0, "changed").otherwise("same")
    return both.select(*keys, status.alias("status"), F.when(status == "changed", changed).otherwise(F.array().cast("array<string>")).alias("changed"))


def summary(differences: DataFrame) -> DataFrame:
    return differences.groupBy("status").agg(F.count("*").alias("n"))
