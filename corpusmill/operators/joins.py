"""Joins with the override and patch rules of metadata pipelines. Build sides are made unique first (last wins)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedupe import last_wins


def override_join(base: DataFrame, other: DataFrame, key: str, order: str) -> DataFrame:
    """Inner join in which the other side's columns win; the base is unique by key, last wins."""
    unique = last_wins(base, F.col(key), F.col(order))
    keep = [c for c in unique.columns if c not in other.columns]
    return other.join(unique.select(key, *keep), key)


def unmatched(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_anti")


def matched(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_semi")


def patch_join(base: DataFrame, patch: DataFrame, key: str, columns: Sequence[str], when: Column | None = None) -> DataFrame:
    """Left join that takes the patch's columns where it matched (and ``when`` holds on its columns, named p_*), null or not."""
    side = patch.select(F.col(key), F.lit(True).alias("_hit"), *(F.col(c).alias(f"p_{c}") for c in columns))
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & (F.lit(True) if when is None else F.coalesce(when, F.lit(False)))
    joined = base.join(side, key, "left")
    return joined.select(*(F.when(hit, F.col(f"p_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns))


def replace_rows(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    return base.join(patch.select(key), key, "left_anti").unionByName(patch)


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Counts of keys in both, only in a, only in b."""
    x, y = (df.select(key).distinct().withColumn(tag, F.lit(1)) for df, tag in ((a, "_a"), (b, "_b")))
    side = F.when(F.col("_a").isNull(), "only_right").when(F.col("_b").isNull(), "only_left").otherwise("both")
    return x.join(y, key, "full").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def coverage(df: DataFrame, key: str, refs: str, available: DataFrame, ref_key: str) -> DataFrame:
    """Per row the share of its references that are available: valid_refs, total_refs, ratio (four places); repeats count."""
    have = available.select(F.col(ref_key).alias("_ref")).distinct().withColumn("_have", F.lit(1))
    flat = df.select(key, F.explode_outer(refs).alias("_ref"))
    out = flat.join(have, "_ref", "left").groupBy(key).agg(F.count("_have").alias("valid_refs"), F.count("_ref").alias("total_refs"))
    return out.withColumn("ratio", F.coalesce(F.bround(F.try_divide("valid_refs", "total_refs"), 4), F.lit(0.0)))


def realign(results: DataFrame, key: str, index: str, value: str, expected: str) -> DataFrame:
    """Indexed results back into arrays of the expected length, null where there is none; other indexes are ignored."""
    at = F.map_from_entries(F.collect_list(F.struct(F.col(index), F.col(value))))
    rows = results.groupBy(key, expected).agg(at.alias("_at"))
    return rows.select(key, F.transform(F.sequence(F.lit(1), F.col(expected)), lambda i: F.try_element_at("_at", i)).alias(value))
