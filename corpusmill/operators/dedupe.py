"""First-wins, last-wins, cascading and greedy dedup; set operations with provenance.

Order comes from an explicit column, never from the order of partitions. Windows are
replaced by grouped minima where only the winner is needed, so that a hot key is combined
on the map side before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _present(key: Column) -> Column:
    return key.isNotNull() & (key.cast("string") != "")


def digest(key: Column) -> Column:
    """What a key is grouped by: 256 bits, however long it is; null stays null."""
    return F.sha2(key.cast("string"), 256)


def _winner(df: DataFrame, key: Column, order: Column, first: bool) -> DataFrame:
    pick = F.min_by if first else F.max_by
    return df.groupBy(digest(key).alias("_key")).agg(pick(F.struct(F.col("*")), order).alias("_row")).select("_row.*")


def first_wins(df: DataFrame, key: Column, order: Column, keep_missing: bool = True) -> DataFrame:
    """The first row of each key; rows without a key are all kept, or (``keep_missing=False``) count as one key."""
    if not keep_missing:
        return _winner(df, key, order, True)
    return _winner(df.where(_present(key)), key, order, True).unionByName(df.where(~F.coalesce(_present(key), F.lit(False))))


def last_wins(df: DataFrame, key: Column, order: Column) -> DataFrame:
    return _winner(df.where(_present(key)), key, order, False)


def cascade(df: DataFrame, keys: Sequence[Column], order: Column) -> DataFrame:
    """First-wins by each key in turn, each stage on what the one before kept."""
    for key in keys:
        df = first_wins(df, key, order)
    return df


def duplicate_counts(df: DataFrame, key: Column) -> DataFrame:
    """One row: rows, duplicates, rows without a key."""
    have = F.coalesce(_present(key), F.lit(False))
    n, distinct = F.count_if(have), F.count_distinct(F.when(have, key))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), (n - distinct).alias("n_duplicates"), F.count_if(~have).alias("n_no_key"))


def greedy(df: DataFrame, a: str, b: str, title: str, order: str, components) -> DataFrame:
    """Single pass over ordered rows: a row goes if its first key, else its second one, was seen among rows kept.

    Keys of dropped rows aren't remembered, so the result depends on order within a connected
    component of keys; components are scanned one by one. Rows with neither key are first-wins by
    title. ``components`` is a function from edges (a, b) to (node, root). A component must fit
    into a task's memory; as keys are identifiers, these are small unless the data are broken.
    """
    ids = df.withColumn("_a", F.nullif(F.col(a), F.lit(""))).withColumn("_b", F.nullif(F.col(b), F.lit("")))
    keyed = ids.where("_a is not null or _b is not null")
    node = lambda c, tag: F.xxhash64(F.lit(tag), F.col(c))
    edges = keyed.select(
        F.when(F.col("_a").isNotNull(), node("_a", "a")).otherwise(node("_b", "b")).alias("a"),
        F.when(F.col("_b").isNotNull(), node("_b", "b")).otherwise(node("_a", "a")).alias("b"),
    )
    roots = components(edges)
    own = F.when(F.col("_a").isNotNull(), node("_a", "a")).otherwise(node("_b", "b"))
    placed = keyed.withColumn("_node", own).join(roots.withColumnRenamed("node", "_node"), "_node", "left")
    placed = placed.withColumn("_root", F.coalesce("root", "_node")).select(*df.columns, "_a", "_b", "_root")

    columns = df.columns

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        seen_a, seen_b, keep = set(), set(), []
        for x, y in rows.sort_values(order)[["_a", "_b"]].itertuples(index=False):
            fresh = not (x in seen_a if isinstance(x, str) else False) and not (y in seen_b if isinstance(y, str) else False)
            keep.append(fresh)
            if fresh:
                seen_a.add(x)
                seen_b.add(y)
        return rows.sort_values(order)[keep][columns]

    return placed.groupBy("_root").applyInPandas(scan, df.schema).unionByName(
        first_wins(ids.where("_a is null and _b is null").select(*df.columns), F.col(title), F.col(order))
    )


def exclusive_members(df: DataFrame, key: str, source: str) -> DataFrame:
    """Per source, how many keys are in no other source."""
    one = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(source).alias(source), F.max(source).alias("_max"))
    return one.where(F.col(source) == F.col("_max")).groupBy(source).agg(F.count(F.lit(1)).alias("n_exclusive"))


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows, missing columns null, with the ordinal of the source they come from."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("src_ord", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows, the same ones on every run."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def batched(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds ``batch``, groups of about ``size`` rows by ranges of the order column, without one global sort task."""
    n = df.count()
    return df.repartitionByRange(max(1, -(-n // size)), order).withColumn("batch", F.spark_partition_id())
