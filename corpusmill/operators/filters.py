"""Filters that say why a row goes, and splits of rows in one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENGLISH = ("en", "eng", "english")
TOKEN_LIMIT = 121_000
COUNT_EDGES = (1, 5_000, 50_000, 250_000, 1_000_000, 5_000_000, 20_000_000)
COUNT_NAMES = ("b0_0", "b1_1_5k", "b2_5k_50k", "b3_50k_250k", "b4_250k_1m", "b5_1m_5m", "b6_5m_20m", "b7_20m_plus")


def contains_any(c: Column, phrases: Sequence[str]) -> Column:
    return F.coalesce(F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(c, p)), F.lit(False))


def is_english(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*ENGLISH), F.lit(False))


def non_empty(c: Column) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def with_reason(df: DataFrame, rules: Sequence[tuple[str, Column]], name: str = "reason") -> DataFrame:
    """Adds the first rule that the row breaks, null if none; rules are (reason, condition that must hold)."""
    out = F.lit(None).cast("string")
    for reason, ok in reversed(rules):
        out = F.when(~F.coalesce(ok, F.lit(False)), reason).otherwise(out)
    return df.withColumn(name, out)


def reason_counts(df: DataFrame, name: str = "reason") -> DataFrame:
    return df.groupBy(F.coalesce(name, F.lit("kept")).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def resume(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in what is done."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def not_status(c: Column, status: str) -> Column:
    """Null-safe: rows without a status stay."""
    return ~c.eqNullSafe(F.lit(status))


def within_tokens(c: Column, limit: int = TOKEN_LIMIT) -> Column:
    return c <= limit


def count_score(counts: Column, how: str = "max") -> Column:
    """Of the non-negative counts the largest, sum, least or first; 0 for none."""
    good = F.filter(counts, lambda x: x.isNotNull() & (x >= 0))
    pick = {
        "max": F.array_max(good), "min": F.array_min(good), "first": F.get(good, F.lit(0)),
        "sum": F.aggregate(good, F.lit(0).cast("long"), lambda a, x: a + x.cast("long")),
    }[how]
    return F.coalesce(pick, F.lit(0)).cast("long")


def count_bucket(score: Column) -> Column:
    out = F.lit(COUNT_NAMES[0])
    for edge, name in zip(COUNT_EDGES, COUNT_NAMES[1:]):
        out = F.when(score >= edge, name).otherwise(out)
    return out


def needs_fallback(text: Column, failures: Sequence[str], repeated: Column) -> Column:
    return (F.coalesce(F.trim(text), F.lit("")) == "") | contains_any(text, failures) | F.coalesce(repeated, F.lit(False))


def url_ok(c: Column) -> Column:
    """A string that isn't blank."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def any_filled(df: DataFrame, flags: Sequence[Column]) -> DataFrame:
    """Rows in which at least one field counts as filled; ``flags`` are predicates that are never null."""
    some = F.lit(False)
    for f in flags:
        some = some | f
    return df.where(some)


def _said(c: Column, many: bool) -> Column:
    return F.coalesce(F.exists(c, lambda x: F.trim(x) != "") if many else F.trim(c) != "", F.lit(False))


def has_boolean_queries(queries: Column, many: bool = False) -> Column:
    """Some item of an array of structs has a query text that isn't blank; with ``many`` texts are lists of strings."""
    return F.coalesce(F.exists(queries, lambda q: _said(q["boolean_query_string"], many)), F.lit(False))


def has_database_info(databases: Column, queries: Column, many: bool = False) -> Column:
    """A list of databases with an item that isn't blank, or a source in some query."""
    return _said(databases, True) | F.coalesce(F.exists(queries, lambda q: _said(q["database_source"], many)), F.lit(False))


def length_ordered(df: DataFrame, length: Column) -> DataFrame:
    """Rows in ranges of ascending length, sorted within each: batches of neighbours are of about equal length."""
    return df.withColumn("_n", length).repartitionByRange("_n").sortWithinPartitions("_n").drop("_n")


def language_verdict(text: Column, cleaned: Column, label: Column, score: Column, least: float = 0.85) -> Column:
    """Short texts fail, texts that clean up to little pass, else the label must hold "en" with enough score."""
    by_model = F.contains(label, F.lit("en")) & (score >= least)
    return F.coalesce(F.when(F.length(text) < 100, False).when(F.length(cleaned) < 50, True).otherwise(by_model), F.lit(False))


def language_filter(df: DataFrame, text: str, model: Callable[[list[str]], list[tuple[str, float]]], least: float = 0.85) -> DataFrame:
    """Adds ``is_english`` by a pluggable model, a function from cleaned texts to (label, score); texts that a rule decides don't reach it."""
    from pyspark.sql.types import StructType

    from ..functions.text import strip_markup

    @F.pandas_udf(StructType.fromDDL("label string, score double"))
    def judged(c: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"label": [None] * len(c), "score": [None] * len(c)}, index=c.index)
        some = c[c.notna()]
        if len(some):
            found = model(some.tolist())
            out.loc[some.index, "label"], out.loc[some.index, "score"] = [x[0] for x in found], [float(x[1]) for x in found]
        return out.astype({"score": float})

    clean = strip_markup(F.col(text))
    asked = df.withColumn("_c", clean).withColumn("_m", judged(F.when((F.length(text) >= 100) & (F.length("_c") >= 50), F.col("_c"))))
    return asked.withColumn("is_english", language_verdict(F.col(text), F.col("_c"), F.col("_m.label"), F.col("_m.score"), least)).drop("_c", "_m")


def token_lengths(df: DataFrame, text: str, tokenizer: Callable[[], Callable[[list[str]], list[int]]], name: str = "token_count") -> DataFrame:
    """Adds how many tokens a pluggable tokenizer makes of each text; it is made once per task. Null texts count as empty."""
    schema = _schema_with(df, f"`{name}` int")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = tokenizer()
        for frame in frames:
            yield frame.assign(**{name: count(["" if x is None else x for x in frame[text]])})

    return df.mapInPandas(run, schema)


def _schema_with(df: DataFrame, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {more}"


def cohort(has_query: Column, has_keywords: Column) -> Column:
    return F.when(has_query & has_keywords, "both").when(has_query, "has_boolean").when(has_keywords, "keywords_only").otherwise("neither")
