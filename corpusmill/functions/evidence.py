"""When a field counts as filled: six rules that differ on purpose, as predicates over typed columns.

``ev`` is a struct with ``value``; ``queries`` is an array of structs with ``boolean_query_string``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _false() -> Column:
    return F.lit(False)


def _text(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " ")) != ""


def value_filled(ev: Column) -> Column:
    """Completeness: the value is not null."""
    return F.coalesce(ev["value"].isNotNull(), _false())


def list_value_filled(ev: Column) -> Column:
    """Completeness, list values: not null and not empty."""
    return F.coalesce(F.size(ev["value"]) > 0, _false())


def text_list_filled(ev: Column) -> Column:
    """Cohort split: some item that isn't blank."""
    return F.coalesce(F.exists(ev["value"], _text), _false())


def first_query_filled(queries: Column) -> Column:
    """Completeness and repair impact: the first item has a query."""
    return F.coalesce(F.get(queries, F.lit(0))["boolean_query_string"].isNotNull(), _false())


def any_query_filled(queries: Column) -> Column:
    """Cohort split and statistics: some item has a query that isn't blank."""
    return F.coalesce(F.exists(queries, lambda q: _text(q["boolean_query_string"])), _false())


def value_present(ev: Column) -> Column:
    """Repair impact: an empty list counts."""
    return F.coalesce(ev["value"].isNotNull(), _false())


def statistic_filled(c: Column, kind: str) -> Column:
    """Corpus statistics: truthiness, blank text aside."""
    rule = {"string": lambda: _text(c), "list": lambda: F.exists(c, _text), "number": lambda: c != 0, "boolean": lambda: c}[kind]()
    return F.coalesce(rule, _false())


def slim_filled(c: Column, kind: str) -> Column:
    """Slim coverage: non-blank text, non-empty collections, any other scalar, 0 and false included."""
    rule = {"string": lambda: _text(c), "list": lambda: F.size(c) > 0, "number": lambda: c.isNotNull(), "boolean": lambda: c.isNotNull()}[kind]()
    return F.coalesce(rule, _false())


def explored(c: Column, kind: str) -> Column:
    """Exploration: everything but null, empty, zero and false."""
    rule = {"string": lambda: c != "", "list": lambda: F.size(c) > 0, "number": lambda: c != 0, "boolean": lambda: c}[kind]()
    return F.coalesce(rule, _false())


def missing_fields(fields: dict[str, Column], queries: Column) -> Column:
    """Names of evidence fields without a value, and of the query list if it has no first query; an empty list is not missing."""
    flags = [F.when(~value_present(c), F.lit(k)) for k, c in fields.items()]
    return F.array_compact(F.array(*flags, F.when(~first_query_filled(queries), F.lit("exact_boolean_queries"))))


def strip_evidence(fields: dict[str, Column], queries: Column) -> list[Column]:
    """Bare values under the fields' names; queries keep text and source."""
    bare = F.transform(queries, lambda q: F.struct(q["boolean_query_string"].alias("boolean_query_string"), q["database_source"].alias("database_source")))
    return [*(c["value"].alias(k) for k, c in fields.items()), bare.alias("exact_boolean_queries")]
