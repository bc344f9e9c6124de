"""Records around model calls: inputs, prompts, checked outputs; and Markdown images."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources.remote import rewritten
from .text import clean_string, json_candidate, without_thinking


@F.pandas_udf(StringType())
def nfkc(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def rewrite_url(params: dict[str, str]):
    """A column function that sets parameters of addresses."""

    @F.pandas_udf(StringType())
    def run(c: pd.Series) -> pd.Series:
        return c.map(lambda x: None if x is None else rewritten(x, **params))

    return run


def record_id(*cols: Column) -> Column:
    """The first id that isn't null or empty."""
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in cols))


def model_input(queries: Column, keywords: Column) -> Column:
    """struct(items, expected_len, keywords_only): queries numbered q_1.., or the keywords if all queries are blank."""
    filled = F.filter(F.transform(queries, clean_string), lambda x: x.isNotNull())
    only = F.coalesce(F.size(filled) == 0, F.lit(True))
    none = F.array().cast("array<struct<id:string,text:string>>")
    items = F.transform(queries, lambda x, i: F.struct(F.concat(F.lit("q_"), (i + 1).cast("string")).alias("id"), x.alias("text")))
    words = F.coalesce(F.transform(keywords, lambda x: F.struct(F.lit("keyword").alias("id"), x.alias("text"))), none)
    return F.struct(F.when(only, words).otherwise(items).alias("items"), F.when(only, 1).otherwise(F.size(queries)).alias("expected_len"), only.alias("keywords_only"))


def prompt(task: str, items: Column, missing: Column, hints: dict[str, str]) -> Column:
    """The task, one line per input item, and what to look for in each missing field; a note if nothing is missing."""
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x["id"], F.lit(": "), F.coalesce(x["text"], F.lit("")))), "\n")
    known = F.create_map(*(F.lit(y) for k, v in hints.items() for y in (k, v)))
    wanted = F.array_join(F.transform(missing, lambda m: F.concat(F.lit("* "), m, F.lit(": "), F.coalesce(F.try_element_at(known, m), F.lit("fill in if the text states it")))), "\n")
    return F.concat_ws("\n", F.lit(task), lines, F.when(F.size(missing) > 0, wanted).otherwise("All fields are present."))


def parsed_output(raw: Column, schema: str, required: str) -> Column:
    """struct(value, error) of a model's text: JSON_PARSE_ERROR if it isn't JSON, SCHEMA_VALIDATION_ERROR if a field is missing."""
    body = json_candidate(without_thinking(raw))
    ok = F.try_parse_json(body).isNotNull()
    value = F.from_json(body, schema)
    error = F.when(~F.coalesce(ok, F.lit(False)), "JSON_PARSE_ERROR").when(value[required].isNull(), "SCHEMA_VALIDATION_ERROR")
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def padded(c: Column, n: Column) -> Column:
    """Cut or filled with nulls to the expected length."""
    return F.slice(F.concat(F.coalesce(c, F.array().cast("array<string>")), F.array_repeat(F.lit(None).cast("string"), n)), F.lit(1), n)


def output_error(error: Column, queries: Column, edits: Column, expected: Column) -> Column:
    """The first thing wrong with a model's lists, null if nothing."""
    return (
        F.when(error.isNotNull(), error).when(queries.isNull(), "MISSING_OR_INVALID_LIST").when(edits.isNull(), "MISSING_OR_INVALID_EDITS")
        .when(F.size(edits) != F.size(queries), "EDITS_LENGTH_MISMATCH").when(F.size(queries) != expected, "LENGTH_MISMATCH")
    )


def coverage_of(direct: Column, nested: Column) -> Column:
    return F.coalesce(direct.cast("double"), nested["ratio"].cast("double"))


_IMAGE = re.compile(r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)")
_TAG = re.compile(r"<img\b[^>]*>", re.I)


def describe_images(text: str, captions: dict[str, str]) -> str:
    """Alternative texts from ``captions`` (by file) in Markdown images and tags; a caption line follows the first use of each."""
    told: set[str] = set()

    def caption(src: str) -> str | None:
        return captions.get(re.sub(r"^[./]+", "", src))

    def once(src: str, said: str) -> str:
        if src in told:
            return ""
        told.add(src)
        return f"\n\n*{said}*"

    def markdown(m: re.Match) -> str:
        said = caption(m[2])
        return m[0] if said is None else f"![{said}]({m[2]})" + once(m[2], said)

    def tag(m: re.Match) -> str:
        src = re.search(r"""src\s*=\s*["']([^"']+)""", m[0], re.I)
        said = caption(src[1]) if src else None
        if said is None:
            return m[0]
        bare = re.sub(r"""\s+alt\s*=\s*(?:"[^"]*"|'[^']*')""", "", m[0], flags=re.I)
        return bare[:4] + f' alt="{html.escape(said)}"' + bare[4:] + once(src[1], said)

    return _TAG.sub(tag, _IMAGE.sub(markdown, text))


@F.pandas_udf(StringType())
def describe_images_udf(text: pd.Series, captions: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else describe_images(t, dict(c or {})) for t, c in zip(text, captions)])
