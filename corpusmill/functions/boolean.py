"""The Boolean query language: tokens, canonical form, structure, fidelity measures, repair and search addresses."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import collapse

#: Fixed values of the query language.
OPERATORS = ("AND", "OR", "NOT")
TOKEN = r'("[^"\\]*(?:\\.[^"\\]*)*"|[()]|[^\s()]+)'
CURLY_DOUBLE, CURLY_SINGLE = "“”„«»‟", "’‘‚‛"
FIELD_HEADS = [
    r"TITLE-ABS-KEY\s*\(", r"TITLE\s*\(", r"ABS(?:TRACT)?\s*\(", r"KEY\s*\(", r"AUTHKEY\s*\(", r"AUTHOR-NAME\s*\(",
    r"TS\s*=\s*\(", r"TI\s*=\s*\(", r"AB\s*=\s*\(", r"ALL\s*=\s*\(",
]
FIELD_LABELS = "TI AB TS TITLE ABS KEY AUTHKEY AU".split()
YEAR = r"(?:19\d{2}|20\d{2})"
SEARCH_BASE = "https://api.example.org/works"
MIN_TERM = 2


def straight_quotes(c: Column) -> Column:
    return F.translate(c, CURLY_DOUBLE + CURLY_SINGLE, '"' * len(CURLY_DOUBLE) + "'" * len(CURLY_SINGLE))


def upper_operators(c: Column) -> Column:
    for op in OPERATORS:
        c = F.regexp_replace(c, rf"(?i)\b{op}\b", op)
    return c


def canonical(c: Column, fields: bool = True, metadata: bool = True) -> Column:
    """Quotes straight, tags, field names and metadata gone, operators upper case, white space collapsed; null is empty."""
    c = F.regexp_replace(straight_quotes(c), r"\[[a-zA-Z]+\]", "")
    if fields:
        for head in FIELD_HEADS:
            c = F.regexp_replace(c, rf"(?i)\b{head}", "(")
        c = F.regexp_replace(c, rf"(?i)\b(?:{'|'.join(FIELD_LABELS)})\s*:\s*", "")
    if metadata:
        for pattern in (r"(?i)\bLIMIT-TO\s*\([^)]*\)", r"(?i)\bPUBYEAR\s*[<>=]+\s*\d{4}", rf"\b{YEAR}\s*[-–]\s*{YEAR}\b", rf"\b{YEAR}\b"):
            c = F.regexp_replace(c, pattern, " ")
    c = F.regexp_replace(upper_operators(c), r"(?i)\b(?:NEAR|W)\s*/\s*\d+\b", "AND")
    return F.coalesce(collapse(F.replace(c, F.lit("$"), F.lit(" "))), F.lit(""))


def tokens(c: Column, keep_quotes: bool = False, escape_slash: bool = False) -> Column:
    """array<struct<type, val>>: PHRASE, PAREN, OP or TERM."""

    def token(t: Column) -> Column:
        phrase = F.startswith(t, F.lit('"')) & F.endswith(t, F.lit('"')) & (F.length(t) >= 2)
        inner = t if keep_quotes else F.substring(t, F.lit(2), F.length(t) - 2)
        term = F.replace(t, F.lit("/"), F.lit("\\/")) if escape_slash else t
        kind = F.when(phrase, "PHRASE").when(t.isin("(", ")"), "PAREN").when(F.upper(t).isin(*OPERATORS), "OP").otherwise("TERM")
        value = F.when(kind == "PHRASE", inner).when(kind == "OP", F.upper(t)).when(kind == "TERM", term).otherwise(t)
        return F.struct(kind.alias("type"), value.alias("val"))

    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(1)), token)


def clean_term(c: Column) -> Column:
    edge = r"[^\p{L}\p{N}_*?]+"
    return F.regexp_replace(F.replace(F.lower(F.trim(c)), F.lit("–"), F.lit("-")), f"^{edge}|{edge}$", "")


def _values(toks: Column, *kinds: str) -> Column:
    return F.transform(F.filter(toks, lambda t: t["type"].isin(*kinds)), lambda t: t["val"])


def terms(toks: Column) -> Column:
    """Cleaned terms and phrases of two characters or more."""
    return F.filter(F.transform(_values(toks, "TERM", "PHRASE"), clean_term), lambda t: F.length(t) >= MIN_TERM)


def unigrams(toks: Column) -> Column:
    """Terms, and of a phrase both itself and its words."""

    def parts(t: Column) -> Column:
        whole = clean_term(t["val"])
        words = F.filter(F.transform(F.split(whole, r"\s+"), clean_term), lambda w: F.length(w) >= MIN_TERM)
        single = F.filter(F.array(whole), lambda w: F.length(w) >= MIN_TERM)
        none = F.array().cast("array<string>")
        return F.when(t["type"] == "TERM", single).when((t["type"] == "PHRASE") & (whole != ""), F.concat(F.array(whole), words)).otherwise(none)

    return F.flatten(F.transform(toks, parts))


def operator_codes(toks: Column) -> Column:
    """Operators as one letter each: A, O, N."""
    return F.array_join(F.transform(_values(toks, "OP"), lambda v: F.substring(v, 1, 1)), "")


def skeleton(toks: Column) -> Column:
    """One letter per token: A, O, N, parentheses, t for terms and phrases."""
    return F.array_join(F.transform(toks, lambda t: F.when(t["type"].isin("TERM", "PHRASE"), "t").otherwise(F.substring(t["val"], 1, 1))), "")


def paren_stats(toks: Column) -> Column:
    """struct(balanced, max_depth); below zero the depth starts again."""
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"), F.lit(True).alias("ok"))

    def step(s: Column, v: Column) -> Column:
        d = s["d"] + F.when(v == "(", 1).otherwise(-1)
        return F.struct(F.greatest(d, F.lit(0)).alias("d"), F.greatest(s["m"], d).alias("m"), (s["ok"] & (d >= 0)).alias("ok"))

    return F.aggregate(_values(toks, "PAREN"), start, step, lambda s: F.struct((s["ok"] & (s["d"] == 0)).alias("balanced"), s["m"].alias("max_depth")))


def balance(c: Column) -> Column:
    """Closing parentheses without a partner dropped, missing ones appended, tokens joined by spaces."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("d"))

    def step(s: Column, t: Column) -> Column:
        v = t["val"]
        drop = (v == ")") & (s["d"] == 0) & (t["type"] == "PAREN")
        change = F.when(t["type"] != "PAREN", 0).when(v == "(", 1).when(drop, 0).otherwise(-1)
        return F.struct(F.when(drop, s["out"]).otherwise(F.array_append(s["out"], v)).alias("out"), (s["d"] + change).alias("d"))

    return F.aggregate(tokens(c, keep_quotes=True), start, step, lambda s: F.array_join(F.concat(s["out"], F.array_repeat(F.lit(")"), s["d"])), " "))


def prf(original: Column, other: Column) -> Column:
    """struct(precision, recall, f1, added, dropped) of two term lists as sets; two empty ones agree."""
    a, b = F.array_distinct(original), F.array_distinct(other)
    same = F.size(F.array_intersect(a, b))
    both_empty = (F.size(a) == 0) & (F.size(b) == 0)
    rate = lambda n, d: F.when(both_empty, 1.0).otherwise(F.coalesce(F.try_divide(n, d), F.lit(0.0)))
    p, r = rate(same, F.size(b)), rate(same, F.size(a))
    return F.struct(
        p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"),
        F.size(F.array_except(b, a)).alias("added"), F.size(F.array_except(a, b)).alias("dropped"),
    )


def code_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, of code strings; two empty ones are equal."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / n)


def assemble(queries: Column) -> Column:
    """Non-blank queries as they are if single, else each in parentheses, joined by OR."""
    q = F.filter(F.transform(queries, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(q) > 1, F.concat(F.lit("("), F.array_join(q, ") OR ("), F.lit(")"))).when(F.size(q) == 1, F.get(q, F.lit(0))).otherwise("")


def with_fidelity(df: DataFrame, original: str, normal: str) -> DataFrame:
    """Adds measures of how far a rewritten query keeps terms, operators and structure, to four places.

    Both columns are canonical. Tokens and lists are columns of their own, computed once.
    """
    df = df.withColumns({"_a": tokens(F.col(original)), "_b": tokens(F.col(normal))})
    df = df.withColumns({f"_{k}{f.__name__}": f(F.col(f"_{k}")) for k in "ab" for f in (terms, unigrams, operator_codes, skeleton, paren_stats)})
    df = df.withColumns({"_t": prf(F.col("_aterms"), F.col("_bterms")), "_u": prf(F.col("_aunigrams"), F.col("_bunigrams"))})
    r = lambda c: F.bround(c, 4)
    out = {f"{name}_{m}": r(F.col(f"{c}.{m}")) for c, name in (("_t", "term"), ("_u", "unigram")) for m in ("precision", "recall", "f1")}
    out |= {m: F.col(f"_t.{m}") for m in ("added", "dropped")}
    out |= {name: r(code_similarity(F.col(f"_a{f}"), F.col(f"_b{f}"))) for f, name in (("operator_codes", "operator_similarity"), ("skeleton", "skeleton_similarity"))}
    out |= {"original_balanced": F.col("_aparen_stats.balanced"), "normal_balanced": F.col("_bparen_stats.balanced")}
    out |= {"depth_change": F.col("_bparen_stats.max_depth") - F.col("_aparen_stats.max_depth")}
    mine = [c for c in df.columns if not c.startswith("_")]
    return df.select(*mine, *(c.alias(k) for k, c in out.items()))


def is_meaningful(c: Column) -> Column:
    """At least one term longer than a character, quotes and backslashes aside."""
    words = _values(tokens(c, keep_quotes=True), "TERM", "PHRASE")
    return F.exists(words, lambda w: F.length(F.replace(F.regexp_replace(w, r'^"+|"+$', ""), F.lit("\\"), F.lit(""))) > 1)


def syntax_flags(c: Column) -> Column:
    """Names of what is wrong with a query address's search term."""
    s = F.coalesce(c, F.lit(""))
    count = lambda ch: F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))
    rules = [
        ("missing_search", F.trim(s) == ""), ("unbalanced_quotes", count('"') % 2 == 1), ("unbalanced_parens", count("(") != count(")")),
        ("leading_operator", F.rlike(s, F.lit(r"(?i)^\s*(AND|OR)\b"))), ("trailing_operator", F.rlike(s, F.lit(r"(?i)\b(AND|OR|NOT)\s*$"))),
        ("double_operator", F.rlike(s, F.lit(r"(?i)\b(AND|OR)\s+(AND|OR)\b"))), ("empty_parens", F.rlike(s, F.lit(r"\(\s*\)"))), ("long_query", F.length(s) > 1000),
    ]
    return F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in rules)))


def percent_encode(c: Column) -> Column:
    """Percent-encoding of UTF-8 with ``/`` left as it is."""
    c = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def search_text(c: Column) -> Column:
    """Phrases with wildcards lose their quotes, all stars go, operators become upper case."""
    bare = F.regexp_replace(c, r'"([^"]*\*[^"]*)"', "$1")
    return F.trim(upper_operators(F.replace(bare, F.lit("*"), F.lit(""))))


def search_urls(queries: Column, years: Column, base: str = SEARCH_BASE) -> Column:
    """One address per query; a range gives both bounds, a single year the upper one. Null queries give null."""
    part = F.split(years, "-")
    two = F.size(part) == 2
    bounds = F.when(
        F.contains(years, F.lit("-")) & two,
        F.concat(F.lit("from_publication_date:"), F.trim(F.get(part, F.lit(0))), F.lit("-01-01,to_publication_date:"), F.trim(F.get(part, F.lit(1))), F.lit("-12-31")),
    ).when(F.rlike(years, F.lit(r"^\d+$")), F.concat(F.lit("to_publication_date:"), years, F.lit("-12-31")))
    tail = F.coalesce(F.concat(F.lit("&filter="), bounds), F.lit(""))
    return F.transform(queries, lambda q: F.concat(F.lit(f"{base}?search="), percent_encode(search_text(q)), tail))


# Repair: a state machine over tokens, in Python over Arrow batches.

_TOKEN = re.compile(TOKEN)
_ONION = re.compile(r"\(\(([^()]+)\)\)")


def _kind(t: str) -> str:
    if len(t) >= 2 and t[0] == t[-1] == '"':
        return "quoted"
    return "paren" if t in "()" else "op" if t.upper() in OPERATORS else "term"


def _merged(words: list[str]) -> Iterator[tuple[str, str]]:
    """Neighbouring terms: with wildcards all required, else a phrase; a single one loses leading wildcards."""
    if len(words) == 1:
        if bare := words[0].lstrip("*?"):
            yield "term", bare
    elif any(ch in w for w in words for ch in "*?"):
        yield "paren", "("
        for i, w in enumerate(words):
            if i:
                yield "op", "AND"
            yield "term", w
        yield "paren", ")"
    else:
        yield "quoted", f'"{" ".join(words)}"'


def strip_onion(q: str) -> str:
    """``((x))`` to ``(x)`` until nothing changes."""
    while (shorter := _ONION.sub(r"(\1)", q)) != q:
        q = shorter
    return q


def repair(q: str | None) -> str:
    """A query that a Lucene-like parser takes; empty for a blank one."""
    text = re.sub(r"\s+", " ", (q or "").strip().replace("$", ""))
    flow: list[tuple[str, str]] = []
    for kind, run in groupby(_TOKEN.findall(text), _kind):
        if kind == "term":
            flow.extend(_merged([w.replace("/", "\\/") for w in run]))
        else:
            flow.extend((kind, w.upper() if kind == "op" else w) for w in run)
    kept: list[tuple[str, str]] = []
    for kind, value in flow:
        if kind == "op":
            if not kept or kept[-1][1] == "(":
                continue
            if kept[-1][0] == "op":
                kept.pop()
        kept.append((kind, value))
    while kept and kept[-1][0] == "op":
        kept.pop()
    out = re.sub(r"\s+\)", ")", re.sub(r"\(\s+", "(", " ".join(v for _, v in kept)))
    out = re.sub(r"(AND|OR|NOT)\(", r"\1 (", re.sub(r"\)(AND|OR|NOT)", r") \1", out))
    excess = out.count(")") - out.count("(")
    out = out.replace(")", "", excess) if excess > 0 else out + ")" * -excess
    return strip_onion(out.strip())


def _repairable(q: object) -> bool:
    return isinstance(q, str) and any(_kind(t) in ("term", "quoted") and len(t.strip('"').replace("\\", "")) > 1 for t in _TOKEN.findall(q))


def repair_list(queries) -> list[str] | None:
    """Repaired queries of a record; without any operator they are merged into one, null if nothing is left."""
    good = [q for q in queries if _repairable(q)]
    fixed = [repair(q) for q in good]
    if any(_kind(t) == "op" for q in good for t in _TOKEN.findall(q)):
        valid = [f for f in fixed if any(_kind(t) in ("term", "quoted") for t in _TOKEN.findall(f))]
        return valid or None
    unique = list({f.lower(): f for f in reversed(fixed) if f}.values())[::-1]
    return [f"({' OR '.join(unique)})"] if unique else None


@F.pandas_udf(StringType())
def repair_udf(q: pd.Series) -> pd.Series:
    return q.map(repair)


@F.pandas_udf(ArrayType(StringType()))
def repair_list_udf(q: pd.Series) -> pd.Series:
    return q.map(lambda x: None if x is None else repair_list(x))


_SPLIT = re.compile(r"(\bAND\b|\bOR\b|\bNOT\b|[()])", re.I)


def sanitise(q: str) -> str:
    """Quotes straight, operators upper case, unquoted phrases quoted, and a search prefix."""
    for ch in CURLY_DOUBLE + CURLY_SINGLE + "‹›":
        q = q.replace(ch, '"')
    parts = []
    for part in _SPLIT.split(q):
        t = part.strip()
        if not part:
            continue
        plain = t.upper() in (*OPERATORS, "(", ")") or t.startswith("search=")
        parts.append(t.upper() if plain and not t.startswith("search=") else f'"{t}"' if not plain and " " in t and '"' not in t else t)
    q = " ".join(parts).replace("( ", "(").replace(" )", ")").strip()
    return q if not q or q.lower().startswith("search=") else f"search={q}" if q.startswith("(") else f"search=({q})"


@F.pandas_udf(StringType())
def sanitise_udf(q: pd.Series) -> pd.Series:
    return q.map(lambda x: None if x is None else sanitise(x))
