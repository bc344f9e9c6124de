"""Evidence alignment, fact checking with pluggable scorers, and repair of extracted records."""

from __future__ import annotations

import difflib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType

from ..functions.text import join_hyphenated

THRESHOLD, MIN_QUOTE = 70, 5


def _common(where: dict[str, int], n: int, text: str) -> int:
    """Length of the longest common subsequence of ``text`` and the string of length n whose characters stand at ``where``."""
    full = v = (1 << n) - 1
    for c in text:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def partial_ratio(needle: str, text: str, cutoff: float = 0.0) -> float:
    """0-100: the best indel similarity of the shorter string to a window of the longer one.

    All windows are tried, except those that a bound excludes: what a window shares with the
    shorter string is at most the characters that both have, and at most the longest common
    subsequence. With a cutoff, the result is exact from there on and only known to be less below.
    """
    a, b = (needle, text) if len(needle) <= len(text) else (text, needle)
    if not a:
        return 0.0
    if a in b:
        return 100.0
    n, best = len(a), 0
    points = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)
    shared = np.zeros(len(b) - n + 1, np.int64)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    for c, at in where.items():
        sums = np.concatenate([[0], np.cumsum(points == ord(c))])
        shared += np.minimum(sums[n:] - sums[:-n], at.bit_count())
    least = max(1, math.ceil(cutoff * n / 100 - 1e-9))
    step = max(1, n // 8)
    runs = range(0, len(shared), step)  # neighbouring starts, of which one bound excludes all
    runs = [(int(shared[lo : lo + step].max()), lo) for lo in runs]
    match = difflib.SequenceMatcher(None, "", a, autojunk=False)
    for most, lo in sorted(runs, key=lambda x: (-x[0], x[1])):
        if most < max(least, best + 1):
            break
        if _common(where, n, b[lo : lo + step + n - 1]) < max(least, best + 1):
            continue
        for s in range(lo, min(lo + step, len(shared))):
            if shared[s] >= max(least, best + 1) and _common(where, n, b[s : s + n]) >= max(least, best + 1):
                match.set_seq1(b[s : s + n])
                best = max(best, sum(m.size for m in match.get_matching_blocks()))
    return 2.0 * best / (2 * n) * 100


def ratio_udf(cutoff: float):
    @F.pandas_udf(DoubleType())
    def ratio(needle: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else partial_ratio(a, b, cutoff) for a, b in zip(needle, text)])

    return ratio


partial_ratio_udf = ratio_udf(0.0)


def quote_exact(quote: Column, value_empty: Column, text: Column, least: int = MIN_QUOTE) -> Column:
    """ok, failed, or fuzzy where only a fuzzy comparison can tell; quote and text are cleaned first."""
    q, t = join_hyphenated(quote), join_hyphenated(text)
    inside = F.coalesce(F.contains(t, q), F.lit(False))
    missing = F.coalesce(q, F.lit("")) == ""
    return F.when(missing & value_empty, "ok").when(missing, "failed").when(inside, "ok").when(F.length(q) < least, "failed").otherwise("fuzzy")


def verify_quotes(df: DataFrame, quote: str, value_empty: Column, text: str, threshold: float = THRESHOLD, least: int = MIN_QUOTE) -> DataFrame:
    """Adds ``verified``, in one pass. Texts of rows that an exact test decides never reach Python."""
    staged = df.withColumn("_stage", quote_exact(F.col(quote), value_empty, F.col(text), least))
    doubt = F.col("_stage") == "fuzzy"
    score = ratio_udf(threshold)(F.when(doubt, join_hyphenated(F.col(quote))), F.when(doubt, join_hyphenated(F.col(text))))
    return staged.withColumn("verified", F.when(doubt, F.coalesce(score >= threshold, F.lit(False))).otherwise(F.col("_stage") == "ok")).drop("_stage")


def verify_fields(df: DataFrame, key: str, fields: Sequence[str], texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with failed evidence nulled; its quotes meet the texts once, however many fields there are."""
    one = [F.struct(F.lit(f).alias("field"), F.col(f)["verbatim_source"].alias("_q"), F.coalesce(F.col(f)["value"].isNull(), F.lit(True)).alias("_empty")) for f in fields]
    long = df.select(key, F.explode(F.array(*one)).alias("x")).select(key, "x.*").join(texts, key, "left")
    bad = verify_quotes(long, "_q", F.col("_empty"), "text", threshold).where("not verified").groupBy(key).agg(F.collect_set("field").alias("_bad"))
    joined = df.join(bad, key, "left")
    ok = {f: ~F.coalesce(F.array_contains("_bad", f), F.lit(False)) for f in fields}
    return joined.withColumns({f: nullify(F.col(f), ok[f]) for f in fields}).drop("_bad")


#: Passages, and characters of them, that are sent to the tasks at once; more are taken in several passes.
SENT_PASSAGES, SENT_CHARS = 100_000, 20_000_000


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Rows (id, passage), read one block at a time."""
    block, chars = [], 0
    for r in items.toLocalIterator():
        if block and (len(block) >= SENT_PASSAGES or chars + len(r[1]) > SENT_CHARS):
            yield block
            block, chars = [], 0
        block.append((r[0], r[1]))
        chars += len(r[1])
    if block:
        yield block


def _holders(block: list[tuple], kind: pa.DataType):
    """All but the first and the last word of a passage are whole words of a text that holds it: the longest of them is looked up."""
    by_word: dict[str, list[tuple]] = {}
    short = []
    for i, q in block:
        inner = q.split(" ")[1:-1]
        (by_word.setdefault(max(inner, key=len), []) if inner else short).append((i, q))
    words = by_word.keys()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []
            for k, d in enumerate(batch["d"].to_pylist()):
                met = [i for i, q in short if q in d] + [i for w in words & set(d.split(" ")) for i, q in by_word[w] if q in d]
                row += [k] * len(met)
                found += met
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(row, pa.int64())), pa.array(found, kind)], ["doc_id", "item_id"])

    return run


def held_passages(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """(doc_id, item_id) where a text holds a passage as a substring; words stand apart by single spaces in both.

    Texts are tested where they are, and nothing but the result shuffles; there is a pass over the texts
    for every ``SENT_PASSAGES`` passages. Null texts and passages match nothing; an empty passage is in every text.
    """
    d = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("d"))
    q = items.where(F.col(passage).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(passage).alias("q")).distinct()
    ddl = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, item_id {q.schema['item_id'].dataType.simpleString()}"
    out = None
    for block in _blocks(q):
        part = d.mapInArrow(_holders(block, to_arrow_type(q.schema["item_id"].dataType)), ddl)
        out = part if out is None else out.unionByName(part)
    return d.sparkSession.createDataFrame([], ddl) if out is None else out.distinct()


def verdict(checks: Column, text: Column) -> Column:
    """struct(status, score, errors) of an array of struct(path, ok); an empty document is invalid with score 0."""
    total, failed = F.size(checks), F.filter(checks, lambda c: ~c["ok"])
    empty = F.coalesce(F.trim(text), F.lit("")) == ""
    score = F.when(empty, 0.0).when(total == 0, 1.0).otherwise((total - F.size(failed)) / total)
    status = F.when(empty, "CRITICAL_ERROR").when(F.size(failed) > 0, "FAIL").otherwise("PASS")
    return F.struct(status.alias("status"), score.alias("score"), F.transform(failed, lambda c: c["path"]).alias("errors"))


def nullify(ev: Column, ok: Column) -> Column:
    """An evidence struct whose value and quote go if the check failed."""
    names = ("value", "verbatim_source")
    return F.when(ev.isNotNull(), F.struct(*(F.when(ok, ev[n]).alias(n) for n in names)))


def nullify_queries(queries: Column, ok: Column) -> Column:
    """Of queries with a failed quote only the quote goes."""
    return F.transform(F.arrays_zip(queries.alias("q"), ok.alias("ok")), lambda x: F.struct(
        x["q"]["boolean_query_string"].alias("boolean_query_string"), x["q"]["database_source"].alias("database_source"),
        F.when(x["ok"], x["q"]["verbatim_source"]).alias("verbatim_source")))


def pairs(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, claim, quote) of evidence fields with both parts; values are rendered as text."""
    def claim(f: str) -> Column:
        c = F.col(f)["value"]
        kind = df.schema[f].dataType["value"].dataType.typeName()
        return F.array_join(c, ", ") if kind == "array" else F.initcap(c.cast("string")) if kind == "boolean" else c.cast("string")

    one = [F.struct(F.lit(f).alias("field"), claim(f).alias("claim"), F.col(f)["verbatim_source"].alias("quote")) for f in fields]
    return df.select(key, F.explode(F.array(*one)).alias("x")).select(key, "x.*").where("claim is not null and quote is not null")


def containment(claims: Sequence[str], quotes: Sequence[str]) -> list[float]:
    """Stand-in scorer: the share of the claim's tokens that the quote holds."""
    out = []
    for c, q in zip(claims, quotes):
        tokens = c.lower().split()
        out.append(sum(t in q.lower() for t in tokens) / len(tokens) if tokens else 0.0)
    return out


def fact_check(claims: DataFrame, scorer: Callable[[Sequence[str], Sequence[str]], Sequence[float]] = containment, threshold: float = 0.5, chunk: int = 128) -> DataFrame:
    """Adds support_probability and status (PASS, FAIL, ERROR); a chunk whose scorer fails is all ERROR."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in claims.schema) + ", support_probability double, status string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), chunk):
                part = frame.iloc[lo : lo + chunk].copy()
                try:
                    p = pd.Series(list(scorer(part["claim"].tolist(), part["quote"].tolist())), index=part.index, dtype=float)
                    part["support_probability"], part["status"] = p, p.ge(threshold).map({True: "PASS", False: "FAIL"})
                except Exception:  # fail closed
                    part["support_probability"], part["status"] = None, "ERROR"
                yield part

    return claims.mapInPandas(run, schema)


def patched(base: Column, repaired: Column, wanted: Column) -> Column:
    """A repaired field where it was asked for and has a value."""
    return F.when(wanted & repaired["value"].isNotNull(), repaired).otherwise(base)


def load_status(path: Column, text: Column) -> Column:
    """Error of a record whose text can't be used, null if it can."""
    return F.when(path.isNull(), "FILE_NOT_FOUND").when(text.isNull(), "READ_ERROR").when(F.trim(text) == "", "EMPTY_TEXT")


def scored_batches(df: DataFrame, model: Callable[[list[str]], list[str]], column: str = "text", batch: int = 50) -> DataFrame:
    """Adds raw_output and error from a pluggable model over batches; a failed batch is marked row by row."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", raw_output string, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch].copy()
                try:
                    part["raw_output"], part["error"] = model(part[column].tolist()), None
                except Exception as e:
                    part["raw_output"], part["error"] = None, f"{type(e).__name__}: {e}"
                yield part

    return df.mapInPandas(run, schema)
