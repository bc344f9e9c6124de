"""Profiling and evaluation: coverage, percentiles in three conventions, histograms, retrieval measures."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed


def field_coverage(df: DataFrame, filled: dict[str, Column]) -> DataFrame:
    """Per field: filled, missing, pct; one pass over the rows."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(c).alias(k) for k, c in filled.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.col(f"`{k}`").alias("filled")) for k in filled))).alias("_x")
    rows = one.select("_n", pairs).select("_x.*", (F.col("_n") - F.col("_x.filled")).alias("missing"), "_n")
    return rows.select("field", "filled", "missing", F.bround(F.coalesce(F.try_divide(F.col("filled") * 100, "_n"), F.lit(0.0)), 4).alias("pct"))


def value_counts(df: DataFrame, c: Column, n: int = 15, missing: str = "Unknown") -> DataFrame:
    return df.groupBy(F.coalesce(c.cast("string"), F.lit(missing)).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def percentiles(df: DataFrame, c: Column, points: Sequence[float], kind: str = "linear", by: Sequence[str] = ()) -> DataFrame:
    """Columns p<point>: ``linear`` interpolates, ``nearest`` takes rank ceil(p n), ``rounded`` index round-half-even(p (n - 1)).

    Distinct values are counted, dealt by ranges, and added up within a range; the ranges' totals say
    how many stand before each. No task sees all values of a group, and no list of them is made.
    """
    x = c.cast("double")
    counts = df.where(c.isNotNull()).groupBy(*by, x.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranged = checkpointed(counts.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy(*by, "_part").agg(F.sum("_n").alias("_sum"))  # a row for each range and group
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*(F.col(k).alias(f"_o{i}") for i, k in enumerate(by)), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy(*by)).alias("_total"))
    same = [F.col(k).eqNullSafe(F.col(f"_o{i}")) for i, k in enumerate(by)]
    joined = ranged.join(offsets, functools.reduce(lambda a, b: a & b, same, F.col("_part") == F.col("_p")))
    upto = joined.withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy("_v")))
    n = F.col("_total")
    at = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col("_v")))  # noqa: E731  the value of a rank, from 1

    def value(p: float) -> Column:
        if kind == "nearest":
            return at(F.greatest(F.lit(1), F.least(n, F.ceil(F.round(n * p, 9)))))
        place = (n - 1) * F.lit(float(p))
        if kind == "rounded":
            return at(F.bround(place).cast("long") + 1)
        low, high = at(F.floor(place) + 1), at(F.ceil(place) + 1)
        return F.when(low == high, low).otherwise(low + (high - low) * F.max(place - F.floor(place)))

    return upto.groupBy(*by).agg(*(value(p).alias(_name(p)) for p in points))


def _name(p: float) -> str:
    return f"p{round(p * 100):d}"


def summary(df: DataFrame, c: Column) -> DataFrame:
    return df.agg(F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.round(F.avg(c), 6).alias("mean"), F.percentile(c, F.lit(0.5)).alias("median"))


def histogram(df: DataFrame, c: Column, low: float, high: float, bins: int) -> DataFrame:
    """Counts per equal bin; values outside go to the nearest bin, the last bin is closed."""
    width = (high - low) / bins
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((c - low) / width)))
    return df.where(c.isNotNull()).groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def log_histogram(df: DataFrame, c: Column, per_decade: int = 1) -> DataFrame:
    """Counts per logarithmic bin; -1 holds zeros."""
    at = F.when(c <= 0, -1).otherwise(F.floor(F.round(F.log10(c) * per_decade, 9)))
    return df.where(c.isNotNull()).groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_clipped(df: DataFrame, c: Column, bins: int, top: float = 0.99) -> DataFrame:
    """(bin, low, high, n): equal bins from the least value to a percentile; what is above it is left out."""
    limits = percentiles(df, c, (top,)).crossJoin(df.agg(F.min(c).cast("double").alias("_low"))).select("_low", F.col(_name(top)).alias("_high"))
    rows = df.where(c.isNotNull()).select(c.cast("double").alias("_v")).crossJoin(F.broadcast(limits)).where("_v <= _high")
    width = (F.col("_high") - F.col("_low")) / bins
    at = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_low")) / width))).otherwise(0).cast("long")
    out = rows.groupBy(at.alias("bin"), "_low", width.alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("bin", (F.col("_low") + F.col("bin") * F.col("_w")).alias("low"), (F.col("_low") + (F.col("bin") + 1) * F.col("_w")).alias("high"), "n")


def boxplot(df: DataFrame, c: Column, limits: Sequence[float] = ()) -> DataFrame:
    """Quartiles, upper fence, outliers beyond it, and counts beyond given limits; two passes over one column."""
    q = df.agg(*(F.percentile(c, F.lit(p)).alias(k) for p, k in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))))
    fenced = df.select(c.cast("double").alias("_v")).crossJoin(F.broadcast(q.withColumn("fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))))
    over = [F.count_if(F.col("_v") > x).alias(f"over_{int(x)}") for x in limits]
    return fenced.groupBy("q1", "q2", "q3", "fence").agg(F.count_if(F.col("_v") > F.col("fence")).alias("outliers"), *over)


def coverage_bucket(ratio: Column) -> Column:
    return F.when(ratio >= 0.9, "90+").when(ratio >= 0.8, "80-89").when(ratio >= 0.7, "70-79").when(ratio >= 0.6, "60-69").otherwise("<60")


def f_beta(p: Column, r: Column, beta: float) -> Column:
    return F.coalesce(F.try_divide((1 + beta * beta) * p * r, beta * beta * p + r), F.lit(0.0))


def as_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull()))


def retrieval_rows(df: DataFrame, key: str, relevant: str, retrieved: str) -> DataFrame:
    """Per record: counts, precision, recall, F1, F3 of retrieved against relevant ids as sets."""
    rel, ret = as_set(F.col(relevant)), as_set(F.col(retrieved))
    out = df.select(key, F.size(rel).alias("relevant_count"), F.size(ret).alias("retrieved_count"), F.size(F.array_intersect(rel, ret)).alias("true_positives"))
    out = out.withColumns({
        "precision": F.coalesce(F.try_divide("true_positives", "retrieved_count"), F.lit(0.0)),
        "recall": F.coalesce(F.try_divide("true_positives", "relevant_count"), F.lit(0.0)),
    })
    return out.withColumns({"f1": f_beta(F.col("precision"), F.col("recall"), 1), "f3": f_beta(F.col("precision"), F.col("recall"), 3)})


def retrieval_summary(rows: DataFrame) -> DataFrame:
    """Micro measures of the summed counts, and macro means of the per-record ones."""
    s = rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum("true_positives").alias("tp"), F.sum("retrieved_count").alias("ret"), F.sum("relevant_count").alias("rel"),
        *(F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1", "f3")),
    )
    p, r = (F.coalesce(F.try_divide("tp", c), F.lit(0.0)) for c in ("ret", "rel"))
    micro = {"micro_precision": p, "micro_recall": r, "micro_f1": f_beta(p, r, 1), "micro_f3": f_beta(p, r, 3)}
    return s.select("n", *(F.round(c, 6).alias(k) for k, c in micro.items()), "macro_precision", "macro_recall", "macro_f1", "macro_f3")


def repair_impact(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Per field and in total: missing before, recovered, regressed; fields are boolean columns, rows are in both."""
    joined = before.select(key, *(F.col(f).alias(f"b_{f}") for f in fields)).join(after.select(key, *(F.col(f).alias(f"a_{f}") for f in fields)), key)
    long = joined.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"b_{f}").alias("b"), F.col(f"a_{f}").alias("a")) for f in fields))).alias("x")).select("x.*")
    out = long.rollup("field").agg(
        F.count_if(~F.col("b")).alias("missing_before"), F.count_if(~F.col("b") & F.col("a")).alias("recovered"), F.count_if(F.col("b") & ~F.col("a")).alias("regressed"))
    return out.withColumn("field", F.coalesce("field", F.lit("TOTAL"))).withColumn("gain_pct", F.bround(F.coalesce(F.try_divide(F.col("recovered") * 100, "missing_before"), F.lit(0.0)), 4))


def error_summary(df: DataFrame, errors: str) -> DataFrame:
    """Counts of rows whose error lists are missing, empty, all null, or hold errors."""
    e = F.col(errors)
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(e.isNull()).alias("missing_errors"), F.count_if(F.size(e) == 0).alias("no_queries"),
        F.count_if((F.size(e) > 0) & F.forall(e, lambda x: x.isNull())).alias("ok"), F.count_if(F.exists(e, lambda x: x.isNotNull())).alias("failed"),
        F.coalesce(F.sum(F.size(F.filter(e, lambda x: x.isNotNull()))), F.lit(0)).alias("error_items"),
    )


def without_result(df: DataFrame, results: Column, expected: Column) -> DataFrame:
    """Rows none of whose results is there: in all, with results expected, and without."""
    none = ~F.coalesce(F.exists(results, lambda x: F.trim(x) != ""), F.lit(False))
    some = F.coalesce(expected > 0, F.lit(False))
    return df.agg(F.count_if(none).alias("no_result"), F.count_if(none & some).alias("expected"), F.count_if(none & ~some).alias("not_expected"))


def changed(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row: rows in both, rows in which any of the columns changed (null counts as a value), and changes per column."""
    joined = before.select(key, *(F.col(c).alias(f"_b_{c}") for c in columns)).join(after.select(key, *(F.col(c).alias(f"_a_{c}") for c in columns)), key)
    differs = {c: ~F.col(f"_b_{c}").eqNullSafe(F.col(f"_a_{c}")) for c in columns}
    some = F.lit(False)
    for d in differs.values():
        some = some | d
    return joined.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(some).alias("n_changed"), *(F.count_if(d).alias(f"changed_{c}") for c, d in differs.items()))


def statistics(df: DataFrame, filled: dict[str, Column], present: dict[str, Column], either: tuple[str, str], key: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """One row of counters over records, in one pass: rows, every ``filled`` and ``present`` predicate, the sum of the ``either``
    pair (rows with both count twice), rows with any of the pair, with all ``key`` fields and any of the pair, with all ``stats``
    fields, and with all of these."""
    flags = {k: F.coalesce(c, F.lit(False)) for k, c in (filled | present).items()}
    every = lambda names: functools.reduce(lambda a, b: a & b, (flags[n] for n in names), F.lit(True))
    any_of = flags[either[0]] | flags[either[1]]
    core, numbers = every(key) & any_of, every(stats)
    return df.agg(
        F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(k) for k, c in flags.items()),
        (F.count_if(flags[either[0]]) + F.count_if(flags[either[1]])).alias("either_sum"), F.count_if(any_of).alias("either"),
        F.count_if(core).alias("all_key"), F.count_if(numbers).alias("all_stats"), F.count_if(core & numbers).alias("all"),
    )


def ids_by_error(df: DataFrame, key: str, errors: str) -> DataFrame:
    flat = df.select(key, F.explode(errors).alias("error")).where("error is not null").distinct()
    return flat.groupBy("error").agg(F.sort_array(F.collect_list(key)).alias("ids"))


def presence(df: DataFrame, raw: str) -> DataFrame:
    """Per key of JSON objects: how often it is there with a value that isn't null, empty, false or zero; pct to four places."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    entries = F.explode(F.map_entries(F.from_json(raw, "map<string,string>"))).alias("x")
    empty = F.coalesce(F.col("x.value"), F.lit("")).isin("", "[]", "{}", "false", "0", "0.0", "null")
    per = df.select(entries).groupBy(F.col("x.key").alias("key")).agg(F.count_if(~empty).alias("present"))
    return per.crossJoin(F.broadcast(total)).select("key", "present", F.bround(F.col("present") * 100 / F.col("_n"), 4).alias("pct"))


def conjunctions(df: DataFrame, flags: dict[str, Column], together: Sequence[Sequence[str]]) -> DataFrame:
    """One row of counts: every flag, every named conjunction (a_and_b), and of pairs also either (or) and their sum."""
    out = [F.count_if(c).alias(k) for k, c in flags.items()]
    for names in together:
        cond, either = F.lit(True), F.lit(False)
        for n in names:
            cond, either = cond & flags[n], either | flags[n]
        out.append(F.count_if(cond).alias("_and_".join(names)))
        if len(names) == 2:
            out.append(F.count_if(either).alias("_or_".join(names)))
            out.append((F.count_if(flags[names[0]]) + F.count_if(flags[names[1]])).alias("_or_".join(names) + "_sum"))
    return df.agg(F.count(F.lit(1)).alias("total"), *out)


def population(df: DataFrame, c: Column, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, extremes, quartiles (rounded ranks) and upper median of a measure."""
    base = df.where(c.isNotNull()).select(*by, c.cast("double").alias("_m"))
    s = base.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("_m"), 6).alias("mean"), F.min("_m").alias("min"), F.max("_m").alias("max"))
    q = percentiles(base, F.col("_m"), (0.25, 0.5, 0.75), "rounded", by)
    return s.join(q, list(by)) if by else s.crossJoin(q)


def funnel(stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of each stage, in order, and their share of the first."""
    parts = None
    for i, (name, df) in enumerate(stages):
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("step"), F.lit(name).alias("stage"), "n")
        parts = one if parts is None else parts.unionByName(one)
    first = parts.where("step = 0").select(F.col("n").alias("_first"))
    return parts.crossJoin(F.broadcast(first)).select("step", "stage", "n", F.bround(F.coalesce(F.try_divide(F.col("n") * 100, "_first"), F.lit(0.0)), 4).alias("pct"))
