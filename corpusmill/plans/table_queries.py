"""Queries over orders, lineitem, part, events and their like: years, Boolean language, scores, evaluation, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boolean as B
from ..functions import evidence as E
from ..functions import records as R
from ..functions import text as T
from ..functions.years import normalise_year_range
from ..operators import aggregate as A
from ..operators import filters as P
from ..operators import joins as J
from ..sources import remote
from .registry import query

_RAW = {
    0: "'from ' || y || ' to ' || (y - 5)", 1: "y || ' to present'", 2: "'since ' || y", 3: "'last 5 years'", 4: "'past ten years'", 5: "'last 2 decades'",
    6: "'past decade'", 7: "'recent few years'", 8: "'published ' || y", 9: "'any time'", 10: "NULL", 11: "'last 200 years'",
}
_YEARS = f"SELECT o_orderkey, y, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE y + 20 END AS sy, CASE o_orderkey % 12 {' '.join(f'WHEN {k} THEN {v}' for k, v in _RAW.items())} END AS raw FROM (SELECT o_orderkey, year(o_orderdate)::INT AS y FROM orders)"
_RULES = f"""
WITH b AS ({_YEARS}), r AS (SELECT *, o_orderkey % 12 AS k FROM b)
SELECT o_orderkey, CASE k WHEN 0 THEN (y - 5) || '-' || y WHEN 1 THEN CASE WHEN sy IS NOT NULL THEN y || '-' || sy END WHEN 2 THEN CASE WHEN sy IS NOT NULL THEN y || '-' || sy END
 WHEN 3 THEN (sy - 4) || '-' || sy WHEN 4 THEN (sy - 9) || '-' || sy WHEN 5 THEN (sy - 19) || '-' || sy WHEN 6 THEN (sy - 9) || '-' || sy WHEN 7 THEN (sy - 4) || '-' || sy
 WHEN 8 THEN sy::VARCHAR WHEN 9 THEN sy::VARCHAR WHEN 10 THEN sy::VARCHAR ELSE NULL END AS range,
 CASE WHEN k = 0 THEN 'two_years' WHEN k = 1 THEN CASE WHEN sy IS NULL THEN 'year_to_present_missing_study_year' ELSE 'year_to_present' END
 WHEN k = 2 THEN CASE WHEN sy IS NULL THEN 'since_year_missing_study_year' ELSE 'since_year' END
 WHEN k = 10 THEN CASE WHEN sy IS NOT NULL THEN 'fallback_study_year' END
 WHEN sy IS NULL THEN 'no_rule' ELSE CASE k WHEN 3 THEN 'last_n_years' WHEN 4 THEN 'last_word_years' WHEN 5 THEN 'last_n_decades' WHEN 6 THEN 'last_decade' WHEN 7 THEN 'last_few_years' WHEN 11 THEN 'invalid_last_n_years' ELSE 'fallback_study_year' END END AS rule
FROM r"""


def _years(t):
    spark_sql = _YEARS.split(" FROM (SELECT o_orderkey, year")[0].removeprefix("SELECT ")
    rows = t("orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    case = spark_sql.split("END AS sy, ")[1].removesuffix(" AS raw")
    return rows.withColumn("sy", F.when(F.col("o_orderkey") % 7 != 0, F.col("y") + 20)).withColumn("raw", F.expr(case))


@query(_RULES)
def year_range_normalise(t, spark):
    return _years(t).select("o_orderkey", normalise_year_range(F.col("raw"), F.col("sy")).alias("x")).select("o_orderkey", "x.range", "x.rule")


@query(f"SELECT coalesce(rule, 'none') AS rule, count(*) AS n FROM ({_RULES}) GROUP BY 1")
def year_rule_counts(t, spark):
    return _years(t).select(F.coalesce(normalise_year_range(F.col("raw"), F.col("sy"))["rule"], F.lit("none")).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


# A query text per part: words of its name, a quoted type, its brand, with tags, years and stray parentheses.
_Q = """'(' || p_name || ' and "' || lower(p_type) || '"[tiab]) or TI=(' || p_brand || ' NEAR/3 x$y) ' || CASE WHEN p_partkey % 3 = 0 THEN '1999-2005)' WHEN p_partkey % 3 = 1 THEN 'AND (2010' ELSE 'not z*' END"""
_CANON = f"""trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_Q},
 '\\[[a-zA-Z]+\\]', '', 'g'), '\\bTI\\s*=\\s*\\(', '(', 'gi'), '\\b(19\\d{{2}}|20\\d{{2}})\\s*[-–]\\s*(19\\d{{2}}|20\\d{{2}})\\b', ' ', 'g'), '\\b(19\\d{{2}}|20\\d{{2}})\\b', ' ', 'g'),
 '\\band\\b', 'AND', 'gi'), '\\bor\\b', 'OR', 'gi'), '\\bnot\\b', 'NOT', 'gi'), '\\bNEAR\\s*/\\s*\\d+\\b', 'AND', 'gi'), '$', ' '), '\\s+', ' ', 'g'))"""
_TOK = r"""regexp_extract_all(c, '("[^"\\]*(?:\\.[^"\\]*)*"|[()]|[^\s()]+)')"""
_KINDS = f"list_transform({_TOK}, lambda x: CASE WHEN x[1] = '\"' AND length(x) > 1 THEN 't' WHEN x IN ('(', ')') THEN x WHEN upper(x) IN ('AND', 'OR', 'NOT') THEN upper(x)[1] ELSE 't' END)"


def _queries(t):
    return t("part").select("p_partkey", F.expr(_Q).alias("q"))


@query(f"SELECT p_partkey, {_CANON} AS canonical FROM part")
def bool_canonicalise(t, spark):
    return _queries(t).select("p_partkey", B.canonical(F.col("q")).alias("canonical"))


@query(f"SELECT p_partkey, list_transform({_TOK}, lambda x: CASE WHEN x[1] = '\"' AND length(x) > 1 THEN 'PHRASE:' || x[2:-2] WHEN x IN ('(', ')') THEN 'PAREN:' || x WHEN upper(x) IN ('AND', 'OR', 'NOT') THEN 'OP:' || upper(x) ELSE 'TERM:' || x END) AS tokens FROM (SELECT p_partkey, {_Q} AS c FROM part)")
def bool_tokenise(t, spark):
    return _queries(t).select("p_partkey", F.transform(B.tokens(F.col("q")), lambda x: F.concat(x["type"], F.lit(":"), x["val"])).alias("tokens"))


@query(f"""WITH k AS (SELECT p_partkey, {_KINDS} AS k FROM (SELECT p_partkey, {_CANON} AS c FROM part)),
e AS (SELECT p_partkey, unnest(k) AS x, generate_subscripts(k, 1) AS i FROM k),
d AS (SELECT p_partkey, sum(CASE x WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY i) AS d FROM e),
s AS (SELECT p_partkey, max(d) AS m, min(d) AS lo, sum(1) AS n FROM d GROUP BY p_partkey), z AS (SELECT p_partkey, sum(CASE x WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) AS total FROM e GROUP BY p_partkey)
SELECT p_partkey, lo >= 0 AND total = 0 AS balanced, greatest(0, m)::INT AS max_depth FROM s JOIN z USING (p_partkey)""")
def bool_paren_stats(t, spark):
    return _queries(t).select("p_partkey", B.paren_stats(B.tokens(B.canonical(F.col("q")))).alias("x")).select("p_partkey", "x.balanced", "x.max_depth")


@query(f"""WITH k AS (SELECT p_partkey, array_to_string({_KINDS}, '') AS a, regexp_replace(array_to_string({_KINDS}, ''), '[^AON]', '', 'g') AS o FROM (SELECT p_partkey, {_CANON} AS c FROM part))
SELECT p_partkey, o AS ops, a AS skeleton, round(1 - levenshtein(a, 'tAtOt') / greatest(length(a), 5)::DOUBLE, 6) AS similarity FROM k""")
def bool_ops_similarity(t, spark):
    toks = B.tokens(B.canonical(F.col("q")))
    rows = _queries(t).select("p_partkey", B.operator_codes(toks).alias("ops"), B.skeleton(toks).alias("skeleton"))
    return rows.withColumn("similarity", F.round(B.code_similarity(F.col("skeleton"), F.lit("tAtOt")), 6))


@query("""WITH s AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(lower(p_type), ' ') || string_split(p_name, ' ')[1:1]) AS b FROM part),
n AS (SELECT *, length(list_intersect(a, b)) AS c FROM s)
SELECT p_partkey, round(c / length(b)::DOUBLE, 6) AS precision, round(c / length(a)::DOUBLE, 6) AS recall, CASE WHEN c = 0 THEN 0 ELSE round(2.0 * (c / length(b)::DOUBLE) * (c / length(a)::DOUBLE) / (c / length(b)::DOUBLE + c / length(a)::DOUBLE), 6) END AS f1,
 (length(b) - c)::INT AS added, (length(a) - c)::INT AS dropped FROM n""")
def bool_prf(t, spark):
    names = F.split("p_name", " ")
    x = B.prf(names, F.concat(F.split(F.lower("p_type"), " "), F.slice(names, 1, 1)))
    return t("part").select("p_partkey", x.alias("x")).select("p_partkey", *(F.round(f"x.{c}", 6).alias(c) for c in ("precision", "recall", "f1")), "x.added", "x.dropped")


@query(f"""SELECT p_partkey, '{B.SEARCH_BASE}?search=' || replace(replace(replace(replace(url_encode(trim(p_name || ' AND ' || lower(p_type) || ' OR ' || p_brand)), '+', '%20'), '*', '%2A'), '%7E', '~'), '%2F', '/') ||
 CASE WHEN p_size % 3 = 0 THEN '&filter=from_publication_date:2001-01-01,to_publication_date:' || (2001 + p_size) || '-12-31' WHEN p_size % 3 = 1 THEN '&filter=to_publication_date:' || (2001 + p_size) || '-12-31' ELSE '' END AS url FROM part""")
def bool_url(t, spark):
    q = F.concat("p_name", F.lit(' and "'), F.lower("p_type"), F.lit('*" or '), "p_brand")
    years = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("2001-"), (F.col("p_size") + 2001).cast("string"))).when(F.col("p_size") % 3 == 1, (F.col("p_size") + 2001).cast("string"))
    return t("part").select("p_partkey", F.get(B.search_urls(F.array(q), years), F.lit(0)).alias("url"))


@query()
def bool_repair(t, spark):
    """Queries as a parser takes them; the state machine is tested on vectors."""
    return _queries(t).select("p_partkey", B.repair_udf("q").alias("repaired"), B.balance(F.col("q")).alias("balanced"), B.sanitise_udf("q").alias("sanitised"))


@query()
def bool_repair_records(t, spark):
    by = _queries(t).join(t("part").select("p_partkey", "p_brand"), "p_partkey").groupBy("p_brand").agg(F.sort_array(F.collect_list("q")).alias("queries"))
    return by.select("p_brand", B.repair_list_udf("queries").alias("queries"))


@query()
def bool_fidelity(t, spark):
    """Measures between each query and its repaired form; each is tested on vectors and against SQL above."""
    rows = _queries(t).select("p_partkey", B.canonical(F.col("q")).alias("a")).withColumn("b", B.balance(F.col("a")))
    return B.with_fidelity(rows, "a", "b").drop("a", "b")


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN ['unbalanced_quotes'] WHEN p_size % 4 = 1 THEN ['unbalanced_parens', 'trailing_operator'] WHEN p_size % 4 = 2 THEN ['missing_search'] ELSE [] END AS flags FROM part""")
def query_flags(t, spark):
    q = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit('"'), "p_name")).when(F.col("p_size") % 4 == 1, F.concat(F.lit("("), "p_name", F.lit(" AND"))).when(F.col("p_size") % 4 == 2, F.lit(" ")).otherwise(F.col("p_name"))
    return t("part").select("p_partkey", B.syntax_flags(q).alias("flags"))


_SCORE = "SELECT o_custkey, max(c) AS max_score, sum(c)::BIGINT AS sum_score, min(c) AS min_score FROM (SELECT o_custkey, (o_totalprice * 40)::BIGINT AS c FROM orders) GROUP BY 1"
_BUCKET = "CASE WHEN {0} >= 20000000 THEN 'b7_20m_plus' WHEN {0} >= 5000000 THEN 'b6_5m_20m' WHEN {0} >= 1000000 THEN 'b5_1m_5m' WHEN {0} >= 250000 THEN 'b4_250k_1m' WHEN {0} >= 50000 THEN 'b3_50k_250k' WHEN {0} >= 5000 THEN 'b2_5k_50k' WHEN {0} >= 1 THEN 'b1_1_5k' ELSE 'b0_0' END"


def _scores(t):
    return t("orders").select("o_custkey", F.round(F.col("o_totalprice") * 40).cast("long").alias("c")).groupBy("o_custkey").agg(F.collect_list("c").alias("counts"))


@query(_SCORE.replace("(o_totalprice * 40)::BIGINT", "round(o_totalprice * 40)::BIGINT"))
def score_strategies(t, spark):
    return _scores(t).select("o_custkey", *(P.count_score(F.col("counts"), k).alias(f"{k}_score") for k in ("max", "sum", "min")))


@query(f"SELECT {_BUCKET.format('s')} AS bucket, count(*) AS n FROM (SELECT sum(round(o_totalprice * 40)::BIGINT) AS s FROM orders GROUP BY o_custkey) GROUP BY 1")
def count_buckets(t, spark):
    return _scores(t).select(P.count_bucket(P.count_score(F.col("counts"), "sum")).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


_COVER = "SELECT l_orderkey, count(*) FILTER (p_size > 25) AS valid_refs, count(*) AS total_refs, round_even(count(*) FILTER (p_size > 25) / count(*)::DOUBLE, 4) AS ratio FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"


def _coverage(t):
    refs = t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("refs"))
    return J.coverage(refs, "l_orderkey", "refs", t("part").where("p_size > 25"), "p_partkey")


@query(_COVER)
def coverage_ratio(t, spark):
    return _coverage(t)


@query(f"SELECT CASE WHEN v >= 0.9 THEN '90+' WHEN v >= 0.8 THEN '80-89' WHEN v >= 0.7 THEN '70-79' WHEN v >= 0.6 THEN '60-69' ELSE '<60' END AS bucket, count(*) AS n FROM (SELECT valid_refs / total_refs::DOUBLE AS v FROM ({_COVER})) GROUP BY 1")
def coverage_buckets(t, spark):
    return _coverage(t).select(A.coverage_bucket(F.col("valid_refs") / F.col("total_refs")).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


_EVAL = """WITH x AS (SELECT l_suppkey, list_distinct(list(l_partkey::VARCHAR) FILTER (year(l_shipdate) % 2 = 0)) AS rel, list_distinct(list(l_partkey::VARCHAR) FILTER (l_quantity > 20)) AS ret FROM lineitem GROUP BY 1),
y AS (SELECT l_suppkey, coalesce(length(rel), 0)::INT AS a, coalesce(length(ret), 0)::INT AS b, coalesce(length(list_intersect(rel, ret)), 0)::INT AS c FROM x),
z AS (SELECT *, CASE WHEN b = 0 THEN 0 ELSE c / b::DOUBLE END AS p, CASE WHEN a = 0 THEN 0 ELSE c / a::DOUBLE END AS r FROM y)
SELECT l_suppkey, a AS relevant_count, b AS retrieved_count, c AS true_positives, p AS precision, r AS recall, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1, CASE WHEN p + r = 0 THEN 0 ELSE 10 * p * r / (9 * p + r) END AS f3 FROM z"""


def _retrieval(t):
    part = F.col("l_partkey").cast("string")
    sets = t("lineitem").groupBy("l_suppkey").agg(F.collect_set(F.when(F.year("l_shipdate") % 2 == 0, part)).alias("relevant"), F.collect_set(F.when(F.col("l_quantity") > 20, part)).alias("retrieved"))
    return A.retrieval_rows(sets, "l_suppkey", "relevant", "retrieved")


@query(f"SELECT l_suppkey, relevant_count, retrieved_count, true_positives, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(f3, 9) AS f3 FROM ({_EVAL})")
def ir_eval_rows(t, spark):
    rows = _retrieval(t)
    return rows.select("l_suppkey", "relevant_count", "retrieved_count", "true_positives", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "f3")))


@query(f"""WITH e AS ({_EVAL}), s AS (SELECT count(*) AS n, sum(true_positives) / sum(retrieved_count)::DOUBLE AS p, sum(true_positives) / sum(relevant_count)::DOUBLE AS r, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS m1, avg(f3) AS m3 FROM e)
SELECT n, round(p, 6) AS micro_precision, round(r, 6) AS micro_recall, round(2 * p * r / (p + r), 6) AS micro_f1, round(10 * p * r / (9 * p + r), 6) AS micro_f3, round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round(m1, 6) AS macro_f1, round(m3, 6) AS macro_f3 FROM s""")
def ir_eval_summary(t, spark):
    return A.retrieval_summary(_retrieval(t))


_FIELDS = {"acctbal": "c_acctbal > 0", "segment": "c_mktsegment <> 'BUILDING'", "nation": "c_nationkey <> 3"}


@query("WITH c AS (SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER ({v}) AS {k}" for k, v in _FIELDS.items()) + " FROM customer), u AS (" + " UNION ALL ".join(f"SELECT '{k}' AS field, {k} AS filled, n FROM c" for k in _FIELDS) + ") SELECT field, filled, n - filled AS missing, round_even(filled * 100 / n::DOUBLE, 4) AS pct FROM u")
def field_coverage(t, spark):
    return A.field_coverage(t("customer"), {k: F.expr(v) for k, v in _FIELDS.items()})


@query("SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER ({v}) AS {k}" for k, v in _FIELDS.items()) + f", count(*) FILTER (NOT ({') AND NOT ('.join(_FIELDS.values())})) AS all_null, count(*) FILTER (({') AND ('.join(_FIELDS.values())})) AS all_filled FROM customer")
def completeness_matrix(t, spark):
    flags = [F.expr(v) for v in _FIELDS.values()]
    none, every = ~flags[0] & ~flags[1] & ~flags[2], flags[0] & flags[1] & flags[2]
    return t("customer").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.expr(v)).alias(k) for k, v in _FIELDS.items()), F.count_if(none).alias("all_null"), F.count_if(every).alias("all_filled"))


@query("SELECT CASE WHEN c_acctbal > 0 AND c_mktsegment <> 'BUILDING' THEN 'both' WHEN c_acctbal > 0 THEN 'has_boolean' WHEN c_mktsegment <> 'BUILDING' THEN 'keywords_only' ELSE 'neither' END AS cohort, count(*) AS n FROM customer GROUP BY 1")
def strategy_cohorts(t, spark):
    return t("customer").groupBy(P.cohort(F.expr("c_acctbal > 0"), F.expr("c_mktsegment <> 'BUILDING'")).alias("cohort")).agg(F.count(F.lit(1)).alias("n"))


_PAIRS = "SELECT c_custkey, c_acctbal > 2000 AS a_b, c_acctbal > 0 AS a_a, c_nationkey > 12 AS n_b, c_nationkey % 2 = 0 AS n_a FROM customer"


@query(f"""WITH p AS ({_PAIRS}), u AS (SELECT 'acctbal' AS f, a_b AS b, a_a AS a FROM p UNION ALL SELECT 'nation', n_b, n_a FROM p),
s AS (SELECT f, b, a FROM u UNION ALL SELECT 'TOTAL', b, a FROM u)
SELECT f AS field, count(*) FILTER (NOT b) AS missing_before, count(*) FILTER (NOT b AND a) AS recovered, count(*) FILTER (b AND NOT a) AS regressed, round_even(count(*) FILTER (NOT b AND a) * 100 / (count(*) FILTER (NOT b))::DOUBLE, 4) AS gain_pct FROM s GROUP BY 1""")
def repair_impact(t, spark):
    c = t("customer")
    before = c.select("c_custkey", (F.col("c_acctbal") > 2000).alias("acctbal"), (F.col("c_nationkey") > 12).alias("nation"))
    after = c.select("c_custkey", (F.col("c_acctbal") > 0).alias("acctbal"), (F.col("c_nationkey") % 2 == 0).alias("nation"))
    return A.repair_impact(before, after, "c_custkey", ["acctbal", "nation"])


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def json_props(t, spark):
    return t("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""WITH e AS (SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events),
r AS (SELECT event_id, k, CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN [] WHEN 2 THEN [' '] WHEN 3 THEN [NULL, 'a'] ELSE ['a', 'b'] END::VARCHAR[] AS l,
 CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN [] WHEN 2 THEN [NULL, 'q'] WHEN 3 THEN ['  ', 'q'] ELSE ['q'] END::VARCHAR[] AS q FROM e)
SELECT event_id, k IS NOT NULL AS completeness, coalesce(k <> 0, false) AS statistic, k IS NOT NULL AS slim, coalesce(k <> 0, false) AS explored,
 coalesce(len(l) > 0, false) AS list_value, coalesce(len(list_filter(l, lambda x: trim(x) <> '')) > 0, false) AS text_list, l IS NOT NULL AS list_present,
 coalesce(len(list_filter(l, lambda x: trim(x) <> '')) > 0, false) AS list_statistic, coalesce(len(l) > 0, false) AS list_slim, coalesce(len(l) > 0, false) AS list_explored,
 coalesce(q[1] IS NOT NULL, false) AS first_query, coalesce(len(list_filter(q, lambda x: trim(x) <> '')) > 0, false) AS any_query FROM r""")
def filled_variants(t, spark):
    """The rules for filled fields, on numbers, lists of strings and lists of structs."""
    k = F.from_json("props", "k bigint")["k"]
    none, texts = F.lit(None).cast("string"), lambda *x: F.array(*x).cast("array<string>")
    a, b, q = F.lit("a"), F.lit("b"), F.lit("q")
    ls = F.when(k % 6 == 0, None).when(k % 6 == 1, texts()).when(k % 6 == 2, texts(F.lit(" "))).when(k % 6 == 3, texts(none, a)).when(k.isNotNull(), texts(a, b)).otherwise(texts(a, b))
    qs = F.when(k % 5 == 0, None).when(k % 5 == 1, texts()).when(k % 5 == 2, texts(none, q)).when(k % 5 == 3, texts(F.lit("  "), q)).otherwise(texts(q))
    rows = t("events").select("event_id", k.alias("k"), ls.alias("l"), F.transform(qs, lambda x: F.struct(x.alias("boolean_query_string"), F.lit("d").alias("database_source"))).alias("q"))
    ev, lv = F.struct(F.col("k").alias("value")), F.struct(F.col("l").alias("value"))
    return rows.select(
        "event_id", E.value_filled(ev).alias("completeness"), E.statistic_filled(F.col("k"), "number").alias("statistic"), E.slim_filled(F.col("k"), "number").alias("slim"),
        E.explored(F.col("k"), "number").alias("explored"), E.list_value_filled(lv).alias("list_value"), E.text_list_filled(lv).alias("text_list"), E.value_present(lv).alias("list_present"),
        E.statistic_filled(F.col("l"), "list").alias("list_statistic"), E.slim_filled(F.col("l"), "list").alias("list_slim"), E.explored(F.col("l"), "list").alias("list_explored"),
        E.first_query_filled(F.col("q")).alias("first_query"), E.any_query_filled(F.col("q")).alias("any_query"),
    )


@query("""WITH r AS (SELECT l_orderkey, l_linenumber AS i, CASE WHEN l_linenumber % 2 = 1 THEN l_partkey END AS v FROM lineitem)
SELECT l_orderkey, 7 AS n, [max(v) FILTER (i = 1), max(v) FILTER (i = 2), max(v) FILTER (i = 3), max(v) FILTER (i = 4), max(v) FILTER (i = 5), max(v) FILTER (i = 6), max(v) FILTER (i = 7)] AS v FROM r GROUP BY 1""")
def realign_results(t, spark):
    """Results by number back into lists of seven; those of even numbers are missing values."""
    value = F.when(F.col("l_linenumber") % 2 == 1, F.col("l_partkey"))
    rows = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(value).alias("v")).withColumn("n", F.lit(7))
    return J.realign(rows, "l_orderkey", "l_linenumber", "v", "n").withColumn("n", F.lit(7))


@query("""SELECT count(*) AS total, count(*) FILTER (e IS NULL) AS missing_errors, count(*) FILTER (len(e) = 0) AS no_queries, count(*) FILTER (len(e) = 1 AND e[1] IS NULL) AS ok,
 count(*) FILTER (len(list_filter(e, lambda x: x IS NOT NULL)) > 0) AS failed, sum(coalesce(len(list_filter(e, lambda x: x IS NOT NULL)), 0))::BIGINT AS error_items
FROM (SELECT CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN [] WHEN 2 THEN [NULL] ELSE ['http_500', NULL] END::VARCHAR[] AS e FROM customer)""")
def error_summary(t, spark):
    k, none = F.col("c_custkey") % 4, F.lit(None).cast("string")
    e = F.when(k == 1, F.array().cast("array<string>")).when(k == 2, F.array(none)).when(k == 3, F.array(F.lit("http_500"), none))
    return A.error_summary(t("customer").select(e.alias("e")), "e")


@query("SELECT p_type AS error, list_sort(list(DISTINCT p_partkey)) AS ids FROM part WHERE p_size > 40 GROUP BY 1")
def ids_by_error(t, spark):
    return A.ids_by_error(t("part").where("p_size > 40").select("p_partkey", F.array("p_type").alias("e")), "p_partkey", "e")


@query("SELECT quantile_cont(o_totalprice, 0.9) AS p90, o_orderpriority FROM orders GROUP BY 2")
def grouped_percentile(t, spark):
    return A.percentiles(t("orders"), F.col("o_totalprice"), (0.9,), by=["o_orderpriority"])


@query("""SELECT 'k' AS key, count(*) FILTER ((props::JSON ->> 'k')::BIGINT <> 0) AS present, round_even(count(*) FILTER ((props::JSON ->> 'k')::BIGINT <> 0) * 100 / count(*)::DOUBLE, 4) AS pct FROM events""")
def presence_distribution(t, spark):
    return A.presence(t("events"), "props")


_RECORD = """SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_name ELSE '' END AS title, CASE WHEN p_size % 5 <> 0 THEN p_type END AS abstract,
 CASE WHEN p_size % 3 = 0 THEN [p_brand] WHEN p_size % 3 = 1 THEN [] END AS inclusion, CASE WHEN p_size % 4 = 0 THEN [p_brand] END AS exclusion,
 CASE WHEN p_size % 11 = 0 THEN NULL WHEN p_size % 11 = 1 THEN 0 ELSE p_size END AS n_studies, CASE p_size % 6 WHEN 0 THEN NULL WHEN 1 THEN [' '] ELSE ['q'] END AS queries,
 CASE WHEN p_size % 9 = 0 THEN ['db'] END AS databases FROM part"""


def _records(part):
    """Records with evidence that is missing, empty, blank or there, made from sizes."""
    size, none = F.col("p_size"), F.lit(None).cast("array<string>")
    query = F.when(size % 6 == 0, none).when(size % 6 == 1, F.array(F.lit(" "))).otherwise(F.array(F.lit("q")))
    return part.select(
        "p_partkey", F.when(size % 7 != 0, F.col("p_name")).otherwise("").alias("title"), F.when(size % 5 != 0, F.col("p_type")).alias("abstract"),
        F.when(size % 3 == 0, F.array("p_brand")).when(size % 3 == 1, F.array().cast("array<string>")).alias("inclusion"), F.when(size % 4 == 0, F.array("p_brand")).alias("exclusion"),
        F.when(size % 11 == 0, None).when(size % 11 == 1, 0).otherwise(size).alias("n_studies"),
        F.transform(query, lambda x: F.struct(x.alias("boolean_query_string"), x.alias("database_source"))).alias("queries"), F.when(size % 9 == 0, F.array(F.lit("db"))).alias("databases"),
    )


_SAID = "coalesce(len(list_filter(queries, lambda x: trim(x) <> '')) > 0, false)"
_KEY = f"title <> '' AND coalesce(abstract, '') <> '' AND {_SAID} AND (coalesce(len(inclusion), 0) > 0 OR coalesce(len(exclusion), 0) > 0)"
_STATS = f"(coalesce(len(databases), 0) > 0 OR {_SAID}) AND n_studies IS NOT NULL"


@query(f"""SELECT count(*) AS total, count(*) FILTER (title <> '') AS title, count(*) FILTER (coalesce(abstract, '') <> '') AS abstract, count(*) FILTER ({_SAID}) AS queries,
 count(*) FILTER (coalesce(len(inclusion), 0) > 0) AS inclusion, count(*) FILTER (coalesce(len(exclusion), 0) > 0) AS exclusion,
 count(*) FILTER (coalesce(len(databases), 0) > 0 OR {_SAID}) AS databases, count(*) FILTER (n_studies IS NOT NULL) AS n_studies,
 count(*) FILTER (coalesce(len(inclusion), 0) > 0) + count(*) FILTER (coalesce(len(exclusion), 0) > 0) AS either_sum,
 count(*) FILTER (coalesce(len(inclusion), 0) > 0 OR coalesce(len(exclusion), 0) > 0) AS "either", count(*) FILTER ({_KEY}) AS all_key, count(*) FILTER ({_STATS}) AS all_stats,
 count(*) FILTER ({_KEY} AND {_STATS}) AS "all" FROM ({_RECORD})""")
def corpus_statistics(t, spark):
    """Counters over records: filled, present and conjunctive ones in one pass."""
    rows = _records(t("part"))
    filled = {k: E.statistic_filled(F.col(k), kind) for k, kind in (("title", "string"), ("abstract", "string"))}
    filled |= {"queries": P.has_boolean_queries(F.col("queries")), "inclusion": E.explored(F.col("inclusion"), "list"), "exclusion": E.explored(F.col("exclusion"), "list")}
    present = {"databases": P.has_database_info(F.col("databases"), F.col("queries")), "n_studies": F.col("n_studies").isNotNull()}
    return A.statistics(rows, filled, present, ("inclusion", "exclusion"), ("title", "abstract", "queries"), ("databases", "n_studies"))


@query("SELECT count(*) AS total, count(*) FILTER (c_acctbal > 0) AS a, count(*) FILTER (c_nationkey > 12) AS b, count(*) FILTER (c_acctbal > 0 AND c_nationkey > 12) AS a_and_b, count(*) FILTER (c_acctbal > 0 OR c_nationkey > 12) AS a_or_b, count(*) FILTER (c_acctbal > 0) + count(*) FILTER (c_nationkey > 12) AS a_or_b_sum FROM customer")
def conjunction_counts(t, spark):
    return A.conjunctions(t("customer"), {"a": F.expr("c_acctbal > 0"), "b": F.expr("c_nationkey > 12")}, [("a", "b")])


@query(f"SELECT p_partkey FROM ({_RECORD}) WHERE coalesce(len(inclusion), 0) > 0 OR coalesce(len(exclusion), 0) > 0 OR coalesce(n_studies, 0) <> 0 OR {_SAID}")
def any_field_filled(t, spark):
    flags = [E.slim_filled(F.col("inclusion"), "list"), E.slim_filled(F.col("exclusion"), "list"), E.explored(F.col("n_studies"), "number"), P.has_boolean_queries(F.col("queries"))]
    return P.any_filled(_records(t("part")), flags).select("p_partkey")


@query(f"SELECT p_partkey, {_SAID} AS has_queries, coalesce(len(databases), 0) > 0 OR {_SAID} AS has_databases FROM ({_RECORD})")
def query_and_database_flags(t, spark):
    return _records(t("part")).select("p_partkey", P.has_boolean_queries(F.col("queries")).alias("has_queries"), P.has_database_info(F.col("databases"), F.col("queries")).alias("has_databases"))


@query("""SELECT p_partkey, p_size % 3 = 0 OR (p_size % 4 = 1) OR p_size % 5 = 2 AS has_pdf FROM part""")
def has_pdf(t, spark):
    """Addresses of files in the first, the best or any other location; blank ones don't count."""
    size, none = F.col("p_size"), F.lit(None).cast("string")
    at = lambda c: F.struct(c.alias("pdf_url"))
    url = lambda cond: F.when(cond, "https://x/a.pdf").when(size % 2 == 0, " ").otherwise(none)
    others = F.array(at(none), at(url(size % 5 == 2)))
    return t("part").select("p_partkey", T.has_pdf(at(url(size % 3 == 0)), at(url(size % 4 == 1)), others).alias("has_pdf"))


@query("""SELECT count(*) FILTER (p_size % 3 <> 0) AS no_result, count(*) FILTER (p_size % 3 <> 0 AND p_size % 4 > 0) AS expected, count(*) FILTER (p_size % 3 <> 0 AND p_size % 4 = 0) AS not_expected FROM part""")
def without_result(t, spark):
    size = F.col("p_size")
    results = F.when(size % 3 == 0, F.array(F.lit(None).cast("string"), F.lit("q"))).when(size % 3 == 1, F.array(F.lit(" ")))
    return A.without_result(t("part"), results, F.when(size % 4 == 0, F.when(size % 8 == 0, 0)).otherwise(size % 4))


@query("""SELECT count(*) AS n_rows, count(*) FILTER (p_size % 2 = 0 OR p_size % 5 = 0) AS n_changed, count(*) FILTER (p_size % 2 = 0) AS changed_p_name, count(*) FILTER (p_size % 5 = 0) AS changed_p_brand FROM part""")
def changed_rows(t, spark):
    """Rows and fields that a rewrite changed; a value that is lost is a change."""
    before = t("part").select("p_partkey", "p_name", "p_brand", "p_size")
    after = before.withColumns({"p_name": F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")), "p_brand": F.when(F.col("p_size") % 5 != 0, F.col("p_brand"))})
    return A.changed(before, after, "p_partkey", ["p_name", "p_brand"])


@query("""SELECT c_custkey, coalesce(trim(u) = '', true) OR coalesce(e <> '', false) OR coalesce(n = 0, false) AS probe, coalesce(trim(u) = '', true) OR coalesce(e <> '', false) AS only_errors
FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'u' END AS u, CASE WHEN c_custkey % 7 = 0 THEN 'http_500' END AS e, CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 3 = 1 THEN 5 END AS n FROM customer)""")
def probe_decision(t, spark):
    k = F.col("c_custkey")
    u, e, n = F.when(k % 5 == 0, None).when(k % 5 == 1, " ").otherwise("u"), F.when(k % 7 == 0, "http_500"), F.when(k % 3 == 0, 0).when(k % 3 == 1, 5)
    return t("customer").select("c_custkey", remote.should_probe(u, n, e).alias("probe"), remote.should_probe(u, n, e, only_errors=True).alias("only_errors"))


@query("""WITH s AS (SELECT o_orderstatus, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS c FROM orders)
SELECT o_orderstatus, count(*) AS n, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max, max(CASE WHEN r = round_even((c - 1) * 0.25, 0) + 1 THEN v END) AS p25, max(CASE WHEN r = round_even((c - 1) * 0.5, 0) + 1 THEN v END) AS p50, max(CASE WHEN r = round_even((c - 1) * 0.75, 0) + 1 THEN v END) AS p75 FROM s GROUP BY 1""")
def population_summary(t, spark):
    return A.population(t("orders"), F.col("o_totalprice"), ["o_orderstatus"])


@query("WITH s AS (SELECT 0 AS step, 'all' AS stage, count(*) AS n FROM orders UNION ALL SELECT 1, 'finished', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 2, 'large', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000) SELECT step, stage, n, round_even(n * 100 / (SELECT n FROM s WHERE step = 0)::DOUBLE, 4) AS pct FROM s")
def funnel_counts(t, spark):
    done = t("orders").where("o_orderstatus = 'F'")
    return A.funnel([("all", t("orders")), ("finished", done), ("large", done.where("o_totalprice > 100000"))])


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['q_1: ' || p_name, 'q_2: ' || p_brand] ELSE ['keyword: ' || p_type] END AS lines, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS expected_len, p_size % 2 = 1 AS keywords_only FROM part""")
def model_inputs(t, spark):
    even = F.col("p_size") % 2 == 0
    x = R.model_input(F.when(even, F.array("p_name", "p_brand")).otherwise(F.array(F.lit(" "), F.lit(None).cast("string"))), F.array("p_type"))
    rows = t("part").select("p_partkey", x.alias("x"))
    return rows.select("p_partkey", F.transform("x.items", lambda i: F.concat(i["id"], F.lit(": "), i["text"])).alias("lines"), "x.expected_len", "x.keywords_only")


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'JSON_PARSE_ERROR' WHEN 1 THEN 'SCHEMA_VALIDATION_ERROR' END AS error, CASE WHEN p_size % 3 = 2 THEN p_name END AS title FROM part""")
def parsed_outputs(t, spark):
    raw = F.when(F.col("p_size") % 3 == 0, "none").when(F.col("p_size") % 3 == 1, '<think>{}</think> {"a": 1}').otherwise(F.concat(F.lit('x {"title": "'), "p_name", F.lit('"} y')))
    rows = t("part").select("p_partkey", R.parsed_output(raw, "title string", "title").alias("x"))
    return rows.select("p_partkey", "x.error", F.col("x.value.title").alias("title"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN [p_name, NULL, NULL] ELSE [p_name, p_brand, p_type] END AS padded, CASE WHEN p_size % 2 = 0 THEN 'LENGTH_MISMATCH' END AS error FROM part")
def pad_truncate(t, spark):
    items = F.when(F.col("p_size") % 2 == 0, F.array("p_name")).otherwise(F.array("p_name", "p_brand", "p_type"))
    return t("part").select("p_partkey", R.padded(items, F.lit(3)).alias("padded"), R.output_error(F.lit(None).cast("string"), items, items, F.lit(3)).alias("error"))


@query("SELECT p_partkey, 'Repair' || chr(10) || '- a: ' || p_name || chr(10) || CASE WHEN p_size % 2 = 0 THEN '* objective: state the aim' || chr(10) || '* other: fill in if the text states it' ELSE 'All fields are present.' END AS prompt FROM part")
def repair_prompt(t, spark):
    missing = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("objective"), F.lit("other"))).otherwise(F.array().cast("array<string>"))
    items = F.array(F.struct(F.lit("a").alias("id"), F.col("p_name").alias("text")))
    return t("part").select("p_partkey", R.prompt("Repair", items, missing, {"objective": "state the aim"}).alias("prompt"))


@query()
def normalised_forms(t, spark):
    """NFKC titles and rewritten addresses; the Python forms are tested on vectors."""
    return t("pages").select("page_id", R.nfkc("html").alias("nfkc"), R.rewrite_url({"per-page": "1"})("url").alias("url"))


@query()
def described_images(t, spark):
    """Image captions put into page texts."""
    return t("pages").select("page_id", R.describe_images_udf("html", F.create_map(F.lit("a.png"), F.lit("a figure"))).alias("html"))
