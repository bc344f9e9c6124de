"""Vectors for scalar functions."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import boolean as B
from corpusmill.functions import evidence as E
from corpusmill.functions import text as T
from corpusmill.functions.years import normalise_year_range


def one(spark, column, **values):
    ddl = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    row = tuple(v for _, v in values.values()) or (1,)
    return spark.createDataFrame([row], ddl).select(column.alias("y")).first().y


YEARS = [
    ("from 2015 to 2010", 2021, "2010-2015", "two_years"), ("2010 to present", 2021, "2010-2021", "year_to_present"),
    ("2010 to present", None, None, "year_to_present_missing_study_year"), ("since 2012", 2020, "2012-2020", "since_year"),
    ("last 5 years", 2020, "2016-2020", "last_n_years"), ("last 200 years", 2020, None, "invalid_last_n_years"),
    ("past ten years", 2020, "2011-2020", "last_word_years"), ("last 2 decades", 2020, "2001-2020", "last_n_decades"),
    ("past decade", 2020, "2011-2020", "last_decade"), ("recent few years", 2020, "2016-2020", "last_few_years"),
    ("published 2014", 2020, "2020", "fallback_study_year"), ("any time", None, None, "no_rule"), (None, None, None, None), (None, 2020, "2020", "fallback_study_year"),
    ("120015 and 2003", 2020, "2001-2003", "two_years"), ("last 5 years", 0, None, "no_rule"),
]


def test_year_rules(spark):
    rows = spark.createDataFrame([(i, r, s) for i, (r, s, _, _) in enumerate(YEARS)], "i int, raw string, sy int")
    got = {r.i: (r.x["range"], r.x["rule"]) for r in rows.select("i", normalise_year_range(F.col("raw"), F.col("sy")).alias("x")).collect()}
    assert got == {i: (a, b) for i, (_, _, a, b) in enumerate(YEARS)}


@pytest.mark.parametrize(
    ("query", "fixed"),
    [
        ("machine learning AND OR data", '"machine learning" OR data'), ("auto* vehicles", "(auto* AND vehicles)"), ("AND (x OR y", "(x OR y)"), ("((abc))", "(abc)"),
        ("", ""), (None, ""), ("a) OR b", "a OR b"), ("*x", "x"), ("a AND", "a"), ("a/b", "a\\/b"), ("$a OR (AND b)", "a OR (b)"), ('"a b"(c)', '"a b" (c)'),
    ],
)
def test_repair(query, fixed):
    assert B.repair(query) == fixed


def test_repair_list():
    assert B.repair_list(["aa", "AA", "bb c"]) == ['(aa OR "bb c")']
    assert B.repair_list(["a", None, "#1"]) == ["(#1)"]
    assert B.repair_list(["x", "()"]) is None
    assert B.repair_list(["xx AND yy", "zz"]) == ["xx AND yy", "zz"]


def test_tokens_and_structure(spark):
    toks = B.tokens(F.col("q"))
    q = ("string", 'a "b c" and (d)')
    assert [(t.type, t.val) for t in one(spark, toks, q=q)] == [("TERM", "a"), ("PHRASE", "b c"), ("OP", "AND"), ("PAREN", "("), ("TERM", "d"), ("PAREN", ")")]
    assert one(spark, toks, q=("string", None)) == []
    assert tuple(one(spark, B.paren_stats(toks), q=("string", "())("))) == (False, 1)
    assert one(spark, B.skeleton(toks), q=("string", '(a OR "b c")')) == "(tOt)"
    assert one(spark, B.balance(F.col("q")), q=("string", "a) (b")) == "a ( b )"
    assert one(spark, B.code_similarity(F.lit("AO"), F.lit("A"))) == 0.5
    p = one(spark, B.prf(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))))
    assert (p.precision, p.recall, p.f1, p.added, p.dropped) == (0.5, 0.5, 0.5, 1, 1)
    empty = F.array().cast("array<string>")
    p = one(spark, B.prf(empty, empty))
    assert (p.precision, p.recall, p.f1, p.added, p.dropped) == (1, 1, 1, 0, 0)


def test_canonical(spark):
    q = ("string", "TS=(“deep learning”[tiab] near/3 x$) and PUBYEAR > 2010 or TI: cats 2001-2005")
    assert one(spark, B.canonical(F.col("q")), q=q) == '("deep learning" AND x ) AND OR cats'
    assert one(spark, B.canonical(F.col("q")), q=("string", None)) == ""


def test_fidelity(spark):
    df = spark.createDataFrame([("a1 AND b1", "a1 OR c1"), ("", "")], "a string, b string")
    x, y = B.with_fidelity(df, "a", "b").orderBy("a", ascending=False).collect()
    assert (x.term_precision, x.term_recall, x.added, x.dropped, x.operator_similarity, x.skeleton_similarity) == (0.5, 0.5, 1, 1, 0.0, 0.6667)
    assert y.term_f1 == 1 and y.operator_similarity == 1


def test_search_urls(spark):
    url = B.search_urls(F.array(F.col("q")), F.col("y"))[0]
    at = lambda q, y: one(spark, url, q=("string", q), y=("string", y)).removeprefix(B.SEARCH_BASE)
    assert at('"open pred*" and x', "2010-2020") == "?search=open%20pred%20AND%20x&filter=from_publication_date:2010-01-01,to_publication_date:2020-12-31"
    assert at("x", "2015") == "?search=x&filter=to_publication_date:2015-12-31"
    assert at("a/b~c", None) == "?search=a/b~c"


def test_sanitise():
    assert B.sanitise("deep learning and (cat or big dog)") == 'search=("deep learning" AND  (cat OR "big dog"))'  # blank parts stay
    assert B.sanitise("search=(a)") == "search= (a)"


def test_normalisers(spark):
    s = lambda f, v: one(spark, f(F.col("x")), x=("string", v))
    assert s(T.normalise_doi, " DOI: 10.1/AB ") == "10.1/ab" and s(T.normalise_doi, "https://dx.doi.org/10.1/X") == "10.1/x" and s(T.normalise_doi, "nan") is None
    assert s(T.work_id, "https://example.org/w12") == "W12" and s(T.work_id, "x") is None
    assert s(T.title_key_compact, "The  A-b: c!") == "the ab c" and s(T.title_key_spaced, "A-b") == "a b" and s(T.title_key_spaced, "!!") is None
    assert s(T.title_key_compact, "Éa") == "éa"
    assert s(T.join_hyphenated, "inter-\n national  x") == "international x"
    assert s(T.image_key, "../.a/b.png") == "a/b.png"
    assert s(T.clean_string, "  ") is None and s(T.clean_string, " a ") == "a"
    assert s(T.json_candidate, 'x {"a": {}} y') == '{"a": {}}' and s(T.json_candidate, "x") is None
    assert s(T.without_thinking, "<think>a\nb</think>c") == "c"
    assert s(T.doi_in_url, "https://x.org/doi/10.1234/a.b/") == "10.1234/a.b"
    assert s(T.shard_of, "W7123") == "W7" and s(T.shard_of, None) == "W0"
    assert s(T.repeats_token, "a b b B b c") is True and s(T.repeats_token, "b b b c") is False
    assert s(T.is_placeholder, "#1 AND #2") is True and s(T.is_placeholder, "a AND #2") is False
    assert s(T.nonblank_lines, " a \n\n b") == "a\nb"
    assert s(T.search_term, "https://x.org/?search=a%2520b&y=1") == "a b"


def test_inverted_index(spark):
    col = F.col("m")
    m = ("map<string,array<int>>", {"Abstract": [0], "b": [1, 4], "c": [2, 2, -1]})
    assert one(spark, T.text_of_inverted_index(col), m=m) == "b c b"
    assert one(spark, T.text_of_inverted_index(col, keep_gaps=True), m=("map<string,array<int>>", {"a": [0], "b": [2]})) == "a  b"
    assert one(spark, T.text_of_inverted_index(col), m=("map<string,array<int>>", {})) is None
    assert one(spark, T.text_of_inverted_index(col, keep_gaps=True), m=("map<string,array<int>>", {})) == ""


def test_identity_and_tiles(spark):
    x = T.identity(F.lit("10.1/a"), F.lit("t"), F.lit("see 10.1/A"), F.lit("body"))
    assert one(spark, x).reason == "doi_header"
    x = T.identity(F.lit(None).cast("string"), F.lit("Deep networks predict protein folding"), F.lit(""), F.lit("deep networks in protein folding predictions"))
    assert one(spark, x).ok is True
    assert [(t.x, t.y) for t in one(spark, T.tiles(F.lit(25), F.lit(10), 10, 2))] == [(0, 0), (8, 0), (16, 0)]


def test_filled_variants(spark):
    v = lambda c, t, x: one(spark, c, e=(t, x))
    lst, qs = "struct<value:array<string>>", "array<struct<boolean_query_string:string>>"
    e = F.col("e")
    assert [v(f(e), lst, ([" "],)) for f in (E.list_value_filled, E.text_list_filled, E.value_present)] == [True, False, True]
    assert [v(f(e), lst, ([],)) for f in (E.list_value_filled, E.text_list_filled, E.value_present)] == [False, False, True]
    assert [v(f(e), qs, [(None,), ("q",)]) for f in (E.first_query_filled, E.any_query_filled)] == [False, True]
    assert v(E.first_query_filled(e), qs, []) is False and v(E.first_query_filled(e), qs, None) is False
    assert (v(E.slim_filled(e, "number"), "int", 0), v(E.statistic_filled(e, "number"), "int", 0), v(E.explored(e, "boolean"), "boolean", False)) == (True, False, False)


def test_records(spark):
    from corpusmill.functions import records as R

    assert R.describe_images('![x](./a.png) <img src="a.png" alt="old"> ![y](b.png)', {"a.png": 'say "hi"'}) == (
        '![say "hi"](./a.png)\n\n*say "hi"* <img alt="say &quot;hi&quot;" src="a.png">\n\n*say "hi"* ![y](b.png)'
    )
    df = spark.createDataFrame([("ﬁ①", "https://x.org/?a=&b=1+2&per-page=9")], "a string, u string")
    r = df.select(R.nfkc("a").alias("a"), R.rewrite_url({"per-page": "1"})("u").alias("u")).first()
    assert (r.a, r.u) == ("fi1", "https://x.org/?b=1+2&per-page=1")
    assert one(spark, R.record_id(F.lit(""), F.lit(None).cast("string"), F.lit("x"))) == "x"
    x = one(spark, R.model_input(F.lit(None).cast("array<string>"), F.array(F.lit("k"))))
    assert (x.expected_len, x.keywords_only, len(x["items"])) == (1, True, 1)


def test_repeated_token_flag_like_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from corpusmill.plans import text_queries  # noqa: F401  registers the queries
    from corpusmill.plans.registry import ORACLES, QUERIES

    texts = ["éa a a a", "a é a ß a, aö", "aéa ab a a", "a a a\nab a", "B b_ b b", "b-B\n\nb;b", "\u0130b ib Ib \u0130B", "\u212a k K k", "_ _ _ _", None, "", "é é é é"]
    rows = [*enumerate(texts), (20, "a b"), (20, "a b"), (21, "a x"), (21, "a y"), (21, "a z"), (21, "a w"), (22, None), (22, "c c c c"), (23, None), (23, None), (None, "a a a a"), (None, "a")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    expected = dict(db.execute(ORACLES["repeated_token_flag"]).fetchall())
    got = [tuple(r) for r in QUERIES["repeated_token_flag"](spark, str(tmp_path)).collect()]
    assert dict(got) == expected and len(got) == len(expected)
    assert expected[0] and expected[1] and not expected[2] and expected[21] and not expected[20]
