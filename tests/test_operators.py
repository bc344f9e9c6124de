"""Dedup, joins, aggregates, alignment, sources and streaming on small tables."""

import difflib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import boolean as B
from corpusmill.operators import aggregate as A
from corpusmill.operators import align
from corpusmill.operators import dedupe as D
from corpusmill.operators import filters as P
from corpusmill.operators import joins as J
from corpusmill.operators.graph import components
from corpusmill.plans import pipelines
from corpusmill.sources import io, remote
from corpusmill.streaming.available_now import run_available, run_batches


def test_greedy_and_cascade_differ(spark):
    rows = [(1, "A", "1", "t"), (2, "B", "1", "t"), (3, "B", "2", "t"), (4, None, None, "t"), (5, "", None, "t"), (6, None, None, "u")]
    df = spark.createDataFrame(rows, "ord int, doi string, id string, title string")
    greedy = D.greedy(df, "doi", "id", "title", "ord", components)
    assert sorted(r.ord for r in greedy.collect()) == [1, 3, 4, 6]
    kept = D.cascade(df.where("ord <= 3"), [F.col("doi"), F.col("id")], F.col("ord"))
    assert sorted(r.ord for r in kept.collect()) == [1]


def test_first_and_last_wins(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, ""), (5, None)], "o int, k string")
    ids = lambda x: sorted(r.o for r in x.collect())
    assert ids(D.first_wins(df, F.col("k"), F.col("o"))) == [1, 3, 4, 5]
    assert ids(D.first_wins(df, F.col("k"), F.col("o"), keep_missing=False)) == [1, 3, 4]
    assert ids(D.last_wins(df, F.col("k"), F.col("o"))) == [2]
    once = D.first_wins(df, F.col("k"), F.col("o"))
    assert ids(D.first_wins(once, F.col("k"), F.col("o"))) == ids(once)
    assert tuple(D.duplicate_counts(df, F.col("k")).first()) == (5, 1, 3)
    assert ids(D.first_wins(df.limit(0), F.col("k"), F.col("o"))) == []


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (6, 6), (3, 9), (8, 9)], "a long, b long")
    assert {r.node: r.root for r in components(e).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 8: 1, 4: 4, 5: 4, 6: 6}


def test_joins(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, o int, v string")
    patch = spark.createDataFrame([("a", None)], "id string, v string")
    assert {r.id: r.v for r in J.patch_join(base, patch, "id", ["v"]).collect()} == {"a": None, "b": "y"}
    assert {r.id: r.v for r in J.patch_join(base, patch, "id", ["v"], F.col("p_v").isNotNull()).collect()} == {"a": "x", "b": "y"}
    refs = spark.createDataFrame([("p", ["r", "r", "s"]), ("q", [])], "id string, refs array<string>")
    got = {r.id: (r.valid_refs, r.total_refs, r.ratio) for r in J.coverage(refs, "id", "refs", spark.createDataFrame([("r",)], "w string"), "w").collect()}
    assert got == {"p": (2, 3, 0.6667), "q": (0, 0, 0.0)}
    rows = spark.createDataFrame([("k", 2, "b", 3), ("k", 9, "z", 3)], "id string, i int, v string, n int")
    assert J.realign(rows, "id", "i", "v", "n").first().v == [None, "b", None]


@pytest.mark.parametrize(("x", "name"), [(0, "b0_0"), (1, "b1_1_5k"), (5000, "b2_5k_50k"), (50000, "b3_50k_250k"), (250000, "b4_250k_1m"), (10**6, "b5_1m_5m"), (5 * 10**6, "b6_5m_20m"), (2 * 10**7, "b7_20m_plus")])
def test_buckets(spark, x, name):
    assert spark.range(1).select(P.count_bucket(F.lit(x))).first()[0] == name


def test_scores_and_measures(spark):
    c = F.array(F.lit(-1), F.lit(None).cast("int"), F.lit(3), F.lit(2))
    assert tuple(spark.range(1).select(*(P.count_score(c, k) for k in ("max", "min", "sum", "first"))).first()) == (3, 2, 5, 3)
    assert spark.range(1).select(P.count_score(F.array().cast("array<int>"))).first()[0] == 0
    df = spark.createDataFrame([(1, ["a", "a", "b"], ["b", None]), (2, [], None)], "id int, rel array<string>, ret array<string>")
    r = {x.id: x for x in A.retrieval_rows(df, "id", "rel", "ret").collect()}
    assert (r[1].precision, r[1].recall, round(r[1].f1, 4), round(r[1].f3, 4)) == (1.0, 0.5, 0.6667, 0.5263) and r[2].f3 == 0


def test_percentiles(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "v int")
    assert A.percentiles(df, F.col("v"), (0.25,)).first()[0] == 1.75
    assert tuple(A.percentiles(df, F.col("v"), (0.0, 0.25, 0.5, 1.0), "nearest").first()) == (1, 1, 2, 4)
    assert tuple(A.percentiles(df, F.col("v"), (0.5, 0.9), "rounded").first()) == (3, 4)


def test_reasons_sum_up(spark):
    df = spark.createDataFrame([("en", "x"), ("fr", "x"), (None, "y"), ("en", "y")], "l string, t string")
    counts = P.reason_counts(P.with_reason(df, [("language", P.is_english(F.col("l"))), ("t", F.col("t") == "x")])).collect()
    assert {r.reason: r.n for r in counts} == {"kept": 1, "language": 2, "t": 1}


def test_alignment(spark):
    rows = [(1, "inter-\nnational law", "v", "on international law today"), (2, "abcd", "v", "xx"), (3, None, None, "t"), (4, None, "v", "t"), (5, "the quick brown fax jumps", "v", "see the quick brown fox jumps over")]
    df = spark.createDataFrame(rows, "id int, q string, v string, text string")
    got = {r.id: r.verified for r in align.verify_quotes(df, "q", F.col("v").isNull(), "text").collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True}
    checks = F.array(F.struct(F.lit("a").alias("path"), F.lit(True).alias("ok")), F.struct(F.lit("b").alias("path"), F.lit(False).alias("ok")))
    v = spark.range(1).select(align.verdict(checks, F.lit("t")).alias("x"), align.verdict(checks, F.lit(" ")).alias("y")).first()
    assert (v.x.status, v.x.score, v.x.errors) == ("FAIL", 0.5, ["b"]) and (v.y.status, v.y.score) == ("CRITICAL_ERROR", 0.0)


def test_fact_check_fails_closed(spark):
    claims = spark.createDataFrame([(1, "f", "a b", "b a c"), (2, "f", "x y", "q")], "id int, field string, claim string, quote string")
    assert {r.id: r.status for r in align.fact_check(claims).collect()} == {1: "PASS", 2: "FAIL"}

    def broken(a, b):
        raise RuntimeError("no model")

    assert {r.status for r in align.fact_check(claims, broken).collect()} == {"ERROR"}


def test_sources(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": "a", "n": 1}\n\n{bad\n[1]\n{"id": "b"}\n')
    assert sorted(r.id for r in io.jsonl(spark, str(p), "id string, n int").collect()) == ["a", "b"]
    assert io.jsonl_audited(spark, str(p), "id string, n int").where("not valid").count() == 2
    (tmp_path / "y.json").write_text('[{"id": "c"}]')
    assert [r.id for r in io.json_auto(spark, str(tmp_path / "y.json"), "id string").collect()] == ["c"]
    (tmp_path / "z.json").write_text(json.dumps({"data": [{"id": "d"}, {"id": "e"}]}))
    assert io.json_envelope(spark, str(tmp_path / "z.json"), "id:string").count() == 2
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "w1.md").write_text("text\nmore")
    assert [(r.doc_id, r.text) for r in io.text_tree(spark, str(tmp_path / "docs")).collect()] == [("w1", "text\nmore")]
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, bucket string")
    io.write_split(df, "bucket", str(tmp_path / "split"))
    assert spark.read.parquet(str(tmp_path / "split")).where("bucket = 'y'").first().id == "b"
    with pytest.raises(ValueError, match="nope"):
        io.require(df, "nope")


def test_remote(spark):
    pages = {"*": {"results": [{"id": "1"}, {"id": "2"}], "next_cursor": "c"}, "c": {"results": [{"id": "3"}], "next_cursor": None}}
    assert [r["id"] for r in remote.paged(lambda q: pages[q["cursor"]], {}, 2)] == ["1", "2"]
    tries = []
    slept = []
    policy = remote.Policy(jitter=lambda: 0.5, sleep=slept.append)
    assert remote.with_retries(lambda q: tries.append(1) or {"status": 503 if len(tries) < 3 else 200}, {}, policy)["status"] == 200
    assert slept == [2.5, 4.5]
    df = spark.createDataFrame([("r", ["https://x/?search=a", "", "https://x/?search=bb"])], "id string, urls array<string>")

    def transport(q):
        return {"count": len(q["url"].split("search=")[1].split("&")[0]), "results": [{"id": q["url"][-1]}], "next_cursor": None}

    got = remote.annotate(df, "id", "urls", transport).first()
    assert got["values"] == [1, None, 2] and got["errors"] == [None, "blank_url", None]
    keys = spark.createDataFrame([("k1",), ("k2",), (None,)], "k string")
    out = remote.lookup(keys, "k", lambda q: {"results": [{"k": x, "v": 1} for x in q["keys"] if x != "k2"]}, "k string, v int")
    assert {(r.k, r.v, r.error) for r in out.collect()} == {("k1", 1, None), ("k2", None, "not_found")}


def test_streaming_resumes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"v": 1}\n')
    args = (str(src), "v int", lambda d: d.where("v > 0"), str(tmp_path / "out"), str(tmp_path / "cp"))
    run_available(spark, *args)
    (src / "2.json").write_text('{"v": 2}\n{"v": -1}\n')
    run_available(spark, *args)
    assert sorted(r.v for r in spark.read.parquet(args[3]).collect()) == [1, 2]
    run_batches(spark, str(src), "v int", lambda d: d.dropDuplicates(), str(tmp_path / "out2"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "out2")).count() == 3


def test_final_dataset(spark):
    ev = "struct<value:string,verbatim_source:string>"
    ext = spark.createDataFrame([("W1", ("study effects", "we study effects"), ("2010 to present", "from 2010 on")), ("W2", ("zzz", "not there at all"), (None, None))], f"doc_id string, objective {ev}, year_range {ev}")
    texts = spark.createDataFrame([("W1", "Here we study effects of x, from 2010 on, 2010 to present."), ("W2", "other")], "doc_id string, text string")
    corpus = spark.createDataFrame([("https://x.org/W1", 2020), ("https://x.org/W2", 2019)], "id string, year int")
    got = {r.doc_id: r for r in pipelines.final_dataset(ext, corpus, texts).collect()}
    assert got["W1"].objective == "study effects" and got["W2"].objective is None
    assert got["W2"].year_range_normalized == "2019" and got["W2"].year_range_normalization_rule == "fallback_study_year"


def test_evaluate_queries(spark):
    rec = spark.createDataFrame([("r1", ["aa AND bb"], "2010-2020"), ("r2", ["x"], None)], "id string, queries array<string>, years string")
    rel = spark.createDataFrame([("r1", ["w1", "w2"])], "id string, relevant array<string>")
    rows, total = pipelines.evaluate_queries(rec, rel, lambda q: {"count": 7, "results": [{"id": "w1"}], "next_cursor": None}, remote.annotate)
    r = rows.first()
    assert (r.true_positives, r.retrieved_count, r.bucket) == (1, 1, "b1_1_5k") and total.first().micro_recall == 0.5


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab()*? \"$/ANDOR", max_size=30))
def test_repair_is_balanced_and_stable(q):
    out = B.repair(q)
    assert out.count("(") == out.count(")")


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=20), st.text(max_size=40))
def test_partial_ratio_bounds(a, b):
    x = align.partial_ratio(a, b)
    assert 0 <= x <= 100 and (not a or a not in b or x == 100)


def test_partial_ratio_finds_late_quotes(spark):
    quote = "the effect of the treatment on the patients of the clinic"
    text = "the effect was seen, " * 400 + "the efect of the treatmant on the patiants of the clinyc" + " and so on" * 40
    assert align.partial_ratio(quote, text) > 90 and align.partial_ratio(quote, text, 70) > 90
    assert align.partial_ratio("the cat sat on", "the " * 400 + "xx thx cxt sxt on xx") > 70
    rows = spark.createDataFrame([(1, quote, text), (2, quote, "the effect was seen, " * 400)], "id int, q string, t string")
    assert {r.id: r.verified for r in align.verify_quotes(rows, "q", F.lit(False), "t").collect()} == {1: True, 2: False}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc ", min_size=1, max_size=20), st.text(alphabet="abc ", min_size=20, max_size=120), st.sampled_from([0, 50, 70, 90]))
def test_partial_ratio_tries_every_window(a, b, cutoff):
    n = len(a)
    want = max(difflib.SequenceMatcher(None, b[s : s + n], a, autojunk=False).ratio() * 100 for s in range(len(b) - n + 1))
    got = align.partial_ratio(a, b, cutoff)
    assert got == pytest.approx(want) if want >= cutoff else got < cutoff


QUICK = remote.Policy(attempts=2, base=0.0, jitter=lambda: 0.0)


def test_remote_failures_are_told(spark):
    pages = {"*": {"results": [{"id": "a"}], "next_cursor": "2"}, "2": {"status": 500}}
    with pytest.raises(remote.RequestFailed):
        list(remote.paged(lambda q: pages[q["cursor"]], {}, policy=QUICK))
    df = spark.createDataFrame([("r", ["https://x/?search=a"])], "id string, urls array<string>")
    got = remote.annotate(df, "id", "urls", lambda q: pages[q["cursor"]], "ids", QUICK).first()
    assert got["values"] == [None] and got["errors"] == ["http_500"]
    keys = spark.createDataFrame([(f"k{i}",) for i in range(6)], "k string").coalesce(1)
    broken = lambda q: {"status": 503} if "k3" in q["keys"] else {"results": [{"k": x, "v": int(x[1])} for x in q["keys"] if x != "k1"]}
    out = remote.lookup(keys, "k", broken, "k string, v int", 1, QUICK)
    rows = {r.k: (r.v, r.error) for r in out.collect()}
    assert rows == {"k0": (0, None), "k1": (None, "not_found"), "k2": (2, None), "k3": (None, "http_503"), "k4": (4, None), "k5": (5, None)}
    asked = lambda q: {"results": [{"k": x, "v": 9} for x in q["keys"]]}
    again = {r.k: r.v for r in remote.lookup(keys, "k", asked, "k string, v int", 2, QUICK, known=out).collect()}
    assert again == {"k0": 0, "k1": None, "k2": 2, "k3": 9, "k4": 4, "k5": 5}


def test_limiter_spaces_requests():
    now, sent = [0.0], []

    def sleep(seconds):
        now[0] += seconds

    policy = remote.Policy(spacing=0.35, sleep=sleep, clock=lambda: now[0], jitter=lambda: 0.0)
    limiter = remote.Limiter(policy)

    def transport(q):
        sent.append(now[0])
        now[0] += 0.1 if len(sent) % 2 else 1.0
        return {"status": 429, "retry_after": 5} if len(sent) == 3 else {"count": 1}

    for _ in range(5):
        remote.fetched(transport, {}, policy, limiter)
    gaps = [b - a for a, b in zip(sent, sent[1:])]
    assert len(sent) == 6 and all(g >= 0.35 - 1e-9 for g in gaps) and gaps[2] >= 5


def test_probe_keys_and_rotation(spark):
    says = {"u1": {"status": 200}, "u2": {"status": 403, "error": "forbidden", "message": "no"}, "u3": {"status": 500, "text": "x" * 900}}
    urls = spark.createDataFrame([("u1",), ("u2",), ("u3",), ("boom",), (" ",), (None,)], "url string")
    got = {r.url: (r.status, r.error, r.message) for r in remote.probe(urls, lambda q: says[q["url"]]).collect()}
    assert got["u1"] == (200, None, None) and got["u2"] == (403, "forbidden", "no") and got["u3"] == (500, "http_500", "x" * 500)
    assert got["boom"][:2] == (0, "request_exception") and got[" "][1] == got[None][1] == "empty_url"
    assert remote.key_list({"KEYS": " a, b,,a ", "KEY_2": "c", "KEY_1": "b", "OTHER": "d"}, "KEYS") == ["a", "b", "c"]
    seen = []
    send = remote.rotated(lambda q: seen.append(q.get("key")) or {}, ["a", "b"])
    for _ in range(3):
        send({})
    assert seen == ["a", "b", "a"] and remote.rotated(lambda q: q, [])({"x": 1}) == {"x": 1}


def test_download_manifest_and_resume(spark, tmp_path):
    files = {"ok": {"content": b"%PDF-1.7 x"}, "html": {"content": b"<html>"}, "gone": {"status": 404}}
    rows = [("a", ["gone", "html", "ok", "never"]), ("b", ["html"]), ("c", []), ("d", None), ("e", ["gone", " "]), ("f", ["boom"])]
    df = spark.createDataFrame(rows, "id string, urls array<string>")
    out = remote.download(df, "id", "urls", lambda q: files[q["url"]], QUICK)
    got = {r.id: (r.status, r.url, r.tried) for r in out.collect()}
    assert got == {"a": ("downloaded", "ok", 3), "b": ("not_pdf", "html", 1), "c": ("no_url", None, 0), "d": ("no_url", None, 0), "e": ("http_404", "gone", 1), "f": ("error", "boom", 1)}
    path, schema = str(tmp_path / "manifest"), "id string, status string, ts int"
    assert io.manifest(spark, path, "id", schema).count() == 0
    for ts, (i, status) in enumerate([("a", "downloaded"), ("a", "http_500"), ("b", "not_pdf"), ("b", "http_404")]):
        io.append_manifest(spark.createDataFrame([(i, status, ts)], schema), path)
    best = io.manifest(spark, path, "id", schema)
    assert {(r.id, r.status) for r in best.collect()} == {("a", "downloaded"), ("b", "http_404")}
    todo = P.resume(df, best.where("status = 'downloaded'"), "id")
    assert {r.id for r in todo.collect()} == set("bcdef")


def test_references_summaries_and_replacement(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    (tmp_path / "a.json").write_text('[{"id": 1, "doi": "d1"}, {"id": null, "doi": "x"}]')
    (tmp_path / "b.jsonl").write_text('{"id": "2", "doi": "d2"}\n\nnot json\n{"id": "3"}\n')
    (tmp_path / "c.json").write_text('{"data": [{"other_id": "4", "doi": "d4"}, {"id": "5", "other_id": "6", "doi": "d5"}]}')
    spark.createDataFrame([("t", "d6"), (None, "d7")], "title string, doi string").write.parquet(p("d"))
    spark.createDataFrame([(8, "d8")], "reg int, doi string").write.parquet(p("e"))
    lists = [("array", p("a.json"), "s1"), ("lines", p("b.jsonl"), "s2"), ("envelope", p("c.json"), "s3"), ("titles", p("d"), "s4"), ("registry", p("e"), "s5"), ("titles", p("missing"), "s6")]
    got = {tuple(r) for r in io.tagged_references(spark, lists, {"registry_id": "reg"}).collect()}
    assert got == {("1", "d1", "s1"), ("2", "d2", "s2"), ("4", "d4", "s3"), ("5", "d5", "s3"), ("t", "d6", "s4"), ("8", "d8", "s5")}
    for value in (1, 2):  # the second one replaces the first
        io.write_summary(spark.createDataFrame([(value, None)], "n int, m string"), p("summary"))
        assert json.loads("".join(r.value for r in spark.read.text(p("summary"), wholetext=True).collect())) == [{"n": value, "m": None}]
    assert not [f for f in tmp_path.iterdir() if ".tmp" in f.name]
    io.write_sample(spark.range(50), "id", 7, p("sample"))
    first = io.csv(spark, p("sample")).collect()
    io.write_sample(spark.range(50).repartition(5), "id", 7, p("sample"))
    assert len(first) == 7 and first == io.csv(spark, p("sample")).collect()
    io.write_lines(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "w string"), "w", p("ids"))
    assert sorted(r.value for r in spark.read.text(p("ids")).collect()) == ["a", "b"]
    io.write_shards(spark.range(25).coalesce(1), p("shards"), 10)
    assert len(list((tmp_path / "shards").glob("*.json"))) == 3
    files = spark.createDataFrame([("file:/in/x/1.pdf",), ("file:/in/2.pdf",)], "file_path string")
    done = spark.createDataFrame([("file:/out/x/1.md",)], "file_path string")
    assert [tuple(r) for r in io.to_do(files, done, "file:/in", "file:/out", ".md").collect()] == [("file:/in/2.pdf", "file:/out/2.md")]
    with pytest.raises(Exception):
        io.jsonl_strict(spark, p("b.jsonl"), "id string").collect()
    with pytest.raises(ValueError):
        io.require(done, "nope")
    assert io.conform(done, __import__("pyspark").sql.types.StructType.fromDDL("z int, file_path string")).columns == ["z", "file_path"]


def test_held_passages_of_any_length(spark, monkeypatch):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text), (2, "un" + text + "s"), (3, "other words"), (4, None), (5, "")], "doc_id long, text string")
    pieces = ["three", "two three four", "two three four five", "two three four five six", "ne two", "", "o", text, "zzz", None]
    items = spark.createDataFrame(list(enumerate(pieces)), "item_id int, passage string")
    want = {(d, i) for d, t in ((1, text), (2, "un" + text + "s"), (3, "other words"), (5, "")) for i, q in enumerate(pieces) if q is not None and q in t}
    for n in (100, 2):
        monkeypatch.setattr(align, "SENT_PASSAGES", n)
        assert {(r.doc_id, r.item_id) for r in align.held_passages(docs, items).collect()} == want
    assert align.held_passages(docs, items.limit(0)).count() == 0


def test_partial_ratio_after_many_decoys():
    quote = "the quick brown fox jumps over the lazy dog near the river"
    near = quote.replace("lazy", "lary")
    decoys = " ".join(f"the quick brown cat {i}" for i in range(250))
    assert align.partial_ratio(quote, decoys + " " + near) == pytest.approx(align.partial_ratio(quote, near)) and align.partial_ratio(quote, near) > 97


def test_verify_fields_reads_texts_once(spark):
    ev = "struct<value:string,verbatim_source:string>"
    rows = [("W1", ("a", "held words here"), ("b", "nowhere at all, not one bit")), ("W2", ("a", "held words here"), (None, None)), ("W3", ("a", "text"), ("b", "text"))]
    df = spark.createDataFrame(rows, f"doc_id string, x {ev}, y {ev}")
    texts = spark.createDataFrame([("W1", "Some held words here."), ("W2", "other")], "doc_id string, text string")
    got = {r.doc_id: (r.x.value, r.y.value) for r in align.verify_fields(df, "doc_id", ["x", "y"], texts).collect()}
    assert got == {"W1": ("a", None), "W2": (None, None), "W3": (None, None)}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.integers(-50, 50))), max_size=60))
def test_percentiles_against_lists(spark, rows):
    import math

    import numpy as np

    df = spark.createDataFrame(rows, "g int, v int")
    points = (0.0, 0.25, 0.5, 0.9, 1.0)
    for g in {g for g, v in rows if v is not None}:
        values = sorted(v for k, v in rows if k == g and v is not None)
        n = len(values)
        want = {
            "linear": [float(np.percentile(values, p * 100)) for p in points],
            "nearest": [values[max(1, math.ceil(round(n * p, 9))) - 1] for p in points],
            "rounded": [values[round((n - 1) * p)] for p in points],
        }
        for kind, w in want.items():
            got = next(r for r in A.percentiles(df, F.col("v"), points, kind, ["g"]).collect() if r.g == g)
            assert [got[f"p{round(p * 100)}"] for p in points] == pytest.approx(w)
        break


def test_filters_around_models(spark):
    texts = ["short", "x" * 200, "<p>" + "word " * 60 + "</p>", "<b></b>" * 40, None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    asked = []

    def model(batch):
        return [("__label__en", 0.9) if "word" in t else ("__label__fr", 0.99) for t in batch]

    got = {r.id: r.is_english for r in P.language_filter(df, "text", model).collect()}
    assert got == {0: False, 1: False, 2: True, 3: True, 4: False} and not asked
    counts = P.token_lengths(df, "text", lambda: lambda ts: [len(t.split()) for t in ts])
    assert [r.token_count for r in counts.orderBy("id").collect()] == [1, 1, 61, 1, 0]
    long = P.length_ordered(spark.range(500).withColumn("n", (F.col("id") * 7919) % 500), F.col("n"))
    parts = [[r.n for r in p] for p in long.rdd.glom().collect() if p]
    assert all(p == sorted(p) for p in parts) and sorted(x for p in parts for x in p) == list(range(500))
    ordered = sorted(parts, key=lambda p: p[0])
    assert all(a[-1] < b[0] for a, b in zip(ordered, ordered[1:]))
    q = spark.createDataFrame([(1, [([" ", None], None)], None), (2, [(["q"], [" "])], [" "]), (3, None, ["db"])], "id int, q array<struct<boolean_query_string:array<string>,database_source:array<string>>>, d array<string>")
    flags = {r.id: (r.a, r.b) for r in q.select("id", P.has_boolean_queries(F.col("q"), True).alias("a"), P.has_database_info(F.col("d"), F.col("q"), True).alias("b")).collect()}
    assert flags == {1: (False, False), 2: (True, False), 3: (False, True)}


def test_no_local_folder_for_a_cluster():
    from types import SimpleNamespace

    from corpusmill.operators.graph import checkpointed

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://there", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        checkpointed(SimpleNamespace(sparkSession=session))


def test_inverted_index(spark):
    from corpusmill.functions import text as T

    df = spark.createDataFrame([(1, ["a", "b", None, "a"]), (2, []), (3, None)], "id int, w array<string>")
    got = {r.id: r.x for r in df.select("id", T.inverted_index("w").alias("x")).collect()}
    assert got == {1: {"a": [0, 3], "b": [1]}, 2: {}, 3: None}
