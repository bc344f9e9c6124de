"""Operators of the llm subpackage against brute force, exact round trips, held-out accuracy and odd input."""

import hashlib
import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm import chat_format as chat
from corpusmill.llm import decontaminate as leak
from corpusmill.llm import exact_dedup as exact
from corpusmill.llm import html_extract as page
from corpusmill.llm import line_dedup as lines
from corpusmill.llm import ngram_join as near
from corpusmill.llm import piece_sampling as sp
from corpusmill.llm import substring_dedup as sub
from corpusmill.llm import toxicity as tox
from corpusmill.llm import url_filter as url

LONG = "word " * 60_000
#: Null and empty texts, ties, repeated rows, a null id, a very long text; extra columns have names that operators use inside.
ODD = [(1, None), (2, ""), (3, "  \n"), (4, "a b"), (5, "a b"), (5, "a b"), (6, "ab"), (None, "a  b"), (7, LONG), (8, "x" * 5000), (9, "é ☃ 日本 ▁ \x01 </s>")]
EXTRA = "row long, _id long, key string, segment string, text_sha256 string, _sha string, host string, group long, rep long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, *([None] * 9)) for i, t in ODD]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}")


def vocabulary(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def corpus(n, seed, words=400):
    """Texts with copies, edited copies and shared passages."""
    rng, v = random.Random(seed), vocabulary(words, seed)
    out, passage = [], [rng.choice(v) for _ in range(60)]
    for i in range(n):
        w = [rng.choice(v) for _ in range(rng.randint(3, 120))]
        if i % 4 == 1:
            w = list(out[-1])
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(v)
        if i % 5 == 2:
            w[len(w) // 2 : len(w) // 2] = passage
        out.append(w)
    return [" ".join(w) if rng.random() < 0.8 else "\n".join(w) for w in out]


def test_exact_dedup_odd(odd):
    rows = exact.exact_dedup(odd).collect()
    assert len(rows) == len(ODD)
    sha = lambda s: hashlib.sha256("".join(c for c in s or "" if c not in " \t\n\v\f\r").encode()).hexdigest()
    assert Counter((r.doc_id, r.text_sha256) for r in rows) == Counter((i, sha(t)) for i, t in ODD)
    by = {}
    for r in rows:
        by.setdefault(r.text_sha256, []).append(r)
    for g in by.values():
        assert sum(r.kept for r in g) == 1 and {r.group_size for r in g} == {len(g)}
    assert [r.keep_id for r in by[sha("ab")] if r.kept] == [None] and {r.doc_id for r in by[sha("")] if r.kept} == {3}
    left = exact.drop_exact_duplicates(odd)
    assert left.columns == odd.columns and left.count() == len(by)


def test_exact_dedup_bloom_passes_unique_rows(spark):
    rows = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("s"))
    bits = exact.bits_for(3000)
    twice = rows.unionByName(rows.limit(10))
    flagged = exact.flag_possible_repeats(twice, "s", exact.repeated_bits(twice, "s", bits), bits)
    maybe = flagged.where("_maybe").count()
    assert 20 <= maybe < 300


def test_url_filter(spark):
    urls = [(1, "https://A.Org/x?y"), (2, "http://m.example.org/es/1"), (3, "http://example.org/en/17#a"), (4, "http://example.org/en/2"), (5, None), (6, "no scheme"), (7, "http://x.com/de/1"), (8, "http://x.com/fr"), (9, "http://cheap-pills.example.net"), (10, "http://notorg/"), (11, "http://b.org?q"), (11, "http://b.org?q"), (12, "a://b://c/d"), (13, "://org/")]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in urls], "page_id long, url string, host string, hits string")
    out = url.url_filter(df, spark.createDataFrame(url.RULES, "rule string, verdict string"), spark.createDataFrame([(x,) for x in url.LISTED], "url string"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert out.count() == len(urls)
    assert got[1] == ("a.org", "/x", "org/", "allow") and got[2] == ("m.example.org", "/es/1", "example.org/es/", "block")
    assert got[3] == ("example.org", "/en/17", "example.org/en/1", "block") and got[4][2:] == ("org/", "allow")
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow") and got[7][2:] == ("com/de/", "block") and got[8][2:] == (None, "allow")
    assert got[9] == ("cheap-pills.example.net", "", None, "block") and got[10][2] is None and got[11] == ("b.org", "", None, "allow")
    assert got[12][:2] == ("b:", "//c/d") and got[13][2] == "org/"
    none = url.url_filter(df.limit(0), spark.createDataFrame([], "rule string, verdict string"))
    assert none.count() == 0


def test_url_canonical():
    want = "a.org/b/c?q=1&r=%2F~"
    for u in ("http://a.org/b/c?q=1&r=%2f%7e", "HTTPS://A.org:443/b/./x/../c?q=1&r=%2F~#top", "http://me:pw@a.org.:80/%62/c?q=1&r=%2f~", "http://a.org/../b/c?q=1&r=%2F~"):
        assert url.canonical(u) == want
    assert url.canonical("http://a.org") == url.canonical("http://A.ORG/?#x") == "a.org/" and url.canonical("http://a.org/b/..") == "a.org/"
    assert url.canonical("http://a.org:443/") == "a.org:443/" and url.canonical(None) is None and url.canonical("a.org/b") is None and url.canonical("http://a.org/x/.") == "a.org/x/"


def test_url_filter_listed_pages(spark):
    rules = spark.createDataFrame([("b.org/", "allow")], "rule string, verdict string")
    pages = spark.createDataFrame([("https://a.org/x/../bad?id=%7e1",), ("http://b.org/bad",), (None,), ("no scheme",)], "url string")
    urls = ["http://A.org:80/bad?id=~1#f", "http://a.org/bad", "http://x.a.org/bad?id=~1", "https://b.org/bad", "http://c.org", None, "." * 5000, "http://" + "a." * 4000 + "b.org/bad"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "`page.id` long, `the url` string")
    got = {r.page_id: (r.rule, r.verdict, r.listed) for r in url.url_filter(df, rules, None, "page.id", "the url", pages).collect()}
    none = (None, "allow", False)
    assert got == {0: (None, "block", True), 1: none, 2: none, 3: ("b.org/", "allow", True), 4: none, 5: none, 6: none, 7: ("b.org/", "allow", False)}


def test_url_filter_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(url, "BROADCAST_ENTRIES", 0)
    df = spark.createDataFrame([(i, f"http://h{i % 50}.org/p{i}") for i in range(300)], "page_id long, url string")
    rules = spark.createDataFrame([(f"h{i}.org/p{i + 50}", "block") for i in range(50)] + [("org/", "allow")], "rule string, verdict string")
    got = {r.page_id: r.verdict for r in url.url_filter(df, rules).collect()}
    assert got == {i: "block" if str(i).startswith(str(i % 50 + 50)) else "allow" for i in range(300)}


def test_html_vectors():
    doc = """<html><body><header><a href=/>Home</a><p>Site header, text.</p></header><nav><p>Menu one</p></nav><div class="sidebar"><p>Side, text. More, of it.</p></div>
<div id="cookie-notice"><p>We use cookies, as ever.</p></div><main><h1>Head&amp;line</h1><p>First  paragraph, with <b>bold</b> &lt;text&gt;
and more.<p>Second&nbsp;one, unclosed.<br>Line</p><p>Short.</p><form><p>Your name, please.</p></form><script>var a="</p>";</script><style>p{}</style></main>
<div class="comments"><p>A reader said, this. And that.</p></div><footer><p>Imprint, address.</p></footer>"""
    assert page.extract(doc) == "Head&line\n\nFirst paragraph, with bold <text> and more.\n\nSecond one, unclosed. Line\n\nShort."
    assert page.extract(None) == "" and page.extract("") == "" and page.extract("<p") == "<p"
    assert page.extract(doc, hints=False) == page.extract(doc)
    for broken in ("</div></p>", "<![CDATA[x", "<!--", "<a <b>", "&#0;&#x110000;&bogus;", "<p>" * 3000 + "x", "<p>&#" + "9" * 6000 + ";", "<", "<a href='>", "x>"):
        page.extract(broken)
    assert page.extract("<p>One&#0000000000065;, two. &#x000000042;</p>") == "OneA, two. B" and page.extract("<p>a &#99999999999; b.</p>") == "a \ufffd b."
    assert page.extract('<p title="a > b">One, two.</p><a title="never closed>x</a>') == "One, two."


def test_html_pages_without_hints():
    """Pages without article, main, or telling names: the ratios decide alone, on every one of them."""
    rng, v = random.Random(12), vocabulary(300, 8)
    say = lambda n: " ".join(rng.choice(v) for _ in range(n)).capitalize() + "."
    for i in range(200):
        body = [" ".join(say(rng.randint(4, 14)) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(10, 14))]
        body[1] = say(2)  # a short paragraph among long ones
        links = "".join(f'<li><a href="/{k}">{rng.choice(v)}</a></li>' for k in range(8))
        box = f'<div class="x{i}">{say(rng.randint(5, 12))}</div>'
        title = say(6)
        flat = i % 2
        quote = f"<p>{body[-1]}</p>" if flat else f"<blockquote><p>{body[-1]}</p></blockquote>"
        story = f"<h1>{title}</h1>" + "".join(f"<p>{x}</p>" for x in body[:-1]) + quote
        doc = f"<body><ul>{links}</ul>{box}" + (story if flat else f"<div><div class=story>{story}</div></div>") + f"<div><p>{say(6)}</p></div></body>"
        want = "\n\n".join([title, *body])
        assert page.extract(doc, hints=False) == want and page.extract(doc) == want


def test_html_reader_comments_inside_the_article():
    story = "".join(f"<p>Paragraph {i}, with some words. And more.</p>" for i in range(4))
    said = "".join(f"<li><p>I think, dear writer, that number {i} is wrong. Really, all of it. And much more, at length.</p></li>" for i in range(12))
    doc = f"<article><h1>Head</h1>{story}<section class=comments><h2>Comments</h2><ol>{said}</ol></section></article>"
    assert page.extract(doc) == "\n\n".join(["Head", *(f"Paragraph {i}, with some words. And more." for i in range(4))])


@pytest.mark.parametrize("page_of", [
    lambda: "<div>" * 200_000 + "x", lambda: "<div>a, b." * 100_000, lambda: '<a href="x ' * 90_000 + ">", lambda: '<a href="x> ' * 80_000,
    lambda: "<b>" * 150_000 + "<p>x" * 100_000, lambda: "<div>" * 100_000 + "</i></section>" * 60_000, lambda: "<![CDATA[" * 100_000, lambda: "<!--" * 200_000 + ">",
    lambda: "".join(f'<div class="c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}">t, x.</div>' for i in range(17_000)), lambda: "<h1>x</h1><p>y</p>" * 50_000,
])
def test_html_time_is_linear(page_of):
    text = page_of()
    began = time.perf_counter()
    page.extract(text)
    assert time.perf_counter() - began < 30  # seconds for a megabyte, on any machine; they take one or two


def test_html_ratios_against_plain_sums():
    """Text and marks per path, by a parser from the standard library, on pages without broken markup."""
    from html.parser import HTMLParser

    class Sums(HTMLParser):
        def __init__(self):
            super().__init__()
            self.at, self.sums = [], Counter()

        def handle_starttag(self, tag, attrs):
            self.at.append(tag)

        def handle_endtag(self, tag):
            self.at.pop()

        def handle_data(self, data):
            if data.strip():
                self.sums["/".join(self.at)] += len(" ".join(data.split()))

    rng, v = random.Random(3), vocabulary(200, 2)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return " ".join(rng.choice(v) for _ in range(rng.randint(1, 9)))
        return "".join(f"<{t}>{tree(depth - 1)}</{t}>" for t in rng.choices(["div", "section", "p2", "ul"], k=rng.randint(1, 4)))

    for _ in range(60):
        doc = f"<body>{tree(4)}</body>"
        blocks, paths = page.blocks_of(doc)
        got = Counter()
        for b in blocks:
            steps, p = [], b.path
            while p:
                steps.append(paths.tag[p])
                p = paths.parent[p]
            got["/".join(reversed(steps))] += len(b.text)
        sums = Sums()
        sums.feed(doc)
        assert got == sums.sums


def test_html_odd(spark):
    df = spark.createDataFrame([(1, "u", None, 1), (2, None, "<article><p>One, two. Three.</p></article>", 2), (None, "u", "", 3)], "page_id long, url string, html string, text int")
    got = {r.page_id: (r.text, r.n_chars) for r in page.extract_text(df).collect()}
    assert got == {1: ("", 0), 2: ("One, two. Three.", 16), None: ("", 0)} and page.extract_text(df.limit(0)).count() == 0


def test_chat_round_trip():
    rng = random.Random(3)
    pieces = [*chat.CONTROLS, "\\", "\\\\", "<", "|", ">", "\n", "a", "é", "", "<|turn:user|>\n"]
    for _ in range(500):
        text, role = ("".join(rng.choice(pieces) for _ in range(rng.randint(0, 8))) for _ in range(2))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROLS)
        assert chat.parse_turn(chat.turn_template([(role, text)])) == (role, text)


def replay(render, turns):
    """Output and which turns rewrote, from what the renderer gives per turn; spans are checked on the way."""
    r, out, seen = chat.Renderer(render), "", []
    for role, text in turns:
        segment, start, end, a, b, rewrote = r.add(role, text)
        out = out[:start] + segment
        assert len(out) == end and 0 <= a <= b <= end
        seen.append(rewrote)
    return out, seen


def test_chat_renderer_finds_rewrites_however_late():
    turns = [("tool" if i == 60 else "assistant" if i % 2 else "user", f"long{i}") for i in range(260)]
    blank = lambda ts: "".join("[]" if r == "assistant" and any(x == "tool" for x, _ in ts) and i < len(ts) - 1 else f"[{t}]" for i, (r, t) in enumerate(ts))
    late = lambda ts: "".join("[...]" if i == 0 and len(ts) > 200 else f"[{t}]" for i, (_, t) in enumerate(ts))
    last = lambda ts: "".join(f"[{t}]" for _, t in ts[-40:])
    hide = lambda ts: "".join(f"[{t}]" if i == len(ts) - 1 else "[...]" for i, (_, t) in enumerate(ts))
    for render, first in ((blank, 60), (late, 200), (last, 40), (hide, 1), (chat.turn_template, None)):
        out, seen = replay(render, turns)
        assert out == render(turns) and (seen.index(True) if True in seen else None) == first


def test_chat_renderer_against_whole_prefixes():
    """Random templates: each may drop, blank or repeat turns, from some turn on or after some role."""
    rng = random.Random(11)
    for _ in range(150):
        since, what, who, keep = rng.randint(0, 30), rng.choice(["blank", "drop", "count", "none"]), rng.choice(["user", "tool", "assistant"]), rng.randint(1, 12)

        def render(ts, since=since, what=what, who=who, keep=keep):
            on = len(ts) > since and any(r == who for r, _ in ts)
            if on and what == "drop":
                ts = ts[-keep:]
            head = f"({len(ts)})" if on and what == "count" else "^"
            return head + "".join(f"<{r}>{'' if on and what == 'blank' and i < len(ts) - keep else t}</>" for i, (r, t) in enumerate(ts))

        turns = [(rng.choice(["user", "assistant", "tool"]), rng.choice(["", "a", "bb", "\x01", "</>"])) for _ in range(rng.randint(1, 45))]
        r, before = chat.Renderer(render), render([])
        for i, (role, text) in enumerate(turns):
            segment, start, end, a, b, rewrote = r.add(role, text)
            now = render(turns[: i + 1])
            assert now == before[:start] + segment and end == len(now) and rewrote == (not now.startswith(before)) and now[a:b] == text
            before = now


def test_chat_common_prefix():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert chat.common_prefix(a, b) == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_chat_query_odd(spark, tmp_path):
    rows = [(1, 1, "assistant", None, 0), (1, 0, None, "hi </s>", 0), (None, 0, "user", "q", 0), (None, 0, "user", "q", 0), (2, None, "assistant", "x" * 100_000, 0), (3, 0, "assistant", "<|end|>\n", 0)]
    schema = "conv_id long, turn long, role string, text string, segment int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op6_chat_format(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("\nhi </s>\nassistant\n\n") and got[1].loss_chars == 0 and got[None].n_turns == 2
    assert got[2].loss_chars == 100_000 and got[3].loss_sha256 == sha("<|end|>\n") and got[-1].n_turns == 2


def test_substring_dedup_brute_force(spark):
    texts = corpus(120, 5) + [" ".join(["x", "y"] * k) for k in (17, 18, 40)] + [None, "", " ".join(["z"] * 34), " ".join(["q"] * 36)]
    texts += [texts[0], texts[4] + " " + texts[4]]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, row int")
    got = {r.doc_id: r for r in sub.substring_dedup(df).collect()}
    want = sub.brute_force(texts)
    for i, w in enumerate(want):
        r = got[i]
        assert (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) == w
        assert sum(s.end - s.start for s in r.removed) == r.n_removed


def test_substring_dedup_hot_anchor(spark, monkeypatch):
    """A passage of 30 words with other surroundings in each document: no window repeats; with 5 words more one does."""
    monkeypatch.setattr(sub, "HOT_ROWS", 20)
    rng, v = random.Random(3), vocabulary(900, 4)
    passage = [rng.choice(v) for _ in range(40)]
    texts = [" ".join([*(rng.choice(v) for _ in range(20)), *passage[: 30 + (i % 7 == 0) * 6], *(rng.choice(v) for _ in range(20))]) for i in range(140)]
    got = {r.doc_id: r for r in sub.substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, w in enumerate(sub.brute_force(texts)):
        assert (got[i].n_words, got[i].n_removed, hashlib.sha256(got[i].kept.encode()).hexdigest()) == w
        assert (w[1] > 0) == (i % 7 == 0)


def test_substring_dedup_repeated_ids(spark):
    texts = corpus(40, 6)
    rows = [(i // 3, t) for i, t in enumerate(texts)] + [(None, texts[3]), (None, texts[8]), (2, texts[6]), (2, texts[6])]
    got = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in sub.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter((i, *w) for (i, _), w in zip(rows, sub.brute_force([t for _, t in rows])))


def test_substring_dedup_small_slices(spark):
    """No task holds two Python workers at once, and the last step holds ``CHUNK`` texts."""
    texts = [" ".join(f"{i % 7}-{j}" for j in range(40)) for i in range(20)]
    df = sub.substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))

    def chained(plan, below_python):
        name = plan.nodeName()
        if name == "MapInArrow" and below_python:
            return True
        python = name == "MapInArrow" or below_python and name != "Join"
        return any(chained(plan.children().apply(i), python) for i in range(plan.children().size()))

    assert not chained(df._jdf.queryExecution().optimizedPlan(), False)
    assert sorted((r.n_words, r.n_removed) for r in df.collect()) == [(40, 40)] * 20
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(2500)), "text": ["a b"] * 2500, "marks": pa.nulls(2500, pa.list_(pa.struct([("first", pa.int32()), ("mask", pa.int64())])))})
    assert [b.num_rows for b in sub._cut_out(35)(iter([batch]))] == [1000, 1000, 500]


def test_substring_dedup_blocks(spark, monkeypatch):
    a = " ".join(vocabulary(3000, 1))
    hashes = sub.WordHashes().of(sub.split(a.encode()))
    whole = sub.segments_of(hashes, sub.Powers())
    monkeypatch.setattr(sub, "BLOCK", 257)
    parts = sub.segments_of(hashes, sub.Powers())
    windows = lambda s: sorted(i for f, n in zip(s[2], s[3]) for i in range(f, f + n))
    assert windows(whole) == windows(parts) == list(range(len(hashes) - sub.WINDOW + 1))


def test_substring_dedup_odd(odd):
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in sub.substring_dedup(odd).collect())
    assert got[(7, 60_000, 60_000)] == 1 and got[(5, 2, 0)] == 2 and got[(1, 0, 0)] == 1 and sum(got.values()) == len(ODD)
    assert sub.substring_dedup(odd.limit(0)).count() == 0


def test_line_dedup_brute_force(spark):
    rng = random.Random(2)
    pool = [" ".join(rng.choice("abcdefg") * rng.randint(1, 4) for _ in range(rng.randint(1, 5))) for _ in range(400)]
    block = pool[:9]
    rows = []
    for i in range(150):
        x = [rng.choice(pool) for _ in range(rng.randint(0, 25))]
        if i % 3 == 0:
            k = rng.randint(0, len(x))
            x[k:k] = block
        rows.append((i, "\n".join(x + ([""] * (i % 2)))))
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, body string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_chunks_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in lines.line_dedup(df).collect()}
    want = lines.brute_force(rows)
    assert got == want and sum(w[2] for w in want.values()) > 20


def test_line_dedup_removes_repeats_whatever_stands_around_them(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(60):  # passages of two to seven lines, each twice between lines that occur once
        passage = [f"passage {i} {k}" for k in range(2 + i % 6)]
        for copy in range(2):
            head, tail = ([f"{side} {i} {copy} {k}" for k in range(rng.randint(0, 3))] for side in ("head", "tail"))
            rows.append((2 * i + copy, "\n".join([*head, *passage, *tail])))
            want[2 * i + copy] = "\n".join([*head, *tail] if copy else [*head, *passage, *tail])
    rows += [(900, "x\n\ny\nz"), (901, "q\nx\n\ny\n\nr"), (902, "x\ny"), (903, "z\nz\nz")]
    want |= {900: "x\n\ny\nz", 901: "q\n\nr", 902: "x\ny", 903: "z"}
    got = {r.doc_id: r.text for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_line_chunks_shift():
    base = [f"line {i} {i * i}" for i in range(60)]
    a = {c[2] for c in lines.chunks("\n".join(base).encode())}
    b = {c[2] for c in lines.chunks("\n".join(["new first", *base[:30], "in between", *base[30:]]).encode())}
    assert len(a & b) >= len(a) - 4
    assert b"\n".join(c[2] for c in lines.chunks(b"x\n\ny\n")) == b"x\n\ny\n" and lines.chunks(b"") == []


def test_line_dedup_odd(odd):
    got = [(r.doc_id, r.text) for r in lines.line_dedup(odd).collect()]
    assert Counter(got) == Counter((i, t or "") for i, t in ODD) and lines.line_dedup(odd.limit(0)).count() == 0


def linked(df):
    return Counter((r.doc_id, r.class_id, r.n_links) for r in near.near_duplicates(df).collect())


def test_near_duplicates_brute_force(spark):
    rows = list(enumerate(corpus(300, 9, words=2000))) + [(900, "a b"), (901, "a b"), (902, "a b c"), (903, ""), (904, None), (905, "\n")]
    rows += [(3, rows[3][1])] * 3 + [(4, rows[7][1] + " z"), (4, "nothing like it " * 9), (5, rows[4][1]), (5, rows[4][1])]  # repeated rows and ids
    assert linked(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, rep int")) == Counter(near.brute_force(rows))


def test_near_duplicates_repeats(spark):
    a = "one two three four five six seven eight nine ten eleven twelve"
    other = "quite another text that shares nothing with the ones before it at all"
    df = spark.createDataFrame([(1, a), (1, a), (2, a + " more"), (2, other)], "doc_id long, text string")
    assert linked(df) == Counter({(1, 1, 2): 2, (2, 1, 2): 1, (2, 2, 0): 1})
    assert Counter((r.doc_id, r.text) for r in near.keep_one_per_class(df).collect()) == Counter({(1, a): 1, (2, other): 1})
    named = df.select(F.col("doc_id").alias("an.id"), F.col("text").alias("a text"), F.lit(1).alias("h1"), F.lit(2).alias("row"), F.lit(3).alias("a.b"))
    left = near.keep_one_per_class(named, "an.id", "a text")
    assert left.columns == named.columns and left.count() == 2


def dense(n, seed, size=200):
    rng, v = random.Random(seed), vocabulary(3000, 4)
    base = [rng.choice(v) for _ in range(size)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(i % 5):
            w[rng.randrange(size)] = rng.choice(v)
        if i % 3 == 0:  # half of it another text: shares prefixes, but isn't linked
            w[size // 2 :] = [rng.choice(v) for _ in range(size // 2)]
        rows.append((i, " ".join(w)))
    return rows


def test_near_duplicates_in_parts(spark, monkeypatch):
    """A large group of near copies, cut into parts; nodes that are split by longer prefixes, in tasks and before the shuffle."""
    rows = dense(90, 1)
    df, want = spark.createDataFrame(rows, "doc_id long, text string"), Counter(near.brute_force(rows))
    monkeypatch.setattr(near, "PART", 16)
    assert linked(df) == want
    monkeypatch.setattr(near, "NODE", 3)
    monkeypatch.setattr(near, "SIDE_ROWS", 0)
    assert linked(df) == want
    monkeypatch.setattr(near, "HELD", 20)
    assert linked(df) == want


def test_forest_walk_splits_until_nodes_are_small(monkeypatch):
    rng = np.random.default_rng(2)
    sig = np.unique(rng.integers(0, 3, (400, near.TREES * near.DEPTH)).astype(np.uint8), axis=0)
    order = near.label_order(5)
    monkeypatch.setattr(near, "NODE", 7)
    edges, at = near.walk(sig, order, 2, 50)
    for i, d in enumerate(at.tolist()):  # each row's node at its depth is small, and the one above it is not
        size = lambda d, i=i: (sig[:, order[:d]] == sig[i, order[:d]]).all(1).sum()
        assert size(d) <= 7 and (d == 2 or (sig[:, order[2 : d - 1]] == sig[i, order[2 : d - 1]]).all(1).sum() > 7)
    assert all((sig[a] == sig[b]).sum() >= 50 for a, b in edges)
    near_pairs = lambda e, n: len({frozenset(x) for x in e}) <= n - 1
    every = near.join_near(sig, 50)
    assert near_pairs(every, len(sig))
    root = list(range(len(sig)))
    for a, b in every:
        a, b = root[a], root[b]
        root = [a if x == b else x for x in root]
    same = (sig[:, None, :] == sig[None, :, :]).sum(2) >= 50
    assert all(root[i] == root[j] for i, j in zip(*np.nonzero(same)))


def test_near_recall_over_similarities(spark):
    """Pairs around the threshold, each alone: all linked ones are found."""
    rng, v, rows = random.Random(3), vocabulary(6000, 7), []
    for k in range(150):
        w = [rng.choice(v) for _ in range(rng.randint(30, 150))]
        x = list(w)
        for _ in range(max(1, len(w) * (k % 5) // 200)):
            x[rng.randrange(len(x))] = "zzz"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(x))]
    want = Counter(near.brute_force(rows))
    assert linked(spark.createDataFrame(rows, "doc_id long, text string")) == want and sum(n for (_, _, k), n in want.items() if k) > 100


def test_near_duplicates_odd(odd):
    got = near.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r.n_links for r in got if r.doc_id in (1, 2, 3, 6)} == {0} and {r.n_links for r in got if r.doc_id in (4, 5)} == {3}
    left = near.keep_one_per_class(odd)
    assert left.columns == odd.columns and left.count() == 8 and near.near_duplicates(odd.limit(0)).count() == 0


def edited(words, rng, share):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < share / 3 else ["zzz"] if x < share * 2 / 3 else [w, "yyy"] if x < share else [w]
    return out


def test_decontaminate(spark):
    rng, v = random.Random(8), vocabulary(1500, 2)
    items = [(i, " ".join(rng.choice(v) for _ in range(40))) for i in range(12)] + [(50, "a b"), (51, None)]
    docs, want = [], set()
    for i in range(200):
        w = [rng.choice(v) for _ in range(rng.randint(20, 300))]
        if i % 10 < 2:
            k = rng.randrange(12)
            w[10:10] = items[k][1].split() if i % 10 else edited(items[k][1].split(), rng, 0.25)
            want.add((i, k))
        docs.append((i, " ".join(w).upper() if i % 3 == 0 else " ".join(w)))
    got = leak.contaminated(spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double"), spark.createDataFrame(items, "item_id long, text string"))
    rows = got.collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and all(r.score == 1 for r in rows if r.doc_id % 10 == 1)
    kept = leak.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {d for d, _ in want}


def test_decontaminate_finds_an_edited_version_with_many_copies(spark):
    rng, v = random.Random(9), vocabulary(1500, 3)
    items = [(k, [rng.choice(v) for _ in range(20)]) for k in range(2)]
    docs = []
    for k, (_, w) in enumerate(items):
        every = 4 + k  # every fourth or fifth word replaced
        copy = ["zzz" if j % every == every - 1 else x for j, x in enumerate(w)]
        docs += [(k * 100 + i, " ".join([*(rng.choice(v) for _ in range(30)), *copy, *(rng.choice(v) for _ in range(30))])) for i in range(40)]
    docs += [(1000 + i, " ".join(rng.choice(v) for _ in range(80))) for i in range(40)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leak.contaminated(df, bench).collect()} == {(d, d // 100) for d, _ in docs if d < 1000}
    assert {r.doc_id for r in leak.drop_contaminated(df, bench).collect()} == {d for d, _ in docs if d >= 1000}


def test_decontaminate_finds_a_passage_of_a_long_item():
    v = vocabulary(1500, 4)
    rng = random.Random(10)
    words = rng.sample(v, 59)
    index = leak.Index.of([(7, " ".join(words))])
    for n, hit in ((29, True), (13, True), (12, False)):
        text = " ".join(["zzz"] * 20 + words[15 : 15 + n] + ["zzz"] * 20).encode()
        found = [leak.matches(index, *x) for x in leak._hits(index, leak.WordIds(index.vocabulary), [text])]
        assert found == [[(0, n / 59, 20, 20 + n, n - 2)] if hit else []]


def test_align_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(1, 14))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert leak.align(a, b)[0] == h.max()


def test_decontaminate_odd(odd, spark, monkeypatch):
    none = spark.createDataFrame([], "item_id long, text string")
    assert leak.contaminated(odd, none).count() == 0 and leak.drop_contaminated(odd, none).count() == len(ODD)
    monkeypatch.setattr(leak, "BLOCK_WORDS", 5)  # several blocks
    items = spark.createDataFrame([(1, "word word word word"), (2, "é ☃ 日本"), (2, "é ☃ 日本"), (3, "p q r s")], "item_id long, text string")
    assert Counter((r.doc_id, r.item_id) for r in leak.contaminated(odd, items).collect()) == {(7, 1): 1, (9, 2): 2}


def test_toxicity_learns_and_generalises(spark):
    rng, v = random.Random(5), vocabulary(800, 3)
    bad = ["grumblefuss", "snarlwart", "dreckhaufen", "miesling"]
    texts, labels = [], []
    for i in range(900):
        w = [rng.choice(v) for _ in range(rng.randint(20, 200))]
        if i % 6 == 0:
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(bad)
        texts.append(" ".join(w)), labels.append(int(i % 6 == 0))
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    lab = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    model = tox.fit(docs, lab)
    got = tox.score(docs, model).collect()
    test = [r for r in got if r.held_out]
    assert {r.doc_id for r in test} == {i for i in range(900) if __import__("zlib").crc32(str(i).encode()) % 3 == 1}
    hit = [r.predicted for r in test if labels[r.doc_id]]
    assert sum(hit) >= 0.95 * len(hit) and sum(r.predicted for r in test if not labels[r.doc_id]) <= 0.02 * len(test)
    odd = [(1, "the grumblefus snarlwartt of " + " ".join(v[:20])), (2, " ".join(v[:22])), (3, None), (4, "")]  # misspelt, clean, none
    got = {r.doc_id: r.score for r in tox.score(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert got[1] > 0.7 > got[2] and got[3] == got[4] and 0 <= got[3] <= 1
    left = tox.drop_toxic(docs, lab)
    assert left.columns == docs.columns and abs(left.count() - 750) < 20


def test_toxicity_learns_from_the_same_rows_on_every_run(spark):
    docs = [(i % 40, f"text {i}") for i in range(200)] + [(None, "x")]
    labels = [(i, i % 2) for i in range(40)] + [(3, 1), (4, 1), (5, 7), (100, 0), (6, None)]  # 4 has two labels
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    runs = []
    for parts in (1, 3, 7):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
        texts, y = tox.training_rows(df, lab, per_label=8)
        runs.append((texts, y.tolist()))
        few, z = tox.training_rows(df, lab, per_label=8, chars=20)
        assert sum(len(t) for t, k in zip(few, z) if k == 0) <= 20 and set(few) <= set(texts)
    assert runs[0] == runs[1] == runs[2] and Counter(runs[0][1]) == {0: 8, 1: 8}
    ids = {int(t.split()[1]) % 40 for t in runs[0][0]}
    assert len(ids) == 16 and not ids & {4, 5} and all(__import__("zlib").crc32(str(i).encode()) % 3 != 1 for i in ids)


def test_toxicity_odd(odd, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert tox.fit(odd, none) is None
    got = tox.score(odd, None).collect()
    assert len(got) == len(ODD) and {r.score for r in got} == {0.0} and tox.drop_toxic(odd, none).count() == len(ODD)


@pytest.fixture(scope="module")
def pieces():
    return sp.Pieces.load()


def segmentations(pieces, word):
    if not word:
        yield ()
    for j in range(1, len(word) + 1):
        if word[:j] in pieces.ids:
            for rest in segmentations(pieces, word[j:]):
                yield (word[:j], *rest)


def test_sampling_matches_enumeration(pieces):
    text, n = "that on", 4000
    every = [a + b for a in segmentations(pieces, "▁that") for b in segmentations(pieces, "▁on")]
    w = np.array([sum(pieces.weight[p] for p in s) for s in every])
    prob = dict(zip([tuple(pieces.ids[p] for p in s) for s in every], np.exp(w - w.max()) / np.exp(w - w.max()).sum()))
    part = sp.Slice([text] * n, np.arange(n).astype(np.uint64) * np.uint64(7919), sp.Lattices(pieces), 5)
    first, both, total = Counter(), Counter(), 0.0
    for *samples, kappa in part.search(3):
        ids = [tuple(part.ids(e, pieces.byte0).tolist()) for e, _, _ in samples]
        assert len(set(ids)) == 3 and [g for _, _, g in samples] == sorted((g for _, _, g in samples), reverse=True)
        assert all(abs(lp - math.log(prob[x])) < 1e-9 for (_, lp, _), x in zip(samples, ids))
        first[ids[0]] += 1
        both[ids[0], ids[1]] += 1
        total += sum(math.exp(lp - sp.inclusion(lp, kappa)) for _, lp, _ in samples)
    assert all(abs(first[x] / n - p) < 0.03 for x, p in prob.items())
    assert all(abs(k / n - prob[a] * prob[b] / (1 - prob[a])) < 0.03 for (a, b), k in both.items())
    assert abs(total / n - 1) < 0.02  # weighted estimates are unbiased


def test_sampling_round_trip(odd, pieces, spark):
    out = sp.sample_encodings(odd, k=3)
    rows = out.collect()
    assert all(r.round_trip for r in rows)
    assert all(len(r.ids) == 0 and r.log_inclusion == 0 for r in rows if r.doc_id in (1, 2))
    per = Counter((r.doc_id, r.sample) for r in rows)
    assert per[(5, 0)] == 2 and per[(7, 2)] == 1
    again = sp.sample_encodings(odd.repartition(3), k=3).collect()
    key = lambda r: (str(r.doc_id), r.sample, r.ids)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    back = sp.decode(out.select("doc_id", "ids"))
    assert {(r.doc_id, r.text) for r in back.collect()} == {(i, t or "") for i, t in ODD}
    assert sp.sample_encodings(odd.limit(0)).count() == 0


def test_long_words_do_not_underflow(pieces):
    part = sp.Slice(["q" * 3000], np.array([1], np.uint64), sp.Lattices(pieces), 1)
    (*samples, _), = part.search(2)
    assert all(pieces.decode(part.ids(e, pieces.byte0).tolist()) == "q" * 3000 and lp < 0 for e, lp, _ in samples)


def test_samples_are_equal_bit_by_bit_whatever_stands_beside_them(pieces, monkeypatch):
    import pyarrow as pa

    rng, v = random.Random(6), vocabulary(400, 5)
    texts = [" ".join(rng.choice(v) for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["q" * 400, "é☃ " * 30, "", "y" * 65]
    odd = ["z" * 151, "ab " * 2000, "x" * 5000, "日本" * 300]

    def sample(rows, size):
        t = pa.table({"doc_id": [i for i, _ in rows], "text": [x for _, x in rows]})
        out = pa.Table.from_batches(sp._sample(pieces, 3, 9)(t.to_batches(max_chunksize=size))).to_pylist()
        return {(r["doc_id"], r["sample"]): (r["ids"], r["log_prob"], r["perturbed"], r["log_inclusion"]) for r in out if r["doc_id"] < 100}

    rows = list(enumerate(texts))
    alone = {k: x for r in rows for k, x in sample([r], 1).items()}
    for k in range(4):
        beside = rows + [(100 + i, odd[rng.randrange(len(odd))]) for i in range(k * 8)]
        rng.shuffle(beside)
        monkeypatch.setattr(sp, "SLICE_CHARS", rng.choice([300, 5000, 500_000]))
        monkeypatch.setattr(sp, "KEPT_NODES", rng.choice([0, 700, 1_000_000]))
        assert sample(beside, rng.randint(1, 80)) == alone  # equal floats, not close ones


def test_exits_that_are_not_drawn_cannot_win(pieces, monkeypatch):
    text = " ".join(vocabulary(3000, 9))
    few = sp.Slice([text], np.array([5], np.uint64), sp.Lattices(pieces), 3).search(4)
    monkeypatch.setattr(sp, "BLOCK", 10**9)  # all are drawn
    every = sp.Slice([text], np.array([5], np.uint64), sp.Lattices(pieces), 3).search(4)
    assert [(a.tolist(), b, c) for a, b, c in few[0][:-1]] == [(a.tolist(), b, c) for a, b, c in every[0][:-1]] and few[0][-1] == every[0][-1]


def test_stages_keep_columns_and_tell_repeated_ids_apart(spark, tmp_path):
    """Repeated ids and rows, clashing and dotted names, an id that isn't a number, and no documents at all."""
    import corpus_pipeline

    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [("x", "a b", 1), ("x", "a   b", 2), ("x", "a  b", 3), ("y", long, 4), ("y", long + " more", 5), ("y", "something else", 6), ("z", None, 7), (None, "", 8), ("y", "something else", 6)]
    df = spark.createDataFrame([(*r, "p", "q", "r", "s") for r in rows], "doc_id string, text string, `a.b` int, _sha string, h1 string, maybe string, id string")
    spark.createDataFrame([], "doc_id string, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(7, "never seen in any text of these")], "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, empty = df, df.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, empty = stage(spark, docs, str(tmp_path)), stage(spark, empty, str(tmp_path))
        assert docs.columns == empty.columns == df.columns and empty.count() == 0
    got = {(r["doc_id"], r["text"], r["a.b"]) for r in docs.collect()}
    assert len(got) == docs.count() == 4 and {g[2] for g in got} - {7, 8} == {2, 4, 6} and ("x", "a   b", 2) in got
    assert {g[2] for g in got} & {7, 8} == {8}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).where("sample = 0").count() == 4


def test_decontaminate_item_ids_of_any_type(spark):
    text = "some words of an item that stands in a text and in no other place"
    df = spark.createDataFrame([(1, f"before {text} after"), (2, "nothing")], "doc_id long, text string")
    for kind, value in (("int", 3), ("string", "q-3"), ("long", 3), ("decimal(5,2)", None)):
        items = spark.createDataFrame([(value, text)], f"item_id {kind}, text string")
        rows = leak.contaminated(df, items).collect()
        assert [(r.doc_id, r.item_id) for r in rows] == [(1, value)] and leak.contaminated(df, items).schema["item_id"].dataType == items.schema["item_id"].dataType


def test_decontaminate_against_alignment_of_all_pairs(spark):
    """Seeds find every document whose whole alignment with an item reaches the threshold."""
    rng, v = random.Random(21), vocabulary(1500, 11)
    items = [(k, [rng.choice(v) for _ in range(rng.randint(15, 59))]) for k in range(10)]
    docs = []
    for i in range(150):
        w = [rng.choice(v) for _ in range(rng.randint(20, 120))]
        if i % 2:
            w[5:5] = edited(items[i % 10][1], rng, rng.choice([0.0, 0.1, 0.2, 0.3, 0.4]))
        docs.append((i, w))
    got = {(r.doc_id, r.item_id) for r in leak.contaminated(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")).collect()}
    number, want = {}, set()
    ids = lambda w: np.array([number.setdefault(x, len(number)) for x in w])
    for i, w in docs:
        for k, x in items:
            score, _ = leak.align(ids(x), ids(w))
            if score >= min(leak.THRESHOLD * leak.MATCH * len(x), leak.MATCH * leak.PASSAGE):
                want.add((i, k))
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 40


def test_no_local_folder_for_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from corpusmill.llm import common

    context = SimpleNamespace(master="spark://there", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context)
    with pytest.raises(RuntimeError):
        common.shared_folder(session)
    session.conf.get = lambda *a: "/shared"
    assert common.shared_folder(session) == "/shared"


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng, v = random.Random(4), vocabulary(900, 6)
    text = lambda n: " ".join(rng.choice(v) for _ in range(n))
    clean = [(i, text(80), "en") for i in range(120)]
    toxic = [(200 + i, text(40) + " snarlwart " * 2 + text(40), "en") for i in range(60)]
    item = text(40)
    copies = [(300, clean[0][1].replace(" ", "  "), "en"), (301, clean[1][1] + " " + text(2), "en"), (302, text(30) + " " + item + " " + text(30), "en"), (303, None, "fr"), (304, "", "fr")]
    rows = clean + toxic + copies
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(200 <= i < 300)) for i, _, _ in rows if i < 300], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    want = {i for i, _, _ in clean} - {0} | {300, 303}
    assert got == want
    assert [len(corpus_pipeline.STAGES), out.schema["ids"].dataType] == [5, T.ArrayType(T.IntegerType(), True)]
