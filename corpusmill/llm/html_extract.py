"""Main text of web pages by tag-path ratios.

Every piece of text hangs at a root-to-leaf path of tags (with classes and ids, without inline
markup). Per path of a page the text length and the punctuation are added up; link text counts
against a path twice, and the headings of a section, ``HEADING`` times their length, count for
the paths inside that section. In page order both sums are smoothed with a Gaussian whose
weights shrink with the distance of two paths in the tree, brought to a common scale, and fused
by their geometric mean. What pages say about their own parts is one more factor, not a rule:
``MAIN_WEIGHT`` inside an article or main element, ``ASIDE_WEIGHT`` inside navigation, asides,
page headers and footers, and elements whose class, id or role names such a part. Paths whose
best fused value is at least ``THRESHOLD`` of the page's best one (outside parts that are named as
something else) are content: so a short paragraph stays if the paragraphs at its path are content together.

Headings stay where their section holds content, unless all that stands below them went.
Elements that never show text (scripts, styles, forms and their fields) are left out before.

A block ends where a block element or a line break of the page's structure starts or ends.
Inside a block references are decoded, white space becomes one space, and the ends are trimmed;
blocks are joined in page order by an empty line. Pages are read in one pass, in time and
memory in proportion to their length, whatever is nested or left unclosed in them.

Edge cases: null or empty HTML, and pages without content, give an empty text; repeated rows
give repeated results; broken markup is read as browsers do for the cases that matter here
(unclosed paragraphs, stray end tags, raw text of scripts); a quote that is never closed ends
with its tag; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

# HTML element groups.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
HIDDEN = set("script style noscript template iframe svg math object embed canvas audio video head title form button select option textarea input dialog".split())
ASIDE = set("nav aside footer menu".split())
CLOSES_P = set("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}
#: Words in a class, id or role that name something other than the article.
BOILER = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|banner|breadcrumbs?|byline-ads|captcha|comments?|commentlist|contentinfo|cookies?|consent|disqus|footer|gdpr|login|masthead|menu|nav|navbar|navigation|navbox|newsletter|notices?|pagination|pager|popup|modal|promo\w*|related|replies|respond|search|share|sharing|sidebar|signup|site-header|skip|social|sponsor\w*|subscribe|tags|toc|toolbar|topbar|widgets?|complementary)(?:$|[-_\s])",
    re.I,
)
MAIN = {"article", "main"}
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")
SPACE = re.compile(r"\s+")
NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
QUOTE = re.compile(r"=\s*([\"'])|>")
LONG_REFERENCE = re.compile(r"&#(?:([0-9]{8,})|[xX]([0-9a-fA-F]{7,}));?")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?=[\s/=>]|$))", re.I)
THRESHOLD, SIGMA, RADIUS = 0.2, 1.0, 2
HEADING, MAIN_WEIGHT, ASIDE_WEIGHT = 64, 3.0, 0.02
FAR = 8  # steps in the tree from which two paths don't smooth each other


@dataclass
class Paths:
    """The tree of a page's tag paths: parents and steps by number; a parent's number is less than its children's."""

    parent: list[int]
    depth: list[int]
    tag: list[str]
    hint: list[int]  # 1: inside a main part, -1: inside a part that is named as another one, 0: neither

    def distance(self, a: int, b: int) -> int:
        """Steps from one path to the other, ``FAR`` at most."""
        n = 0
        while a != b and n < FAR:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
            n += 1
        return n


@dataclass
class Block:
    path: int
    text: str
    link: int = 0
    level: int = 0  # of a heading


def decoded(text: str) -> str:
    """Character references decoded; numbers beyond any character stand for U+FFFD."""

    def short(m: re.Match) -> str:
        digits = (m[1] or m[2]).lstrip("0") or "0"
        return f"&#{'' if m[1] else 'x'}{digits};" if len(digits) < 8 else "�"

    return entities.unescape(LONG_REFERENCE.sub(short, text)) if "&" in text else text


def tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, name or text, attributes, end): kind is ``text``, ``open`` or ``close``; the receiver may send a place to go on from."""
    at, n = 0, len(page)
    last_gt, last_comment, last_data = page.rfind(">"), page.rfind("-->"), page.rfind("]]>")
    last_quote = {q: page.rfind(q) for q in "\"'"}
    loose = False  # no tag of the rest has its quotes closed
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt > last_gt and page.startswith("<!--", lt) is False:
            yield "text", page[at:], "", n
            return
        if lt > at:
            yield "text", page[at:lt], "", lt
        if page.startswith("<!--", lt):
            if lt + 4 > last_comment:
                return
            at = page.index("-->", lt + 4) + 3
            continue
        if page.startswith("<![CDATA[", lt) and lt < last_data:
            end = page.index("]]>", lt)
            yield "text", page[lt + 9 : end].replace("&", "&amp;"), "", end + 3
            at = end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            at = page.index(">", lt) + 1
            continue
        name = NAME.match(page, lt + 1)
        if name is None:
            yield "text", "<", "", lt + 1
            at = lt + 1
            continue
        end = i = name.end()
        while not loose:
            m = QUOTE.search(page, i)
            if m is None:
                loose = True
            elif m[1] is None:
                end = m.end()
                break
            elif m.end() > last_quote[m[1]]:
                i = m.end()  # never closed: an ordinary character
            else:
                i = page.index(m[1], m.end()) + 1
        if loose:
            end = page.index(">", name.end()) + 1
        tag = name[0].lower()
        kind, tag = ("close", tag[1:]) if tag[0] == "/" else ("open", tag)
        moved = yield kind, tag, page[name.end() : end - 1], end
        at = end if moved is None else moved


def _step(tag: str, attributes: str) -> tuple[str, bool]:
    """The element's step in a path, and whether it names another part than the main one."""
    if not attributes:
        return tag, False
    names, other = [], False
    for m in ATTRIBUTE.finditer(attributes):
        value, key = m[2] or m[3] or m[4] or "", m[1].lower()
        other = other or key == "hidden" or bool(BOILER.search(value))
        if key == "class":
            names += sorted(re.sub(r"\d+", "", x) for x in value.split())
    return ".".join([tag, *names]), other


def blocks_of(page: str) -> tuple[list[Block], Paths]:
    """Blocks in page order, and the tree of their paths."""
    out: list[Block] = []
    paths = Paths([-1], [0], [""], [0])
    number: dict[tuple[int, str, int], int] = {}
    stack: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]  # tag, path, whether it shows nothing, level of the heading it is in
    open_tags: Counter[str] = Counter()
    pieces: list[str] = []
    link = linked = 0  # 1 + the length of the stack where a link began

    def flush():
        nonlocal linked
        if pieces:
            _, path, hidden, level = stack[-1]
            if not hidden:
                text = SPACE.sub(" ", decoded("".join(pieces))).strip()
                if text:
                    out.append(Block(path, text, min(linked, len(text)), level))
            pieces.clear()
        linked = 0

    def pop():
        nonlocal link
        open_tags[stack.pop()[0]] -= 1
        if link > len(stack):
            link = 0

    walk, moved = tokens(page), None
    while True:
        try:
            kind, name, attributes, end = walk.send(moved)
        except StopIteration:
            break
        moved = None
        if kind == "text":
            pieces.append(name)
            if link:
                linked += len(name.strip())
        elif kind == "close":
            if name == "a":
                link = 0
            elif name not in INLINE and open_tags[name] > 0:
                flush()
                while stack[-1][0] != name:
                    pop()
                pop()
        elif name == "br":
            pieces.append(" ")
        elif name in VOID:
            if name == "hr":
                flush()
        elif name in INLINE:
            if name == "a" and not attributes.endswith("/"):
                link = len(stack)
        else:
            flush()
            if name in CLOSES_P or name in CLOSES_ITSELF:
                while stack[-1][0] == "p":
                    pop()
                while stack[-1][0] in CLOSES_ITSELF.get(name, ()):
                    pop()
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, end)
                moved = close.end() if close else len(page)
                continue
            if attributes.endswith("/"):
                continue
            _, path, hidden, level = stack[-1]
            step, other = _step(name, attributes)
            hint = paths.hint[path]
            if name in ASIDE or (other and name not in ("html", "body", *MAIN)) or (name == "header" and hint < 1):
                hint = -1
            elif name in MAIN and not hint:
                hint = 1
            key = (path, step, hint)
            if key not in number:
                number[key] = len(paths.parent)
                paths.parent.append(path), paths.depth.append(paths.depth[path] + 1), paths.tag.append(name), paths.hint.append(hint)
            stack.append((name, number[key], hidden or name in HIDDEN, HEADINGS.get(name, level)))
            open_tags[name] += 1
    flush()
    return out, paths


def sections(blocks: list[Block], paths: Paths) -> tuple[list[int], list[int]]:
    """Per path the innermost path around it that headings stand in beside other text (0: none), and per block the section it belongs to.

    A path that holds all text of the page tells nothing, and is no section.
    """
    n = len(paths.parent)
    every, body = [0] * n, [0] * n
    for b in blocks:
        every[b.path] += 1
        body[b.path] += not b.level
    for p in range(n - 1, 0, -1):
        every[paths.parent[p]] += every[p]
        body[paths.parent[p]] += body[p]
    up, has = [0] * n, [False] * n  # up: the nearest path above, or itself, that holds other text than headings
    for p in range(1, n):
        up[p] = p if body[p] and every[p] < every[0] else up[paths.parent[p]]
    of = [0] * len(blocks)
    for i, b in enumerate(blocks):
        if b.level:
            p = b.path
            while paths.tag[p] not in HEADINGS:
                p = paths.parent[p]
            of[i] = up[paths.parent[p]]
            has[of[i]] = True
    around = [0] * n
    for p in range(1, n):
        around[p] = p if has[p] else around[paths.parent[p]]
    for i, b in enumerate(blocks):
        if not b.level:
            of[i] = around[b.path]
    return around, of


def ratios(blocks: list[Block], paths: Paths, hints: bool = True) -> np.ndarray:
    """The fused ratio of each block that isn't a heading, relative to the page's best one; 0 for headings."""
    around, of = sections(blocks, paths)
    text, marks = Counter(), Counter()
    head_text, head_marks = Counter(), Counter()
    for b, s in zip(blocks, of):
        size, n = len(b.text) - 2 * b.link, len(PUNCTUATION.findall(b.text))
        if b.level:
            if s:
                head_text[s] += HEADING * max(0, size)
                head_marks[s] += HEADING * (n + 1)
        else:
            text[b.path] += size
            marks[b.path] += n
    body = [i for i, b in enumerate(blocks) if not b.level]
    score = np.zeros(len(blocks))
    if not body:
        return score
    at = [blocks[i].path for i in body]
    x = np.array([max(0, text[p]) + head_text[around[p]] for p in at], float)
    m = np.array([marks[p] + 1 + head_marks[around[p]] for p in at], float)
    total, smooth_x, smooth_m = np.ones(len(at)), x.copy(), m.copy()
    for k in range(1, RADIUS + 1):
        g = float(np.exp(-(k**2) / (2 * SIGMA**2)))
        w = np.array([g * (0.0 if (d := paths.distance(a, b)) >= FAR else 4.0**-d) for a, b in zip(at, at[k:])])
        if len(w):
            total[:-k] += w
            total[k:] += w
            smooth_x[:-k] += w * x[k:]
            smooth_x[k:] += w * x[:-k]
            smooth_m[:-k] += w * m[k:]
            smooth_m[k:] += w * m[:-k]
    fused = np.sqrt(smooth_x / total * (smooth_m / total))
    fused[[text[p] <= 0 for p in at]] = 0.0  # links for the greater part
    measure = np.ones(len(at), bool)
    if hints:
        hint = np.array([paths.hint[p] for p in at])
        fused *= np.choose(hint + 1, (ASIDE_WEIGHT, 1.0, MAIN_WEIGHT))
        measure = hint >= 0  # a part that is named as another one is never the measure
    top = fused[measure].max(initial=0.0)
    score[body] = fused / top if top > 0 else 0.0
    return score


def content(blocks: list[Block], paths: Paths, hints: bool = True) -> list[Block]:
    """The blocks at content paths, with the headings of sections that hold some."""
    _, of = sections(blocks, paths)
    with_body = {s for b, s in zip(blocks, of) if not b.level}
    # a page of headings alone: they are its text
    if not any(not b.level for b in blocks):
        return [b for b in blocks if not hints or paths.hint[b.path] >= 0]
    best: dict[int, float] = {}
    for b, s in zip(blocks, ratios(blocks, paths, hints)):
        if not b.level:
            best[b.path] = max(best.get(b.path, 0.0), float(s))
    chosen = {p for p, s in best.items() if s >= THRESHOLD}
    live = {s for b, s in zip(blocks, of) if not b.level and b.path in chosen}
    keep = [b.path in chosen if not b.level else s in live or s not in with_body for b, s in zip(blocks, of)]
    # a heading goes if text stands below it, up to the next heading of its section and level, and none of that stays
    below: dict[int, list] = {}
    for i in range(len(blocks) - 1, -1, -1):
        b, s = blocks[i], of[i]
        if not b.level:
            seen = below.setdefault(s, [])
            if not seen or seen[-1][0]:
                seen.append([0, False, False])
            seen[-1][1] = True
            seen[-1][2] = seen[-1][2] or keep[i]
        else:
            seen = below.setdefault(s, [])
            text = stays = False
            while seen and (seen[-1][0] == 0 or seen[-1][0] > b.level):
                _, t, k = seen.pop()
                text, stays = text or t, stays or k
            if text and not stays or (hints and paths.hint[b.path] < 0):
                keep[i] = False
            seen.append([b.level, text, stays])
    return [b for b, k in zip(blocks, keep) if k]


def extract(page: str | None, hints: bool = True) -> str:
    """The page's main text; without ``hints`` the ratios decide alone."""
    return "\n\n".join(b.text for b in content(*blocks_of(page or ""), hints))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x) for x in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars; pages are read where they are, with no shuffle."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")


def op4_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
