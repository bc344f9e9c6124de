"""Scalar normalisers and string projections as Column -> Column."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType

WS = r"[\s\u0085   -     　\x1C-\x1F]"  # Unicode white space, as Python's \s
NOT_WORD = r"[^\p{L}\p{N}_\s]"

#: Words that carry no identity in a title.
TITLE_STOPWORDS = (
    "a an and are as at by for from in into is of on or that the to with without via using use review systematic meta analysis"
).split()


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    """White-space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean_string(c: Column) -> Column:
    return blank_to_null(strip(c))


def first_filled(*cols: Column) -> Column:
    """First column that is neither null nor empty."""
    return F.coalesce(*(blank_to_null(c) for c in cols))


def normalise_doi(c: Column) -> Column:
    """Bare lower-case DOI; prefix ``doi:`` and resolver addresses are dropped; words for missing values are null."""
    bare = F.regexp_replace(F.lower(strip(c)), r"^doi:\s*", "")
    bare = strip(F.regexp_replace(bare, r"^https?://(dx\.)?doi\.org/", ""))
    return F.when(~bare.isin("", "nan", "none"), bare)


def strip_doi_resolver(c: Column) -> Column:
    """The weak form: only the usual resolver address goes."""
    return F.regexp_replace(c, r"^https://doi\.org/", "")


def pick_doi(*cols: Column) -> Column:
    return F.coalesce(*(normalise_doi(c) for c in cols))


def work_id(c: Column) -> Column:
    """``W`` and digits at the end, any case, upper-cased; null if there is none."""
    return blank_to_null(F.upper(F.regexp_extract(strip(c), r"(?i)(W\d+)$", 1)))


def entity_id(c: Column, slash: bool = False) -> Column:
    """A capital letter and digits at the end, optionally only behind a slash."""
    return blank_to_null(F.regexp_extract(strip(c), r"/([A-Z]\d+)$" if slash else r"([A-Z]\d+)$", 1))


def after_last_slash(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def without_prefix(c: Column, prefix: str) -> Column:
    return F.when(F.startswith(c, F.lit(prefix)), F.substring(c, len(prefix) + 1, 2**31 - 1)).otherwise(c)


def title_key_compact(c: Column) -> Column:
    """Lower case, white space collapsed, punctuation deleted."""
    return F.trim(F.regexp_replace(collapse(F.lower(c)), NOT_WORD, ""))


def title_key_plain(c: Column) -> Column:
    """Lower case, white space collapsed, punctuation kept."""
    return collapse(F.lower(c))


def title_key_spaced(c: Column) -> Column:
    """Lower case, punctuation to spaces; null if nothing is left. Give it NFKC text."""
    return blank_to_null(collapse(F.regexp_replace(F.lower(c), NOT_WORD, " ")))


def ascii_words(c: Column) -> Column:
    """Lower case with everything but a-z, 0-9 and white space replaced by spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]+", " "), r"\s+", " "))


def title_tokens(c: Column, limit: int = 10, least: int = 5, stop: Sequence[str] = TITLE_STOPWORDS) -> Column:
    """The first tokens of five letters or more outside the stop list, duplicates kept."""
    words = F.filter(F.split(ascii_words(c), " "), lambda w: (F.length(w) >= least) & ~w.isin(*stop))
    return F.slice(words, 1, limit)


def join_hyphenated(c: Column) -> Column:
    """OCR text: words split by a hyphen at a line end joined, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])", "$1$2"), r"\s+", " "))


def strip_markup(c: Column) -> Column:
    """Tags, superscript marks, addresses and Markdown signs removed, in this order."""
    for pattern, to in ((r"<[^>]+>", " "), (r"\^\{\d+\}", ""), (r"https?://\S+", ""), (r"[#*_`$\[\]]", ""), (r"\s+", " ")):
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def description(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r'^"+|"+$', "")


def nonblank_lines(c: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != ""), "\n")


def image_key(c: Column) -> Column:
    return F.regexp_replace(c, r"^[./]+", "")


def plain_quotes(c: Column) -> Column:
    return F.translate(c, "“”„«»‘’", "\"\"\"\"\"''")


def plain_double_quotes(c: Column) -> Column:
    return F.translate(c, "“”„«»‹›", '"' * 7)


def ordered_distinct(c: Column) -> Column:
    return F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (x != "")))


def cleaned_names(c: Column) -> Column:
    """Stripped, non-empty, first occurrence order; null for none."""
    names = F.array_distinct(F.filter(F.transform(c, clean_string), lambda x: x.isNotNull()))
    return F.when(F.size(names) > 0, names)


def display_names(structs: Column) -> Column:
    return cleaned_names(F.transform(structs, lambda x: x["display_name"]))


def merged_tags(a: Column, b: Column, limit: int = 15) -> Column:
    """Union of two tag lists in alphabetical order, so that the cut is the same on every run."""
    empty = F.array().cast("array<string>")
    return F.slice(F.sort_array(F.array_union(F.coalesce(a, empty), F.coalesce(b, empty))), 1, limit)


@F.pandas_udf(MapType(StringType(), ArrayType(IntegerType())))
def inverted_index(words: pd.Series) -> pd.Series:
    """Positions of each word of an array, in one pass; nulls are left out."""

    def index(array) -> dict | None:
        if array is None:
            return None
        out: dict[str, list[int]] = {}
        for i, w in enumerate(array):
            if w is not None:
                out.setdefault(w, []).append(i)
        return out

    return words.map(index)


def text_of_inverted_index(index: Column, keep_gaps: bool = False) -> Column:
    """Words of ``map<word, positions>`` in order; on a collision the last word in map order stays."""
    placed = F.transform(F.map_entries(index), lambda e, k: F.transform(e["value"], lambda p: F.struct(p.cast("int").alias("p"), k.alias("k"), e["key"].alias("w"))))
    ordered = F.array_sort(F.filter(F.flatten(placed), lambda x: x["p"].isNotNull() & (x["p"] >= 0)))

    def joined(words: Column) -> Column:
        last = F.filter(words, lambda x, i: ~F.coalesce(F.get(words, i + 1)["p"] == x["p"], F.lit(False)))
        if not keep_gaps:
            return F.array_join(F.transform(last, lambda x: x["w"]), " ")
        before = lambda x, i: F.coalesce(F.get(last, i - 1)["p"], F.lit(-1))
        return F.array_join(F.transform(last, lambda x, i: F.concat(F.repeat(F.lit(" "), x["p"] - before(x, i) - 1), x["w"])), " ")

    # a one-element array binds the sorted list to a variable, so that it is computed once
    text = F.regexp_replace(F.get(F.transform(F.array(ordered), joined), F.lit(0)), r"(?i)^Abstract\s+", "")
    return F.when(text != "", text).otherwise(F.lit("") if keep_gaps else F.lit(None).cast("string"))


def simplified_authors(authorships: Column) -> Column:
    """(id, name, affiliations) of each author; affiliations are institutions, else the raw strings."""
    people = F.transform(authorships, lambda a: F.struct(
        clean_string(a["author"]["id"]).alias("id"), clean_string(a["author"]["display_name"]).alias("name"),
        F.coalesce(display_names(a["institutions"]), cleaned_names(a["raw_affiliation_strings"])).alias("affiliations"),
    ))
    kept = F.filter(people, lambda p: p["id"].isNotNull() | p["name"].isNotNull() | p["affiliations"].isNotNull())
    return F.when(F.size(kept) > 0, kept)


def first_phrase(c: Column, phrases: Sequence[str]) -> Column:
    """The first phrase of the list that the text contains, else empty."""
    return F.coalesce(*(F.when(F.contains(c, F.lit(p)), F.lit(p)) for p in phrases), F.lit(""))


def url_origin(c: Column) -> Column:
    return F.concat(F.try_parse_url(c, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(c, F.lit("AUTHORITY")), F.lit("/"))


def url_candidates(c: Column) -> Column:
    """Addresses to try for a document, in order: as it is, without query, direct and https forms."""
    bare = F.regexp_replace(c, r"\?.*$", "")
    return F.array_distinct(F.array(c, bare, F.replace(c, F.lit("/pdfdirect/"), F.lit("/pdf/")), F.regexp_replace(c, "^http://", "https://")))


def href_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))


def pdf_links(html: Column, origin: Column, head: int = 300_000) -> Column:
    """Citation links, then links to PDF files, of the first characters; root-relative ones are made absolute."""
    start = F.substring(html, 1, head)
    meta = F.regexp_extract_all(start, F.lit(r'(?is)<meta[^>]+name="citation_pdf_url"[^>]+content="([^"]+)"'), F.lit(1))
    files = F.regexp_extract_all(start, F.lit(r'(?i)href="([^"]+\.pdf(?:\?[^"]*)?)"'), F.lit(1))
    plain = F.transform(F.concat(meta, files), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    return F.array_distinct(F.transform(plain, lambda u: F.when(F.startswith(u, F.lit("/")), F.concat(F.rtrim(origin, F.lit("/")), u)).otherwise(u)))


def _urls(location: Column) -> list[Column]:
    return [clean_string(location["pdf_url"])]


def ranked_pdf_urls(best: Column, oa_url: Column, locations: Column, primary: Column) -> Column:
    """Best open location, open address, open repositories, other open, primary, the rest; distinct."""
    loc = F.coalesce(locations, F.array().cast("array<struct<pdf_url:string,landing_page_url:string,is_oa:boolean,source:struct<display_name:string,type:string>>>"))
    opened = lambda x: F.coalesce(x["is_oa"], F.lit(False))
    shelf = lambda x: F.coalesce(x["source"]["type"] == "repository", F.lit(False))
    url = lambda x: clean_string(x["pdf_url"])
    parts = [
        F.array(url(best), clean_string(oa_url)), F.transform(F.filter(loc, lambda x: opened(x) & shelf(x)), url),
        F.transform(F.filter(loc, lambda x: opened(x) & ~shelf(x)), url), F.array(url(primary)), F.transform(F.filter(loc, lambda x: ~opened(x)), url),
    ]
    return F.array_distinct(F.filter(F.flatten(F.array(*parts)), lambda u: u.isNotNull()))


def has_pdf(primary: Column, best: Column, locations: Column) -> Column:
    """Whether any location names a PDF file."""
    named = lambda x: F.coalesce(F.trim(x["pdf_url"]) != "", F.lit(False))
    return named(primary) | named(best) | F.coalesce(F.exists(locations, named), F.lit(False))


def landing_urls(primary: Column, best: Column, oa_url: Column, locations: Column) -> Column:
    all_of = F.concat(
        F.array(clean_string(primary["landing_page_url"]), clean_string(best["landing_page_url"]), clean_string(oa_url)),
        F.coalesce(F.transform(locations, lambda x: clean_string(x["landing_page_url"])), F.array().cast("array<string>")),
    )
    return F.array_distinct(F.filter(all_of, lambda u: u.isNotNull()))


def search_term(url: Column) -> Column:
    """The search parameter of an address, decoded twice."""
    return F.url_decode(F.url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("search"))))


def doi_in_url(c: Column) -> Column:
    return blank_to_null(F.rtrim(F.regexp_extract(c, r"(10\.\d{4,9}/[-._;()/:a-zA-Z0-9]+)", 1), F.lit("/")))


def without_thinking(c: Column) -> Column:
    return F.regexp_replace(c, r"(?is)<(think|analysis)>.*?</\1>", "")


def json_candidate(c: Column) -> Column:
    """From the first opening to the last closing brace; null if there is none."""
    a, b = F.locate("{", c), F.length(c) - F.locate("}", F.reverse(c)) + 1
    return F.when((a > 0) & (F.locate("}", c) > 0) & (b >= a), F.substring(c, a, b - a + 1))


def collapse_nulls(c: Column) -> Column:
    """Non-blank items; if there are none, one null; an empty list stays empty."""
    kept = F.filter(c, lambda x: clean_string(x).isNotNull())
    one = F.array(F.lit(None).cast("string"))
    return F.when(F.size(kept) > 0, kept).when(F.size(c) > 0, one).otherwise(c)


def flat_distinct(c: Column) -> Column:
    return F.array_distinct(F.flatten(F.filter(c, lambda x: x.isNotNull())))


def shard_of(c: Column) -> Column:
    """Directory of an id: W and its first digit."""
    return F.concat(F.lit("W"), F.coalesce(blank_to_null(F.regexp_extract(c, r"^W(\d)", 1)), F.lit("0")))


def repeats_token(c: Column, times: int = 4) -> Column:
    """Whether a token ``[A-Za-z0-9_]+`` stands ``times`` times in a row, whatever stands between; false for null.

    Bounds are spelt out: before Java 19 ``\\b`` sees none between a letter of ``\\w`` and an accented one.
    """
    token = "[a-z0-9_]"
    return F.coalesce(F.rlike(c, F.lit(rf"(?i)(?<!{token})({token}++)(?:[^a-z0-9_]++\1(?!{token})){{{times - 1}}}")), F.lit(False))


def lower_simple(c: Column) -> Column:
    """Lower case of one character for one, like DuckDB's: only the dotted capital I becomes two in Spark."""
    return F.lower(F.replace(c, F.lit("\u0130"), F.lit("i")))


def is_placeholder(c: Column) -> Column:
    """Only references to other lines of a search, operators and parentheses."""
    return F.rlike(c, F.lit(r"(?i)^(?:#?\d+|\bAND\b|\bOR\b|\bNOT\b|[()]|\s)+$"))


def is_pdf(content_type: Column, url: Column, head: Column) -> Column:
    """By header, by address or by its first bytes."""
    no = F.lit(False)
    return (
        F.coalesce(F.contains(F.lower(content_type), F.lit("pdf")), no)
        | F.coalesce(F.endswith(F.lower(url), F.lit(".pdf")), no)
        | F.coalesce(F.startswith(head, F.lit("%PDF")), no)
    )


def is_retryable(status: Column) -> Column:
    return status.isin(408, 429, 500, 502, 503, 504)


def identity(doi: Column, title: Column, header: Column, body: Column) -> Column:
    """(ok, reason): whether a file is the work: DOI in header or address, DOI in text, else enough title tokens."""
    tokens = title_tokens(title)
    n, plain = F.size(tokens), ascii_words(body)
    need = F.least(F.lit(4), F.greatest(F.lit(2), F.floor(n / 2))).cast("int")
    hits = F.size(F.filter(tokens, lambda t: F.contains(plain, t)))
    spellings = F.array(doi, F.concat(F.lit("doi:"), doi), F.concat(F.lit("https://doi.org/"), doi), F.url_encode(doi))
    in_body = F.exists(spellings, lambda s: F.contains(F.lower(body), F.lower(s)))
    no = F.lit(False)
    reason = (
        F.when(F.coalesce(F.contains(F.lower(header), doi), no), "doi_header").when(F.coalesce(in_body, no), "doi_text")
        .when(doi.isNotNull(), "doi_missing").when((n > 0) & (hits >= need), "title").otherwise("no_match")
    )
    return F.struct(reason.isin("doi_header", "doi_text", "title").alias("ok"), reason.alias("reason"))


def retry_delay(attempt: Column, jitter: Column, most: float = 90.0) -> Column:
    """Seconds before a repeated request: doubling from two, bounded, plus jitter."""
    return F.least(F.lit(most), F.lit(2.0) * F.pow(F.lit(2.0), attempt - 1)) + jitter


def tiles(width: Column, height: Column, size: int, overlap: int) -> Column:
    """Corners of overlapping tiles over an image, row by row."""
    step = max(1, size - overlap)
    xs, ys = (F.sequence(F.lit(0), F.greatest(F.lit(0), x - overlap - 1), F.lit(step)) for x in (width, height))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y")))))
