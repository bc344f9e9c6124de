"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join.

The list holds rules (with a verdict), listed sites and listed pages (which mean block).
A rule or a site is a host, optionally followed by a path that starts with ``/``. It fits
its host and all subdomains, if the path of the URL starts with the entry's path. A page is
a URL, and fits the URLs that have the same canonical form (:func:`canonical`).

1. Every entry sets eight bits, one per 64-bit lane, in one 512-bit block; hosts
   are entered too, so that most URLs are done after a probe per host suffix (of at
   most as many labels as the longest listed host has) and one of the canonical URL.
   Blocks are combined in Spark; there are at most ``MAX_BLOCKS`` of them (8 MB),
   so what is sent to the workers is bounded whatever the list's size.
2. URLs without a possible hit go straight to the output.
3. Possible hits are joined exactly with the list, which removes false positives;
   the list is broadcast only up to ``BROADCAST_ENTRIES`` entries, and is joined by
   a shuffle, whose skewed hosts Spark can split, beyond that.

The longest fitting rule wins; of equally long ones that with the longer host, then
block. A URL without a rule is blocked if a listed URL fits, else allowed.

Canonical form: no scheme, user or fragment; host in lower case without a dot at its end;
no default port (80 of http, 443 of https); ``.`` and ``..`` segments resolved; ``/`` for an
empty path; escapes of unreserved characters decoded, others in upper case; parameters as
they are, an empty query dropped.

Edge cases: a null URL or one without ``://`` has an empty host and path and is
allowed; repeated rows give repeated results; empty entries are ignored; an empty
list allows everything; columns other than the id and the URL are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, quoted, table

LANES, MAX_BLOCKS, KEYS_PER_BLOCK = 8, 1 << 17, 32
BROADCAST_ENTRIES = 100_000
#: Odd multipliers, one per lane, that turn a hash into the lane's bit.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
UTF8_SEED = 42  # the seed of Spark's xxhash64


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


#: The host under which pages are entered; no URL has it, as it holds a slash.
PAGE = "/page"


def entries_of(rules: DataFrame, listed: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """``rules`` (rule, verdict), ``listed`` sites and ``pages`` (url) as (e_host, e_path, rule, verdict); listed ones have no verdict."""
    both = rules.select(F.col("rule").cast("string"), F.col("verdict").cast("string"))
    if listed is not None:
        both = both.unionByName(listed.select(F.col("url").cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")))
    entries = (
        both.where("coalesce(rule, '') != ''").distinct()
        .select(
            F.translate(F.substring_index("rule", "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("e_host"),
            F.expr("case when instr(rule, '/') > 0 then substr(rule, instr(rule, '/')) else '' end").alias("e_path"),
            "rule", "verdict",
        )
    )
    if pages is not None:
        urls = pages.select(F.col("url").cast("string").alias("url")).mapInArrow(_canonical, "rule string").where("rule is not null").distinct()
        entries = entries.unionByName(urls.select(F.lit(PAGE).alias("e_host"), F.col("rule").alias("e_path"), "rule", F.lit(None).cast("string").alias("verdict")))
    return entries


def _block_key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


_UNRESERVED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
_ESCAPE = re.compile("%([0-9a-fA-F]{2})")


def _unescape(m: re.Match) -> str:
    char = chr(int(m[1], 16))
    return char if char in _UNRESERVED else m[0].upper()


def canonical(url: str | None) -> str | None:
    """The canonical form of a URL; null where it has no ``://``."""
    scheme, found, rest = (url or "").partition("://")
    if not found:
        return None
    rest = rest.partition("#")[0]
    end = next((i for i, c in enumerate(rest) if c in "/?"), len(rest))
    host, (path, _, query) = rest[:end].rpartition("@")[2].lower(), rest[end:].partition("?")
    port = {"http": ":80", "https": ":443"}.get(scheme.strip().lower())
    if port and host.endswith(port):
        host = host[: -len(port)]
    steps: list[str] = []
    parts = _ESCAPE.sub(_unescape, path).split("/")[1:] or [""]
    for i, part in enumerate(parts):
        if part == "..":
            del steps[-1:]
        if part not in (".", ".."):
            steps.append(part)
        elif i == len(parts) - 1:
            steps.append("")
    return f"{host.rstrip('.')}/{'/'.join(steps)}" + (f"?{_ESCAPE.sub(_unescape, query)}" if query else "")


def _canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([canonical(u) for u in batch["url"].to_pylist()], pa.string())], ["rule"])


class BlockedBloom:
    """Eight lanes of 64 bits per block; a key sets and tests one bit of each lane."""

    def __init__(self, blocks: np.ndarray):
        self.blocks = blocks  # uint64, (blocks, LANES)

    @staticmethod
    def build(keys: DataFrame, count: int) -> BlockedBloom:
        """From a column ``key``; the bits are combined in Spark, a row per block reaches the driver."""
        n = min(MAX_BLOCKS, max(1, 1 << (max(count, 1) // KEYS_PER_BLOCK).bit_length()))
        h = keys.select(F.xxhash64("key").alias("h"))
        bits = [
            F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned((h & 2147483647L) * {salt}L, 26) & 63L as int)))").alias(f"w{i}")
            for i, salt in enumerate(SALTS)
        ]
        rows = h.groupBy(F.expr(f"shiftrightunsigned(h, 32) & {n - 1}L").alias("b")).agg(*bits).toArrow()
        blocks = np.zeros((n, LANES), np.uint64)
        for i in range(LANES):
            blocks[rows["b"].to_numpy(), i] = rows[f"w{i}"].to_numpy().astype(np.int64).view(np.uint64)
        return BlockedBloom(blocks)

    def may_contain(self, keys: list[bytes]) -> np.ndarray:
        h = np.fromiter((xxhash.xxh64_intdigest(k, UTF8_SEED) for k in keys), np.uint64, len(keys))
        block = self.blocks[(h >> np.uint64(32)) & np.uint64(len(self.blocks) - 1)]
        low = (h & np.uint64(0x7FFFFFFF))[:, None] * np.array(SALTS, np.uint64)[None, :]
        bit = (low >> np.uint64(26)) & np.uint64(63)
        return ((block >> bit) & np.uint64(1)).all(axis=1)


def _suffixes(host: str, labels: int) -> list[str]:
    """A host's ends of at most so many labels."""
    parts = host.rsplit(".", labels)[-labels:] if labels else []
    return [".".join(parts[i:]) for i in range(len(parts))]


def _probe(bloom: BlockedBloom, lengths: list[int], labels: int, with_pages: bool):
    """Replaces ``url`` by ``hits``: the entries' keys that the URL may fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch["host"].to_pylist(), batch["path"].to_pylist()
            at, keys = [], []
            for i, host in enumerate(hosts):
                for suffix in _suffixes(host, labels):
                    at.append((i, suffix))
                    keys.append(suffix.encode("utf-8", "surrogatepass"))
            found = bloom.may_contain(keys) if keys else []
            at = [x for x, ok in zip(at, found) if ok]
            tried = [(i, f"{s}\n{paths[i][:n]}") for i, s in at for n in lengths if n <= len(paths[i])]
            if with_pages:
                tried += [(i, f"{PAGE}\n{c}") for i, u in enumerate(batch["url"].to_pylist()) if (c := canonical(u)) is not None]
            found = bloom.may_contain([k.encode("utf-8", "surrogatepass") for _, k in tried]) if tried else []
            hits: list[list[str]] = [[] for _ in hosts]
            for (i, key), ok in zip(tried, found):
                if ok:
                    hits[i].append(key)
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["host"], batch["path"], pa.array(hits, pa.list_(pa.string()))], ["page_id", "host", "path", "hits"])

    return run


def url_filter(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", listed_pages: DataFrame | None = None) -> DataFrame:
    """Judge every URL: page_id, host, path, rule, verdict, listed (boolean)."""
    entries = cut(entries_of(rules, listed, listed_pages))
    count = entries.count()
    sites = entries.where(F.col("e_host") != PAGE)
    lengths = sorted(r[0] for r in sites.select(F.char_length("e_path")).distinct().collect())  # at most the longest path
    labels = sites.agg(F.max(F.size(F.split("e_host", "[.]")))).first()[0] or 0
    keys = entries.select(F.col("e_host").alias("key")).unionByName(entries.select(_block_key(F.col("e_host"), F.col("e_path")).alias("key")))
    bloom = BlockedBloom.build(keys.distinct(), 2 * count)

    url = F.col(quoted(url_col)).cast("string")
    rows = pages.select(F.col(quoted(id_col)).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), url.alias("url"))
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, host string, path string, hits array<string>"
    probed = rows.mapInArrow(_probe(bloom, lengths, labels, listed_pages is not None), schema)
    verdict = F.coalesce("verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    none = F.lit(None).cast("string")
    clear = probed.where("size(hits) = 0").select("page_id", "host", "path", none.alias("rule"), F.lit("allow").alias("verdict"), F.lit(False).alias("listed"))

    maybe = probed.where("size(hits) > 0").withColumn("_row", F.monotonically_increasing_id()).select("*", F.explode("hits").alias("_key"))
    known = entries.select(
        _block_key(F.col("e_host"), F.col("e_path")).alias("_key"),
        F.struct((F.char_length("e_host") + F.char_length("e_path")).alias("n"), F.char_length("e_host").alias("h"), "verdict", "rule").alias("_entry"),
    )
    known = F.broadcast(known) if count <= BROADCAST_ENTRIES else known
    judged = (
        maybe.join(known, "_key", "left").groupBy("_row")
        .agg(
            F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"),
            F.max(F.when(F.col("_entry.verdict").isNotNull(), F.col("_entry"))).alias("_best"),
            F.coalesce(F.expr("bool_or(_entry.rule is not null and _entry.verdict is null)"), F.lit(False)).alias("listed"),
        )
        .select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("verdict"), "listed")
        .withColumn("verdict", verdict)
    )
    return clear.unionByName(judged)


#: The rules of the contract.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Names of sites that are listed under each of the example domains.
LISTED_SITES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED = [f"{site}.example.{top}" for site in LISTED_SITES for top in ("com", "net", "org")]


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    listed = spark.createDataFrame([(x,) for x in LISTED], "url string")
    return url_filter(table(spark, sf_dir, "pages"), rules, listed)


ORACLE = r"""
WITH u AS (
  SELECT page_id, url,
         CASE WHEN position('://' IN url) > 0 THEN regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*') ELSE '' END AS h,
         CASE WHEN position('://' IN url) > 0 THEN regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
p AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r(rule, rh, rp, v) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
s(site) AS (VALUES %s),
l AS (SELECT site || '.example.' || top AS lh FROM s, (VALUES ('com'), ('net'), ('org')) t(top)),
best AS (
  SELECT p.page_id, p.host, p.path, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v
  FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY p.page_id, p.host, p.path),
j AS (SELECT best.*, EXISTS (SELECT 1 FROM l WHERE host = lh OR ends_with(host, '.' || lh)) AS listed FROM best)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM j
""" % ", ".join(f"('{x}')" for x in LISTED_SITES)
