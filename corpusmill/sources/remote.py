"""Remote services behind an injected transport: paged scans, key lookups, counts, id lists, probes and downloads.

A transport is a picklable function from a request (dict) to a response (dict); tests give one
that reads fixtures. Nothing here opens a connection by itself. How often a request is repeated,
how long to wait and how far apart requests are is a :class:`Policy`; every task has a limiter of
its own, so the rate of a job is that of a task times the tasks that run at once.

What fails for good is told: a scan raises, a lookup gives a row with an error for each key, and
a list of ids is whole or null.
"""

from __future__ import annotations

import random
import time
import urllib.parse
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Transport = Callable[[dict], dict]
RETRYABLE = (408, 429, 500, 502, 503, 504)


@dataclass(frozen=True)
class Policy:
    """Attempts, seconds before the first repeat (doubling up to ``most``), seconds between requests, and the clock."""

    attempts: int = 3
    base: float = 2.0
    most: float = 90.0
    spacing: float = 0.0
    jitter: Callable[[], float] = random.random
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic

    def delay(self, attempt: int, response: Mapping) -> float:
        """What the service asks for, else a doubling delay; jitter is added to both."""
        asked = response.get("retry_after")
        return (float(asked) if asked is not None else min(self.most, self.base * 2**attempt)) + self.jitter()


@dataclass
class Limiter:
    """Keeps requests at least ``policy.spacing`` seconds apart."""

    policy: Policy
    last: float | None = field(default=None)

    def wait(self) -> None:
        if self.policy.spacing > 0:
            if self.last is not None and (rest := self.last + self.policy.spacing - self.policy.clock()) > 0:
                self.policy.sleep(rest)
            self.last = self.policy.clock()


class RequestFailed(Exception):
    """A request that failed for good."""

    def __init__(self, status: int):
        super().__init__(f"http_{status}")
        self.status = status


def rewritten(url: str, **params: str) -> str:
    """The address with parameters set; blank ones are dropped."""
    p = urllib.parse.urlsplit(url)
    query = {k: v for k, v in urllib.parse.parse_qsl(p.query)} | params
    return urllib.parse.urlunsplit(p._replace(query=urllib.parse.urlencode(query)))


def key_list(settings: Mapping[str, str], name: str) -> list[str]:
    """Keys of a comma-separated setting, then of all settings whose names go on from it; each once, in order."""
    keys = settings.get(name, "").split(",") + [v for k, v in sorted(settings.items()) if k.startswith(name.rstrip("S")) and k != name]
    return list(dict.fromkeys(k.strip() for k in keys if k.strip()))


def rotated(transport: Transport, keys: Sequence[str], param: str = "key") -> Transport:
    """A transport that gives each request the next of the keys, in turn."""
    turn = [0]

    def send(request: dict) -> dict:
        if not keys:
            return transport(request)
        turn[0] += 1
        return transport(request | {param: keys[(turn[0] - 1) % len(keys)]})

    return send


def with_retries(transport: Transport, request: dict, policy: Policy = Policy(), limiter: Limiter | None = None) -> dict:
    """The response, after repeats for statuses that may pass; the last one if none did."""
    response = {"status": 0}
    for k in range(policy.attempts):
        if limiter is not None:
            limiter.wait()
        response = transport(request)
        if response.get("status", 200) not in RETRYABLE:
            return response
        if k + 1 < policy.attempts:
            policy.sleep(policy.delay(k, response))
    return response


def fetched(transport: Transport, request: dict, policy: Policy = Policy(), limiter: Limiter | None = None) -> dict:
    """The response of a request that succeeded; any other status raises."""
    response = with_retries(transport, request, policy, limiter)
    if response.get("status", 200) != 200:
        raise RequestFailed(response["status"])
    return response


def paged(transport: Transport, request: dict, most: int | None = None, policy: Policy = Policy(), limiter: Limiter | None = None) -> Iterator[dict]:
    """Rows of all pages of a cursor scan, at most ``most``; raises if a page fails for good."""
    cursor, n = "*", 0
    while cursor:
        page = fetched(transport, request | {"cursor": cursor}, policy, limiter)
        for row in page.get("results", []):
            if most is not None and n >= most:
                return
            yield row
            n += 1
        cursor = page.get("next_cursor") if page.get("results") else None


def lookup(keys: DataFrame, key: str, transport: Transport, schema: str, batch: int = 50, policy: Policy = Policy(), known: DataFrame | None = None) -> DataFrame:
    """Records by key, ``batch`` keys a request: the columns of ``schema`` (with the key under ``key``) and ``error``.

    Every key has a row: a key that the service doesn't have is ``not_found``, keys of a failed
    request carry its error. ``known`` (results of earlier runs) is not asked again, except for
    keys that failed then.
    """
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiter = Limiter(policy)
        for frame in frames:
            ids = frame[key].tolist()
            for lo in range(0, len(ids), batch):
                part, error, got = ids[lo : lo + batch], "not_found", []
                try:
                    got = fetched(transport, {"keys": part}, policy, limiter).get("results", [])
                except RequestFailed as e:
                    error = str(e)
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                have = {r.get(key) for r in got}
                rows = [{n: r.get(n) for n in names} | {"error": None} for r in got]
                rows += [{n: None for n in names} | {key: k, "error": error} for k in part if k not in have]
                yield pd.DataFrame(rows, columns=[*names, "error"])

    asked = keys.select(key).where(F.col(key).isNotNull()).distinct()
    if known is None:
        return asked.mapInPandas(run, f"{schema}, error string")
    sure = known.where("error is null or error = 'not_found'")
    new = asked.join(sure.select(key), key, "left_anti").mapInPandas(run, f"{schema}, error string")
    return sure.join(asked, key, "left_semi").select(*names, "error").unionByName(new)


def _per_url(urls: DataFrame, read: Callable[[dict, Limiter], tuple], schema: str, policy: Policy) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiter = Limiter(policy)
        for frame in frames:
            rows = []
            for url in frame["url"]:
                try:
                    rows.append((url, read({"url": url}, limiter), None))
                except RequestFailed as e:
                    rows.append((url, None, str(e)))
                except Exception as e:
                    rows.append((url, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["url", "value", "error"])

    return urls.mapInPandas(run, f"url string, value {schema}, error string")


def annotate(df: DataFrame, key: str, urls: str, transport: Transport, what: str = "count", policy: Policy = Policy()) -> DataFrame:
    """(key, values, errors) aligned with the addresses: counts, or id lists of all pages.

    Equal addresses are asked once. An id list is whole or null.
    """

    def count(request: dict, limiter: Limiter) -> int:
        return fetched(transport, {"url": rewritten(request["url"], **{"per-page": "1"})}, policy, limiter)["count"]

    def ids(request: dict, limiter: Limiter) -> list:
        return [r["id"] for r in paged(transport, {"url": rewritten(request["url"], select="id")}, None, policy, limiter)]

    flat = df.select(key, F.posexplode(urls).alias("pos", "url"))
    asked = flat.select("url").where("trim(url) != ''").distinct()
    got = _per_url(asked, count if what == "count" else ids, "bigint" if what == "count" else "array<string>", policy)
    rows = flat.join(got, "url", "left").withColumn("error", F.when(F.trim("url") == "", "blank_url").otherwise(F.col("error")))
    item = F.array_sort(F.collect_list(F.struct("pos", "value", "error")))
    out = rows.groupBy(key).agg(item.alias("_x"))
    return out.select(key, F.transform("_x", lambda x: x["value"]).alias("values"), F.transform("_x", lambda x: x["error"]).alias("errors"))


def should_probe(url: Column, count: Column, error: Column, only_errors: bool = False, zeros: bool = True) -> Column:
    """Whether an address needs a probe: it is blank, had an error, or counted nothing."""
    blank, failed = F.coalesce(F.trim(url) == "", F.lit(True)), F.coalesce(error != "", F.lit(False))
    nothing = F.coalesce(count == 0, F.lit(False)) & F.lit(zeros and not only_errors)
    return blank | failed | nothing


def probe(urls: DataFrame, transport: Transport, most: int = 500) -> DataFrame:
    """(url, status, error, message): what the service says about an address, asked once."""

    def one(url: str | None) -> tuple:
        if not (url or "").strip():
            return (url, 0, "empty_url", None)
        try:
            r = transport({"url": url})
        except Exception as e:
            return (url, 0, "request_exception", str(e))
        status = r.get("status", 200)
        if status == 200:
            return (url, 200, None, None)
        error = r.get("error") or r.get("message") or f"http_{status}"
        return (url, status, error, r.get("message") or r.get("detail") or str(r.get("text", ""))[:most])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([one(u) for u in frame["url"]], columns=["url", "status", "error", "message"])

    return urls.select("url").distinct().mapInPandas(run, "url string, status int, error string, message string")


def download(records: DataFrame, key: str, candidates: str, transport: Transport, policy: Policy = Policy()) -> DataFrame:
    """(key, status, url, tried, content): the first of a record's candidate addresses that gives a PDF file.

    ``status`` is ``downloaded``, ``no_url``, or what the last candidate said: ``http_<status>``,
    ``not_pdf`` or ``error``. The table without its content is the manifest.
    """

    def one(urls: Sequence[str], limiter: Limiter) -> tuple:
        status, url, tried = "no_url", None, 0
        for url in [u for u in urls if (u or "").strip()]:
            tried += 1
            try:
                r = fetched(transport, {"url": url}, policy, limiter)
            except RequestFailed as e:
                status = str(e)
                continue
            except Exception:
                status = "error"
                continue
            body = r.get("content") or b""
            if body[:1024].lstrip().startswith(b"%PDF"):
                return ("downloaded", url, tried, body)
            status = "not_pdf"
        return (status, url, tried, None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiter = Limiter(policy)
        for frame in frames:
            for k, urls in zip(frame[key], frame[candidates]):  # one file at a time is held
                yield pd.DataFrame([(k, *one(() if urls is None else urls, limiter))], columns=[key, "status", "url", "tried", "content"])

    kind = records.schema[key].dataType.simpleString()
    return records.select(key, candidates).mapInPandas(run, f"{key} {kind}, status string, url string, tried int, content binary")
