"""Substring dedup: Rabin-Karp hashes of every fixed-length window of words, counted in Spark.

A window is ``WINDOW`` consecutive words of one document. It is repeated if the same
word sequence also starts anywhere else; every word under a repeated window goes.

Every window is hashed. Its anchor is the run of ``ANCHOR`` words in it with the least hash (the
first one on a tie): equal windows have equal anchors. Consecutive windows with the same anchor
occurrence, ``WINDOW - ANCHOR + 1`` at most, form a segment, whose hash is made of its windows'
hashes; a segment that is counted k times counts each of its windows k times. So:

1. anchors are counted. Windows of an anchor that occurs once are unique, and go no further.
2. segments of the others are counted by (anchor, segment): windows of a segment that occurs twice
   are repeated. Within a segment no two windows are equal.
3. of anchors with several different segments one occurrence of each is written out window by
   window, and windows are counted by (anchor, hash); around the edits of near copies and the ends
   of shared passages this finds what segments as a whole don't tell.
4. repeated windows of each document are merged into maximal intervals and cut out.

Hashes are 128 bits together (anchor and segment, or anchor and window), independent of the
position. All counts are combined on the map side, and groups are counts and bit masks, so neither
a passage that a third of all documents share nor an anchor with as many different surroundings
is one task's. Texts are read four times: for their segments, those with segments to write out once
more, and at the end those without and those with repeated windows apart; the segments are written
once, to the shared folder.

Edge cases: a null text has no words; documents shorter than a window lose nothing;
repeated rows repeat each other's windows and lose them all, also if they have the same
id; null ids are documents like others; very long documents are cut into overlapping
blocks of ``BLOCK`` words, which changes segments but no result; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BitFilter, cut, quoted, stored, table, text_or_empty
from .words import BASE, Powers, Rolling, U, WordHashes, mix, split, utf8, window_min

WINDOW, ANCHOR, BLOCK = 35, 20, 1 << 18
#: Documents whose segments are held at once.
CHUNK = 1000
#: A segment is hot from this many occurrences, and from a thousandth of all; an anchor, by its different segments: at most 1,000 of each exist.
HOT_ROWS, HOT_SHARE = 1000, 1000
_LOW = U((1 << 20) - 1)


def segments_of(hashes: np.ndarray, powers: Powers, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Anchor hash, segment hash, first window and number of windows of each segment of a document, and the hashes of all its windows."""
    parts = []
    for at in range(0, max(1, len(hashes) - window + 1), BLOCK):
        block = hashes[at : at + BLOCK + window - 1]
        if len(block) < window:
            break
        rolling = Rolling(block, powers)
        h, every = rolling.every(anchor), rolling.every(window)
        rank = (h & ~_LOW) | np.arange(len(h), dtype=U)  # by hash, then by position
        where = (window_min(rank, window - anchor + 1) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        n = np.diff(np.append(first, len(where)))
        place = (np.arange(len(every)) - np.repeat(first, n)).astype(U)
        parts.append((h[where[first]], mix(np.add.reduceat(mix(every + place * U(BASE)), first) + n.astype(U)), first + at, n, every))
    if not parts:
        return (np.empty(0, U), np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _segments(window: int, anchor: int):
    """Every segment (doc_id, row, anchor, segment, first, n) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, powers = WordHashes(), Powers()
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                found = [segments_of(cache.of(split(text)), powers, window, anchor)[:4] for text in utf8(part["text"])]
                at = pa.array(np.repeat(np.arange(part.num_rows), [len(f[0]) for f in found]))
                a, s, first, n = (np.concatenate([f[k] for f in found]) for k in range(4))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"].take(at), part["row"].take(at), pa.array(a.view(np.int64)), pa.array(s.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["doc_id", "row", "anchor", "segment", "first", "n"],
                )

    return run


def _chosen(may: BitFilter, key: str):
    """Rows whose key may be in the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may(batch[key].to_numpy())))

    return run


def _pair(anchor: np.ndarray, segment: np.ndarray) -> np.ndarray:
    return anchor * U(3) ^ segment


def _windows(window: int, anchor: int, may: BitFilter, rows: BitFilter):
    """Windows (anchor, segment, offset, hash) of the segments to write out, from the texts that have some.

    What a filter lets through besides is another occurrence of a segment, or one whose anchor is
    unique: it changes no window from once to several times that isn't there several times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, powers = WordHashes(), Powers()
        for batch in batches:
            batch = batch.filter(pa.array(rows(batch["row"].to_numpy())))
            for lo in range(0, batch.num_rows, CHUNK):
                part, out = batch.slice(lo, CHUNK), []
                for text, row in zip(utf8(part["text"]), part["row"].to_numpy().view(U)):
                    a, s, first, n, every = segments_of(cache.of(split(text)), powers, window, anchor)
                    some = np.flatnonzero(may((_pair(a, s) ^ row).view(np.int64)))
                    if len(some):
                        a, s, first, n = a[some], s[some], first[some], n[some]
                        offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                        out.append((np.repeat(a, n).view(np.int64), np.repeat(s, n).view(np.int64), offset.astype(np.int32), every[np.repeat(first, n) + offset].view(np.int64)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["anchor", "segment", "offset", "hash"])

    return run


def _may_be_marked(may: BitFilter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, s = (batch[c].to_numpy().view(U) for c in ("anchor", "segment"))
            yield batch.filter(pa.array(may(_pair(a, s).view(np.int64))))

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of segments, with the row where there is one."""
    for batch in batches:
        a, s = (batch[c].to_numpy().view(U) for c in ("anchor", "segment"))
        key = _pair(a, s)
        if "row" in batch.schema.names:
            key = key ^ batch["row"].to_numpy().view(U)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["pair"])


def _maybe(may: BitFilter):
    """Rows that may have repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                yield part.filter(pa.array(may(part["row"].to_numpy())))

    return run


def kept_mask(n_words: int, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """False for words under a repeated window; the union of the windows is the maximal intervals."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n_words), -1)
    return np.cumsum(edge)[:-1] == 0


def _starts(marks) -> np.ndarray:
    """First words of the repeated windows: of each segment those whose bits are set."""
    if not marks:
        return np.empty(0, np.int64)
    first = np.array([m["first"] for m in marks], np.int64)
    mask = np.array([m["mask"] for m in marks], np.int64).view(U)
    bit = np.arange(64, dtype=U)
    at, offset = np.nonzero((mask[:, None] >> bit) & U(1))
    return np.unique(first[at] + offset)


def _cut_out(window: int, cut_elsewhere: BitFilter | None = None):
    """Results of texts with their ``marks``, or, without such a column, of those that have none.

    The latter are the rows that the filter doesn't let through; they come straight from the table, so
    that no task of this operator feeds one Python worker from another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                if cut_elsewhere is not None:
                    part = part.filter(pa.array(~cut_elsewhere(part["row"].to_numpy())))
                n_words, removed, texts, spans = [], [], [], []
                marked = part["marks"].to_pylist() if "marks" in part.schema.names else [None] * part.num_rows
                for text, marks in zip(utf8(part["text"]), marked):
                    words = split(text)
                    keep = kept_mask(len(words), _starts(marks), window)
                    edges = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]]).astype(np.int8)))
                    n_words.append(len(words))
                    removed.append(int((~keep).sum()))
                    texts.append(b" ".join(words if keep.all() else [w for w, k in zip(words, keep.tolist()) if k]))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    ["doc_id", "n_words", "n_removed", "kept", "removed"],
                )

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (text) and removed (word intervals)."""
    if not 0 <= window - anchor < 63:
        raise ValueError("a segment has at most 63 windows")
    source = docs.select(F.col(quoted(id_col)).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    texts = source.withColumn("row", F.xxhash64("text"))  # equal rows share id and hash, and a result
    every = f"doc_id {kind}, row long, anchor long, segment long, first int, n int"
    segments = stored(texts.mapInArrow(_segments(window, anchor), every))

    again = cut(segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("anchor"))
    known = segments.mapInArrow(_chosen(BitFilter.build(again, "anchor", again.count()), "anchor"), every)
    groups = cut(known.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("times"), F.min("row").alias("row"), F.max("n").alias("n")))
    several = cut(groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    total, count, kinds = (groups.agg(F.sum("times")).first()[0] or 0), several.count(), groups.count()
    some = groups.select("anchor", "segment", "row").mapInArrow(_chosen(BitFilter.build(several, "anchor", count), "anchor"), "anchor long, segment long, row long")
    hot = F.col("kinds") >= max(HOT_ROWS, kinds // HOT_SHARE)
    first = some.join(F.broadcast(several.where(hot)), "anchor", "left")
    several = cut(first.where("kinds is not null").drop("kinds").unionByName(first.where("kinds is null").drop("kinds").join(several.where(~hot), "anchor", "left_semi")))
    n = several.count()
    expand = _windows(window, anchor, BitFilter.build(several.mapInArrow(_pairs, "pair long"), "pair", n), BitFilter.build(several.select("row"), "row", n))
    expanded = cut(texts.select("row", "text").mapInArrow(expand, "anchor long, segment long, offset int, hash long").distinct())
    twice = expanded.groupBy("anchor", "hash").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    partly = expanded.join(twice, ["anchor", "hash"], "left_semi").groupBy("anchor", "segment").agg(F.expr("bit_or(shiftleft(1L, offset))").alias("some"))

    whole = F.when(F.col("times") > 1, F.expr("shiftleft(1L, n) - 1"))
    marked = groups.join(partly, ["anchor", "segment"], "left").select("anchor", "segment", "times", F.coalesce(whole, "some").alias("mask")).where("mask is not null")
    marked = cut(marked)
    may = BitFilter.build(marked.select("anchor", "segment").mapInArrow(_pairs, "pair long"), "pair", marked.count())
    found = segments.mapInArrow(_may_be_marked(may), every).drop("n")
    hot = F.col("times") >= max(HOT_ROWS, total // HOT_SHARE)
    first = found.join(F.broadcast(marked.where(hot)), ["anchor", "segment"], "left")
    rest = first.where("times is null").drop("times", "mask").join(marked.where(~hot), ["anchor", "segment"])
    hits = first.where("times is not null").unionByName(rest.select(*first.columns))
    marks = cut(hits.groupBy("doc_id", "row").agg(F.collect_set(F.struct("first", "mask")).alias("marks")))
    may = BitFilter.build(marks, "row", marks.count())
    known = marks.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "marks")
    maybe = texts.mapInArrow(_maybe(may), texts.schema)
    cut_docs = maybe.join(known, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left").select("doc_id", "text", "marks")
    result = f"doc_id {kind}, n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>"
    return texts.mapInArrow(_cut_out(window, may), result).unionByName(cut_docs.mapInArrow(_cut_out(window), result))


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("removed").cast("long").alias("n_intervals"))


def brute_force(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, kept_sha256) of each text, from a table of all windows; for tests."""
    words = [split((t or "").encode()) for t in texts]
    seen: dict[tuple, int] = {}
    for w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out
