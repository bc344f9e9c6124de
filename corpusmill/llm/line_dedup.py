"""Line dedup by all runs of ``MIN_LINES`` lines, grouped by their bytes.

A passage of two lines or more that repeats is a chain of repeated windows of two lines, wherever
it begins and ends and whatever stands around it. So every window of every text is compared: one
that occurs several times in the corpus stays where it occurs first (least id, then position),
and its lines are removed everywhere else. A line goes if any window it is in goes; the first
occurrence of each line in the corpus always stays, but a passage may be left in parts, each where
it occurs first, and of one line many times in a row one is left.

Windows are grouped by a hash, and by their bytes: hashes only choose what to look at, and
equal windows are equal byte by byte. Both groupings combine on the map side first, so a window
that a third of all documents hold costs one row per task. Only windows whose hash repeats
bring their bytes to the second one.

What is removed is also told in content-defined chunks, those of two lines or more of which no
line is left: a rolling hash over the hashes of the last ``SPAN`` lines ends a chunk where it is
divisible by ``EVERY``, so boundaries depend on the lines around them alone.

Lines end at ``\\n``. Lines without anything but white space count towards no window's lines and
end no chunk, but those between a window's lines belong to it, and go with it.

Edge cases: null and empty texts have no lines to remove; repeated rows (same id and text)
share one decision: the window that stays in one of them stays in all; null ids sort first; a
very long line is hashed whole; other columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BitFilter, cut, quoted, table, text_or_empty
from .words import BASE, U, mix, utf8

SPAN, EVERY, MIN_LINES, SLICE = 2, 3, 2, 500
#: A window is hot from this many occurrences, and from a thousandth of all: at most 1,000 such windows exist.
HOT_ROWS, HOT_SHARE = 1000, 1000


def chunks(text: bytes) -> list[tuple[int, int, bytes]]:
    """(first line, lines that count, bytes) of each chunk; the chunks make up the text."""
    lines = text.split(b"\n")
    solid = [i for i, x in enumerate(lines) if x.strip()]
    if not solid:
        return []
    h = np.fromiter((xxhash.xxh64_intdigest(lines[i]) for i in solid), U, len(solid))
    rolling = h.copy()
    for k in range(1, SPAN):
        rolling[k:] += h[:-k] * U(pow(BASE, k, 1 << 64))
    ends = np.flatnonzero(mix(rolling) % U(EVERY) == 0)
    ends = ends[ends < len(solid) - 1].tolist()
    firsts = [0, *(solid[e] + 1 for e in ends)]
    counts = np.diff([0, *(e + 1 for e in ends), len(solid)]).tolist()
    lasts = [*firsts[1:], len(lines)]
    return [(a, n, b"\n".join(lines[a:b])) for a, b, n in zip(firsts, lasts, counts)]


def windows(text: bytes) -> list[tuple[int, int, bytes]]:
    """(first line, last line, bytes) of each run of ``MIN_LINES`` lines that count."""
    lines = text.split(b"\n")
    solid = [i for i, x in enumerate(lines) if x.strip()]
    ends = list(accumulate((len(x) + 1 for x in lines)))
    return [(a, b, text[ends[a] - len(lines[a]) - 1 : ends[b] - 1]) for a, b in zip(solid, solid[MIN_LINES - 1 :])]


def _keys(with_bytes: bool, may: BitFilter | None):
    """Rows (row, at, key) of all windows, with their bytes where the hash may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                ids, row, at, key, data = [], [], [], [], []
                for k, text in enumerate(utf8(part["text"])):
                    for first, _, body in windows(text):
                        ids.append(k), at.append(first), key.append(xxhash.xxh64_intdigest(body)), data.append(body)
                key = np.array(key, U).view(np.int64)
                keep = np.arange(len(key)) if may is None else np.flatnonzero(may(key))
                take = pa.array(np.array(ids, np.int64)[keep] if len(ids) else [], pa.int64())
                out = [part["doc_id"].take(take), part["row"].take(take), pa.array(np.array(at, np.int32)[keep] if len(at) else [], pa.int32()), pa.array(key[keep])]
                names = ["doc_id", "row", "at", "key"]
                if with_bytes:
                    out.append(pa.array([data[i] for i in keep.tolist()], pa.binary()))
                    names.append("body")
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def _without(text: bytes, gone: set[int]) -> tuple[bytes, int, int]:
    """What is left when the windows that begin at some lines go, and how many lines and whole chunks went."""
    lines = text.split(b"\n")
    left = np.ones(len(lines), bool)
    for first, last, _ in windows(text):
        if first in gone:
            left[first : last + 1] = False
    content = np.array([bool(x.strip()) for x in lines])
    n = sum(k >= MIN_LINES and not (left & content)[a : a + body.count(b"\n") + 1].any() for a, k, body in chunks(text))
    return b"\n".join(x for x, stays in zip(lines, left.tolist()) if stays), int((~left).sum()), n


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            part = batch.slice(lo, SLICE)
            lines, removed, n_chunks, texts = [], [], [], []
            for text, gone in zip(utf8(part["text"]), part["gone"].to_pylist()):
                lines.append(text.count(b"\n") + 1 if text else 0)
                if gone:
                    text, *counts = _without(text, set(gone))
                else:
                    counts = 0, 0
                removed.append(counts[0]), n_chunks.append(counts[1]), texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_chunks, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_lines", "n_removed", "n_chunks_removed", "text"],
            )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_lines, n_removed (lines), n_chunks_removed, text (what is left)."""
    base = docs.select(F.col(quoted(id_col)).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("row", F.xxhash64("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row long, at int, key long"

    counted = base.mapInArrow(_keys(False, None), schema).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = cut(counted)
    total, count = repeated.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    may = BitFilter.build(repeated, "key", count)

    # byte comparison: one group per hash and bytes
    place = F.struct("doc_id", "row", "at")
    bodies = base.mapInArrow(_keys(True, may), schema + ", body binary").groupBy("key", "body").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    bodies = cut(bodies.where("n > 1").select("key", "n", "first", F.xxhash64(F.lit(1), "body").alias("body_key")))

    occurrences = base.mapInArrow(_keys(True, may), schema + ", body binary").select("row", "doc_id", "at", "key", F.xxhash64(F.lit(1), "body").alias("body_key"))
    hot = F.col("n") >= max(HOT_ROWS, total // HOT_SHARE)
    on = ["key", "body_key"]
    first = occurrences.join(F.broadcast(bodies.where(hot)), on, "left")
    rest = first.where("n is null").drop("n", "first").join(bodies.where(~hot), on)
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row")) & (F.col("at") == F.col("first.at"))
    gone = first.where("n is not null").unionByName(rest).where(~stays).groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set("at").alias("gone"))
    gone = cut(gone)
    some = BitFilter.build(gone, "_row", gone.count())
    marked = base.mapInArrow(_flagged(some), f"doc_id {kind}, text string, row long, maybe boolean")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row"))  # a row is told by its id and a hash of its text
    hit = marked.where("maybe").join(gone, same, "left").select("doc_id", "text", "gone")
    clear = marked.where("not maybe").select("doc_id", "text", F.lit(None).cast("array<int>").alias("gone"))
    return clear.unionByName(hit).mapInArrow(_remove, f"doc_id {kind}, n_lines long, n_removed long, n_chunks_removed long, text string")


def _flagged(may: BitFilter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(may(batch["row"].to_numpy()))], [*batch.schema.names, "maybe"])

    return run


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_chunks_removed", F.sha2("text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple]) -> dict:
    """{id: (n_lines, n_removed, n_chunks_removed, kept_sha256)} from a table of all pairs of lines with content; for tests."""
    held, seen, out = {d: (t or "").encode() for d, t in rows}, set(), {}
    for d in sorted(held):
        lines, gone, before = held[d].split(b"\n"), set(), None
        for i, x in enumerate(lines):
            if not x.strip():
                continue
            if before is not None:
                pair = tuple(lines[before : i + 1])
                if pair in seen:
                    gone.update(range(before, i + 1))
                seen.add(pair)
            before = i
        n = 0
        for a, k, body in chunks(held[d]):
            n += k >= 2 and all(i in gone or not lines[i].strip() for i in range(a, a + len(body.split(b"\n"))))
        left = b"\n".join(x for i, x in enumerate(lines) if i not in gone)
        out[d] = (len(lines) if held[d] else 0, len(gone), n, hashlib.sha256(left).hexdigest())
    return out
