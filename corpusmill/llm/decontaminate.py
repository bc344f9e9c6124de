"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. All word n-grams of the test items are seeds. None is dropped for being frequent: how often
   the corpus holds an n-gram doesn't tell a common phrase from a leak with many copies.
2. Documents meet items where they share seeds. Hits of one item on neighbouring diagonals
   form a candidate, if there are ``MIN_SEEDS`` of them.
3. Each candidate is aligned locally, word by word, with match +2, mismatch -1, gap -1. The
   score is divided by that of the whole item; from ``THRESHOLD`` on the passage is a copy,
   edited or not. So is one that scores as much as ``PASSAGE`` words in a row do, however
   small a part of the item it is.

Words are compared in lower case without punctuation at their ends. Items are taken in
blocks of ``BLOCK_WORDS`` words, which bounds what is sent to the workers whatever the
size of the benchmark; each block is one more pass over the documents, and its index is gone
before the next one is made. Documents are read where they are; nothing is shuffled.

Edge cases: null texts and texts without words match nothing; items with fewer than ``SEED``
words have no seed and match nothing; item ids are of any type; repeated items and rows give repeated results; an empty
benchmark or table gives an empty result; columns other than ids and texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, quoted, rows_where, table, text_or_empty
from .words import split, utf8

SEED, MIN_SEEDS, THRESHOLD, PASSAGE = 3, 2, 0.5, 13
MATCH, MISMATCH, GAP = 2, -1, -1
BAND = 16  # diagonals that edits may lie apart
BLOCK_WORDS = 250_000
CACHE_WORDS = 400_000
_EDGE = ".,;:!?\"'()[]{}<>*#%&$-_«»“”‘’…"


def plain(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(_EDGE)


def plain_words(text: str | None) -> list[str]:
    return [x for w in split((text or "").encode("utf-8", "replace")) if (x := plain(w))]


class WordIds(dict):
    """Raw words to ids of the items' vocabulary, -1 for others and -2 for words that are only punctuation."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        w = plain(word)
        self[word] = i = self.vocabulary.get(w, -1) if w else -2
        return i


@dataclass
class Index:
    """A block of items with their seeds: sorted keys, and for each key where it stands in which items."""

    vocabulary: dict[str, int]
    items: list[np.ndarray]
    ids: list
    keys: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    at: np.ndarray

    @staticmethod
    def of(rows: list[tuple]) -> Index:
        vocabulary: dict[str, int] = {}
        items = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in plain_words(t)], np.int64) for _, t in rows]
        size = len(vocabulary)
        grams = [_grams(x, size) for x in items]
        key = np.concatenate([*grams, np.empty(0, np.int64)])
        item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        at = np.concatenate([*(np.arange(len(g)) for g in grams), np.empty(0, np.int64)]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        keys, begin = np.unique(key[order], return_index=True)
        return Index(vocabulary, items, [i for i, _ in rows], keys, np.append(begin, len(key)), item[order], at[order])


def _grams(ids: np.ndarray, size: int) -> np.ndarray:
    """Keys of all runs of SEED words; negative where a word isn't in the vocabulary."""
    n = len(ids) - SEED + 1
    if n <= 0:
        return np.empty(0, np.int64)
    key, bad = np.zeros(n, np.int64), np.zeros(n, bool)
    for k in range(SEED):
        part = ids[k : k + n]
        key = key * size + np.maximum(part, 0)
        bad |= part < 0
    return np.where(bad, -1, key)


def _lookup(index: Index, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose n-gram is a seed, and the seeds' numbers."""
    if not len(index.keys) or not len(grams):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    where = np.minimum(np.searchsorted(index.keys, grams), len(index.keys) - 1)
    found = np.flatnonzero(index.keys[where] == grams)
    return found, where[found]


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Best local score and where it ends in ``words``."""
    h = np.zeros(len(words) + 1, np.int64)
    step = np.arange(len(words) + 1) * -GAP
    best = end = 0
    for w in item:
        t = np.maximum(h - -GAP, 0)
        t[1:] = np.maximum(t[1:], h[:-1] + np.where(words == w, MATCH, MISMATCH))
        h = np.maximum.accumulate(t + step) - step
        k = int(h.argmax())
        if h[k] > best:
            best, end = int(h[k]), k
    return best, end


def matches(index: Index, ids: np.ndarray, found: np.ndarray, seed: np.ndarray) -> list[tuple[int, float, int, int, int]]:
    """(item, score, start, end, seeds) of the best passage of one document for each item, from the seeds' hits."""
    size = index.begin[seed + 1] - index.begin[seed]
    pos = np.repeat(found, size)
    entry = np.repeat(index.begin[seed] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(len(pos))
    item, diagonal = index.item[entry], pos - index.at[entry]
    order = np.lexsort((diagonal, item))
    item, diagonal, pos = item[order], diagonal[order], pos[order]
    new = np.concatenate([[True], (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > BAND)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(item))
    best: dict[int, tuple] = {}
    for a, b in zip(first.tolist(), last.tolist()):
        words = index.items[item[a]]
        seeds = len(np.unique(pos[a:b]))
        if seeds < min(MIN_SEEDS, len(words) - SEED + 1):
            continue
        lo, hi = max(0, int(diagonal[a]) - BAND), min(len(ids), int(diagonal[b - 1]) + len(words) + BAND)
        part = ids[lo:hi]
        score, end = align(words, part)
        share = score / (MATCH * len(words))
        if (share >= THRESHOLD or score >= MATCH * PASSAGE) and share > best.get(int(item[a]), (0.0,))[0]:
            _, length = align(words[::-1], part[:end][::-1])
            best[int(item[a])] = (share, lo + end - length, lo + end, seeds)
    return [(i, *x) for i, x in sorted(best.items())]


def _hits(index: Index, cache: WordIds, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per text: word ids, positions of seeds, seeds."""
    size = len(index.vocabulary)
    for text in texts:
        words = split(text)
        ids = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
        if (ids == -2).any():
            ids = ids[ids != -2]
        yield ids, *_lookup(index, _grams(ids, size))


def _find(index: Index, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordIds(index.vocabulary)
        for batch in batches:
            rows, out = [], []
            for k, (ids, found, seed) in enumerate(_hits(index, cache, utf8(batch["text"]))):
                if len(found):
                    for m in matches(index, ids, found, seed):
                        rows.append(k)
                        out.append((index.ids[m[0]], *m[1:]))
            cols = list(zip(*out)) or [[]] * 5
            kinds = [kind, pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))],
                ["doc_id", "item_id", "score", "start", "end", "seeds"],
            )

    return run


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple]]:
    """The items in blocks of at most ``BLOCK_WORDS`` words (or one item), read one block at a time."""
    rows = benchmark.select(F.col(item_col).alias("i"), text_or_empty(text_col).alias("t"))
    size = F.size(F.split("t", r"\s+"))
    block, words = [], 0
    for r in rows.withColumn("n", size).orderBy("i", "t").toLocalIterator():
        if block and words + r["n"] > BLOCK_WORDS:
            yield block
            block, words = [], 0
        block.append((r["i"], r["t"]))
        words += r["n"]
    if block:
        yield block


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """The index of each block that has seeds."""
    for block in blocks(benchmark):
        index = Index.of(block)
        if len(index.keys):
            yield index


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item it contains: doc_id, item_id, score, start, end (words), seeds.

    With several blocks of items, each block's matches are written before the next one's index is built.
    """
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), text_or_empty(text_col).alias("text"))
    item = benchmark.schema["item_id"]
    ddl = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {item.dataType.simpleString()}, score double, start long, end long, seeds long"
    kind, out, last = to_arrow_type(item.dataType), None, None
    for index in indexes(benchmark):
        if last is not None:
            part = cut(rows.mapInArrow(_find(last, kind), ddl))
            out = part if out is None else out.unionByName(part)
        last = index
    if last is None:
        return docs.sparkSession.createDataFrame([], ddl)
    part = rows.mapInArrow(_find(last, kind), ddl)
    return part if out is None else out.unionByName(part)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that contain a test item; rows are tested in place, all columns unchanged.

    With several blocks of items, what each block leaves is written before the next one's index is built.
    """
    last = None
    for index in indexes(benchmark):
        if last is not None:
            docs = cut(rows_where(docs, text_col, _clean(last)))
        last = index
    return docs if last is None else rows_where(docs, text_col, _clean(last))


def _clean(index: Index):
    def made():
        cache = WordIds(index.vocabulary)
        return lambda texts: pa.array([not (len(found) and matches(index, ids, found, seed)) for ids, found, seed in _hits(index, cache, utf8(texts))], pa.bool_())

    return made


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
