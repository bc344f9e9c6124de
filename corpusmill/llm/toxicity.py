"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its subwords: itself and the character n-grams of
``<word>``, hashed into ``BUCKETS`` rows. A document is the mean of its words, times
``SCALE``; a linear softmax over it gives the score. Embeddings and softmax are trained
together by Adam on the driver, on at most ``ROWS_PER_LABEL`` labelled rows of each label, in
the order of a hash of their ids, and of at most ``CHARS_PER_LABEL`` characters together (whole
texts; one that doesn't fit is passed over): these bounds are the only sampling there is. Subwords whose
frequency doesn't differ between the labels beyond chance keep a zero vector. A misspelling that
training never saw shares n-grams, and so vectors, with the word it comes from.

Mean and softmax are linear, so for scoring each bucket folds into one number; documents
are scored whole, where they are, with no shuffle. What is sent to workers is 4 bytes a
bucket.

Edge cases: a null or empty text scores as the softmax of a zero vector; repeated rows get
equal results; labels other than 0 and 1, for ids without a document, or that contradict each
other are not used; of rows with the same id the text with the least hash is learnt from;
without rows of both labels every score is 0; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, quoted, rows_where, table, text_or_empty
from .words import U, mix

ROWS_PER_LABEL, CHARS_PER_LABEL = 2000, 50_000_000
BUCKETS, DIM, NGRAMS, SCALE = 1 << 17, 8, (3, 5), 30.0
EPOCHS, BATCH, RATE, DECAY = 16, 32, 0.02, 0.05
MIN_DOCS, MIN_Z = 3, 5.0
THRESHOLD = 0.7
SLICE = 1000  # documents that are scored at once
_EDGE = ".,;:!?\"'()[]{}<>*#%&$-_"


def held_out(doc_id: Column) -> Column:
    """Rows that no training may see: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' subwords, and the number of the word that each belongs to."""
    text = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(size)
    owner, last = np.repeat(np.arange(len(words)), size), np.repeat(end, size)
    place = (np.arange(len(codes)) - np.repeat(end - size, size)).astype(U)
    whole = mix(np.add.reduceat(mix(codes + place * U(0x9E3779B97F4A7C15)), end - size)) if len(words) else np.empty(0, U)
    buckets, owners = [whole], [np.arange(len(words))]
    at, h = np.arange(len(codes)), np.zeros(len(codes), U)
    for n in range(1, NGRAMS[1] + 1):
        fits = at + n <= last[at]
        at, h = at[fits], h[fits]
        h = (h + codes[at + n - 1] + U(1)) * U(0x9E3779B97F4A7C15)
        if n >= NGRAMS[0]:
            buckets.append(mix(h))
            owners.append(owner[at])
    return (np.concatenate(buckets) % U(BUCKETS)).astype(np.int64), np.concatenate(owners)


def words_of(text: str) -> list[str]:
    return [x for w in text.lower().split() if (x := w.strip(_EDGE))]


@dataclass
class Model:
    embeddings: np.ndarray  # (BUCKETS, DIM)
    weights: np.ndarray  # (DIM, 2)
    bias: np.ndarray  # (2,)

    def folded(self) -> tuple[np.ndarray, float]:
        """Per bucket its share in the log odds of label 1, and the bias."""
        d = self.weights[:, 1] - self.weights[:, 0]
        return (self.embeddings @ d * SCALE).astype(np.float32), float(self.bias[1] - self.bias[0])


class Bags:
    """Documents as sparse rows over the buckets; each row's weights sum up to SCALE. Rows are made when asked for."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        self.words = []
        for t in texts:
            c = Counter(words_of(t))
            self.words.append((np.fromiter((number.setdefault(w, len(number)) for w in c), np.int32, len(c)), np.fromiter(c.values(), np.int32, len(c))))
        parts, many, known = [], [], list(number)
        for lo in range(0, len(known), 20_000):
            bucket, owner = subwords(known[lo : lo + 20_000])
            parts.append(bucket[np.argsort(owner, kind="stable")].astype(np.int32))
            many.append(np.bincount(owner))
        self.bucket = np.concatenate(parts) if parts else np.empty(0, np.int32)
        self.many = np.concatenate(many) if many else np.empty(0, np.int64)
        self.begin = np.cumsum(self.many) - self.many

    def __len__(self) -> int:
        return len(self.words)

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets in order, and their weights."""
        w, n = self.words[i]
        many = self.many[w]
        at = np.repeat(self.begin[w] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        index, where = np.unique(self.bucket[at], return_inverse=True)
        return index, np.bincount(where, np.repeat(n * SCALE / max(1, int(n.sum())) / np.maximum(1, many), many), len(index)).astype(np.float32)


def telling(bags: Bags, labels: np.ndarray) -> np.ndarray:
    """Buckets whose share of documents differs between the labels by ``MIN_Z`` standard errors; all, if none does.

    Others say nothing that the sample can prove, and would only learn it by heart.
    """
    n, have = [(labels == k).sum() for k in (0, 1)], np.zeros((2, BUCKETS))
    for i, y in enumerate(labels.tolist()):
        have[y, bags.row(i)[0]] += 1
    both = have.sum(0) / sum(n)
    error = np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / n[0] + 1 / n[1]))
    use = (have.sum(0) >= MIN_DOCS) & (np.abs(have[1] / n[1] - have[0] / n[0]) >= MIN_Z * error)
    return np.flatnonzero(use if use.any() else have.sum(0) > 0)


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    """Joint training of embeddings and softmax; labels are weighted to equal shares."""
    rng = np.random.default_rng(seed)
    bags = Bags(texts)
    use = telling(bags, labels)
    at = np.full(BUCKETS, -1)
    at[use] = np.arange(len(use))
    bags = [(at[i][at[i] >= 0], w[at[i] >= 0]) for i, w in map(bags.row, range(len(bags)))]
    params = [rng.normal(0, 0.05, (len(use), DIM)).astype(np.float32), rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    share = np.array([0.5 / (labels == k).mean() for k in (0, 1)], np.float32)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            index, weight = (np.concatenate([bags[i][k] for i in pick]) for k in (0, 1))
            doc = np.repeat(np.arange(len(pick)), [len(bags[i][0]) for i in pick])
            part = params[0][index] * weight[:, None]
            x = np.stack([np.bincount(doc, part[:, d], len(pick)) for d in range(DIM)], 1).astype(np.float32)
            z = x @ params[1] + params[2]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            y = labels[pick]
            p[np.arange(len(pick)), y] -= 1
            g = p * share[y][:, None] / len(pick)
            gx = (g @ params[1].T)[doc] * weight[:, None]
            ge = np.stack([np.bincount(index, gx[:, d], len(use)) for d in range(DIM)], 1).astype(np.float32)
            step += 1
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, grad in enumerate((ge, x.T @ g, g.sum(0))):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                params[k] -= RATE * (fix * first[k] / (np.sqrt(second[k]) + 1e-8) + (DECAY * params[k] if k == 0 else 0))
    embeddings = np.zeros((BUCKETS, DIM), np.float32)
    embeddings[use] = params[0]
    return Model(embeddings, params[1], params[2])


def training_rows(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = ROWS_PER_LABEL, chars: int = CHARS_PER_LABEL
) -> tuple[list[str], np.ndarray]:
    """At most ``per_label`` texts of each label, without held-out ids; the same ones on every run.

    The ids are broadcast, and only their texts shuffle, one of each id.
    """
    known = labels.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(label_col)).cast("int").alias("_y"))
    known = known.where(~held_out(F.col("_id")) & F.col("_id").isNotNull() & F.col("_y").isNotNull())
    known = known.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").drop("_z")
    pick = None
    for y in (0, 1):
        one = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_label)
        pick = one if pick is None else pick.unionByName(one)
    side = docs.select(F.col(quoted(id_col)).alias("_doc"), text_or_empty(text_col).alias("_text"))
    met = side.join(F.broadcast(pick), F.col("_doc") == F.col("_id"))
    texts = cut(met.groupBy("_id", "_y").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), F.col("_text").alias("t"))).alias("_x")))
    sizes = texts.select("_id", "_y", F.xxhash64("_id").alias("h"), F.char_length("_x.t").alias("n")).collect()  # 2 * per_label rows at most
    used, left = [], {0: chars, 1: chars}
    for r in sorted(sizes, key=lambda r: (r["h"], r["_id"])):
        if r["n"] <= left[r["_y"]]:
            left[r["_y"]] -= r["n"]
            used.append(r["_id"])
    if not used:
        return [], np.empty(0, np.int64)
    rows = texts.where(F.col("_id").isin(used)).select(F.xxhash64("_id").alias("h"), "_id", F.col("_x.t").alias("t"), "_y").toArrow()
    rows = rows.sort_by([("h", "ascending"), ("_id", "ascending")])
    return rows["t"].to_pylist(), rows["_y"].to_numpy().astype(np.int64)


def scores_of(texts: list[str], folded: np.ndarray, bias: float) -> np.ndarray:
    """Scores of whole texts; each distinct word among them is hashed once."""
    number: dict[str, int] = {}
    sizes, flat = [], []
    for text in texts:
        words = text.lower().split()
        sizes.append(len(words))
        flat += [number.setdefault(w, len(number)) for w in words]
    bare = [w.strip(_EDGE) for w in number]
    bucket, owner = subwords(bare)
    word = np.bincount(owner, folded[bucket], len(bare)) / np.maximum(1, np.bincount(owner, minlength=len(bare)))
    real = np.fromiter((bool(w) for w in bare), bool, len(bare))
    flat, doc = np.array(flat, np.int64), np.repeat(np.arange(len(texts)), sizes)
    total = np.bincount(doc, np.where(real, word, 0.0)[flat], len(texts))
    odds = bias + total / np.maximum(1, np.bincount(doc, real[flat].astype(np.float64), len(texts)))
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def _scorer(folded: np.ndarray | None, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                texts = pc.fill_null(part["text"], "").to_pylist()
                out = np.zeros(len(texts)) if folded is None else scores_of(texts, folded, bias)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(out)], ["doc_id", "held_out", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = ROWS_PER_LABEL) -> Model | None:
    texts, y = training_rows(docs, labels, id_col, text_col, label_col, per_label)
    return train(texts, y) if len(set(y.tolist())) == 2 else None


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    folded, bias = model.folded() if model else (None, 0.0)
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), held_out(F.col(quoted(id_col))).alias("held_out"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(_scorer(folded, bias), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the model rejects; rows are tested in place, all columns unchanged."""
    model = fit(docs, labels, id_col, text_col)
    if model is None:
        return docs
    folded, bias = model.folded()

    def made():
        def keep(column: pa.Array) -> pa.Array:
            out = [np.empty(0, bool)]
            for lo in range(0, len(column), SLICE):
                texts = pc.fill_null(column[lo : lo + SLICE].cast(pa.string()), "").to_pylist()
                out.append(scores_of(texts, folded, bias) < threshold)
            return pa.array(np.concatenate(out))

        return keep

    return rows_where(docs, text_col, made)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
