"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Texts are sets of runs of five consecutive words; two documents are linked if the Jaccard
similarity of their sets is 0.8 or more.

1. Documents with equal sets fall into one class by a 128-bit hash of the set; a class counts
   once, under a number of its own.
2. A class has a signature of ``TREES * DEPTH`` MinHash values. In each of ``TREES`` trees its
   label is the signature read from another place on, so a label is as long as the signature.
   Sorted by label, a tree is a prefix trie: classes that share a prefix stand together.
3. In every tree matched prefixes are shortened down to the length at which a pair at the
   threshold meets in some tree with probability ``RECALL`` (:func:`prefix_length`). A node of
   more than ``NODE`` different signatures is not compared at that length: it is split by
   longer prefixes until its parts are small, or no value is left to tell them apart by. So the
   depth is the node's own, deep where the corpus is dense.
4. A pair at the threshold meets in a tree of depth d with probability ``threshold ** d``. What
   longer prefixes cost is added up for each class; classes that are short of the target recall
   are given ``TREES`` more trees, of labels read in another order, until all have reached it.
5. Classes of one node are compared by their whole signatures. Those that may be similar
   (``SLACK`` standard errors of doubt) are joined into candidate groups by spanning edges.
6. Groups are verified exactly: each class's set is shuffled once to its group (a large group
   is cut into pairs of parts, so that no task holds more than two parts of ``PART`` classes);
   overlaps are counted through an inverted index. What leaves a task are link counts per
   class and spanning edges of the verified links, never all pairs.

Nodes that would not fit a task (more than ``HELD`` classes) are counted and split by longer
prefixes before they are shuffled. Groups and classes of links are connected components, found
in Spark by large-star and small-star steps on edges; neither edges nor components reach the
driver.

Words are as in the other operators: separated by ASCII white space, otherwise unchanged.

Edge cases: a text of one to four words has one shingle, all of its words; a text without
words (or null) has none and links to nothing, not even to another one; repeated rows and rows
that repeat an id are documents like others, each linked to the rest of its class; null ids sort
first; other columns are not read, and may have any name; an empty table gives an empty result.
Sets are of 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BitFilter, cut, quoted, table, text_or_empty
from .words import BASE, U, WordHashes, mix, split, utf8

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.999
TREES, DEPTH = 16, 8
SLACK, NODE, HELD, PART = 5.0, 2000, 200_000, 500
#: A class is hot from this many documents, and from a thousandth of all: at most 1,000 such classes exist.
HOT_ROWS, HOT_SHARE = 1000, 1000
SIDE_ROWS = 100_000
_RNG = np.random.default_rng(12345)
_SEEDS = _RNG.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * U(2) + U(1)


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with the target recall."""
    for d in range(depth, 1, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    return 1


def shingles(hashes: np.ndarray, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct hashes of all runs of n words."""
    if not len(hashes):
        return np.empty(0, U)
    n = min(n, len(hashes))
    m = len(hashes) - n + 1
    total = np.zeros(m, U)
    for k in range(n):
        total = total * U(BASE) + hashes[k : k + m]
    return np.unique(mix(total + U(n)))


def signature(grams: np.ndarray) -> np.ndarray:
    """TREES * DEPTH MinHash values."""
    best = None
    for lo in range(0, len(grams), 4096):
        x = grams[lo : lo + 4096, None] * _SEEDS
        x ^= x >> U(32)
        least = x.min(0)
        best = least if best is None else np.minimum(best, least)
    return mix(best)


def _sketch(ngram: int):
    """Rows (doc_id, text hashes, set_key, signature): a byte of each MinHash value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            keys, short = [], []
            for text in utf8(batch["text"]):
                grams = shingles(cache.of(split(text)), ngram)
                if not len(grams):
                    keys.append(None), short.append(None)
                    continue
                place = np.arange(1, len(grams) + 1, dtype=U)
                a, b = mix(np.array([(grams * (place * U(2) + U(1))).sum(dtype=U), (mix(grams) ^ place).sum(dtype=U)], U)).tolist()
                keys.append(a.to_bytes(8, "big") + b.to_bytes(8, "big"))
                short.append((signature(grams) & U(0xFF)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["h1"], batch["h2"], pa.array(keys, pa.binary()), pa.array(short, pa.binary())], ["doc_id", "h1", "h2", "set_key", "signature"])

    return run


def label_order(tree: int) -> np.ndarray:
    """In which order a tree reads the values of a signature; a prefix of DEPTH values is shared with no other tree of its round."""
    turn, k = divmod(tree, TREES)
    order = np.arange(TREES * DEPTH) if turn == 0 else np.random.default_rng([54321, turn]).permutation(TREES * DEPTH)
    return np.roll(order, -k * DEPTH)


ROW = "node long, tree int, depth int, rep long, signature binary"


def _prefixes(trees: range, depth: int, may: BitFilter | None):
    """The key of the first ``depth`` values of each class's label in each tree: keys alone, or rows of ``ROW`` where the key may be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = [label_order(t)[:depth] for t in trees]
        for batch in batches:
            n = batch.num_rows
            sig = np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint8).reshape(n, -1)
            keys = np.concatenate([node_keys(sig[:, o], t) for o, t in zip(orders, trees)]).view(np.int64)
            if may is None:
                yield pa.RecordBatch.from_arrays([pa.array(keys)], ["node"])
                continue
            ok = np.flatnonzero(may(keys))
            at, tree = pa.array(ok % max(1, n)), (ok // max(1, n) + trees[0]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys[ok]), pa.array(tree), pa.array(np.full(len(ok), depth, np.int32)), batch["rep"].take(at), batch["signature"].take(at)], ["node", "tree", "depth", "rep", "signature"])

    return run


def _longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows at prefixes of one value more."""
    for batch in batches:
        n = batch.num_rows
        sig = np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint8).reshape(n, -1)
        tree, depth = batch["tree"].to_numpy(), batch["depth"].to_numpy() + 1
        keys = np.empty(n, U)
        for t, d in set(zip(tree.tolist(), depth.tolist())):
            at = (tree == t) & (depth == d)
            keys[at] = node_keys(sig[at][:, label_order(t)[:d]], t)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch["tree"], pa.array(depth.astype(np.int32)), batch["rep"], batch["signature"]], ["node", "tree", "depth", "rep", "signature"])


def node_keys(values: np.ndarray, tree: int) -> np.ndarray:
    """One 64-bit key per row for its values in a tree."""
    key = np.full(len(values), tree + 1, U)
    for k in range(values.shape[1]):
        key = mix(key * U(BASE) + values[:, k] + U(1))
    return key


def join_near(sig: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Spanning edges between rows whose signatures agree in ``enough`` values; rows that are joined already aren't compared."""
    root = np.arange(len(sig))
    edges = []
    for i in range(len(sig) - 1):
        apart = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        if not len(apart) and (root == root[0]).all():
            break
        for lo in range(0, len(apart), 20_000):
            part = apart[lo : lo + 20_000]
            near = part[(sig[part] == sig[i]).sum(1) >= enough]
            if len(near):
                first, at = np.unique(root[near], return_index=True)
                edges += [(i, int(near[k])) for k, r in zip(at.tolist(), first.tolist()) if r != root[i]]
                root[np.isin(root, first)] = root[i]
    return edges


def walk(sig: np.ndarray, order: np.ndarray, depth: int, enough: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges among the rows of one node (sorted, different signatures), and at which depth each row was compared.

    Part by part, the longest prefixes first, so that a part is held only while it is compared.
    """
    edges: list[tuple[int, int]] = []
    at = np.full(len(sig), depth)
    todo = [(np.arange(len(sig)), depth)]
    while todo:
        rows, d = todo.pop()
        if len(rows) <= NODE or d == len(order):
            at[rows] = d
            edges += [(int(rows[a]), int(rows[b])) for a, b in join_near(sig[rows], enough)]
            continue
        value = sig[rows, order[d]]
        by = np.argsort(value, kind="stable")
        todo += [(rows[part], d + 1) for part in np.split(by, np.flatnonzero(np.diff(value[by])) + 1)]
    return edges, at


def _nodes(enough: int, base: int):
    """From rows (node, tree, depth, rep, signature) sorted by node and signature: edges (a, b), and (a, depth) where a class was compared deeper than ``base``."""

    def done(tree: int, depth: int, ids: list[int], sigs: list[bytes]) -> list[tuple]:
        out, at = [], np.full(len(ids), depth)
        if len(ids) > 1:
            edges, at = walk(np.frombuffer(b"".join(sigs), np.uint8).reshape(len(ids), -1), label_order(tree), depth, enough)
            out += [(ids[x], ids[y], None) for x, y in edges]
        return out + [(x, None, d) for x, d in zip(ids, at.tolist()) if d > base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sigs, out = None, [], [], []
        pack = lambda e: pa.RecordBatch.from_arrays([pa.array([x[0] for x in e], pa.int64()), pa.array([x[1] for x in e], pa.int64()), pa.array([x[2] for x in e], pa.int32())], ["a", "b", "depth"])
        for batch in batches:
            for *key, rep, sig in zip(*(batch[c].to_pylist() for c in ("node", "tree", "depth", "rep", "signature"))):
                if key != now:
                    if ids:
                        out += done(now[1], now[2], ids, sigs)
                    now, ids, sigs = key, [], []
                ids.append(rep)
                sigs.append(sig)
                if len(out) > 50_000:
                    yield pack(out)
                    out = []
        if ids:
            out += done(now[1], now[2], ids, sigs)
        yield pack(out)

    return run


def forest(classes: DataFrame, threshold: float, recall: float, enough: int) -> DataFrame:
    """Candidate edges (a, b) between classes (rep, signature), from as many trees as each class needs for the target recall."""
    base = prefix_length(threshold, recall=recall)
    lost = lambda d: F.log(1 - F.pow(F.lit(threshold), d))  # noqa: E731  log of the chance that a pair at the threshold is apart in a tree
    # equal signatures are equal labels, whatever the tree: one class of each goes on, and is joined with the others
    first = classes.groupBy("signature").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("n"))
    edges = classes.join(first.where("n > 1"), "signature").where("rep != a").select("a", F.col("rep").alias("b"))
    lacking, turn = cut(first.select(F.col("a").alias("rep"), "signature", F.lit(0.0).alias("missed"))), 0
    while True:
        trees = range(turn * TREES, (turn + 1) * TREES)
        bare = lacking.select("rep", "signature")
        shared = cut(bare.mapInArrow(_prefixes(trees, base, None), "node long").groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        rows = bare.mapInArrow(_prefixes(trees, base, BitFilter.build(shared, "node", shared.count())), ROW)
        small, large = None, shared.where(F.col("n") > HELD).select("node")
        while large.take(1):  # nodes that are too large for a task are split before they are shuffled
            part = rows.join(large, "node", "left_anti").select(*rows.columns)
            small = part if small is None else small.unionByName(part)
            rows = cut(rows.join(large, "node", "left_semi").select(*rows.columns).mapInArrow(_longer, ROW))
            large = cut(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HELD).select("node"))
        rows = rows if small is None else small.unionByName(rows)
        rows = rows.repartition(F.col("node")).sortWithinPartitions("node", "tree", "depth", "signature")
        found = cut(rows.mapInArrow(_nodes(enough, base), "a long, b long, depth int"))
        edges = edges.unionByName(found.where("b is not null").select("a", "b"))
        deeper = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum(lost(F.col("depth")) - lost(F.lit(base))).alias("more"))
        missed = F.col("missed") + F.coalesce("more", F.lit(0.0)) + TREES * lost(F.lit(base))
        lacking = cut(lacking.join(deeper, "rep", "left").select("rep", "signature", missed.alias("missed")).where(F.col("missed") > math.log(1 - recall)))
        turn += 1
        if not lacking.take(1):
            return edges.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component of edges (a, b), by star steps; roots included."""
    e = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    print_of = lambda x: x.agg(F.count(F.lit(1)), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first()
    seen = print_of(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        e = cut(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u != v").distinct())
        now = print_of(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def verified(sets: list[np.ndarray], size: list[int], parts: list[int], lo: int, hi: int, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each class (in documents of its partners) and spanning edges, among pairs of parts (lo, hi)."""
    n = len(sets)
    links = np.zeros(n, np.int64)
    length = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets)
    _, gram = np.unique(every, return_inverse=True)
    owner = np.repeat(np.arange(n), length)
    order = np.argsort(gram, kind="stable")
    post = owner[order]
    begin = np.concatenate([[0], np.cumsum(np.bincount(gram))])
    start = np.concatenate([[0], np.cumsum(length)])
    side, weight = np.array(parts), np.array(size, np.int64)
    root = np.arange(n)
    edges = []
    for i in range(n):
        g = gram[start[i] : start[i + 1]]
        g = g[begin[g + 1] - begin[g] > 1]
        if not len(g):
            continue
        count = begin[g + 1] - begin[g]
        at = np.repeat(begin[g] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        common = np.bincount(post[at], minlength=n)
        ok = (common * (1 + threshold) >= threshold * (length[i] + length) - 1e-9) & (common > 0)
        ok[: i + 1] = False
        if lo != hi:
            ok &= side != side[i]
        near = np.flatnonzero(ok)
        if len(near):
            links[i] += weight[near].sum()
            links[near] += weight[i]
            for j in near.tolist():
                a, b = i, j
                while root[a] != a:
                    root[a] = root[root[a]]
                    a = root[a]
                while root[b] != b:
                    root[b] = root[root[b]]
                    b = root[b]
                if a != b:
                    root[max(a, b)] = min(a, b)
                    edges.append((i, j))
    return links, edges


def _verify(ngram: int, threshold: float):
    """From rows (cell, lo, hi, part, rep, size, text) sorted by cell: rows (node, links, other), other null for counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        held: list[tuple] = []
        now = None

        def done() -> pa.RecordBatch:
            nodes = [h[0] for h in held]
            links, edges = verified([h[3] for h in held], [h[1] for h in held], [h[2] for h in held], now[1], now[2], threshold)
            some = np.flatnonzero(links).tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array([nodes[i] for i in some] + [nodes[i] for i, _ in edges], pa.int64()), pa.array([int(links[i]) for i in some] + [0] * len(edges), pa.int64()), pa.array([None] * len(some) + [nodes[j] for _, j in edges], pa.int64())],
                ["node", "links", "other"],
            )

        for batch in batches:
            texts = utf8(batch["text"])
            for group, lo, hi, part, rep, size, text in zip(*(batch[c].to_pylist() for c in ("group", "lo", "hi", "part", "rep", "size")), texts):
                if (group, lo, hi) != now:
                    if len(held) > 1:
                        yield done()
                    now, held = (group, lo, hi), []
                held.append((rep, size, part, shingles(cache.of(split(text)), ngram)))
        if len(held) > 1:
            yield done()

    return run


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, h1, h2): two 64-bit hashes of the text, which tell rows that repeat an id apart."""
    base = docs.select(F.col(quoted(id_col)).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return base.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})


def _decided(docs: DataFrame, id_col: str, text_col: str, ngram: int, threshold: float, recall: float) -> DataFrame:
    """Per document: doc_id, h1, h2, first (doc_id, h1 and h2 of the first row of its class of links), n_links, group_size."""
    values = TREES * DEPTH
    expected = threshold + (1 - threshold) / 256
    enough = math.floor(values * expected - SLACK * math.sqrt(values * expected * (1 - expected)))
    base = _documents(docs, id_col, text_col)
    kind = base.schema["doc_id"].dataType.simpleString()
    rows = cut(base.mapInArrow(_sketch(ngram), f"doc_id {kind}, h1 long, h2 long, set_key binary, signature binary"))
    some = rows.where("set_key is not null")
    classes = some.groupBy("set_key").agg(F.min(F.struct("doc_id", "h1", "h2")).alias("least"), F.count(F.lit(1)).alias("size"), F.first("signature").alias("signature"))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()))
    groups = components(forest(classes, threshold, recall, enough))

    # verification: one text of each class in a group is brought
    member = cut(groups.withColumnRenamed("root", "group").join(classes.select(F.col("rep").alias("node"), "least.h1", "least.h2", "size"), "node"))
    may = BitFilter.build(member.select("h1"), "h1", member.count())
    texts = base.select("text", "h1", "h2").mapInArrow(_chosen(may), "text string, h1 long, h2 long").groupBy("h1", "h2").agg(F.first("text").alias("text"))
    large = member.groupBy("group").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > PART)
    parts = F.coalesce(F.ceil(F.col("members") / PART), F.lit(1)).cast("int")
    placed = member.join(_side(large), "group", "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))
    carried = placed.join(texts, ["h1", "h2"]).select("group", "part", "parts", F.col("node").alias("rep"), "size", "text")
    cells = carried.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("group", F.least("part", "with").alias("lo"), F.greatest("part", "with").alias("hi"), "part", "rep", "size", "text")
    cells = cells.repartition(F.col("group"), F.col("lo"), F.col("hi")).sortWithinPartitions("group", "lo", "hi", "rep")
    found = cut(cells.mapInArrow(_verify(ngram, threshold), "node long, links long, other long"))
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    about = classes.select("set_key", F.col("rep").alias("node"), "least", "size")
    met = cut(about.join(linked, "node").join(links, "node"))
    whole = _side(met.groupBy("root").agg(F.min("least").alias("first"), F.sum("size").alias("group_size")))
    met = met.join(whole, "root").select("set_key", "first", (F.col("size") - 1 + F.col("links")).alias("n_links"), "group_size", "size")
    alone = about.join(linked, "node", "left_anti").select("set_key", F.col("least").alias("first"), (F.col("size") - 1).alias("n_links"), F.col("size").alias("group_size"), "size")
    about = cut(met.unionByName(alone))
    hot = F.col("size") >= max(HOT_ROWS, rows.count() // HOT_SHARE)
    near = some.select("doc_id", "h1", "h2", "set_key").join(F.broadcast(about.where(hot)), "set_key", "left")
    rest = near.where("size is null").select("doc_id", "h1", "h2", "set_key").join(about.where(~hot), "set_key")
    columns = ["doc_id", "h1", "h2", "first", "n_links", "group_size"]
    no_words = rows.where("set_key is null").select("doc_id", "h1", "h2", F.struct("doc_id", "h1", "h2").alias("first"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("group_size"))
    return near.where("size is not null").select(*columns).unionByName(rest.select(*columns)).unionByName(no_words)


def _side(groups: DataFrame) -> DataFrame:
    """A side of a join with one row per group: sent to all tasks while it has at most ``SIDE_ROWS`` rows, so that a large group isn't one task's; shuffled beyond."""
    groups = cut(groups)
    return F.broadcast(groups) if groups.count() <= SIDE_ROWS else groups


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id (least id of its class of links), n_links (documents linked to it), group_size."""
    out = _decided(docs, id_col, text_col, ngram, threshold, recall)
    return out.select("doc_id", F.col("first.doc_id").alias("class_id"), "n_links", "group_size")


def _chosen(may: BitFilter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may(batch["h1"].to_numpy())))

    return run


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the first row (by id, then by a hash of the text) of each class, all columns unchanged.

    Rows are told apart by id and text. Those without links pass without a shuffle where the bit
    filter allows it. Of rows that repeat a kept row's id and text one stays.
    """
    out = _decided(docs, id_col, text_col, NGRAM, THRESHOLD, RECALL).where("n_links > 0")
    stays = F.struct("doc_id", "h1", "h2").eqNullSafe(F.col("first"))
    gone = cut(out.groupBy(F.col("doc_id").alias("id"), "h1", "h2").agg(F.first(stays).alias("stays"), F.count(F.lit(1)).alias("n")))
    may = BitFilter.build(gone.select("h1"), "h1", gone.count())
    packed = docs.select(F.struct(F.col("*")).alias("row"), F.col(quoted(id_col)).alias("id"), text_or_empty(text_col).alias("t"))
    packed = packed.select("row", "id", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2"), F.lit(False).alias("maybe"))
    flagged = packed.mapInArrow(_mark(may), packed.schema)
    known = gone.select(F.col("id").alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "stays", "n")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    met = flagged.where("maybe").join(known, same, "left")
    once = met.where("n is null or (stays and n = 1)")
    again = met.where("stays and n > 1").groupBy("id", "h1", "h2").agg(F.first("row").alias("row"))
    return flagged.where("not maybe").select("row.*").unionByName(once.select("row.*")).unionByName(again.select("row.*"))


def _mark(may: BitFilter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("maybe")
            yield batch.set_column(i, batch.schema.field(i), pa.array(may(batch["h1"].to_numpy())))

    return run


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def brute_force(rows: list[tuple], ngram: int = NGRAM, threshold: float = THRESHOLD) -> list[tuple]:
    """(id, class_id, n_links) of each row, by comparing all pairs; for tests."""
    words = [split((t or "").encode()) for _, t in rows]
    sets = [{tuple(w[i : i + ngram]) for i in range(max(1, len(w) - ngram + 1))} if w else set() for w in words]
    links, root = [0] * len(rows), list(range(len(rows)))
    at: dict = {}
    for i, s in enumerate(sets):
        common: dict[int, int] = {}
        for g in s:
            for j in at.setdefault(g, []):
                common[j] = common.get(j, 0) + 1
            at[g].append(i)
        for j, c in common.items():
            if c >= threshold * (len(s) + len(sets[j]) - c) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = i, j
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        a = i
        while root[a] != a:
            a = root[a]
        root[i] = a
        least[a] = d if a not in least else min(least[a], d)
    return [(d, least[root[i]], links[i]) for i, (d, _) in enumerate(rows)]
