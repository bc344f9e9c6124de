"""SentencePiece encoding and decoding with sampling: Gumbel top-k over the lattice of pieces.

The pieces of a SentencePiece model span a lattice over each text; a segmentation has the
probability that its pieces' weights give it, normalised over the lattice. The operator draws
``k`` distinct segmentations without replacement: those with the k largest log-probabilities
perturbed by independent Gumbel noise. It finds them with a perturbed A* search: backward
sums give each lattice node the exact mass of all paths from it, so the largest perturbed
value of any set of paths can be drawn without listing them. The queue holds such sets
(everything that leaves a found path at one node by another piece, bounded by that path's
value); the best is taken out, its best path is drawn, and what is left of it is split and
put back. The value of the first set that is not taken out, kappa, gives the inclusion score
``log(1 - exp(-exp(log_prob - kappa)))``, the log-probability that a segmentation is among
the k, for weighted estimates.

Weights: byte-pair models order their pieces by rank; a piece weighs ``1 / (rank + 10)`` to the
power ``alpha``. Characters without a piece fall back to bytes. Noise comes from a hash of seed,
row key, path, place and step, so that a row's samples don't depend on how rows are dealt out.

Work is done for all documents of a slice at once in numpy, on lattices of distinct words
(a word keeps the spaces before it, and a line break is one): pieces don't cross words, so the
lattice of a text is the chain of its words' lattices. A task keeps the lattices of up to
``KEPT_NODES`` characters of words. Sums are taken within a node or along a document's own path,
never across them, and masses carry their own exponents, so that words of any length have the
same arithmetic: a row's samples and their numbers are the same bit by bit whatever rows stand
beside it. Decoding gives back every text exactly.

Edge cases: null counts as empty, and an empty text has one segmentation, without pieces; a text
with fewer than k segmentations gives as many rows as it has, with inclusion score 0; repeated
rows get equal samples; a literal U+2581 is encoded by its bytes; texts are encoded whole; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty
from .words import U, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, ALPHA, SEED = 2, 1.0, 17
SLICE_CHARS, REUSE, SLOT_BITS = 120_000, 8, 20
KEPT_NODES, BLOCK, SHIFT, NEAR = 400_000, 400, 4, 64
#: No exponential variable drawn from 53 bits has a logarithm below this.
LEAST_LOG_NOISE = -37.5
MARK, LITERAL_MARK = "▁", "\udc81"  # the space mark, and what stands for a literal one inside the operator
_WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


@dataclass
class Pieces:
    """A model's pieces: ids and log-weights by text, texts by id, the first of the 256 byte ids, a table of hashes."""

    ids: dict[str, int]
    weight: dict[str, float]
    bytes: np.ndarray  # of all pieces' texts, end to end
    starts: np.ndarray
    sizes: np.ndarray
    byte0: int
    longest: int
    fallback: float
    slots: np.ndarray  # hash table of all pieces and of what they start with: hashes, 0 where empty
    values: np.ndarray  # the piece of each slot, -1 for a mere start
    weights: np.ndarray  # by id, not as logarithms

    @staticmethod
    def hash_step(h: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The hash of a string with one more character."""
        x = (h ^ char.astype(U)) * U(0x9E3779B97F4A7C15) + (h >> U(29)) + U(1)
        return x ^ (x << U(32))

    @staticmethod
    def load(path: str = MODEL, alpha: float = ALPHA) -> Pieces:
        """Read on the driver; what workers get is a few MB, however many documents there are."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        byte0 = next(i for i in range(n) if m.is_byte(i))
        normal = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        ids = {m.id_to_piece(i): i for i in normal}
        weight = {m.id_to_piece(i): -alpha * math.log(-m.get_score(i) + 10) for i in normal}
        texts = [b""] * n
        for t, i in ids.items():
            texts[i] = t.replace(MARK, " ").encode()
        for b in range(256):
            texts[byte0 + b] = bytes([b])
        hashes: dict[int, int] = {}
        for t, i in sorted(ids.items(), key=lambda x: len(x[0])):
            h = np.zeros(1, U)
            for k, c in enumerate(t):
                h = Pieces.hash_step(h, np.array([ord(c)]))
                hashes.setdefault(int(h[0]), -1)
            hashes[int(h[0])] = i
        slots, values = np.zeros(1 << SLOT_BITS, U), np.full(1 << SLOT_BITS, -1, np.int64)
        for h, i in hashes.items():
            at = h >> (64 - SLOT_BITS)
            while slots[at]:
                at = (at + 1) % len(slots)
            slots[at], values[at] = h, i
        weights = np.zeros(n)
        for t, i in ids.items():
            weights[i] = math.exp(weight[t])
        sizes = np.array([len(t) for t in texts], np.int64)
        return Pieces(ids, weight, np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes, byte0, max(map(len, ids)), -alpha * math.log(n + 10), slots, values, weights)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are in the table, and their values."""
        at = (h >> U(64 - SLOT_BITS)).astype(np.int64)
        seen = self.slots[at]
        todo = np.flatnonzero((seen != h) & (seen != 0))
        while len(todo):  # the next slot, for the few that met another hash
            at[todo] = (at[todo] + 1) % len(self.slots)
            seen[todo] = self.slots[at[todo]]
            todo = todo[(seen[todo] != h[todo]) & (seen[todo] != 0)]
        known = np.flatnonzero(seen == h)
        return known, self.values[at[known]]

    def decode(self, ids) -> str:
        """The text of ids; the space that encoding puts in front is taken off."""
        ids = np.asarray(ids, np.int64)
        size = self.sizes[ids]
        end = np.cumsum(size)
        at = np.repeat(self.starts[ids] - end + size, size) + np.arange(int(end[-1]) if len(end) else 0)
        data = self.bytes[at].tobytes()
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def words_of(text: str) -> list[str]:
    if not text:
        return []
    return _WORD.findall(MARK + text.replace(MARK, LITERAL_MARK).replace(" ", MARK))


def _uniform(*parts) -> np.ndarray:
    """In (0, 1), from a hash of the parts."""
    x = U(0x9E3779B97F4A7C15)
    for p in parts:
        x = mix(np.asarray(x ^ p, U) * U(0xD1342543DE82EF95) + U(1))
    return _unit(x)


def _unit(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from 64 random bits each."""
    return ((x >> U(12)).astype(np.float64) + 0.5) * 2.0**-52


def _log_noise(seed: int, path: int, steps: np.ndarray) -> np.ndarray:
    """Logarithms of the exponential variables of some steps."""
    return np.log(-np.log(_unit(mix(steps.astype(U) * U(0x9E3779B97F4A7C15) + U((seed ^ (path + 2) * 0xD1342543DE82EF95) % 2**64)))))


class _Numbers(dict):
    """Words by the order in which they were met."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Lattices:
    """The lattices of distinct words, end to end: nodes are characters, edges are pieces, by node and length."""

    COLUMNS = {"length": np.int16, "piece": np.int32, "owner": np.int32, "key": U, "p": np.float64, "low": np.float64}

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.data = {c: np.empty(0, t) for c, t in self.COLUMNS.items()}
        self.clear()

    def clear(self) -> None:
        """Forget all words; memory is kept for the next ones."""
        self.number = _Numbers()
        self.words = self.nodes = self.edges = 0
        self.first, self.edge = np.zeros(1, np.int64), np.zeros(1, np.int64)  # first node of each word, first edge of each node
        for name, a in self.data.items():
            setattr(self, name, a[:0])

    def numbers(self, words: list[str]) -> np.ndarray:
        """The words' numbers; lattices of new words are built."""
        known = len(self.number)
        out = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if len(self.number) > known:
            self._add(list(itertools.islice(self.number, known, None)))
        return out

    def _put(self, name: str, values: np.ndarray) -> None:
        a, n = self.data[name], self.edges + len(values)
        if n > len(a):
            more = np.empty(max(n, 2 * len(a)), a.dtype)
            more[: self.edges] = a[: self.edges]
            self.data[name] = a = more
        a[self.edges : n] = values
        setattr(self, name, a[:n])

    def _add(self, words: list[str]) -> None:
        pieces = self.pieces
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        last = np.cumsum(size)
        nodes = len(text)
        room = np.repeat(last, size) - np.arange(nodes)  # characters to the end of the word
        at, h, parts, many = np.arange(nodes), np.zeros(nodes, U), [], []
        degree = np.zeros(nodes, np.int64)
        for length in range(1, pieces.longest + 1):
            fits = room[at] >= length
            at, h = at[fits], h[fits]
            h = Pieces.hash_step(h, text[at + (length - 1)])
            known, k = pieces.find(h)
            at, h = at[known], h[known]
            full = np.flatnonzero(k >= 0)
            k, here = k[full], at[full]
            if length == 1:  # characters without a piece
                none = np.ones(nodes, bool)
                none[here] = False
                odd = np.flatnonzero(none)
                here, k = np.concatenate([here, odd]), np.concatenate([k, -1 - np.where(text[odd] == ord(LITERAL_MARK), ord(MARK), text[odd])])
            parts.append((here, k, degree[here]))
            many.append(len(here))
            degree[here] += 1
            if not len(at):
                break
        edge = np.concatenate([[0], np.cumsum(degree)])
        place = np.concatenate([edge[here] + rank for here, _, rank in parts])
        start, piece, length = (np.empty(len(place), np.int64) for _ in range(3))
        start[place], piece[place] = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
        length[place] = np.repeat(np.arange(1, len(many) + 1), many)
        weight = pieces.weights[piece]
        odd = np.flatnonzero(piece < 0)
        char = -1 - piece[odd]
        weight[odd] = np.exp(pieces.fallback * (1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)))
        target = start + length
        target[length == room[start]] = nodes
        # backward sums, all words at once, by the distance of nodes from the ends of their words; a mass is
        # mass * 2 ** (power - SHIFT * distance), so that no word is too long for it
        by = np.argsort(room.astype(np.uint16) if size.max() < 1 << 16 else room, kind="stable")
        weight = weight * 2.0 ** (SHIFT * length)
        mass, power = np.ones(nodes + 1), np.zeros(nodes + 1, np.int32)
        lo = 0
        for far, hi in enumerate(np.cumsum(np.bincount(room)[1:]).tolist(), 1):
            node = by[lo:hi]
            lo = hi
            n = degree[node]
            head = np.cumsum(n) - n
            e = np.repeat(edge[node] - head, n) + np.arange(int(head[-1] + n[-1]))
            to = target[e]
            if far <= NEAR:
                mass[node] = np.add.reduceat(weight[e] * mass[to], head)
            else:
                top = np.maximum.reduceat(power[to], head)
                mass[node], more = np.frexp(np.add.reduceat(np.ldexp(weight[e] * mass[to], power[to] - np.repeat(top, n)), head))
                power[node] = top + more
        p = weight * mass[target] / mass[start]
        if lo and far > NEAR:
            p = np.ldexp(p, power[target] - power[start])
        p = np.clip(p, 1e-300, 1.0)
        p[edge[:-1][degree == 1]] = 1.0
        low = np.zeros(len(p))  # of each node's edges, added up one after another
        node = np.flatnonzero(degree > 1)
        for rank in range(1, int(degree.max())):
            e = edge[node] + rank
            low[e] = low[e - 1] + p[e - 1]
            node = node[degree[node] > rank + 1]
        cum = np.minimum(low + p, 1.0)
        cum[edge[1:] - 1] = 1.0
        start += self.nodes
        for name, values in (("length", length), ("piece", piece), ("owner", start), ("key", self.keys(start, cum)), ("p", p), ("low", low)):
            self._put(name, values)
        self.first = np.concatenate([self.first, self.nodes + last])
        self.edge = np.concatenate([self.edge, self.edges + edge[1:]])
        self.words, self.nodes, self.edges = self.words + len(words), self.nodes + nodes, self.edges + len(p)

    @staticmethod
    def keys(node: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Nodes and shares of one (rounded down to 2 ** -32) as integers in order: the same comparison at every node."""
        return (node.astype(U) << U(33)) + (share * 2.0**32).astype(U)


class Slice:
    """The lattices of some documents, end to end, and the search over them."""

    def __init__(self, texts: list[str], keys: np.ndarray, lattices: Lattices, seed: int):
        words = [words_of(t) for t in texts]
        self.size = np.array([len(w) for w in words], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.lattices = at = lattices
        self.word = at.numbers(list(itertools.chain.from_iterable(words)))
        self.edge, self.first, self.length, self.piece, self.owner = at.edge, at.first, at.length, at.piece, at.owner
        self.key, self.p, self.low = at.key, at.p, at.low
        self.last = self.first[1:][self.word]
        self.seed = mix(keys.astype(U) ^ U(seed))

    def draw(self, doc: np.ndarray, word: np.ndarray, node: np.ndarray, path: int) -> tuple[np.ndarray, np.ndarray]:
        """Paths from the nodes to the ends of their words: edges in order, and of which word each is.

        One uniform number serves ``REUSE`` steps: what is left of it, inside the chosen edge's
        interval, is uniform again.
        """
        steps, counts = [], np.zeros(len(word), np.int64)
        if not len(word):
            return counts, counts
        last = self.last[word]
        seeds = self.seed[doc] + U(path * 0xA0761D6478BD642F % 2**64)
        place = (word - self.begin[doc]).astype(U)
        at = np.argsort(node, kind="stable")  # neighbours in the lattice together: the searches stay in cache
        at = at[node[at] < last[at]]
        node, step = node[at], 0
        while len(at):
            if step % REUSE == 0:
                u = _uniform(seeds[at], place[at] * U(1 << 20) + U(step))
            e, q = self.edge[node], Lattices.keys(node, u)
            more = np.flatnonzero(self.key[e] <= q)
            while len(more):
                e[more] += 1
                more = more[self.key[e[more]] <= q[more]]
            steps.append((at, e))
            counts[at] += 1
            u = np.clip((u - self.low[e]) / self.p[e], 0.0, 1 - 2.0**-33)
            node = node + self.length[e]
            live = node < last[at]
            at, node, u = at[live], node[live], u[live]
            step += 1
        start = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(start[-1], np.int64)
        for k, (at, e) in enumerate(steps):
            out[start[at] + k] = e
        return out, np.repeat(np.arange(len(word)), counts)

    def search(self, k: int) -> list[list[tuple]]:
        """Per document its samples (edges, log-probability, perturbed value), best first, and then kappa."""
        docs = len(self.size)
        doc = np.repeat(np.arange(docs), self.size)
        edges, owner = self.draw(doc, np.arange(len(self.word)), self.first[self.word] if len(self.word) else self.word, 0)
        cut = np.searchsorted(doc[owner] if len(owner) else owner, np.arange(docs + 1))
        first = -np.log(-np.log(_uniform(self.seed, U(1), U(0xF1257))))
        heaps: list[list] = [[] for _ in range(docs)]
        found: list[list[tuple]] = [[] for _ in range(docs)]
        for d in range(docs):
            self._take(heaps[d], found[d], d, edges[cut[d] : cut[d + 1]], owner[cut[d] : cut[d + 1]] - self.begin[d], float(first[d]), 0, None, k, 0)
        for path in range(1, k):
            todo = [(d, heapq.heappop(heaps[d])) for d in range(docs) if heaps[d]]
            if not todo:
                break
            parts, starts = [], []
            for d, (value, _, source, t, out) in todo:
                e, w = found[d][source][0], found[d][source][3]
                node = int(self.owner[e[t]])
                side = [x for x in range(int(self.edge[node]), int(self.edge[node + 1])) if x not in out]
                p = self.p[side]
                u = float(_uniform(self.seed[d : d + 1], U(path), U(0xC401CE))[0])
                pick = side[min(int(np.searchsorted(np.cumsum(p) / p.sum(), u)), len(side) - 1)]
                word = int(w[t])
                parts.append((e[:t], w[:t], pick, word))
                n = int(self.size[d]) - word
                starts.append((d, word, n, node + int(self.length[pick])))
            doc = np.repeat([s[0] for s in starts], [s[2] for s in starts])
            word = np.concatenate([self.begin[s[0]] + np.arange(s[1], s[1] + s[2]) for s in starts])
            node = self.first[self.word[word]].copy()
            head = np.concatenate([[0], np.cumsum([s[2] for s in starts])])
            node[head[:-1]] = [s[3] for s in starts]
            edges, owner = self.draw(doc, word, node, path)
            cut = np.searchsorted(owner, head)
            for i, (d, (value, _, source, t, out)) in enumerate(todo):
                before, words, pick, w = parts[i]
                a, b = cut[i], cut[i + 1]
                whole = np.concatenate([before, [pick], edges[a:b]]).astype(np.int64)
                owners = np.concatenate([words, [w], owner[a:b] - head[i] + w]).astype(np.int64)
                self._take(heaps[d], found[d], d, whole, owners, -value, t, out | {pick}, k, path)
        return [[*((e, lp, g) for e, lp, g, _ in f), -h[0][0] if h else -math.inf] for f, h in zip(found, heaps)]

    def _take(self, heap: list, found: list, d: int, edges: np.ndarray, owner: np.ndarray, value: float, t: int, out: frozenset | set | None, k: int, path: int) -> None:
        """Add a path with its perturbed value, and what leaves it from edge t on to the queue."""
        lp = np.cumsum(np.log(self.p[edges])) if len(edges) else np.zeros(0)
        source = len(found)
        found.append((edges, float(lp[-1]) if len(lp) else 0.0, value, owner))
        need = k + 1 - len(found)
        if need <= 0 or t >= len(edges):
            return

        def exits(lo: int, hi: int) -> np.ndarray:
            """Logarithms of noise over mass of what leaves the path at edges lo to hi."""
            share = 1 - self.p[edges[lo:hi]]  # what the other edges of the node weigh
            if lo == t and out is not None:  # at this edge more than one piece is taken
                node = int(self.owner[edges[t]])
                left = [x for x in range(int(self.edge[node]), int(self.edge[node + 1])) if x not in out]
                share[0] = self.p[left].sum()
            some = np.flatnonzero(share > 0)
            noise, at = np.full(hi - lo, math.inf), some + lo
            before = np.where(at > 0, lp[at - 1], 0.0)
            noise[some] = _log_noise(int(self.seed[d]), path, at - t) - np.log(share[some]) - before
            return noise

        # An exit's value falls with its noise over its mass. Noise has a least value, and mass only falls along the path:
        # from the place on where even the least noise is too much, none can be among the best.
        ratio, n = exits(t, min(len(edges), t + BLOCK)), min(len(edges), t + BLOCK)
        if n < len(edges):
            bound = np.partition(ratio, need - 1)[need - 1]
            end = 1 + int(np.searchsorted(-lp, bound - LEAST_LOG_NOISE, side="right")) if bound < math.inf else len(edges)
            if min(end, len(edges)) > n:
                ratio = np.concatenate([ratio, exits(n, min(end, len(edges)))])
        best = np.argpartition(ratio, need - 1)[:need] if need < len(ratio) else np.arange(len(ratio))
        for i in sorted(best.tolist()):
            if ratio[i] < math.inf:
                taken = out if (i == 0 and out is not None) else {int(edges[t + i])}
                heapq.heappush(heap, (float(np.logaddexp(-value, ratio[i])), len(found) * 1_000_000 + i, source, t + i, frozenset(taken)))

    def ids(self, edges: np.ndarray, byte0: int) -> np.ndarray:
        piece = self.piece[edges]
        char = -1 - piece
        piece = np.where((char >= 0) & (char < 128), char + byte0, piece)
        odd = np.flatnonzero(piece < 0)
        if not len(odd):
            return piece.astype(np.int32)
        out, at = [], 0
        for i in odd.tolist():
            out.append(piece[at:i])
            out.append(np.frombuffer(chr(int(char[i])).encode("utf-8", "replace"), np.uint8).astype(np.int64) + byte0)
            at = i + 1
        return np.concatenate([*out, piece[at:]]).astype(np.int32)


def inclusion(log_prob: float, kappa: float) -> float:
    """Log-probability that a segmentation is among the k drawn, given kappa."""
    if kappa == -math.inf:
        return 0.0
    x = log_prob - kappa
    return x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700.0))))


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of texts of some ``SLICE_CHARS`` characters together, or one longer text."""
    lo = chars = 0
    for i, n in enumerate(sizes):
        if i > lo and chars + n > SLICE_CHARS:
            yield lo, i
            lo, chars = i, 0
        chars += n
    if lo < len(sizes):
        yield lo, len(sizes)


def _sample(pieces: Pieces, k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(pieces)
        for batch in batches:
            for lo, hi in _slices(pc.fill_null(pc.utf8_length(batch["text"]), 0).to_pylist()):
                texts = pc.fill_null(batch["text"].slice(lo, hi - lo), "").to_pylist()
                keys = np.array([xxhash.xxh64_intdigest(str(x), seed) for x in batch["doc_id"].slice(lo, hi - lo).to_pylist()], U)
                if lattices.nodes > KEPT_NODES:
                    lattices.clear()
                part = Slice(texts, keys, lattices, seed)
                row, number, ids, lp, value, score, same = [], [], [], [], [], [], []
                for i, (*samples, kappa) in enumerate(part.search(k)):
                    for j, (edges, p, g) in enumerate(samples):
                        x = part.ids(edges, pieces.byte0)
                        row.append(lo + i), number.append(j), ids.append(x), lp.append(p), value.append(g)
                        score.append(inclusion(p, kappa))
                        same.append(pieces.decode(x) == texts[i])
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else [], pa.int32())),
                     pa.array(lp, pa.float64()), pa.array(value, pa.float64()), pa.array(score, pa.float64()), pa.array(same, pa.bool_())],
                    ["doc_id", "sample", "ids", "log_prob", "perturbed", "log_inclusion", "round_trip"],
                )

    return run


def sample_encodings(docs: DataFrame, model: str = MODEL, k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document and sample: doc_id, sample (best perturbed value first), ids, log_prob, perturbed, log_inclusion, round_trip (whether decoding gives the text)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double, round_trip boolean"
    return rows.mapInArrow(_sample(Pieces.load(model, alpha), k, seed), ddl)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` (with ids) with the column text; null ids give an empty text."""
    pieces = Pieces.load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [pieces.decode(x or ()) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return encoded.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", text string")


def op2_piece_sampling(spark, sf_dir: str) -> DataFrame:
    out = sample_encodings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "perturbed", "log_inclusion", "round_trip")
