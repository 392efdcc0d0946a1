"""LM scoring with Elias-Fano n-gram tries (three orders), dealt over shards of contexts.

1. Every training token is counted. The most frequent words (a bounded table) get ids by rank and are broadcast with
   their counts; any other word's id is 48 bits of its hash.
2. The documents' tokens are written as batches of ids, once; all later steps read these, so a batch is the same in each.
3. A batch asks for its distinct n-grams, each with its count in the training documents: its (u, v, w) by the context word
   v, its rare words by themselves. A context too frequent for one shard is split: by u (then its pairs (v, w) are asked
   for on their own), and a pair (u, v) that is too frequent as well by w; such totals are in bounded broadcast tables. An
   n-gram comes once from a batch, however often the batch holds it.
4. A shard adds up the training counts of its n-grams and builds a trie of them: v, then u relative to v, then w relative
   to (u, v), and w relative to v. Levels are Elias-Fano sequences of word ranks, made monotone by adding what came
   before, with monotone pointers to each node's children. Leaves hold the smoothed probability a = c / (C + mu), and
   contexts the mass that they leave to the lower order, g = mu / (C + mu) (Dirichlet smoothing), quantised to 8 bits. The
   trie is written to a file of the task, memory-mapped, and answers every batch: a word is found by a successor search
   relative to its context, and what is not found leaves everything to the lower order.
5. The codes go back to their batch, in the order of its questions, and each token gets
   p(w | u, v) = a3 + g3 (a2 + g2 p(w)), with p(w) = (c + 1) / (N + V + 1) from exact counts.

The smoothing is fixed by parameters, so scores do not depend on shards or batches. All that is gathered grows with the
corpus and is spread over shards of about `shard_tokens` n-grams.

Defined results: null text: empty (one token, the end); repeated rows: each scored and counted; a null doc_id is in
training; no rows: no rows; no training rows: N = V = 0, the base formula; further columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import BLANK, LOWER, held_out, materialise, mix64, pieces, span_hashes, spans, table, text_buffer, trim

FREQUENT = 1 << 18
MASK48 = np.uint64((1 << 48) - 1)
#: Hash of the end token; no word has it, as words hash with their length.
END = np.uint64(0xE0D0E0D0E0D0E0D0)
#: Ids after the ranks of frequent words; hashed ids start above.
BEGIN_ID = FREQUENT + 1
LOWEST_HASH = np.uint64(FREQUENT + 2)
#: Dirichlet smoothing: pseudo-counts that the lower order gets in a context of one and of two words.
MU2, MU3 = 50.0, 5.0
#: Decades of the 255 quantised probabilities, from 1 down.
DECADES = 8.0


def quantise(p: np.ndarray) -> np.ndarray:
    """1 to 255: the nearest power of ten on an even grid."""
    return np.clip(np.rint(-np.log10(p) * (254 / DECADES)), 0, 254).astype(np.uint8) + np.uint8(1)


#: What a code stands for; 0: not there.
_DECODED = np.append(0.0, 10.0 ** (-np.arange(255) * (DECADES / 254)))


class EliasFano:
    """A sorted sequence of n values below a bound: low bits packed, high bits in unary."""

    def __init__(self, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, n: int, width: int):
        self.low, self.high, self.zeros, self.n, self.width = low, high, zeros, n, width  # zeros: how many are before each word

    @classmethod
    def build(cls, values: np.ndarray, bound: int) -> EliasFano:
        n = len(values)
        width = max(0, int(np.log2(max(1, bound // max(1, n)))))
        values = values.astype(np.uint64)
        low = np.zeros(n * width // 64 + 2, np.uint64)
        if width:
            part = values & np.uint64((1 << width) - 1)
            bit = np.arange(n, dtype=np.int64) * width
            word, shift = bit >> 6, (bit & 63).astype(np.uint64)
            for at, piece in ((word, part << shift), (word + 1, np.where(shift > 0, part >> np.minimum(np.uint64(64) - shift, np.uint64(63)), np.uint64(0)))):
                cut = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if n else np.empty(0, np.int64)
                if len(cut):
                    low[at[cut]] |= np.bitwise_or.reduceat(piece, cut)
        top = (values >> np.uint64(width)).astype(np.int64)
        bits = np.zeros(-(-(n + (int(bound) >> width) + 2) // 64) * 64, np.uint8)
        bits[top + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        zeros = np.append(0, np.cumsum(64 - np.bitwise_count(high).astype(np.int64)))
        return cls(low, high, zeros.astype(np.int64), n, width)

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.zeros]

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th zero of the high bits."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        return self._select(word, k - self.zeros[word], ~self.high[word])

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        word = np.searchsorted(ones, i, "right") - 1
        place = self._select(word, i - ones[word], self.high[word])
        return (place - i << self.width) + self._low(i).astype(np.int64)

    @staticmethod
    def _select(word: np.ndarray, rest: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """The place of one more set bit than `rest` in each word: halve the word, and again."""
        place = word * 64
        for width in (32, 16, 8, 4, 2, 1):
            low = bits & np.uint64((1 << width) - 1)
            count = np.bitwise_count(low).astype(np.int64)
            right = rest >= count
            rest = rest - np.where(right, count, 0)
            bits = np.where(right, bits >> np.uint64(width), low)
            place += right * width
        return place

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i * self.width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        both = (self.low[word] >> shift) | np.where(shift > 0, self.low[word + 1] << np.minimum(np.uint64(64) - shift, np.uint64(63)), np.uint64(0))
        return both & np.uint64((1 << self.width) - 1)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The index of each value, or -1: the successor of the value must be itself."""
        if not len(x):
            return np.empty(0, np.int64)
        x = x.astype(np.uint64)
        top, want = (x >> np.uint64(self.width)).astype(np.int64), x & np.uint64((1 << self.width) - 1)
        inside = top < self.zeros[-1]
        top = np.where(inside, top, 0)
        begin = np.where(top > 0, self._zero(np.maximum(top - 1, 0)) - np.maximum(top - 1, 0), 0)
        stop = self._zero(top) - top
        a, b = begin.copy(), np.minimum(stop, self.n)
        while (open_ := a < b).any():
            at = np.flatnonzero(open_)
            middle = (a[at] + b[at]) >> 1
            less = self._low(middle) < want[at]
            a[at] = np.where(less, middle + 1, a[at])
            b[at] = np.where(less, b[at], middle)
        hit = inside & (a < np.minimum(stop, self.n))
        at = np.flatnonzero(hit)
        hit[at] = self._low(a[at]) == want[at]
        return np.where(hit, a, -1)


class Level:
    """The children of a level's nodes: pointers to where each node's begin, and their ranks, each node's above those of the one before."""

    def __init__(self, pointers: EliasFano, ranks: EliasFano):
        self.parts = [pointers, ranks]

    @classmethod
    def build(cls, parent: np.ndarray, rank: np.ndarray, nodes: int, words: int) -> Level:
        """Of children sorted by parent and rank."""
        begin = np.searchsorted(parent, np.arange(nodes + 1))
        last = rank[begin[1:] - 1]  # every node has a child
        base = np.append(0, np.cumsum(last + 1))
        values = rank + base[parent]
        return cls(EliasFano.build(begin, len(rank) + 1), EliasFano.build(values, int(values[-1]) + 1 if len(values) else 1))

    def find(self, node: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The child of each node (or -1) with each rank (or -1); -1 where there is none. A run of one node finds its children's range once."""
        pointers, ranks = self.parts
        out = np.full(len(node), -1, np.int64)
        use = np.flatnonzero((node >= 0) & (rank >= 0))
        if not len(use):
            return out
        node = node[use]
        head = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        begin, end = pointers.access(node[head]), pointers.access(node[head] + 1)
        base = np.zeros(len(head), np.int64)
        later = np.flatnonzero(begin > 0)
        base[later] = ranks.access(begin[later] - 1) + 1
        run = np.diff(np.append(head, len(node)))
        at = ranks.find(rank[use] + np.repeat(base, run))
        out[use] = np.where((at >= np.repeat(begin, run)) & (at < np.repeat(end, run)), at, -1)
        return out


class Trie:
    """Words; contexts v; u relative to v; w relative to (u, v); w relative to v; and the codes of leaves and contexts."""

    def __init__(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, c: np.ndarray, total3: np.ndarray, total2: np.ndarray, own2: np.ndarray, known: np.ndarray | None = None):
        """Of distinct training n-grams sorted by (v, u, w): counts c, context totals of each, and whether the pairs (v, w) of v are all here.

        Given sorted words `known`, v, u and w are places in them.
        """
        if known is None:
            known, code = np.unique(np.concatenate([v, u, w]), return_inverse=True)
            v, u, w = code.reshape(3, -1)
        used = np.zeros(len(known), bool)
        for x in (v, u, w):
            used[x] = True
        words, rank = known[used], np.cumsum(used) - 1
        rv, ru, rw = rank[v], rank[u], rank[w]
        new = lambda *columns: np.flatnonzero(np.any([np.append(True, x[1:] != x[:-1]) for x in columns], axis=0)) if len(v) else np.empty(0, np.int64)
        one, two = new(rv), new(rv, ru)
        node1 = np.repeat(np.arange(len(one)), np.diff(np.append(one, len(v))))
        node2 = np.repeat(np.arange(len(two)), np.diff(np.append(two, len(v))))
        pair = np.argsort(node1 * len(words) + rw)
        head = np.flatnonzero(np.append(True, (node1[pair][1:] != node1[pair][:-1]) | (rw[pair][1:] != rw[pair][:-1]))) if len(v) else np.empty(0, np.int64)
        c2 = np.add.reduceat(c[pair], head) if len(v) else np.empty(0, np.int64)
        bi = pair[head]
        bound = lambda a: int(a[-1]) + 1 if len(a) else 1
        self.words, self.contexts = EliasFano.build(words, bound(words)), EliasFano.build(rv[one], bound(rv[one]))
        self.second, self.third = Level.build(node1[two], ru[two], len(one), len(words)), Level.build(node2, rw, len(two), len(words))
        self.pairs = Level.build(node1[bi], rw[bi], len(one), len(words))
        here = own2[bi]
        self.a3, self.g3 = quantise(c / (total3 + MU3)), quantise(MU3 / (total3[two] + MU3))
        self.a2, self.g2 = np.where(here, quantise(c2 / (total2[bi] + MU2)), np.uint8(0)), np.where(own2[one], quantise(MU2 / (total2[one] + MU2)), np.uint8(0))

    def mapped(self, folder: str) -> None:
        """Move the levels to a file and read them through a memory map."""
        sequences = [self.words, self.contexts, *self.second.parts, *self.third.parts, *self.pairs.parts]
        arrays = [a for e in sequences for a in e.arrays()] + [self.a3, self.g3, self.a2, self.g2]
        path = os.path.join(folder, "trie")
        with open(path, "wb") as f:
            for a in arrays:
                f.write(a.tobytes())
                f.write(b"\0" * (-a.nbytes % 8))
        at, out = 0, []
        for a in arrays:
            out.append(np.memmap(path, a.dtype, "r", at, a.shape) if a.size else a)
            at += a.nbytes + (-a.nbytes % 8)
        for k, e in enumerate(sequences):
            e.low, e.high, e.zeros = out[3 * k : 3 * k + 3]
        self.a3, self.g3, self.a2, self.g2 = out[-4:]

    def lookup(self, words: np.ndarray, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
        """Codes a3, g3, a2, g2 of questions (places of their words in `words`), sorted; 0 where the trie has no such node."""
        rank = self.words.find(words)
        first, second, third = rank[v], rank[u], rank[w]
        node1, node2 = np.full(len(v), -1, np.int64), np.full(len(v), -1, np.int64)
        if len(v):
            one = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            node = np.where(first[one] >= 0, self.contexts.find(np.maximum(first[one], 0)), -1)
            node1 = np.repeat(node, np.diff(np.append(one, len(v))))
            two = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (u[1:] != u[:-1])))
            node2 = np.repeat(self.second.find(node1[two], second[two]), np.diff(np.append(two, len(v))))
        leaves = ((self.third.find(node2, third), self.a3), (node2, self.g3), (self.pairs.find(node1, third), self.a2), (node1, self.g2))
        return [np.where(at >= 0, codes[np.maximum(at, 0)], np.uint8(0)) if len(codes) else np.zeros(len(v), np.uint8) for at, codes in leaves]


# packed blocks
def pack(*columns: np.ndarray) -> bytes:
    """Integer columns of one length as compressed byte planes, as many as each needs."""
    n, planes = len(columns[0]), []
    wide = np.zeros(16, np.uint8)
    for k, c in enumerate(columns):
        c = c.astype(np.uint64)
        wide[k] = max(1, -(-int(c.max()).bit_length() // 8)) if n else 0
        planes += [np.ascontiguousarray(p).tobytes() for p in c.view(np.uint8).reshape(-1, 8).T[: wide[k]]]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.uint64(n).tobytes(), wide.tobytes(), *planes]))


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, wide, at, out = int(raw[:8].view(np.uint64)[0]), raw[8 : 8 + columns].tolist(), 24, []
    for width in wide:
        bytes_ = np.zeros((n, 8), np.uint8)
        bytes_[:, :width] = raw[at : at + n * width].reshape(width, n).T
        out.append(bytes_.view(np.uint64).ravel())
        at += n * width
    return out


def pack_codes(columns: list[np.ndarray]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.tobytes() for c in columns))


def unpack_codes(blob: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(columns, -1)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, and how many each has."""
    data, at = text_buffer(texts)
    data = LOWER[data]
    start, end = spans(~BLANK[data], at)
    return span_hashes(data, start, end), np.diff(np.searchsorted(start, at))


def tokens(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(token hashes, rows, tokens of each, whether it goes on a text): an end follows each text; a long one comes in pieces."""
    open_ = False
    for part, rows, _, whole in pieces(texts, ~BLANK):
        hashes, count = words_of(part)
        after = np.full(1, open_) if len(rows) == 1 else np.zeros(len(rows), bool)
        if whole:
            out = np.full(len(hashes) + len(count), END, np.uint64)
            out[np.arange(len(hashes)) + np.repeat(np.arange(len(count)), count)] = hashes
            hashes, count = out, count + 1
        open_ = not whole
        yield hashes, rows, count, after


class Frequent:
    """The most frequent words: sorted hashes, the rank of each, counts by rank; totals; how hot contexts are split."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n: int, v: int, documents: int, shards: int, hot: int):
        """hot: more training tokens than this are too many for a shard."""
        order = np.argsort(hashes)
        self.hashes, self.ranks, self.counts = hashes[order], order.astype(np.uint64), counts
        self.n, self.v, self.documents, self.shards, self.hot = n, v, documents, shards, hot
        directory = np.zeros(1 << 22, bool)
        directory[(self.hashes >> np.uint64(42)).astype(np.int64)] = True
        self.directory = np.packbits(directory)
        self.pair_keys, self.pair_totals = np.empty(0, np.uint64), np.empty(0, np.int64)

    def totals(self) -> np.ndarray:
        """Training tokens after each id below LOWEST_HASH; the last two are the end, after which nothing comes, and the begin."""
        out = np.zeros(int(LOWEST_HASH), np.int64)
        out[: len(self.counts)] = self.counts
        out[BEGIN_ID] = self.documents
        return out

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = np.maximum(hashes & MASK48, LOWEST_HASH)
        slot = (hashes >> np.uint64(42)).astype(np.int64)
        maybe = np.flatnonzero(self.directory[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)
        if len(maybe) and len(self.hashes):
            spot = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            hit = self.hashes[spot] == hashes[maybe]
            out[maybe[hit]] = self.ranks[spot[hit]]
        return out

    def is_hot(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(v), bool)
        low = np.flatnonzero(v < LOWEST_HASH)
        out[low] = self.totals()[v[low].astype(np.int64)] > self.hot
        return out

    def pair(self, v: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The training total of each pair of hot words (u, v) that is too frequent for a shard, else 0."""
        out = np.zeros(len(v), np.int64)
        use = np.flatnonzero((v < LOWEST_HASH) & (u < LOWEST_HASH)) if len(self.pair_keys) else np.empty(0, np.int64)
        key = v[use] << np.uint64(32) | u[use]
        spot = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        out[use] = np.where(self.pair_keys[spot] == key, self.pair_totals[spot], 0) if len(use) else 0
        return out


def vocabulary(documents: DataFrame) -> DataFrame:
    """Written (h, c): the count of every token of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

        for batch in batches:
            for hashes, *_ in tokens(batch.column("text")):
                held.append(hashes)
                if sum(map(len, held)) > 1 << 21:
                    yield counted()
                    held = []
            trim()
        if held:
            yield counted()

    return materialise(documents.select(F.col("text").cast("string")).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))


BATCH = "batch long, docs binary, ids binary"


def _tokenised(batches: Iterator[pa.RecordBatch], frequent: Frequent, batch_tokens: int) -> Iterator[pa.RecordBatch]:
    """Batches of about batch_tokens tokens: per document (or part of one) key, doc_id, null, held_out, tokens and the two ids before; and the ids."""
    held: list[tuple] = []
    size, number, before = 0, TaskContext.get().partitionId() << 32, np.full(2, BEGIN_ID, np.uint64)

    def closed() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([pack(*columns[:-1])], pa.binary()), pa.array([pack(columns[-1])], pa.binary())], names=["batch", "docs", "ids"])

    for batch in batches:
        key, doc = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("key", "doc_id"))
        null, held_out_ = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False), batch.column("held_out").to_numpy(zero_copy_only=False)
        for hashes, rows, count, after in tokens(batch.column("text")):
            ids = frequent.ids(hashes)
            u, v = (np.where(after, x, np.uint64(BEGIN_ID)) for x in before)
            held.append((key[rows], doc[rows], null[rows], held_out_[rows], count, u, v, ids))
            before = np.append(np.array([u[-1], v[-1]]), ids[-2:])[-2:] if len(rows) == 1 else before
            size += len(ids)
            if size >= batch_tokens:
                yield closed()
                held, size, number = [], 0, number + 1
        trim()
    if held:
        yield closed()


class Tokens:
    """A batch: its documents (or parts of one), and each token w with the two before it and its document."""

    def __init__(self, docs: bytes, ids: bytes):
        self.key, self.doc, self.null, self.held_out, count, self.u0, self.v0 = unpack(docs, 7)
        (self.w,) = unpack(ids, 1)
        self.count = count.astype(np.int64)
        some = self.count > 0
        self.first, self.lead = (np.cumsum(self.count) - self.count)[some], np.flatnonzero(some)
        self.train = np.repeat(self.held_out == 0, self.count)

    @cached_property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    @cached_property
    def context(self) -> list[np.ndarray]:
        """v and u of each token: the token before it, and the one before that."""
        return self.before(self.w, self.v0, self.u0)

    def before(self, w: np.ndarray, v0: np.ndarray, u0: np.ndarray) -> list[np.ndarray]:
        """For each token what stands one and two before it, of values w of the tokens and v0, u0 before each document."""
        out = []
        for lead in (v0, u0):
            w = np.append(w[:1], w[:-1])
            w[self.first] = lead[self.lead]
            out.append(w)
        return out


class Questions(Tokens):
    """What a batch asks: for each level the distinct n-grams, their training counts, their shards, and which tokens they are for."""

    def __init__(self, docs: bytes, ids: bytes, frequent: Frequent):
        super().__init__(docs, ids)
        w, train = self.w, self.train
        words, code = np.unique(np.concatenate([w, self.v0, self.u0]), return_inverse=True)
        width = np.uint64(max(1, int(len(words)).bit_length()))
        cw, v0, u0 = np.split(code.astype(np.uint32), [len(w), len(w) + len(self.v0)])
        del code
        cv, cu = self.before(cw, v0, u0)
        hot = frequent.is_hot(words)[cv]
        salt = lambda x, k: mix64(x ^ np.uint64(k * 0x9E3779B9))

        def level(use: np.ndarray | slice, *codes: np.ndarray) -> tuple:
            joined = codes[0][use].astype(np.uint64)
            for c in codes[1:]:
                joined <<= width
                joined |= c[use]
            distinct, inverse = np.unique(joined, return_inverse=True)
            del joined
            mask = (np.uint64(1) << width) - np.uint64(1)
            columns = [words[(distinct >> (width * np.uint64(len(codes) - 1 - i)) & mask).astype(np.int64)] for i in range(len(codes))]
            n = np.bincount(inverse[train[use]], minlength=len(distinct)).astype(np.uint64)
            return use, inverse.astype(np.int32), columns, n

        self.levels = []
        use, inverse, (v3, u3, w3), n = level(slice(None), cv, cu, cw)
        home = mix64(v3)
        split = np.flatnonzero(frequent.is_hot(v3))
        home[split] += salt(u3[split], 1)
        split = split[frequent.pair(v3[split], u3[split]) > 0]
        home[split] += salt(w3[split], 2)
        self.levels.append((use, inverse, [v3, u3, w3], n, home))
        use, inverse, (v2, w2), n = level(np.flatnonzero(hot), cv, cw)
        self.levels.append((use, inverse, [v2, w2], n, mix64(v2 * np.uint64(3) + np.uint64(1)) + salt(w2, 3)))
        use, inverse, (w1,), n = level(np.flatnonzero(w >= LOWEST_HASH), cw)
        self.levels.append((use, inverse, [w1], n, salt(w1, 4)))
        self.levels = [(use, inverse, columns, n, (mix64(home) % np.uint64(frequent.shards)).astype(np.int64)) for use, inverse, columns, n, home in self.levels]

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(level, shard, which of the level's n-grams) for each shard that is asked."""
        for k, (_, _, _, _, shard) in enumerate(self.levels):
            order = np.argsort(shard, kind="stable")
            edge = np.flatnonzero(np.append(True, np.diff(shard[order]) > 0)) if len(order) else np.empty(0, np.int64)
            for a, b in zip(edge.tolist(), np.append(edge, len(order))[1:].tolist(), strict=True):
                yield k, int(shard[order[a]]), order[a:b]


BLOCK = "level int, shard int, batch long, payload binary"


def _asked(batches: Iterator[pa.RecordBatch], frequent: Frequent) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            asked = Questions(r["docs"], r["ids"], frequent)
            rows = [(k, s, pack(*(c[at] for c in asked.levels[k][2]), asked.levels[k][3][at])) for k, s, at in asked.blocks()]
            kinds = [pa.int32(), pa.int32(), pa.binary()]
            level, shard, payload = (pa.array([x[i] for x in rows], kinds[i]) for i in range(3))
            yield pa.RecordBatch.from_arrays([level, shard, pa.array([r["batch"]] * len(rows), pa.int64()), payload], names=["level", "shard", "batch", "payload"])
            trim()


def _joined(columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The words of some n-grams; the distinct n-grams in order as places in these; and which one each row is. Takes the columns out of the list."""
    words, many = np.unique(np.concatenate([np.unique(c) for c in columns])), len(columns)
    width = np.uint64(max(1, len(words).bit_length()))
    key = np.zeros(len(columns[0]), np.uint64)
    while columns:
        key <<= width
        key |= np.searchsorted(words, columns.pop(0)).astype(np.uint64)
    distinct, inverse = np.unique(key, return_inverse=True)
    del key
    mask = (np.uint64(1) << width) - np.uint64(1)
    return words, [(distinct >> (width * np.uint64(many - 1 - i)) & mask).astype(np.int64) for i in range(many)], inverse


def _by_run(x: np.ndarray, n: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """The sum of n over each run of equal x (and more), for each row."""
    run = np.cumsum(np.any([np.append(True, c[1:] != c[:-1]) for c in (x, *more)], axis=0)) - 1 if len(x) else np.empty(0, np.int64)
    return np.bincount(run, n).astype(np.int64)[run] if len(x) else np.empty(0, np.int64)


def _answered(rows: pa.Table, frequent: Frequent) -> pa.Table:
    """All blocks of a shard: build its trie, then answer each block from it."""
    level = rows["level"][0].as_py()
    width = (4, 3, 2)[level]
    blobs = rows["payload"].to_pylist()
    parts = [unpack(b, width) for b in blobs]
    edges = np.append(0, np.cumsum([len(p[0]) for p in parts]))
    *columns, n = (np.concatenate([p[i] for p in parts]) for i in range(width))
    del blobs, parts
    words, asked, inverse = _joined(columns)  # an n-gram that many batches ask for is one question
    del columns
    n = np.bincount(inverse, n, len(asked[0])).astype(np.int64)
    if level == 2:  # rare words: exact counts
        answers = [pack(n[inverse[a:b]]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    else:
        if level == 1:  # pairs of a hot context
            asked.insert(1, np.zeros(len(n), np.int64))
        known = np.flatnonzero(n)
        places = [c[known] for c in asked]
        v, u = (words[x] for x in places[:2])
        c = n[known]
        if level == 1:
            total3, total2, own2 = c, frequent.totals()[v.astype(np.int64)], np.ones(len(v), bool)
        else:
            pair = frequent.pair(v, u)
            total3 = np.where(pair > 0, pair, _by_run(v, c, u))
            total2, own2 = _by_run(v, c), ~frequent.is_hot(v)
        with tempfile.TemporaryDirectory() as folder:
            trie = Trie(*places, c, total3, total2, own2, words)
            trie.mapped(folder)
            del v, u, places, c, n, total2, total3, own2
            codes = trie.lookup(words, *asked)[2 * level :]
            del trie
        answers = [pack_codes([x[inverse[a:b]] for x in codes]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    trim()
    return pa.table([rows["level"], rows["shard"], rows["batch"], pa.array(answers, pa.binary())], names=["level", "shard", "batch", "payload"])


SCORED = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(batch: pa.Table, answers: pa.Table, frequent: Frequent) -> pa.Table:
    """The sums of each document (or part of one) of a batch."""
    asked = Questions(batch["docs"][0].as_py(), batch["ids"][0].as_py(), frequent)
    known = {(r["level"], r["shard"]): r["payload"] for r in answers.select(["level", "shard", "payload"]).to_pylist()}
    found = [np.zeros((k, len(n)), kind) for k, kind, (_, _, _, n, _) in zip((4, 2, 1), (np.uint8, np.uint8, np.int64), asked.levels, strict=True)]
    for k, shard, at in asked.blocks():
        found[k][:, at] = unpack(known[(k, shard)], 1) if k == 2 else unpack_codes(known[(k, shard)], len(found[k]))
    tokens_ = len(asked.w)
    codes = np.zeros((4, tokens_), np.uint8)
    codes[:, asked.levels[0][0]] = found[0][:, asked.levels[0][1]]
    codes[2:, asked.levels[1][0]] = found[1][:, asked.levels[1][1]]
    c1 = np.zeros(tokens_, np.int64)
    often = asked.w < LOWEST_HASH
    c1[often] = frequent.counts[asked.w[often].astype(np.int64)]
    c1[asked.levels[2][0]] = found[2][0][asked.levels[2][1]]
    p1 = (c1 + 1.0) / (frequent.n + frequent.v + 1.0)
    a3, g3, a2, g2 = codes
    # what a split context leaves is the same in all its shards, also in those without one of its n-grams
    hot = asked.levels[1][0]
    v, u = (x[hot] for x in asked.context)
    g2[hot] = quantise(MU2 / (frequent.totals()[v.astype(np.int64)] + MU2))
    pair = frequent.pair(v, u)
    g3[hot[pair > 0]] = quantise(MU3 / (pair[pair > 0] + MU3))
    left = lambda g: np.where(g > 0, _DECODED[g], 1.0)  # noqa: E731  an unseen context leaves all
    p2 = np.minimum(1.0, _DECODED[a2] + left(g2) * p1)
    p3 = np.minimum(1.0, _DECODED[a3] + left(g3) * p2)
    n = len(asked.key)
    add = lambda x: np.bincount(asked.owner, x, n)
    doc = pa.array(asked.doc.view(np.int64), mask=asked.null.astype(bool))
    return pa.table([pa.array(asked.key.view(np.int64)), doc, pa.array(asked.held_out > 0), pa.array(asked.count), pa.array(add(c1 > 0).astype(np.int64)), pa.array(add(np.log10(p1))), pa.array(add(np.log10(p3)))], names=["key", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def _hot_pairs(batches: Iterator[pa.RecordBatch], frequent: Frequent) -> Iterator[pa.RecordBatch]:
    """(v, u, n): the training tokens of a batch after each pair of hot words."""
    for batch in batches:
        for r in batch.to_pylist():
            t = Tokens(r["docs"], r["ids"])
            v, u = t.context
            hot = np.flatnonzero(t.train & frequent.is_hot(v))
            hot = hot[frequent.is_hot(u[hot])]
            key, n = np.unique(v[hot] << np.uint64(32) | u[hot], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])
            trim()


def score(documents: DataFrame, shard_tokens: int = 1_000_000, batch_tokens: int = 1_200_000) -> DataFrame:
    """Of rows (doc_id, text, held_out): trained on those not held out, all scored; with train_tokens."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("held_out"))
    known = vocabulary(rows.where("not held_out"))
    n, v = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = known.where(F.col("h") == int(END.astype(np.int64))).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    best = known.where(F.col("h") != int(END.astype(np.int64))).orderBy(F.desc("c"), "h").limit(FREQUENT - 1).toArrow()
    # the end token comes first: it always has a rank
    hashes = np.append(END, best["h"].to_numpy().view(np.uint64)).astype(np.uint64)
    counts = np.append(ends, best["c"].to_numpy()).astype(np.int64)
    shards = max(1, -(-(n * 7 // 6) // shard_tokens))  # about all tokens, as a seventh is held out
    hot = max(shard_tokens // 2, n >> 18)  # so there are at most 2^18 hot pairs
    frequent = Frequent(hashes, counts, n, v, ends, shards, hot)
    spread = lambda: spark.sparkContext.broadcast(vars(frequent))  # noqa: E731  plain arrays: workers need no installed copy

    def of(shared) -> Frequent:
        out = Frequent.__new__(Frequent)
        out.__dict__.update(shared.value)
        return out

    first = spread()
    keyed = rows.withColumn("key", F.monotonically_increasing_id())
    batches = materialise(keyed.mapInArrow(lambda b: _tokenised(b, of(first), batch_tokens), BATCH))
    if (frequent.totals() > hot).any():
        pairs = batches.mapInArrow(lambda b: _hot_pairs(b, of(first)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > hot).orderBy("key").toArrow()
        frequent.pair_keys, frequent.pair_totals = pairs["key"].to_numpy().view(np.uint64), pairs["n"].to_numpy().astype(np.int64)
    shared = spread()
    asked = batches.mapInArrow(lambda b: _asked(b, of(shared)), BLOCK)
    answers = asked.groupBy("level", "shard").applyInArrow(lambda t: _answered(t, of(shared)), BLOCK)
    parts = batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(lambda a, b: _scored(a, b, of(shared)), SCORED)
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    whole = parts.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *sums)
    return whole.drop("key").withColumn("train_tokens", F.lit(n).cast("long"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id"), 7, 2).alias("held_out"))
    return score(documents)
