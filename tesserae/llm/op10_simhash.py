"""SimHash near-duplicates by Golay-code fuzzy hashing.

A document's fingerprint takes the majority of each of the 64 bits over the XXH64
values (seed 42) of its word shingles. The fingerprint is cut into segments of
23, 23 and 18 bits. The perfect binary Golay code [23, 12, 7] puts every segment
within 3 bits of one codeword, and those 3 bits away within 4 bits of 5 more; two
segments that differ in at most 2 bits share one of these codewords. With at
most 4 differing bits over three segments, the two closest segments differ in at
most 2 bits together, so two linked fingerprints share a key made of a codeword of
one segment and a codeword of another. Keys find candidates; the bits decide.

Equal fingerprints are folded before keys are made, so copies cost one node. Key
groups are streamed through sorted partitions; each gives a star per connected
part, never all its pairs. A key group beyond `group_limit` is dealt out as pairs
of blocks to many tasks, which is exact too. Components are closed with large-star
and small-star rounds, each written to the shared folder.

Defined results: null or blank text: fingerprint zero; a null `doc_id` is linked by
its text but is never a component id (null only if no member has an id); repeated
rows: one row each; no rows: no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import BLANK, LOWER, materialise, mix64, pieces, salted_join, span_hashes, spans, table, text_buffer, trim

SEGMENTS = ((0, 23), (23, 23), (46, 18))
MAX_BITS = 4
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a generator of the binary Golay code.
GENERATOR = 0b110001110101
#: Most keys of a segment: the codewords within 4 bits.
NEARBY = 6


def _remainders(words: np.ndarray) -> np.ndarray:
    words = words.astype(np.int64)
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ (GENERATOR << (bit - 11)), words)
    return words


def _error_patterns() -> np.ndarray:
    """For each syndrome the error patterns of at most 4 bits with it, the lightest first; -1: no more."""
    from itertools import combinations

    table = np.full((1 << 11, NEARBY), -1, np.int64)
    filled = np.zeros(1 << 11, np.int64)
    for weight in range(MAX_BITS + 1):
        patterns = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)], np.int64)
        for pattern, syndrome in zip(patterns.tolist(), _remainders(patterns).tolist(), strict=True):
            table[syndrome, filled[syndrome]] = pattern
            filled[syndrome] += 1
    return table


_PATTERNS: list[np.ndarray] = []


def nearby_codewords(segments: np.ndarray) -> np.ndarray:
    """The 12-bit indices of the codewords within 4 bits of each 23-bit segment, or -1."""
    if not _PATTERNS:
        _PATTERNS.append(_error_patterns())
    errors = _PATTERNS[0][_remainders(segments)]
    return np.where(errors >= 0, (segments[:, None] ^ errors) >> 11, -1)


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (key, which fingerprint) of some fingerprints (uint64)."""
    near = [nearby_codewords((prints >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1)) for shift, bits in SEGMENTS]
    keys, owners = [], []
    for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        both = near[i][:, :, None] << 12 | near[j][:, None, :]
        fit = (near[i][:, :, None] >= 0) & (near[j][:, None, :] >= 0)
        owner, _, _ = np.nonzero(fit)
        keys.append(both[fit] | tag << 24)
        owners.append(owner)
    return np.concatenate(keys), np.concatenate(owners)


def _words(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts and ends, and the first word of each shingle and the number of shingles of each text."""
    data, at = text_buffer(texts)
    data = LOWER[data]
    start, end = spans(~BLANK[data], at)
    before = np.searchsorted(start, at)
    count = np.diff(before)
    shingles = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    first = np.arange(int(shingles.sum())) + np.repeat(before[:-1] - (np.cumsum(shingles) - shingles), shingles)
    return data, start, end, first, shingles


def xx_hashes(texts: pa.Array, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each shingle, and how many each text has; a text of fewer words is one shingle."""
    data, start, end, first, shingles = _words(texts, words)
    if not len(start):
        return np.empty(0, np.uint64), shingles
    # words with one space between: each goes to its place in a new buffer
    size = end - start
    stop = np.cumsum(size + 1)
    begin = stop - size - 1
    joined = np.full(int(stop[-1]), 0x20, np.uint8)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    joined[inner + np.repeat(begin, size)] = data[inner + np.repeat(start, size)]
    stop -= 1
    last = first + np.minimum(np.repeat(np.searchsorted(start, text_buffer(texts)[1][1:]), shingles) - first, words) - 1
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((digest(raw[a:b], seed) for a, b in zip(begin[first].tolist(), stop[last].tolist(), strict=True)), np.uint64, len(first)), shingles


def shingled(texts: pa.Array, words: int, hashes: Callable) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, shingle hashes, how many each row has), some whole texts at a time; a long text is hashed in pieces."""
    held: list[np.ndarray] = []
    for part, rows, _, whole in pieces(texts, ~BLANK, words - 1):
        values, count = hashes(part, words)
        if held or not whole:
            held.append(values)
            if not whole:
                continue
            values = np.concatenate(held)
            count, held = np.array([len(values)]), []
        yield rows, values, count


def _distinct(values: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each row, each once and in order."""
    owner = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.append(True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1]))[: len(values)]
    return values[new], np.bincount(owner[new], minlength=len(count))


def majority(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The bits that are set in over half the values of each row."""
    out = np.zeros(len(count), np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    edge = np.append(0, np.cumsum(count[full]))
    votes = np.zeros((len(full), 64), np.int64)
    for a in range(0, len(values), 1 << 16):  # 64 bytes a shingle at a time
        b = min(a + (1 << 16), len(values))
        bits = np.unpackbits(values[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        here = slice(int(np.searchsorted(edge, a, "right")) - 1, int(np.searchsorted(edge, b, "left")))
        cuts = np.append(np.maximum(edge[here], a), b) - a
        for row, (low, high) in enumerate(pairwise(cuts.tolist()), here.start):
            votes[row] += bits[low:high].sum(0, dtype=np.int32)
    out[full] = np.packbits(2 * votes > count[full][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def simhash(texts: pa.Array, words: int, seed: int = 42, distinct: bool = False) -> np.ndarray:
    """The 64-bit fingerprint of each text; `distinct` counts each shingle of a text once."""
    out = np.zeros(len(texts), np.uint64)
    for rows, values, count in shingled(texts, words, lambda part, n: xx_hashes(part, n, seed)):
        out[rows] = majority(*(_distinct(values, count) if distinct else (values, count)))
    return out


def fingerprints(documents: DataFrame, words: int = 4, seeds: tuple[int, ...] = (42,), distinct: bool = False) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row; with several seeds fp0, fp1, ..."""
    names = ["fp"] if len(seeds) == 1 else [f"fp{i}" for i in range(len(seeds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [pa.array(simhash(batch.column("text"), words, seed, distinct).view(np.int64)) for seed in seeds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *prints], names=["doc_id", *names])
            trim()

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def stars(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of as many fingerprints each (runs x size): links from the first of each connected part to its others, and their rows."""
    runs, size = groups.shape
    near = np.bitwise_count(groups[:, :, None] ^ groups[:, None, :]) <= MAX_BITS
    label = np.broadcast_to(np.arange(size), (runs, size))
    while True:
        new = np.where(near, label[:, None, :], size).min(2)
        if (new == label).all():
            break
        label = new
    row, col = np.nonzero(label != np.arange(size))
    return groups[row, label[row, col]], groups[row, col], row


def star(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one large group, a block of rows at a time."""
    label = np.arange(len(prints))
    step = max(1, 4_000_000 // max(1, len(prints)))
    while True:
        new = label.copy()
        for a in range(0, len(prints), step):
            near = np.bitwise_count(prints[a : a + step, None] ^ prints[None, :]) <= MAX_BITS
            new[a : a + step] = np.where(near, label[None, :], len(prints)).min(1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(prints)))
    return prints[label[other]], prints[other]


#: part: which of a document's fingerprints; key: of the rows of a group that is too large for one task.
LINKS = "part int, a long, b long, key int"


def _links_of_sorted(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Links of the key groups of a sorted partition; groups over the limit come out as (fp, fp, key) instead."""

    def out(part, a, b, key=None):
        parts = pa.array(np.broadcast_to(np.asarray(part) >> 26, len(a)).astype(np.int32))
        return pa.RecordBatch.from_arrays([parts, pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(len(a), pa.int32()) if key is None else pa.array(np.full(len(a), key, np.int32))], names=["part", "a", "b", "key"])

    held_key, held, over = None, np.empty(0, np.uint64), False

    def close() -> Iterator[pa.RecordBatch]:
        if over:
            yield out(held_key, held, held, held_key)
        elif len(held) > 1:
            yield out(held_key, *star(np.unique(held)))

    for batch in batches:
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        prints = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(keys):
            continue
        edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(edge, len(keys)))
        if held_key is not None and keys[0] == held_key:
            held = np.concatenate([held, prints[: size[0]]])
            if len(held) > limit:
                yield out(held_key, held, held, held_key)
                held, over = held[:0], True
            edge, size = edge[1:], size[1:]
        if not len(edge):
            continue
        if held_key is not None:
            yield from close()
        held_key, over = int(keys[edge[-1]]), False
        held = prints[edge[-1] :].copy()
        edge, size = edge[:-1], size[:-1]
        for n in np.unique(size[size > 1]).tolist():
            at = edge[size == n]
            if n > limit:
                for i in at.tolist():
                    yield out(keys[i], prints[i : i + n], prints[i : i + n], int(keys[i]))
            elif n > 512:
                for i in at.tolist():
                    yield out(keys[i], *star(prints[i : i + n]))
            else:
                step = max(1, 2_000_000 // (n * n))
                for i in range(0, len(at), step):
                    a, b, row = stars(prints[at[i : i + step, None] + np.arange(n)])
                    yield out(keys[at[i : i + step]][row], a, b)
    if held_key is not None:
        yield from close()


def link_stars(distinct: DataFrame, group_limit: int = 4096) -> DataFrame:
    """Of distinct (part, fp): links (part, a, b) that span the connected parts of the graph of at most 4 differing bits."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            parts = batch.column("part").to_numpy(zero_copy_only=False).astype(np.int64)
            for a in range(0, len(prints), 4096):
                keys, owner = golay_keys(prints[a : a + 4096])
                keys = keys | parts[a : a + 4096][owner] << 26
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(prints[a : a + 4096][owner].view(np.int64))], names=["key", "fp"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _links_of_sorted(batches, group_limit)

    keys = distinct.select("part", "fp").mapInArrow(keyed, "key int, fp long")
    found = materialise(keys.repartition("key").sortWithinPartitions("key").mapInArrow(linked, LINKS))
    links = found.where("key is null").select("part", "a", "b")
    large = found.where("key is not null").select("key", F.col("a").alias("fp"))
    if not large.isEmpty():
        links = links.unionByName(_links_of_large(large, group_limit))
    return links.distinct()


def _links_of_large(large: DataFrame, limit: int) -> DataFrame:
    """Each pair of blocks of a large key group goes to a task of its own."""
    blocks = large.groupBy("key").agg(F.ceil(F.count("*") / limit).cast("int").alias("n"))
    one = large.hint("shuffle_merge").join(blocks, "key").withColumn("i", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    pair = one.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = pair.select("key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "fp")

    def linked(group: pa.Table) -> pa.Table:
        a, b = star(np.unique(group["fp"].to_numpy().view(np.uint64)))
        part = np.full(len(a), group["key"][0].as_py() >> 26, np.int32)
        return pa.table({"part": part, "a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("key", "i", "j").applyInArrow(linked, "part int, a long, b long")


def _with_least(edges: DataFrame, hub: int) -> DataFrame:
    """Edges (a, b) with the least b of each a as m. The few a with over `hub` edges are broadcast, so no task holds all of one."""
    least = materialise(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
    hubs = least.where(F.col("n") > hub).select("a", "m")
    few = edges.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(least.select("a", "m").hint("shuffle_merge"), "a")
    return few.unionByName(edges.join(F.broadcast(hubs), "a"))


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for every node of the links, by large-star and small-star rounds."""

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = digest(edges)
    while True:
        hub = max(1000, seen[0] // 20_000)  # so there are at most 40,000 of them
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = materialise(_with_least(both, hub).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct())
        small = _with_least(large, hub)
        edges = materialise(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = digest(edges)
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def component_ids(prints: DataFrame) -> DataFrame:
    """doc_id, fp and component_id for each row of written fingerprints."""
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = materialise(components(link_stars(nodes.withColumn("part", F.lit(0)))))
    named = nodes.join(roots.hint("shuffle_merge"), nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = materialise(named.join(least.hint("shuffle_merge"), "root").select("fp", "component_id"))
    return prints.join(labels.hint("shuffle_merge"), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(documents: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each document."""
    found = component_ids(materialise(fingerprints(documents, words)))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Fingerprints of the stage that drops near copies: distinct word pairs, under three seeds.
DROP_WORDS, DROP_SEEDS = 2, (42, 43, 44)
#: The way for pairs whose fingerprints differ in more bits: least hashes of the shingle set, in bands of rows. Two sets
#: of Jaccard similarity j share none of the bands with a probability of (1 - j^4)^24: 3 in a million at 0.8, whatever
#: their sizes.
BANDS, ROWS = 24, 4
_FACTORS = np.random.default_rng(2024).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def set_hashes(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each shingle, and how many each text has."""
    data, start, end, first, shingles = _words(texts, words)
    if not len(start):
        return np.empty(0, np.uint64), shingles
    word = span_hashes(data, start, end)
    size = np.minimum(np.repeat(np.searchsorted(start, text_buffer(texts)[1][1:]), shingles) - first, words)
    values = size.astype(np.uint64)
    for i in range(words):
        here = word[np.minimum(first + i, len(word) - 1)]
        values = np.where(i < size, mix64(values * np.uint64(0x9E3779B97F4A7C15) + here), values)
    return values, shingles


def drop_prints(texts: pa.Array) -> np.ndarray:
    """A fingerprint of each text's distinct shingles of DROP_WORDS words for each of DROP_SEEDS; the shingles are hashed once."""
    out = np.zeros((len(texts), len(DROP_SEEDS)), np.uint64)
    for rows, values, count in shingled(texts, DROP_WORDS, set_hashes):
        values, count = _distinct(values, count)
        for k, seed in enumerate(DROP_SEEDS):
            out[rows, k] = majority(mix64(values ^ np.uint64(seed * 0x9E3779B9)), count)
    return out


def _set_digests(values: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, as two signed longs."""
    out = np.zeros((2, len(count)), np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        edge = np.append(0, np.cumsum(count[full])[:-1])
        out[0, full] = np.add.reduceat(mix64(values), edge)
        out[1, full] = np.bitwise_xor.reduceat(mix64(values ^ np.uint64(0x5851F42D4C957F2D)), edge)
    return out[0].view(np.int64), out[1].view(np.int64)


def least_hashes(values: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A signed long for each band of each set, and 32 bits of each least hash (an empty set: zeros)."""
    out, low = np.zeros((len(count), BANDS), np.uint64), np.zeros((len(count), BANDS * ROWS), np.uint32)
    full = np.flatnonzero(count)
    if len(full):
        edge = np.append(0, np.cumsum(count[full])[:-1])
        for band in range(BANDS):
            key = np.full(len(full), band, np.uint64)
            for k in range(band * ROWS, band * ROWS + ROWS):
                least = np.minimum.reduceat(values * _FACTORS[k], edge)  # the values are mixed, and a product's high bits depend on all of theirs
                low[full, k] = (least >> np.uint64(20)).astype(np.uint32)
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + least)
            out[full, band] = key
    return out.view(np.int64), low


def sketches(documents: DataFrame, words: int) -> DataFrame:
    """doc_id and a hash of the text, digest of the shingle set (d1, d2), its size n, the fingerprints, the bands of least hashes, and the least hashes, of each row with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, n = batch.column("text"), batch.num_rows
            prints = drop_prints(text)
            digests, sizes, bands, mins = np.zeros((2, n), np.int64), np.zeros(n, np.int32), np.zeros((n, BANDS), np.int64), np.zeros((n, BANDS * ROWS), np.uint32)
            for rows, values, count in shingled(text, words, set_hashes):
                values, count = _distinct(values, count)
                digests[:, rows], sizes[rows] = _set_digests(values, count), count
                bands[rows], mins[rows] = least_hashes(values, count)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(digests[0]), pa.array(digests[1]), pa.array(sizes), _lists(prints), _lists(bands), pa.array([m.tobytes() for m in mins], pa.binary())], names=["doc_id", "version", "d1", "d2", "n", "prints", "bands", "mins"])
            trim()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return rows.withColumn("version", F.xxhash64("text")).mapInArrow(run, "doc_id long, version long, d1 long, d2 long, n int, prints array<long>, bands array<long>, mins binary")


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel().view(np.int64)))


def candidate_groups(nodes: DataFrame) -> DataFrame:
    """Written (gid, doc_id, n) of written sketches: who may be similar to whom, as groups and never as pairs.

    A group is a connected part of a Golay key group (of at most 4 differing bits in one fingerprint), or a band of
    least hashes.
    """
    prints = materialise(nodes.select("doc_id", "n", F.posexplode("prints").alias("part", "fp")))
    distinct = materialise(prints.groupBy("part", "fp").agg(F.count("*").alias("many")))
    stars_ = link_stars(distinct.select("part", "fp"))
    members = stars_.select("part", "a", F.col("b").alias("fp")).unionByName(stars_.select("part", "a", F.col("a").alias("fp")))
    members = members.unionByName(distinct.where("many > 1").select("part", F.col("fp").alias("a"), "fp")).distinct()
    linked = members.hint("shuffle_merge").join(prints.hint("shuffle_merge"), ["part", "fp"]).select(F.xxhash64(F.lit("print"), "part", "a").alias("gid"), "doc_id", "n")
    banded = nodes.select("doc_id", "n", F.posexplode("bands").alias("band", "key")).select(F.xxhash64(F.lit("band"), "band", "key").alias("gid"), "doc_id", "n")
    return _shared(materialise(linked.unionByName(banded).distinct()))


def _shared(groups: DataFrame) -> DataFrame:
    """Of written groups those of two members or more, written."""
    some = groups.groupBy("gid").agg(F.count("*").alias("many")).where("many > 1").select("gid")
    return materialise(groups.hint("shuffle_merge").join(some.hint("shuffle_merge"), "gid", "left_semi"))


def shingle_table(documents: DataFrame, nodes: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """Written (doc_id, s): the shingle sets of some ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values, count in shingled(batch.column("text"), words, set_hashes):
                values, count = _distinct(values, count)
                d1, d2 = _set_digests(values, count)
                s = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(d1), pa.array(d2), s], names=["doc_id", "d1", "d2", "s"])
            trim()

    linked = materialise(ids.join(nodes.select("doc_id", "own", "d1", "d2").hint("shuffle_merge"), "doc_id"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = texts.hint("shuffle_merge").join(linked.select(F.col("own").alias("doc_id")).hint("shuffle_merge"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "doc_id long, d1 long, d2 long, s array<long>")
    # of rows with one id, the one that was sketched
    sets = sets.withColumnRenamed("doc_id", "own").hint("shuffle_merge").join(linked.hint("shuffle_merge"), ["own", "d1", "d2"])
    return materialise(sets.groupBy("doc_id").agg(F.first("s").alias("s")))


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the written pairs (a, b) whose shingle sets have the similarity, written."""
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("s").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    alike = shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared)
    with_right = materialise(salted_join(pairs, right, "b"))
    return materialise(salted_join(with_right, left, "a").where(alike).select("a", "b"))


def _fits(similarity: float) -> Column:
    """Whether the sizes of two sets allow the similarity."""
    return F.least("a_n", "b_n") >= F.lit(similarity) * F.greatest("a_n", "b_n") - 1e-6


#: Least hashes (of 96) that a pair must share to be tested: of pairs with a similarity of 0.8, 2 in a million share fewer.
LEAST_SHARED = 58


def close_pairs(groups: DataFrame, nodes: DataFrame, similarity: float, limit: int = 1024) -> DataFrame:
    """Distinct pairs (a, b) of a group that share LEAST_SHARED least hashes, compared in blocks within tasks: no other pair
    is ever a row. A group of more than `limit` members is dealt out as pairs of blocks. A pair comes from one of its groups
    alone, that of the smallest gid, and from one pair of blocks."""
    size = groups.groupBy("gid").agg(F.count("*").alias("many"), F.ceil(F.count("*") / limit).cast("int").alias("blocks"))
    size = materialise(size.where("many > 1").drop("many"))
    some = materialise(groups.hint("shuffle_merge").join(size.hint("shuffle_merge"), "gid"))
    all_of = some.groupBy("doc_id").agg(F.collect_list("gid").alias("gids"))
    known = materialise(all_of.hint("shuffle_merge").join(nodes.select("doc_id", "mins").hint("shuffle_merge"), "doc_id"))
    one = some.hint("shuffle_merge").join(known.hint("shuffle_merge"), "doc_id").withColumn("i", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    both = one.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lower = F.filter("gids", lambda g: g < F.col("gid")).alias("lower")
    dealt = both.select("gid", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.col("i").alias("own"), "doc_id", "n", "mins", lower)

    def pairs(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("doc_id")
        ids, n, own = (group[c].to_numpy() for c in ("doc_id", "n", "own"))
        alone = group["i"][0].as_py() == group["j"][0].as_py()
        mins = np.frombuffer(b"".join(group["mins"].to_pylist()), np.uint32).reshape(len(ids), -1).T.copy()
        others = group["lower"].combine_chunks()
        at, gids = np.append(0, np.cumsum(others.value_lengths().to_numpy())), others.flatten().to_numpy()
        left, right = [], []
        for a in range(len(ids) - 1):
            fits = np.minimum(n[a], n[a + 1 :]) >= similarity * np.maximum(n[a], n[a + 1 :]) - 1e-6
            near = a + 1 + np.flatnonzero(fits & (alone | (own[a + 1 :] != own[a])) & ((mins[:, a, None] == mins[:, a + 1 :]).sum(0) >= LEAST_SHARED))
            mine = set(gids[at[a] : at[a + 1]].tolist())
            near = np.array([b for b in near.tolist() if mine.isdisjoint(gids[at[b] : at[b + 1]].tolist())], np.int64) if mine else near
            left.append(np.full(len(near), ids[a]))
            right.append(ids[near])
        empty = [np.empty(0, np.int64)]
        return pa.table({"a": np.concatenate(left or empty), "b": np.concatenate(right or empty)})

    return dealt.groupBy("gid", "i", "j").applyInArrow(pairs, "a long, b long")


def losers(groups: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float, few: int = 1) -> list[DataFrame]:
    """The ids that are similar to a smaller id which stays, of written groups; ids are judged in rising order.

    In each round those of the `few` smallest ids of each group, twice as many as in the round before, that are among them
    in all their groups are ready to be judged: they go or stay. Only they can make a member go, so only groups with such
    a head meet their members, and a member is tested against these; a ready id is tested against the other heads too, as
    it has to wait for one that it is similar to. In the first round most of a group of near copies goes with its
    smallest id; a group of thousands goes in a few rounds. Once a round takes less than a tenth of the ids, those left
    are together by chance: they are compared by their least hashes within tasks, and the few close pairs are tested.
    """
    gone, ids = [], groups.select("doc_id").distinct().count()
    while ids:
        rank = F.row_number().over(Window.partitionBy("gid").orderBy("doc_id"))
        top = materialise(groups.withColumn("rank", rank).where(F.col("rank") <= few + 1))  # one more tells a group of heads alone
        if top.where("rank > 1").isEmpty():
            break
        own = groups.groupBy("doc_id").agg(F.count("*").alias("many"))
        led = top.where(F.col("rank") <= few).groupBy("doc_id").agg(F.count("*").alias("many"))
        ready = materialise(led.hint("shuffle_merge").join(own.hint("shuffle_merge"), ["doc_id", "many"]).select("doc_id"))
        marked = top.hint("shuffle_merge").join(ready.withColumn("ready", F.lit(True)).hint("shuffle_merge"), "doc_id", "left")
        head = F.when(F.col("rank") <= few, F.struct(F.col("doc_id").alias("a"), F.col("n").alias("a_n"), F.col("ready").isNotNull().alias("ready")))
        heads = marked.groupBy("gid").agg(F.collect_list(head).alias("heads"), F.max("rank").alias("most"))
        heads = materialise(heads.where((F.col("most") > 1) & F.exists("heads", lambda h: h["ready"])).drop("most"))
        # one row a member of a group with a ready head, with its heads; then one row an id, with the heads of all its groups
        met = salted_join(groups, heads, "gid").groupBy("doc_id", "n").agg(F.array_distinct(F.flatten(F.collect_list("heads"))).alias("heads"))
        met = met.withColumn("may", F.exists("heads", lambda h: h["ready"] & (h["a"] == F.col("doc_id"))))
        met = met.select(F.filter("heads", lambda h: (h["a"] < F.col("doc_id")) & (h["ready"] | F.col("may"))).alias("heads"), F.col("doc_id").alias("b"), F.col("n").alias("b_n"))
        tried = met.select(F.explode("heads").alias("head"), "b", "b_n").select("head.a", "head.a_n", "b", "b_n").where(_fits(similarity)).select("a", "b")
        stay, go = judge(similar_pairs(materialise(tried), sets, similarity), ready)
        gone.append(go)
        few_went, few = go.count() < ids / 10, few * 2
        settled = materialise(stay.unionByName(go))
        groups = materialise(groups.hint("shuffle_merge").join(settled.hint("shuffle_merge"), "doc_id", "left_anti"))
        ids = groups.select("doc_id").distinct().count()
        if ids and few_went:
            pairs = materialise(close_pairs(groups, nodes, similarity))
            gone.append(judge(similar_pairs(pairs, sets, similarity), materialise(groups.select("doc_id").distinct()))[1])
            break
    return gone


def judge(edges: DataFrame, ready: DataFrame, limit: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(ids that stay, ids that go), written, of written similar pairs a < b. Only `ready` ids may stay, as only their
    pairs with smaller ids are all there; whatever such an id is similar to goes.

    While there are more than `limit` pairs, ready ids without a smaller neighbour stay and take theirs with them, all at
    once; what is left is judged pair by pair in rising order.
    """
    stays, goes = [], []
    while edges.count() > limit:
        first = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).hint("shuffle_merge"), "a", "left_anti")
        first = materialise(first.join(ready.select(F.col("doc_id").alias("a")).hint("shuffle_merge"), "a", "left_semi"))
        if first.isEmpty():
            break
        go = materialise(edges.hint("shuffle_merge").join(first.hint("shuffle_merge"), "a", "left_semi").select("b").distinct())
        stays.append(first.select(F.col("a").alias("doc_id")))
        goes.append(go.select(F.col("b").alias("doc_id")))
        left = edges.hint("shuffle_merge").join(first.hint("shuffle_merge"), "a", "left_anti").join(go.hint("shuffle_merge"), "b", "left_anti")
        edges = materialise(left.join(go.select(F.col("b").alias("a")).hint("shuffle_merge"), "a", "left_anti"))

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lost: set[int] = set()
        waits: set[int] = set()
        for batch in batches:
            for a, b, may in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "may")), strict=True):
                if a not in lost:
                    (lost if may and a not in waits else waits).add(b)
        ids = [*sorted(lost), *sorted(waits - lost)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([i < len(lost) for i in range(len(ids))], pa.bool_())], names=["doc_id", "lost"])

    few = edges.count() <= limit  # else all that is left waits for ids that are not ready
    marked = edges.join(ready.select(F.col("doc_id").alias("a"), F.lit(True).alias("may")).hint("shuffle_merge"), "a", "left").withColumn("may", F.coalesce("may", F.lit(False)))
    last = marked.coalesce(1).sortWithinPartitions("a", "b").mapInArrow(one_by_one, "doc_id long, lost boolean") if few else edges.select(F.col("b").alias("doc_id"), F.lit(False).alias("lost")).distinct()
    last = materialise(last)
    go, rest = last.where("lost").select("doc_id"), ready.join(last.select("doc_id").hint("shuffle_merge"), "doc_id", "left_anti")
    for more in goes:
        go, rest = go.unionByName(more), rest.join(more.hint("shuffle_merge"), "doc_id", "left_anti")
    for more in stays:
        rest = rest.unionByName(more)
    return materialise(rest.distinct()), materialise(go.distinct())


def drop_near_copies(documents: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents, one of each group of near copies (the smallest doc_id); their columns stay as they are.

    A document goes if its set of `words`-word shingles and that of a smaller doc_id which stays have a Jaccard
    similarity of at least `similarity`. Equal sets are folded first. Fingerprints over word pairs under several seeds
    bring together what may be similar, and bands of least hashes what differs in more bits than the fingerprints' links
    allow; all members of a group are tested, never only the links of a star, whose centre may be there by chance. A null
    doc_id always stays; equal texts of one doc_id are one document, and of different ones all but the first are judged
    after all ids.
    """
    rows = materialise(sketches(documents, words))
    known = materialise(rows.groupBy("doc_id", "version").agg(F.min(F.struct("d1", "d2", "n", "prints", "bands", "mins")).alias("r")).select("doc_id", "version", "r.*"))
    several = known.groupBy(F.col("doc_id").alias("own")).agg(F.min("version").alias("first"), F.count("*").alias("many"))
    several = materialise(several.where("many > 1").drop("many"))  # none in a table whose ids are keys
    later = (F.col("first") != F.col("version")) & F.col("first").isNotNull()
    key = F.when(later, F.xxhash64("doc_id", "version").bitwiseAND((1 << 62) - 1) + (1 << 62)).otherwise(F.col("doc_id"))
    known = known.join(several, known["doc_id"] == several["own"], "left").select(key.alias("doc_id"), F.col("doc_id").alias("own"), "version", "d1", "d2", "n", "prints", "bands", "mins")
    nodes = materialise(known.groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "own", "prints", "bands", "mins")).alias("r")).select("d1", "d2", "n", "r.*"))
    out = known.select("doc_id").join(nodes.select("doc_id").hint("shuffle_merge"), "doc_id", "left_anti")
    groups = candidate_groups(nodes)
    sets = shingle_table(documents, nodes, groups.select("doc_id").distinct(), words)
    for gone in losers(groups, nodes, sets, similarity):
        out = out.unionByName(gone)
    names = [f"c{i}" for i in range(len(documents.columns))]
    out = out.distinct().hint("shuffle_merge").join(known.select("doc_id", "own", "version").hint("shuffle_merge"), "doc_id")
    out = materialise(out.select(F.col("own").alias("gone"), "version"))
    left = documents.toDF(*names)
    key, text = (F.col(names[documents.columns.index(c)]) for c in ("doc_id", "text"))
    same = (key.cast("long") == F.col("gone")) & (F.xxhash64(text.cast("string")) == F.col("version"))
    return left.hint("shuffle_merge").join(out.hint("shuffle_merge"), same, "left_anti").toDF(*documents.columns)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
