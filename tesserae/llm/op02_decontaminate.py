"""Benchmark decontamination with suffix arrays over the training text.

The training text is cut into shards (a few MB of whole documents). In each shard
the words that occur in the benchmark get small ids, all others are barriers, and
the suffixes of the remaining runs are sorted by prefix doubling. Every test
suffix is then binary-searched, one word deeper at a time for all suffixes at
once; those still alive after a whole window are occurrences, which are extended
to the longest verbatim match and kept with their place. A document is whole in
one shard, so nothing is shuffled and a hot group of copies costs no more than
other rows.

A long text is searched in pieces that overlap by the words of the longest item, so
that no match is cut. The benchmark is cut into blocks of about `block_bytes`; each
is broadcast on its own, and what a block leaves is written before the next one, so
that a worker holds one block.

Defined results: null or word-less text: no words, not contaminated; item without
words: never occurs; repeated item_ids count once; a null item_id is named
`null`; repeated documents get equal rows; an empty benchmark: nothing is hit;
further columns of the documents are ignored (or, in `decontaminate`, kept).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import LOWER, materialise, per_text, pieces, span_hashes, spans, table, text_buffer

#: Word bytes after lower-casing: digits, a-z and every byte of a non-ASCII character.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True

FOUND = "n_words bigint, hits array<struct<start:int,end:int>>, matches array<struct<item:string,item_start:int,doc_start:int,n_words:int>>"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts and ends, and the number of words before each text."""
    data, at = text_buffer(texts)
    data = LOWER[data]
    start, end = spans(WORD[data], at)
    return data, start, end, np.searchsorted(start, at)


@dataclass
class Tests:
    """The benchmark items of a block: words as ids from 1, windows by length."""

    items: list[str]
    ids: np.ndarray  # all items' words, a 0 after each item
    first: np.ndarray  # where each item begins in ids
    vocabulary: np.ndarray  # sorted word hashes
    words: list[bytes]  # the words themselves, by id - 1
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length -> distinct id rows, where the places of each begin, all places
    pairs: np.ndarray  # sorted codes of two adjacent words
    least: int  # words of the shortest window
    longest: int  # words of the longest item


def build_tests(rows: list[tuple[str, str]], window: int) -> Tests | None:
    names = [r[0] for r in rows]
    data, start, end, before = words_of(pa.array([r[1] for r in rows], pa.string()))
    if len(start) == 0:
        return None
    hashes = span_hashes(data, start, end)
    vocabulary, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    words = [bytes(data[start[i] : end[i]]) for i in at]
    count = np.diff(before)
    ids = np.zeros(len(start) + len(rows), np.int64)
    first = before[:-1] + np.arange(len(rows))
    ids[np.arange(len(start)) + np.repeat(np.arange(len(rows)), count)] = inverse + 1
    windows: dict[int, tuple] = {}
    for length in np.unique(np.minimum(count[count > 0], window)).tolist():
        use = np.flatnonzero((count >= window) if length == window else (count == length))
        spots = np.concatenate([first[i] + np.arange(count[i] - length + 1) for i in use])
        rows_of, inverse = np.unique(ids[spots[:, None] + np.arange(length)], axis=0, return_inverse=True)
        inverse = inverse.ravel()
        edge = np.append(0, np.cumsum(np.bincount(inverse, minlength=len(rows_of))))
        windows[length] = (rows_of, edge, spots[np.lexsort((spots, inverse))])
    two = ids[:-1] * (len(vocabulary) + 1) + ids[1:]
    pairs = np.unique(two[(ids[:-1] > 0) & (ids[1:] > 0)])
    return Tests(names, ids, first, vocabulary, words, windows, pairs, min(windows), int(count.max()))


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of the non-zero ids, sorted by the `depth` ids that begin there."""
    n = len(ids)
    rank, step = ids.astype(np.int64), 1
    while step < depth:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:]
        _, rank = np.unique(rank * (int(after.max()) + 1) + after, return_inverse=True)
        if rank.max() + 1 == n:
            break
        step *= 2
    order = np.argsort(rank, kind="stable")
    return order[ids[order] > 0]


def narrow(ids: np.ndarray, order: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of suffixes that begin with each query row, by binary search one word deeper at a time."""
    low = np.zeros(len(queries), np.int64)
    high = np.full(len(queries), len(order), np.int64)
    padded = np.append(ids, np.zeros(queries.shape[1] + 1, ids.dtype))
    for d in range(queries.shape[1]):
        alive = np.flatnonzero(low < high)
        if not len(alive):
            break
        for side in (0, 1):
            a, b = low[alive].copy(), high[alive].copy()
            word = queries[alive, d]
            while (open_ := a < b).any():
                middle = (a + b) // 2
                here = padded[order[np.minimum(middle, len(order) - 1)] + d]
                right = (here < word) if side == 0 else (here <= word)
                a = np.where(open_ & right, middle + 1, a)
                b = np.where(open_ & ~right, middle, b)
            if side == 0:
                lower = a
            else:
                low[alive], high[alive] = lower, a
    return low, high


def _longest(best: dict, shard: np.ndarray, tests: Tests, length: int, edges: np.ndarray, spots: np.ndarray, which: np.ndarray, here: np.ndarray, begin: np.ndarray, text: np.ndarray, before: np.ndarray) -> None:
    """Put the longest match of each (text, item) among some window occurrences into `best` as (words, item place, text place)."""
    many = edges[which + 1] - edges[which]
    at = spots[np.arange(int(many.sum())) + np.repeat(edges[which] - (np.cumsum(many) - many), many)]
    here, begin, text = np.repeat(here, many), np.repeat(begin, many), np.repeat(text, many)
    # where the words before agree too, the match begins earlier
    inner = (here > 0) & (at > 0) & (shard[here - 1] > 0) & (shard[here - 1] == tests.ids[at - 1])
    at, here, begin, text = at[~inner], here[~inner], begin[~inner], text[~inner]
    reach = np.full(len(begin), length)
    padded, tail = np.append(shard, 0), np.append(tests.ids, 0)
    live = np.arange(len(begin))
    while len(live):
        x = padded[np.minimum(here[live] + reach[live], len(shard))]
        y = tail[np.minimum(at[live] + reach[live], len(tests.ids))]
        live = live[(x == y) & (x > 0)]
        reach[live] += 1
    item = np.searchsorted(tests.first, at, "right") - 1
    pick = np.lexsort((at, begin, -reach, item, text))
    pick = pick[np.concatenate([[True], (np.diff(text[pick]) != 0) | (np.diff(item[pick]) != 0)])] if len(pick) else pick
    for i in pick.tolist():
        match = (int(reach[i]), int(at[i] - tests.first[item[i]]), int(begin[i] - before[text[i]]))
        known = best.get((int(text[i]), int(item[i])))
        if known is None or (-match[0], match[2], match[1]) < (-known[0], known[2], known[1]):
            best[(int(text[i]), int(item[i]))] = match


def search(texts: pa.Array, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int, int, int]]]:
    """One shard: words per text, hit start and end (word places in the shard), longest matches (text, item, item place, text place, words)."""
    data, start, end, before = words_of(texts)
    none = np.empty(0, np.int64)
    if len(start) == 0:
        return before, none, none, []
    hashes = span_hashes(data, start, end)
    spot = np.minimum(np.searchsorted(tests.vocabulary, hashes), len(tests.vocabulary) - 1)
    ids = np.where(tests.vocabulary[spot] == hashes, spot + 1, 0)
    # a barrier after every text
    owner = np.searchsorted(before[1:], np.arange(len(ids)), "right")
    wide = np.zeros(len(ids) + len(texts), np.int64)
    wide[np.arange(len(ids)) + owner] = ids
    word_at = np.full(len(wide), -1, np.int64)
    word_at[np.arange(len(ids)) + owner] = np.arange(len(ids))
    if tests.least > 1:  # a window begins with two adjacent words of the benchmark
        two = wide[:-1] * (len(tests.vocabulary) + 1) + wide[1:]
        place = np.minimum(np.searchsorted(tests.pairs, two), len(tests.pairs) - 1)
        link = np.append(tests.pairs[place] == two, False) if len(tests.pairs) else np.zeros(len(wide), bool)
        keep = link.copy()
        keep[1:] |= link[:-1]
        # two runs that touch are split where the pair between them does not occur
        cut = keep & ~link
        runs = np.where(keep, wide, 0)
        gap = np.flatnonzero(cut) + 1
        runs, word_at = np.insert(runs, gap, 0), np.insert(word_at, gap, -1)
    else:
        runs = wide
    full = runs > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], full.view(np.int8), [0]])))
    a, b = edge[::2], edge[1::2]
    long = (b - a) >= tests.least
    a, b = a[long], b[long]
    if not len(a):
        return before, none, none, []
    # the shard proper: runs that can hold a window, a 0 after each
    size = b - a + 1
    to = np.cumsum(size) - size
    index = np.arange(int(size.sum())) + np.repeat(a - to, size)
    shard = np.where(np.arange(len(index)) == np.repeat(to + size - 1, size), 0, runs[np.minimum(index, len(runs) - 1)])
    places = np.where(shard > 0, word_at[np.minimum(index, len(runs) - 1)], -1)
    order = suffix_array(shard, max(tests.windows))
    hit_at, hit_end, best = [], [], {}
    for length, (queries, edges, spots) in tests.windows.items():
        sample = spots[edges[:-1]]
        low, high = narrow(shard, order, queries)
        found = np.flatnonzero(low < high)
        if not len(found):
            continue
        many = high[found] - low[found]
        which = np.repeat(found, many)
        here = order[np.arange(int(many.sum())) + np.repeat(low[found] - (np.cumsum(many) - many), many)]
        begin = places[here]
        text = owner[begin]
        # exact: compare the bytes of one window per distinct occurrence with the item's words
        same = np.ones(len(begin), bool)
        for d in range(length):
            words = tests.ids[sample[which] + d] - 1
            same &= np.array([tests.words[w] == data[start[p] : end[p]].tobytes() for w, p in zip(words.tolist(), (begin + d).tolist(), strict=True)], bool)
        which, here, begin, text = which[same], here[same], begin[same], text[same]
        hit_at.append(begin)
        hit_end.append(begin + length)
        # every place of the window is extended on its own, some occurrences at a time
        total = np.cumsum(edges[which + 1] - edges[which])
        cut = 0
        while cut < len(which):
            stop = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + 1_000_000, "right")))
            _longest(best, shard, tests, length, edges, spots, *(x[cut:stop] for x in (which, here, begin, text)), before)
            cut = stop
    matches = [(t, o, m[1], m[2], m[0]) for (t, o), m in sorted(best.items())]
    if not hit_at:
        return before, none, none, matches
    return before, np.concatenate(hit_at), np.concatenate(hit_end), matches


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


#: Word places of different rows are this far apart.
_ROW = 1 << 36


def find(texts: pa.Array, tests: Tests | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """Words of each text, its hits as places plus row * _ROW (merged), and the longest match of each (text, item)."""
    words = np.zeros(len(texts), np.int64)
    starts, ends, best = [], [], {}
    for part, rows, before, _ in pieces(texts, WORD[LOWER], tests.longest if tests else 0):
        if tests is None:
            words[rows] = before + np.diff(words_of(part)[3])
            continue
        counts, at, end, matches = search(part, tests)
        words[rows] = before + np.diff(counts)
        owner = np.searchsorted(counts[1:], at, "right")
        shift = rows[owner] * _ROW + before - counts[owner]
        starts.append(at + shift)
        ends.append(end + shift)
        for t, o, j, p, n in matches:
            match, key = (-n, p + before, j), (int(rows[t]), o)
            best[key] = min(best.get(key, match), match)
    if not starts or not sum(map(len, starts)):
        return words, np.empty(0, np.int64), np.empty(0, np.int64), best
    return words, *_merged(np.concatenate(starts), np.concatenate(ends)), best


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[Callable[[], Tests | None]]:
    """For each block of the benchmark a function that gives a worker its tests, from a broadcast of plain values."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("body") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == k).collect()  # about block_bytes, or one item
        tests = build_tests([tuple(r) for r in rows], window)
        shared = spark.sparkContext.broadcast(vars(tests) if tests else None)
        yield lambda shared=shared: Tests(**shared.value) if shared.value else None


def find_matches(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 16_000_000) -> DataFrame:
    """doc_id, n_words, hits (word spans) and matches (the longest per item) of each row of (doc_id, text)."""

    def finder(tests_of: Callable) -> Callable[[pa.Array], pa.Array]:
        def run(texts: pa.Array) -> pa.Array:
            tests = tests_of()
            words, start, end, best = find(texts, tests)
            per = np.bincount(start // _ROW, minlength=len(texts))
            hits = pa.ListArray.from_arrays(
                pa.array(np.append(0, np.cumsum(per)).astype(np.int32)), pa.StructArray.from_arrays([pa.array((start % _ROW).astype(np.int32)), pa.array((end % _ROW).astype(np.int32))], names=["start", "end"])
            )
            found: list[list] = [[] for _ in range(len(texts))]
            for (t, o), (n, p, j) in sorted(best.items()):
                found[t].append({"item": tests.items[o], "item_start": j, "doc_start": p, "n_words": -n})
            match = pa.struct([("item", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("n_words", pa.int32())])
            return pa.StructArray.from_arrays([pa.array(words), hits, pa.array(found, pa.list_(match))], names=["n_words", "hits", "matches"])

        return run

    df = documents.select("doc_id", F.col("text").cast("string").alias("text"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("hits"), F.expr("cast(array() as array<struct<item:string,item_start:int,doc_start:int,n_words:int>>)").alias("matches"))
    for k, tests_of in enumerate(_blocks(benchmark, window, block_bytes)):
        found = (materialise(df) if k else df).withColumn("found", per_text(finder(tests_of), FOUND)(F.col("text")))
        df = found.select("doc_id", "text", F.concat("hits", "found.hits").alias("hits"), F.concat("matches", "found.matches").alias("matches"), F.col("found.n_words").alias("n_words"))
    return df.select("doc_id", "n_words", "hits", "matches")


def _hit_words(hits: Column) -> Column:
    """Words in the union of the spans; blocks may have found overlapping ones."""
    step = lambda acc, h: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("long"), h["end"].cast("long") - F.greatest(h["start"].cast("long"), acc["reach"]))).alias("n"),
        F.greatest(acc["reach"], h["end"].cast("long")).alias("reach"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    return F.aggregate(F.array_sort(hits), zero, step, lambda acc: acc["n"])


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 16_000_000) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings), matches and contaminated, for each document."""
    found = find_matches(documents, benchmark, window, block_bytes)
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"])))
    n_hit = _hit_words(F.col("hits"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), items.alias("items"), "matches", (F.size("hits") > 0).alias("contaminated"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 16_000_000) -> DataFrame:
    """The documents without those that hold a benchmark window; their columns stay as they are."""

    def clean(tests_of: Callable) -> Callable[[pa.Array], pa.Array]:
        def run(texts: pa.Array) -> pa.Array:
            out = np.ones(len(texts), bool)
            out[find(texts, tests_of())[1] // _ROW] = False
            return pa.array(out)

        return run

    names = [f"c{i}" for i in range(len(documents.columns))]
    text = F.col(names[documents.columns.index("text")]).cast("string")
    df = documents.toDF(*names)
    for k, tests_of in enumerate(_blocks(benchmark, window, block_bytes)):
        df = (materialise(df) if k else df).where(per_text(clean(tests_of), "boolean")(text))
    return df.toDF(*documents.columns)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(listed, "utf-8"), 256).alias("items_sha256"), "contaminated")


def brute_force(text: str | None, items: list[tuple[str, str | None]], window: int = 10) -> tuple[int, int, int, str, bool]:
    """The contract, word by word, for tests."""
    import re

    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, owners = cut(text), set(), set()
    for item, body in items:
        probe = cut(body)
        length = min(window, len(probe))
        if not length:
            continue
        grams = {tuple(probe[i : i + length]) for i in range(len(probe) - length + 1)}
        for i in range(len(words) - length + 1):
            if tuple(words[i : i + length]) in grams:
                hit.update(range(i, i + length))
                owners.add(str(item))
    listed = ",".join(sorted(owners))
    return len(words), len(hit), len(owners), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT item, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i, w FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM g),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
c AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM p, (SELECT DISTINCT n FROM k) WHERE i + n - 1 <= len(w)),
h AS (SELECT c.doc_id, c.i, k.n, k.item FROM c JOIN k ON c.n = k.n AND c.gram = k.gram),
x AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
y AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)
"""
