"""Nearest rows by cosine over an inverted-file index.

Cells are the centres of a spherical k-means on a bounded sample; every row is put in its nearest cell. A query first
probes the cells that may hold its nearest rows, then every other cell whose best possible cosine is above that of the
k-th row found so far. With `spread` = 1 that bound holds for certain, so the result is exact at any number of cells;
a smaller one is the bound for rows that lie around their cell's centre without a common direction, and trades recall for work.

A hot cell is dealt out: blocks of at most `BLOCK` rows meet blocks of at most as many queries. The cells probed first get
their queries by a shuffle, a fixed number of copies of each row; all others, which without clusters are nearly all cells of
each query, by a Cartesian product of written blocks, which moves the nearest rows found and no vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import scalar as S
from tesserae.operators.store import materialise

BLOCK = 2048
#: Queries of a block whose cosines are held at once, and the parts of an index that give their own nearest rows.
STRIP, PARTS = 128, 8
#: Rows that a cell has on average, up to MOST_CELLS cells; the sample that they are fitted on has SAMPLE rows a cell, by hash of the id.
ROWS_A_CELL, MOST_CELLS, SAMPLE = 2048, 16_384, 4
#: Cells that a query probes first.
PROBES = 4
_FOUND = "q long, g long, cos double, q_label long, g_label long"


@dataclass(frozen=True)
class Cells:
    """For each cell its centre, the number of its rows and the range of their angles to it; it travels with the tasks."""

    centres: np.ndarray
    counts: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray

    def bounds(self, unit: np.ndarray, spread: float) -> np.ndarray:
        """The best cosine that a row of each cell can have with each query."""
        angle = np.arccos(np.clip(unit @ self.centres.T, -1, 1))
        if spread >= 1:
            out = np.cos(np.maximum(0, np.maximum(angle - self.farthest, self.nearest - angle)))
        else:
            best = np.clip(np.arctan2(spread * np.sin(angle), np.cos(angle)), self.nearest, self.farthest)
            out = np.cos(angle) * np.cos(best) + spread * np.sin(angle) * np.sin(best)
        out[:, self.counts == 0] = -np.inf
        return out

    def likely(self, unit: np.ndarray, spread: float, probes: int) -> np.ndarray:
        """Which cells each query probes first."""
        bounds = self.bounds(unit, spread)
        if probes >= len(self.counts):
            return np.isfinite(bounds)
        out = np.zeros(bounds.shape, bool)
        out[np.arange(len(unit))[:, None], np.argpartition(-bounds, probes - 1, axis=1)[:, :probes]] = True
        return out & np.isfinite(bounds)


@dataclass(frozen=True)
class Index:
    """Written rows (id, label, v: unit vector, cell), and the cells."""

    rows: DataFrame
    cells: Cells


def _matrix(batch: pa.RecordBatch, name: str = "v") -> np.ndarray:
    column = batch.column(name)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).ravel()))


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from the first rows of the sample; a cell that runs empty keeps its centre."""
    sample = _unit(sample)
    centres = sample[:cells].copy()
    for _ in range(rounds):
        nearest = np.concatenate([np.argmax(sample[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        filled = np.linalg.norm(sums, axis=1) > 0
        centres[filled] = _unit(sums[filled])
    return centres


def build(vectors: DataFrame, cells: int | None = None) -> Index:
    """Index all rows (id, label, v)."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), S.doubles(F.col("v")).alias("v"))
    n = rows.count()
    cells = max(1, min(cells or -(-n // ROWS_A_CELL), MOST_CELLS, n))
    if cells == 1:  # nothing to choose between
        return Index(rows.withColumn("cell", F.lit(0)), Cells(np.zeros((1, 1)), np.array([n]), np.zeros(1), np.full(1, np.pi)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(cells * SAMPLE).select("v").toArrow()
    centres = fit_centres(np.stack(sample["v"].to_numpy()), cells)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                unit = _unit(_matrix(b))
                cos = unit @ centres.T
                cell = np.argmax(cos, axis=1)
                angle = np.arccos(np.clip(cos[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), _lists(unit), pa.array(cell.astype(np.int32)), pa.array(angle)], names=["id", "label", "v", "cell", "angle"])

    placed = materialise(rows.mapInArrow(assign, "id long, label long, v array<double>, cell int, angle double"))
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).toArrow()  # at most MOST_CELLS rows
    counts, low, high = np.zeros(cells, np.int64), np.zeros(cells), np.full(cells, np.pi)
    at = stats["cell"].to_numpy()
    counts[at], low[at], high[at] = stats["n"].to_numpy(), stats["low"].to_numpy(), stats["high"].to_numpy()
    return Index(placed.drop("angle"), Cells(centres, counts, low, high))


def _best(q: np.ndarray, qi: np.ndarray, ql: np.ndarray, least: np.ndarray, g: np.ndarray, gi: np.ndarray, gl: np.ndarray, k: int, scope: str) -> tuple[np.ndarray, ...]:
    """(row, column, cosine) of the k best columns of each row that reach its least cosine, ties by id; STRIP rows at a time."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for at in range(0, len(q), STRIP):
        rows = slice(at, at + STRIP)
        cos = q[rows] @ g.T
        hit = cos >= least[rows, None]
        if np.count_nonzero(hit) > 4 * k * len(cos) and cos.shape[1] > k:
            bad = qi[rows, None] == gi[None, :]
            if scope != "any":
                bad |= (ql[rows, None] == gl[None, :]) != (scope == "own")
            cos[bad] = -np.inf
            hit &= cos >= np.partition(cos, -k, axis=1)[:, -k, None]
        r, c = np.divmod(np.flatnonzero(hit), cos.shape[1])
        good = (qi[r + at] != gi[c]) & (cos[r, c] > -np.inf)
        if scope != "any":
            good &= (ql[r + at] == gl[c]) == (scope == "own")
        r, c = r[good], c[good]
        out.append(_cut(r + at, c, cos[r, c], gi[c], k))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _cut(r: np.ndarray, c: np.ndarray, cos: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best entries of each row."""
    order = np.lexsort((ids, -cos, r))
    r, c, cos = r[order], c[order], cos[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], c[keep], cos[keep]


_NAMES, _KINDS = ["q", "g", "cos", "q_label", "g_label"], [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]


def _compare(left: pa.Table, right: pa.Table, k: int, scope: str) -> pa.Table:
    """The k best rows of one block for each query of another."""
    if not left.num_rows or not right.num_rows:
        return pa.table([pa.array([], t) for t in _KINDS], names=_NAMES)
    left, right = (t.combine_chunks().to_batches()[0] for t in (left, right))
    qi, gi, ql, gl = (t.column(c).to_numpy() for t, c in ((left, "qid"), (right, "id"), (left, "qlabel"), (right, "label")))
    r, c, cos = _best(_unit(_matrix(left, "w")), qi, ql, np.full(len(qi), -np.inf), _unit(_matrix(right)), gi, gl, k, scope)
    return pa.table([pa.array(x, t) for x, t in zip((qi[r], gi[c], cos, ql[r], gl[c]), _KINDS, strict=True)], names=_NAMES)


_ASKED = "qid binary, qlabel binary, reached binary, w binary"
_HELD = "cell int, id binary, label binary, v binary"


def _row(*columns: np.ndarray) -> list[pa.Array]:
    """One row, each array as its bytes: Spark copies them whole."""
    return [pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns]


def _array(b: pa.RecordBatch, name: str, kind: type = np.int64) -> np.ndarray:
    """The array of a batch of one such row."""
    return np.frombuffer(b.column(name)[0].as_buffer(), kind)


def _all_pairs(again: DataFrame, index: Index, k: int, scope: str, spread: float, probes: int, block: int) -> DataFrame:
    """The k best rows, for each query (qid, qlabel, w, reached) and PARTS parts of the index, of the cells whose bound reaches the
    k-th cosine found and that were not probed first.

    Both sides are written as blocks, one row each, and Spark's Cartesian product brings them together: it reads the written
    blocks of the index again for each part of the queries and shuffles none.
    """
    of = index.cells

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = np.concatenate([np.argmax(_unit(_matrix(b.slice(i, 512), "w")) @ of.centres.T, axis=1) for i in range(0, b.num_rows, 512)] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("qid", "qlabel", "reached", "w")), pa.array(cell.astype(np.int32))], names=["qid", "qlabel", "reached", "w", "near"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, block) for x in batches for i in range(0, x.num_rows, block)):
            yield pa.RecordBatch.from_arrays(_row(*(b.column(c).to_numpy() for c in ("qid", "qlabel", "reached")), _unit(_matrix(b, "w"))), names=["qid", "qlabel", "reached", "w"])

    def held(rows: pa.Table) -> pa.Table:
        b = rows.combine_chunks().to_batches()[0]
        return pa.Table.from_arrays([b.column("cell").slice(0, 1), *_row(b.column("id").to_numpy(), b.column("label").to_numpy(), _unit(_matrix(b)))], names=["cell", "id", "label", "v"])

    placed = materialise(again.mapInArrow(near, "qid long, qlabel long, reached double, w array<double>, near int"))
    queries = materialise(placed.repartitionByRange(max(1, -(-placed.count() // block)), "near", "qid").drop("near").mapInArrow(asked, _ASKED))
    cut = again.sparkSession.createDataFrame([(int(c), -(-int(of.counts[c]) // block)) for c in np.flatnonzero(of.counts)], "cell int, parts int")  # at most MOST_CELLS rows
    parted = index.rows.join(F.broadcast(cut), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    gallery = materialise(parted.select("cell", "part", "id", "label", "v").groupBy("cell", "part").applyInArrow(held, _HELD)).coalesce(PARTS)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qi = None
        for b in (x.slice(i, 1) for x in batches for i in range(x.num_rows)):
            if qi is None or not np.array_equal(qi, _array(b, "qid")):
                if qi is not None:
                    yield done()
                qi, ql = _array(b, "qid"), _array(b, "qlabel")
                q, least = _array(b, "w", float).reshape(len(qi), -1), _array(b, "reached", float) - 1e-12
                wanted = np.concatenate([(of.bounds(q[i : i + STRIP], spread) >= least[i : i + STRIP, None] - 1e-9) & ~of.likely(q[i : i + STRIP], spread, probes) for i in range(0, len(qi), STRIP)])
                have = tuple(np.empty(0, t) for t in (np.int64, np.int64, float, np.int64))  # row, id, cosine, label

                def done() -> pa.RecordBatch:
                    r, g, cos, label = have
                    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((qi[r], g, cos, ql[r], label), _KINDS, strict=True)], names=_NAMES)

            asks = np.flatnonzero(wanted[:, b.column("cell")[0].as_py()])
            if not len(asks):
                continue
            ids, labels = _array(b, "id"), _array(b, "label")
            r, c, cos = _best(q[asks], qi[asks], ql[asks], least[asks], _array(b, "v", float).reshape(len(ids), -1), ids, labels, k, scope)
            if not len(r):
                continue
            r, g, cos, label = (np.concatenate(x) for x in zip(have, (asks[r], ids[c], cos, labels[c]), strict=True))
            r, at, cos = _cut(r, np.arange(len(r)), cos, g, k)
            have = (r, g[at], cos, label[at])
            last = np.flatnonzero(np.append(r[1:] != r[:-1], True))
            last = last[np.bincount(r, minlength=len(qi))[r[last]] >= k]
            least[r[last]] = np.maximum(least[r[last]], cos[last] - 1e-12)
        if qi is not None:
            yield done()

    met = queries.hint("shuffle_replicate_nl").crossJoin(gallery)
    return met.mapInArrow(best, _FOUND)


def search(index: Index, queries: DataFrame, k: int, scope: str = "any", spread: float = 1.0, probes: int = PROBES, block: int | None = None) -> DataFrame:
    """(q, g, cos, q_label, g_label, rank): the k nearest rows of the index, ties by id, never the row itself.

    scope: any, own (same label) or other. Queries are rows (id, label, v) with ids of their own.
    """
    spark, index_rows, of = queries.sparkSession, index.rows, index.cells
    cells, block = len(of.counts), block or BLOCK
    asked = queries.select(F.col("id").cast("long").alias("qid"), F.col("label").cast("long").alias("qlabel"), S.doubles(F.col("v")).alias("w"), F.lit(None).cast("double").alias("reached"))
    best = Window.partitionBy("q").orderBy(F.desc("cos"), "g")
    top = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def meet(rows: DataFrame, chosen: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame | None:
        """What is found in the cells that `chosen` takes for unit vectors and the k-th cosines reached."""

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                    unit = _unit(_matrix(part, "w"))
                    q, cell = np.nonzero(chosen(unit, part.column("reached").to_numpy(zero_copy_only=False)))
                    yield pa.RecordBatch.from_arrays([part.column("qid").take(pa.array(q)), part.column("qlabel").take(pa.array(q)), _lists(unit[q]), pa.array(cell.astype(np.int32))], names=["qid", "qlabel", "w", "cell"])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(cells, np.int64)
            for b in probe(batches):
                total += np.bincount(b.column("cell").to_numpy(), minlength=cells)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

        if cells == 1:
            probed, asking = rows.select("qid", "qlabel", "w", F.lit(0).alias("cell")), {0: rows.count()}
        else:
            probed = rows.mapInArrow(probe, "qid long, qlabel long, w array<double>, cell int")
            asking = {r["cell"]: r["n"] for r in rows.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # at most MOST_CELLS rows
        asking = {c: n for c, n in asking.items() if n}
        if not asking:
            return None
        dealt = spark.createDataFrame([(int(c), -(-int(of.counts[c]) // block), -(-int(n) // block)) for c, n in asking.items()], "cell int, parts int, askers int")
        dealt = F.broadcast(dealt)  # at most MOST_CELLS rows
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        some = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        left = probed.join(dealt, "cell").select("qid", "qlabel", "w", "cell", some("qid", "askers").alias("a"), every("parts").alias("b"))
        right = index_rows.join(dealt, "cell").select("id", "label", "v", "cell", every("askers").alias("a"), some("id", "parts").alias("b"))
        keys = ["cell", "a", "b"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda x, y: _compare(x, y, k, scope), _FOUND)

    found = meet(asked, lambda unit, _: of.likely(unit, spread, probes))
    if found is None:
        return spark.createDataFrame([], _FOUND + ", rank int")
    if probes >= cells:
        return top(found)
    nearest = materialise(top(found))
    reached = nearest.groupBy(F.col("q").alias("qid")).agg(F.when(F.count(F.lit(1)) >= k, F.min("cos")).otherwise(-2.0).alias("least"))
    again = asked.hint("shuffle_merge").join(reached.hint("shuffle_merge"), "qid", "left").select("qid", "qlabel", "w", F.coalesce("least", F.lit(-2.0)).alias("reached"))
    return top(nearest.drop("rank").unionByName(_all_pairs(again, index, k, scope, spread, probes, block)))
