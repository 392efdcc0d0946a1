"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of every training text: each task adds up a
(language x bucket) matrix of fixed size and hands on its non-zero cells, which
Spark sums. The log-probability matrix is broadcast; its size is languages x
buckets, and with very many languages it has fewer buckets. Scoring is a sparse
batch product in numpy: the n-grams of a batch gather their matrix cells, which are
summed per text; a long text is read in pieces.

Letters are lower-cased, every other character becomes a blank, and blanks frame
each text; n-grams of blanks alone are not counted.

Defined results: null text, or one without a letter: `und`, score 0; rows with null
text or lang teach nothing; no training rows at all: `und`, score 0; equal
posteriors: the first language by name; repeated rows count as often as they occur;
further columns are ignored (or, in `predict`, kept, but for `lang_pred` and `score`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import runs, held_out, per_text, table, text_buffer, trim

ORDERS = (1, 2, 3)
BLANK_CODE = 0x20
#: Bytes of text of a pass, or of a piece of a long text.
LIMIT = 500_000
#: Code point -> lower-cased letter, or a blank; filled as code points turn up.
_LETTER = np.zeros(0, np.uint32)
_UNSEEN = 0xFFFFFFFF


def _letters(codes: np.ndarray) -> np.ndarray:
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.full(0x110000, _UNSEEN, np.uint32)
    out = _LETTER[codes]
    if (out == _UNSEEN).any():
        for c in np.unique(codes[out == _UNSEEN]).tolist():
            low = chr(c).lower()
            _LETTER[c] = ord(low[0]) if chr(c).isalpha() else BLANK_CODE
        out = _LETTER[codes]
    return out


def _framed(texts: pa.Array, first: bool, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of texts with a blank before (if first) and after (if last), and where each begins."""
    data, at = text_buffer(texts)
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))[at]
    more = int(first) + int(last)
    framed = np.full(len(codes) + more * len(texts), BLANK_CODE, np.uint32)
    framed[np.arange(len(codes)) + more * np.repeat(np.arange(len(texts)), np.diff(chars)) + int(first)] = _letters(codes)
    return framed, chars[:-1] + more * np.arange(len(texts))


def framed_pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(framed letters, where texts begin in them, their rows, letters of the next piece at the end): all texts; a long one in pieces."""
    data, at = text_buffer(texts)
    for a, b in runs(at, LIMIT):
        if at[b] - at[a] <= LIMIT:
            yield *_framed(texts.slice(a, b - a), True, True), np.arange(a, b), 0
            continue
        low, stop = int(at[a]), int(at[b])
        while low < stop:
            high = _char_start(data, min(low + LIMIT, stop), stop)
            ahead = high
            for _ in range(max(ORDERS) - 1):
                ahead = _char_start(data, min(ahead + 1, stop), stop)
            piece = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, ahead - low], np.int32)), pa.py_buffer(data[low:ahead]))
            framed, start = _framed(piece, low == at[a], ahead == stop)
            after = int(np.count_nonzero((data[high:ahead] & 0xC0) != 0x80)) + int(ahead == stop) if high < stop else 0
            yield framed, start, np.array([a]), after
            low = high


def _char_start(data: np.ndarray, i: int, stop: int) -> int:
    while i < stop and data[i] & 0xC0 == 0x80:
        i += 1
    return i


def ngram_buckets(framed: np.ndarray, start: np.ndarray, buckets: int, after: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (one row per order, `buckets` where no n-gram begins), and whether each text has a letter; the last `after` letters begin none."""
    letter = framed != BLANK_CODE
    has = np.add.reduceat(letter, start) > 0 if len(start) else np.empty(0, bool)
    out = np.full((len(ORDERS), len(framed)), buckets, np.int32)
    value = np.zeros(len(framed), np.uint32)
    inside = np.zeros(len(framed), bool)
    end = np.append(start[1:], len(framed))
    for k, n in enumerate(ORDERS):
        size = len(framed) - n + 1
        if size <= 0:
            break
        with np.errstate(over="ignore"):
            value[:size] = value[:size] * np.uint32(0x01000193) + framed[n - 1 :] + np.uint32(1)
            mixed = (value ^ (value >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
        inside[:size] |= letter[n - 1 :]
        out[k] = np.where(inside, (mixed ^ (mixed >> np.uint32(16))) % np.uint32(buckets), buckets)
        for back in range(1, n):  # n-grams that reach into the next text
            out[k][end[end - back >= 0] - back] = buckets
    if after:
        out[:, len(framed) - after :] = buckets
    return out, has


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # languages x (buckets + 1); the last column is zero
    prior: np.ndarray


def train(documents: DataFrame, buckets: int = 1 << 15, smoothing: float = 0.1, most_cells: int = 1 << 23) -> Model:
    """Fit on all rows of (text, lang). With so many languages that the matrix would pass `most_cells`, it has fewer buckets (1,024 at least)."""
    rows = documents.select(F.col("lang").cast("string"), F.col("text").cast("string")).where("lang is not null and text is not null")
    many = rows.agg(F.count_distinct("lang")).first()[0]
    while buckets > 1024 and buckets * many > most_cells:
        buckets //= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang in set(langs):
                sums.setdefault(lang, np.zeros(buckets + 1, np.int64))[buckets] += langs.count(lang)
            for framed, start, here, after in framed_pieces(batch.column("text")):
                cells, _ = ngram_buckets(framed, start, buckets, after)
                size = np.diff(np.append(start, len(framed)))
                mine = np.array([langs[i] for i in here.tolist()], object)
                for lang in set(mine.tolist()):
                    of = np.repeat(mine == lang, size)
                    for row in cells:
                        sums[lang][:buckets] += np.bincount(row[of], minlength=buckets + 1)[:buckets]
            trim()
        for lang, total in sums.items():
            cell = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cell), pa.string()), pa.array(cell), pa.array(total[cell])], names=["lang", "bucket", "n"])

    counts = rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most most_cells, or 1,024 a language
    names = sorted(set(counts["lang"].to_pylist()))
    logs = np.zeros((len(names), buckets + 1))
    place = {n: i for i, n in enumerate(names)}
    logs[np.array([place[x] for x in counts["lang"].to_pylist()], np.int64), counts["bucket"].to_numpy().astype(np.int64)] = counts["n"].to_numpy()
    prior = np.log(logs[:, buckets] / max(1.0, logs[:, buckets].sum())) if names else np.zeros(0)
    logs[:, buckets] = 0
    logs[:, :buckets] = np.log((logs[:, :buckets] + smoothing) / (logs[:, :buckets].sum(1, keepdims=True) + smoothing * buckets))
    return Model(names, logs.astype(np.float32), prior)


def identify(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The place of each text's language (after the last one: none), and its posterior."""
    total, has = np.tile(model.prior, (len(texts), 1)), np.zeros(len(texts), bool)
    for framed, start, here, after in framed_pieces(texts):
        cells, letters = ngram_buckets(framed, start, model.logs.shape[1] - 1, after)
        has[here] |= letters
        for j, logs in enumerate(model.logs):
            for row in cells:
                total[here, j] += np.add.reduceat(logs[row], start, dtype=np.float64)
    has &= bool(len(model.languages))
    if not len(texts) or not len(model.languages):
        return np.zeros(len(texts), np.int64), np.zeros(len(texts))
    best = np.where(has, total.argmax(1), len(model.languages))
    return best, np.where(has, 1 / np.exp(total - total.max(1, keepdims=True)).sum(1), 0.0)


def language(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A column function: (lang_pred, score) of a text."""
    shared = spark.sparkContext.broadcast((model.languages, model.logs, model.prior))

    def run(texts: pa.Array) -> pa.Array:
        m = Model(*shared.value)
        best, score = identify(texts, m)
        known = pa.array([*m.languages, "und"], pa.string())
        return pa.StructArray.from_arrays([known.take(pa.array(best)), pa.array(score)], names=["lang_pred", "score"])

    return per_text(run, "lang_pred string, score double")


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """The documents with lang_pred and score (the posterior of that language); columns of these names are replaced."""
    out = language(documents.sparkSession, model)(F.col("text").cast("string"))
    kept = [c for c in documents.columns if c not in ("lang_pred", "score")]
    names = [f"c{i}" for i in range(len(kept))]
    found = documents.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)), out.alias("found"))
    return found.select(*(F.col(n).alias(c) for n, c in zip(names, kept, strict=True)), "found.lang_pred", "found.score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 5, 0)
    model = train(documents.where(~held))
    slim = documents.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(slim, model).select("doc_id", "held_out", "lang_pred", "score")
