"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of about `FRAME_BYTES` bytes, each
with the units (lines) and bytes before it. Two cuts between units are drawn from a
hash of the doc_id; only the one or two frames that hold them are decompressed to
select the places. The output streams frames one by one in its own order, prefix,
suffix, middle (psm) or suffix, prefix, middle (spm), and is stored as frames again.
To restore a text, the markers are searched in the stored output and its three
parts are streamed in the order of the text. So a row costs its compressed frames and
one or two open ones, whatever its length. Rows stay where Spark reads them: no shuffle.

Defined results: null text: empty; an empty text, or one with a marker, stays plain;
null doc_id: cuts are drawn as for an empty id; repeated rows: one result each, all
alike; a unit of any length goes over as many frames as it needs; no rows: no rows;
further columns are kept by `infill` and ignored by the query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import table, text_buffer, trim

FRAME_BYTES = 1 << 16
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
#: (marker, part) in the order of the output; the parts are prefix, middle, suffix.
ORDERS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
STORED = "array<struct<units:bigint,bytes:bigint,frame:binary>>"


class Codec:
    """One compressor and decompressor for a task."""

    def __init__(self) -> None:
        self.pack = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        self.unpack = zstandard.ZstdDecompressor().decompress


def store(codec: Codec, chunks: Iterable[bytes], size: int = FRAME_BYTES) -> list[tuple[int, int, bytes]]:
    """(units that end before, bytes before, frame) of a text that comes in chunks; frames hold `size` bytes, the last one fewer."""
    frames: list[tuple[int, int, bytes]] = []
    units = done = 0
    held = bytearray()

    def close(part: bytes) -> None:
        nonlocal units, done
        frames.append((units, done, codec.pack(part)))
        units, done = units + part.count(b"\n"), done + len(part)

    for chunk in chunks:
        view = memoryview(chunk)
        while len(held) + len(view) >= size:
            taken = size - len(held)
            close(bytes(held) + bytes(view[:taken]) if held else bytes(view[:taken]))
            held.clear()
            view = view[taken:]
        held += view
    if held:
        close(bytes(held))
    return frames


def ends(codec: Codec, frames: list[tuple[int, int, bytes]]) -> tuple[int, int]:
    """Units and bytes of a stored text; the last frame tells them."""
    if not frames:
        return 0, 0
    units, before, frame = frames[-1]
    last = codec.unpack(frame)
    return units + last.count(b"\n") + (not last.endswith(b"\n")), before + len(last)


def seek(codec: Codec, frames: list[tuple[int, int, bytes]], unit: int, total: tuple[int, int]) -> int:
    """The byte at which a unit begins: the frame with the line end before it is the only one opened."""
    if unit == 0:
        return 0
    if unit >= total[0]:
        return total[1]
    low, high = 0, len(frames)  # the last frame with fewer than `unit` line ends before it
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if frames[mid][0] < unit else (low, mid)
    units, before, frame = frames[low]
    ended = np.flatnonzero(np.frombuffer(codec.unpack(frame), np.uint8) == 10)
    return before + int(ended[unit - units - 1]) + 1


def stream(codec: Codec, frames: list[tuple[int, int, bytes]], start: int, stop: int) -> Iterator[bytes]:
    """The bytes from start to stop, frame by frame."""
    if start >= stop:
        return
    low, high = 0, len(frames)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if frames[mid][1] <= start else (low, mid)
    for _, before, frame in frames[low:]:
        if before >= stop:
            return
        yield codec.unpack(frame)[max(0, start - before) : stop - before]


def find(codec: Codec, frames: list[tuple[int, int, bytes]], markers: tuple[bytes, ...]) -> dict[bytes, int]:
    """The first place of each marker that occurs, also across frames."""
    found: dict[bytes, int] = {}
    tail, keep = b"", max(map(len, markers)) - 1
    for _, before, frame in frames:
        here = tail + codec.unpack(frame)
        for m in markers:
            at = here.find(m) if m not in found else -1
            if at >= 0:
                found[m] = before - len(tail) + at
        tail = here[-keep:]
    return found


def draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def plan(codec: Codec, frames: list[tuple[int, int, bytes]], doc_id: int | None, marked: bool, seed: int, rate: int, spm: int) -> tuple[int, str, list[tuple[int, int]]]:
    """(units, form, byte ranges of prefix, middle and suffix) of a stored text."""
    total = ends(codec, frames)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not frames or marked or h3 % 100 >= rate:
        return total[0], "plain", []
    cuts = sorted((h1 % (total[0] + 1), h2 % (total[0] + 1)))
    a, b = (seek(codec, frames, cut, total) for cut in cuts)
    return total[0], "spm" if h4 % 100 < spm else "psm", [(0, a), (a, b), (b, total[1])]


def arranged(codec: Codec, frames: list[tuple[int, int, bytes]], form: str, parts: list[tuple[int, int]]) -> Iterator[bytes]:
    """The output, piece by piece."""
    if form == "plain":
        yield from stream(codec, frames, 0, 1 << 62)
        return
    for marker, part in ORDERS[form]:
        yield marker
        yield from stream(codec, frames, *parts[part])


def restored(codec: Codec, output: list[tuple[int, int, bytes]], form: str) -> Iterator[bytes]:
    """The text, piece by piece, from the stored output and its form alone."""
    if form == "plain":
        yield from stream(codec, output, 0, 1 << 62)
        return
    at = find(codec, output, MARKERS)
    order = ORDERS[form]
    stops = [at[marker] for marker, _ in order[1:]] + [ends(codec, output)[1]]
    ranges = {part: (at[marker] + len(marker), stop) for (marker, part), stop in zip(order, stops, strict=True)}
    for part in (0, 1, 2):
        yield from stream(codec, output, *ranges[part])


def _characters(chunks: Iterable[bytes]) -> int:
    return sum(int(np.count_nonzero((np.frombuffer(c, np.uint8) & 0xC0) != 0x80)) for c in chunks)


def _digest(chunks: Iterable[bytes]) -> str:
    digest = hashlib.sha256()
    for c in chunks:
        digest.update(c)
    return digest.hexdigest()


def _chunks(data: np.ndarray) -> Iterator[bytes]:
    for at in range(0, len(data), FRAME_BYTES):
        yield data[at : at + FRAME_BYTES].tobytes()


_FORMED = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
_FRAMES = pa.list_(pa.struct([("units", pa.int64()), ("bytes", pa.int64()), ("frame", pa.binary())]))


def infill(documents: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """All columns of documents but text, and n, form, prefix_chars, middle_chars, `output` (stored frames).

    `rate` is the percentage of texts that are transformed, `spm` the percentage of those in suffix-prefix-middle order.
    """
    own = [name for name, _ in _FORMED] + ["output", "text", "_id", "_marked"]
    kept = [c for c in documents.columns if c not in own]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = F.contains(text, F.lit(PREFIX.decode())) | F.contains(text, F.lit(SUFFIX.decode())) | F.contains(text, F.lit(MIDDLE.decode()))
    rows = documents.select(*kept, F.col("doc_id").cast("long").alias("_id"), marked.alias("_marked"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        for batch in batches:
            data, at = text_buffer(batch.column("text"))
            ids, plain = batch.column("_id").to_pylist(), batch.column("_marked").to_pylist()
            done: list[tuple] = []
            size = first = 0

            def rows_of(first: int, done: list[tuple]) -> pa.RecordBatch:
                arrays = [batch.column(c).slice(first, len(done)) for c in kept]
                arrays += [pa.array([r[i] for r in done], kind) for i, (_, kind) in enumerate(_FORMED)]
                output = pa.array([[{"units": u, "bytes": b, "frame": f} for u, b, f in r[4]] for r in done], _FRAMES)
                return pa.RecordBatch.from_arrays([*arrays, output], names=[*kept, *(n for n, _ in _FORMED), "output"])

            for i in range(batch.num_rows):
                frames = store(codec, _chunks(data[at[i] : at[i + 1]]))
                n, form, parts = plan(codec, frames, ids[i], plain[i], seed, rate, spm)
                output = store(codec, arranged(codec, frames, form, parts))
                chars = [None, None] if form == "plain" else [_characters(stream(codec, frames, *p)) for p in parts[:2]]
                done.append((n, form, *chars, output))
                size += int(at[i + 1] - at[i])
                if size >= 16 << 20:
                    yield rows_of(first, done)
                    first, done, size = i + 1, [], 0
            if done:
                yield rows_of(first, done)
            trim()

    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*kept).schema] + ["n long, form string, prefix_chars long, middle_chars long", f"output {STORED}"])
    return rows.mapInArrow(run, shape)


def digests(formed: DataFrame) -> DataFrame:
    """output_sha256 and restored_sha256 in place of the stored output."""
    kept = [c for c in formed.columns if c not in ("output", "output_sha256", "restored_sha256")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        for batch in batches:
            sums: list[tuple[str, str]] = []
            for form, output in zip(batch.column("form"), batch.column("output"), strict=True):
                frames = [(f["units"], f["bytes"], f["frame"]) for f in output.as_py()]
                sums.append((_digest(stream(codec, frames, 0, 1 << 62)), _digest(restored(codec, frames, form.as_py()))))
            names = ["output_sha256", "restored_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array([s[i] for s in sums], pa.string()) for i in (0, 1)], names=kept + names)

    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in formed.select(*kept).schema] + ["output_sha256 string, restored_sha256 string"])
    return formed.mapInArrow(run, shape)


def texts(formed: DataFrame, restore: bool = False) -> DataFrame:
    """`output` as text; with `restore`, `text` rebuilt from output and form."""

    name = "text" if restore else "output"
    kept = [c for c in formed.columns if c not in ("output", name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        for batch in batches:
            made = []
            for form, output in zip(batch.column("form"), batch.column("output"), strict=True):
                frames = [(f["units"], f["bytes"], f["frame"]) for f in output.as_py()]
                chunks = restored(codec, frames, form.as_py()) if restore else stream(codec, frames, 0, 1 << 62)
                made.append(b"".join(chunks).decode())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(made, pa.string())], names=[*kept, name])

    return formed.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in formed.select(*kept).schema] + [f"{name} string"]))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return digests(infill(documents)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


SQL = r"""
WITH d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(CAST(doc_id AS BIGINT) AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
