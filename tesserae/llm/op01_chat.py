"""Chat formatting by columnar byte assembly.

Each conversation becomes one string. A turn is laid out as

    <turn>\\n{role}\\n<text>\\n{text}\\n</turn>\\n

and every control string inside a role or text gets one more backslash in front
of the backslashes that it already has, which `unescape` takes away again. Real
markers always stand at a line start, so none is ever preceded by a backslash.

Conversations are dealt out by `conv_id` and sorted by turn in Spark; a task
streams through them with Arrow batches. Segment lengths, cumulative offsets and
scatter indices are computed in numpy, and headers and contents are copied into
one preallocated buffer that becomes the Arrow column. A task holds one batch and
the conversation at its end: a conversation is one output value, so that much is
inherent.

Defined results: null role or text: empty; null `conv_id`: one conversation of
its own; equal turns: ordered by role, then text; a null turn comes first; no
rows: no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import table, text_buffer

OPEN, MIDDLE, CLOSE = "<turn>\n", "\n<text>\n", "\n</turn>\n"
CONTROLS = ("<turn>", "<text>", "</turn>")
_ANY = "|".join(map(re.escape, CONTROLS))
_ESCAPED = re.compile(rf"\\(\\*(?:{_ANY}))")
FORMATTED = "conv_id long, formatted string, n_turns long, loss_spans array<struct<start:long,end:long>>"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, rf"(\\*(?:{_ANY}))", r"\\\1")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _copy(out: np.ndarray, texts: pa.Array, to: np.ndarray) -> None:
    """Scatter the bytes of each text to its place in the buffer."""
    data, at = text_buffer(texts)
    out[np.arange(len(data)) + np.repeat(to - at[:-1], np.diff(at))] = data


def _stamp(out: np.ndarray, mark: str, to: np.ndarray) -> None:
    out[to[:, None] + np.arange(len(mark))] = np.frombuffer(mark.encode(), np.uint8)


def assemble(rows: pa.Table, trained: str) -> pa.RecordBatch:
    """Whole conversations, sorted, to one row each."""
    ids = rows["conv_id"].combine_chunks()
    role, text = (escape(pc.fill_null(rows[c], "").combine_chunks()) for c in ("role", "text"))
    long = [np.diff(text_buffer(x)[1]) for x in (role, text)]
    fixed = len(OPEN) + len(MIDDLE) + len(CLOSE)
    size = fixed + long[0] + long[1]
    end = np.cumsum(size)
    start = end - size
    out = np.empty(int(end[-1]), np.uint8)
    _stamp(out, OPEN, start)
    _copy(out, role, start + len(OPEN))
    _stamp(out, MIDDLE, start + len(OPEN) + long[0])
    _copy(out, text, start + len(OPEN) + long[0] + len(MIDDLE))
    _stamp(out, CLOSE, end - len(CLOSE))

    key = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    null = pc.is_null(ids).to_numpy(zero_copy_only=False)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (null[1:] != null[:-1])
    first = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.append(start[first], end[-1])), pa.py_buffer(out))

    chars = [pc.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (role, text)]
    wide = fixed + chars[0] + chars[1]
    before = np.cumsum(wide) - wide
    before -= before[first][which]
    taught = pc.fill_null(pc.equal(rows["role"].combine_chunks(), trained), False).to_numpy(zero_copy_only=False)
    begin = (before + len(OPEN) + chars[0] + len(MIDDLE))[taught]
    per = np.bincount(which[taught], minlength=len(first))
    masks = pa.ListArray.from_arrays(
        pa.array(np.append(0, np.cumsum(per)).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(begin), pa.array(begin + chars[1][taught])], names=["start", "end"]),
    )
    turns = np.diff(np.append(first, len(key)))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), formatted, pa.array(turns.astype(np.int64)), masks], names=["conv_id", "formatted", "n_turns", "loss_spans"])


def format_chats(conversations: DataFrame, trained: str = "assistant", batch_bytes: int = 32_000_000) -> DataFrame:
    """conv_id, formatted, n_turns, and the code-point spans of `formatted` that carry loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < batch_bytes:
                continue
            rows = pa.Table.from_batches(held)
            last = rows["conv_id"][-1]
            ids = rows["conv_id"]
            other = pc.is_valid(ids) if not last.is_valid else pc.fill_null(pc.not_equal(ids, last), True)
            done = int(pc.sum(other).as_py() or 0)  # sorted: the last conversation is at the end
            if done:
                yield assemble(rows.slice(0, done), trained)
                held = rows.slice(done).to_batches()
            size = sum(b.nbytes for b in held)
        if held:
            yield assemble(pa.Table.from_batches(held), trained)

    rows = conversations.select(F.col("conv_id").cast("long"), "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations and digest what they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text, turns, n, loss, taught = r["formatted"], hashlib.sha256(), 0, hashlib.sha256(), 0
                for part in text.split(CLOSE)[:-1]:
                    role, _, said = part[len(OPEN) :].partition(MIDDLE)
                    turns.update(f"{unescape(role)}\n{unescape(said)}\n".encode())
                    n += 1
                for s in r["loss_spans"]:
                    said = unescape(text[s["start"] : s["end"]])
                    loss.update(said.encode())
                    taught += len(said)
                rows.append((r["conv_id"], n, turns.hexdigest(), taught, loss.hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], kinds[i]) for i in range(6)], names=names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(0, 2, 1, 1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return read_back(format_chats(given.unionByName(extra)))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (
  SELECT *, 24 + length(role) + length(text)
    + (length(role) - length(replace(role, '<turn>', ''))) // 6 + (length(text) - length(replace(text, '<turn>', ''))) // 6
    + (length(role) - length(replace(role, '<text>', ''))) // 6 + (length(text) - length(replace(text, '<text>', ''))) // 6
    + (length(role) - length(replace(role, '</turn>', ''))) // 7 + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS width
  FROM t)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(width) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
