"""Repeated passages against brute force, the texts that are kept, and long texts in steps."""

import random

import numpy as np
import pyarrow as pa

from tesserae.llm import op04_chunks


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(n))


def test_recall_kept_documents_and_clean_texts(spark):
    rng = random.Random(4)
    shared = [words(rng, 60) for _ in range(8)]
    texts, planted = {}, set()
    seen = set()
    for i in range(160):
        part = rng.randrange(len(shared)) if i % 2 else None
        texts[i] = words(rng, rng.randint(20, 80)) + (f" {shared[part]} " if part is not None else " ") + words(rng, rng.randint(20, 80))
        if part is not None:
            if part in seen:
                planted.add(i)
            seen.add(part)
    texts[200] = texts[3] + " new " + texts[3]  # a copy of a whole text, twice
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = op04_chunks.repeated_spans(frame).collect()
    found = {r.doc_id for r in rows}
    assert len(found & planted) >= 0.95 * len(planted)
    assert found <= planted | {200}
    for r in rows:
        assert r.kept_doc_id <= r.doc_id
        text, kept = texts[r.doc_id][r.start : r.end], texts[r.kept_doc_id]
        start, end = op04_chunks.cuts(np.frombuffer(kept.encode(), np.uint8), np.array([0, len(kept.encode())]))
        own = {kept.encode()[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)}
        whole = texts[r.doc_id].encode()
        start, end = op04_chunks.cuts(np.frombuffer(whole, np.uint8), np.array([0, len(whole)]))
        mine = [whole[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True) if r.start <= a and b <= r.end]
        assert b"".join(mine).decode() == text and all(m in own for m in mine)
    left = {r.doc_id: r.text for r in op04_chunks.deduplicate(frame).collect()}
    assert all(left[i] == texts[i] for i in texts if i not in found) and len(left[200]) < len(texts[3])


def test_long_texts_are_cut_as_whole(monkeypatch):
    rng = random.Random(5)
    text = (words(rng, 3000) + " \u00e9\u00df\U0001f600 ") * 3 + "x" * 5000
    texts = pa.array(["short one", text, "", "tail"])
    whole = [tuple(map(np.ndarray.tolist, x)) for x in op04_chunks.chunked(texts)]
    monkeypatch.setattr(op04_chunks, "LIMIT", 5000)
    parts = [tuple(map(np.ndarray.tolist, x)) for x in op04_chunks.chunked(texts)]
    for k in range(5):
        assert [v for p in whole for v in p[k]] == [v for p in parts for v in p[k]]


def test_unique_text_of_a_repeated_id_stays(spark):
    rng = random.Random(6)
    shared, own, other = words(rng, 80), words(rng, 80), words(rng, 80)
    rows = [(1, shared), (2, shared), (2, own), (3, own + " " + other), (3, own), (3, own)]
    left = sorted((r.doc_id, r.text) for r in op04_chunks.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert (1, shared) in left and (2, own) in left and all(len(t) < 40 for i, t in left if i == 2 and t != own)
    assert [len(t) < 40 for i, t in left if i == 3].count(True) == 2 and any(other[20:-20] in t for i, t in left if i == 3)
