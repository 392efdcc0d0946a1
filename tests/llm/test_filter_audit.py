"""Filter audit: tries, ranges and counts against plain Python."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from tesserae.llm import op12_filter_audit as op


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    bits = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text))]
    return sum(b << i for i, b in enumerate(bits))


def brute_masks(rows):
    least = {}
    for doc_id, _, text in rows:
        key = op.LAST_ID if doc_id is None else doc_id
        least[text or ""] = min(least.get(text or "", key), key)
    return Counter((doc_id, lang or "", fails(text or "") | 16 * ((op.LAST_ID if doc_id is None else doc_id) > least[text or ""])) for doc_id, lang, text in rows)


def brute_audit(masks, labels):
    quality, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    out = {}
    for part in {p for _, p, _ in masks}:
        shapley = Counter()
        docs = [(i, m, n) for (i, p, m), n in masks.items() if p == part]
        for order in itertools.permutations("ABCDE"):
            gone = 0
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                row = Counter()
                for i, m, n in docs:
                    removed = m & bit and not m & gone
                    row["kept"] += n * (not m & (gone | bit))
                    row["removed"] += n * bool(removed)
                    row["redundant"] += n * bool(m & bit and m & gone)
                    row["unique_fails"] += n * (m == bit)
                    row["good_lost"] += n * bool(removed and i in quality)
                    row["toxic_lost"] += n * bool(removed and i in toxic)
                shapley[letter] += row["removed"]
                out[part, "".join(order), step] = row
                gone |= bit
        for key, row in out.items():
            if key[0] == part:
                row["shapley"] = shapley[key[1][key[2] - 1]]
    return out


def some_rows():
    rng = random.Random(12)
    texts = ["", "a", "ab", "abc", "B#", "word " * 250, "Word Other " * 200, " ".join(map(str, range(300))), "é" * 20, "é" * 19 + "e", "x" * 3000, "x" * 3000 + "y", "x" * 2999]
    texts += ["shared start of many texts, longer than the first prefix " + "".join(rng.choice("ab") for _ in range(k % 6)) for k in range(60)]
    rows = [(rng.randint(0, 400), rng.choice(["en", "de", None]), rng.choice([*texts, None])) for _ in range(500)]
    return [*rows, *rows[:40], (None, "en", "abc"), (None, "en", "abc"), (None, None, "only here"), *((1000 + i, "en", "x" * 3000) for i in range(200)), *((7, "de", "one id, one text"),) * 50]


def test_trie():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))).encode() for _ in range(2000)]
    trie, least = op.Trie(), {}
    ids = [rng.randint(0, 10**6) for _ in texts]
    terminals = [trie.insert(t, i) for t, i in zip(texts, ids, strict=True)]
    for t, i in zip(texts, ids, strict=True):
        least[t] = min(i, least.get(t, i))
    assert [node[1] for node in terminals] == [least[t] for t in texts]
    seen = []

    def walk(node, before):
        whole = before + node[0]
        if node[1] is not None:
            seen.append(whole)
        assert not (node is not trie.root and node[1] is None and len(node[2]) < 2), "edges are compressed"
        for byte, child in node[2].items():
            assert child[0][0] == byte
            walk(child, whole)

    walk(trie.root, b"")
    assert sorted(seen) == sorted(least)


@pytest.mark.parametrize(("size", "local"), [(16 << 20, 32 << 20), (20_000, 2000)])
def test_masks(spark, monkeypatch, size, local):
    monkeypatch.setattr(op, "RANGE_BYTES", size)
    monkeypatch.setattr(op, "LEAST_RANGE_BYTES", min(size, op.LEAST_RANGE_BYTES))
    monkeypatch.setattr(op, "LOCAL_BYTES", local)
    rows = some_rows()
    docs = spark.createDataFrame([(*r, 1, "mine") for r in rows], "doc_id long, lang string, text string, mask int, part string").repartition(5)
    got = Counter()
    for r in op.masks(docs).collect():
        got[r.doc_id, r.part, r.mask] += r.n
    assert got == brute_masks(rows)


def test_ranges_are_split(spark, monkeypatch):
    monkeypatch.setattr(op, "RANGE_BYTES", 3000)
    monkeypatch.setattr(op, "LEAST_RANGE_BYTES", 3000)
    texts = spark.createDataFrame([(r[2] or "",) for r in some_rows()], "text string")
    split, parts, _ = op.split_ranges(texts.withColumn("prefixes", op.prefixes(texts["text"])))
    known = texts.select(op.prefixes(texts["text"]).alias("p"), "text").distinct().collect()
    where = {r.text: [int(h) in set(split.tolist()) for h in r.p] for r in known}
    assert where["x" * 3000] == [True, True, True, True] and parts.max() > 100  # one frequent text
    assert where["a"] == [False] and where["shared start of many texts, longer than the first prefix "][0]
    hashes, frequent, _ = op._first_unsplit(texts.select(op.prefixes(texts["text"]).alias("p")).toArrow()["p"].combine_chunks(), split)
    assert len(hashes) == len(some_rows()) and frequent.sum() >= 200 and np.all(np.diff(split) > 0)


def test_counts(spark):
    rows = some_rows()
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 300, 2)] + [(4, 0, 0), (4, 1, 1), (None, 1, 1), (8, None, None)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = op.audit(op.masks(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    expected = brute_audit(brute_masks(rows), labels)
    assert len(got) == 600 * 3 == len(expected)
    for r in got:
        row = expected[r.part, r.filter_order, r.step]
        assert all(r[c] == row[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert op.audit(op.masks(docs), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
