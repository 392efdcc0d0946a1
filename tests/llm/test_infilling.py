"""Infilling: cuts and outputs against plain Python, frames of a few bytes, and odd rows."""

import hashlib
import random
import re

import pytest

from tesserae.llm import op11_infilling as op


def plain(text, doc_id, rate=100, spm=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def some_texts():
    rng = random.Random(11)
    alphabet = ["a", "b c", "\n", "\n\n", "é", "\U0001f600", "<", "<P", "S>", "x" * 40]
    texts = ["", "\n", "one line", "ends\n", "<P", "a<P>b\nc", "\n\n\n", "x" * 500, "<S\n<M\n>"]
    return texts + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(120)]


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1 << 16])
def test_frames_of_any_size(size):
    codec = op.Codec()
    for doc_id, text in enumerate(some_texts()):
        data = text.encode()
        frames = op.store(codec, [data[i : i + 5] for i in range(0, len(data), 5)], size)
        assert b"".join(op.stream(codec, frames, 0, 1 << 62)) == data
        units = re.findall(rb"[^\n]*\n|[^\n]+", data)
        total = op.ends(codec, frames)
        assert total == (len(units), len(data))
        assert [op.seek(codec, frames, k, total) for k in range(len(units) + 1)] == [len(b"".join(units[:k])) for k in range(len(units) + 1)]
        marked = any(m in data for m in op.MARKERS)
        n, form, parts = op.plan(codec, frames, doc_id, marked, 7, 100, 50)
        output = op.store(codec, op.arranged(codec, frames, form, parts), size)
        expected = plain(text, doc_id)
        assert (n, form, b"".join(op.stream(codec, output, 0, 1 << 62)).decode()) == (*expected[:2], expected[4])
        assert b"".join(op.restored(codec, output, form)) == data


def test_table(spark):
    texts = [*some_texts(), "line of a long text\n" * 30_000 + "end", None]
    rows = [(i if i else None, t, "mine", 5) for i, t in enumerate(texts)] + [(3, texts[3], "again", 6), (3, "other", "again", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, extra int").repartition(3)
    formed = op.infill(docs)
    assert formed.columns == ["doc_id", "extra", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted((r.extra, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in op.texts(formed).where("doc_id = 3").collect())
    assert got == sorted((e, *plain(t, 3)) for e, t in ((5, texts[3]), (6, texts[3]), (7, "other")))
    sums = {(r.doc_id, r.extra): r for r in op.digests(formed).collect()}
    back = {(r.doc_id, r.extra): r.text for r in op.texts(formed, restore=True).collect()}
    assert len(sums) == len(rows)
    for doc_id, text, _, extra in rows:
        r, expected = sums[doc_id, extra], plain(text or "", doc_id)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == expected[:4]
        assert r.output_sha256 == hashlib.sha256(expected[4].encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((text or "").encode()).hexdigest() and back[doc_id, extra] == (text or "")


def test_rates_and_no_rows(spark):
    docs = spark.createDataFrame([(i, f"a{i}\nb\nc\n") for i in range(300)], "doc_id long, text string")
    forms = {r.doc_id: r.form for r in op.infill(docs, rate=30, spm=100).select("doc_id", "form").collect()}
    assert all(forms[i] == plain(f"a{i}\nb\nc\n", i, 30, 100)[1] for i in range(300)) and set(forms.values()) == {"plain", "spm"}
    assert op.digests(op.infill(docs.limit(0))).collect() == []
