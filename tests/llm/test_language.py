"""Language identification against a plain reading of the model, and long texts in pieces."""

import collections
import math
import random

import numpy as np
import pyarrow as pa

from tesserae.llm import op05_language as g

BUCKETS = 1 << 12


def grams(text: str) -> list[int]:
    letters = " " + "".join(c.lower()[0] if c.isalpha() else " " for c in text) + " "
    out = []
    for n in g.ORDERS:
        for i in range(len(letters) - n + 1):
            piece = letters[i : i + n]
            if piece.strip():
                h = 0
                for c in piece:
                    h = (h * 0x01000193 + ord(c) + 1) % 2**32
                h = ((h ^ h >> 15) * 0x9E3779B1 + n * 0x85EBCA6B) % 2**32
                out.append((h ^ h >> 16) % BUCKETS)
    return out


def test_against_plain_counts(spark):
    rng = random.Random(6)
    rows = [("en", "the quick brown fox jumps"), ("en", "a lazy dog"), ("fr", "le renard brun \u00e9tait l\u00e0"), ("de", "der schnelle Fuchs, \u00fcber"), ("fr", ""), ("xx", None), (None, "nothing")]
    counts, docs = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        if lang and text is not None:
            counts[lang].update(grams(text))
            docs[lang] += 1
    model = g.train(spark.createDataFrame(rows, "lang string, text string"), BUCKETS)
    assert model.languages == sorted(docs)
    texts = ["".join(rng.choice("abcdefghij klmnoprstuv\u00e9") for _ in range(60)) for _ in range(20)] + ["", "1 2", "Fuchs"]
    logs = {la: {b: math.log((counts[la][b] + 0.1) / (sum(counts[la].values()) + 0.1 * BUCKETS)) for t in texts for b in grams(t)} for la in docs}
    best, score = g.identify(pa.array(texts), model)
    for t, b, s in zip(texts, best.tolist(), score.tolist(), strict=True):
        if not any(c.isalpha() for c in t):
            assert (b, s) == (len(docs), 0)
            continue
        total = {la: math.log(docs[la] / sum(docs.values())) + sum(logs[la][x] for x in grams(t)) for la in docs}
        top = max(sorted(total), key=total.get)
        assert model.languages[b] == top
        assert math.isclose(s, 1 / sum(math.exp(v - total[top]) for v in total.values()), rel_tol=1e-4)


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice("abc d\u00e9f\U0001f600 \u00df") for _ in range(5000))
    texts = pa.array(["ab", text, "", "c"])

    def counted():
        out = np.zeros((4, BUCKETS), np.int64)
        for framed, start, rows, after in g.framed_pieces(texts):
            cells, _ = g.ngram_buckets(framed, start, BUCKETS, after)
            for row in cells:
                np.add.at(out, (np.repeat(rows, np.diff(np.append(start, len(framed)))), np.minimum(row, BUCKETS - 1)), row < BUCKETS)
        return out

    whole = counted()
    monkeypatch.setattr(g, "LIMIT", 700)
    assert (counted() == whole).all() and whole[1].sum() > 9000


def test_columns_of_the_same_name_are_replaced(spark):
    model = g.train(spark.createDataFrame([("en", "hello there")], "lang string, text string"))
    out = g.predict(spark.createDataFrame([(1, "hello", "x", 2.0)], "doc_id long, text string, lang_pred string, score double"), model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score"] and out.first().lang_pred == "en"
