"""Language-model scores against plain dictionaries, for any number of shards; long texts and tries."""

import collections
import math
import random

import numpy as np
import pytest

from tesserae.llm import op06_lm as g


def plain(texts: dict[int, str], held: set[int]) -> dict[int, tuple[float, float]]:
    words = {i: [*t.encode().split(), b""] for i, t in texts.items()}  # b"": the end
    c1, c2, c3, t2, t3 = (collections.Counter() for _ in range(5))
    for i in words:
        u = v = None
        for w in words[i] if i not in held else ():
            for counter, gram in ((c1, w), (c2, (v, w)), (c3, (u, v, w)), (t2, v), (t3, (u, v))):
                counter[gram] += 1
            u, v = v, w
    near = lambda p: 10.0 ** (-min(254, round(-math.log10(p) * (254 / g.DECADES))) * (g.DECADES / 254))
    n, many, out = sum(c1.values()), len(c1), {}
    for i in words:
        u, v, base, score = None, None, 0.0, 0.0
        for w in words[i]:
            p = (c1[w] + 1) / (n + many + 1)
            base += math.log10(p)
            for c, t, mu in ((c2[(v, w)], t2[v], g.MU2), (c3[(u, v, w)], t3[(u, v)], g.MU3)):
                p = min(1.0, (near(c / (t + mu)) if c else 0.0) + (near(mu / (t + mu)) if t else 1.0) * p)
            score += math.log10(p)
            u, v = v, w
        out[i] = base, score
    return out


@pytest.mark.parametrize(("shard_tokens", "batch_tokens", "frequent"), [(1_000_000, 1_000_000, 1 << 18), (300, 700, 16), (40, 100, 4)])
def test_scores_against_plain_counts(spark, monkeypatch, shard_tokens, batch_tokens, frequent):
    rng = random.Random(9)
    few, many = "the of and a".split(), [f"w{i}" for i in range(60)]
    texts = {i: " ".join(rng.choice(few if rng.random() < 0.6 else many) for _ in range(rng.randint(0, 60))) for i in range(120)}
    texts[200] = texts[201] = "of the of the of the and the of the a"
    held = {i for i in texts if i % 5 == 0}
    monkeypatch.setattr(g, "FREQUENT", frequent)
    monkeypatch.setattr(g, "BEGIN_ID", frequent + 1)
    monkeypatch.setattr(g, "LOWEST_HASH", np.uint64(frequent + 2))
    frame = spark.createDataFrame([(i, t, i in held) for i, t in texts.items()], "doc_id long, text string, held_out boolean")
    want = plain(texts, held)
    rows = g.score(frame, shard_tokens, batch_tokens).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert math.isclose(r.base_score, want[r.doc_id][0], rel_tol=1e-9) and math.isclose(r.score, want[r.doc_id][1], rel_tol=1e-9), r


def test_long_texts_are_read_in_pieces(spark):
    rng = random.Random(10)
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(400_000))
    texts = {1: long, 2: "w1 w2 w3", 3: " " * 2_500_000, 4: ""}
    frame = spark.createDataFrame([(i, t, False) for i, t in texts.items()], "doc_id long, text string, held_out boolean")
    want = plain(texts, set())
    rows = {r.doc_id: r for r in g.score(frame, batch_tokens=100_000).collect()}
    assert len(rows) == 4 and rows[3].n_tokens == rows[4].n_tokens == 1
    assert all(math.isclose(rows[i].score, want[i][1], rel_tol=1e-9) for i in texts)


def test_trie_finds_its_ngrams_and_no_others():
    rng = np.random.default_rng(11)
    grams = np.unique(rng.integers(0, 40, (3000, 3)) ** 3, axis=0).astype(np.uint64)
    inside, other = grams[::2], grams[1::2]
    v, u, w = inside.T.copy()
    c = rng.integers(1, 9, len(v))
    t3, t2 = g._by_run(v, c, u), g._by_run(v, c)
    trie = g.Trie(v, u, w, c, t3, t2, np.ones(len(v), bool))
    words = np.arange(40, dtype=np.uint64) ** np.uint64(3)
    ask = lambda rows: trie.lookup(words, *np.searchsorted(words, rows).T)
    a3, g3, a2, g2 = ask(inside)
    assert (a3 == g.quantise(c / (t3 + g.MU3))).all() and (g3 == g.quantise(g.MU3 / (t3 + g.MU3))).all() and (g2 == g.quantise(g.MU2 / (t2 + g.MU2))).all()
    a3, g3, a2, g2 = ask(other)
    assert (a3 == 0).all()
    pairs, contexts = {tuple(x) for x in inside[:, [0, 2]].tolist()}, {tuple(x) for x in inside[:, :2].tolist()}
    assert [x > 0 for x in a2.tolist()] == [(a, b) in pairs for a, _, b in other.tolist()]
    assert [x > 0 for x in g3.tolist()] == [(a, b) in contexts for a, b, _ in other.tolist()]


def test_elias_fano_access():
    rng = np.random.default_rng(12)
    for n, bound in ((1, 2), (300, 301), (5000, 1 << 20), (5000, 1 << 47)):
        values = np.sort(rng.integers(0, bound, n))
        assert (g.EliasFano.build(values, bound).access(np.arange(n)) == values).all()
