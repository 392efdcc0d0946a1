"""The near-copy stage against brute force, over all pairs."""

import random

import numpy as np
import pyarrow as pa

from tesserae.llm import op10_simhash


def kept(texts: dict[int, str], similarity: float = 0.8) -> list[int]:
    """Ids in rising order; one goes if it is similar to one that stays."""

    def shingles(t: str) -> set:
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    stay: dict[int, set] = {}
    for i in sorted(texts):
        s = shingles(texts[i])
        if not any((len(s & k) / len(s | k) if s | k else 1.0) >= similarity for k in stay.values()):
            stay[i] = s
    return list(stay)


def dropped(spark, texts: dict[int, str]) -> list[int]:
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return sorted(r.doc_id for r in op10_simhash.drop_near_copies(frame).select("doc_id").collect())


def edited(rng: random.Random, text: str, n: int) -> str:
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"edit{rng.randrange(10**9)}"
    return " ".join(w)


def test_chance_linked_centre(spark):
    rng = random.Random(3)
    few = "alpha beta gamma delta".split()
    text = lambda: " ".join(rng.choice(few) for _ in range(400))  # noqa: E731  all hold the same word pairs
    texts = {1: text(), 2: text()}
    texts[3] = texts[2] + " alpha alpha"
    texts[4] = texts[1]
    texts[5], texts[6], texts[7] = "", " ", "alpha"
    assert kept(texts) == [1, 2, 5, 7]
    assert dropped(spark, texts) == [1, 2, 5, 7]


def test_every_similar_pair_is_found(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    texts, i = {}, 0
    for length in (8, 30, 100, 1000):
        for _ in range(60):
            text = " ".join(rng.choice(words) for _ in range(length))
            texts[i], texts[i + 1] = text, edited(rng, text, rng.randint(1, max(1, length // 45)))
            i += 2
    assert dropped(spark, texts) == kept(texts)


def test_every_link_is_in_a_group(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 20).tolist()
    prints = sorted({b ^ sum(1 << int(x) for x in rng.choice(62, k, replace=False)) for b in base for k in (0, 1, 2, 2, 3, 4, 5)})
    want = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 4}
    nodes = spark.createDataFrame([(0, p) for p in prints], "part int, fp long")
    for limit in (4096, 2):
        groups = {}
        for r in op10_simhash.link_stars(nodes, limit).collect():
            groups.setdefault(r.a, {r.a}).add(r.b)
        assert all(any({a, b} <= g for g in groups.values()) for a, b in want)


def test_a_large_group_goes_in_few_pairs(spark):
    rng = random.Random(13)
    words = [f"w{i}" for i in range(3000)]
    text = " ".join(rng.choice(words) for _ in range(300))
    texts = {i: edited(rng, text, 2) for i in range(200)} | {i: " ".join(rng.choice(words) for _ in range(100)) for i in range(200, 260)}
    assert dropped(spark, texts) == kept(texts)


def hashed(texts: list[str]) -> tuple[list, list]:
    """The shingle hashes of each text, and its least hashes."""
    values, count = op10_simhash.set_hashes(pa.array(texts), 5)
    values, count = op10_simhash._distinct(values, count)
    sets = np.split(values.view(np.int64), np.cumsum(count)[:-1])
    return [s.tolist() for s in sets], [m.tobytes() for m in op10_simhash.least_hashes(values, count)[1]]


def test_only_groups_with_a_ready_head_meet_their_members(spark, monkeypatch):
    rng = random.Random(19)
    text = " ".join(rng.choice([f"w{i}" for i in range(3000)]) for _ in range(300))
    sets, mins = hashed([edited(rng, text, 2) for _ in range(41)])
    # 0 leads the first group; the heads of the others, 1 to 9, are in it too and can't be ready
    groups = [(0, i) for i in range(41)] + [(g, i) for g in range(1, 10) for i in range(g, 41)]
    frame = spark.createDataFrame([(g, i, len(sets[i])) for g, i in groups], "gid long, doc_id long, n int")
    nodes = spark.createDataFrame([(i, bytearray(mins[i])) for i in range(41)], "doc_id long, mins binary")
    made, join = {"gid": 0, "b": 0}, op10_simhash.salted_join

    def counted(left, right, key, *more):
        made[key] = made.get(key, 0) + join(left, right, key, *more).count()
        return join(left, right, key, *more)

    monkeypatch.setattr(op10_simhash, "salted_join", counted)
    gone = op10_simhash.losers(frame, nodes, spark.createDataFrame(list(enumerate(sets)), "doc_id long, s array<long>"), 0.8)
    assert sorted(r.doc_id for part in gone for r in part.collect()) == list(range(1, 41))
    assert made["gid"] == 41 and made["b"] == 40


def test_a_close_pair_comes_from_one_group(spark):
    rng = random.Random(23)
    text = " ".join(rng.choice([f"w{i}" for i in range(3000)]) for _ in range(300))
    sets, mins = hashed([edited(rng, text, 2) for _ in range(30)] + ["alone"])
    rows = [(g, i, len(sets[i])) for g in range(-4, 4) for i in range(30) if i % 8 != g + 4] + [(9, 30, 1)]
    groups = spark.createDataFrame(rows, "gid long, doc_id long, n int")
    nodes = spark.createDataFrame([(i, bytearray(m)) for i, m in enumerate(mins)], "doc_id long, mins binary")
    for limit in (1024, 7):
        found = sorted((r.a, r.b) for r in op10_simhash.close_pairs(groups, nodes, 0.8, limit).collect())
        assert found == [(a, b) for a in range(30) for b in range(a + 1, 30)]


def test_a_hub_is_one_component(spark):
    links = spark.range(1, 5000).selectExpr("0L as a", "id as b").unionByName(spark.range(1).selectExpr("7000L as a", "8000L as b"))
    roots = {(r.node, r.root) for r in op10_simhash.components(links).collect()}
    assert roots == {(i, 0) for i in range(1, 5000)} | {(8000, 7000)}


def test_a_long_text_is_hashed_in_pieces():
    rng = random.Random(17)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(400_000))
    texts = pa.array(["a b c d e f", long, None, "x"])
    for words in (2, 4):
        for distinct in (False, True):
            values, count = op10_simhash.xx_hashes(texts, words, 42)
            whole = op10_simhash.majority(*(op10_simhash._distinct(values, count) if distinct else (values, count)))
            assert (op10_simhash.simhash(texts, words, 42, distinct) == whole).all()


def test_judged_in_rising_order(spark):
    rng = random.Random(11)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)})
    for ready in (set(range(60)), {i for i in range(60) if i % 7}):
        stays, goes, waits = set(), set(), set()
        for i in range(60):
            smaller = [a for a, b in pairs if b == i]
            if any(a in stays for a in smaller):
                goes.add(i)
            elif i not in ready or any(a in waits for a in smaller):
                waits.add(i)
            else:
                stays.add(i)
        for limit in (1_000_000, 10):
            frame, may = spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame([(i,) for i in ready], "doc_id long")
            stay, go = op10_simhash.judge(frame, may, limit)
            assert ({r.doc_id for r in stay.collect()}, {r.doc_id for r in go.collect()}) == (stays, goes)


def test_each_text_of_a_repeated_id_is_judged(spark):
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(120))
    shared, own = text(), [text() for _ in range(8)]
    rows = [(1, shared), *((i, shared) for i in range(2, 8)), *((i, own[i]) for i in range(2, 8)), (2, own[2]), (9, edited(rng, own[3], 1)), (None, shared)]
    left = sorted(((r.doc_id or 0, r.text) for r in op10_simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert [t for i, t in left if i == 1] == [shared] and [t for i, t in left if i == 0] == [shared]
    texts = [t for i, t in left if i > 1]
    assert all(own[i] in texts for i in (2, 4, 5, 6, 7)) and shared not in texts
    assert (own[3] in texts) != any(i == 9 for i, _ in left)  # one of the two near copies
