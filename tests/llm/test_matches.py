"""The longest match of each item and its place, against brute force."""

import random

from tesserae.llm import op02_decontaminate


def longest(doc: list[str], item: list[str]) -> int:
    best = 0
    for i in range(len(doc)):
        for j in range(len(item)):
            n = 0
            while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
                n += 1
            best = max(best, n)
    return best


def test_shared_and_repeated_passages(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(10**6)}"
    shared, one, two = ([word() for _ in range(n)] for n in (12, 9, 20))
    items = {"a": shared + one, "b": [word(), *shared, *two], "c": [*shared, word(), word(), *shared, *one, *two], "d": shared[:6]}
    docs = {1: [word(), *shared, *two, word()], 2: [*shared, *one, *two], 3: [*shared, word(), *shared, *one]}
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id string, text string")
    frame = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string")
    for r in op02_decontaminate.contamination(frame, bench).collect():
        doc = docs[r.doc_id]
        assert {m.item: m.n_words for m in r.matches} == {k: longest(doc, v) for k, v in items.items()}
        for m in r.matches:
            assert doc[m.doc_start : m.doc_start + m.n_words] == items[m.item][m.item_start : m.item_start + m.n_words]
