"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import op01_chat, op02_decontaminate, op03_fingerprint, op04_chunks, op05_language, op06_lm, op07_mixing, op08_pii, op09_toxicity, op10_simhash
from tesserae.llm.queries import QUERIES

CLASHES = "c0 keys n_tokens label weight docs t epochs position block hash bucket before mix_key epoch _gone gone id score lang_pred found toxicity hits matches n_words digest attempts made text_ a b n".split()
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
LONG = " ".join(f"w{i % 997} tail{i % 13}." for i in range(20_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the old river bank at dawn", "en", "a"),
    (1, "the quick brown fox jumps over the lazy dog near the old river bank at dawn", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank at dawn", "en", None),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, "   \n\t ", "de", "b"),
    (6, LONG, "en", "b"),
    (7, "ein zwei drei vier fünf sechs sieben acht neun zehn elf zwölf", "de", "b"),
    (None, "ein zwei drei", "de", "b"),
    (9, "\U0001f600 ünïcödé İ ẞ", "de", "c"),
    (-10, "you are an idiot and a moron.", "en", "c"),
]
BENCH = [(1, "lazy dog near the old river bank at dawn the fox"), (2, "vier fünf"), (3, None), (4, ""), (2, "vier fünf"), (None, "neun zehn elf")]


def documents(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t), *CLASHES) for i, t, la, s in rows], DOCUMENTS)


@pytest.fixture(scope="module", params=["rows", "none"])
def folder(request, spark, tmp_path_factory):
    """The tables with odd rows, and empty ones."""
    path, full = str(tmp_path_factory.mktemp(request.param)), request.param == "rows"
    some = lambda rows: rows if full else []
    documents(spark, some(ROWS)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(some(BENCH), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(some([(-10, 0, 1), (1, 1, 0), (7, None, None), (None, 1, 1), (-10, 0, 1)]), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    talk = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a"), (None, 0, "user", "x\\</turn>"), (2, None, None, "\\"), (2, 3, "assistant", "<text>\n</turn>\n<turn>")]
    spark.createDataFrame(some(talk), "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    page = "<article><p>A page, which is long enough, and has commas.</p></article>"
    spark.createDataFrame(some([(1, "u", page), (1, "u", page), (None, None, None), (2, "", "<nav>")]), "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path, full


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_odd_tables(spark, folder, name):
    path, full = folder
    rows = QUERIES[name](spark, path).collect()
    if name.startswith("op1_"):
        assert len(rows) == (4 if full else 1)
    elif not full:
        assert rows == []
    elif name.startswith("op4_"):
        assert all(r.doc_id != 1 or r.kept_doc_id == 1 for r in rows)
    elif name.startswith("op7_"):
        assert len({r.doc_id for r in rows}) == len({r[0] for r in ROWS})
    elif name.startswith("op12_"):  # all orders and steps for en, de and no language
        assert len(rows) == 3 * 600 and sum(r.kept + r.removed for r in rows if r.step == 1 and r.filter_order == "ABCDE") == len(ROWS)
    elif name.startswith("op13_"):
        assert sorted(r.n_chars for r in rows) == [0, 0, 45, 45]
    else:
        assert len(rows) == len(ROWS)


def test_pipeline_on_odd_tables(spark, folder):
    path, full = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "mixing":
            assert out.columns == docs.columns, name
        assert all(getattr(r, c) == c for r in out.select(*CLASHES).collect() for c in CLASHES if name != "mixing" or c not in ("weight", "epoch", "position", "block"))
        docs = spark.createDataFrame(out.collect(), out.schema)
    kept = {r.doc_id for r in docs.collect()}
    assert (None in kept and 6 in kept and 2 not in kept) if full else kept == set()


def test_chat_round_trip(spark):
    talk = [(1, 0, "user", "a\\\\</turn> <turn>\n\n</turn>\n"), (1, 1, "assistant", "\\"), (1, 2, "assistant", "é<text>"), (2, 0, "<turn>", "")]
    out = {r.conv_id: r for r in op01_chat.format_chats(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")).collect()}
    parts = [p[len(op01_chat.OPEN) :].split(op01_chat.MIDDLE) for p in out[1].formatted.split(op01_chat.CLOSE)[:-1]]
    assert [(op01_chat.unescape(a), op01_chat.unescape(b)) for a, b in parts] == [t[2:] for t in talk[:3]]
    assert [op01_chat.unescape(out[1].formatted[s.start : s.end]) for s in out[1].loss_spans] == ["\\", "é<text>"]


def test_long_conversation_crosses_batches(spark):
    rows = spark.range(5000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    r = op01_chat.read_back(op01_chat.format_chats(rows, batch_bytes=1000)).collect()
    assert len(r) == 1 and r[0].loss_sha256 == hashlib.sha256("".join(map(str, range(5000))).encode()).hexdigest()


def test_contamination_in_blocks_equals_one_block(spark):
    docs, bench = documents(spark), spark.createDataFrame(BENCH, "item_id long, text string")
    one = op02_decontaminate.find_matches(docs.select("doc_id", "text"), bench)
    many = op02_decontaminate.find_matches(docs.select("doc_id", "text"), bench, block_bytes=20)
    view = lambda df: sorted((str(r.doc_id), r.n, tuple(sorted({m.item for m in r.matches}))) for r in df.withColumn("n", op02_decontaminate._hit_words(F.col("hits"))).collect())
    assert view(one) == view(many)


def test_fingerprint_neighbours_wrap_around(spark):
    rows = [(3, "c"), (1, "a"), (2, "b"), (None, "n")]
    out = op03_fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string"), [])
    assert {r.text: r.next_text for r in out.collect()} == {"c": "b", "b": "a", "a": "n", "n": "c"}


def test_fingerprint_buckets(spark, monkeypatch):
    monkeypatch.setattr(op03_fingerprint, "ROWS_A_BUCKET", 7)
    rows = spark.range(0, 1000, 3).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    out = {r.doc_id: r.next_text for r in op03_fingerprint.with_next(rows, []).collect()}
    ids = sorted(range(0, 1000, 3), reverse=True)
    assert out == {i: str(ids[(k + 1) % len(ids)]) for k, i in enumerate(ids)}


def test_peeling_recovers_both_sides(spark):
    text = lambda xs: F.lit("\n".join(xs))
    a, b = [f"line {i}" for i in range(400)] + ["same", "same"], [f"line {i}" for i in range(300, 520)] + ["same"]
    keys = spark.range(1).select(op03_fingerprint.digests(text(a)).alias("a"), op03_fingerprint.digests(text(b)).alias("b"))
    diff = op03_fingerprint.differing(F.col("a"), F.col("b"), op03_fingerprint.sketch(F.col("a")), op03_fingerprint.sketch(F.col("b")))
    r = keys.select("a", "b", diff.alias("d")).first()
    assert set(r.d.plus) == set(r.a) - set(r.b) and set(r.d.minus) == set(r.b) - set(r.a)
    assert len(r.d.plus) == 301 and len(r.d.minus) == 121


def test_substring_dedup_cuts_the_later_copy(spark):
    import random

    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 8)))
    passage = " ".join(word() for _ in range(60))
    texts = {i: " ".join(word() for _ in range(200)) for i in range(6)}
    for i in (1, 4):
        texts[i] = texts[i][: 300 + i] + " " + passage + " " + texts[i][300 + i :]
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    spans = op04_chunks.repeated_spans(docs).collect()
    assert {(r.doc_id, r.kept_doc_id) for r in spans} == {(4, 1)}
    assert sum(r.end - r.start for r in spans) > 0.6 * len(passage)
    out = {r.doc_id: r.text for r in op04_chunks.deduplicate(docs).collect()}
    assert all(out[i] == texts[i] for i in texts if i != 4) and len(out[4]) < len(texts[4]) - 0.6 * len(passage)


def test_language_undetermined(spark):
    model = op05_language.train(documents(spark))
    out = {r.doc_id: r for r in op05_language.predict(documents(spark).select("doc_id", "text"), model).collect()}
    assert out[3].lang_pred == out[4].lang_pred == out[5].lang_pred == "und" and out[3].score == 0
    assert out[7].lang_pred == "de"


def test_elias_fano():
    import numpy as np

    rnd = np.random.default_rng(1)
    for n, bound in ((1, 2), (300, 301), (500, 1 << 20), (500, 1 << 47)):
        values = np.unique(rnd.integers(0, bound, n))
        ef = op06_lm.EliasFano.build(values, int(values[-1]) + 1)
        assert (ef.find(values) == np.arange(len(values))).all()
        other = np.setdiff1d(rnd.integers(0, bound, 400), values)
        assert (ef.find(other) == -1).all()


def test_mixing_targets(spark):
    import math

    counted = spark.createDataFrame([(900,), (90,), (10,)], "t long")
    a = op07_mixing.exponent(counted, 3.0)
    assert (90.0) ** (1 - a) <= 3.0 + 1e-9 and (90.0) ** (1 - a) > 2.99
    a = op07_mixing.exponent(counted, 1.0, target_entropy=0.8)
    p = [x**a for x in (0.9, 0.09, 0.01)]
    h = -sum(x / sum(p) * math.log(x / sum(p)) for x in p)
    assert abs(h - 0.8) < 1e-4


def test_mixing_against_brute_force(spark):
    rows = [(i, "s" if i % 5 else "t", " ".join(["w"] * (1 + i % 7))) for i in range(300)]
    out = op07_mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    tokens, drawn = {"s": 0, "t": 0}, {"s": 0, "t": 0}
    for i, s, t in rows:
        tokens[s] += len(t.split())
    for r in out:
        drawn[r.source] += r.mix_tokens
    weight = {r.source: r.weight for r in out}
    assert abs(sum(weight.values()) - 1) < 1e-9
    total = sum(drawn.values())
    assert all(abs(drawn[s] / total - weight[s]) < 0.02 for s in drawn)
    assert {r.doc_id for r in out} == set(range(300)) and max(r.epoch for r in out) <= 1 and all(0 <= r.position < 1 for r in out)


PII = "Mail Ann.Lee9@mail.shop.com or +1 (017) 555-7713, card 4111 1111 1111 1111, ip 10.20.30.40, token = \"abcdef0123456789\", SSN 123-45-6789, ask Mr. John Smith or Mrs. Smith, г. господин Иван Петров."


def test_surrogates_keep_type_and_coreference(spark):
    docs = spark.createDataFrame([(1, PII), (2, "again ann.lee9@mail.shop.com and 4111111111111111, Dr. Smith"), (3, None), (4, "")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in op08_pii.surrogate_text(docs, "k").collect()}
    for piece in ("Ann.Lee9", "555-7713", "4111", "10.20.30.40", "abcdef0123456789", "123-45-6789", "John", "Smith", "Иван", "Петров"):
        assert piece not in out[1], piece
    import re

    mail = [re.search(r"\S+@\S+", out[i])[0].rstrip(",").lower() for i in (1, 2)]
    assert mail[0] == mail[1] and mail[0].endswith(".example.com")
    card = re.search(r"card ([\d ]{19})", out[1])[1].replace(" ", "")
    digits = [int(c) for c in card]
    assert card in out[2] and (sum(digits[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in digits[-2::-2])) % 10 == 0
    names = re.search(r"Mr\. (\w+) (\w+) or Mrs\. (\w+),", out[1])
    assert names[2] == names[3] and out[2].endswith(f"Dr. {names[2]}")
    assert re.search(r"господин [А-Я][а-я]+ [А-Я][а-я]+\.", out[1])
    assert out[3] is None and out[4] == ""
    other = op08_pii.surrogate_text(docs, "another key").where("doc_id = 1").first().text
    assert other != out[1]


def test_surrogates_stay_distinct_when_they_collide(spark):
    rows = [(i, f"Mr. N{a}{b}{c} left") for i, (a, b, c) in enumerate((a, b, c) for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = [r.text.split()[1] for r in op08_pii.surrogate_text(docs, "k").collect()]
    assert len(set(names)) == len(rows)


def test_grammar_scores_clauses():
    g = op09_toxicity
    machine = g.grammar_machine()
    attack = {g.INSULT, g.THREAT}
    run = lambda *symbols, gaps=None: g.score_clause(machine, list(symbols), [1.0 if s in attack else 0.0 for s in symbols], gaps or [0] * len(symbols))
    assert run(g.INSULT) == g.LONE_INSULT and run(g.THREAT) == g.LONE_THREAT
    aimed = 1 + g.AIMED_INSULT + g.TARGET_BONUS
    assert run(g.TARGET, g.INSULT) == run(g.TARGET, g.COPULA, g.INSULT, gaps=[0, 0, 1]) == aimed
    assert run(g.INSULT, g.INSULT) == g.LONE_INSULT + 1  # stupid fool
    assert run(g.INSULT, g.TARGET) == g.LONE_INSULT + g.AIMED_INSULT + g.TARGET_BONUS
    assert run(g.INTENT, g.THREAT, g.TARGET) == 1 + g.AIMED_THREAT + g.TARGET_BONUS > run(g.THREAT, g.TARGET) > run(g.THREAT)
    assert run(g.NEGATION, g.INSULT) < run(g.INSULT) and run(g.REPORT, g.INSULT) < run(g.INSULT)
    assert run(g.NEGATION, g.INSULT, gaps=[0, 3]) == run(g.INSULT)
    assert run(g.TARGET, g.NEGATION, g.INSULT) < aimed


def test_golay_keys_meet_at_four_bits():
    import numpy as np

    rnd = np.random.default_rng(2)
    a = rnd.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = a.copy()
    for i in range(400):
        for bit in rnd.choice(64, 4, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    keys = [{}, {}]
    for k, x in enumerate((a, b)):
        for key, owner in zip(*op10_simhash.golay_keys(x), strict=True):
            keys[k].setdefault(int(owner), set()).add(int(key))
    assert all(keys[0][i] & keys[1][i] for i in range(400))


def test_large_key_groups_are_exact(spark):
    import numpy as np

    rnd = np.random.default_rng(3)
    centre = int(rnd.integers(0, 1 << 62))
    prints = {centre}
    while len(prints) < 120:
        x = centre
        for bit in rnd.choice(64, 3, replace=False):
            x ^= 1 << int(bit)
        prints.add(x)
    signed = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(sorted(prints))]
    nodes = spark.createDataFrame(signed, "fp long, least long").withColumn("part", F.lit(1))
    for limit in (4096, 16):
        roots = op10_simhash.components(op10_simhash.link_stars(nodes, limit).select("a", "b")).collect()
        assert len(roots) == 119 and len({r.root for r in roots}) == 1


def test_workers_need_no_installed_copy(tmp_path):
    """Workers of a Spark that was started in an empty folder cannot import the package: task code and broadcasts travel with the job."""
    import subprocess
    import sys

    code = f"""
import sys
sys.path.insert(0, {str(__import__("pathlib").Path(__file__).parents[2])!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from tesserae.llm.queries import QUERIES
for name in ("op2_benchmark_decontamination", "op5_language_id", "op6_lm_scoring", "op9_toxicity"):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() == 200, name
print("all done")
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**__import__("os").environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=600)
    assert "all done" in done.stdout, done.stderr[-3000:]
