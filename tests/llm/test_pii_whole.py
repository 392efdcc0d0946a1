"""PII surrogates: more persons than short names, whole secrets and names of any form."""

from tesserae.llm import op08_pii


def test_more_given_names_than_short_surrogates(spark):
    n = 15_000  # 48 x 48 x 6 = 13,824 names of two syllables
    units = spark.range(n).selectExpr("'male' as kind", "concat('real', id) as norm", "concat('Real', id) as shape")
    later = {r.norm: r.attempt for r in op08_pii.assign(units, "k").collect()}
    rows = units.collect()
    frame = spark.createDataFrame([(r.kind, r.norm, r.shape, later.get(r.norm, 0)) for r in rows], "kind string, norm string, shape string, attempt int")
    made = frame.select(op08_pii.surrogate("k", *(frame[c] for c in frame.columns)).alias("made"))
    assert made.distinct().count() == n


def test_secret_without_letters_or_digits_ends(spark):
    out = op08_pii.surrogate_text(spark.createDataFrame([(1, "password: --------")], "doc_id long, text string"), "k").first().text
    assert out != "password: --------" and out.startswith("password: --------")


def test_nothing_of_a_secret_or_name_stays(spark):
    hidden = {
        1: ("token = eyJhbGciOi.eyJzdWIiOiIx.SflKxwRJSM. Next", ["eyJhb", "eyJzd", "SflKx"]),
        2: ("secret: " + "abcdefghij" * 40 + "TAILTAIL end", ["TAILTAIL"]),
        3: ("met Dr. Anna Maria Louise Schmidt today", ["Anna", "Maria", "Louise", "Schmidt"]),
        4: ("met Mr. J. R. McDonald-Smith today", ["J.", "R.", "McDonald", "Smith"]),
        5: ("met Mrs O'Brien and Mr J Doe, gone", ["O'B", "Brien", " J ", "Doe"]),
        7: ("write to " + "jonathan." * 12 + "miller@mail.com now", ["jonathan", "miller"]),
        8: ("write to ann@" + "north." * 12 + "office.org now", ["ann", "north", "office"]),
        9: ("write to ann@" + "long" * 20 + ".org now", ["ann", "long"]),
        10: ("write to -ann.lee@mail.org, now", ["ann", "lee", "mail"]),
        6: ("password: john.smith@mail.com here", ["john", "smith", "mail.com"]),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, _) in hidden.items()], "doc_id long, text string")
    out = {r.doc_id: r.text for r in op08_pii.surrogate_text(docs, "k").collect()}
    for i, (text, parts) in hidden.items():
        assert not [p for p in parts if p in out[i]], out[i]
        assert out[i].split()[-1] == text.split()[-1]


def test_a_long_run_of_mail_characters_takes_linear_time(spark):
    text = "a.b-" * 250_000
    docs = spark.createDataFrame([(1, text), (2, text + "@mail.org"), (3, text + "@mail")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in op08_pii.surrogate_text(docs, "k").collect()}
    assert out[1] == text and out[2].endswith(".example.org") and text not in out[2] and out[3] == text + "@mail"
