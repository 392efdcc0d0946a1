"""PII surrogates: detection and keyed, type-consistent replacement, in DataFrame functions only.

One pattern finds e-mail addresses, IPv4 addresses, payment cards, phone numbers,
US social security numbers, IBANs, assigned secrets (token = "...") and persons
after a title. An entity is reduced to its normal form (case, separators and title
dropped) and gets a surrogate from a keyed SHA-256 stream:

* numbers keep their separators and lengths; a card that passes the Luhn
  check gets one that passes too;
  IPv4 octets stay octets;
* letters stay letters of the same case and digits digits in secrets and mail
  names; mail hosts become reserved example hosts;
* persons: each name word gets a name of its own script (Latin, Cyrillic, Greek); a
  given name takes the gender of the title, a surname is the same whatever the
  title, so that "Mr. A B" and "Dr. B" still name one person; an initial becomes a name.

The same normal form gets the same surrogate everywhere (coreference). Distinct
forms must differ: the table of distinct entities is checked for equal surrogates
and for surrogates that are real entities, and those rows draw again (a higher
attempt) until none is left. Later attempts draw from more surrogates (names get a
syllable each time; secrets, mail names and phone numbers a character after four
times), so this ends however many entities there are. Only entities with a later attempt are joined back to
the documents that hold them; usually there are none, and the rewriting shuffles
nothing.

Defined results: null text stays null; empty text: no entity; repeated rows and
equal ids: equal texts get equal results; no rows: no rows; further columns are
kept by `surrogate_text`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import materialise, table

_MALE, _FEMALE, _NEUTRAL = ("Mr", "Sir", "Herr", "Señor", "Sr", "Monsieur", "господин"), ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Sra", "Madame", "Mme", "Mlle", "госпожа", "κυρία"), ("Dr", "Prof")
_TITLE = "(?:" + "|".join(sorted(_MALE + _FEMALE + _NEUTRAL, key=len, reverse=True)) + r")\.?"
#: A word with inner capitals, hyphens and apostrophes, initials with dots, or a bare initial before a further word.
_NAME = r"(?:(?:\p{Lu}\.)*+\p{Lu}[\p{L}\p{M}'’-]++|(?:\p{Lu}\.)++|\p{Lu}(?= \p{Lu}))(?![\p{L}\p{N}])"
#: From the beginning of a run of mail characters any length; from within it (after an entity, say) only 64, so that long runs take linear time.
_EMAIL = r"(?:(?<![._%+-])[\p{L}\p{N}._%+-]++|(?<=[._%+-])[\p{L}\p{N}._%+-]{1,64}+)@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
SECRET_WORDS = "token|secret|password|passwd|api_key|apikey|access_key|secret_key|auth"

#: Each pattern begins where no letter or digit stands before it.
PATTERNS = {
    "secret": rf"(?i:{SECRET_WORDS})\s{{0,3}}[=:]\s{{0,3}}[\"']?(?!{_EMAIL})(?=[A-Za-z0-9+/_-](?:\.?[A-Za-z0-9+/_-]){{7}})[A-Za-z0-9+/_.-]+(?<!\.)",
    "email": _EMAIL,
    "ip": r"(?<!\.)(?:\d{1,3}\.){3}\d{1,3}(?![\p{L}\p{N}]|\.\d)",
    "iban": r"[A-Z]{2}\d{2} ?(?:[A-Z0-9]{4} ?){2,7}[A-Z0-9]{1,4}(?![\p{L}\p{N}])",
    "card": r"(?<!\.)(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}|3\d{3}[ -]?\d{6}[ -]?\d{5})(?![\p{L}\p{N}])",
    "ssn": r"(?<!-)\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "phone": r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4})(?![\p{L}\p{N}])",
    "person": rf"{_TITLE} {_NAME}(?: {_NAME})*+",
}
#: What a first character can begin is tried alone, the most common failures first.
ENTITY = (
    r"(?<![\p{L}\p{N}])(?:(?=\p{L})(?:" + "|".join(PATTERNS[k] for k in ("email", "secret", "person", "iban"))
    + r")|(?=[\d+(._%-])(?:" + "|".join(PATTERNS[k] for k in ("email", "ip", "card", "ssn", "phone")) + "))"
)

#: Attempts before a secret, mail name or phone number gets longer than its original.
GROW_AFTER = 4

#: Name words are built from these syllables, then an ending.
_LATIN = "ba be bi bo da de di do fa fe fi ga ge gi ka ke ki la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi za ze".split()
_CYRILLIC = "ба бе би бо да де ди до ва ве ви га ге ги ка ке ки ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си со та те ти то за зе".split()
_GREEK = "βα βε βι βο δα δε δι δο γα γε γι κα κε κι λα λε λι λο μα με μι μο να νε νι νο πα πε πι ρα ρε ρι ρο σα σε σι σο τα τε τι το".split()
_ENDINGS = {
    "latin": (_LATIN, {"male": "n r s ld rt ck".split(), "female": "a ia na ine elle ette".split(), "surname": "man ler sen ski ton ard".split()}),
    "cyrillic": (_CYRILLIC, {"male": "н р с й м т".split(), "female": "на ия ра ла ся та".split(), "surname": "ов ин ский ко ев юк".split()}),
    "greek": (_GREEK, {"male": "ος ης ας ων ις ευς".split(), "female": "α η ια ω ινα ουλα".split(), "surname": "ου ιδης ακης ας ογλου ης".split()}),
}


def _kind(entity: Column) -> Column:
    out = F.when(entity.rlike(f"^(?:{PATTERNS['secret']})$"), "secret").when(F.contains(entity, F.lit("@")), "email").when(entity.rlike(rf"^{_TITLE} "), "person")
    for kind in ("ip", "ssn", "iban", "card"):
        out = out.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    return out.otherwise("phone")


def _prefix(entity: Column, kind: Column) -> Column:
    """What stays in front of a secret's value."""
    return F.when(kind == "secret", F.regexp_extract(entity, rf"^(?i:{SECRET_WORDS})\s*[=:]\s*[\"']?", 0)).otherwise("")


def units(entity: Column) -> Column:
    """The parts of an entity that get surrogates: array of (kind, norm, shape).

    `norm` identifies the part, `shape` is its text; a person gives one unit a name word.
    """
    kind = _kind(entity)
    body = F.substring(entity, F.char_length(_prefix(entity, kind)) + 1, F.char_length(entity))
    unit = lambda k, norm, shape: F.struct(k.alias("kind"), norm.alias("norm"), shape.alias("shape"))
    words = F.filter(F.split(F.regexp_replace(entity, rf"^{_TITLE} ", ""), " "), lambda w: w != "")
    title = F.regexp_replace(F.regexp_extract(entity, rf"^{_TITLE} ", 0), r"[. ]", "")
    gender = F.when(title.isin(list(_MALE)), "male").when(title.isin(list(_FEMALE)), "female").otherwise("male")
    names = F.transform(words, lambda w, i: unit(F.when(i < F.size(words) - 1, gender).otherwise("surname"), F.lower(F.replace(w, F.lit("."), F.lit(""))), w))
    norm = F.when(kind.isin("card", "ssn", "phone"), F.regexp_replace(body, r"\D", "")).when(kind == "iban", F.replace(body, F.lit(" "), F.lit(""))).when(kind == "email", F.lower(body)).otherwise(body)
    return F.when(kind == "person", names).otherwise(F.array(unit(kind, norm, body)))


def _stream(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """256 keyed hex digits."""
    return F.concat(*(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(str(i)), kind, attempt.cast("string"), norm).cast("binary"), 256) for i in range(4)))


def _nibble(stream: Column, i: Column, width: int) -> Column:
    return F.conv(F.substring(stream, F.pmod(i * width, F.lit(256 - width)) + 1, F.lit(width)), 16, 10).cast("int")


def _fill(shape: Column, stream: Column, keep: Column | None = None) -> Column:
    """Digits become digits and letters letters of the same case; all else, and the first `keep` characters, stay."""
    pick = lambda letters, i: F.substring(F.lit(letters), F.pmod(_nibble(stream, i, 4), F.lit(len(letters))) + 1, F.lit(1))
    lower = "abcdefghijklmnopqrstuvwxyz"

    def one(c: Column, i: Column) -> Column:
        out = F.when(c.rlike(r"^\d$"), pick("0123456789", i)).when(c.rlike(r"^\p{Lu}$"), pick(lower.upper(), i)).when(c.rlike(r"^\p{L}$"), pick(lower, i)).otherwise(c)
        return out if keep is None else F.when(i < keep, c).otherwise(out)

    return F.array_join(F.transform(F.filter(F.split(shape, ""), lambda c: c != ""), one), "")


def _reshape(shape: Column, filled: Column, separator: str) -> Column:
    """The characters of `filled` in the places of those of `shape` that are no separators."""
    kept = lambda i: F.char_length(F.regexp_replace(F.substring(shape, F.lit(1), i + 1), separator, ""))
    one = lambda c, i: F.when(c.rlike(f"^{separator}$"), c).otherwise(F.substring(filled, kept(i), F.lit(1)))
    return F.array_join(F.transform(F.filter(F.split(shape, ""), lambda c: c != ""), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Of a string of digits, the rightmost not doubled."""
    value = lambda c, i: F.when(F.pmod(F.char_length(digits) - i, F.lit(2)) == 1, c.cast("int")).otherwise(F.element_at(F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1))
    return F.aggregate(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), value), F.lit(0), lambda a, x: a + x)


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _further(stream: Column, n: Column, words: list[str]) -> Column:
    """n more words (letters, digits, syllables) from the stream; none if n is not positive."""
    pick = lambda j: F.element_at(F.array(*(F.lit(w) for w in words)), F.pmod(_nibble(stream, j + 9, 4), F.lit(len(words))) + 1)
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), pick), "")).otherwise("")


def _name(kind: Column, norm: Column, stream: Column, attempt: Column) -> Column:
    """A syllable more with each attempt, so that there are names enough for any number of persons."""

    def of(script: str) -> Column:
        syllables, endings = _ENDINGS[script]
        at = lambda words, i: F.element_at(F.array(*(F.lit(w) for w in words)), F.pmod(_nibble(stream, F.lit(i), 4), F.lit(len(words))) + 1)
        ending = F.when(kind == "male", at(endings["male"], 9)).when(kind == "female", at(endings["female"], 9)).otherwise(at(endings["surname"], 9))
        return F.initcap(F.concat(at(syllables, 0), at(syllables, 1), F.when(kind == "surname", at(syllables, 2)).otherwise(""), _further(stream, attempt, syllables), ending))

    return F.when(norm.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(norm.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))


def surrogate(key: str, kind: Column, norm: Column, shape: Column, attempt: Column) -> Column:
    """The replacement of a unit."""

    def of(stream: Column) -> Column:
        # where the shape has too few others, later attempts are longer
        letters, longer = list("abcdefghijklmnopqrstuvwxyz"), lambda words: _further(stream, attempt - GROW_AFTER, words)
        octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(_nibble(stream, i, 4), F.lit(254)) + 1).cast("string")), ".")
        tld = F.regexp_extract(shape, r"[^.]*$", 0)
        host = F.concat(F.regexp_extract(_fill(norm, stream), r"@([^.]*)", 1), F.when(tld.isin("com", "org", "net"), F.concat(F.lit(".example."), tld)).otherwise(".example"))
        mail = F.concat(F.regexp_extract(_fill(shape, stream), r"^[^@]*", 0), longer(letters), F.lit("@"), host)
        # a valid card: the last digit makes the sum right
        body = lambda filled: F.regexp_replace(filled, r"\d$", "")
        card = lambda filled: F.when(F.pmod(_luhn_sum(norm), F.lit(10)) == 0, F.concat(body(filled), F.pmod(-_luhn_sum(F.concat(body(filled), F.lit("0"))), F.lit(10)).cast("string"))).otherwise(filled)
        country = F.char_length(F.regexp_replace(F.regexp_extract(shape, r"^(\+\d{1,3}[ .-])?", 0), r"\D", ""))
        return (
            F.when(kind == "ip", octets).when(kind == "email", mail).when(kind == "card", _reshape(shape, _let(_fill(norm, stream), card), r"\D"))
            .when(kind == "ssn", _reshape(shape, _fill(norm, stream), r"\D")).when(kind == "phone", F.concat(_reshape(shape, _fill(norm, stream, country), r"\D"), longer(list("0123456789"))))
            .when(kind == "iban", _reshape(shape, _fill(norm, stream, F.lit(2)), " "))
            .when(kind.isin("male", "female", "surname"), _name(kind, norm, stream, attempt)).otherwise(F.concat(_fill(shape, stream), longer(letters)))
        )

    return _let(_stream(key, kind, norm, attempt), of)


def _folded(kind: Column, text: Column) -> Column:
    """The normal form of a surrogate, to compare with those of real entities."""
    return F.when(kind.isin("card", "ssn", "phone"), F.regexp_replace(text, r"\D", "")).when(kind == "iban", F.replace(text, F.lit(" "), F.lit(""))).when(kind.isin("email", "male", "female", "surname"), F.lower(text)).otherwise(text)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """Written rows (kind, norm, attempt > 0) of the units whose first surrogate was taken."""
    known = materialise(entities.groupBy("kind", "norm").agg(F.min("shape").alias("shape")).withColumn("attempt", F.lit(0)))
    while True:
        drawn = materialise(known.withColumn("made", _folded(F.col("kind"), surrogate(key, F.col("kind"), F.col("norm"), F.col("shape"), F.col("attempt")))))
        # the lowest (attempt, norm) of equal surrogates stays
        first = drawn.groupBy("kind", "made").agg(F.min(F.struct("attempt", "norm")).alias("owner"), F.count("*").alias("n"))
        clash = first.where("n > 1").select("kind", "made", F.col("owner.norm").alias("owner"))
        real = drawn.select("kind", F.col("norm").alias("made"))
        lost = drawn.join(clash.hint("shuffle_merge"), ["kind", "made"]).where("norm <> owner").select("kind", "norm")
        lost = lost.unionByName(drawn.join(real.hint("shuffle_merge"), ["kind", "made"], "left_semi").select("kind", "norm")).distinct()
        lost = materialise(lost.withColumn("again", F.lit(1)))
        if lost.isEmpty():
            return known.where("attempt > 0").select("kind", "norm", "attempt")
        known = materialise(known.join(lost.hint("shuffle_merge"), ["kind", "norm"], "left").select("kind", "norm", "shape", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")))


def _rewritten(text: Column, key: str, attempts: Column | None) -> Column:
    """The text with every entity replaced."""

    def attempt(u: Column) -> Column:
        if attempts is None:
            return F.lit(0)
        return F.coalesce(F.element_at(attempts, F.concat_ws("\x1f", u["kind"], u["norm"])), F.lit(0))

    def replaced(entity: Column) -> Column:
        made = F.transform(units(entity), lambda u: surrogate(key, u["kind"], u["norm"], u["shape"], attempt(u)))
        kind = _kind(entity)
        title = F.when(kind == "person", F.regexp_extract(entity, rf"^{_TITLE} ", 0)).otherwise(_prefix(entity, kind))
        return F.concat(title, F.array_join(made, " "))

    found = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    joined = lambda made: F.array_join(F.zip_with(F.split(text, ENTITY, -1), made, lambda b, m: F.concat(b, F.coalesce(m, F.lit("")))), "")
    out = _let(F.transform(found, replaced), lambda made: F.struct(F.when(F.size(made) == 0, text).otherwise(joined(made)).alias("text"), F.size(made).cast("long").alias("n")))
    return F.when(text.isNull(), F.struct(F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"))).otherwise(out)


def surrogate_text(documents: DataFrame, key: str = "surrogates", count: str | None = None) -> DataFrame:
    """The documents with every entity in `text` replaced; all other columns stay as they are. `count` names a column to add: the number of entities."""
    own = documents.columns
    names = [f"c{i}" for i in range(len(own))]
    names[own.index("text")] = "text"
    rows = documents.toDF(*names)
    found = rows.select(F.explode(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))).alias("entity")).distinct()
    later = assign(found.select(F.inline(units(F.col("entity")))), key)

    def written(frame: DataFrame, attempts: Column | None) -> DataFrame:
        made = frame.select(*names, _rewritten(F.col("text"), key, attempts).alias("made"))
        kept = [F.col("made.text").alias("text") if n == "text" else F.col(n) for n in names]
        return made.select(*kept, *([F.col("made.n")] if count else [])).toDF(*own, *([count] if count else []))

    if later.isEmpty():
        return written(rows, None)
    # the documents that hold one of these units, by a digest of their text
    digest = F.sha2(F.col("text").cast("binary"), 256)
    held = rows.select(digest.alias("digest"), F.explode(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))).alias("entity")).distinct()
    held = held.select("digest", F.inline(units(F.col("entity")))).select("digest", "kind", "norm").distinct()
    per_text = held.join(later.hint("shuffle_merge"), ["kind", "norm"]).groupBy("digest").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\x1f", "kind", "norm"), "attempt"))).alias("attempts"))
    per_text = materialise(per_text)
    joined = rows.withColumn("digest", digest).join(per_text.hint("shuffle_merge"), "digest", "left")
    return written(joined, F.col("attempts"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate_text(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_entities")
