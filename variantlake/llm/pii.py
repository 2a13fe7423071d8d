"""Surrogates for personal data, with DataFrame functions only.

Entities (e-mail and IP addresses, telephone, card and account numbers, national
numbers, names after a form of address) are found by one expression; a name found so is
then found in the rest of its text without its title too, whole or by one word. Each distinct
entity, in a canonical form that its spellings share, gets one surrogate from a keyed
hash: same type, length classes and punctuation; card and account numbers keep their check
digits' validity, names keep gender and script. The words of names are entities by
themselves, all in one space, and names are put together from them: so a surname reads the
same with and without a given name, and two people of one text never come to share a word
that they did not share. Surrogates are checked against each other and against all real
entities; the losers are hashed again until none collide, so distinct entities stay
distinct and one entity reads the same in every document.

Entities are counted by the form of their surrogates (kind, length, fixed signs). Where they
want more than ``FULL`` of all surrogates of a form, those of this form get as many signs more
as make room; check digits are computed for the whole. No form is lengthened otherwise.

The key reaches the expressions as a scalar subquery over one row, so plans and event logs
do not show it.

A document's new text depends on its text alone, so texts meet their replacements by
content hash, and copies share one computation. Texts without an entity never shuffle.

Defined cases: a null text stays null, an empty one empty; an empty table gives an
empty result; repeated rows give repeated results; null ids are carried; very long texts and mentions are
searched whole; other columns pass through (or are ignored by ``surrogates``), whatever
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_small, written

#: Entities may want this share of all surrogates of their form; beyond it those get longer.
#: Half of the form's surrogates stay free at least, so attempts end soon.
FULL = 0.25

LETTERS, CAPITALS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CYRILLIC = "абвгдежзиклмнопрстуфхцчшэюя"
CONSONANTS, VOWELS = ("bdfgklmnprstvz", "бвгдзклмнпрст"), ("aeiou", "аеиоу")
MALE_ENDS, FEMALE_ENDS = ("nrs", "нрс"), ("na", "на")
WORD_KINDS = ("given", "given_f", "given_m", "surname")

FEMALE = "Mrs|Ms|Miss|Frau|Mme|Mlle|Madame|Señora|Sra|Signora|г-жа|госпожа"
MALE = "Mr|Herr|Monsieur|Señor|Signor|г-н|господин"
NEUTRAL = "Dr|Prof"
SIGN = r"\p{L}\p{M}\p{N}"  # of a word, in every script
EMAIL = rf"(?<![{SIGN}_.%+-])[{SIGN}_.%+-]++@[{SIGN}-]+(?:\.[{SIGN}-]+){{0,126}}\.(?:[A-Za-z]{{2,}}|[\p{{L}}\p{{M}}]{{2,}})"
IP = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)"
NATIONAL = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
CARD = r"(?<!\w)\d{4}(?:[\x20-]\d{4}){2}[\x20-]\d{1,7}(?!\w)|(?<!\w)\d{13,19}(?!\w)"
PHONE = r"(?<![\w+])\+\d{1,3}[\x20.-]?(?:\(\d{1,4}\)[\x20.-]?)?\d{2,4}(?:[\x20.-]\d{2,4}){1,4}(?!\w)|(?<![\w+])\+\d{8,15}(?!\w)|(?<!\w)\(\d{3}\)\x20?\d{3}[.-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
TITLES = rf"(?:(?:{FEMALE}|{MALE}|{NEUTRAL})\.?\x20)"
WORD = r"\p{Lu}(?:['’-]?[\p{L}\p{M}]{2,}|[\p{L}\p{M}])(?:['’-][\p{L}\p{M}]{2,})*+"
NAME = rf"(?<!\p{{L}}){TITLES}++{WORD}(?:\x20{WORD})?"
#: Entities of a group share their first signs, which decide whether it is tried.
PATTERN = rf"{EMAIL}|(?=[0-9+(])(?:{IP}|{NATIONAL}|{PHONE}|{CARD})|(?=[A-Zг])(?:{IBAN}|{NAME})"

#: Setting of a session that holds the key; its name is one that Spark's redaction hides.
KEY_SETTING = "spark.variantlake.pii.secret"
#: Of the registered queries over made-up tables, where a session sets none. Anybody can
#: compute its surrogates anew, so it protects no real data.
TEST_KEY = "key of the made-up tables"


def session_key(spark: SparkSession, otherwise: str | None = None) -> str:
    """The key that the session sets, else ``otherwise``; an error without either."""
    key = spark.conf.get(KEY_SETTING, None) or otherwise
    if not key:
        raise ValueError(f"{KEY_SETTING} must hold the key of surrogates")
    return key


def _hidden(spark: SparkSession, key: str) -> Column:
    """The key as a column that plans show without its value."""
    return spark.sql("SELECT k FROM VALUES (:key) AS t(k)", {"key": key}).scalar()


def _kind(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "national")
        .when(m.rlike(rf"^(?:(?:{NEUTRAL})\.?\x20)*+(?:{FEMALE})\.?\x20"), "name_f")
        .when(m.rlike(rf"^(?:(?:{NEUTRAL})\.?\x20)*+(?:{MALE})\.?\x20"), "name_m")
        .when(m.rlike(r"^\p{L}"), "name")
        .when(m.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]"), "phone")
        .otherwise("card")
    )


def _untitled(m: Column) -> Column:
    return F.regexp_replace(m, f"^{TITLES}++", "")


def _canonical(kind: Column, m: Column) -> Column:
    """What all spellings of an entity share."""
    return (
        F.when(kind == "email", F.lower(m))
        .when(kind == "ip", m)
        .when(kind == "iban", F.replace(m, F.lit(" "), F.lit("")))
        .when(kind.startswith("name"), F.lower(_untitled(m)))
        .when(kind == "phone", F.regexp_replace(F.regexp_replace(m, r"\D", ""), r"^1(?=\d{10}$)", ""))  # with or without the country code
        .otherwise(F.regexp_replace(m, r"\D", ""))
    )


def _once(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _noise(key: Column, kind: Column, canonical: Column, attempt: Column) -> Column:
    """128 hex digits from the key and the entity."""
    of = lambda n: F.sha2(F.concat_ws("\x1f", key, kind, canonical, attempt.cast("string"), F.lit(str(n))), 256)
    return F.concat(of(0), of(1))


def _byte(noise: Column, i: Column) -> Column:
    return F.conv(F.substring(noise, (i % 64 * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, noise: Column, i: Column) -> Column:
    return F.substring(F.lit(letters), (_byte(noise, i) % len(letters) + 1).cast("int"), F.lit(1))


def _chars(s: Column, change) -> Column:
    """``s`` with its i-th character (from 0) replaced by ``change(character, i)``."""
    return F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), change), "")


def _digits(noise: Column, like: Column, keep: Column) -> Column:
    return _chars(like, lambda c, i: F.when(i < keep, c).otherwise(_pick(DIGITS, noise, i)))


def _luhn(digits: Column) -> Column:
    """The sum of a digit string whose last digit is the check digit."""
    last = F.length(digits) - 1
    signs = F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = lambda d: 2 * d - F.when(d > 4, 9).otherwise(0)
    return F.aggregate(F.transform(signs, lambda d, i: F.when((last - i) % 2 == 0, d).otherwise(doubled(d))), F.lit(0), lambda a, d: a + d)


def _valid_card(canonical: Column) -> Column:
    return _luhn(canonical) % 10 == 0


def _card(noise: Column, like: Column, valid: Column) -> Column:
    """The first digit stays; a valid number gets a valid check digit."""

    def checked(made: Column) -> Column:
        body = F.substring(made, F.lit(1), F.length(made) - 1)
        check = F.pmod(10 - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
        return F.when(valid, F.concat(body, check)).otherwise(made)

    return _once(_digits(noise, like, F.lit(1)), checked)


def _top_level(email: Column) -> Column:
    return F.substring_index(email, ".", -1)


def _email(noise: Column, like: Column) -> Column:
    """Letters for letters, digits for digits; the top-level domain stays."""
    fixed = F.length(like) - F.length(_top_level(like))
    letter = lambda c, i: F.when(c.rlike(r"\p{IsCyrillic}"), _pick(CYRILLIC, noise, i)).otherwise(_pick(LETTERS, noise, i))
    return _chars(like, lambda c, i: F.when(i >= fixed, c).when(c.rlike(r"\p{N}"), _pick(DIGITS, noise, i)).when(c.rlike(r"\p{L}"), letter(c, i)).otherwise(c))


def _mod97(iban: Column) -> Column:
    """The remainder that is 1 for a valid number."""
    signs = F.filter(F.split(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4)), ""), lambda c: c != "")
    step = lambda a, c: F.when(c.rlike(r"\d"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(signs, F.lit(0), step)


def _valid_iban(canonical: Column) -> Column:
    return _mod97(canonical) == 1


def _iban(noise: Column, like: Column, valid: Column) -> Column:
    """The country stays; a valid number gets valid check digits."""

    def checked(made: Column) -> Column:
        country, body = F.substring(made, 1, 2), F.substring(made, F.lit(5), F.length(made))
        digits = F.lpad((98 - _mod97(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0")
        return F.when(valid, F.concat(country, digits, body)).otherwise(made)

    signs = lambda c, i: F.when(i < 2, c).when(c.rlike(r"\d"), _pick(DIGITS, noise, i)).otherwise(_pick(CAPITALS, noise, i))
    return _once(_chars(like, signs), checked)


def _phone(noise: Column, like: Column, n: Column) -> Column:
    """Of a number of ``n`` digits what is before the last ten stays; area and exchange
    begin with 2 to 9."""
    return _chars(like, lambda c, i: F.when(i < n - 10, c).when((i == n - 10) | (i == n - 7), _pick("23456789", noise, i)).otherwise(_pick(DIGITS, noise, i)))


def _word(noise: Column, kind: Column, canonical: Column, more: Column) -> Column:
    """A word of a name, in lower case and in its script. A given name's ending shows its
    gender, if it is known."""
    cyrillic = canonical.rlike(r"\p{IsCyrillic}")
    pick = lambda of, n: F.when(cyrillic, _pick(of[1], noise, n)).otherwise(_pick(of[0], noise, n))
    body = F.concat(*[pick(of, F.lit(n + i)) for n in range(0, 6, 2) for i, of in enumerate((CONSONANTS, VOWELS))])
    longer = F.when(more > 0, F.array_join(F.transform(F.sequence(F.lit(1), more), lambda i: pick((LETTERS, CYRILLIC), i + 6)), "")).otherwise("")
    female = F.when(cyrillic, FEMALE_ENDS[1]).otherwise(FEMALE_ENDS[0])
    end = F.when(kind == "given_f", female).when(kind == "given_m", pick(MALE_ENDS, F.lit(6))).otherwise(pick(CONSONANTS, F.lit(6)))
    return F.concat(body, longer, end)


def _is_word(kind: Column) -> Column:
    return kind.isin(*WORD_KINDS)


def _surrogate(noise: Column, kind: Column, canonical: Column, more: Column) -> Column:
    """A surrogate with ``more`` signs than its form has."""
    first = F.when(canonical.rlike(r"^\p{IsCyrillic}"), "я").otherwise("a")
    like = F.when(kind == "email", F.concat(F.repeat(first, more), canonical)).otherwise(F.concat(canonical, F.repeat(F.lit("0"), more)))
    octets = F.transform(F.sequence(F.lit(0), more + 3), lambda i: (_byte(noise, i) % 254 + 1).cast("string"))
    return (
        F.when(_is_word(kind), _word(noise, kind, canonical, more))
        .when(kind == "email", _email(noise, like))
        .when(kind == "ip", F.array_join(octets, "."))
        .when(kind == "iban", _iban(noise, like, _valid_iban(canonical)))
        .when(kind == "phone", _phone(noise, like, F.length(canonical)))
        .when(kind == "card", _card(noise, like, _valid_card(canonical)))
        .otherwise(_digits(noise, like, F.lit(0)))
    )


def _form(kind: Column, canonical: Column) -> tuple[Column, Column]:
    """What surrogates of an entity have in common, hashed, and the decimal logarithm of
    how many there are."""
    n = F.length(canonical)
    flag = lambda x: x.cast("int").cast("string")
    many = lambda s, sign: F.length(s) - F.length(F.replace(s, F.lit(sign), F.lit("")))
    cyrillic = canonical.rlike(r"\p{IsCyrillic}")
    head = F.regexp_replace(F.substring(canonical, F.lit(1), n - F.length(_top_level(canonical))), r"\p{N}", "0")
    head = F.regexp_replace(F.regexp_replace(head, r"[\p{L}&&[^\p{IsCyrillic}]]", "a"), r"[\p{L}&&\p{IsCyrillic}]", "я")
    account = F.regexp_replace(F.regexp_replace(F.substring(canonical, F.lit(5), n), "[A-Z]", "A"), r"\d", "0")
    form = (
        F.when(_is_word(kind), flag(cyrillic))
        .when(kind == "email", F.concat(head, _top_level(canonical)))
        .when(kind == "iban", F.concat(F.substring(canonical, 1, 2), account, flag(_valid_iban(canonical))))
        .when(kind == "phone", F.concat(F.substring(canonical, F.lit(1), F.greatest(n - 10, F.lit(0))), F.lit(" "), n.cast("string")))
        .when(kind == "card", F.concat_ws(" ", F.substring(canonical, 1, 1), n.cast("string"), flag(_valid_card(canonical))))
        .otherwise("")
    )
    log = math.log10
    words = [3 * log(len(CONSONANTS[i])) + 3 * log(len(VOWELS[i])) for i in (0, 1)]
    ends = lambda of: F.when(cyrillic, words[1] + log(len(of[1]))).otherwise(words[0] + log(len(of[0])))
    begins = F.when(n >= 10, 2).when(n >= 7, 1).otherwise(0)
    room = (
        F.when(kind == "given_f", ends(("x", "x")))
        .when(kind == "given_m", ends(MALE_ENDS))
        .when(_is_word(kind), ends(CONSONANTS))
        .when(kind == "email", many(head, "0") + many(head, "a") * log(len(LETTERS)) + many(head, "я") * log(len(CYRILLIC)))
        .when(kind == "ip", F.lit(4 * log(254)))
        .when(kind == "iban", many(account, "0") + many(account, "A") * log(len(CAPITALS)) + F.when(_valid_iban(canonical), 0).otherwise(2))
        .when(kind == "phone", F.least(n, F.lit(10)) - begins * (1 - log(8)))
        .when(kind == "card", n - 1 - _valid_card(canonical).cast("int"))
        .otherwise(n)
    )
    return F.sha2(F.concat_ws("\x1f", kind, form), 256), room.cast("double")


def _with_more(units: DataFrame) -> DataFrame:
    """``units`` with the signs that their surrogates get beyond their form's."""
    form, room = _form(F.col("kind"), F.col("canonical"))
    formed = written(units.withColumn("form", form).withColumn("room", room), "forms")
    sign = F.when(F.first("kind").isin("email", *WORD_KINDS), math.log10(len(LETTERS))).otherwise(1.0)
    lacking = F.log10(F.count(F.lit(1)) / FULL) - F.first("room")
    full = formed.groupBy("form").agg(F.ceil(lacking / sign).cast("int").alias("more")).filter("more > 0")
    return join_small(formed, written(full, "full_forms"), "form", "left", "canonical").drop("form", "room").withColumn("more", F.coalesce("more", F.lit(0)))


def _spelled(kind: Column, m: Column, surrogate: Column) -> Column:
    """The surrogate in the spelling of this mention."""
    bare = F.regexp_replace(m, r"\D", "")
    coded = (kind == "phone") & bare.rlike(r"^1\d{10}$")  # the code is no part of the canonical form
    surrogate = F.when(coded, F.concat(F.lit("1"), surrogate)).otherwise(surrogate)
    blanks = F.split(F.regexp_replace(m, "[A-Z0-9]", "#"), "#", -1)
    signs = F.filter(F.split(surrogate, ""), lambda c: c != "")
    filled = F.array_join(F.zip_with(blanks, signs, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    cased = _chars(surrogate, lambda c, i: F.when(F.substring(m, (i + 1).cast("int"), F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c))
    title = F.concat(F.regexp_extract(m, f"^{TITLES}*+", 0), surrogate)
    return F.when(kind == "email", cased).when(kind == "ip", surrogate).when(kind.startswith("name"), title).otherwise(filled)


def _settled(units: DataFrame, key: str) -> DataFrame:
    """``kind, canonical, surrogate`` for distinct ``kind, canonical``. Of those that want
    one surrogate the smallest gets it; the others try again with the next attempt."""
    space = F.when(_is_word(F.col("kind")), "word").otherwise(F.col("kind"))
    waiting = written(_with_more(units).withColumn("space", space), "units")
    real = waiting.select("space", F.col("canonical").alias("surrogate"))
    hidden, done, attempt = _hidden(units.sparkSession, key), None, 0
    while True:
        noisy = waiting.withColumn("noise", _noise(hidden, F.col("kind"), F.col("canonical"), F.lit(attempt)))
        tried = noisy.withColumn("surrogate", _surrogate(F.col("noise"), F.col("kind"), F.col("canonical"), F.col("more")))
        taken = real if done is None else real.unionByName(done.select("space", "surrogate"))
        free = tried.join(taken, ["space", "surrogate"], "left_anti")
        won = free.groupBy("space", "surrogate").agg(F.min(F.struct("canonical", "kind")).alias("u")).select("space", "surrogate", "u.kind", "u.canonical")
        done = written(won if done is None else done.unionByName(won), "surrogates")
        waiting = written(waiting.join(done, ["kind", "canonical"], "left_anti"), "waiting")
        if waiting.isEmpty():
            return done.select("kind", "canonical", "surrogate")
        attempt += 1


def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind, canonical, surrogate`` for distinct ``kind, canonical``: distinct, and none a
    real entity. Names are made of their words' surrogates, the first of several words being a
    given name; a column ``gender`` (f, m or null) gives it its ending."""
    gender = F.col("gender") if "gender" in entities.columns else F.lit(None).cast("string")
    words = F.split("canonical", " ")
    given = (F.col("at") == 0) & (F.col("n") > 1)
    role = F.when(given, F.concat(F.lit("given"), F.coalesce(F.concat(F.lit("_"), gender), F.lit("")))).otherwise("surname")
    named = entities.filter("kind = 'name'").withColumn("n", F.size(words)).select("*", F.posexplode(words).alias("at", "word")).withColumn("role", role)
    named = named.select("canonical", "at", "word", F.col("role").alias("word_kind"))
    others = entities.filter("kind <> 'name'").select("kind", "canonical")
    units = others.unionByName(named.select(F.col("word_kind").alias("kind"), F.col("word").alias("canonical")).distinct())
    settled = _settled(units, key)
    unit = lambda kind, word: F.concat_ws(" ", kind, word).alias("unit")
    of_words = settled.filter(_is_word(F.col("kind"))).select(unit("kind", "canonical"), F.initcap("surrogate").alias("new"))
    met = join_small(named.select("canonical", "at", unit("word_kind", "word")), of_words, "unit", "inner", "canonical")
    made = met.groupBy("canonical").agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("l"))
    names = made.select(F.lit("name").alias("kind"), "canonical", F.array_join("l.new", " ").alias("surrogate"))
    return written(settled.filter(~_is_word(F.col("kind"))).unionByName(names), "assigned")


def _names(found: Column) -> Column:
    """The names among a text's mentions, as spelled there without their titles."""
    return F.array_distinct(F.transform(F.filter(found, lambda m: m.rlike(rf"^{TITLES}++\p{{Lu}}")), _untitled))


def _pattern(names: Column) -> Column:
    """``PATTERN``, and these names and their words where they stand without a title."""
    words = F.array_distinct(F.flatten(F.transform(names, lambda n: F.split(n, " "))))
    both = F.array_join(F.concat(F.filter(names, lambda n: n.contains(" ")), words), "|")
    before, after = rf"(?<![{SIGN}_])(?<!\p{{L}}[-'’])(?=\p{{Lu}})(?iu:", rf")(?![{SIGN}_]|-\p{{L}})"
    return F.when(F.size(names) > 0, F.concat(F.lit(f"{PATTERN}|{before}"), both, F.lit(after))).otherwise(PATTERN)


def _owner(canonical: Column, names: Column) -> Column:
    """The first name of a text that a mention repeats in whole, else in one word."""
    lower = F.transform(names, F.lower)
    part = F.get(F.filter(lower, lambda n: F.array_contains(F.split(n, " "), canonical)), F.lit(0))
    return F.when(F.array_contains(lower, canonical), canonical).otherwise(F.coalesce(part, canonical))


def replacements(found: DataFrame, key: str) -> DataFrame:
    """``h, spelled, kinds``: for each text with an entity (``h``, its SHA-256,
    ``names``, those it gives with a title, and ``found``, its mentions) the
    replacements in order and their kinds. A name is one entity whatever its titles;
    its gender is what titles say, unless they disagree."""
    found = written(found.groupBy("h").agg(F.first("found").alias("found"), F.first("names").alias("names")), "mentions")
    mentions = found.select("h", "names", F.posexplode("found").alias("at", "mention")).withColumn("said", _kind(F.col("mention")))
    mentions = mentions.withColumn("canonical", _canonical(F.col("said"), F.col("mention")))
    named = F.col("said").startswith("name")
    mentions = mentions.withColumn("kind", F.when(named, "name").otherwise(F.col("said"))).withColumn("own", F.col("canonical"))
    mentions = mentions.withColumn("canonical", F.when(named, _owner(F.col("own"), F.col("names"))).otherwise(F.col("own")))
    female, male = F.bool_or(F.col("said") == "name_f"), F.bool_or(F.col("said") == "name_m")
    gender = F.when(female & ~male, "f").when(male & ~female, "m").alias("gender")
    known = assign_surrogates(written(mentions.groupBy("kind", "canonical").agg(gender), "entities"), key)
    nth = F.array_position(F.split("canonical", " "), F.col("own")).cast("int")
    surrogate = F.when(named & (F.col("own") != F.col("canonical")), F.get(F.split("surrogate", " "), nth - 1)).otherwise(F.col("surrogate"))
    spelled = mentions.join(known, ["kind", "canonical"]).select("h", "at", "said", _spelled(F.col("said"), F.col("mention"), surrogate).alias("new"))
    listed = spelled.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("at", "new", "said"))).alias("l"))
    return written(listed.select("h", F.col("l.new").alias("spelled"), F.col("l.said").alias("kinds")), "replacements")


def _replaced(text: Column, names: Column, spelled: Column) -> Column:
    gaps = F.when(F.size(names) > 0, F.split(text, _pattern(names), -1)).otherwise(F.split(text, PATTERN, -1))
    return F.array_join(F.zip_with(gaps, spelled, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def replace_pii(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with surrogates in ``text_col``, in a struct
    ``row``, and the kinds replaced, in ``kinds``. Rows are written with their
    mentions; only texts with a name are searched again, for its other mentions."""
    text = F.col(text_col).cast("string")
    row = F.struct(*[(text if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns]).alias("row")
    mentions = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("found")
    scanned = written(docs.select(row, mentions), "scanned")
    some = F.coalesce(F.size("found"), F.lit(0)) > 0
    text = F.col("row").getField(text_col)
    dirty = scanned.filter(some).withColumn("h", F.sha2(text, 256)).withColumn("names", _names(F.col("found")))
    again = F.regexp_extract_all(text, _pattern(F.col("names")), F.lit(0))
    new = replacements(dirty.select("h", "names", F.when(F.size("names") > 0, again).otherwise(F.col("found")).alias("found")), key)
    clean = scanned.filter(~some).select("row", F.array().cast("array<string>").alias("kinds"))
    met = dirty.join(new, "h").select(F.col("row").withField(text_col, _replaced(text, F.col("names"), F.col("spelled"))).alias("row"), "kinds")
    return clean.unionByName(met)


def surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, n_replaced, kinds`` for every row of ``docs``."""
    out = replace_pii(docs.select(id_col, text_col), key, text_col)
    return out.select(f"row.{id_col}", f"row.{text_col}", F.size("kinds").cast("long").alias("n_replaced"), F.array_join("kinds", ",").alias("kinds"))


def without_pii(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in its text column."""
    return replace_pii(docs, key, text_col).select("row.*")
