"""Personal data in every script, and people mentioned again."""

import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from variantlake.llm import pii


SURNAMES = ["".join(x).capitalize() for x in product("bcdfghklmn", "aeiou", "lmnrst", "aeiou", ("ck", "ld", "ng", "rt", "ss", "tz", "wen"), ("", "er"))][:20_000]
GIVEN = ["".join(x).capitalize() for x in product("bcdfg", "aeiou", "lmnrst", "aeiou")]


def replaced(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in sorted(pii.surrogates(docs, key="change-me").collect(), key=lambda r: r.doc_id)]


def test_addresses_of_every_script(spark):
    mails = ["jürgen.meyer@x.de", "jörgen.meyer@x.de", "müller@firma.de", "иван@mail.ru", "иван@почта.рф", "über@straße.de", "plain_1@x.org"]
    out = replaced(spark, *[f"an {m}, danke" for m in mails], "an JÜRGEN.meyer@x.de!")
    new = [re.fullmatch(r"an (\S+), danke", t)[1] for t in out[:-1]]
    assert len(set(new)) == len(mails)
    for old, made in zip(mails, new):
        local, domain = old.split("@")
        assert local not in made and domain.split(".")[0] not in made.split("@")[1]
        assert made.rsplit(".", 1)[1] == old.rsplit(".", 1)[1] and len(made) == len(old)
    assert re.fullmatch(r"[а-яё]{4}@[a-z]{4}\.ru", new[3]) and re.fullmatch(r"[а-яё]{4}@[а-яё]{5}\.рф", new[4])
    assert out[-1].lower() == f"an {new[0]}!"


def test_people_mentioned_again(spark):
    out = replaced(
        spark,
        "Then Anna Smith came. Mrs Anna Smith wrote; ANNA SMITH said so, and Smith's car, Anna, Smithson, smith, X-Smith.",
        "Dr Anna Smith and Prof. Dr. Anna Smith's dog and Mrs Jones",
        "Anna Smith is not named with a title here",
        "Herr Dr. Jürgen Groß, Groß; г-жа Анна Иванова, Иванова",
        "Mr Kim Lee and Mrs Kim Lee",
    )
    given, last = re.match(r"Then (\w+) (\w+) came", out[0]).groups()
    assert given.endswith("na") and {given, last}.isdisjoint({"Anna", "Smith"})
    assert out[0] == f"Then {given} {last} came. Mrs {given} {last} wrote; {given} {last} said so, and {last}'s car, {given}, Smithson, smith, X-Smith."
    assert re.fullmatch(rf"Dr {given} {last} and Prof\. Dr\. {given} {last}'s dog and Mrs \w+", out[1]) and "Jones" not in out[1]
    assert out[2] == "Anna Smith is not named with a title here"
    assert re.fullmatch(r"Herr Dr\. [A-Z]\w+[nrs] ([A-Z]\w+), \1; г-жа [А-Я][а-я]+на ([А-Я][а-я]+), \2", out[3])
    assert re.fullmatch(r"Mr (\w+ \w+) and Mrs \1", out[4])


def test_no_text_ends_a_job(spark):
    texts = ["x@" + "a." * 100_000, "Mr A" + "-aa" * 50_000, "Dr " * 50_000 + "Mrs Jones", "+1 " * 50_000, "1.2" * 50_000, "word " * 1_000_000, "GB82 " * 20_000]
    out = replaced(spark, *texts)
    assert len(out) == len(texts) and "Jones" not in out[2] and out[5] == texts[5]


def test_a_full_space_gets_longer_surrogates(spark):
    mails = [f"{a}@{b}.co" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    new = replaced(spark, *mails)
    assert len(set(new)) == len(mails) and not set(new) & set(mails) and all(re.fullmatch(r"[a-z]+@[a-z]\.co", x) for x in new)


def valid_iban(x):
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def luhn(x):
    digits = [int(c) for c in re.sub(r"\D", "", x)][::-1]
    return sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])


def test_every_kind_keeps_its_format(spark):
    iban, card = "GB82 WEST 1234 5698 7654 32", "4111-1111-1111-1111"
    text = f"call +1 (743) 555-3824 or (743) 555-3824 or 743-555-3824; {iban} and DE89370400440532013000; {card}; 078-05-1120; 10.1.2.3; a.b9@x.org"
    new = replaced(spark, text, text)
    assert new[0] == new[1]
    m = re.fullmatch(r"call \+1 \((\d{3})\) (\d{3})-(\d{4}) or \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})-(\d{3})-(\d{4}); (GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d) and (DE\d{20}); (4\d{3}-\d{4}-\d{4}-\d{4}); (\d{3}-\d\d-\d{4}); (\d+\.\d+\.\d+\.\d+); ([a-z]\.[a-z]\d@[a-z]\.org)", new[0])
    assert m and m.groups()[:3] == m.groups()[3:6] == m.groups()[6:9] and m[1][0] in "23456789" and m[2][0] in "23456789"
    assert valid_iban(iban) and valid_iban(m[10]) and valid_iban(m[11]) and luhn(card) % 10 == luhn(m[12]) % 10 == 0
    assert m[10] != iban and m[12] != card and m[13] != "078-05-1120" and m[14] != "10.1.2.3" and m[15] != "a.b9@x.org"


def test_other_keys_give_other_surrogates(spark):
    docs = spark.createDataFrame([(1, "a.b@x.org")], "doc_id long, text string")
    assert len({pii.surrogates(docs, key=k).first().text for k in ("a", "b", "c")}) == 3
    with pytest.raises(ValueError):
        pii.session_key(spark)
    spark.conf.set(pii.KEY_SETTING, "mine")
    assert pii.session_key(spark, "other") == "mine"
    spark.conf.unset(pii.KEY_SETTING)
    assert pii.session_key(spark, "other") == "other"


def test_plans_hide_the_key(spark, capsys):
    entities = spark.createDataFrame([("card", "4111111111111111"), ("given", "anna")], "kind string, canonical string")
    noisy = entities.withColumn("noise", pii._noise(pii._hidden(spark, "hush-hush"), F.col("kind"), F.col("canonical"), F.lit(0)))
    assert len({r.noise for r in noisy.collect()}) == 2
    noisy.explain("extended")
    assert "sha2" in (shown := capsys.readouterr().out) and "hush" not in shown


def test_people_of_20000_surnames_stay_apart(spark):
    people = [(f"{'Mr' if i % 2 else 'Mrs'} {g} {s}", g, s) for i, s in enumerate(SURNAMES) for g in [GIVEN[i % len(GIVEN)]]]
    texts = [f"{whole} met {people[i - 1][0]}; {s} left and {people[i - 1][2]} stayed." for i, (whole, _, s) in enumerate(people)]
    new, old = {}, set(SURNAMES) | set(GIVEN)
    for i, t in enumerate(replaced(spark, *texts)):
        m = re.fullmatch(r"Mrs? (\w+) (\w+) met Mrs? (\w+) (\w+); (\w+) left and (\w+) stayed\.", t)
        assert m and m[2] == m[5] and m[4] == m[6] and old.isdisjoint(m.groups())
        for role, word, made in (("s", i, m[2]), ("s", (i - 1) % len(people), m[4])):
            assert new.setdefault((role, SURNAMES[word]), made) == made
        for p, made in ((i, m[1]), (i - 1, m[3])):
            female = people[p][0].startswith("Mrs")
            assert new.setdefault((female, people[p][1]), made) == made and (not female or made.endswith("na"))
    assert len(set(new.values())) == len(new) == len(SURNAMES) + len({(p[0].startswith("Mrs"), p[1]) for p in people})


def test_forms_are_lengthened_only_where_they_are_full(spark):
    """Numbers of nine digits keep their length; of the cards of a form with 100 valid
    numbers, 30 are too many, so theirs get longer and stay valid."""
    def card(i):
        digits = f"41{i:02}"
        return next(digits + str(c) for c in range(10) if luhn(digits + str(c)) % 10 == 0)

    cards = [("card", card(i)) for i in range(30)]
    rows = [*cards, *[("national", f"{i:09}") for i in range(3_000)], *[("phone", f"202{i:07}") for i in range(500)]]
    got = pii.assign_surrogates(spark.createDataFrame(rows, "kind string, canonical string"), "change-me").collect()
    assert len({(r.kind, r.surrogate) for r in got}) == len(rows) and not {(r.kind, r.surrogate) for r in got} & set(rows)
    for r in got:
        assert len(r.surrogate) == len(r.canonical)
        assert r.kind != "card" or (luhn(r.surrogate) % 10 == 0 and r.surrogate[0] == "4")
    more = [("card", f"4{i:02}{next(c for c in range(10) if luhn(f'4{i:02}{c}') % 10 == 0)}") for i in range(60)]
    got = pii.assign_surrogates(spark.createDataFrame(more, "kind string, canonical string"), "change-me").collect()
    assert len({r.surrogate for r in got}) == 60 and all(len(r.surrogate) == 5 and r.surrogate[0] == "4" and luhn(r.surrogate) % 10 == 0 for r in got)
