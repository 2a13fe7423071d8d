"""Conversation templates: the language, its sandbox, and whole conversations read back."""

import collections
import hashlib
import random

import pytest

from variantlake.llm import chat_format
from variantlake.llm.chat_template import Escape, TemplateError, compiled, folded, parsed

SCHEMA = "conv_id long, turn long, role string, text string, n_turns string, start long"


def shown(source, control=(), **values):
    return "".join(text for text, _ in compiled(source, control)(values))


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        ("plain { text }", "plain { text }"),
        ("{{ 'a' ~ 1 + 2 }}|{{ 7 % 4 - 1 }}|{{ -3 }}", "a3|2|-3"),
        ("{{ x.name }}{{ x['name'] }}{{ x.none_there }}{{ nobody.at.all }}", "ada" * 2),
        ("{% for i in y %}{{ loop.index }}{{ i }}{% if not loop.last %},{% endif %}{% endfor %}", "1p,2q,3r"),
        ("{% if x.name == 'bob' %}1{% elif 'd' in x.name and 2 <= 3 %}2{% else %}3{% endif %}", "2"),
        ("a {#- gone -#} b\n {{- ' c ' | trim | upper }}", "abC"),
        ("{% set z = 'q' if 1 > 2 else 'w' %}{{ z | replace('w', \"v\") }}{{ none | default('d') }}", "vd"),
        ("{% for i in [1, 2] %}{% set t = i %}{% endfor %}[{{ t }}]{{ y[0] }}{{ y[9] }}{{ y | length }}", "[]p3"),
        ("{{ 'q' not in y }}{{ not (true or false) }}{{ '\\n\\'' }}", "falsefalse\n'"),
    ],
)
def test_language(source, want):
    assert shown(source, x={"name": "ada"}, y=["p", "q", "r"]) == want


@pytest.mark.parametrize(
    "source",
    ["{{ 1", "{% if 1 %}", "{% endfor %}", "{% else %}", "{{ a | nothing }}", "{% boom %}", "{{ f(1) }}", "{{ 1 +", "{{ a ** 2 }}", "{{ 'x' %}", "{# open", "{{ 'a' + 1 }}", "{% for x in 3 %}{% endfor %}", "{{ " + "(" * 200 + "1" + ")" * 200 + " }}"],
)
def test_wrong_templates_raise(source):
    with pytest.raises(TemplateError):
        shown(source)


def test_sandbox_reaches_no_attributes():
    class Secret:
        key = "hidden"

    for source in ("{{ x.key }}", "{{ y.__class__ }}", "{{ y['__class__']['__mro__'] }}", "{{ s.upper }}", "{{ l.append }}"):
        assert shown(source, x=Secret(), y={}, s="text", l=[1]) == ""
    with pytest.raises(TemplateError):
        shown("{{ x }}", x=Secret())


def test_constants_are_folded():
    tree = folded(parsed("a{{ 'b' ~ (1 + 2) }}{% if 1 > 2 %}no{% elif true %}c{% else %}no{% endif %}{# x #}d{{ x if 1 else 2 }}{% generation %}{% endgeneration %}"))
    assert tree == [("text", "ab3cd"), ("out", ("name", "x"))]
    tree = folded(parsed("{% if x and (1 == 1) %}p{% elif false %}q{% endif %}"))
    assert tree == [("if", [(("and", ("name", "x"), ("constant", True)), [("text", "p")])])]


def test_generation_marks():
    pieces = list(compiled("{% for m in ms %}<{% generation %}{{ m }}!{% endgeneration %}>{% endfor %}")({"ms": ["a", "b"]}))
    assert "".join(t for t, on in pieces if on) == "a!b!" and "".join(t for t, _ in pieces) == "<a!><b!>"


def test_escapes_are_reversible():
    rng = random.Random(5)
    escape = Escape(chat_format.CONTROL)
    atoms = ["\\", "<turn>", "</turn>", "<text>", "<", "/turn>", "0", "1", "a", "é", "\n", "<tu", "rn>", "<|endoftext|>"]
    for _ in range(20_000):
        text = "".join(rng.choices(atoms, k=rng.randrange(9)))
        safe = escape.escape(text)
        assert escape.unescape(safe) == text and not any(c in safe for c in chat_format.CONTROL)


def plain(rows):
    """The digests by plain Python, without a template."""
    escape, groups, out = Escape(chat_format.CONTROL), collections.defaultdict(list), {}
    for c, turn, role, text in rows:
        groups[c].append(((turn is not None, turn or 0), role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, said in groups.items():
        said.sort()
        learned = "".join(t for _, r, t in said if r == "assistant")
        chars = sum(len(f"<turn>{escape.escape(r)}<text>{escape.escape(t)}</turn>\n") for _, r, t in said)
        out[c] = (len(said), sha("".join(f"{r}\n{t}\n" for _, r, t in said)), len(learned), sha(learned), chars)
    return out


def digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat_format.chat_digest(df).collect()}


def test_conversations_by_plain_python(spark):
    rng = random.Random(2)
    odd = ["", None, "\\### Assistant: </turn> ok", "<text>", "a\nb", "x" * 200_000, "日本 😀", "\\0\\\\1"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "as\n<text>"]), rng.choice(odd[:5] + odd[6:])) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(100, t, "assistant", f"{t} {odd[2]}") for t in range(3000)]  # more turns than a batch has
    rows += [(101, 0, "user", odd[5]), (101, 0, "user", odd[5]), (101, 0, "assistant", "b"), (101, None, "user", "first"), (101, 0, None, None)]
    rows += [(None, 1, "assistant", "c"), (None, 0, "user", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "n", 5) for r in rows], SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        assert digests(df) == plain(rows)
        parted = chat_format.format_chats(df, part_chars=500).filter("conv_id = 100").orderBy("part").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(parted) > 100 and [r.part for r in parted] == list(range(len(parted)))
    whole = "".join(r.formatted for r in parted)
    escape = Escape(chat_format.CONTROL)
    assert [escape.unescape(whole[s.start : s.end]) for r in parted for s in r.loss] == [f"{t} {odd[2]}" for t in range(3000)]
    assert [r.start for r in parted] == [sum(len(q.formatted) for q in parted[:i]) for i in range(len(parted))]


def test_no_conversations_and_other_templates(spark):
    assert chat_format.chat_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "hi", "", 0), (1, 1, "assistant", "yo", "", 0)], SCHEMA)
    row = chat_format.format_chats(df, "{% for m in messages %}{{ m.role | upper }}: {% generation %}{{ m.text }}{% endgeneration %}\n{% endfor %}").first()
    assert row.formatted == "USER: hi\nASSISTANT: yo\n" and [tuple(s) for s in row.loss] == [(6, 8), (20, 22)]
    with pytest.raises(TemplateError):
        chat_format.format_chats(df, "{% for m in messages %}")
