"""Secret scans: keyword prefilter, anchored expressions, checksum validation.

One Aho-Corasick pass over the lower-cased text finds the keywords of all kinds;
an expression anchored at a hit then decides. A hit inside the span of an earlier
match of its kind is skipped, so matches are leftmost and do not overlap, as with a
scan of the expression itself. Runs of hex digits have no keyword and are scanned
for directly. Kinds whose tokens carry a checksum count only where it agrees.

Defined cases: a null text counts as empty; an empty text or table has no spans;
repeated rows are scanned one by one; other columns are ignored, whatever their
names. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<kind string, start int, end int>>"


def _crc_token(body: str) -> bool:
    """The last six characters are the CRC-32 of the ones before, in base 62."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    n, out = zlib.crc32(body[:-6].encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = digits[r] + out
    return out == body[-6:]


def _json_part(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except (ValueError, binascii.Error, RecursionError):  # the last one: nested too deep to be a header
        return False


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: kind: (keywords in lower case, expression, test of a match). In the order in which
#: spans with one start are listed.
KINDS = {
    "assign": (
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        "(?:" + "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api") + "_?" + _any_case("key") + ")"
        + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: len(m[1]) >= 8,
    ),
    "access": (("akia",), r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    "hex": ((), r"[0-9a-f]{32,}", lambda m: True),
    "checked": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), r"(?:gh[pousr]|npm)_([A-Za-z0-9]{36})(?![A-Za-z0-9])", lambda m: _crc_token(m[1])),
    "webtoken": (("eyj",), r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]{16,}", lambda m: _json_part(m[1]) and _json_part(m[2])),
    "key": (("-----begin ",), r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", lambda m: True),
}
BASE = ("assign", "access", "hex")


@lru_cache(1)
def _tools():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for kind, (words, _, _) in KINDS.items():
        for w in words:
            automaton.add_word(w, (kind, len(w)))
    automaton.make_automaton()
    return automaton, {k: re.compile(x) for k, (_, x, _) in KINDS.items()}


def _lowered(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a whole text by start, then kind as listed."""
    if not text:
        return []
    automaton, rules = _tools()
    hits: dict[str, list[int]] = {}
    for end, (kind, n) in automaton.iter(_lowered(text)):
        hits.setdefault(kind, []).append(end - n + 1)
    found = [("hex", *m.span()) for m in rules["hex"].finditer(text)]
    for kind, starts in hits.items():
        done, rule, holds = 0, rules[kind], KINDS[kind][2]
        for start in sorted(starts):
            if start >= done and (m := rule.match(text, start)):
                done = m.end()
                if holds(m):
                    found.append((kind, *m.span()))
    order = list(KINDS)
    return sorted(found, key=lambda x: (x[1], order.index(x[0])))


def _scan_batch(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in scan(x)] for x in texts])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, spans`` (kind, start, end in order) for every row of ``docs``."""
    return docs.select(F.col(id_col), F.pandas_udf(_scan_batch, SPANS)(F.col(text_col).cast("string")).alias("spans"))


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per base kind, the SHA-256 of the base spans and all spans as text."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(docs, id_col, text_col).select(
        id_col, *map(count, BASE), F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
