"""Quality rules with host-level verdicts.

Each text is measured once; rule failures are counted by host; a host's failure
rate per rule is shrunk towards the others' by a beta prior fitted to all hosts
(method of moments); a host whose shrunken rate is above ``HOST_LIMIT`` for some
rule is rejected, and the verdict is joined back to its documents.

Defined cases: a null or empty text has no words, so it fails; a null host has no
verdict and rejects nobody; an empty table gives an empty result; repeated rows
are measured one by one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Further rules, counted for hosts only: symbols per word, share of repeated lines' weight.
MAX_SYMBOLS_PER_WORD = 0.5
MAX_DUP_LINES = 10
#: A host is rejected where a shrunken failure rate is above this.
HOST_LIMIT = 0.5
RULES = ("short", "repeat", "symbol", "lines")

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split on ASCII white space only
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        end = 0  # words before this position are counted
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def _measure_batch(texts: pd.Series) -> pd.DataFrame:
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return pd.DataFrame([measure(x) for x in texts], columns=columns, dtype="int64")


def _base_failed(m: str = "") -> Column:
    words, repeated = F.col(f"{m}n_words"), F.col(f"{m}n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)


def _failures() -> list[Column]:
    words = F.col("n_words")
    return [
        words < MIN_WORDS,
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * words,
        F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * words,
        F.col("n_dup_lines") > MAX_DUP_LINES,
    ]


def document_metrics(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    return rows.withColumn("m", F.pandas_udf(_measure_batch, METRICS)("text")).select("id", "host", "m.*")


def host_table(metrics: DataFrame) -> DataFrame:
    """A row per host: its documents, failures and shrunken rate by rule, host_rejected.

    The prior comes back to the driver as one row: mean and variance of the rates, and
    the mean of 1 / n, by which the noise of small hosts is told from spread.
    """
    counts = written(
        metrics.filter("host is not null")
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f).alias(f"{r}_failed") for r, f in zip(RULES, _failures())]),
        "hosts",
    )
    rate = {r: F.col(f"{r}_failed") / F.col("n") for r in RULES}
    noise = F.avg(1 / F.col("n")).alias("noise")
    moments = counts.agg(noise, *[x for r in RULES for x in (F.avg(rate[r]).alias(f"{r}_m"), F.var_samp(rate[r]).alias(f"{r}_v"))]).first()
    out = counts
    for r in RULES:
        a, b = beta_prior(moments[f"{r}_m"], moments[f"{r}_v"], moments["noise"])
        out = out.withColumn(f"{r}_rate", (F.col(f"{r}_failed") + F.lit(a)) / (F.col("n") + F.lit(a + b)))
    over = F.greatest(*[F.col(f"{r}_rate") for r in RULES]) > HOST_LIMIT
    return out.withColumn("host_rejected", over)


def beta_prior(mean: float | None, variance: float | None, noise: float | None) -> tuple[float, float]:
    """Parameters of a beta-binomial's prior by moments: a host's rate varies by
    m (1 - m) (s + (1 - s) / n), where s is the spread of the hosts' own rates and
    ``noise`` the mean of 1 / n. The prior is strong where hosts differ by noise only, and
    weak where that cannot be told (one host, or one document a host)."""
    m = min(max(mean if mean is not None else 0.5, 1e-6), 1 - 1e-6)
    if variance is None or noise is None or noise > 1 - 1e-9:
        strength = 2.0
    else:
        spread = (variance / (m * (1 - m)) - noise) / (1 - noise)
        strength = min(max(1 / max(spread, 1e-9) - 1, 2.0), 1e4)
    return m * strength, (1 - m) * strength


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Metrics, base_failed, the host's verdict and kept for every row of ``docs``."""
    metrics = written(document_metrics(docs, id_col, text_col, host_col), "metrics")
    hosts = host_table(metrics).select("host", "host_rejected")
    out = join_small(metrics, hosts, "host", spread="id")
    rejected = F.coalesce(F.col("host_rejected"), F.lit(False))
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        _base_failed().alias("base_failed"), rejected.alias("host_rejected"), (~_base_failed() & ~rejected).alias("kept"),
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns. Texts are measured a
    second time here: that costs less than a shuffle of all texts by id."""
    hosts = host_table(written(document_metrics(docs, id_col, text_col, host_col), "metrics")).select("host", "host_rejected")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"),
    )
    good = rows.withColumn("m", F.pandas_udf(_measure_batch, METRICS)("text")).filter(~_base_failed("m."))
    out = join_small(good.select("row", "host", "id"), hosts, "host", spread="id")
    return out.filter(~F.coalesce(F.col("host_rejected"), F.lit(False))).select("row.*")
