"""URL filters: listed rules, and boosted trees for what no rule names.

Rules name a host (with its subdomains) and a path prefix; the longest one that fits
decides. Labelled URLs are those that a rule decides: at most ``FIT_ROWS`` of them, the
first by a hash, train gradient-boosted trees on lexical features, which judge the rest.

Defined cases: a null URL or one without ``://`` has an empty host and path and no rule;
with labels of one class only, or none, URLs without a rule are allowed; repeated rows
are judged one by one; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, written

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
FIT_ROWS = 20_000
TREES, DEPTH, SEED = 20, 4, 7
NUMBERS = (
    "url_chars", "host_chars", "path_chars", "labels", "depth", "digit_ratio", "entropy", "parameters",
    "hyphens", "dots", "longest_label", "suffix_chars", "suffix_share", "label_share", "secure",
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as text; null if none does."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda x: len(x[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _count(s: Column, sign: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(sign), F.lit("")))


def _lexical(pages: DataFrame) -> DataFrame:
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    size = F.greatest(F.length(url), F.lit(1))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size
    signs = F.filter(F.array_distinct(F.split(url, "")), lambda c: c != "")
    labels = F.split(host, r"\.")
    return pages.withColumns({
        "url_chars": F.length(url), "host_chars": F.length(host), "path_chars": F.length(path),
        "labels": F.size(labels), "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
        "digit_ratio": (F.length(url) - F.length(F.regexp_replace(url, "[0-9]", ""))) / size,
        "entropy": F.aggregate(F.transform(signs, lambda c: -share(c) * F.log2(share(c))), F.lit(0.0), lambda a, x: a + x),
        "parameters": F.when(url.contains("?"), _count(url, "&") + 1).otherwise(0),
        "hyphens": _count(url, "-"), "dots": _count(url, "."),
        "longest_label": F.array_max(F.transform(labels, lambda x: F.length(x))),
        "suffix": F.element_at(labels, -1), "label": F.coalesce(F.get(labels, F.size(labels) - 2), F.lit("")),
        "suffix_chars": F.length(F.element_at(labels, -1)), "secure": url.startswith("https").cast("int"),
    })


def _shares(pages: DataFrame, key: str, total: int) -> DataFrame:
    return pages.groupBy(key).agg((F.count(F.lit(1)) / total).alias(f"{key}_share"))


def featured(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """``id, host, path, rule`` and the features; written once."""
    host, path = split_url(F.col("url"))
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    named = named.withColumn("host", host).withColumn("path", path).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    base = written(_lexical(named), "urls")
    total = max(1, base.count())
    for key in ("suffix", "label"):
        base = join_small(base, written(_shares(base, key, total), f"{key}es"), key, spread="id")
    return written(base.select("id", "host", "path", "rule", *[F.col(c).cast("double").alias(c) for c in NUMBERS]), "features")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, rows: int = FIT_ROWS) -> DataFrame:
    """``id, host, path, rule, verdict, block_score`` for every row of ``pages``; the
    score is null where a rule decides."""
    table = featured(pages, id_col, url_col, rules)
    verdicts = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules])
    ruled = table.filter("rule is not null").withColumn("label", (verdicts == "block").cast("double"))
    # The rows of smallest hash; thinned by it where they lie, so that few are ordered.
    share = (rows + 6 * math.sqrt(rows) + 20) / max(1, ruled.count())
    hashed = ruled.withColumn("hash", F.xxhash64("id"))
    thin = hashed if share >= 1 else hashed.filter(F.col("hash") <= int(-(2**63) + share * 2**64))
    sample = written(thin.orderBy("hash", "id").limit(rows).drop("hash"), "labelled")
    kinds = sample.select("label").distinct().count()
    vectors = VectorAssembler(inputCols=list(NUMBERS), outputCol="features")
    if kinds == 2:
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxMemoryInMB=64).fit(vectors.transform(sample))
        rest = model.transform(vectors.transform(table.filter("rule is null")))
        from pyspark.ml.functions import vector_to_array

        rest = rest.withColumn("block_score", F.get(vector_to_array("probability"), F.lit(1)))
    else:
        rest = table.filter("rule is null").withColumn("block_score", F.lit(0.0))
    plain = ["id", "host", "path", "rule"]
    judged = rest.select(*plain, F.when(F.col("block_score") > 0.5, "block").otherwise("allow").alias("verdict"), "block_score")
    listed = table.filter("rule is not null").select(*plain, verdicts.alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    return listed.unionByName(judged).withColumnRenamed("id", id_col)
