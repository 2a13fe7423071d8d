"""Texts without expressions; lines of an rsID made once."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from variantlake.functions import rules, texts
from variantlake.operators import annotation
from variantlake.operators.scratch import written_once
from variantlake.plans import derived, registry

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_white_space_of_any_script(spark):
    """Every character of the first plane, at both ends and inside, as the expression had it."""
    made = [(f"{chr(i)} \n{chr(i)}a {chr(i)}b{chr(i)}\t{chr(i)}",) for i in range(0x10000) if not 0xD800 <= i < 0xE000] + [(None,), ("",), ("  \n",)]
    df = spark.createDataFrame(made, "t string")
    assert df.filter(~F.regexp_replace("t", r"(?U)^\s+|\s+$", "").eqNullSafe(rules.strip(F.col("t")))).count() == 0
    assert "regexp" not in plan(df.select(rules.strip(F.col("t"))))


def test_numbers_keep_their_value_and_form(spark):
    rng = random.Random(11)
    made = [(rng.choice([-1, 1]) * float(f"{rng.randrange(1, 10**9)}e{rng.randrange(-300, 290)}"),) for _ in range(4000)] + [(float(x),) for x in ("1e22", "1e16", "0.0", "1e-5", "-0.0001", "12.0", "5.3e-47")]
    got = spark.createDataFrame(made, "p double").select("p", F.col("p").cast("string").alias("plain"), texts.number_text(F.col("p")).alias("t"))
    rows = got.collect()
    assert [r for r in rows if Decimal(r.t) != Decimal(r.plain)] == []
    assert [r for r in rows if ("e" in r.t) != ("e" in repr(r.p))] == []
    assert {r.p: r.t for r in rows}[5.3e-47] == "5.3e-47"
    assert "regexp" not in plan(got)


def test_raw_data_lines_are_made_once_for_each_rsid(spark):
    """The same texts as from the lists of each result; none of those is built."""
    lists = registry.results(spark, DIR).select("sample_id", "rsid", texts.fallback_text().alias("explanation"))
    assert sorted(map(tuple, registry.fallback_texts(spark, DIR).collect())) == sorted(map(tuple, lists.collect()))
    text = plan(registry.fallback_texts(spark, DIR))
    assert "clinvar#" not in text.replace("n_clinvar#", "").replace("of_clinvar#", "")


def test_warnings_need_no_lists(spark):
    wanted = registry.results(spark, DIR).select("sample_id", "rsid", F.array_join(texts.warnings(F.col("clinvar"), F.col("gwas"), F.col("rsid")), "\n").alias("warnings"))
    found = registry.variant_warnings(spark, DIR)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    assert "collect_list" not in plan(found)


def test_printed_results_are_computed_once(spark):
    """The calls are not read again for the rsIDs of what is printed."""
    for name in ("prompts", "flat_results", "section_cards", "fallback_cards", "fallback_cards_explained"):
        assert "o_orderkey" not in plan(registry.queries()[name](spark, DIR)), name


def test_two_analyses_share_the_table_of_ranks(spark, monkeypatch):
    made, slim = [], registry.slim_table
    monkeypatch.setattr(registry, "slim_table", lambda *given: made.append(given) or slim(*given))
    assert registry.replaced_results(spark, DIR).count() > 0
    assert len(made) == 1


def test_written_once_keeps_rows(spark):
    df = spark.range(5).select("id", F.when(F.col("id") > 2, "x").alias("t"))
    assert sorted(map(str, written_once(df).collect())) == sorted(map(str, df.collect()))
    assert written_once(df.filter("id > 9")).count() == 0


def test_stored_rows_read_each_table_once(spark):
    c, g = annotation.last_by_rsid(derived.clinvar_lines(spark, DIR)), derived.gwas(spark, DIR)
    wanted = annotation.annotations(c, g).drop("significance_rank", "category").join(annotation.slim_annotations(c, g), "rsid")
    found = annotation.stored_rows(c, g)
    assert found.columns == wanted.columns and found.count() == wanted.count()
    assert sorted(map(repr, found.collect())) == sorted(map(repr, wanted.collect()))
    assert plan(found).count("Relation") == 2
