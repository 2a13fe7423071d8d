import pytest
from pyspark.sql import functions as F

from variantlake.functions import rules, texts


def values(spark, inputs, expression):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_stars(spark):
    given = ["practice guideline", "Reviewed by expert panel ", "criteria provided, multiple submitters, no conflicts", "criteria provided, single submitter", "no assertion provided", None, "", "odd"]
    assert values(spark, given, rules.review_stars) == [4, 3, 2, 1, 0, 0, 0, 0]


def test_base_rank(spark):
    given = ["Pathogenic", "Conflicting interpretations of pathogenicity", "Likely pathogenic, low penetrance", "benign; risk factor", "likely benign; other", " benign", "drug response", None, ""]
    assert values(spark, given, rules.base_rank) == [1, 1, 1, 3, 8, 10, 999, 999, 999]


def test_gt(spark):
    given = ["0|1", "1/0", "1", "./.", "0/3", "0/1/1", "", "a/b", "2|2"]
    assert values(spark, given, lambda c: rules.genotype_of_gt(c, F.lit("T"), F.lit("C,G"))) == ["CT", "CT", "CC", None, None, None, None, None, "GG"]


def test_numbers(spark):
    assert values(spark, [" 12 ", "+5", "1.5", "1_0", "x", None], rules.whole_number) == [12, 5, None, 10, None, None]
    assert values(spark, ["5e-3", "1.0d", "1E-400", ".5", "-"], rules.real_number) == [0.005, None, 0.0, 0.5, None]


@pytest.mark.parametrize("x", [5.3e-47, 1e-5, 0.0001, 0.00123, 1.0, 12.5, 123456.0, 1e15, 1.5e16, 1e22, 12345678.9, 0.0, 3e-100])
def test_number_text(spark, x):
    assert spark.createDataFrame([(x,)], "x double").select(texts.number_text(F.col("x"))).first()[0] == repr(x)


def test_diagnostic(spark):
    assert values(spark, ["Now YOU HAVE it", "you have", "a 100% chance", "certainly", None], texts.is_diagnostic) == [True, False, True, False, False]
