"""Answers handed back to results, at once and as they arrive."""

import json

import pytest

from variantlake.functions import texts
from variantlake.operators import annotation
from variantlake.operators.explanations import ANSWERS, answers_as_they_arrive, explained, last_answers, merge_answers, stored_answers
from variantlake.operators.store import Store

from test_analysis import CLINVAR, CLINVAR_SCHEMA, GWAS, GWAS_SCHEMA

RESULTS = "sample_id string, rsid string, chromosome string, position long, genotype string"


@pytest.fixture(scope="module")
def results(spark):
    calls = spark.createDataFrame([("S", r, "1", 10, "AA") for r in ("rs429358", "rs7412", "rs762551", "rs1234", "rs12913832", "rs4988235")], RESULTS)
    table = annotation.annotations(spark.createDataFrame(CLINVAR, CLINVAR_SCHEMA), spark.createDataFrame(GWAS, GWAS_SCHEMA))
    return calls.join(table, "rsid")


def answers(spark, rows):
    return spark.createDataFrame([("S", *r) for r in rows], ANSWERS)


GIVEN = [
    ("rs429358", "Plain words.", None, 1), ("rs7412", "Sadly you have it.", None, 1), ("rs762551", None, "Request timed out", 1), ("rs12913832", "", None, 1),
    ("rs4988235", "early", None, 1), ("rs4988235", "late", None, 2), ("rs4988235", "earliest", None, 0), ("rs404", "to nobody", None, 1),
]


def test_hand_off(spark, results):
    got = {r.rsid: r for r in explained(results, answers(spark, GIVEN), "The product").collect()}
    end = texts.DISCLAIMER.format(product="The product")
    note = "\n" + texts.NOTES_TITLE + "- " + texts.WARNINGS["rs7412"] + "\n"
    assert len(got) == 6
    assert got["rs429358"].explanation == "Plain words." + note + end and not got["rs429358"].flagged
    assert got["rs7412"].explanation == "Sadly you have it." + texts.SAFETY_NOTE + note + end and got["rs7412"].flagged
    assert got["rs762551"].explanation.startswith("Explanation: Request timed out\n\nRaw variant data:\n- rsID: rs762551\n") and end not in got["rs762551"].explanation
    assert got["rs1234"].explanation.startswith(f"Explanation: {texts.NO_ANSWER}\n")
    assert got["rs12913832"].explanation == end and got["rs12913832"].answered
    assert got["rs4988235"].explanation == "late" + end
    assert [r for r, x in got.items() if not x.answered] == [r for r in got if r in ("rs762551", "rs1234")]


def test_one_row_for_each_answered_result(spark):
    rows = [("rs1", "b", None, 1), ("rs1", "a", None, 1), ("rs1", None, "x", 0), ("rs2", None, None, 5)]
    assert sorted(map(tuple, last_answers(answers(spark, rows)).collect())) == [("S", "rs1", "b", None, 1), ("S", "rs2", None, None, 5)]
    assert last_answers(answers(spark, [])).count() == 0


def shown(spark, results, path):
    return sorted((r.rsid, r.explanation) for r in explained(results, stored_answers(spark, path)).collect())


def test_batches_of_answers_make_one(spark, results, tmp_path):
    """Two files in two batches, the late answers first, and a batch that runs again."""
    land = tmp_path / "land"
    land.mkdir()
    whole = sorted((r.rsid, r.explanation) for r in explained(results, answers(spark, GIVEN)).collect())
    path, checkpoint = str(tmp_path / "store"), str(tmp_path / "cp")
    line = lambda r: json.dumps(dict(zip(("sample_id", "rsid", "answer", "reason", "ordinal"), ("S", *r))))
    assert shown(spark, results, path) == sorted((r.rsid, r.explanation) for r in explained(results, answers(spark, [])).collect())
    for n, lot in enumerate((GIVEN[4:6] + GIVEN[:1], GIVEN[1:4] + GIVEN[6:])):
        (land / f"{n}.json").write_text("\n".join(map(line, lot)) + "\n")
        answers_as_they_arrive(spark, str(land), path, checkpoint, buckets=4).awaitTermination(120)
        number = Store(spark, path).version().number
        assert number == n + 1
        answers_as_they_arrive(spark, str(land), path, checkpoint).awaitTermination(120)  # nothing new
        merge_answers(Store(spark, path), answers(spark, [("rs1234", "twice", None, 9)]), f"batch {n}")  # made already
        assert Store(spark, path).version().number == number
    assert shown(spark, results, path) == whole
