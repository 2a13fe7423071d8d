"""What a model answered, handed back to the results it was asked about.

Answers have ``sample_id, rsid, answer, reason, ordinal``: the text, or why there is none,
and an order given by who asked. Of several answers to one result the last one counts,
whenever it arrives.

Defined cases: an empty answer is one; an answer without a text gives the raw-data text with
its reason, or the usual one; a result that was never answered likewise; answers without a
result are left out; equal ordinals go by the later arrival, in one table by the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import texts
from .store import BUCKETS, Store

ANSWERS = "sample_id string, rsid string, answer string, reason string, ordinal long"
KEY = ["sample_id", "rsid"]


def last_answers(answers: DataFrame) -> DataFrame:
    """One answer for each result: the last."""
    row = F.struct("answer", "reason", "ordinal")
    order = F.struct("ordinal", *[c for c in ("arrival",) if c in answers.columns], "answer", "reason")
    return answers.groupBy(*KEY).agg(F.max_by(row, order).alias("r")).select(*KEY, "r.*")


def explained(results: DataFrame, answers: DataFrame, product: str = "This library") -> DataFrame:
    """Results with ``explanation``: the answer, checked for diagnostic language, with the
    variant's warnings and the disclaimer; without an answer the raw data and the reason.
    Also ``answered`` and ``flagged``. Only slim answers are aggregated; results keep their
    rows. Those with ``gene`` and ``facts`` need no lists."""
    told = last_answers(answers.select(*KEY, "answer", "reason", "ordinal")).drop("ordinal")
    met = results.join(told, KEY, "left")
    answer = F.col("answer")
    reason = F.coalesce("reason", F.lit(texts.NO_ANSWER))
    if "facts" in results.columns:
        notes, unanswered = texts.gene_warnings(F.col("gene"), F.col("rsid")), texts.fallback_of(F.col("facts"), reason=reason)
    else:
        notes, unanswered = texts.warnings(F.col("clinvar"), F.col("gwas"), F.col("rsid")), texts.fallback_text(reason=reason)
    shown = F.when(answer.isNotNull(), texts.wrapped(texts.safe_text(answer), notes, product)).otherwise(unanswered)
    out = met.withColumn("explanation", shown).withColumn("answered", answer.isNotNull()).withColumn("flagged", texts.is_diagnostic(answer))
    return out.drop("answer", "reason")


def merge_answers(store: Store, answers: DataFrame, token: str | None = None) -> None:
    """Adds answers to the table ``answers`` of a store; for each result the last one stays,
    in whatever order they come. Buckets without new answers are not read."""
    new = answers.select(*KEY, "answer", "reason", "ordinal")
    version = store.version()
    if token is not None and token == version.token:
        return
    if "answers" in version.columns:
        touched = {r[0] for r in new.select(store.bucket(F.col("sample_id"))).distinct().collect()}  # at most the buckets
        asked = new.select(*KEY).distinct()
        old = store.read("answers", version, touched).join(asked, KEY, "left_semi")
        new = new.withColumn("arrival", F.lit(1)).unionByName(old.withColumn("arrival", F.lit(0)))
    store.replace("answers", last_answers(new), KEY, "sample_id", token)


def stored_answers(spark: SparkSession, path: str) -> DataFrame:
    store = Store(spark, path)
    version = store.version()
    return store.read("answers", version) if "answers" in version.columns else spark.createDataFrame([], ANSWERS)


def answers_as_they_arrive(spark: SparkSession, folder: str, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """JSON files of answers that arrive in ``folder`` are merged into the store under
    ``path``, each batch exactly once: a batch that runs again finds its token there. One
    stream feeds a store."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            merge_answers(Store(spark, path, buckets), batch, f"batch {batch_id}")
        finally:
            batch.unpersist()

    stream = spark.readStream.schema(ANSWERS).json(folder)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
