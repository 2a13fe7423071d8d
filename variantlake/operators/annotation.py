"""Loads and the table of annotations, one row per rsID.

Stars, rank, category, gene and texts depend on the rsID alone: they are computed
here once, so a cohort's analysis is one join and one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, texts
from ..functions.rules import CLINVAR_ENTRY, GWAS_ENTRY
from .store import Store

CLINVAR_TEXT = ["gene", "clinical_significance", "conditions", "review_status", "last_evaluated"]


def last_by_rsid(clinvar: DataFrame) -> DataFrame:
    """The last line of each rsID."""
    row = F.struct(*CLINVAR_TEXT)
    return clinvar.groupBy("rsid").agg(F.max_by(row, "ordinal").alias("r")).select("rsid", "r.*")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with the rows of ``new``, which has one row per rsID; write to a new path."""
    return old.join(new, "rsid", "left_anti").unionByName(new)


def _entries() -> Column:
    """An rsID's associations in ``id`` order, as an aggregate."""
    names = ["rsid", "trait", "p_value", "odds_ratio", "mapped_gene", "study", "pubmed_id"]
    return F.array_sort(F.collect_list(F.struct("id", F.struct(*names).alias("entry"))))


def _listed(entries: str) -> Column:
    return F.coalesce(F.transform(entries, lambda x: x["entry"]).cast(f"array<{GWAS_ENTRY}>"), F.array().cast(f"array<{GWAS_ENTRY}>")).alias("gwas")


def _own_entry() -> Column:
    entry = F.struct("rsid", "gene", "clinical_significance", "conditions", "review_status", rules.review_stars(F.col("review_status")).alias("review_stars"))
    return F.array(entry.cast(CLINVAR_ENTRY)).alias("clinvar")


def gwas_lists(gwas: DataFrame) -> DataFrame:
    """``rsid, gwas``: each rsID's entries in ``id`` order."""
    return gwas.groupBy("rsid").agg(_entries().alias("l")).select("rsid", _listed("l"))


def annotations(clinvar: DataFrame, gwas: DataFrame) -> DataFrame:
    """``rsid, clinvar, gwas, significance_rank, category`` of all annotated rsIDs;
    ``clinvar`` has one row per rsID."""
    both = clinvar.select("rsid", _own_entry()).join(gwas_lists(gwas), "rsid", "full_outer")
    both = both.select("rsid", F.coalesce("clinvar", F.array().cast(f"array<{CLINVAR_ENTRY}>")).alias("clinvar"), F.coalesce("gwas", F.array().cast(f"array<{GWAS_ENTRY}>")).alias("gwas"))
    first = F.get("clinvar", F.lit(0))
    sig, stars = first["clinical_significance"], first["review_stars"]
    return both.select("*", rules.weighted_rank(sig, stars, F.size("gwas") > 0).alias("significance_rank"), rules.category(sig, F.col("gwas")).alias("category"))


def slim_annotations(clinvar: DataFrame, gwas: DataFrame) -> DataFrame:
    """``rsid, n_clinvar, n_gwas, significance_rank, category, gene, strong`` of all annotated
    rsIDs: what an analysis needs, by ordered aggregates. No list is built, so an rsID with
    any number of associations is combined before the shuffle. ``clinvar`` has one row per
    rsID."""
    return _per_rsid(clinvar, gwas, lists=False)


def stored_rows(clinvar: DataFrame, gwas: DataFrame) -> DataFrame:
    """The same with the lists ``clinvar, gwas``, in one pass of both tables."""
    return _per_rsid(clinvar, gwas, lists=True)


def _per_rsid(clinvar: DataFrame, gwas: DataFrame, lists: bool) -> DataFrame:
    told = rules.trait_category(F.col("trait"))
    of_gwas = gwas.groupBy("rsid").agg(
        F.count(F.lit(1)).alias("n_gwas"),
        F.min_by("mapped_gene", "id").alias("mapped_gene"),
        F.min_by(told, F.when(told.isNotNull(), F.col("id"))).alias("told"),
        F.bool_or(rules.is_strong_p(F.col("p_value"))).alias("strong_p"),
        *([_entries().alias("l")] if lists else []),
    )
    own = clinvar.select("rsid", "gene", F.col("clinical_significance").alias("sig"), rules.review_stars(F.col("review_status")).alias("stars"), F.lit(1).alias("n_clinvar"), *([_own_entry()] if lists else []))
    both = own.join(of_gwas, "rsid", "full_outer")
    has_gwas, sig = F.col("n_gwas").isNotNull(), F.col("sig")
    gene = F.when(F.col("n_clinvar") == 1, F.col("gene")).otherwise(F.col("mapped_gene"))
    shown = [F.coalesce("clinvar", F.array().cast(f"array<{CLINVAR_ENTRY}>")).alias("clinvar"), _listed("l")] if lists else []
    return both.select(
        "rsid", *shown, F.coalesce("n_clinvar", F.lit(0)).alias("n_clinvar"), F.coalesce("n_gwas", F.lit(0)).cast("int").alias("n_gwas"),
        rules.weighted_rank(sig, F.col("stars"), has_gwas).alias("significance_rank"), rules.category_of(sig, has_gwas, F.col("told")).alias("category"),
        F.nullif(gene, F.lit("")).alias("gene"), (rules.is_strong(sig) | F.coalesce("strong_p", F.lit(False))).alias("strong"),
    )


def entries_of(rsids: DataFrame, clinvar: DataFrame, gwas: DataFrame) -> DataFrame:
    """``rsid, clinvar, gwas`` of the annotated rsIDs among these: lists are built for what
    is printed only."""
    wanted = rsids.select("rsid").distinct()
    near = lambda df: df.join(wanted, "rsid", "left_semi")
    return annotations(near(clinvar), near(gwas)).select("rsid", "clinvar", "gwas")


def facts(clinvar: DataFrame, gwas: DataFrame) -> DataFrame:
    """``rsid, facts``: the raw-data lines of all annotated rsIDs, made once for each and not
    for each result. ``clinvar`` has one row per rsID."""
    line = F.struct("id", texts.gwas_fact(F.col("trait"), F.col("p_value")).alias("line"))
    lines = gwas.select("rsid", line.alias("l")).groupBy("rsid").agg(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]).alias("of_gwas"))
    own = clinvar.select("rsid", F.array(texts.clinvar_fact(F.col("conditions"), F.col("clinical_significance"))).alias("of_clinvar"))
    none = F.array().cast("array<string>")
    return own.join(lines, "rsid", "full_outer").select("rsid", texts.fact_blocks(F.coalesce("of_clinvar", none), F.coalesce("of_gwas", none)).alias("facts"))


def lookup(rsids: DataFrame, table: DataFrame) -> DataFrame:
    """Every distinct requested rsID with its entries; empty lists where there are none."""
    found = rsids.select("rsid").distinct().join(table.select("rsid", "clinvar", "gwas"), "rsid", "left")
    return found.select("rsid", F.coalesce("clinvar", F.array().cast(f"array<{CLINVAR_ENTRY}>")).alias("clinvar"), F.coalesce("gwas", F.array().cast(f"array<{GWAS_ENTRY}>")).alias("gwas"))


def store_statistics(clinvar: DataFrame, gwas: DataFrame) -> DataFrame:
    """One row: rows of both tables, their sum, distinct genes."""
    c = clinvar.agg(F.count(F.lit(1)).alias("clinvar_rows"), F.count_distinct(F.nullif("gene", F.lit(""))).alias("genes"))
    g = gwas.agg(F.count(F.lit(1)).alias("gwas_rows"))
    return c.crossJoin(g).withColumn("total_rows", F.col("clinvar_rows") + F.col("gwas_rows"))  # one row each


def _no_gwas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id long, rsid string, trait string, p_value double, odds_ratio string, mapped_gene string, study string, pubmed_id string, link string")


def build_tables(clinvar: DataFrame, gwas: DataFrame | None, path: str, versions: tuple[str, str] = ("unknown", "unknown"), loaded_at: str | None = None, gwas_mode: str = "overwrite") -> DataFrame:
    """Writes both tables, the annotations and a load record under ``path`` (a new one
    for each load); returns the record."""
    spark = clinvar.sparkSession
    seen_c, seen_g = Observation(), Observation()
    rows = F.count(F.lit(1)).alias("rows")
    last_by_rsid(clinvar).observe(seen_c, rows).write.mode("overwrite").parquet(f"{path}/clinvar")
    if gwas is None:
        versions = (versions[0], "unavailable")
        gwas = _no_gwas(spark)
    gwas.observe(seen_g, rows).write.mode(gwas_mode).parquet(f"{path}/gwas")
    stored_c, stored_g = spark.read.parquet(f"{path}/clinvar"), spark.read.parquet(f"{path}/gwas")
    annotations(stored_c, stored_g).write.mode("overwrite").parquet(f"{path}/annotations")
    when = F.lit(loaded_at) if loaded_at else F.current_timestamp().cast("string")
    n_c, n_g = seen_c.get["rows"], stored_g.count() if gwas_mode == "append" else seen_g.get["rows"]  # a count reads footers
    genes = stored_c.agg(F.count_distinct(F.nullif("gene", F.lit(""))).alias("genes"))  # one column
    record = genes.select(
        when.alias("last_update"), F.lit(versions[0]).alias("clinvar_version"), F.lit(versions[1]).alias("gwas_version"),
        F.lit(n_c).cast("long").alias("clinvar_rows"), "genes", F.lit(n_g).cast("long").alias("gwas_rows"), F.lit(n_c + n_g).cast("long").alias("total_rows"),
    )
    record.write.mode("append").parquet(f"{path}/loads")
    return record


def load_tables(clinvar: DataFrame, gwas: DataFrame | None, store: Store, versions: tuple[str, str] = ("unknown", "unknown"), loaded_at: str | None = None, gwas_mode: str = "overwrite") -> DataFrame:
    """Loads lines into the tables ``clinvar, gwas, annotations, loads`` of a store as one
    version; returns the load record. The last line of an rsID wins, in a load and over
    loads; rsIDs that are absent from a load survive it. Associations are replaced, or
    appended behind the earlier ones; without any the earlier ones stay. Annotations are
    made anew in touched buckets only. Rows are counted as they are written."""
    old, spark = store.version(), store.spark
    parts, columns = {}, {}

    last = last_by_rsid(clinvar)
    new_c = store.stage("clinvar", last, "rsid")
    parts["clinvar"], columns["clinvar"] = store.merged(old, "clinvar", new_c, ["rsid"], "rsid"), last.schema.json()
    changed = {p.bucket for p in new_c}
    if gwas is None:
        versions = (versions[0], "unavailable")
        parts["gwas"] = old.of("gwas")
        columns["gwas"] = old.columns.get("gwas") or _no_gwas(spark).schema.json()
    else:
        placed = gwas.withColumn("id", F.struct(F.lit(old.number + 1).alias("load"), F.col("id").alias("line")))
        new_g = store.stage("gwas", placed, "rsid")
        earlier = old.of("gwas") if gwas_mode == "append" else []
        parts["gwas"], columns["gwas"] = [*earlier, *new_g], placed.schema.json()
        changed |= {p.bucket for p in new_g} | ({p.bucket for p in old.of("gwas")} if gwas_mode != "append" else set())
    of = lambda table: store.rows_of([p for p in parts[table] if p.bucket in changed], columns[table])
    c, g = of("clinvar"), of("gwas")
    table = stored_rows(c, g)
    parts["annotations"] = [*(p for p in old.of("annotations") if p.bucket not in changed), *store.stage("annotations", table, "rsid")]
    columns["annotations"] = table.schema.json()

    genes = store.rows_of(parts["clinvar"], columns["clinvar"]).agg(F.count_distinct(F.nullif("gene", F.lit("")))).first()[0]  # one column
    n_c, n_g = (sum(p.rows for p in parts[t]) for t in ("clinvar", "gwas"))
    when = F.lit(loaded_at) if loaded_at else F.current_timestamp().cast("string")
    record = spark.range(1).select(
        when.alias("last_update"), F.lit(versions[0]).alias("clinvar_version"), F.lit(versions[1]).alias("gwas_version"),
        F.lit(n_c).cast("long").alias("clinvar_rows"), F.lit(genes).cast("long").alias("genes"), F.lit(n_g).cast("long").alias("gwas_rows"), F.lit(n_c + n_g).cast("long").alias("total_rows"),
    )
    parts["loads"], columns["loads"] = [*old.of("loads"), *store.stage("loads", record, "last_update")], record.schema.json()
    store.commit(old, parts, columns)
    return record
