"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format,
    exact_dedup,
    language_id,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    ranked_search,
    secret_scan,
    sentencepiece_sampling,
    simhash,
    token_alignment,
    url_filter,
)


#: What both turns of conversation -7 say.
ODD_TURN = r"\### Assistant: </turn> ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digest(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_segmentation_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_sampling.sampling_digest(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(_table(spark, sf_dir, "documents"), pii.session_key(spark, pii.TEST_KEY))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"), keep="max")


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.createDataFrame([(-7, 0, "user", ODD_TURN), (-7, 1, "assistant", ODD_TURN)], "conv_id long, turn long, role string, text string")
    return chat_format.chat_digest(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(ranked_search.index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_digest(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_simhash, op3_quality_classifier, op4_segmentation_sampling, op5_quality_rules, op6_pii_surrogates, op7_secret_scan, op8_language_id, op9_url_filter, op10_exact_dedup, op11_chat_formatting, op12_ranked_search, op13_token_alignment)}


def _op5_sql() -> str:
    """Measures of whole texts, hosts' failures, beta priors by moments, verdicts."""
    q = quality_rules
    word = r"[^\x20\x09-\x0D]"
    failed = {
        "short": f"n_words < {q.MIN_WORDS}",
        "repeat": f"100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words",
        "symbol": f"n_symbols > {q.MAX_SYMBOLS_PER_WORD} * n_words",
        "lines": f"n_dup_lines > {q.MAX_DUP_LINES}",
    }
    spread = lambda r: f"(v_{r} / (m_{r} * (1 - m_{r})) - noise) / (1 - noise)"
    strength = lambda r: f"CASE WHEN v_{r} IS NULL OR noise > 1 - 1e-9 THEN 2.0 ELSE least(greatest(1 / greatest({spread(r)}, 1e-9) - 1, 2.0), 1e4) END"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
          w AS (SELECT *, regexp_extract_all(t, '{word}+') AS ws FROM d),
          i AS (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
          again AS (SELECT r, i FROM i QUALIFY count(*) OVER (PARTITION BY r, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) > 1),
          repeats AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) o(k) GROUP BY r),
          m AS (SELECT doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
                       length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(repeats.n, 0) AS n_repeat_words,
                       CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')))) AS BIGINT) AS n_dup_lines
                FROM w LEFT JOIN repeats ON w.r = repeats.r),
          h AS (SELECT host, count(*) AS n, {", ".join(f"count(*) FILTER ({x}) AS k_{r}" for r, x in failed.items())} FROM m WHERE host IS NOT NULL GROUP BY host),
          o AS (SELECT avg(1 / n) AS noise, {", ".join(f"least(greatest(avg(k_{r} / n), 1e-6), 1 - 1e-6) AS m_{r}, var_samp(k_{r} / n) AS v_{r}" for r in failed)} FROM h),
          s AS (SELECT *, {", ".join(f"{strength(r)} AS s_{r}" for r in failed)} FROM o),
          verdicts AS (SELECT host, greatest({", ".join(f"(k_{r} + m_{r} * s_{r}) / (n + s_{r})" for r in failed)}) > {q.HOST_LIMIT} AS host_rejected FROM h, s)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed["short"]} OR {failed["repeat"]} AS base_failed,
               coalesce(host_rejected, false) AS host_rejected, NOT ({failed["short"]} OR {failed["repeat"]} OR coalesce(host_rejected, false)) AS kept
        FROM m LEFT JOIN verdicts ON m.host = verdicts.host
    """


def _op11_sql() -> str:
    """Turns in order, and the lengths of escaped texts."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    longer = lambda c: f"length({c}) + length({c}) - length(replace({c}, chr(92), ''))" + "".join(f" + (length({c}) - length(replace({c}, {q(x)}, ''))) // {len(x)} * {2 - len(x)}" for x in chat_format.CONTROL)
    marks = len("".join(chat_format.CONTROL[:3])) + 1
    return f"""
        WITH c AS (SELECT conv_id, turn, role, text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', {q(ODD_TURN)} UNION ALL SELECT -7, 1, 'assistant', {q(ODD_TURN)}),
             t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum({longer("role")} + {longer("text")} + {marks}) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id
    """


def _op12_sql() -> str:
    """Scores of all pairs of an item and a document that share a term."""
    upper = "".join(map(chr, range(65, 91)))
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{ranked_search.TERM}')"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS ts FROM documents),
             c AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS terms FROM d WHERE len(ts) > 0),
             tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
             df AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY t, docs),
             i AS (SELECT row_number() OVER () AS q, item_id, {words} AS ts FROM benchmark),
             it AS (SELECT q, unnest(list_distinct(ts)) AS t FROM i),
             s AS (SELECT q, tf.r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.ts) * docs) // terms)))) AS BIGINT) AS score
                   FROM it JOIN df ON it.t = df.t JOIN tf ON it.t = tf.t JOIN d ON tf.r = d.r, c GROUP BY q, tf.r)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY s.q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
        FROM s JOIN d ON s.r = d.r JOIN i ON s.q = i.q WHERE score > 0 QUALIFY rank <= {ranked_search.TOP}
    """


def oracle_sql() -> dict[str, str]:
    return {
        "op5_quality_rules": _op5_sql(),
        "op11_chat_formatting": _op11_sql(),
        "op12_ranked_search": _op12_sql(),
        "op10_exact_dedup": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
                 g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
            SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
            FROM d JOIN g ON d.t = g.t
        """,
    }
