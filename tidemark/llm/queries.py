"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chat, counting, decontam, katz, lines, packing, pii, quality, simhash, suffixes
from tidemark.llm.common import table


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.preferences(chat.neighbours(table(spark, sf_dir, "conversations"))))


def op3_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), word_tokenizer())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.dedup_lines(table(spark, sf_dir, "documents")))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.remove_repeats(table(spark, sf_dir, "documents")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return counting.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_chat_formatting": op2_chat_formatting,
        "op3_katz_backoff": op3_katz_backoff,
        "op4_simhash_near_dedup": op4_simhash_near_dedup,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_quality_rules": op6_quality_rules,
        "op7_line_dedup": op7_line_dedup,
        "op8_benchmark_decontamination": op8_benchmark_decontamination,
        "op9_suffix_array_dedup": op9_suffix_array_dedup,
        "op10_token_counts": op10_token_counts,
    }


CHAT_SQL = """
WITH turns AS (
    SELECT conv_id >> 1 AS pair_id, conv_id % 2 = 0 AS first, {'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t FROM conversations WHERE conv_id IS NOT NULL
), sides AS (
    SELECT pair_id, coalesce(list(t ORDER BY t.turn NULLS FIRST, t.role, t.text) FILTER (WHERE first), []) AS c, coalesce(list(t ORDER BY t.turn NULLS FIRST, t.role, t.text) FILTER (WHERE NOT first), []) AS r
    FROM turns GROUP BY pair_id
), cut AS (
    SELECT *, coalesce(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i].role <> r[i].role OR c[i].text <> r[i].text)[1] - 1, least(len(c), len(r))) AS n FROM sides
), texts AS (
    SELECT pair_id, n, list_transform(c[1:n], lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS p, c[n + 1:] AS ct, r[n + 1:] AS rt FROM cut
), rendered AS (
    SELECT *, list_transform(ct, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS cx, list_transform(rt, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS rx FROM texts
)
SELECT pair_id, n AS n_prompt_turns, array_to_string(p, '') AS prompt, array_to_string(cx, '') AS chosen, array_to_string(rx, '') AS rejected,
    array_to_string(list_transform(list_filter(range(1, len(ct) + 1), lambda i: ct[i].role = 'assistant'), lambda i: (length(array_to_string(cx[1:i - 1], '')) + 14) || ':' || length(array_to_string(cx[1:i], ''))), ',') AS chosen_mask,
    array_to_string(list_transform(list_filter(range(1, len(rt) + 1), lambda i: rt[i].role = 'assistant'), lambda i: (length(array_to_string(rx[1:i - 1], '')) + 14) || ':' || length(array_to_string(rx[1:i], ''))), ',') AS rejected_mask
FROM rendered
"""

DECONTAMINATION_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, n, w[i:i + n - 1] AS x FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), own AS (
    SELECT row, i, n, w[i:i + n - 1] AS x FROM (SELECT row, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, (SELECT DISTINCT n FROM windows))
), hits AS (
    SELECT row, i, own.n AS n, item_id FROM own JOIN windows ON own.n = windows.n AND own.x = windows.x
), words AS (
    SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS k FROM hits) GROUP BY row
), items AS (
    SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT row, item_id::varchar AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY row
)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.row = words.row LEFT JOIN items ON d.row = items.row
"""


def oracle_sql() -> dict[str, str]:
    """Of the operators that SQL can express."""
    return {"op2_chat_formatting": CHAT_SQL, "op8_benchmark_decontamination": DECONTAMINATION_SQL}
