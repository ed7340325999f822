"""The operators over whole tables, with production parameters, and the same in SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import chat, decontaminate, mixing, near_dedup, quality, suffix_dedup, token_output, tokens, toxicity, winnow
from nearfield.llm.spark import shared_folder


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def op1_minhash_near_dedup(spark, d):
    return near_dedup.near_duplicates(_documents(spark, d), percent=85)


def op2_token_counts(spark, d):
    return tokens.token_counts(_documents(spark, d))


def op3_quality_rules(spark, d):
    return quality.scored(_documents(spark, d), spark.read.parquet(f"{d}/labels.parquet"))


def op4_suffix_array_dedup(spark, d):
    found = suffix_dedup.repeated_passages(_documents(spark, d))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), "kept_text")


def op5_chat_formatting(spark, d):
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(more))


def op6_token_output(spark, d):
    path = shared_folder(spark)
    token_output.write_tokens(_documents(spark, d), path)
    return token_output.token_digests(spark, path)


def op7_toxicity(spark, d):
    return toxicity.scored(_documents(spark, d), spark.read.parquet(f"{d}/labels.parquet"))


def op8_source_mixing(spark, d):
    return mixing.mixed(_documents(spark, d)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "rate")


def op9_winnowing(spark, d):
    return winnow.edited_fingerprints(_documents(spark, d))


def op10_benchmark_decontamination(spark, d):
    return decontaminate.contained_items(_documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_near_dedup, op2_token_counts, op3_quality_rules, op4_suffix_array_dedup, op5_chat_formatting, op6_token_output, op7_toxicity, op8_source_mixing, op9_winnowing, op10_benchmark_decontamination)}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shingle sets of table t(id, text), as (id, s).
SHINGLES = f"""words AS (SELECT id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM t),
shingles AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s FROM words)"""

OP1 = f"""WITH RECURSIVE t AS (SELECT doc_id AS id, text FROM documents), {SHINGLES},
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
both_ AS (SELECT a.id AS u, b.id AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.id < b.id GROUP BY a.id, b.id),
links AS (SELECT u, v FROM both_ JOIN sizes x ON x.id = u JOIN sizes y ON y.id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
sides AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT a, v FROM reach JOIN sides ON u = b),
least_ AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT a AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, a = component_id AS kept FROM least_ LEFT JOIN sizes ON id = a"""

OP10 = f"""WITH t AS (SELECT doc_id * 2 AS id, text FROM documents UNION ALL SELECT item_id * 2 + 1, text FROM benchmark), {SHINGLES},
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
both_ AS (SELECT a.id AS d, b.id AS i, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.id % 2 = 0 AND b.id % 2 = 1 GROUP BY a.id, b.id)
SELECT d // 2 AS doc_id, i // 2 AS item_id, n AS n_item_shingles, c AS n_shared, c / n AS containment FROM both_ JOIN sizes ON id = i WHERE 100 * c >= 80 * n"""


OP5 = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) + length(role) + length(regexp_replace(role, '[^\\<#:\n]', '', 'g')) + 14 AS size FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars FROM e GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": OP1, "op5_chat_formatting": OP5, "op10_benchmark_decontamination": OP10}
