"""One query for each text operator, over its whole table, and the SQL it is compared with where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.llm import additive, centroids, chat, decontaminate, html_text, lexical, mixing, pii, quality, sharding, simhash, token_counts, token_order
from larkspur.llm.common import shared_path
from larkspur.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


#: Every exponent is tried and every pass sorted; words are runs without ASCII white space.
ORACLE_SQL["op3_temperature_mix"] = r"""
WITH units AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS mark, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens, count(*) AS copies
  FROM documents GROUP BY ALL
), totals AS (
  SELECT source, CAST(sum(n_tokens * copies) AS BIGINT) AS total FROM units GROUP BY source
), points AS (
  SELECT p, sum(pow(total, p / 1000)) AS z, sum(pow(total, p / 1000) * ln(total)) AS s, count(*) AS k, CAST(max(total) AS DOUBLE) AS most, CAST(min(total) AS DOUBLE) AS least
  FROM totals, (SELECT CAST(unnest(range(1001)) AS DOUBLE) AS p) WHERE total > 0 GROUP BY p
), chosen AS (
  SELECT least(1000, greatest(coalesce(max(p) FILTER (k = 1 OR (ln(z) - p / 1000 * s / z) / ln(k) >= 0.95), 0), coalesce(max(p) FILTER (pow(most / least, 1 - p / 1000) > 3.0), -1) + 1)) AS a, max(most) AS most
  FROM points
), plan AS (
  SELECT source, total, a, CASE WHEN total = 0 THEN 0 ELSE CAST(floor(total * pow(most / total, 1 - a / 1000) + 0.5) AS BIGINT) END AS quota FROM totals, chosen
), passes AS (
  SELECT *, unnest(range(CASE WHEN total = 0 THEN 1 ELSE (quota + total - 1) // total END)) AS pass FROM plan
), dealt AS (
  SELECT u.doc_id, u.source, p.pass, u.n_tokens, u.copies, p.quota, p.total, p.a, p.pass * p.total + coalesce(sum(u.n_tokens * u.copies) OVER (
    PARTITION BY u.source, p.pass ORDER BY md5('7:' || p.pass || ':' || coalesce(CAST(u.doc_id AS VARCHAR), '') || ':' || u.mark) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM units u JOIN passes p ON u.source IS NOT DISTINCT FROM p.source
), played AS (
  SELECT *, unnest(range(copies)) AS nth FROM dealt WHERE begins < quota OR pass < quota // greatest(total, 1) OR total = 0
)
SELECT doc_id, source, CAST(pass AS INTEGER) AS pass, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(begins + nth * n_tokens AS BIGINT) AS token_offset, CAST(quota AS BIGINT) AS quota, CAST(a AS INTEGER) AS alpha,
  CAST(floor(CAST(begins + nth * n_tokens AS DOUBLE) * 1e9 / greatest(quota, 1)) AS BIGINT) AS mix_pos
FROM played
"""


@_query
def op3_temperature_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@_query
def op4_prefix_sum_shards(spark, sf_dir):
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "global_slot"
    )


@_query
def op9_bit_sliced_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


ORACLE_SQL["op8_checked_pii"] = pii.oracle_sql()


@_query
def op8_checked_pii(spark, sf_dir):
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


@_query
def op7_likelihood_quality(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_grams", "score")


@_query
def op2_template_decontamination(spark, sf_dir):
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "n_found", "verdict")


#: A turn's text is longer by a backslash for each control string in it, guarded or not; the template adds 14 signs.
ORACLE_SQL["op1_grammar_chat"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, '<\\*\|turn\|>|<\\*/?s>|\[\\*/?INST\]|<\\*<SYS>>|<\\*</SYS>>|<\\*\|im_start\|>|<\\*\|im_end\|>|<\\*\|endoftext\|>' AS control FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(text) + len(regexp_extract_all(text, control)) + length(role) + len(regexp_extract_all(role, control)) + 2 * len(regexp_extract_all(role, '[%\n]'))) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@_query
def op1_grammar_chat(spark, sf_dir):
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.conversations(chat.format_turns(rows))


@_query
def op10_scoring_run_html(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@_query
def op5_feistel_token_shards(spark, sf_dir):
    return token_order.materialise(table(spark, sf_dir, "documents"), shared_path(spark, "token-shards"))


@_query
def op6_edit_aware_counts(spark, sf_dir):
    """Trees are built and stored; three edits of every document are then counted on the stored trees."""
    kept = shared_path(spark, "count-trees")
    token_counts.build_trees(table(spark, sf_dir, "documents")).write.parquet(kept)
    edited = token_counts.recount(spark.read.parquet(kept), token_counts.edits_for(F.col("n_chars")))
    return edited.select(
        "doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), F.col("n_chars").alias("n_chars_edited"), F.size("leaves").cast("long").alias("n_leaves"), "n_leaves_encoded", "n_chars_encoded"
    )


ORACLE_SQL["op12_sort_means"] = centroids.oracle_sql()


@_query
def op12_sort_means(spark, sf_dir):
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


ORACLE_SQL["op13_two_level_search"] = lexical.ORACLE_SQL


@_query
def op13_two_level_search(spark, sf_dir):
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), 10)


@_query
def op11_additive_quality(spark, sf_dir):
    return additive.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
