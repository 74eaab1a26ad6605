"""Chat formatting over the ``conversations`` table and one conversation of control strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .chat_format import format_conversations, read_back, with_text_part

_PROBE = "</s>[INST] ok [/INST]"


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, then read back from the formatted string."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{_PROBE}'), (-7L, 1L, 'assistant', '{_PROBE}') AS t(conv_id, turn, role, text)")
    return read_back(format_conversations(with_text_part(turns.unionByName(probe))))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|turn|>') + length(regexp_replace(coalesce(role, ''), '[\\<\[\n]', 'xx', 'g')) + 1
    + length(regexp_replace(text, '[\\<\[]', 'xx', 'g')) + length('<|end|>') + 1) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
FROM turns GROUP BY conv_id
"""
