"""The queries of this subpackage: each applies one operator to its whole table. SQL is given where it can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm import chat, decontam, extract, langid, linededup, packing, quality, simhash, spotsigs, tokencount
from varloom.llm.common import held_out, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 3, 1)
    trees = quality.fit(docs, table(spark, sf_dir, "labels"), ~out)
    return quality.score(docs.select("doc_id", "text"), trees).select("doc_id", out.alias("held_out"), "score", "predicted")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = tokencount.token_lengths(table(spark, sf_dir, "documents"), tokenizer())
    return tokencount.suffix_sums(tokencount.histogram(lengths))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return linededup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "pair_id", "n_shared")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


#: The tools of the calls that `with_calls` writes.
SCHEMAS = {
    "measure": {
        "type": "object", "required": ["chars"], "additionalProperties": False,
        "properties": {"chars": {"type": "integer"}, "quote": {"type": "string"}, "after": {"type": "object"}},
    },
}
#: The table holds no tool calls, so calls and results are written for its assistant turns, by SQL that Spark and DuckDB share:
#: every one calls `measure` with its length; in spans of 20 turns it refers to the call two turns before; some have a wrong
#: type, an unknown tool or no result.
CALLS = """
SELECT conv_id, turn, 'assistant' AS role, concat('{{"tool_calls": [{{"id": "c', cast(turn AS {text}), '", "name": "',
         CASE WHEN length(text) % 13 = 0 THEN 'unknown' ELSE 'measure' END, '", "arguments": {{"quote": "q", "chars": ',
         CASE WHEN length(text) % 7 = 0 THEN '"many"' ELSE cast(length(text) AS {text}) END,
         CASE WHEN turn % 20 >= 2 THEN concat(', "after": {{"$ref": "c', cast(turn - 2 AS {text}), '"}}') ELSE '' END, '}}}}]}}') AS text
FROM {chats} WHERE role = 'assistant' AND text IS NOT NULL
UNION ALL SELECT conv_id, turn + 1 AS turn, 'tool' AS role,
         concat('{{"content": ', cast(length(text) AS {text}), ', "tool_call_id": "c', cast(turn AS {text}), '"}}') AS text
FROM {chats} WHERE role = 'assistant' AND text IS NOT NULL AND length(text) % 11 <> 0"""


def with_calls(conversations: DataFrame) -> DataFrame:
    chats = conversations.select("conv_id", "turn", "role", "text")
    return chats.unionByName(conversations.sparkSession.sql(CALLS.replace("{text}", "string"), chats=chats))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(with_calls(table(spark, sf_dir, "conversations")), SCHEMAS)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer())


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spotsigs.with_groups(spotsigs.with_next(docs), spotsigs.near_groups(docs))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    model = langid.fit(docs, ~out)
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_quality, op2_token_counts, op3_decontamination, op4_line_dedup, op5_html_extraction, op6_simhash, op7_chat_formatting,
        op8_packing, op9_spotsigs, op10_language,
    )
    return {f.__name__: f for f in own}


OP4_SQL = f"""
WITH docs AS (SELECT doc_id, text, source, row_number() OVER () AS r FROM documents),
lines AS (
  SELECT r, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM docs
), bad AS (
  SELECT trim(line) AS key FROM lines WHERE trim(line) <> ''
  GROUP BY 1 HAVING count(DISTINCT source) >= {linededup.SITES} AND count(DISTINCT text) >= {linededup.SITES}
), marked AS (
  SELECT l.*, b.key IS NOT NULL AS gone FROM lines l LEFT JOIN bad b ON trim(l.line) = b.key
), cleaned AS (
  SELECT r, count(*) AS n_lines, sum(gone::INT) AS n_gone, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS clean
  FROM marked GROUP BY r
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN c.clean END AS text,
       CAST(CASE WHEN d.text IS NULL THEN 0 ELSE c.n_lines END AS BIGINT) AS n_lines,
       CAST(CASE WHEN d.text IS NULL THEN 0 ELSE c.n_gone END AS BIGINT) AS n_removed
FROM docs d LEFT JOIN cleaned c USING (r)
"""


OP7_SQL = f"""
WITH RECURSIVE written AS ({CALLS.format(text="VARCHAR", chats="conversations")}),
plain AS (
  SELECT conv_id, turn, coalesce(nullif(role, ''), 'user') AS role, coalesce(text, '') AS text FROM conversations
), calls AS (
  SELECT conv_id, turn, concat('c', turn) AS call_id, CASE WHEN length(text) % 13 = 0 THEN 'unknown' ELSE 'measure' END AS name,
         CASE WHEN length(text) % 13 = 0 THEN 'unknown tool' WHEN length(text) % 7 = 0 THEN '$.chars: not integer' END AS error,
         CASE WHEN length(text) % 7 = 0 THEN '"many"' ELSE CAST(length(text) AS VARCHAR) END AS chars, length(text) % 11 <> 0 AS answered,
         CASE WHEN turn % 20 >= 2 THEN turn - 2 END AS before, length(text) AS n
  FROM conversations WHERE role = 'assistant' AND text IS NOT NULL
), places AS (
  SELECT conv_id, turn, 0 AS depth FROM calls c WHERE NOT EXISTS (SELECT 1 FROM calls b WHERE b.conv_id = c.conv_id AND b.turn = c.before)
  UNION ALL SELECT c.conv_id, c.turn, p.depth + 2 FROM places p JOIN calls c ON c.conv_id = p.conv_id AND c.before = p.turn
)
SELECT conv_id, turn, 0 AS part, role, 'message' AS kind, NULL AS call_id, NULL AS name, NULL AS error, 'plain' AS status, turn AS at_turn, 0 AS depth,
       concat('{{"content":', CAST(to_json(text) AS VARCHAR), ',"role":', CAST(to_json(role) AS VARCHAR), '}}') AS body FROM plain
UNION ALL SELECT conv_id, turn, 0, 'assistant', 'call', call_id, name, error,
       CASE WHEN error IS NOT NULL THEN 'invalid' WHEN answered THEN 'linked' ELSE 'unanswered' END, turn, depth,
       concat('{{"role":"assistant","tool_call":{{"arguments":{{', CASE WHEN before IS NULL THEN '' ELSE concat('"after":{{"$ref":"c', before, '"}},') END,
              '"chars":', chars, ',"quote":"q"}},"id":"', call_id, '","name":"', name, '"}}}}') FROM calls JOIN places USING (conv_id, turn)
UNION ALL SELECT conv_id, turn + 1, 0, 'tool', 'result', call_id, NULL, NULL, 'linked', turn + 1, depth + 1,
       concat('{{"content":', n, ',"role":"tool","tool_call_id":"', call_id, '"}}') FROM calls JOIN places USING (conv_id, turn) WHERE answered
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op7_chat_formatting": OP7_SQL}
