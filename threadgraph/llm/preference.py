"""Preference formatting of chat conversations (DataFrame functions only).

Of a chosen and a rejected conversation, the longest common prefix of turns is rendered once, as the prompt; what follows in
each becomes its completion, with a mask that gives the lengths of the stretches that are trained on (1: what an assistant
says, with its end mark) and of those that aren't (0: headers, other roles), in order.

``pairs_from_conversations`` makes the pairs where a table has no rejected answers: the rejected conversation is the chosen one
with its last assistant turn replaced by that of the conversation whose id differs in the lowest bit.

Defined results: turns go by turn, then role, then text, nulls first; a null role is written ``unknown`` and a null text is
empty; repeated rows are repeated turns; a turn of a null conversation id is a conversation by itself, which has no partner. A
conversation without an assistant turn, or without a partner that has one, is ``unpaired``: all of it is the prompt and the
completions are null. Where both are equal the pair is ``identical`` and its completions are empty. An empty table gives an
empty result; further columns are ignored. A turn shuffles once with its conversation; nothing is paired within a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"  # fixed values of the chat format


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text, in order)."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.sort_array(F.collect_list(turn))
    # Turns without a conversation, which may be very many, aren't gathered: each is one by itself.
    apart = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    own = turns.select("conv_id", apart.alias("_apart"), "turn", "role", "text")
    return own.groupBy("conv_id", "_apart").agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")).drop("_apart")


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))), "")


def mask(turns: Column) -> Column:
    """``flag:length`` of each stretch, in code points."""

    def of(t):
        head = F.length(t["role"]) + len(OPEN) + 1
        body = F.length(t["text"]) + len(CLOSE)
        said = F.concat(F.lit("0:"), head.cast("string"), F.lit(",1:"), body.cast("string"))
        return F.when(t["role"] == "assistant", said).otherwise(F.concat(F.lit("0:"), (head + body).cast("string")))

    return F.array_join(F.transform(turns, of), ",")


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal."""
    shorter = F.least(F.size(a), F.size(b))
    equal = F.zip_with(F.slice(a, F.lit(1), shorter), F.slice(b, F.lit(1), shorter), lambda x, y: x == y)
    first = F.array_position(equal, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(shorter).cast("int")


def last_assistant(turns: Column) -> Column:
    """1-based place of the last assistant turn; 0 if there is none."""
    back = F.array_position(F.reverse(F.transform(turns, lambda t: t["role"])), F.lit("assistant"))
    return F.when(back > 0, F.size(turns) + 1 - back).otherwise(F.lit(0)).cast("int")


def pairs_from_conversations(convs: DataFrame) -> DataFrame:
    """conv_id, chosen, rejected (null where there is no pair)."""
    own = convs.withColumn("_at", last_assistant(F.col("turns"))).withColumn("_partner", F.col("conv_id").bitwiseXOR(F.lit(1)))
    other = convs.select(F.col("conv_id").alias("_partner"), F.col("turns").alias("_others"), last_assistant(F.col("turns")).alias("_to")).where("_to > 0")
    other = other.select("_partner", F.element_at("_others", F.col("_to")).alias("_answer"))
    rejected = F.transform(F.col("turns"), lambda t, k: F.when(k == F.col("_at") - 1, F.col("_answer")).otherwise(t))
    paired = (F.col("_at") > 0) & F.col("_answer").isNotNull()
    return own.join(other, "_partner", "left").select("conv_id", F.col("turns").alias("chosen"), F.when(paired, rejected).alias("rejected"))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """conv_id, status, prompt_turns, prompt, and completion and mask of the chosen and the rejected conversation."""
    cut = pairs.withColumn("_n", F.coalesce(common_prefix(F.col("chosen"), F.col("rejected")), F.size("chosen")))

    def rest(name):
        return F.slice(F.col(name), F.col("_n") + 1, F.greatest(F.size(name) - F.col("_n"), F.lit(0)))

    def completion(function, name):
        return F.when(F.col("rejected").isNotNull(), function(rest(name)))

    same = (F.col("_n") == F.size("chosen")) & (F.col("_n") == F.size("rejected"))
    return cut.select(
        "conv_id",
        F.when(F.col("rejected").isNull(), "unpaired").when(same, "identical").otherwise("paired").alias("status"),
        F.col("_n").cast("long").alias("prompt_turns"),
        render(F.slice(F.col("chosen"), F.lit(1), F.col("_n"))).alias("prompt"),
        completion(render, "chosen").alias("chosen_completion"),
        completion(mask, "chosen").alias("chosen_mask"),
        completion(render, "rejected").alias("rejected_completion"),
        completion(mask, "rejected").alias("rejected_mask"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return format_pairs(pairs_from_conversations(conversations(table(spark, sf_dir, "conversations"))))


SQL = """
WITH c AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, 'unknown'), text := coalesce(text, '')) ORDER BY turn, role, text) AS turns
  FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS apart FROM conversations) GROUP BY conv_id, apart
), p AS (
  SELECT *, coalesce(list_max([i FOR i IN range(1, len(turns) + 1) IF turns[i].role = 'assistant']), 0) AS at FROM c
), r AS (
  SELECT p.conv_id, p.turns AS chosen,
         CASE WHEN p.at > 0 AND o.at > 0 THEN [CASE WHEN i = p.at THEN o.turns[o.at] ELSE p.turns[i] END FOR i IN range(1, len(p.turns) + 1)] END AS rejected
  FROM p LEFT JOIN p o ON o.conv_id = xor(p.conv_id, 1)
), n AS (
  SELECT *, CASE WHEN rejected IS NULL THEN len(chosen)
                 ELSE coalesce(list_min([i FOR i IN range(1, len(chosen) + 1) IF chosen[i] <> rejected[i]]) - 1, len(chosen)) END AS k
  FROM r
), s AS (
  SELECT conv_id, k, rejected IS NOT NULL AS paired, len(chosen) AS size, chosen[:k] AS head, chosen[k + 1 :] AS a, rejected[k + 1 :] AS b FROM n
)
SELECT conv_id,
  CASE WHEN NOT paired THEN 'unpaired' WHEN k = size THEN 'identical' ELSE 'paired' END AS status,
  k::BIGINT AS prompt_turns,
  coalesce(array_to_string(['<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10) FOR t IN head], ''), '') AS prompt,
  CASE WHEN paired THEN coalesce(array_to_string(['<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10) FOR t IN a], ''), '') END AS chosen_completion,
  CASE WHEN paired THEN coalesce(array_to_string([CASE WHEN t.role = 'assistant' THEN '0:' || (length(t.role) + 13) || ',1:' || (length(t.text) + 11)
    ELSE '0:' || (length(t.role) + length(t.text) + 24) END FOR t IN a], ','), '') END AS chosen_mask,
  CASE WHEN paired THEN coalesce(array_to_string(['<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10) FOR t IN b], ''), '') END AS rejected_completion,
  CASE WHEN paired THEN coalesce(array_to_string([CASE WHEN t.role = 'assistant' THEN '0:' || (length(t.role) + 13) || ',1:' || (length(t.text) + 11)
    ELSE '0:' || (length(t.role) + length(t.text) + 24) END FOR t IN b], ','), '') END AS rejected_mask
FROM s
"""
