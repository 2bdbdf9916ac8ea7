"""Preference pairs of conversations, as chat text.

The longest common prefix of turns of a chosen and a rejected conversation is rendered once, as the prompt; the turns
after it are the two completions. A mask gives the character spans of a completion that are learned from: what the
assistant says, with the end of its turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
LEARNED = "assistant"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns): an array of (role, text) in order of turn; a null role is "user" and a null text empty.

    Turns of equal number are ordered by role, then text; null numbers come first. A conversation is one value, which
    a task holds as a whole; rows without an identifier are conversations of one turn each.
    """
    one = F.struct(F.col(turn_col).alias("n"), F.coalesce(F.col(role_col), F.lit("user")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    alone = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    return turns.groupBy(F.col(id_col).alias("id"), alone.alias("alone")).agg(F.transform(F.sort_array(F.collect_list(one)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")).drop("alone")


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def mask(turns: Column) -> Column:
    """Array of (start, end) of the learned characters of rendered(turns). The work grows with the square of the number of
    turns, each of which is three numbers here."""

    def span(t: Column, upto: Column) -> Column:
        head = F.length(t["role"]) + len(OPEN) + len(MIDDLE)
        return F.struct((upto + head).alias("start"), (upto + head + F.length(t["text"]) + len(CLOSE)).alias("end"), (t["role"] == LEARNED).alias("learned"))

    zero = F.array().cast("array<struct<start:int,end:int,learned:boolean>>")
    spans = F.aggregate(turns, zero, lambda got, t: F.concat(got, F.array(span(t, F.coalesce(F.try_element_at(got, F.lit(-1))["end"], F.lit(0))))))
    return F.transform(F.filter(spans, lambda s: s["learned"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def preference_pairs(pairs: DataFrame, chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """`pairs`, whose two columns are arrays of (role, text), with prefix_turns, prompt, chosen_text, rejected_text,
    chosen_mask and rejected_mask.

    A null array has no turns. If one conversation is the start of the other, its completion is empty.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    chosen, rejected = (F.coalesce(F.col(c), empty) for c in (chosen_col, rejected_col))
    shorter = F.least(F.size(chosen), F.size(rejected))
    same = F.zip_with(F.slice(chosen, 1, shorter), F.slice(rejected, 1, shorter), lambda a, b: a == b)
    differ = F.array_position(same, False)
    with_prefix = pairs.withColumn("prefix_turns", F.when(differ > 0, differ - 1).otherwise(shorter).cast("int"))
    at = F.col("prefix_turns")
    rest = lambda a: F.slice(a, at + 1, F.greatest(F.size(a) - at, F.lit(0)))
    return (
        with_prefix.withColumn("prompt", rendered(F.slice(chosen, F.lit(1), at)))
        .withColumn("chosen_text", rendered(rest(chosen))).withColumn("rejected_text", rendered(rest(rejected)))
        .withColumn("chosen_mask", mask(rest(chosen))).withColumn("rejected_mask", mask(rest(rejected)))
    )


def own_negatives(convs: DataFrame) -> DataFrame:
    """Pairs from single conversations: chosen is the conversation up to its last answer. In rejected, that answer is
    an earlier one of the same conversation (the latest that differs), or else it repeats the turn before it.
    A conversation without answers is its own pair; so is one of a single turn."""
    answers = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at(F.col("turns"), i)["role"] == LEARNED)
    last = F.coalesce(F.array_max(answers), F.size("turns"))
    place = free_name("_last", convs.columns)
    cut = convs.withColumn(place, last).withColumn("chosen", F.slice("turns", F.lit(1), F.col(place)))
    final = F.element_at(F.col("chosen"), -1)
    before = F.slice("chosen", F.lit(1), F.col(place) - 1)
    earlier = F.filter(before, lambda t: (t["role"] == LEARNED) & (t["text"] != final["text"]))
    other = F.coalesce(F.try_element_at(earlier, F.lit(-1))["text"], F.try_element_at(before, F.lit(-1))["text"])
    swapped = F.concat(before, F.array(F.struct(final["role"].alias("role"), F.coalesce(other, final["text"]).alias("text"))))
    return cut.withColumn("rejected", F.when(final["role"] == LEARNED, swapped).otherwise(F.col("chosen"))).drop(place, "turns")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference_pairs(own_negatives(conversations(table(spark, sf_dir, "conversations"))))
    masked = lambda c: F.aggregate(c, F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("long")
    return pairs.select(
        F.col("id").alias("conv_id"), "prefix_turns", F.length("prompt").cast("long").alias("prompt_chars"), F.sha2("prompt", 256).alias("prompt_sha256"), F.sha2("chosen_text", 256).alias("chosen_sha256"), F.sha2("rejected_text", 256).alias("rejected_sha256"),
        masked("chosen_mask").alias("chosen_masked"), masked("rejected_mask").alias("rejected_masked"),
    )


OP9_SQL = r"""
WITH c AS MATERIALIZED (SELECT *, coalesce(conv_id::VARCHAR, 'null ' || row_number() OVER ()) AS cid FROM conversations),
t AS (
  SELECT cid, conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS i
  FROM c),
ends AS (SELECT cid, coalesce(max(i) FILTER (WHERE role = 'assistant'), max(i)) AS last, bool_or(role = 'assistant') AS answered FROM t GROUP BY cid),
cut AS (SELECT t.*, e.last, e.answered FROM t JOIN ends e ON t.cid = e.cid WHERE i <= last),
final AS (SELECT cid, conv_id, role, text, last, answered FROM cut WHERE i = last),
other AS (
  SELECT c.cid, arg_max(c.text, c.i) FILTER (WHERE c.role = 'assistant' AND c.text <> f.text) AS earlier, arg_max(c.text, c.i) AS before
  FROM cut c JOIN final f ON c.cid = f.cid WHERE c.i < c.last GROUP BY c.cid),
ends2 AS (
  SELECT f.cid, f.conv_id, f.role, f.text, f.last, CASE WHEN f.answered THEN coalesce(o.earlier, o.before, f.text) ELSE f.text END AS rejected
  FROM final f LEFT JOIN other o ON f.cid = o.cid),
prompts AS (
  SELECT c.cid, coalesce(string_agg('<|' || c.role || '|>' || chr(10) || c.text || '<|end|>' || chr(10), '' ORDER BY c.i) FILTER (WHERE c.i < e.last OR e.text = e.rejected), '') AS prompt
  FROM cut c JOIN ends2 e ON c.cid = e.cid GROUP BY c.cid)
SELECT e.conv_id, (CASE WHEN e.text = e.rejected THEN e.last ELSE e.last - 1 END)::INTEGER AS prefix_turns, length(prompt)::BIGINT AS prompt_chars, sha256(prompt) AS prompt_sha256,
       sha256(CASE WHEN e.text = e.rejected THEN '' ELSE '<|' || e.role || '|>' || chr(10) || e.text || '<|end|>' || chr(10) END) AS chosen_sha256,
       sha256(CASE WHEN e.text = e.rejected THEN '' ELSE '<|' || e.role || '|>' || chr(10) || e.rejected || '<|end|>' || chr(10) END) AS rejected_sha256,
       CASE WHEN e.text = e.rejected THEN 0 ELSE length(e.text) + 8 END::BIGINT AS chosen_masked,
       CASE WHEN e.text = e.rejected THEN 0 ELSE length(e.rejected) + 8 END::BIGINT AS rejected_masked
FROM ends2 e JOIN prompts p ON e.cid = p.cid
"""
