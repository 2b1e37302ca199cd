"""Preference pairs from chosen and rejected conversations.

The longest common prefix of turns (role and text alike) of a pair is rendered once as the prompt;
what follows on either side becomes its completion, with the character spans that a loss may see:
the assistant's text and the marker that closes it.

Turns are ordered by number, then role, then text (nulls last), so repeated numbers have a fixed
order.  A null role reads ``user``, a null text is empty; markers inside a text get a blank and so
stay text.  Rows without conversation id belong to none.  A pair that lacks one side keeps the
other: no shared turns, an empty prompt, a null completion for the missing side.  Conversations
that are equal, or one of which begins the other, leave an empty completion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightdesk.llm.registry import query, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: the ordered turns of each conversation as one row."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    turn = F.struct(F.col("turn").isNull(), "turn", F.coalesce("role", F.lit("user")).alias("role"), text.alias("text"))
    held = turns.where("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv_id"))
    ordered = F.array_sort(F.collect_list(turn))
    return held.agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _rendered(turn):
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"), turn["text"], F.lit(CLOSE))


def _text(turns):
    return F.array_join(F.transform(turns, _rendered), "")


def _spans(turns):
    """``start, length`` of the assistant's text and closing marker, in characters of the rendered turns."""
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<struct<start: bigint, length: bigint>>")

    def step(acc, turn):
        head = F.length(turn["role"]) + len(OPEN) + 1
        size = F.length(turn["text"]) + len(CLOSE)
        span = F.struct((acc["at"] + head).cast("long").alias("start"), size.cast("long").alias("length"))
        kept = F.when(turn["role"] == "assistant", F.array_append(acc["out"], span)).otherwise(acc["out"])
        return F.struct((acc["at"] + head + size).cast("long").alias("at"), kept.alias("out"))

    return F.aggregate(turns, F.struct(zero.alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def preference_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per pair of ``pairs`` (pair_id, chosen_id, rejected_id), built from ``turns``."""
    held = conversations(turns)
    sides = [held.select(F.col("conv_id").alias(f"{s}_id"), F.col("turns").alias(f"{s}_turns")) for s in ("chosen", "rejected")]
    both = pairs.select("pair_id", "chosen_id", "rejected_id").join(sides[0], "chosen_id", "left").join(sides[1], "rejected_id", "left")
    shorter = F.least(F.coalesce(F.size("chosen_turns"), F.lit(0)), F.coalesce(F.size("rejected_turns"), F.lit(0)))
    one = F.lit(1)
    apart = F.filter(
        F.when(shorter > 0, F.sequence(one, shorter)).otherwise(F.array().cast("array<int>")),
        lambda n: F.element_at("chosen_turns", n) != F.element_at("rejected_turns", n),
    )
    both = both.withColumn("shared", F.when(F.size(apart) > 0, apart[0] - 1).otherwise(shorter))
    rest = {s: F.slice(f"{s}_turns", F.col("shared") + 1, F.greatest(F.size(f"{s}_turns"), one)) for s in ("chosen", "rejected")}
    return both.select(
        "pair_id", "chosen_id", "rejected_id",
        F.col("shared").cast("long").alias("shared_turns"),
        F.coalesce(_text(F.slice("chosen_turns", 1, F.col("shared"))), F.lit("")).alias("prompt"),
        _text(rest["chosen"]).alias("chosen"),
        _text(rest["rejected"]).alias("rejected"),
        _spans(rest["chosen"]).alias("chosen_spans"),
        _spans(rest["rejected"]).alias("rejected_spans"),
    )


def neighbours(turns: DataFrame) -> DataFrame:
    """Pairs by id: conversation 2k is the chosen one, 2k + 1 the rejected one."""
    ids = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("id")).distinct()
    pick = lambda odd: F.max(F.when(F.pmod("id", F.lit(2)) == odd, F.col("id")))
    return ids.groupBy(F.floor(F.col("id") / 2).alias("pair_id")).agg(pick(0).alias("chosen_id"), pick(1).alias("rejected_id"))


SIDE = """array_to_string(list_transform({a}, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '')"""
SPANS = """array_to_string(list_transform(list_filter(range(1, len({a}) + 1), lambda i: {a}[i].role = 'assistant'), lambda i:
  (coalesce(list_sum(list_transform({a}[1 : i - 1], lambda x: 24 + length(x.role) + length(x.text))), 0)::BIGINT + 13 + length({a}[i].role))::VARCHAR
  || '+' || (length({a}[i].text) + 11)::VARCHAR), ',')"""


@query(
    "op2_preference_format",
    f"""
WITH t AS (
  SELECT conv_id, list({{'role': coalesce(role, 'user'), 'text': replace(coalesce(text, ''), '<|im_', '<| im_')}} ORDER BY turn, role, text) AS a
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), p AS (
  SELECT coalesce(c.conv_id, r.conv_id - 1) // 2 AS pair_id, c.conv_id AS chosen_id, r.conv_id AS rejected_id, c.a AS ca, r.a AS ra,
    least(coalesce(len(c.a), 0), coalesce(len(r.a), 0)) AS short
  FROM (FROM t WHERE conv_id % 2 = 0) c FULL JOIN (FROM t WHERE conv_id % 2 = 1) r ON r.conv_id = c.conv_id + 1
), n AS (
  SELECT *, coalesce(list_min(list_filter(range(1, short + 1), lambda i: ca[i] <> ra[i])) - 1, short)::BIGINT AS shared_turns FROM p
), s AS (
  SELECT *, ca[1 : shared_turns] AS pa, ca[shared_turns + 1 :] AS xa, ra[shared_turns + 1 :] AS ya FROM n
)
SELECT pair_id, chosen_id, rejected_id, shared_turns, coalesce({SIDE.format(a="pa")}, '') AS prompt, {SIDE.format(a="xa")} AS chosen,
  {SIDE.format(a="ya")} AS rejected, {SPANS.format(a="xa")} AS chosen_spans, {SPANS.format(a="ya")} AS rejected_spans FROM s
""",
)
def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = preference_pairs(turns, neighbours(turns))
    written_out = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("+", s["start"].cast("string"), s["length"].cast("string"))), ",")
    return found.withColumns({c: written_out(c) for c in ("chosen_spans", "rejected_spans")})
