"""Chat formatting of preference pairs (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm._common import id_hash

ASSISTANT = "assistant"
#: Conversations (about) among which a rejected reply is looked for, and turn numbers to one row of a formatted pair.
BUCKET_ROWS, BLOCK_TURNS = 256, 64


def render(role: Column, text: Column) -> Column:
    """One turn in the chat template."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def with_negative_replies(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Preference pairs from conversations without ratings: (pair_id, side, turn, role, text).

    The chosen side is the conversation as it is. The rejected side ends with another conversation's last reply in place of its own: that
    of the next conversation with a reply, by id, in the same hash bucket; after the last one comes the first. The buckets hold about
    ``bucket_rows`` conversations, however many there are. A conversation that is alone in its bucket or has no assistant turn is the same on both
    sides. Rows without conversation id are left out; of several last replies with one turn number the greatest text counts.
    """
    t = turns.select(F.col(conv_col).alias("pair_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).where("pair_id is not null")
    replies = t.where((F.col("role") == ASSISTANT) & F.col("turn").isNotNull())
    last = replies.groupBy("pair_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    buckets = 1 + replies.select("pair_id").distinct().count() // bucket_rows
    by_id = W.partitionBy(F.floor(id_hash(F.col("pair_id")) * buckets / F.lit(2147483648))).orderBy("pair_id")
    reply = F.coalesce(F.lead("last.text").over(by_id), F.first("last.text").over(by_id))
    ends = last.select("pair_id", F.col("last.turn").alias("last_turn"), reply.alias("reply"))
    both = t.join(ends, "pair_id", "left").withColumn("side", F.explode(F.array(F.lit("chosen"), F.lit("rejected"))))
    replaced = (F.col("side") == "rejected") & (F.col("turn") == F.col("last_turn"))
    kept = (F.col("side") == "chosen") | F.coalesce(F.col("turn") <= F.col("last_turn"), F.lit(True))
    return both.where(kept).select("pair_id", "side", "turn", F.when(replaced, F.lit(ASSISTANT)).otherwise(F.col("role")).alias("role"), F.when(replaced, F.col("reply")).otherwise(F.col("text")).alias("text"))


def format_pairs(pairs: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Rendered preference pairs: (pair_id, block, prompt, chosen, rejected, chosen_mask, rejected_mask).

    ``pairs`` has (pair_id, side, turn, role, text): the turns of the chosen and the rejected conversation of each pair. Turns
    at which both conversations agree in role and text, from the first one on, are the prompt and are rendered once; what follows is the completion
    of either side. A mask lists the rendered turns of its completion as ``length:trained`` with commas between: so many characters, and 1
    for assistant turns, on which a loss is taken, or 0. The prompt is never trained.

    A row holds ``block_turns`` turn numbers of a pair, so a conversation of any length is never gathered in one row: block n has the turns from
    n * block_turns on; ordered by block, the texts of a pair follow each other. Most pairs have block 0 alone.

    A pair whose other side is missing has an empty prompt. Rows with null pair or side are left out; a null turn number comes
    first (block -1) and never agrees; null roles and texts are empty, and equal each other. Rows that repeat a turn of one side wholly count once; several different rows
    of one turn agree if both sides have the same ones. Rows of one turn are in order of role and text. Extra columns don't pass; no pairs give no rows.
    """
    t = pairs.select("pair_id", "side", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected"))
    rows = t.groupBy("pair_id", "turn", "role", "text").agg(F.max(F.col("side") == "chosen").alias("c"), F.max(F.col("side") == "rejected").alias("r"))
    agree = F.col("turn").isNotNull() & F.col("c") & F.col("r")
    first = rows.groupBy("pair_id").agg(F.min(F.when(~agree, F.coalesce(F.col("turn"), F.lit(-(2**62))))).alias("breaks_at"))
    prompt = F.col("turn").isNotNull() & (F.col("breaks_at").isNull() | (F.col("turn") < F.col("breaks_at")))
    out = rows.join(first, "pair_id").withColumn("prompt", prompt).withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-1)))
    turn = F.struct(F.coalesce("turn", F.lit(-(2**62))).alias("turn"), "role", "text", render(F.col("role"), F.col("text")).alias("shown"))
    own = lambda side: F.array_sort(F.collect_list(F.when(~F.col("prompt") & F.col(side), turn)))
    out = out.groupBy("pair_id", "block").agg(F.array_sort(F.collect_list(F.when(F.col("prompt"), turn))).alias("p"), own("c").alias("c"), own("r").alias("r"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x["shown"]), "")
    mask = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.length(x["shown"]).cast("string"), F.lit(":"), F.when(x["role"] == ASSISTANT, "1").otherwise("0"))), ",")
    return out.select("pair_id", F.col("block").cast("long").alias("block"), text("p").alias("prompt"), text("c").alias("chosen"), text("r").alias("rejected"), mask("c").alias("chosen_mask"), mask("r").alias("rejected_mask"))


_SHOWN = "'<|' || role || '|>' || chr(10) || text || chr(10)"


def _joined(value: str, mark: str, of: str) -> str:
    return f"coalesce(string_agg({value}, '{mark}' ORDER BY turn NULLS FIRST, role, text) FILTER ({of}), '')"


#: The same in DuckDB SQL, for op2's pairs.
ORACLE = f"""
WITH b AS (SELECT * FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(turn) AS last_turn, arg_max(coalesce(text, ''), (turn, coalesce(text, ''))) AS reply FROM b WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY conv_id),
k AS (SELECT *, (((((conv_id % 2147483648) + 2147483648) % 2147483648) * 1103515245 + 12345) % 2147483648 * (1 + (SELECT count(*) FROM l) // {BUCKET_ROWS})) // 2147483648 AS bucket FROM l),
n AS (SELECT conv_id, last_turn, coalesce(lead(reply) OVER w, first_value(reply) OVER w) AS reply FROM k WINDOW w AS (PARTITION BY bucket ORDER BY conv_id)),
t AS (SELECT conv_id AS pair_id, 'chosen' AS side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM b
  UNION ALL SELECT b.conv_id, 'rejected', turn, CASE WHEN b.turn = n.last_turn THEN 'assistant' ELSE coalesce(role, '') END, CASE WHEN b.turn = n.last_turn THEN n.reply ELSE coalesce(text, '') END
  FROM b LEFT JOIN n ON b.conv_id = n.conv_id WHERE coalesce(b.turn <= n.last_turn, TRUE)),
a AS (SELECT pair_id, turn, role, text, bool_or(side = 'chosen') AS c, bool_or(side = 'rejected') AS r FROM t GROUP BY ALL),
f AS (SELECT pair_id, min(coalesce(turn, -4611686018427387904)) FILTER (turn IS NULL OR NOT (c AND r)) AS breaks_at FROM a GROUP BY pair_id),
o AS (SELECT a.*, turn IS NOT NULL AND (breaks_at IS NULL OR turn < breaks_at) AS prompt, coalesce(CAST(floor(turn / {BLOCK_TURNS}) AS BIGINT), -1) AS block FROM a JOIN f USING (pair_id))
SELECT pair_id, block, {_joined(_SHOWN, "", "prompt")} AS prompt, {_joined(_SHOWN, "", "NOT prompt AND c")} AS chosen, {_joined(_SHOWN, "", "NOT prompt AND r")} AS rejected,
  {_joined(f"length({_SHOWN}) || ':' || CASE WHEN role = 'assistant' THEN '1' ELSE '0' END", ",", "NOT prompt AND c")} AS chosen_mask,
  {_joined(f"length({_SHOWN}) || ':' || CASE WHEN role = 'assistant' THEN '1' ELSE '0' END", ",", "NOT prompt AND r")} AS rejected_mask
FROM o GROUP BY pair_id, block
"""
