"""Preference formatting of chosen and rejected conversations.

Of each pair the longest common prefix of turns (equal role and text) becomes the prompt, rendered once. What
follows in either conversation is its completion, in segments with a mask: 1 for what an assistant says and the end
sign after it, which a loss would count, 0 for headers and all other roles.

Each side is exchanged once, by pair, and its turns stand in one sorted array, as they do in the result; both sides are
joined where they lie. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the template around each turn
HEAD, MIDDLE, TAIL = "<|start|>", "\n", "<|end|>\n"


def _turns(side: DataFrame, name: str) -> DataFrame:
    """Per pair its turns (turn, role, text) in order; of rows that share pair and turn the least (role, text) counts."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = side.where("pair_id is not null and turn is not null").select("pair_id", one.alias("t"))
    listed = rows.groupBy("pair_id").agg(F.sort_array(F.collect_list("t")).alias("_all"))
    first = F.filter("_all", lambda x, i: (i == 0) | (F.get("_all", i - 1)["turn"] != x["turn"]))
    return listed.select("pair_id", first.alias(name))


def _header(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), turn["role"], F.lit(MIDDLE))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(_header(x), x["text"], F.lit(TAIL))), "")


def _spans(turns: Column) -> Column:
    counted = lambda x: F.struct((F.length(x["text"]) + len(TAIL)).alias("length"), (x["role"] == "assistant").cast("int").alias("mask"))
    return F.flatten(F.transform(turns, lambda x: F.array(F.struct(F.length(_header(x)).alias("length"), F.lit(0).alias("mask")), counted(x))))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, chosen_spans, rejected, rejected_spans.

    Both inputs have pair_id, turn, role, text; other columns are not looked at. Turns are compared by their numbers, so a
    number missing on one side ends the prefix. Spans are runs of (length in characters, mask) that cover
    the completion. Pairs with turns on one side only are left out; pairs of equal conversations have
    empty completions. Null roles and texts count as empty, null ids and turns are left out. Of rows that repeat
    a pair and turn the least (role, text) counts.
    """
    both = _turns(chosen, "c").join(_turns(rejected, "r"), "pair_id")
    differs = F.array_position(F.zip_with("c", "r", lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    both = both.withColumn("n", F.when(differs == 0, F.size("c")).otherwise(differs - 1).cast("int"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    cut = both.select("pair_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return cut.select(
        "pair_id", F.col("n").cast("long").alias("n_prompt_turns"), _rendered(F.col("p")).alias("prompt"),
        _rendered(F.col("c")).alias("chosen"), _spans(F.col("c")).alias("chosen_spans"), _rendered(F.col("r")).alias("rejected"), _spans(F.col("r")).alias("rejected_spans"),
    )


def as_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as pairs: each, whole, is chosen; rejected is the same with its last assistant turn's words in reverse order."""
    rows = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(Window.partitionBy("pair_id"))
    worse = rows.withColumn("last", last).withColumn("text", F.when(F.col("turn") == F.col("last"), F.array_join(F.reverse(F.split("text", " ")), " ")).otherwise(F.col("text")))
    return rows, worse.drop("last")


def op2_preference_format(spark, sf_dir: str) -> DataFrame:
    """Digest of the formatted pairs: lengths, counted characters and the texts' checksums."""
    out = format_preferences(*as_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    counted = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["length"] * x["mask"])
    return out.select(
        F.col("pair_id").alias("conv_id"), "n_prompt_turns", F.length("prompt").cast("long").alias("prompt_chars"), F.md5("prompt").alias("prompt_md5"),
        F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"), counted("chosen_spans").alias("chosen_counted"), counted("rejected_spans").alias("rejected_counted"),
    )


OP2_SQL = """
WITH rows_ AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
one AS (SELECT conv_id, turn, min({'role': role, 'text': text}) AS t FROM rows_ WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
base AS (SELECT conv_id, turn, t.role AS role, t.text AS good,
    CASE WHEN turn = max(CASE WHEN t.role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id)
      THEN array_to_string(list_reverse(string_split(t.text, ' ')), ' ') ELSE t.text END AS bad FROM one),
cut AS (SELECT *, min(CASE WHEN good <> bad THEN turn END) OVER (PARTITION BY conv_id) AS first FROM base)
SELECT conv_id,
  CAST(count(*) FILTER (first IS NULL OR turn < first) AS BIGINT) AS n_prompt_turns,
  CAST(length(coalesce(string_agg('<|start|>' || role || chr(10) || good || '<|end|>' || chr(10), '' ORDER BY turn) FILTER (first IS NULL OR turn < first), '')) AS BIGINT) AS prompt_chars,
  md5(coalesce(string_agg('<|start|>' || role || chr(10) || good || '<|end|>' || chr(10), '' ORDER BY turn) FILTER (first IS NULL OR turn < first), '')) AS prompt_md5,
  md5(coalesce(string_agg('<|start|>' || role || chr(10) || good || '<|end|>' || chr(10), '' ORDER BY turn) FILTER (turn >= first), '')) AS chosen_md5,
  md5(coalesce(string_agg('<|start|>' || role || chr(10) || bad || '<|end|>' || chr(10), '' ORDER BY turn) FILTER (turn >= first), '')) AS rejected_md5,
  CAST(coalesce(sum(length(good) + 8) FILTER (turn >= first AND role = 'assistant'), 0) AS BIGINT) AS chosen_counted,
  CAST(coalesce(sum(length(bad) + 8) FILTER (turn >= first AND role = 'assistant'), 0) AS BIGINT) AS rejected_counted
FROM cut GROUP BY conv_id
"""
