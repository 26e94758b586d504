"""Training corpora from demonstrations and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chat_raw(turns: DataFrame, by: str = "conv_id", open_turn: bool = False) -> DataFrame:
    """by, chat: role-framed turns in order, without separators, optionally with an open assistant turn."""
    framed = F.concat(F.lit("<|"), F.col("role"), F.lit("|>"), F.coalesce("text", F.lit("")))
    chat = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", framed.alias("x")))), lambda s: s["x"]), "")
    out = turns.groupBy(by).agg(chat.alias("chat"))
    return out.withColumn("chat", F.concat("chat", F.lit("<|assistant|>"))) if open_turn else out


def merge_roles(turns: DataFrame, by: str = "conv_id", separator: str = "\n") -> DataFrame:
    """Neighbouring turns of one role become one: by, turn (from 0), role, text."""
    order = Window.partitionBy(by).orderBy("turn")
    marked = turns.withColumn("new_", F.coalesce((F.lag("role").over(order) != F.col("role")).cast("int"), F.lit(1)))
    numbered = marked.withColumn("island_", F.sum("new_").over(order) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda s: s["text"]), separator)
    return numbered.groupBy(by, F.col("island_").alias("turn"), "role").agg(text.alias("text"))


def exchanges(turns: DataFrame, by: str = "conv_id") -> DataFrame:
    """by, index, input, output: each user turn with the assistant turn right after it."""
    order = Window.partitionBy(by).orderBy("turn")
    nxt = turns.withColumn("next_role", F.lead("role").over(order)).withColumn("next_text", F.lead("text").over(order))
    pairs = nxt.where("role = 'user' and next_role = 'assistant'")
    return pairs.select(by, (F.row_number().over(order) - 1).alias("index"), F.col("text").alias("input"), F.col("next_text").alias("output"))


def leave_one_out(pairs: DataFrame, by: str = "conv_id") -> DataFrame:
    """by, held, index, input, output: every pair with all other pairs of its task as context. Stays within a task."""
    held = pairs.select(F.col(by), F.col("index").alias("held"))
    return held.join(pairs, by).where("held <> index")


def demonstration_turns(pairs: DataFrame, by: str = "conv_id", include_demos: bool = True) -> DataFrame:
    """by, held, turn, role, text: the other pairs as user and assistant turns, then the held pair's input as the query."""
    demos = leave_one_out(pairs, by)
    place = F.row_number().over(Window.partitionBy(by, "held").orderBy("index")) - 1
    demos = demos.withColumn("n", place)
    asked = demos.select(by, "held", (2 * F.col("n")).alias("turn"), F.lit("user").alias("role"), F.col("input").alias("text"))
    told = demos.select(by, "held", (2 * F.col("n") + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("output").alias("text"))
    count = pairs.groupBy(by).agg((2 * (F.count(F.lit(1)) - 1)).cast("int").alias("last_"))
    query = pairs.join(count, by).select(by, F.col("index").alias("held"), (F.col("last_") if include_demos else F.lit(0)).alias("turn"), F.lit("user").alias("role"), F.col("input").alias("text"))
    return asked.union(told).union(query) if include_demos else query


def document_pairs(pairs: DataFrame, by: str = "conv_id") -> DataFrame:
    """by, index, turn, role, text: each pair alone, as two turns."""
    turn = lambda n, role, text: F.struct(F.lit(n).alias("turn"), F.lit(role).alias("role"), F.col(text).alias("text"))
    two = F.inline(F.array(turn(0, "user", "input"), turn(1, "assistant", "output")))
    return pairs.select(by, "index", two)


def ocr_lines(rows: DataFrame, lines: str = "valid_line") -> DataFrame:
    """``rows`` with text: the words of each line joined by a space, empty lines dropped, one to a line."""
    joined = F.transform(F.col(lines), lambda x: F.trim(F.array_join(F.transform(x["words"], lambda w: w["text"]), " ")))
    return rows.withColumn("text", F.array_join(F.filter(joined, lambda x: x != ""), "\n"))
