"""Conversation history: a window a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.text import has_followup_signal

#: Messages that are stored, turns of a summary, characters of a message in it.
STORED, TURNS, SUMMARY_CHARS = 20, 3, 400


def stored(messages: DataFrame, most: int = STORED) -> DataFrame:
    """messages: conv_id, turn, role, text. The last ones of each conversation; only users and assistants are kept."""
    said = messages.filter(F.col("role").isin("user", "assistant"))
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return said.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= most)


def last_messages(messages: DataFrame, n_turns: int = TURNS) -> DataFrame:
    """conv_id, place (from 1, oldest first), role, text of the last 2 * n_turns stored messages."""
    recent = stored(messages).filter(F.col("back") <= 2 * n_turns)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return recent.select("conv_id", place.alias("place"), "role", "text")


def message_lists(messages: DataFrame, n_turns: int = TURNS) -> DataFrame:
    """conv_id, said: the last messages of each conversation as an array of (role, content), oldest first."""
    rows = last_messages(messages, n_turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "role", F.col("text").alias("content")))).alias("m"))
    return rows.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("said"))


def prompt(system: Column, said: Column, asked: Column) -> Column:
    """What a model gets: a system message, what was said before (null: nothing), the question."""

    def message(role: str, content: Column) -> Column:
        return F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))

    return F.concat(message("system", system), F.coalesce(said, F.array().cast("array<struct<role:string,content:string>>")), message("user", asked))


def summaries(messages: DataFrame, n_turns: int = TURNS, most: int = SUMMARY_CHARS) -> DataFrame:
    """conv_id, summary: the last messages, newest first, cut."""
    recent = stored(messages).filter(F.col("back") <= 2 * n_turns)
    cut = F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit("..."))).otherwise(F.col("text"))
    line = F.concat(F.when(F.col("role") == "user", F.lit("User: ")).otherwise(F.lit("Assistant: ")), cut)
    grouped = recent.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("back", line.alias("line")))).alias("l"))
    return grouped.select("conv_id", F.concat_ws("\n", F.lit("CONVERSATION HISTORY (most recent first):"), F.transform("l", lambda x: x["line"])).alias("summary"))


def followups(messages: DataFrame) -> DataFrame:
    """conv_id, turn, is_followup of each user message: a signal in it, and a message stored before it."""
    said = messages.filter(F.col("role").isin("user", "assistant"))
    before = F.count("*").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    return said.withColumn("before", before).filter("role = 'user'").select("conv_id", "turn", ((F.col("before") > 0) & has_followup_signal("text")).alias("is_followup"))


def exported(messages: DataFrame) -> DataFrame:
    """One JSON text a conversation."""
    rows = stored(messages).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("conversation"))
    return rows.select("conv_id", F.to_json(F.struct(F.current_timestamp().alias("timestamp"), F.col("conv_id").alias("session_id"), F.transform("conversation", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("conversation"))).alias("json"))
