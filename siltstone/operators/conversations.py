"""Conversations: pairs, recent rounds, tasks, reports and questions with answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

# All functions take messages(session_id, turn, role, content).


def first_messages(messages: DataFrame, role: str | None = None) -> DataFrame:
    """The first message of each session, of one role or of each role."""
    own = messages.where(F.col("role") == role) if role else messages
    n = F.row_number().over(W.partitionBy("session_id", "role").orderBy("turn"))
    return own.withColumn("n", n).where("n = 1").select("session_id", "role", "turn", "content")


def question_answers(messages: DataFrame) -> DataFrame:
    """Each assistant turn with the last user turn before it that no other assistant turn took."""
    w = W.partitionBy("session_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w)
    answered = F.last(F.when(F.col("role") == "assistant", F.col("turn")), ignorenulls=True).over(w)
    text = F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(w)
    rows = messages.select("*", asked.alias("question_turn"), answered.alias("previous_answer"), text.alias("question"))
    fresh = F.col("previous_answer").isNull() | (F.col("previous_answer") < F.col("question_turn"))
    rows = rows.where((F.col("role") == "assistant") & F.col("question_turn").isNotNull() & fresh)
    return rows.select("session_id", "question_turn", F.col("turn").alias("answer_turn"), "question", F.col("content").alias("answer"))


def recent_rounds(messages: DataFrame, rounds: int) -> DataFrame:
    """Messages from the rounds-th last user turn on; whole sessions with fewer rounds."""
    later = W.partitionBy("session_id").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, -1)
    after = F.coalesce(F.sum((F.col("role") == "user").cast("int")).over(later), F.lit(0))
    return messages.withColumn("after", after).where(F.col("after") < rounds).drop("after")


def answer_sentences(messages: DataFrame) -> DataFrame:
    """(session_id, turn, pos, sentence) of assistant turns."""
    own = messages.where("role = 'assistant'")
    return own.select("session_id", "turn", F.posexplode(T.sentences("content")).alias("pos", "sentence"))


def tasks(messages: DataFrame, limit: int) -> DataFrame:
    """Actionable sentences of assistant turns as tasks, the first of equal titles, at most ``limit`` a session."""
    rows = answer_sentences(messages).where(T.is_actionable("sentence"))
    rows = rows.select("session_id", "turn", "pos", T.task_title("sentence").alias("title"), T.shorten("sentence", 400).alias("description"), T.priority("sentence").alias("priority"))
    same = W.partitionBy("session_id", F.lower("title")).orderBy("turn", "pos")
    rows = rows.withColumn("n", F.row_number().over(same)).where("n = 1").drop("n")
    return rows.withColumn("task_no", F.row_number().over(W.partitionBy("session_id").orderBy("turn", "pos"))).where(F.col("task_no") <= limit).drop("pos")


def risks(messages: DataFrame, limit: int) -> DataFrame:
    rows = answer_sentences(messages).where(T.is_risk("sentence"))
    return rows.withColumn("n", F.row_number().over(W.partitionBy("session_id").orderBy("turn", "pos"))).where(F.col("n") <= limit).select("session_id", "n", T.shorten("sentence", 220).alias("risk"))


def report(messages: DataFrame, plan: int = 8) -> DataFrame:
    """Per session: user turns, answers, risk sentences, and the next plan ("[priority] title", distinct, first ``plan``)."""
    counts = messages.groupBy("session_id").agg(F.count(F.when(F.col("role") == "user", 1)).alias("n_questions"), F.count(F.when(F.col("role") == "assistant", 1)).alias("n_answers"))
    risk = answer_sentences(messages).where(T.is_risk("sentence")).groupBy("session_id").agg(F.count("*").alias("n_risks"))
    todo = tasks(messages, plan).withColumn("line", F.concat(F.lit("["), "priority", F.lit("] "), "title"))
    lines = todo.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("task_no", "line"))), lambda x: x.line), "\n").alias("next_plan"))
    return counts.join(risk, "session_id", "left").join(lines, "session_id", "left").select("session_id", "n_questions", "n_answers", F.coalesce("n_risks", F.lit(0)).alias("n_risks"), F.coalesce("next_plan", F.lit("")).alias("next_plan"))
