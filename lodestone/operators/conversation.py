"""Questions in conversations: what is asked, in which language, with which history."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lodestone.functions import text as tx


def _by_turn() -> WindowSpec:
    return Window.partitionBy("conv_id").orderBy("turn")


def effective_questions(turns: DataFrame, short: int = 15) -> DataFrame:
    """Each user turn with the question it asks: conv_id, turn, question, search_text, kind.

    A question shorter than ``short`` goes with the user's question before it: as a 'choice' if
    the assistant's last reply ended with a question mark, else as a 'follow_up'."""
    said = lambda role: F.last(F.when(F.col("role") == role, F.col("text")), ignorenulls=True).over(_by_turn().rowsBetween(Window.unboundedPreceding, -1))
    rows = turns.withColumn("previous", said("user")).withColumn("reply", said("assistant")).filter("role = 'user'")
    last = tx.strip(F.coalesce("text", F.lit("")))
    joined = (F.length(last) < short) & F.col("previous").isNotNull()
    choice = F.coalesce(tx.strip(F.col("reply")).endswith("?"), F.lit(False))
    return rows.select(
        "conv_id",
        "turn",
        last.alias("question"),
        F.when(joined, F.concat("previous", F.lit("\n"), last)).otherwise(last).alias("search_text"),
        F.when(~joined, "question").when(choice, "choice").otherwise("follow_up").alias("kind"),
    )


def with_history(turns: DataFrame, messages: int = 6) -> DataFrame:
    """Each user turn with the ``messages`` turns before it, in order, as one text."""
    window = _by_turn().rowsBetween(-messages, -1)
    history = F.collect_list(F.concat_ws(": ", F.col("role"), F.coalesce("text", F.lit("")))).over(window)
    return turns.withColumn("history", history).filter("role = 'user'").select("conv_id", "turn", F.size("history").alias("n_history"), F.array_join("history", "\n").alias("history"))


def question_languages(turns: DataFrame, default: str = "ko") -> DataFrame:
    """The language of each user turn; one that tells none has that of the last that did."""
    found = tx.language(F.coalesce("text", F.lit("")))
    own = Window.partitionBy("conv_id").orderBy("turn")
    users = turns.filter("role = 'user'").withColumn("found", found)
    return users.select("conv_id", "turn", F.coalesce(F.last("found", ignorenulls=True).over(own), F.lit(default)).alias("language"))


def request_problems(turns: DataFrame, most: int = 20, longest: int = 4000, question: int = 1000) -> DataFrame:
    """(conv_id, problem) of conversations that are no valid request: too many turns, a role
    that is unknown, a text that is empty or too long, a last turn that is not a user's."""
    last = F.max_by(F.struct("role", F.length("text").alias("n")), "turn")
    own = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(~F.coalesce(F.col("role").isin("user", "assistant", "system"), F.lit(False))).alias("role"),
        F.bool_or(F.coalesce(F.length("text"), F.lit(0)) == 0).alias("empty"),
        F.bool_or(F.coalesce(F.length("text"), F.lit(0)) > longest).alias("long"),
        last.alias("last"),
    )
    problem = (
        F.when(F.col("n") > most, "too many turns").when(F.col("role"), "unknown role").when(F.col("empty"), "empty text").when(F.col("long"), "text too long")
        .when(F.coalesce(F.col("last.role") != "user", F.lit(True)), "last turn is not the user's").when(F.col("last.n") > question, "question too long")
    )
    return own.select("conv_id", problem.alias("problem")).filter("problem is not null")


def reclassified(answer_type: Column, answer: Column, n_cited: Column, no_evidence: str, notes: Mapping[str, Column], short: int = 200) -> Column:
    """(answer_type, answer) after an answer is complete: a short one that says there is nothing to go by, and cites
    nothing, is 'unknown'; to others the ``notes`` (text -> condition) whose condition holds are added."""
    nothing = (answer_type == "answer") & (F.length(answer) <= short) & answer.rlike(no_evidence) & (n_cited == 0)
    kind = F.when(nothing, "unknown").otherwise(answer_type)
    added = F.filter(F.array(*(F.when(c, F.lit(note)) for note, c in notes.items())), lambda x: x.isNotNull())
    told = F.when((kind == "answer") & (F.size(added) > 0), F.concat(answer, F.lit("\n\n"), F.array_join(added, "\n"))).otherwise(answer)
    return F.struct(kind.alias("answer_type"), told.alias("answer"))


def backend_route(error: Column, answer: Column, fallback: str) -> Column:
    """(route, answer) by how a model's call ended: without an error as it is; after a transport error a fixed text with
    the route 'unavailable'; any other error, such as a wrong setting, stops the job."""
    transport = error.isin("timeout", "refused", "reset", "unreachable")
    other = F.raise_error(F.concat(F.lit("model call failed: "), error))
    route = F.when(error.isNull(), "answer").when(transport, "unavailable").otherwise(other)
    return F.struct(route.alias("route"), F.when(error.isNull(), answer).otherwise(fallback).alias("answer"))
