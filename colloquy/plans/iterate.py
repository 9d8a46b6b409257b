"""Bounded retrieval rounds over all unfinished questions at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from colloquy.config import RoundLimits
from colloquy.operators.context import merge_rounds
from colloquy.plans.routes import action_signature, refinement
from colloquy.session import cut_lineage

Execute = Callable[[DataFrame], DataFrame]
Decide = Callable[[DataFrame, int], DataFrame]


def _ids(context: DataFrame, name: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("slot", "node_id"))), lambda e: e["node_id"])
    # Written by itself, so that the merge of the rounds is planned over short rows only.
    return cut_lineage(context.groupBy("query_id").agg(ordered.alias(name)))


def iterate(questions: DataFrame, plans: DataFrame, execute: Execute, decide: Decide, limits: RoundLimits = RoundLimits()) -> DataFrame:
    """``(query_id, rounds, stop_reason, packed, memory_ids, image_ids, by_time)``.

    ``questions(query_id, question, has_image)``; ``plans(query_id, plan)``;
    ``execute`` maps plans to contexts and ``decide`` maps the open questions with
    their packed ids to model outputs.  A round is one job over every open
    question and ends in the shared folder; there is no job per question.
    """
    first = plans.select("query_id", "plan")
    state = (
        questions.join(first, "query_id")
        .join(_ids(execute(first), "c0"), "query_id", "left")
        .withColumn("seen_actions", F.array(action_signature(F.col("plan"))))
        .withColumn("by_time", F.col("plan")["sort_by"] == "time")
        .drop("plan")
    )
    state = cut_lineage(merge_rounds(state, ["c0"], limits.budgets, limits.top_k))
    columns = ["c0"]
    finished = None
    base = ["query_id", "question", "has_image", "seen_actions", "by_time"]

    def close(df: DataFrame, reason, rounds: int, memory_ids, image_ids) -> None:
        nonlocal finished
        rows = df.select("query_id", F.lit(rounds).alias("rounds"), reason.alias("stop_reason"), "packed", memory_ids.alias("memory_ids"), image_ids.alias("image_ids"), "by_time")
        finished = rows if finished is None else finished.unionByName(rows)

    none = F.array().cast("array<string>")
    for number in range(1, limits.max_rounds):
        asked = state.select("query_id", "question", "has_image", "packed")
        answers = refinement(asked.join(decide(asked, number), "query_id")).select("query_id", "sufficient", "stop_reason", "supporting_memory_ids", "supporting_image_ids", "plan")
        told = cut_lineage(state.join(answers, "query_id"))
        close(told.filter("sufficient"), F.col("stop_reason"), number, F.col("supporting_memory_ids"), F.col("supporting_image_ids"))
        going = told.filter("NOT sufficient").withColumn("_action", action_signature(F.col("plan")))
        repeated = F.array_contains("seen_actions", F.col("_action"))
        close(going.filter(F.col("plan").isNull()), F.lit("missing_refinement_plan"), number, none, none)
        close(going.filter(F.col("plan").isNotNull() & repeated), F.lit("duplicate_retrieval_action"), number, none, none)
        fresh = going.filter(F.col("plan").isNotNull() & ~repeated)
        name = f"c{number}"
        grown = (
            fresh.join(_ids(execute(fresh.select("query_id", "plan")), name), "query_id", "left")
            .withColumn("seen_actions", F.concat("seen_actions", F.array("_action")))
            .withColumn("by_time", F.col("by_time") | (F.col("plan")["sort_by"] == "time"))
            .select(*base, *columns, name)
        )
        columns.append(name)
        merged = cut_lineage(merge_rounds(grown, columns, limits.budgets, limits.top_k))
        close(merged.filter(F.col(f"admitted_{number}") == 0), F.lit("no_new_evidence"), number + 1, none, none)
        state = merged.filter(F.col(f"admitted_{number}") > 0)
        if not state.limit(1).count():
            return finished
    close(state, F.lit("max_rounds_reached"), limits.max_rounds, none, none)
    return finished
