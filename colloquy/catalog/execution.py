"""End-to-end plan execution and iterative retrieval over the conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.catalog.provenance import q_items
from colloquy.catalog.registry import query
from colloquy.config import RoundLimits
from colloquy.operators.dense import mean_vectors
from colloquy.plans.executor import Answered, Memory, execute
from colloquy.plans.iterate import iterate
from colloquy.plans.routes import routes_text, unified_contract, validated_plan
from colloquy.session import cut_lineage
from colloquy.sources.encoders import hashed_vectors
from colloquy.sources.tables import facts, turn_vectors, turns


def memory(spark: SparkSession, d: str) -> Memory:
    """Turns and facts are written once: every layer, lookup and round reads them."""
    day = F.format_string("2024-01-%02d", 1 + F.pmod("conv_id", F.lit(5)))
    t = cut_lineage(turns(spark, d).select("ref", "text", "session_id", "ordinal", day.alias("date")))
    f = cut_lineage(facts(spark, d).select("node_id", "text", F.col("session_id").alias("collection_id"), "refer_ids"))
    vectors = hashed_vectors(f, "node_id", "text").join(f.select("node_id", "collection_id"), "node_id")
    sessions = cut_lineage(t.select(F.col("session_id").alias("node_id"), "date").distinct())
    # Every fourth turn shows an image: its caption repeats the turn's start, its vector comes from the vector table.
    shown = F.pmod("ordinal", F.lit(4)) == 0
    captions = t.filter(shown).select("ref", F.concat(F.lit("a picture of "), F.substring("text", 1, 80)).alias("text"))
    images = turn_vectors(spark, d).filter(shown).select("ref", F.col("embedding").cast("array<double>").alias("vec"))
    means = mean_vectors(vectors, "collection_id", "vec").select(F.col("collection_id").alias("node_id"), "vec")
    return Memory(t, f, means, sessions, hashed_vectors, captions, images)


def model_plans(spark: SparkSession, d: str) -> DataFrame:
    """Scripted model outputs: layers, limits and faults vary with the question."""
    m = F.pmod("query_id", F.lit(6))
    body = (
        F.when(m == 0, '{"routes":[{"layer":"collection","retrievers":["dense","bm25"]}],"needs_event_scope":true}')
        .when(m == 1, '{"routes":[{"layer":"raw","retrievers":["bm25"]},{"layer":"fact","retrievers":["dense","image"]},{"layer":"raw","retrievers":["dense"]}]}')
        .when(m == 2, 'Plan: ```json\n{"routes":null,"sort_by":"time","time_range":"2024-01-03"}\n```')
        .when(m == 3, '{"routes":[{"layer":"bogus","retrievers":["dense"]},{"layer":"fact","retrievers":["bm25"]}],"needs_visual_memory":"true","needs_event_scope":true}')
        .when(m == 4, '{"routes":[{"layer":"fact","retrievers":["dense","bm25","caption"]}],"needs_temporal_reasoning":true}')
        .otherwise("no json at all")
    )
    return q_items(spark, d).select("query_id", F.col("text").alias("question"), (m == 1).alias("has_image"), body.alias("model_output"))


@query(
    """SELECT item_id, item_id % 6 <> 5 AS router_parse_ok, CASE item_id % 6 WHEN 0 THEN 'collection:dense+bm25;raw:dense+bm25' WHEN 1 THEN 'raw:bm25+dense+image+caption;fact:dense+bm25'
  WHEN 3 THEN 'fact:bm25+dense;raw:image+caption+dense+bm25' WHEN 4 THEN 'fact:dense+bm25;raw:dense+bm25' ELSE 'raw:dense+bm25' END AS routes,
  CASE WHEN item_id % 6 IN (2, 4) THEN 'time' ELSE 'score' END AS sort_by, CASE WHEN item_id % 6 = 2 THEN '2024-01-03' ELSE '' END AS time_range FROM benchmark"""
)
def plan_validate(spark: SparkSession, d: str) -> DataFrame:
    p = unified_contract(validated_plan(model_plans(spark, d)))
    return p.select(F.col("query_id").alias("item_id"), "router_parse_ok", routes_text(F.col("plan.routes")).alias("routes"), "plan.sort_by", F.coalesce("plan.time_range", F.lit("")).alias("time_range"))


@query()
def executor_context(spark: SparkSession, d: str) -> DataFrame:
    """Packed contexts of all questions under their validated plans."""
    plans = unified_contract(validated_plan(model_plans(spark, d))).select("query_id", "plan")
    return execute(plans, memory(spark, d)).select(F.col("query_id").alias("item_id"), "slot", "node_id")


@query()
def iterative_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Scripted sufficiency decisions over up to three rounds."""
    m = memory(spark, d)
    asked = model_plans(spark, d)
    plans = unified_contract(validated_plan(asked)).select("query_id", "plan")
    questions = asked.select("query_id", "question", "has_image")

    def decide(open_rows: DataFrame, number: int) -> DataFrame:
        case = F.pmod("query_id", F.lit(4))
        more = F.concat(F.lit('{"sufficient":false,"rewritten_query":"round '), F.lit(str(number)), F.lit(' the and with","routes":[{"layer":"fact","retrievers":["bm25"]}]}'))
        text = F.when(case == 0, '{"sufficient":true,"supporting_memory_ids":[]}').when(case == 1, "broken").when(case == 2, more).otherwise(
            more if number == 1 else F.lit('{"sufficient":false,"rewritten_query":"round 1 the and with","routes":[{"layer":"fact","retrievers":["bm25"]}]}')
        )
        return open_rows.select("query_id", text.alias("model_output"))

    answered = Answered()

    def run(p: DataFrame) -> DataFrame:
        return execute(p, m, answered=answered).select("query_id", "slot", "node_id")

    out = iterate(questions, plans, run, decide, RoundLimits(3, (20, 6, 4), 20))
    return out.select(F.col("query_id").alias("item_id"), "rounds", "stop_reason", F.size("packed").alias("n_packed"))
