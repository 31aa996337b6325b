"""The whole evaluation: segmented problems to generations, step scores, cases and a summary."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.config import EvaluationConfig
from quillmark.functions import text as T
from quillmark.operators import align as A
from quillmark.operators import models as M
from quillmark.operators import scoring as W


@dataclass(frozen=True)
class Evaluation:
    steps: DataFrame  # id, index, num_steps, score, hallucination, step_score
    cases: DataFrame  # one record per case, with its steps as an array
    generations: DataFrame  # id, difficulty, gen_output, steps, final_total_score
    summary: DataFrame  # num, avg_score


def generate_steps(problems: DataFrame, generate: Callable[[Column], Column]) -> DataFrame:
    """(id, index, num_steps, reference, next_reference, generated) for every segment.

    The prompt of step i is the problem and the reference segments up to i, so
    all steps of all cases are independent and run as batches of one column.
    """
    rows = problems.select("id", "problem", F.size("segments").alias("num_steps"), F.posexplode("segments").alias("pos", "s"))
    rows = rows.select("id", "problem", "num_steps", (F.col("pos") + 1).alias("index"), F.col("s.content").alias("reference"))
    rows = W.next_step(W.prefixes(rows, "id", "index", "reference"), "id", "index", "reference", "next_reference")
    prompt = M.continue_prompt(F.col("problem"), F.col("prefix"))
    return rows.select("id", "index", "num_steps", "reference", "next_reference", T.truncate_at_sentinel(generate(prompt)).alias("generated"))


def evaluate(problems: DataFrame, generate: Callable[[Column], Column], scorer: M.Scorer = M.jaccard_scorer, c: EvaluationConfig = EvaluationConfig(), store: Callable[[DataFrame], DataFrame] = lambda d: d) -> Evaluation:
    """Evaluate ``problems(id, problem, answer, difficulty, segments)``.

    Each generation is scored against the segment after its prefix; the last
    one is kept but never scored.  ``store`` is called on the generations and
    should write and reread them when a model makes them, as all four results
    read them.
    """
    made = store(generate_steps(problems, generate))
    result = A.align_prefix(F.col("generated"), F.col("next_reference"), scorer, c)
    scored = made.where(F.col("index") < F.col("num_steps")).withColumn("r", result)
    steps = store(scored.select("id", F.col("index").cast("int").alias("index"), "num_steps", F.col("r.score").alias("score"), F.col("r.hallucination").cast("int").alias("hallucination"), F.col("r.score").alias("step_score")))
    sizes = problems.select("id", "difficulty", F.greatest(F.size("segments"), F.lit(0)).alias("num_steps"))
    scores = W.case_scores(steps, sizes, "id", c=c)
    records = W.case_records(scores, steps, "id").join(problems.select("id", "problem", "answer"), "id")
    cases = records.select("id", "difficulty", "score", "num_steps", "steps", "problem", "answer")
    texts = made.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("index", "generated"))), lambda x: x["generated"]).alias("gen_output"))
    generations = records.join(texts, "id", "left").select("id", "difficulty", F.coalesce("gen_output", F.array().cast("array<string>")).alias("gen_output"), "steps", F.col("score").alias("final_total_score"))
    return Evaluation(steps, cases, generations, W.model_summary(scores))

