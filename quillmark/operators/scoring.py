"""Weighted scores: step, case, model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.config import EvaluationConfig
from quillmark.operators import align as A
from quillmark.operators import models as M
from quillmark.sources.readers import before_parts, in_order


def prefixes(rows: DataFrame, key: str, order: str, content: str, out: str = "prefix") -> DataFrame:
    """Every step with all steps up to it, each after a line end."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.concat(F.lit("\n"), F.array_join(F.collect_list(F.coalesce(content, F.lit(""))).over(upto), "\n")))


def next_step(rows: DataFrame, key: str, order: str, content: str, out: str = "next_content") -> DataFrame:
    """Every step with the one after it; the last has none."""
    return rows.withColumn(out, F.lead(content, 1).over(Window.partitionBy(key).orderBy(order)))


def weight_total(n: Column, alpha: float = 1.0) -> Column:
    """Sum of (n - i + 1) ** alpha over the steps; 0 without steps.  One number a case, to be taken once for it."""
    if alpha in (0.0, 1.0):
        n = F.greatest(n, F.lit(0)).cast("double")
        return n if alpha == 0.0 else n * (n + 1) / 2
    steps = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.pow(i.cast("double"), F.lit(float(alpha))))


def step_share(index: Column, n: Column, alpha: float = 1.0) -> Column:
    """The weight of a step before it is divided by its case's ``weight_total``."""
    return F.pow((n - index + 1).cast("double"), F.lit(float(alpha)))


def step_weight(index: Column, n: Column, alpha: float = 1.0) -> Column:
    return step_share(index, n, alpha) / weight_total(n, alpha)


def weighted_score(steps: Column, n: Column, alpha: float = 1.0) -> Column:
    """Weighted sum over array<struct<index, score>>; the last of n steps is never scored, and a case without steps has 0."""
    scored = F.filter(steps, lambda s: s["index"] < n)
    total = F.aggregate(scored, F.lit(0.0), lambda a, s: a + step_share(s["index"], n, alpha) * s["score"])
    return F.coalesce(F.try_divide(total, weight_total(n, alpha)), F.lit(0.0))


def difficulty_factor(difficulty: Column, beta: float = 1.0) -> Column:
    return F.exp(F.lit(float(beta)) * (difficulty - 5.0) / 10.0)


def score_steps(rows: DataFrame, key: str, order: str, content: str, scorer: M.Scorer = M.jaccard_scorer, c: EvaluationConfig = EvaluationConfig(), apply_penalty: bool = False) -> DataFrame:
    """Every step but the last against the step after it.

    Columns: key, index (from 1), num_steps, score, hallucination, step_score.
    ``apply_penalty`` takes lambda_h off the step score of hallucinated steps.
    """
    own = Window.partitionBy(key)
    numbered = rows.select(key, F.row_number().over(own.orderBy(order)).alias("index"), F.count("*").over(own).alias("num_steps"), F.col(content).alias("__gen"), F.lead(content, 1).over(own.orderBy(order)).alias("__ref"))
    result = A.align_prefix(F.col("__gen"), F.col("__ref"), scorer, c)
    scored = numbered.where(F.col("index") < F.col("num_steps")).withColumn("__r", result)
    flag = F.col("__r.hallucination").cast("int")
    step = F.col("__r.score") - c.lambda_h * flag if apply_penalty else F.col("__r.score")
    return scored.select(key, "index", "num_steps", F.col("__r.score").alias("score"), flag.alias("hallucination"), step.alias("step_score"))


def case_scores(steps: DataFrame, cases: DataFrame, key: str, difficulty: str = "difficulty", c: EvaluationConfig = EvaluationConfig()) -> DataFrame:
    """One row per case of ``cases(key, difficulty, num_steps)``: weighted total and difficulty-adjusted score."""
    part = step_share(F.col("index"), F.col("num_steps"), c.alpha) * F.col("step_score")
    totals = steps.groupBy(key).agg(F.sum(part).alias("total"))
    total = F.coalesce(F.try_divide(F.col("total"), weight_total(F.col("num_steps"), c.alpha)), F.lit(0.0))
    return cases.join(totals, key, "left").select(key, difficulty, "num_steps", total.alias("total_score"), (total * difficulty_factor(F.col(difficulty), c.beta)).alias("score"))


def case_records(scores: DataFrame, steps: DataFrame, key: str) -> DataFrame:
    """Case scores with their steps in order, as one array each."""
    each = F.struct("index", "score", "hallucination", "step_score")
    arrays = steps.groupBy(key).agg(F.sort_array(F.collect_list(each)).alias("steps"))
    return scores.join(arrays, key, "left").withColumn("steps", F.coalesce("steps", F.array().cast("array<struct<index:int,score:double,hallucination:int,step_score:double>>")))


def model_summary(scores: DataFrame, score: str = "score") -> DataFrame:
    """One row: the number of cases, and ten times their mean score (null without cases)."""
    return scores.agg(F.count("*").alias("num"), F.try_divide(F.sum(score) * 10, F.count("*")).alias("avg_score"))


def running_average(scores: DataFrame, order: str, score: str = "score", every: int = 50) -> DataFrame:
    """The mean so far at every ``every``-th case in order.

    Ranges of the order column are added up first, so no task sorts the whole table.
    """
    placed = in_order(scores.select(order, score), [order])
    before = before_parts(placed, s0=F.sum(score), n0=F.count("*"))
    inside = Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.select("__part", "__place", F.sum(score).over(inside).alias("s")).join(F.broadcast(before), "__part")
    num = F.col("n0") + F.col("__place") + 1
    return rows.select(num.alias("num"), ((F.col("s0") + F.col("s")) / num).alias("running_avg")).where(F.col("num") % every == 0)
