"""Alignment of a generated continuation with the next reference step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.config import EvaluationConfig
from quillmark.functions import text as T
from quillmark.operators import models as M

PAIR_FLOOR = 0.4  # pairs below are no match
REPEAT_PENALTY = 0.5  # of each generated claim that is the best of several reference claims
ENTAILED = ("entailed", "incomplete")


def pair_matches(generated: Column, reference: Column, pair=M.jaccard_pair, c: EvaluationConfig = EvaluationConfig()) -> Column:
    """Matches of the first sentences with a reference step, in sentence order."""
    head = F.slice(T.sentence_split_evaluation(generated), 1, c.max_sentences)
    pairs = M.words_pair(head, reference) if pair is M.jaccard_pair else F.transform(head, lambda s: pair(s, reference))

    def match(p: Column, i: Column) -> Column:
        return T.let((p["forward"] + p["backward"]) / 2.0, lambda score: F.struct(reference.alias("ref"), i.alias("gen_index"), p["forward"].alias("forward"), p["backward"].alias("backward"), score.alias("score"), (score < c.threshold).alias("is_hallucination")))

    return F.filter(F.transform(pairs, match), lambda m: m["score"] >= PAIR_FLOOR)


def align_pairs(generated: Column, reference: Column, pair=M.jaccard_pair, c: EvaluationConfig = EvaluationConfig(), top3_by_score: bool = False) -> Column:
    """struct<score, hallucination, n_matches>: the first three matches over three; with ``top3_by_score`` the best three."""
    empty = (T.to_atom(generated) == "") | (T.to_atom(reference) == "")

    def result(scores: Column) -> Column:
        chosen = F.slice(F.reverse(F.array_sort(scores)) if top3_by_score else scores, 1, 3)
        mean = F.aggregate(chosen, F.lit(0.0), lambda a, s: a + s) / 3.0
        return T.let(F.when(empty, 0.0).otherwise(mean), lambda score: F.struct(score.alias("score"), (score < c.overall_threshold).alias("hallucination"), F.size(scores).alias("n_matches")))

    return T.let(F.transform(pair_matches(generated, reference, pair, c), lambda m: m["score"]), result)


def align_prefix(generated: Column, reference: Column, scorer: M.Scorer = M.jaccard_scorer, c: EvaluationConfig = EvaluationConfig()) -> Column:
    """struct<score, hallucination>: the first sentences as one text against the reference step; 0 if either is empty."""
    gen, ref = T.to_atom(generated), T.to_atom(reference)
    head = T.sentence_head(T.sentence_split_evaluation(gen), c.max_sentences)
    score = F.when((head == "") | (ref == ""), 0.0).otherwise(scorer(head, ref))
    return T.let(score, lambda s: F.struct(s.alias("score"), (s < c.overall_threshold).alias("hallucination")))


def claim_matches(rows: DataFrame, key: str, generated: str, reference: str, judge, claims=M.sentence_claims, c: EvaluationConfig = EvaluationConfig()) -> DataFrame:
    """For every reference claim of a row its best generated claim.

    ``judge(gen, ref)`` gives struct<score, label, justification>.  Only
    entailed and incomplete labels can win, the first of equal scores wins,
    and a claim without a winner has score -1 and an empty text.
    """
    own = rows.select(key, F.posexplode(claims(F.col(reference))).alias("ref_pos", "ref"))
    gen = rows.select(key, F.posexplode(claims(F.array_join(F.slice(T.sentence_split_evaluation(F.col(generated)), 1, c.max_sentences), ""))).alias("gen_pos", "gen"))
    judged = own.join(gen, key).withColumn("j", judge(F.col("gen"), F.col("ref"))).where(F.col("j.label").isin(*ENTAILED) & (F.col("j.score") > -1.0))
    order = Window.partitionBy(key, "ref_pos").orderBy(F.desc("j.score"), "gen_pos")
    best = judged.withColumn("n", F.row_number().over(order)).where("n = 1").select(key, "ref_pos", F.col("gen").alias("best_gen"), "j.score", "j.justification")
    out = own.join(best, [key, "ref_pos"], "left")
    score = F.coalesce("score", F.lit(-1.0))
    return out.select(key, "ref_pos", "ref", F.coalesce("best_gen", F.lit("")).alias("best_gen"), score.alias("score"), F.coalesce("justification", F.lit("")).alias("justification"), (~(score > c.threshold)).alias("is_hallucination"))


def claim_scores(matches: DataFrame, key: str, c: EvaluationConfig = EvaluationConfig()) -> DataFrame:
    """Mean best score less the penalty of every generated claim that serves more than one reference claim."""
    repeats = duplicate_claims(matches, key).groupBy(key).agg(F.count("*").alias("n_repeats"))
    mean = matches.groupBy(key).agg(F.avg("score").alias("mean_score"), F.count("*").alias("n_claims"))
    score = F.col("mean_score") - REPEAT_PENALTY * F.coalesce("n_repeats", F.lit(0))
    return mean.join(repeats, key, "left").select(key, "n_claims", F.coalesce("n_repeats", F.lit(0)).alias("n_repeats"), score.alias("score"), (score < c.overall_threshold).alias("hallucination"))


def duplicate_claims(matches: DataFrame, key: str) -> DataFrame:
    """Non-empty generated claims that are the best of several reference claims."""
    return matches.where("best_gen <> ''").groupBy(key, "best_gen").agg(F.count("*").alias("n")).where("n > 1")
