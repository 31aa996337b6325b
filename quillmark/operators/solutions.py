"""Filtering and segmenting tables of worked solutions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.config import SegmentConfig
from quillmark.functions import segment as G
from quillmark.functions import text as T


def long_solution(x: Column, c: SegmentConfig = SegmentConfig()) -> Column:
    """Whether a solution meets any of the thresholds that are set; the cheap ones come first."""
    norm = T.normalize_text(x)
    tests = []
    if c.min_chars is not None:
        tests.append(F.length(norm) >= c.min_chars)
    if c.min_tokens is not None:
        tests.append(T.approx_token_count(norm) >= c.min_tokens)
    if c.use_paragraphs and c.min_paragraphs is not None:
        tests.append(F.size(T.split_paragraphs(norm)) >= c.min_paragraphs)
    long = reduce(lambda a, b: a | b, tests, F.lit(False))
    if c.min_sentences is not None:  # sentences of the texts that are still open alone
        long = long | (G.sentence_count(F.when(~long, norm), c.count_math_as_sentence) >= c.min_sentences)
    return ~T.is_blank(x) & long


def filter_long(rows: DataFrame, c: SegmentConfig = SegmentConfig()) -> DataFrame:
    """Rows with a long solution; null and blank ones go."""
    return rows.where(long_solution(F.col(c.solution_key), c))


def process_solutions(rows: DataFrame, c: SegmentConfig = SegmentConfig()) -> DataFrame:
    """Long rows with ``segment_num`` and ``segments``; all other columns stay."""
    units = G.fine_segment(F.col(c.solution_key), c.max_unit_chars, c.keep_math_block, c.min_unit_chars, c.compat)
    out = filter_long(rows, c).withColumn("segments", units)
    return out.withColumn("segment_num", F.size("segments"))


def explode_segments(rows: DataFrame, keys: list[str], segments: str = "segments") -> DataFrame:
    """One row per segment with its 1-based place."""
    return rows.select(*keys, F.posexplode(segments).alias("pos", "segment")).select(*keys, (F.col("pos") + 1).alias("index"), "segment.*")


# Words that hint at the role of a step, in order of precedence.
ROLE_HINTS = {
    "LowerBound": ["lower bound", "at least", "necessary", "must be ≥", "cannot be less"],
    "UpperBound/Construction": ["upper bound", "construction", "we can achieve", "it suffices to construct"],
    "Conclusion/Answer": ["therefore", "thus", "hence", "in conclusion", "we conclude", "\\boxed"],
    "CaseSplit": ["case", "otherwise", "when", "if", "suppose that"],
    "Claim": ["claim", "lemma", "proposition"],
    "Observation": ["observe that", "note that", "we note"],
    "Verification": ["verify", "check", "it remains to show", "it remains to verify"],
    "Inequality/Algebra": ["inequality", "rearranging", "algebraically", "by AM-GM", "by Cauchy"],
}


def tag_role(x: Column, hints: dict[str, list[str]] = ROLE_HINTS) -> Column:
    """The first role of which a keyword occurs in the text as whole words, in any case; null if none does."""
    found = F.lit(None).cast("string")
    for role, words in reversed(list(hints.items())):
        some = "|".join(re.escape(w.lower()) for w in words)
        found = F.when(F.lower(x).rlike(rf"(?<![\p{{L}}\p{{N}}_])(?:{some})(?![\p{{L}}\p{{N}}_])") if words else F.lit(False), role).otherwise(found)
    return found


def merge_intervals(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or touching intervals of each key as one."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy(start, end)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col(start) > F.max(end).over(before), F.lit(True)).cast("int")
    group = F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("__fresh", fresh).withColumn("__group", group)
    return marked.groupBy(*keys, "__group").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__group")
