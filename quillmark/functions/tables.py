"""Segmentation as a table function, for SQL with LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quillmark.functions import units as U
from quillmark.session import ship

UNIT_ROW = S.StructType([S.StructField("id", S.IntegerType()), S.StructField("type", S.StringType()), S.StructField("content", S.StringType()), S.StructField("paragraph_index", S.IntegerType())])
SENTENCE_ROW = S.StructType([S.StructField("id", S.IntegerType()), S.StructField("content", S.StringType())])


def _text(argument: AnalyzeArgument, name: str) -> None:
    if not isinstance(argument.dataType, (S.StringType, S.NullType)):
        raise ValueError(f"{name} takes a text, not {argument.dataType.simpleString()}")


class FineSegment:
    """``fine_segment(text, max_chars, min_chars)``: the ordered units of a solution; none of a null text."""

    @staticmethod
    def analyze(text: AnalyzeArgument, max_chars: AnalyzeArgument | None = None, min_chars: AnalyzeArgument | None = None) -> AnalyzeResult:
        _text(text, "fine_segment")
        return AnalyzeResult(schema=UNIT_ROW)

    def eval(self, text: str | None, max_chars: int = 220, min_chars: int = 60) -> Iterator[tuple]:
        for i, (kind, content, paragraph) in enumerate(U.merged(U.raw(text or "", max_chars), min_chars)):
            yield i, kind, content, paragraph


class Sentences:
    """``sentences(text)``: the sentences of a generation, which stand for its claims where no model gives them."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        _text(text, "sentences")
        return AnalyzeResult(schema=SENTENCE_ROW)

    def eval(self, text: str | None) -> Iterator[tuple]:
        yield from enumerate(U.evaluation_sentences(text or ""))


def register(spark: SparkSession, **others: type) -> None:
    """Make the table functions known to SQL; ``others`` (name=class) adds to them or takes their place."""
    ship(spark)
    for name, made in {"fine_segment": FineSegment, "sentences": Sentences, **others}.items():
        spark.udtf.register(name, F.udtf(made))
