"""Cases whose steps arrive one by one, in any order, scored as soon as they are whole.

A stateful operator keeps the scores of a case's steps.  When all that count
are there, the case is given out; a step that comes again with another score
corrects it, as a further revision.  A case that waits too long is given out
with what it has, marked as not complete, and forgotten; if steps of it come
later it begins anew, at revision 1 of a later batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillmark.config import EvaluationConfig
from quillmark.operators import scoring as W
from quillmark.session import ship

#: Rows of a step: its case, its place from 1, how many steps the case has, the case's difficulty, the score, and a number that is greater for a later correction.
STEP = "id bigint, index int, num_steps int, difficulty double, step_score double, version bigint"
REVISION = "id bigint, revision bigint, complete boolean, num_steps int, difficulty double, total double"


# written out, as workers have no session to read DDL with
_STEP_KEY = S.StructType([S.StructField("index", S.IntegerType())])
_STEP_STATE = S.StructType([S.StructField("score", S.DoubleType()), S.StructField("version", S.LongType())])
_CASE_STATE = S.StructType([S.StructField("num_steps", S.IntegerType()), S.StructField("difficulty", S.DoubleType()), S.StructField("revision", S.LongType()), S.StructField("given", S.DoubleType())])


class CaseState(StatefulProcessor):
    """Scores of the steps of one case.

    ``alpha`` weighs early steps; ``patience_ms`` is how long a case may wait
    for its next row, in processing time, before it is given out as it is.
    """

    def __init__(self, alpha: float = 1.0, patience_ms: int | None = None) -> None:
        self.alpha, self.patience = alpha, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getMapState("steps", _STEP_KEY, _STEP_STATE)
        self.about = handle.getValueState("about", _CASE_STATE)

    def _given(self, key: tuple, num_steps: int, difficulty: float | None, revision: int, complete: bool, total: float) -> pd.DataFrame:
        return pd.DataFrame({"id": [key[0]], "revision": [revision], "complete": [complete], "num_steps": pd.array([num_steps], "Int32"), "difficulty": [difficulty], "total": [total]})

    def _total(self, n: int, scores: dict[int, float]) -> float:
        parts = sum(float(n - i + 1) ** self.alpha * s for i, s in sorted(scores.items()) if i < n)
        whole = sum(float(i) ** self.alpha for i in range(1, n + 1))
        return parts / whole if whole else 0.0

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.about.get()
        num_steps, difficulty, revision, given = held if held is not None else (0, None, 0, None)
        known = {k[0]: (v[0], v[1]) for k, v in self.steps.iterator()}
        for frame in rows:
            for r in frame.itertuples(index=False):
                num_steps = int(r.num_steps)
                difficulty = None if pd.isna(r.difficulty) else float(r.difficulty)
                if pd.isna(r.index_) or pd.isna(r.step_score):  # a case that only tells that it is there
                    continue
                index, version = int(r.index_), int(r.version)
                if index not in known or version >= known[index][1]:
                    known[index] = float(r.step_score), version
                    self.steps.updateValue((index,), known[index])
        complete = all(i in known for i in range(1, num_steps))
        out = []
        if complete:
            total = self._total(num_steps, {i: s for i, (s, _) in known.items()})
            if given is None or total != given:
                revision, given = revision + 1, total
                out = [self._given(key, num_steps, difficulty, revision, True, total)]
        self.about.update((num_steps, difficulty, revision, given))
        if self.patience is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.about.get()
        if held is None:
            return
        num_steps, difficulty, revision, given = held
        if given is None:
            scores = {k[0]: v[0] for k, v in self.steps.iterator()}
            yield self._given(key, num_steps, difficulty, revision + 1, False, self._total(num_steps, scores))
        self.steps.clear()
        self.about.clear()

    def close(self) -> None:
        pass


def revisions(steps: DataFrame, c: EvaluationConfig = EvaluationConfig(), patience_ms: int | None = None) -> DataFrame:
    """(id, revision, complete, num_steps, difficulty, total_score, score) of the cases of a stream of ``STEP`` rows.

    Repeated rows change nothing; of two scores of a step the one with the
    greater version holds, of equal versions the later row.  The last step of a
    case is never scored and need not come.  Rows without a case go.  With
    ``patience_ms`` the stream looks for late cases batch after batch, so it
    never ends by itself (``run_batches(once=False)``).
    """
    ship(steps.sparkSession)
    rows = steps.where("id IS NOT NULL AND num_steps IS NOT NULL").withColumnRenamed("index", "index_")  # index is a method of tuples
    out = rows.groupBy("id").transformWithStateInPandas(CaseState(c.alpha, patience_ms), S.StructType.fromDDL(REVISION), "Update", "ProcessingTime" if patience_ms is not None else "None")
    return out.select("id", "revision", "complete", "num_steps", "difficulty", F.col("total").alias("total_score"), (F.col("total") * W.difficulty_factor(F.col("difficulty"), c.beta)).alias("score"))


def latest(given: DataFrame) -> DataFrame:
    """Of every case its last revision; with a column ``batch``, as folders of batches give, that of the last batch."""
    order = Window.partitionBy("id").orderBy(*[F.desc(c) for c in ("batch", "revision") if c in given.columns])
    return given.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
