"""Answers of a model that outlive a run, bounded by last use.

A memo is a folder for each model.  Every run adds two small tables: the
answers that it had to ask for, and the keys that it used; a key is the hash of
a text.  Only the ``keep`` keys that were used last are known to later runs, ties
inside a run by key, so a forgotten text is asked again.  When many runs have
gathered, what is known is written as one and the rest deleted.  A run that
fails has written nothing or tables that a repeated run finds; one run writes
at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.session import materialize
from quillmark.sources.readers import numbered

_ANSWERS, _USES = "key string, answer string, made bigint", "key string, used bigint"


def text_key(x: Column) -> Column:
    """A null text has a key of its own."""
    return F.coalesce(F.sha2(x, 256), F.lit("null"))


class Memo:
    """``keep`` None forgets nothing; ``runs`` is how many runs gather before they are written as one."""

    def __init__(self, spark: SparkSession, path: str, model: str, keep: int | None = 5000, runs: int = 16) -> None:
        self.spark, self.keep, self.most_runs = spark, keep, runs
        self.base = f"{path.rstrip('/')}/{hashlib.sha256(model.encode()).hexdigest()[:16]}"

    def _folder(self, name: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _runs(self) -> list[int]:
        """Numbers of the runs that have written both tables."""
        path, system = self._folder("uses")
        names = [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []
        done = []
        for n in sorted(int(x.removeprefix("run-")) for x in names if x.startswith("run-")):
            mark, system = self._folder(f"uses/run-{n:08d}/_SUCCESS")
            if system.exists(mark):
                done.append(n)
        return done

    def _read(self, name: str, schema: str, runs: list[int]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.base}/{name}/run-{n:08d}" for n in runs]) if runs else self.spark.createDataFrame([], schema)

    def known(self) -> DataFrame:
        """(key, answer, made, used) of the keys that are not forgotten."""
        runs = self._runs()
        used = self._read("uses", _USES, runs).groupBy("key").agg(F.max("used").alias("used"))
        if self.keep is not None:
            ranked = numbered(used.withColumn("__back", -F.col("used")), ["__back", "key"], "__rank")
            used = ranked.where(F.col("__rank") <= self.keep).select("key", "used")
        answers = self._read("answers", _ANSWERS, runs).groupBy("key").agg(F.max_by("answer", "made").alias("answer"), F.max("made").alias("made"))
        return answers.join(used, "key")

    def _write(self, run: int, answers: DataFrame, uses: DataFrame) -> None:
        """Uses come last: a run counts once they are whole."""
        answers.write.mode("overwrite").parquet(f"{self.base}/answers/run-{run:08d}")
        uses.write.mode("overwrite").parquet(f"{self.base}/uses/run-{run:08d}")

    def answer(self, rows: DataFrame, text: str, call: Callable[[Column], Column], out: str) -> DataFrame:
        """``rows`` with an answer to every text; ``call`` is asked once for each distinct text that the memo does not know."""
        runs = self._runs()
        run = (runs[-1] if runs else 0) + 1
        known = materialize(self.known(), "memo")
        texts = materialize(rows.select(text_key(F.col(text)).alias("key"), F.col(text).alias("__text")).distinct(), "texts")
        fresh = texts.join(known.select("key"), "key", "left_anti")
        self._write(run, fresh.select("key", call(F.col("__text")).alias("answer"), F.lit(run).cast("long").alias("made")), texts.select("key", F.lit(run).cast("long").alias("used")))
        both = known.select("key", "answer").unionAll(self._read("answers", _ANSWERS, [run]).select("key", "answer"))
        here = materialize(texts.select("key").join(both, "key"), "answers")  # of these texts alone, so later runs may delete what they like
        if len(runs) + 1 >= self.most_runs:
            self.compact()
        found = here.select(F.col("key").alias("__key"), F.col("answer").alias(out))
        kept = rows.select(*[c for c in rows.columns if c != out or c == text])
        return kept.join(found, text_key(F.col(text)) == F.col("__key"), "left").drop("__key")

    def compact(self) -> None:
        """What is known as one run, and no other."""
        runs = self._runs()
        known = materialize(self.known(), "memo")
        self._write(runs[-1] + 1 if runs else 1, known.select("key", "answer", "made"), known.select("key", "used"))
        for n in runs:
            for name in ("uses", "answers"):
                path, system = self._folder(f"{name}/run-{n:08d}")
                system.delete(path, True)
