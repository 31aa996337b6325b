"""Cases that arrive as files: segmented or scored batch by batch, each batch committed once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillmark.config import SegmentConfig
from quillmark.operators.solutions import process_solutions


def stream_jsonl(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """New JSON-lines files of a folder; bad lines are dropped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_batch).json(path)


def segment_stream(rows: DataFrame, c: SegmentConfig = SegmentConfig()) -> DataFrame:
    """Segmentation needs no state: the batch operator works on a stream as it is."""
    return process_solutions(rows, c)


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Operators with state of their own need the store that keeps it on disk; the session's setting comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def run_batches(rows: DataFrame, evaluate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch through ``evaluate`` into a folder of its own, so a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        evaluate(batch).write.mode("overwrite").json(f"{out}/batch={number:08d}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
