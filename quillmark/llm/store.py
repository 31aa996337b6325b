"""Shared intermediate tables: written once, read many times, safe when executors are lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.session import materialize, new_path, shared_dir, ship

__all__ = ["apart", "bound_batches", "discard", "materialize", "new_path", "shared_dir", "table"]


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        folders, base = {f.rpartition("/")[0] for f in t.inputFiles()}, shared_dir(spark)
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            system = path.getFileSystem(spark._jsc.hadoopConfiguration())
            whole = system.makeQualified(path)
            if whole.getParent().toString().rstrip("/") == base:  # nothing but our own tables
                system.delete(whole, True)


def bound_batches(spark: SparkSession, mb: int = 16) -> None:
    """Make the session fit for Python stages.

    Executors get this package, and Arrow batches stay small in bytes, so that
    very long texts do not pile up in one batch.  Plans are run after the
    operator returns, so the session keeps these two settings; a caller who
    wants larger batches again sets them again.
    """
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", mb << 20), ("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)):
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def apart(keep: list[str], outputs: list[str]) -> list[str]:
    """The kept columns without those that an output column of the same name replaces."""
    taken = {c.lower() for c in outputs}
    return [c for c in keep if c.lower() not in taken]
