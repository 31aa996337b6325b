"""JSON lines in three degrees of tolerance, and Parquet copies of hub datasets."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import jsonrepair as J
from quillmark.functions.text import strip
from quillmark.session import materialize, ship


def in_order(rows: DataFrame, parts: list[str]) -> DataFrame:
    """The rows stored by range of ``parts``, with __part (of the range) and __place (from 0, inside it).

    No task sorts more than its range, and ranges are cut by a sample, so a
    key with many rows is cut by the columns that follow it.
    """
    at = F.monotonically_increasing_id()
    placed = materialize(rows.repartitionByRange(*parts).sortWithinPartitions(*parts).withColumn("__at", at), "ordered")
    return placed.withColumn("__part", F.shiftright("__at", 33)).withColumn("__place", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at")


def before_parts(placed: DataFrame, **sums: Column) -> DataFrame:
    """For every __part the sums over the parts before it; one row for each part, so it is small."""
    each = placed.groupBy("__part").agg(*[e.alias(n) for n, e in sums.items()])
    order = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("__part", *[F.coalesce(F.sum(n).over(order), F.lit(0)).alias(n) for n in sums])


def numbered(rows: DataFrame, parts: list[str], out: str = "id") -> DataFrame:
    """A gapless ordinal from 1 in the order of ``parts``; no task sorts the whole table."""
    placed = in_order(rows, parts)
    before = before_parts(placed, __before=F.count("*"))
    return placed.join(F.broadcast(before), "__part").withColumn(out, F.col("__place") + F.col("__before") + 1).drop("__part", "__place", "__before")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with their file, where their split begins in it, and their order in the split."""
    text = spark.read.text(path)
    kept = text.select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__line"), strip(F.col("value")).alias("value"))
    return kept.where("value <> ''")


def read_jsonl(spark: SparkSession, path: str, schema: str, exact: bool = True, ids: str | None = "id") -> DataFrame:
    """Good lines only; bad ones are skipped and do not advance the ordinal ``ids``.

    Files follow each other by name, lines as they stand in their file.

    With ``exact`` a line is good if Python's json.loads takes it; else Spark's
    own parser decides, without Python.
    """
    lines = _lines(spark, path)
    if exact:
        ship(spark)
        good = lines.where(J.is_json("value"))
    else:
        good = lines.where(F.from_json("value", f"struct<{_ddl(schema)}>", {"mode": "PERMISSIVE"}).isNotNull() & F.try_parse_json("value").isNotNull())
    rows = good.withColumn("r", F.from_json("value", f"struct<{_ddl(schema)}>"))
    if ids:
        rows = numbered(rows, ["__file", "__split", "__line"], "__id")
        return rows.select(F.col("__id").alias(ids), *[F.col(f"r.{c}") for c in spark.createDataFrame([], schema).columns if c != ids])
    return rows.select("r.*")


def _ddl(schema: str) -> str:
    """"a int, b array<string>" as fields of a struct: "a:int,b:array<string>"."""
    from pyspark.sql.types import StructType

    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields)


def read_jsonl_strict(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Any bad line fails the read; blank ones are skipped."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl_all_or_nothing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines with single-quoted keys repaired; if any line is bad, no row at all."""
    lines = _lines(spark, path).select(J.fix_json_format(F.col("value")).alias("value"))
    rows = lines.select(F.from_json("value", f"struct<{_ddl(schema)}>", {"mode": "FAILFAST"}).alias("r"))
    try:
        rows.agg(F.count("r"), F.max(F.hash("r"))).collect()  # one row; reads every field
    except (PySparkException, Py4JJavaError):
        return spark.createDataFrame([], schema)
    return rows.select("r.*")


def read_hub_copy(spark: SparkSession, path: str) -> DataFrame:
    """A dataset that was downloaded as Parquet."""
    return spark.read.parquet(path)
