from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from quillmark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4", partitions=4, memory="4g")


@pytest.fixture(scope="session")
def one(spark):
    """The value of a column expression over literal columns a, b, ..."""
    from pyspark.sql import functions as F

    def value(expr, *inputs):
        row = spark.range(1).select(*[F.lit(x).alias(chr(97 + i)) for i, x in enumerate(inputs)])
        return row.select(expr(*[F.col(chr(97 + i)) for i in range(len(inputs))]).alias("r")).first().r

    return value
