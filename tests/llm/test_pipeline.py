"""The pipeline stage by stage: what stays, what goes, and odd documents."""

from __future__ import annotations

import re

import corpus_pipeline as cp
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_documents import ODD, odd, plain_groups, plain_hits

from quillmark.llm.store import materialize

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before each stage and after the last."""
    docs = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for name, f in cp.STAGES:
        docs.append(materialize(f(spark, docs[-1], SMALL), name))
    return docs


def test_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == ["language", "quality", "near_dedup", "decontaminate", "pack"]
    assert all(d.columns == stages[0].columns for d in stages[1:5])


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_language_keeps_text_with_letters(stages):
    kept = ids(stages[1])
    assert {r.doc_id for r in stages[0].collect() if re.search(r"[^\W\d_]", r.text)} - kept == set()


def test_quality_follows_labels(stages):
    labels = pd.read_parquet(f"{SMALL}/labels.parquet").set_index("doc_id").quality
    kept = ids(stages[2])
    judged = labels[[i in ids(stages[1]) for i in labels.index]]
    assert np.mean([(i in kept) == (q == 1) for i, q in judged.items()]) > 0.9


def test_near_dedup_is_the_plain_one(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    groups = plain_groups(rows, 5, 80)
    assert ids(stages[3]) == {i for i, c in groups.items() if i == c}


def test_decontamination_is_the_plain_one(stages):
    rows = [(r.doc_id, r.text) for r in stages[3].collect()]
    items = [tuple(x) for x in pd.read_parquet(f"{SMALL}/benchmark.parquet").itertuples(index=False)]
    assert ids(stages[4]) == {i for (i, _), h in zip(rows, plain_hits([t for _, t in rows], items), strict=True) if not h[1]}


def test_packing_holds_every_document(stages):
    got = stages[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id for r in got} == ids(stages[4]) and all(r.n == r.m for r in got)


def test_run(spark, stages):
    assert cp.run(spark, SMALL).drop("ids", "sequence_id").exceptAll(stages[5].drop("ids", "sequence_id")).count() == 0


@pytest.mark.parametrize("lang", ["en", None])
def test_odd_documents(spark, lang):
    docs = odd(spark).withColumn("lang", F.lit(lang).cast("string")).withColumn("c0", F.lit(1)).withColumn("n_hit", F.lit(2))
    for _, f in cp.STAGES:
        for d in (docs, docs.limit(0)):
            out = f(spark, d, SMALL)
            rows = out.count()
            assert out.columns == docs.columns or "sequence_id" in out.columns
            assert rows <= 20 * len(ODD)
    kept = cp.near_dedup(spark, docs, SMALL).collect()
    assert sum(r.doc_id == 5 for r in kept) == 1 and sum(r.doc_id is None for r in kept) == 2
    assert not [r for r in cp.language(spark, docs, SMALL).collect() if r.doc_id in (1, 2, 3, 8)]


def test_near_dedup_judges_each_text_of_a_repeated_id(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    docs = spark.createDataFrame([(3, b), (5, a), (5, b), (7, c), (7, d), (2, d), (7, c)], "doc_id long, text string")
    for rows in (docs, docs.orderBy(F.desc("text"))):
        assert sorted(tuple(r) for r in cp.near_dedup(spark, rows, SMALL).collect()) == sorted([(3, b), (5, a), (7, c), (2, d)])
