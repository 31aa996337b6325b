"""Importance resampling against a plain version."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillmark.llm import resample

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [(1, None), (2, ""), (3, " .,\n"), (None, "one two three " * 10), (5, "a b c " * 8), (5, "a b c " * 8), (5, "d e f " * 9), (6, "Éa" * 50_000 + " End" * 30), (7, "x"), (8, "İstanbul KK ſ 12 A_b-C\x00d " * 5), (9, "w " * 30_000)]


def plain(rows, target, orders=2, buckets=10_000, percent=25, least=20, salt="7"):
    def words(t):
        return ALNUM.findall((t or "").translate(LOW))

    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, orders + 1) for i in range(len(w) - n + 1)]

    s, t = (collections.Counter(f for x in texts for f in features(x)) for texts in ([x for _, x in rows], target))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = None if i is None else int(hashlib.sha256(f"{salt}:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    fit = sorted((r for r in out if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0], r[1]))
    for rank, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize(("orders", "buckets", "percent"), [(2, 10_000, 25), (1, 7, 60), (3, 500, 100)])
def test_resampling_is_the_plain_one(spark, orders, buckets, percent):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None if i is None else 10_000 + i, t) for i, t in ODD], "doc_id long, text string"))
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = resample.resample(docs, F.col("doc_id"), F.col("text"), bench, F.col("text"), orders, buckets, percent)
    assert rows_of(got) == plain([tuple(r) for r in docs.collect()], [r.text for r in bench.collect()], orders, buckets, percent)


def test_odd_rows_and_clashing_names(spark):
    rows = [(i, t, 1, 2, 3, "p") for i, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int, bucket int, weight int, pos string")
    aim = spark.createDataFrame([(None, 1), ("End a b", 2), ("", 3)], "text string, n int")
    got = resample.resample(docs, F.col("doc_id"), F.col("text"), aim, F.col("text"), percent=60)
    assert rows_of(got) == plain(ODD, [None, "End a b", ""], percent=60)
    sample = resample.drawn(docs, F.col("doc_id"), got)
    assert sample.columns == docs.columns and sample.count() > 0
    ranked = [r.rank for r in got.collect() if r.rank]
    assert sorted(ranked) == list(range(1, len(ranked) + 1))
    none = resample.resample(docs, F.col("doc_id"), F.col("text"), aim.limit(0), F.col("text"))
    assert rows_of(none) == plain(ODD, [])
    empty = resample.resample(docs.limit(0), F.col("doc_id"), F.col("text"), aim, F.col("text"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_ties_go_to_the_smaller_id(spark):
    weighted = spark.createDataFrame([(i, 30, 30 + i % 2, 0) for i in [4, 4, 9, 2]], "doc_id long, n_words long, n_features long, weight long").withColumn("weight", -resample.noise(F.col("doc_id"), "7"))
    got = resample.draw(weighted, 75).where("rank IS NOT NULL").orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [(2, 0), (4, 0), (4, 0)]


def test_words_of_ascii_and_other_texts(spark):
    texts = ["A_b-C 12é", "ÀB c d", "KKİI", "\ta\x00b\x7fc{d}", "", "...", None]
    got = [r.w for r in spark.createDataFrame([(t,) for t in texts], "t string").select(resample.words(F.col("t")).alias("w")).collect()]
    assert got == [ALNUM.findall((t or "").translate(LOW)) for t in texts]
