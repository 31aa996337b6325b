"""Values and records of no fixed type."""

from __future__ import annotations

import gzip
import io
import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillmark.functions import nested as N
from quillmark.sources import jsonlines as J


def plain_flatten(v):
    if isinstance(v, (list, tuple)):
        return [a for e in v for a in plain_flatten(e)]
    text = "" if v is None else v.strip() if isinstance(v, str) else json.dumps(v, ensure_ascii=False) if isinstance(v, dict) else str(v).strip()
    return [text] if text else []


VALUES = [None, "", " a\n", 1, -2.50, 1e22, 0.0000001, True, [], [[]], [[" x ", [None, [1, [2.0, [False]]]]], {"k": [1, {"z": "é"}]}], {"a": 1.0, "b": None}, [" ", "\x1c q"], 12345678901234567]
for _ in range(3):
    deep = ["end"]
    for i in range(200):
        deep = [i, deep]
VALUES.append(deep)


def test_any_shape_flattens_as_python_does(spark):
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(VALUES)], "i int, j string")
    got = {r.i: r for r in rows.select("i", N.flatten_nested(F.col("j"), variant=False).alias("t"), N.flatten_nested(F.parse_json("j")).alias("v"), N.normalize_nested(F.parse_json("j")).alias("n"), N.nested_atom(F.col("j"), variant=False).alias("a")).collect()}
    for i, v in enumerate(VALUES):
        want = " ".join(plain_flatten(v))
        assert got[i].t == want and got[i].v == want and got[i].n == want.strip()
        assert got[i].a == ("" if v is None else v.strip() if isinstance(v, str) else json.dumps(v, ensure_ascii=False) if isinstance(v, (list, dict)) else str(v))
    odd = spark.createDataFrame([(None,), ("no json [",), ("[" * 100_000,), ('["\\ud800"]',)], "j string")
    assert [r.t for r in odd.select(N.flatten_nested(F.col("j"), variant=False).alias("t")).collect()] == ["", "no json [", "[" * 100_000, "?"]
    assert spark.range(1).select(N.flatten_nested(F.parse_json(F.lit(None).cast("string"))).alias("t")).first().t == ""


def test_fields_are_added_as_to_a_dict(one):
    assert one(N.with_fields, '{"b": 1, "a": [1.50, "é"], "c": null}', '{"a": 2, "z": {}}') == '{"b": 1, "a": 2, "c": null, "z": {}}'
    assert one(N.with_fields, None, "{}") is None and one(N.with_fields, '{"a": 1}', None) == '{"a": 1}'


LINES = [b'{"a": 1}', b"", b'  {"b": [NaN, -Infinity], "b": 2}  ', b"{bad", b"\xff\xfe", b'{"\xc3\xa9": "' + b"x" * 600 + b'"}', b"3", b'[1, "\\ud800"]', "﻿{}".encode(), b'{"c": 1} {"d": 2}', b'{"e": 12345678901234567890123456789012345678901}', b'{"f": 1, "f": {"g": Infinity}}']


def write(path, ends=(b"\n",), last=True):
    rng, out, begins = random.Random(1), io.BytesIO(), []
    for i, line in enumerate(LINES):
        begins.append(out.tell())
        out.write(line)
        if last or i < len(LINES) - 1:
            out.write(rng.choice(ends))
    path.write_bytes(out.getvalue())
    return begins


def good():
    out = []
    for i, line in enumerate(LINES):
        try:
            text = line.decode().strip()
            if text:
                json.loads(text)
                out.append(i)
        except ValueError:
            pass
    return out


@pytest.mark.parametrize(("split", "ends", "last"), [(1 << 20, (b"\n",), True), (50, (b"\n", b"\r\n", b"\r"), True), (200, (b"\n", b"\r\n"), False)])
def test_ranges_give_every_line_once(spark, tmp_path, split, ends, last):
    begins = [write(tmp_path / f"{n}.jsonl", ends, last) for n in "ab"]
    (tmp_path / "_SUCCESS").write_text("x")
    (tmp_path / "empty.jsonl").write_text("")
    got = J.read_records(spark, str(tmp_path), split_bytes=split).orderBy("id").collect()
    want = [(n, b[i], i) for n, b in zip("ab", begins, strict=True) for i in good()]
    assert [r.id for r in got] == list(range(1, len(want) + 1))
    assert [(r.file[-7], r.offset) for r in got] == [(n, at) for n, at, _ in want]
    assert json.loads(got[1].record) == {"b": 2} and json.loads(got[2].record) == {"é": "x" * 600}
    assert json.loads(got[4].record) == [1, "?"] and json.loads(got[-1].record) == {"f": {"g": "Infinity"}}
    assert str(got[5].record) == '{"e": 12345678901234567890123456789012345678901}'


@pytest.mark.parametrize("ends", [(b"\n",), (b"\r\n",), (b"\r",), (b"\n", b"\r\n", b"\r")])
@pytest.mark.parametrize("last", [True, False])
def test_all_cuts_of_a_file(tmp_path, ends, last):
    begins = write(tmp_path / "a.jsonl", ends, last)
    for split in (1, 2, 3, 5, 17, 64, 1000):
        reader = J.JsonLinesReader({"path": str(tmp_path), "splitBytes": str(split)})
        rows = [(p.part, r) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert [r["offset"] for _, r in rows] == [begins[i] for i in good()]
        assert all(r["part"] == part == r["offset"] // split for part, r in rows)


def test_many_short_ranges_become_fewer(tmp_path):
    """A range is a task, so their number is bounded; no range reads far beyond itself."""
    line = b"{'a': 12345}\n"
    (tmp_path / "a.jsonl").write_bytes(line * 30_000)
    (tmp_path / "b.jsonl").write_bytes(line * 10_000)
    reader = J.JsonLinesReader({"path": str(tmp_path), "mode": "repair", "splitBytes": "16"})
    ranges = reader.partitions()
    assert len(ranges) < 1100
    rows = [(p.part, r) for p in ranges for b in reader.read(p) for r in b.to_pylist()]
    assert [r["offset"] for _, r in rows] == [len(line) * i for n in (30_000, 10_000) for i in range(n)]
    assert all(r["part"] == part and r["record"] == '{"a": 12345}' for part, r in rows)


def test_compressed_files_and_one_file(spark, tmp_path):
    (tmp_path / "x.jsonl.gz").write_bytes(gzip.compress(b'{"a": 1}\n{"a": 2}\n' * 3000))
    rows = J.read_records(spark, str(tmp_path / "x.jsonl.gz"), split_bytes=10)
    assert rows.count() == 6000 and rows.agg(F.sum(J.field(F.col("value"), "a", "int")).alias("s")).first().s == 9000


def test_strict_names_file_and_byte(spark, tmp_path):
    begins = write(tmp_path / "a.jsonl")
    with pytest.raises(PySparkException, match=rf"a\.jsonl, byte {begins[3]}: "):
        J.read_records(spark, str(tmp_path), "strict").count()
    assert J.first_bad_byte(spark, str(tmp_path)) == begins[3]
    with pytest.raises(PySparkException, match="mode is one of"):
        J.read_records(spark, str(tmp_path), "lenient").count()
    with pytest.raises(PySparkException, match="nowhere"):
        J.read_records(spark, str(tmp_path / "nowhere")).count()


def test_all_or_nothing(spark, tmp_path):
    for n, text, want in (("good", "{'a': 1, 'b c': \"x\"}\n\n{\"a\": 2}\n", [(1, "x"), (2, None)]), ("bad", "{'a': 1}\n{'a': \n", []), ("empty", "", [])):
        (tmp_path / n).mkdir()
        (tmp_path / n / "x.jsonl").write_text(text)
        rows = J.read_records_all_or_nothing(spark, str(tmp_path / n)).orderBy("id")
        assert [(r.a, r.b) for r in rows.select(J.field(F.col("value"), "a", "int").alias("a"), F.try_variant_get("value", "$['b c']", "string").alias("b")).collect()] == want


def test_fields_of_records(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ('{"a": "x", "b": [1]}',), ("[1]",)], "j string").select(F.parse_json("j").alias("v"))
    assert [(r.a, r.b) for r in rows.select(J.field(F.col("v"), "a", "int").alias("a"), J.field(F.col("v"), "b", "array<int>").alias("b")).collect()] == [(1, None), (None, [1]), (None, None)]
