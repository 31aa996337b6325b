"""Charts are whole SVG files, and their marks are where the numbers say."""

from __future__ import annotations

from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from quillmark.sources import charts as C

NS = "{http://www.w3.org/2000/svg}"


def drawn(chart, path):
    C.write_chart(chart, str(path))
    return ElementTree.fromstring("".join(p.read_text(encoding="utf-8") for p in sorted(path.glob("part-*"))))


def test_bars(spark, tmp_path):
    rows = spark.createDataFrame([("b", 4), (None, 2), ("a<&\">\x01é", 1), ("zero", 0), ("null", None)], "key string, count long")
    svg = drawn(C.bar_chart(rows, ["key"], "T & <t>", "x", "y"), tmp_path / "c")
    assert (svg.get("width"), svg.get("height")) == ("600.00", "450.00")
    bars = svg.findall(f"{NS}rect")
    assert [b.get("data-key") for b in bars] == ["None", 'a<&">�é', "b", "null", "zero"]
    assert [float(b.get("height")) for b in bars] == [pytest.approx(350 * 0.95 * n / 4, abs=0.01) for n in (2, 1, 4, 0, 0)]
    assert all(float(b.get("y")) + float(b.get("height")) == pytest.approx(390, abs=0.011) for b in bars)
    assert svg.find(f"{NS}text[@class='title']").text == "T & <t>" and not [t for t in svg.iter(f"{NS}text") if "rotate(-30" in (t.get("transform") or "")]
    back = {r.key: r["count"] for r in C.read_marks(spark, str(tmp_path / "c")).collect()}
    assert back == {"None": 2, 'a<&">�é': 1, "b": 4, "null": 0, "zero": 0}


def test_many_bars_are_wider_and_turned(spark, tmp_path):
    for n, size in ((11, ("625.00", "450.00")), (16, ("750.00", "550.00")), (400, ("2000.00", "550.00"))):
        svg = drawn(C.bar_chart(spark.range(n).select(F.col("id").alias("key"), (F.col("id") + 1).alias("count")).repartition(5), ["key"], ""), tmp_path / str(n))
        assert (svg.get("width"), svg.get("height")) == size
        bars = svg.findall(f"{NS}rect")
        assert [int(b.get("data-key")) for b in bars] == list(range(n))
        xs = [float(b.get("x")) for b in bars]
        assert xs == sorted(xs) and xs[0] >= C.LEFT and xs[-1] + float(bars[-1].get("width")) <= float(size[0]) - C.RIGHT
        assert sum("rotate(-30" in (t.get("transform") or "") for t in svg.iter(f"{NS}text")) == (n if n >= C.TURNED else 0)


def test_charts_of_nothing_and_of_one_value(spark, tmp_path):
    none = spark.createDataFrame([], "key string, count long")
    assert not drawn(C.bar_chart(none, ["key"], "t"), tmp_path / "a").findall(f"{NS}rect")
    for i, (values, bins, curve) in enumerate((([], 0, 0), ([None], 0, 0), ([2.0, 2.0], 10, 0), ([1.0, 2.0, 4.0], 10, 1))):
        svg = drawn(C.histogram_chart(spark.createDataFrame([(v,) for v in values], "v double"), "v", "t"), tmp_path / f"h{i}")
        assert (len(svg.findall(f"{NS}rect")), len(svg.findall(f"{NS}path[@class='density']"))) == (bins, curve)
        assert sum(int(b.get("data-count")) for b in svg.findall(f"{NS}rect")) == len([v for v in values if v is not None])
    for i, (pairs, dots) in enumerate((([], 0), ([(1.0, None)], 0), ([(1.0, 2.0)], 1), ([(1.0, 2.0), (1.0, 3.0)], 2))):
        svg = drawn(C.regression_chart(spark.createDataFrame(pairs, "x double, y double"), "x", "y", F.lit(1), "t", points=3, resamples=5), tmp_path / f"r{i}")
        assert len(svg.findall(f"{NS}circle")) == dots


def test_density_and_band_lie_inside(spark, tmp_path):
    rows = spark.range(200).select("id", (F.col("id") % 13).cast("double").alias("x"), (F.col("id") % 13 * 2 + F.col("id") % 5).cast("double").alias("y"))
    svg = drawn(C.histogram_chart(rows, "x", "t"), tmp_path / "h")
    for chart, kinds in ((svg, ["density"]), (drawn(C.regression_chart(rows, "x", "y", F.col("id"), "t", points=20, resamples=40), tmp_path / "r"), ["low", "high", "fit"])):
        for kind in kinds:
            points = [tuple(map(float, p.strip("ML").split(","))) for p in chart.find(f"{NS}path[@class='{kind}']").get("d").split(" ")]
            assert len(points) in (20, 50) and [p[0] for p in points] == sorted(p[0] for p in points)
            assert all(C.LEFT - 0.01 <= x <= 900 - C.RIGHT + 0.01 and C.TOP - 0.01 <= y <= 600 - C.BOTTOM + 0.01 for x, y in points)
    low, fit, high = ([float(p.split(",")[1]) for p in chart.find(f"{NS}path[@class='{k}']").get("d").strip("M").split(" L")] for k in ("low", "fit", "high"))
    assert all(a >= b >= c for a, b, c in zip(low, fit, high, strict=True))  # y grows downwards
