"""Charts as SVG, drawn by column expressions from rows that are aggregated already.

A chart is a table of lines in order: the frame, a line for each mark, the end.
Places follow from the rows' ranks and the greatest value, so no task gathers
the marks; written as text, the part files in order of their names are the file.
Marks carry what they stand for in ``data-`` attributes, so charts can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import stats as D
from quillmark.sources.readers import numbered
from quillmark.sources.writers import fixed

DPI = 100
LEFT, RIGHT, TOP, BOTTOM = 60.0, 20.0, 40.0, 60.0
#: From so many bars on, their names are turned.
TURNED = 12

_LINE = "part int, place bigint, value string"


def size(n: Column) -> tuple[Column, Column]:
    """Width and height in pixels: 6 by 4.5 inches, wider by a quarter of an inch for each bar beyond 10, to 20, and taller beyond 15 bars."""
    width = F.least(6.0 + F.greatest(n - 10, F.lit(0)) * 0.25, F.lit(20.0))
    return width * DPI, F.when(n <= 15, 4.5).otherwise(5.5) * DPI


def escaped(x: Column) -> Column:
    """Text as XML has it, in an attribute or between tags."""
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(raw), F.lit(name))
    return F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "�")


def unescaped(x: Column) -> Column:
    for raw, name in (('"', "&quot;"), (">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        x = F.replace(x, F.lit(name), F.lit(raw))
    return x


def _px(x: Column) -> Column:
    return fixed(x, 2)


def _line(part: int, place: Column, *pieces: Column | str) -> list[Column]:
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])
    return [F.lit(part).alias("part"), place.cast("long").alias("place"), text.alias("value")]


def _frame(about: DataFrame, width: Column, height: Column, title: str, xlabel: str, ylabel: str) -> DataFrame:
    """First lines of a chart; ``about`` has one row."""
    at = escaped(F.lit(title)), escaped(F.lit(xlabel)), escaped(F.lit(ylabel))
    w, h = _px(width), _px(height)
    pieces = [
        F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), w, F.lit('" height="'), h, F.lit('" font-family="sans-serif" font-size="11">\n'),
        F.lit('<text class="title" text-anchor="middle" font-size="14" x="'), _px(width / 2), F.lit('" y="20">'), at[0], F.lit("</text>\n"),
        F.lit('<text class="xlabel" text-anchor="middle" x="'), _px(width / 2), F.lit('" y="'), _px(height - 8), F.lit('">'), at[1], F.lit("</text>\n"),
        F.lit('<text class="ylabel" text-anchor="middle" transform="rotate(-90)" x="'), _px(-height / 2), F.lit('" y="16">'), at[2], F.lit("</text>\n"),
        F.lit(f'<path class="axes" fill="none" stroke="black" d="M{LEFT:.2f},{TOP:.2f} V'), _px(height - BOTTOM), F.lit(" H"), _px(width - RIGHT), F.lit('"/>'),
    ]
    return about.select(*_line(0, F.lit(0), *pieces))


def _whole(*parts: DataFrame) -> DataFrame:
    """All lines of a chart in order."""
    spark = parts[0].sparkSession
    out = spark.createDataFrame([(9, 0, "</svg>")], _LINE)
    for p in parts:
        out = out.unionAll(p.select("part", "place", "value"))
    return out.orderBy("part", "place").select("value")


def bar_chart(counts: DataFrame, order: list[str], title: str, xlabel: str = "", ylabel: str = "Count", key: str = "key", count: str = "count") -> DataFrame:
    """Bars of ``counts(key, count)`` in the order of the columns ``order``, each with its name and count; from 12 bars on names are turned.

    Counts below 0 or null are drawn as 0; without rows only the frame is there.
    """
    names = escaped(F.coalesce(F.col(key).cast("string"), F.lit("None")))
    rows = counts.select(names.alias("__name"), F.greatest(F.coalesce(F.col(count), F.lit(0)), F.lit(0)).cast("double").alias("__count"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)])
    ranked = numbered(rows, [f"__o{i}" for i in range(len(order))] + ["__name"], "__rank")
    about = ranked.agg(F.count("*").alias("n"), F.coalesce(F.max("__count"), F.lit(0.0)).alias("most"))
    width, height = size(F.col("n"))
    plot_w, plot_h = width - LEFT - RIGHT, height - TOP - BOTTOM
    each = ranked.crossJoin(F.broadcast(about))  # one row
    step = plot_w / F.col("n")
    x = F.lit(LEFT) + step * (F.col("__rank") - 1) + step * 0.1
    tall = F.coalesce(F.try_divide(F.col("__count"), F.col("most")), F.lit(0.0)) * plot_h * 0.95
    y, middle, foot = height - BOTTOM - tall, x + step * 0.4, height - BOTTOM + 14
    shown = F.when(F.col("__count") == F.floor("__count"), F.floor("__count").cast("string")).otherwise(F.col("__count").cast("string"))
    turned = F.when(F.col("n") >= TURNED, F.concat(F.lit('" text-anchor="end" transform="rotate(-30 '), _px(middle), F.lit(" "), _px(foot), F.lit(")"))).otherwise(F.lit('" text-anchor="middle'))
    bars = each.select(*_line(
        1, F.col("__rank"),
        '<rect class="bar" data-key="', F.col("__name"), '" data-count="', shown, '" x="', _px(x), '" y="', _px(y), '" width="', _px(step * 0.8), '" height="', _px(tall), '" fill="steelblue" stroke="black" stroke-width="0.6"/>',
        '<text x="', _px(middle), '" y="', _px(y - 3), '" text-anchor="middle" font-size="8">', shown, "</text>",
        '<text x="', _px(middle), '" y="', _px(foot), turned, '">', F.col("__name"), "</text>",
    ))
    return _whole(_frame(about, width, height, title, xlabel, ylabel), bars)


def _curve(points: DataFrame, kind: str, x: Column, y: Column, color: str, part: int) -> DataFrame:
    """One path through all ``points(i)``, a grid of fixed size, in order."""
    at = F.concat(_px(x), F.lit(","), _px(y))
    path = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", at.alias("p")))), lambda s: s["p"]), " L")
    return points.agg(path.alias("d"), F.count("*").alias("n")).where("n > 0").select(*_line(part, F.lit(0), f'<path class="{kind}" fill="none" stroke="{color}" stroke-width="2" d="M', F.col("d"), '"/>'))


def histogram_chart(rows: DataFrame, x: str, title: str, xlabel: str = "", ylabel: str = "Frequency", bins: int = 10, points: int = 50) -> DataFrame:
    """Equal bins of a column, with its density scaled to counts; a column without values gives only the frame, one value no density."""
    hist = D.histogram(rows, x, bins).where("low IS NOT NULL").withColumn("__width", F.col("high") - F.col("low"))
    width, height = 9.0 * DPI, 6.0 * DPI
    plot_w, plot_h = width - LEFT - RIGHT, height - TOP - BOTTOM
    density = D.kde(rows, x, points, cut=0.0).where("density IS NOT NULL")
    bounds = hist.agg(F.min("low").alias("lo"), F.max("high").alias("hi"), F.max("count").cast("double").alias("most"), F.sum("count").alias("n"), F.max("__width").alias("w"))
    top = density.agg(F.coalesce(F.max("density"), F.lit(0.0)).alias("peak"))
    about = bounds.crossJoin(F.broadcast(top)).select("lo", "hi", "w", "n", F.greatest("most", F.col("peak") * F.col("n") * F.col("w")).alias("most"))  # one row each

    def place(v: Column) -> Column:
        return F.lit(LEFT) + F.coalesce(F.try_divide(v - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.5)) * plot_w

    def height_of(v: Column) -> Column:
        return F.coalesce(F.try_divide(v, F.col("most")), F.lit(0.0)) * plot_h * 0.95

    each = hist.crossJoin(F.broadcast(about.select("lo", "hi", "most")))  # one row
    left = F.lit(LEFT) + F.col("bin") * (plot_w / bins)
    tall = height_of(F.col("count").cast("double"))
    bars = each.select(*_line(
        1, F.col("bin"),
        '<rect class="bin" data-key="', F.col("bin").cast("string"), '" data-low="', F.col("low").cast("string"), '" data-high="', F.col("high").cast("string"), '" data-count="', F.col("count").cast("string"),
        '" x="', _px(left), '" y="', _px(F.lit(height - BOTTOM) - tall), f'" width="{plot_w / bins:.2f}" height="', _px(tall), '" fill="orange" fill-opacity="0.6" stroke="black"/>',
    ))
    ticks = about.where("lo IS NOT NULL").select(F.explode(F.array("lo", "hi")).alias("v"), "lo", "hi")
    names = ticks.select(*_line(2, F.when(F.col("v") == F.col("lo"), 0).otherwise(1), '<text text-anchor="middle" x="', _px(place(F.col("v"))), f'" y="{height - BOTTOM + 14:.2f}">', F.col("v").cast("string"), "</text>"))
    grid = density.withColumn("i", F.col("x")).crossJoin(F.broadcast(about))  # one row
    curve = _curve(grid, "density", place(F.col("x")), F.lit(height - BOTTOM) - height_of(F.col("density") * F.col("n") * F.col("w")), "black", 3)
    return _whole(_frame(about, F.lit(width), F.lit(height), title, xlabel, ylabel), bars, names, curve)


def regression_chart(rows: DataFrame, x: str, y: str, key: Column, title: str, xlabel: str = "", ylabel: str = "", points: int = 100, resamples: int = 200) -> DataFrame:
    """Every pair as a dot, the line of least squares and its bootstrap band; ``key`` as in ``regression_band``."""
    pairs = rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), key.alias("k")).where("x IS NOT NULL AND y IS NOT NULL")
    band = D.regression_band(pairs, "x", "y", F.col("k"), points, resamples).where("low IS NOT NULL")
    width, height = 9.0 * DPI, 6.0 * DPI
    own = pairs.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    more = band.agg(F.min("low").alias("b0"), F.max("high").alias("b1"))
    about = own.crossJoin(F.broadcast(more)).select("x0", "x1", F.least("y0", "b0").alias("y0"), F.greatest("y1", "b1").alias("y1"))  # one row each

    def at(v: Column, lo: str, hi: str, start: float, length: float) -> Column:
        return F.lit(start) + F.coalesce(F.try_divide(v - F.col(lo), F.col(hi) - F.col(lo)), F.lit(0.5)) * length

    def across(v: Column) -> Column:
        return at(v, "x0", "x1", LEFT, width - LEFT - RIGHT)

    def up(v: Column) -> Column:
        return at(v, "y0", "y1", height - BOTTOM, -(height - TOP - BOTTOM))

    dots = numbered(pairs.select("x", "y"), ["x", "y"], "rank").crossJoin(F.broadcast(about))  # one row
    marks = dots.select(*_line(1, F.col("rank"), '<circle class="dot" data-x="', F.col("x").cast("string"), '" data-y="', F.col("y").cast("string"), '" cx="', _px(across(F.col("x"))), '" cy="', _px(up(F.col("y"))), '" r="4" fill="purple" fill-opacity="0.7"/>'))
    grid = band.withColumn("i", F.col("x")).crossJoin(F.broadcast(about))  # one row
    curves = [_curve(grid, kind, across(F.col("x")), up(F.col(c)), color, part) for part, (kind, c, color) in enumerate((("low", "low", "pink"), ("high", "high", "pink"), ("fit", "fit", "red")), 2)]
    return _whole(_frame(about, F.lit(width), F.lit(height), title, xlabel, ylabel), marks, *curves)


def write_chart(chart: DataFrame, path: str) -> None:
    """A folder of text parts; in order of their names they are the SVG."""
    chart.write.mode("overwrite").text(path)


def read_marks(spark: SparkSession, path: str, kind: str = "bar") -> DataFrame:
    """(key, count, x, y, width, height) of the bars or bins of a chart that was written."""
    lines = spark.read.text(path).where(F.col("value").contains(f'<rect class="{kind}" '))

    def attribute(name: str) -> Column:
        return F.regexp_extract("value", f' {name}="([^"]*)"', 1)

    return lines.select(unescaped(attribute("data-key")).alias("key"), attribute("data-count").cast("double").alias("count"), *[attribute(n).cast("double").alias(n) for n in ("x", "y", "width", "height")])
