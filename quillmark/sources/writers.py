"""Writers of records, logs, summaries and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import flatten_to_string, to_atom
from quillmark.operators.stats import distribution

RULE = "-" * 80


def fixed(x: Column, digits: int = 4) -> Column:
    """A number with so many decimals, rounded from its exact binary value, ties to even, as Python formats it.

    Java's formatter rounds the shortest decimal form instead.  The error of
    the scaling product is computed exactly, so ties are told apart.
    """
    scale = 10.0**digits
    a = F.abs(x.cast("double"))
    p = a * scale
    high = a * 134217729.0 - (a * 134217729.0 - a)
    error = (high * scale - p) + (a - high) * scale
    whole = F.floor(p)
    rest = p - whole
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    n = whole + F.when(up, 1).otherwise(0)
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.format_string(f"%.{digits}f", n / scale))


def write_jsonl(rows: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON object a line; null fields stay, text is not escaped to ASCII."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_pretty_json(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Indented objects with a blank line between them."""
    rows.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).write.mode(mode).option("lineSep", "\n\n").text(path)


def read_pretty_json(spark, path: str, schema: str) -> DataFrame:
    from quillmark.sources.readers import _ddl

    text = spark.read.option("lineSep", "\n\n").text(path).where("trim(value) <> ''")
    return text.select(F.from_json("value", f"struct<{_ddl(schema)}>").alias("r")).select("r.*")


def case_log(id_: Column, difficulty: Column, score: Column, num_steps: Column, problem: Column, answer: Column, steps: Column, generations: Column, depth: int = 0) -> Column:
    """A readable log of one case.  ``generations`` is an array of texts, or of arrays nested ``depth`` deep."""

    def step(s: Column) -> Column:
        return F.format_string("  - Step %d: score=%s, weighted=%s, hallucination=%d", s["index"], fixed(s["score"]), fixed(F.coalesce(s["step_score"], s["score"])), s["hallucination"])

    def generation(g: Column, i: Column) -> Column:
        text = flatten_to_string(g, depth) if depth else to_atom(g)
        return F.concat(F.lit("  ["), (i + 1).cast("string"), F.lit("] "), F.coalesce(F.nullif(text, F.lit("")), F.lit("<empty>")))

    def or_note(lines: Column, note: str) -> Column:
        return F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit(note)))

    head = F.array(
        F.concat(F.lit("Case #"), F.coalesce(id_.cast("string"), F.lit("?"))),
        F.concat(F.lit("Difficulty: "), F.coalesce(difficulty.cast("string"), F.lit("?"))),
        F.concat(F.lit("Weighted Score: "), fixed(F.coalesce(score, F.lit(0.0)))),
        F.concat(F.lit("Total Steps: "), F.coalesce(num_steps, F.lit(0)).cast("string")),
        F.lit("Problem:"), to_atom(problem), F.lit("Answer:"), to_atom(answer), F.lit("Step Scores:"),
    )
    lines = F.concat(head, or_note(F.transform(steps, step), "  <no step scores>"), F.array(F.lit("Generated Outputs:")), or_note(F.transform(generations, generation), "  <no generation recorded>"), F.array(F.lit(RULE)))
    return F.array_join(lines, "\n")


def write_case_log(rows: DataFrame, log: Column, path: str, mode: str = "append") -> None:
    rows.select(log.alias("value")).write.mode(mode).text(path)


def run_path(base: str, reasoning: str, judge: str, run_id: int) -> str:
    """The folder of one run; slashes in model names nest folders."""
    return f"{base.rstrip('/')}/{reasoning}_{judge}_{run_id:06d}"


def write_run(base: str, cases: DataFrame, generations: DataFrame, summary: DataFrame, log: Column) -> None:
    """The five outputs of a run, each a folder of part files."""
    write_jsonl(cases, f"{base}/case_results.jsonl")
    write_pretty_json(cases, f"{base}/case_results_pretty.json")
    write_jsonl(generations, f"{base}/gen_and_scores.jsonl")
    write_case_log(cases.join(generations.select("id", "gen_output"), "id"), log, f"{base}/case.log")
    write_jsonl(summary, f"{base}/summary.json")


def distribution_csv(rows: DataFrame, key: str, by: str = "key") -> DataFrame:
    """difficulty, count, percentage with four decimals."""
    return distribution(rows, key, by).select(F.col("key").alias("difficulty"), "count", fixed(F.col("percentage")).alias("percentage"))


def distribution_text(rows: DataFrame, key: str, by: str = "key") -> DataFrame:
    """The lines of the report in order: a title, the total, and a line for each key, however many there are."""
    d = distribution(rows, key, by)
    line = F.format_string("%s\t%d\t(%s%%)", F.col("key").cast("string"), "count", fixed(F.col("percentage"), 2))
    first = -F.col("count") if by != "key" else F.lit(0).cast("long")
    body = d.select(F.lit(1).alias("part"), first.alias("first"), F.col("key"), line.alias("value"))
    total = F.concat(F.lit("Difficulty Distribution\n=======================\nTotal: "), F.coalesce(F.sum("count"), F.lit(0)).cast("string"), F.lit("\n"))
    head = d.agg(total.alias("value")).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("first"), F.lit(None).cast(d.schema["key"].dataType).alias("key"), "value")
    return head.unionAll(body).orderBy("part", "first", "key").select("value")


def write_distribution(rows: DataFrame, key: str, text_path: str, csv_path: str, by: str = "key") -> None:
    """Both as folders of part files whose names follow the order of the rows."""
    distribution_text(rows, key, by).write.mode("overwrite").text(text_path)
    distribution_csv(rows, key, by).write.mode("overwrite").option("header", True).csv(csv_path)


def stats_text(stats: DataFrame) -> DataFrame:
    """Four labelled lines from ``head_stats``."""
    names = {"avg_score": "Average score", "score_variance": "Score variance", "avg_difficulty": "Average difficulty", "difficulty_variance": "Difficulty variance"}
    return stats.select(F.concat_ws("\n", *[F.concat(F.lit(f"{label} for the first 25 cases: "), F.col(c).cast("string")) for c, label in names.items()]).alias("value"))
