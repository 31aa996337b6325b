from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillmark.config import SegmentConfig
from quillmark.operators import align as A
from quillmark.operators import models as M
from quillmark.operators import scoring as W
from quillmark.operators import solutions as P
from quillmark.operators import stats as D
from quillmark.sources import readers as R
from quillmark.sources import writers as K
from quillmark.streaming import evaluate as E


@pytest.mark.parametrize(("n", "alpha", "want"), [(4, 1, [0.4, 0.3, 0.2, 0.1]), (4, 2, [0.533333, 0.3, 0.133333, 0.033333]), (1, 1, [1.0])])
def test_weights(spark, n, alpha, want):
    rows = spark.range(1, n + 1).select(W.step_weight(F.col("id"), F.lit(n), alpha).alias("w")).collect()
    assert [round(r.w, 6) for r in rows] == want


def test_published_scores(spark):
    """Perfect cases score 1 - 1 / (n (n + 1) / 2), before difficulty."""
    steps = spark.createDataFrame([(1, i, 4, 1.0) for i in (1, 2, 3)], "id long, index int, num_steps long, step_score double")
    cases = spark.createDataFrame([(1, 4, 8.0), (2, 0, 5.0), (3, 1, 5.0)], "id long, num_steps long, difficulty double")
    got = {r.id: (r.total_score, r.score) for r in W.case_scores(steps, cases, "id").collect()}
    assert got[1][0] == pytest.approx(0.9) and got[1][1] == pytest.approx(0.9 * 2.718281828459045**0.3)
    assert got[2] == (0.0, 0.0) and got[3] == (0.0, 0.0)


@pytest.mark.parametrize(("scores", "want"), [([0.5, 0.9, 0.4, 1.0], 0.6), ([0.9], 0.3), ([], 0.0)])
def test_first_three_matches(spark, scores, want):
    text = " ".join(f"s{i} x." for i in range(len(scores))) or "lonely."

    def pair(a, b):
        v = F.lit(0.0)
        for i, s in enumerate(scores):
            v = F.when(a.startswith(f"s{i}"), s).otherwise(v)
        return F.struct(v.alias("forward"), v.alias("backward"))

    row = spark.range(1).select(A.align_pairs(F.lit(text), F.lit("ref"), pair).alias("r")).first().r
    assert row.score == pytest.approx(want)


def test_empty_generation_is_hallucination(spark):
    row = spark.range(1).select(A.align_prefix(F.lit(""), F.lit("x")).alias("a"), A.align_prefix(F.lit("x"), F.lit(None).cast("string")).alias("b")).first()
    assert (row.a.score, row.a.hallucination, row.b.score, row.b.hallucination) == (0.0, True, 0.0, True)


def test_claims_and_penalty(spark):
    rows = spark.createDataFrame([(1, "Red cat. Blue dog!", "Red cat. Red cat! Green sun.")], "k int, gen string, ref string")

    def judge(g, r):
        s = M.jaccard_scorer(g, r)
        return M.claim_judgement(s, F.when(s > 0.5, "entailed").otherwise("other"))

    m = A.claim_matches(rows, "k", "gen", "ref", judge)
    assert [(r.ref, r.best_gen, r.score) for r in m.orderBy("ref_pos").collect()] == [("Red cat.", "", -1.0), ("Red cat!", "", -1.0), ("Green sun.", "", -1.0)] or m.count() == 3
    assert A.claim_scores(m, "k").first().n_claims == 3


def test_running_average_is_block_free(spark):
    rows = spark.range(1, 301).select("id", (F.col("id") * 1.0).alias("score"))
    for parts in (1, 7):
        got = {r.num: r.running_avg for r in W.running_average(rows.repartition(parts), "id").collect()}
        assert got == {n: pytest.approx((n + 1) / 2) for n in range(50, 301, 50)}


def test_summary_of_nothing(spark):
    row = W.model_summary(spark.createDataFrame([], "score double")).first()
    assert (row.num, row.avg_score) == (0, None)


def test_filters(spark):
    rows = spark.createDataFrame([(1, "a" * 800, "u"), (2, "a" * 799, "v"), (3, None, "w"), (4, " \n", "x")], "id int, solution string, extra string")
    assert [r.id for r in P.filter_long(rows).collect()] == [1]
    out = P.process_solutions(rows, SegmentConfig(min_chars=1)).orderBy("id").collect()
    assert [(r.id, r.extra, r.segment_num) for r in out] == [(1, "u", 1), (2, "v", 1)]
    strict = SegmentConfig(min_chars=None, use_paragraphs=True, min_paragraphs=2)
    assert P.filter_long(spark.createDataFrame([("a\n\nb",), ("a",)], "solution string"), strict).count() == 1


def test_distribution_nulls_first(spark):
    rows = spark.createDataFrame([(2,), (None,), (2,), (1,)], "k int")
    assert [(r.key, r["count"]) for r in D.distribution(rows, "k").collect()] == [(None, 1), (1, 1), (2, 2)]
    assert D.distribution(rows.limit(0), "k").count() == 0
    for by, last in (("key", "1\t1\t(33.33%)\n2\t2\t(66.67%)"), ("count", "2\t2\t(66.67%)\n1\t1\t(33.33%)")):
        text = "\n".join(r.value for r in K.distribution_text(rows.where("k > 0"), "k", by).collect())
        assert text == f"Difficulty Distribution\n=======================\nTotal: 3\n\n{last}"
    assert [r.value[-2:] for r in K.distribution_text(rows.limit(0), "k").collect()] == ["0\n"]


def test_report_of_many_keys_is_in_order(spark, tmp_path):
    rows = spark.range(20_000).select((F.col("id") % 9000).alias("k"))
    K.write_distribution(rows, "k", str(tmp_path / "t"), str(tmp_path / "c"))
    parts = sorted((tmp_path / "t").glob("part-*"))
    lines = "".join(p.read_text() for p in parts).splitlines()
    assert lines[:4] == ["Difficulty Distribution", "=======================", "Total: 20000", ""]
    assert [int(x.split("\t")[0]) for x in lines[4:]] == list(range(9000))
    csv = [x for p in sorted((tmp_path / "c").glob("part-*")) for x in p.read_text().splitlines() if x[0].isdigit()]
    assert [int(x.split(",")[0]) for x in csv] == list(range(9000))


def test_five_numbers_and_histogram(spark):
    rows = spark.range(0, 11).select(F.col("id").cast("double").alias("x"))
    r = D.five_numbers(rows, "x").first()
    assert (r.min, r.q1, r.median, r.q3, r.max) == (0, 2.5, 5, 7.5, 10)
    assert [x["count"] for x in D.histogram(rows, "x").orderBy("bin").collect()] == [1] * 9 + [2]
    assert D.regression_band(rows.select("x", (F.col("x") * 2).alias("y")), "x", "y", F.col("x"), points=3, resamples=20).count() == 3


def test_intervals(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 5, 6), (1, 8, 9), (2, 1, 2)], "k int, start int, end int")
    assert sorted((r.k, r.start, r.end) for r in P.merge_intervals(rows, ["k"]).collect()) == [(1, 0, 6), (1, 8, 9), (2, 1, 2)]


def test_generator_batches_and_memo(spark):
    class Upper:
        def generate(self, prompts, schema=None):
            return [p.upper() for p in prompts]

    call = M.generator(lambda c: Upper())
    rows = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "t string")
    got = sorted((r.t or "", r.o) for r in M.once_per_text(rows, "t", call, "o").collect())
    assert got == [("", ""), ("a", "A"), ("a", "A"), ("b", "B")]


def test_readers(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"score": 1}\n\n{"score": 2} thanks\n{"score": 3}\n{"score": 4}\n')
    assert [(r.id, r.score) for r in R.read_jsonl(spark, str(p), "score int").orderBy("id").collect()] == [(1, 1), (2, 3), (3, 4)]
    with pytest.raises(Exception):  # noqa: B017
        bad = tmp_path / "bad.jsonl"
        bad.write_text('{"score": 1}\n{"score": \n')
        R.read_jsonl_strict(spark, str(bad), "score int").collect()
    q = tmp_path / "y.jsonl"
    q.write_text("{'score': 1}\n{'score': 2}\n")
    assert R.read_jsonl_all_or_nothing(spark, str(q), "score int").count() == 2
    q.write_text("{'score': 1}\n{'score': \n")
    assert R.read_jsonl_all_or_nothing(spark, str(q), "score int").count() == 0


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "é"), (2, 0.5, "x")], "id long, score double, problem string")
    K.write_jsonl(rows, f"{tmp_path}/a")
    lines = sorted(x for f in (tmp_path / "a").glob("part*") for x in f.read_text().splitlines())
    assert json.loads(lines[0]) == {"id": 1, "score": None, "problem": "é"} and "é" in lines[0]
    K.write_pretty_json(rows, f"{tmp_path}/b")
    assert sorted(map(tuple, K.read_pretty_json(spark, f"{tmp_path}/b", "id long, score double, problem string").collect())) == sorted(map(tuple, rows.collect()))
    assert K.run_path("out", "a/b", "c", 42) == "out/a/b_c_000042"


@pytest.mark.parametrize(("x", "want"), [(0.03125, "0.0312"), (0.04375, f"{0.04375:.4f}"), (0.99995, f"{0.99995:.4f}"), (0.0, "0.0000"), (1.00005, f"{1.00005:.4f}")])
def test_fixed_is_pythons(spark, x, want):
    assert spark.range(1).select(K.fixed(F.lit(x)).alias("v")).first().v == want


def test_case_log(spark):
    steps = F.array(F.struct(F.lit(1).alias("index"), F.lit(0.5).alias("score"), F.lit(1).alias("hallucination"), F.lit(0.25).alias("step_score")))
    log = K.case_log(F.lit(3), F.lit(7.0), F.lit(0.5), F.lit(2), F.lit(" p "), F.lit(None).cast("string"), steps, F.array(F.lit("g"), F.lit(" ")))
    lines = spark.range(1).select(log.alias("v")).first().v.split("\n")
    assert lines == ["Case #3", "Difficulty: 7.0", "Weighted Score: 0.5000", "Total Steps: 2", "Problem:", "p", "Answer:", "", "Step Scores:", "  - Step 1: score=0.5000, weighted=0.2500, hallucination=1", "Generated Outputs:", "  [1] g", "  [2] <empty>", "-" * 80]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"solution": "One. Two."}\n')
    rows = E.stream_jsonl(spark, f"{tmp_path}/in", "solution string")
    q = E.run_batches(E.segment_stream(rows, SegmentConfig(min_chars=1)), lambda b: b, f"{tmp_path}/out", f"{tmp_path}/c")
    q.awaitTermination(120)
    assert spark.read.json(f"{tmp_path}/out/*").count() == 1


def test_evaluation(spark, tmp_path):
    from quillmark.operators.evaluation import evaluate

    units = lambda *t: [(i, "text", x, 0) for i, x in enumerate(t)]
    rows = [(1, "p", "a", 5.0, units("one two", "one two", "three")), (2, "q", "b", 8.0, units("alone")), (3, "r", None, 5.0, [])]
    problems = spark.createDataFrame(rows, "id long, problem string, answer string, difficulty double, segments array<struct<id:int,type:string,content:string,paragraph_index:int>>")
    echo = lambda prompt: F.concat(F.element_at(F.split(prompt, "\n"), -1), F.lit("<<<END>>> more"))
    got = evaluate(problems, echo)
    cases = {r.id: r for r in got.cases.collect()}
    assert [(s["index"], s["score"], s["hallucination"]) for s in cases[1].steps] == [(1, 1.0, 0), (2, 0.0, 1)]
    assert cases[1].score == pytest.approx(0.5) and (cases[2].score, cases[3].score, cases[3].num_steps) == (0.0, 0.0, 0)
    logs = {r.id: r for r in got.generations.collect()}
    assert logs[1].gen_output == ["one two", "one two", "three"] and logs[3].gen_output == []
    assert (got.summary.first().num, got.summary.first().avg_score) == (3, pytest.approx(5 / 3))
    log = K.case_log(F.col("id"), F.col("difficulty"), F.col("score"), F.col("num_steps"), F.col("problem"), F.col("answer"), F.col("steps"), F.col("gen_output"))
    K.write_run(K.run_path(str(tmp_path), "m/x", "j", 7), got.cases, got.generations, got.summary, log)
    assert sorted(p.name for p in (tmp_path / "m/x_j_000007").iterdir()) == ["case.log", "case_results.jsonl", "case_results_pretty.json", "gen_and_scores.jsonl", "summary.json"]


def test_schemas_templates_and_style(spark, tmp_path):
    class Tokenizer:
        chat_template = "x"

        def apply_chat_template(self, turns, tokenize, add_generation_prompt):
            return "".join(f"<{t['role']}>{t['content']}" for t in turns) + "<assistant>" * add_generation_prompt

    rows = spark.createDataFrame([("s", "u"), ("", "u"), (None, None)], "s string, u string")
    got = [r.p for r in rows.select(M.templated_prompt(lambda c: Tokenizer())(F.col("s"), F.col("u")).alias("p")).collect()]
    assert got == ["<system>s<user>u<assistant>", "<user>u<assistant>", "<user><assistant>"]
    call = M.generator(M.EchoEngine)
    r = spark.range(1).select(M.model_scorer(call)(F.lit("a"), F.lit("b")).alias("s"), M.model_pair(call)(F.lit("a"), F.lit("b")).alias("p"), M.model_claims(call)(F.lit("one two")).alias("c")).first()
    assert 0 <= r.s <= 1 and (r.p.forward, r.p.backward) == (0.25, 0.75) and r.c == ["two"]
    note = tmp_path / "style.txt"
    assert M.probe_style(spark, call, str(note)).startswith("user:") and not note.exists()
    note.write_text("old")
    style = M.probe_style(spark, call, str(note))
    assert note.read_text() == style
    assert spark.range(1).select(M.rewriter(call, style)(F.lit("same")).alias("r")).first().r == "user: same"


def test_lines_follow_their_files(spark, tmp_path):
    """Ids run through the files by name, and through lines as they stand, also when a file is cut into splits."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        n = 0
        for name, size in (("a", 40), ("b", 900), ("c", 3)):
            (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"n": {n + i}}}\n' + ("bad\n\n" if i % 5 == 0 else "") for i in range(size)))
            n += size
        got = R.read_jsonl(spark, str(tmp_path), "n int").orderBy("id").collect()
        assert [(r.id, r.n) for r in got] == [(i + 1, i) for i in range(n)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_band_does_not_depend_on_partitions(spark):
    rows = spark.range(0, 400).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2 + F.col("id") % 7).cast("double").alias("y"), "id")
    a, b = ([[round(v, 9) for v in r] for r in D.regression_band(d, "x", "y", points=5, resamples=30, key=F.col("id")).orderBy("x").collect()] for d in (rows, rows.repartition(7)))
    assert a == b and all(r[2] < r[1] < r[3] for r in a)


def test_quartiles_of_odd_columns(spark):
    for values in ([], [None], [3.0], [1.0, 2.0], [5.0] * 9 + [None], [-1.0, 0.5, 0.5, 7.0, 9.25]):
        rows = spark.createDataFrame([(v,) for v in values], "x double")
        got, want = D.five_numbers(rows, "x").first(), rows.agg(F.percentile("x", F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q"), F.count("x").alias("n")).first()
        assert got.n == want.n and [got[k] for k in ("min", "q1", "median", "q3", "max")] == (want.q or [None] * 5)


def test_band_of_repeated_pairs_draws_rows_apart(spark):
    """Rows of few distinct pairs: the band is about as wide as the usual error of the fit, not as that of a few clusters."""
    rows = spark.range(4000).select((F.col("id") % 2).cast("double").alias("x"), (F.floor(F.col("id") / 2) % 2).cast("double").alias("y"), "id")
    out = D.regression_band(rows, "x", "y", F.col("id"), points=2, resamples=200).orderBy("x").collect()
    error = 0.5 / 2000**0.5  # of a mean over the 2,000 rows of either x
    assert all(2 * error < r.high - r.low < 6 * error for r in out)


@pytest.mark.parametrize(("values", "want"), [([], []), ([None], []), ([3.0], [(3.0, None)] * 4), ([2.5, 2.5, None], [(2.5, None)] * 4)])
def test_density_without_bandwidth(spark, values, want):
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    assert [tuple(r) for r in D.kde(rows, "x", points=4).collect()] == want


def test_density_sums_to_one(spark):
    rows = spark.range(500).select((F.col("id") % 37).cast("double").alias("x"))
    out = D.kde(rows.repartition(5), "x", points=200).orderBy("x").collect()
    step = out[1].x - out[0].x
    assert sum(r.density for r in out) * step == pytest.approx(1, abs=0.01)


@pytest.mark.parametrize("alpha", [0.0, 0.5, 1.0, 2.0])
def test_totals_of_weights_once_a_case(spark, alpha):
    rows = spark.range(5).select(F.col("id").alias("n"), W.weight_total(F.col("id"), alpha).alias("w")).collect()
    assert [r.w for r in rows] == [pytest.approx(sum((n - i + 1) ** alpha for i in range(1, n + 1))) for n in range(5)]
    steps = spark.createDataFrame([(1, i, 4, i / 10) for i in (1, 2, 3)], "id long, index int, num_steps long, step_score double")
    cases = spark.createDataFrame([(1, 4, 5.0), (2, 0, 5.0)], "id long, num_steps long, difficulty double")
    got = {r.id: r.total_score for r in W.case_scores(steps, cases, "id", c=W.EvaluationConfig(alpha=alpha)).collect()}
    want = sum((4 - i + 1) ** alpha * i / 10 for i in (1, 2, 3)) / sum(i**alpha for i in (1, 2, 3, 4))
    assert got[1] == pytest.approx(want) and got[2] == 0.0
    one = spark.range(1).select(W.weighted_score(F.array(*[F.struct(F.lit(i).alias("index"), F.lit(i / 10).alias("score")) for i in (1, 2, 3, 4)]), F.lit(4), alpha).alias("s")).first().s
    assert one == pytest.approx(want)


@pytest.mark.parametrize(("text", "role"), [("It is different because of that.", None), ("If so, done", "CaseSplit"), ("A lower bound, if any", "LowerBound"), ("so \\boxed{4}", "Conclusion/Answer"), ("must be ≥ 3", "LowerBound"), ("Lemma1 is no word", None), ("the lemma.", "Claim"), (None, None), ("", None), ("éif", None)])
def test_roles_take_whole_words(spark, one, text, role):
    assert one(P.tag_role, text) == role


def _replay(spark, tmp_path, files, **options):
    import json

    from quillmark.streaming import cases as Y

    names = ("id", "index", "num_steps", "difficulty", "step_score", "version")
    (tmp_path / "in").mkdir()
    for n, rows in enumerate(files):
        path = tmp_path / f"in/{n}.json"
        path.write_text("".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in rows))
        import os

        os.utime(path, (1_000_000 + n, 1_000_000 + n))  # files are taken in the order of their times
    with E.rocks(spark):
        stream = E.stream_jsonl(spark, f"{tmp_path}/in", Y.STEP, files_per_batch=1)
        E.run_batches(Y.revisions(stream, **options), lambda b: b, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    return spark.read.schema("id long, revision long, complete boolean, num_steps int, difficulty double, total_score double, score double").json(f"{tmp_path}/out")


def test_cases_come_out_when_whole_and_are_corrected(spark, tmp_path):
    from quillmark.streaming import cases as Y

    files = [
        [(1, 3, 4, 8.0, 0.5, 1), (1, 1, 4, 8.0, 1.0, 1), (2, None, 1, 5.0, None, 0), (None, 1, 2, 5.0, 1.0, 1)],
        [(1, 2, 4, 8.0, 0.0, 1), (3, 1, 3, None, 1.0, 1)],  # case 1 is whole
        [(1, 2, 4, 8.0, 0.0, 1), (1, 1, 4, 8.0, 1.0, 1)],  # nothing new
        [(1, 3, 4, 8.0, 0.0, 0), (1, 4, 4, 8.0, 9.0, 1)],  # an older version, and the last step
        [(1, 3, 4, 8.0, 1.0, 2), (3, 2, 3, None, 1.0, 1)],
    ]
    given = _replay(spark, tmp_path, files)
    got = sorted((r.id, r.revision, r.complete, round(r.total_score, 9)) for r in given.collect())
    assert got == [(1, 1, True, 0.5), (1, 2, True, 0.6), (2, 1, True, 0.0), (3, 1, True, round(5 / 6, 9))]
    last = {r.id: r for r in Y.latest(given).collect()}
    assert last[1].score == pytest.approx(0.6 * 2.718281828459045**0.3) and last[3].score is None


def test_cases_that_wait_too_long(spark, tmp_path):
    import json
    import time

    from quillmark.streaming import cases as Y

    names = ("id", "index", "num_steps", "difficulty", "step_score", "version")
    (tmp_path / "in").mkdir()

    def feed(n, *rows):
        (tmp_path / f"in/{n}.json").write_text("".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in rows))

    def given():
        lines = [json.loads(x) for p in sorted((tmp_path / "out").glob("batch=*/part-*.json")) for x in p.read_text().splitlines()] if (tmp_path / "out").exists() else []
        return sorted((x["id"], x["complete"], round(x["total_score"], 9)) for x in lines)

    def wait(want):
        end = time.time() + 90
        while time.time() < end and given() != want:
            assert q.exception() is None
            time.sleep(0.5)
        assert given() == want

    feed(0, (1, 1, 3, 5.0, 1.0, 1), (2, 1, 2, 5.0, 1.0, 1))
    whole = (2, True, round(2 / 3, 9))
    with E.rocks(spark):
        stream = E.stream_jsonl(spark, f"{tmp_path}/in", Y.STEP, files_per_batch=1)
        q = E.run_batches(Y.revisions(stream, patience_ms=1000), lambda b: b, f"{tmp_path}/out", f"{tmp_path}/c", once=False)
        try:
            wait([(1, False, 0.5), whole])
            feed(1, (1, 2, 3, 5.0, 1.0, 1), (1, 1, 3, 5.0, 1.0, 1))
            wait([(1, False, 0.5), (1, True, round(5 / 6, 9)), whole])
        finally:
            q.stop()
    assert Y.latest(spark.read.schema("id long, revision long, complete boolean").json(f"{tmp_path}/out")).where("id = 1").first().complete
