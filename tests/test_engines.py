"""Engines on devices, and answers that outlive a run."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillmark.config import ModelConfig
from quillmark.operators import models as M
from quillmark.operators.memo import Memo

ROOT = Path(__file__).resolve().parent.parent

CLUSTER = """
import json, os, sys
from pyspark.sql import SparkSession, functions as F
from quillmark.config import ModelConfig
from quillmark.operators import models as M

def make(config):
    class Engine:
        def generate(self, prompts, schema=None):
            import time
            time.sleep(0.3)
            return [f"{config.devices}|{os.environ.get('CUDA_VISIBLE_DEVICES')}|{os.getpid()}" for _ in prompts]
    return Engine()

spark = SparkSession.builder.getOrCreate()
rows = spark.range(0, 32, 1, 8).select("id", F.array("id").alias("kept"), F.lit("old").alias("said"))
for profile in (M.device_profile(1), None):
    out = M.answers(rows, F.col("id").cast("string"), make, ModelConfig(devices="7,8"), "said", profile=profile).collect()
    print("SAID " + json.dumps([[r.id, r.kept, r.said] for r in out]))
"""


def test_tasks_of_a_model_stage_see_their_devices(tmp_path):
    """Two executors with two devices each: every task has one of its own executor's; tasks without a profile that asks for devices run as configured."""
    import json

    import pyspark

    script = tmp_path / "found.sh"
    script.write_text("""#!/bin/sh\necho '{"name": "gpu", "addresses": ["0", "1"]}'\n""")
    script.chmod(0o755)
    (tmp_path / "run.py").write_text(CLUSTER)
    conf = {
        "spark.master": "local-cluster[2,2,1024]", "spark.executor.memory": "512m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1",
        "spark.worker.resource.gpu.amount": "2", "spark.worker.resource.gpu.discoveryScript": str(script), "spark.executor.resource.gpu.amount": "2", "spark.task.resource.gpu.amount": "0.5",
    }
    home = os.path.dirname(pyspark.__file__)
    env = os.environ | {
        "PYTHONPATH": str(ROOT), "PYSPARK_PYTHON": sys.executable, "SPARK_HOME": home, "SPARK_SCALA_VERSION": "2.13", "SPARK_WORKER_DIR": str(tmp_path / "work"), "SPARK_LOCAL_IP": "127.0.0.1",
        "PYSPARK_SUBMIT_ARGS": " ".join(f"--conf {k}={v}" for k, v in conf.items()) + " pyspark-shell",
    }
    done = subprocess.run([sys.executable, str(tmp_path / "run.py")], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    said = [json.loads(x[5:]) for x in done.stdout.splitlines() if x.startswith("SAID ")]
    assert len(said) == 2, done.stderr[-3000:]
    for out in said:
        assert sorted(r[0] for r in out) == list(range(32)) and all(r[1] == [r[0]] for r in out)
        devices = [r[2].split("|") for r in out]
        assert all(d[0] == d[1] for d in devices)
    assert {r[2].split("|")[0] for r in said[0]} == {"0", "1"}


def test_answers_without_devices(spark):
    def tell(config):
        class Engine:
            def generate(self, prompts, schema=None):
                return [f" {config.devices or '-'}:{config.name}:{len(p)}:{schema is not None} " for p in prompts]

        return Engine()

    rows = spark.createDataFrame([(1, "a", [1]), (2, None, None), (3, "ccc" * 50, [])], "i int, t string, l array<int>")
    out = M.answers(rows, F.col("t"), tell, ModelConfig(name="x", batch_size=2), schema={}).orderBy("i").collect()
    assert [(r.i, r.l, r.answer) for r in out] == [(1, [1], "-:x:1:True"), (2, None, "-:x:0:True"), (3, [], "-:x:150:True")]
    named = M.answers(rows, F.col("t"), tell, ModelConfig(name="x", devices="2,3"), out="t").orderBy("i").collect()
    assert named[0].t == "2,3:x:1:False" and named[0].asDict().keys() == {"i", "l", "t"}
    again = rows.select("i", M.generator(tell, ModelConfig(name="x"))(F.col("t")).alias("t")).orderBy("i").collect()
    assert again[0].t == "-:x:1:False"  # an engine of other devices is another engine
    assert M.answers(rows.limit(0), F.col("t"), tell).collect() == []


def counting(folder):
    """Answers with the number of calls so far; a file for every text that was asked."""

    def call(x):
        @F.udf("string")
        def run(t):
            import uuid

            (Path(folder) / uuid.uuid4().hex).write_text(str(t))
            return f"<{t}>"

        return run(x)

    return call


def asked(folder):
    out = sorted(p.read_text() for p in folder.iterdir())
    for p in folder.iterdir():
        p.unlink()
    return out


@pytest.fixture
def desk(spark, tmp_path):
    (tmp_path / "asked").mkdir()

    def ask(texts, keep=5000, runs=16, model="m"):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        out = Memo(spark, str(tmp_path / "memo"), model, keep, runs).answer(rows, "t", counting(tmp_path / "asked"), "said").orderBy("i").collect()
        assert [r.said for r in out] == [f"<{t}>" for t in texts]
        return asked(tmp_path / "asked")

    ask.path = tmp_path
    return ask


def test_a_second_run_asks_nothing(desk):
    assert desk(["b", "a", "b", None, "", "a"]) == ["", "None", "a", "b"]
    assert desk(["a", None, "", "b", "b"]) == []
    assert desk(["a", "c"]) == ["c"]
    assert desk(["a"], model="other") == ["a"]
    assert desk([]) == []


def test_the_least_recently_used_goes(desk):
    assert desk(["a", "b"], keep=2) == ["a", "b"]
    assert desk(["a"], keep=2) == []
    assert desk(["c"], keep=2) == ["c"]  # b is forgotten
    assert desk(["a"], keep=2) == []
    assert desk(["b"], keep=2) == ["b"]  # c is forgotten
    assert desk(["c", "a"], keep=2) == ["c"]
    assert desk(["a", "b", "c"], keep=None) == []  # nothing is deleted before the memo is compacted


def test_runs_are_written_as_one(desk):
    for t in "abcdef":
        desk([t], keep=3, runs=3)
    base = next((desk.path / "memo").iterdir())
    assert all(len(list((base / n).glob("run-*"))) < 3 for n in ("uses", "answers"))
    assert desk(["d", "e", "f"], keep=3, runs=3) == []
    assert desk(["a"], keep=3, runs=3) == ["a"]


def test_a_run_that_failed_is_repeated(desk, spark):
    desk(["a"])

    def broken(x):
        return F.raise_error(F.concat(F.lit("no engine"), x))

    rows = spark.createDataFrame([("a",), ("z",)], "t string")
    with pytest.raises(Exception, match="no engine"):
        Memo(spark, str(desk.path / "memo"), "m").answer(rows, "t", broken, "said")
    assert desk(["a", "z"]) == ["z"]
