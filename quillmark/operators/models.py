"""Model calls as columns: prompts, scorers and generators that can be plugged in.

A scorer maps two text columns to a score, a generator maps prompts to texts.
The defaults are deterministic stand-ins made of JVM expressions; real models
run in Arrow batches with one engine per Python worker.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import replace
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quillmark.config import ModelConfig
from quillmark.functions import jsonrepair as J
from quillmark.functions import text as T
from quillmark.session import ship

Scorer = Callable[[Column, Column], Column]

CONTINUE = "Continue the solution below with the next step only. At most 18 lines and 400 words. Write <<<END>>> when the step is complete."
JUDGE = 'Does the candidate step entail the reference step? Answer with {"score": x}, x from 0 to 1, and nothing after it.'
PAIR = "Score how far the first text entails the second and the second the first. Answer with [forward, backward], each from 0 to 1."
CLAIMS = 'List the propositions of the text, at most 80 characters each. Answer with {"segments": [{"id": 1, "text": "..."}]}.'
REWRITE = "Rewrite the text in this style without a change of content."


PROBE = "Describe the style in which you write mathematics: tone, length of sentences, notation, order of the argument, rigour. Three to six points in one paragraph, separated by semicolons, and nothing else."

# What guided output must look like, as JSON schemas.  Fixed values: names and bounds that the readers of answers expect.
_SHARE = {"type": "number", "minimum": 0.0, "maximum": 1.0}
SCORE_SCHEMA = {"type": "object", "properties": {"score": _SHARE}, "required": ["score"], "additionalProperties": False}
PAIR_SCHEMA = {"type": "array", "items": _SHARE, "minItems": 2, "maxItems": 2}
_CLAIM = {"type": "object", "properties": {"id": {"type": "integer", "minimum": 0}, "text": {"type": "string", "minLength": 1, "maxLength": 80}}, "required": ["id", "text"], "additionalProperties": False}
CLAIMS_SCHEMA = {"type": "object", "properties": {"segments": {"type": "array", "items": _CLAIM, "minItems": 1}}, "required": ["segments"], "additionalProperties": False}


class Engine(Protocol):
    """``schema`` is a JSON schema that the answers must follow, or None for free text."""

    def generate(self, prompts: list[str], schema: dict | None = None) -> list[str]: ...


class EchoEngine:
    """A stand-in: the last line of a prompt, the sentinel and a remark; with a schema, an answer that fits it."""

    def __init__(self, config: ModelConfig) -> None:
        self.stop = config.stop

    def generate(self, prompts: list[str], schema: dict | None = None) -> list[str]:
        if schema is None:
            return [p.rpartition("\n")[2] + f" {self.stop} and more" for p in prompts]
        if schema.get("type") == "array":
            return ["[0.25, 0.75]" for _ in prompts]
        if "score" in schema["properties"]:
            return [f'{{"score": {len(p) % 101 / 100:.2f}}}' for p in prompts]
        return [json.dumps({"segments": [{"id": 1, "text": p.rpartition(" ")[2][:80] or "."}]}) for p in prompts]


class MarkedTurns:
    """A stand-in for a tokenizer with a chat template: every turn between marks, the model's turn opened."""

    chat_template = "<|{role}|>\n{content}<|end|>\n"

    def __init__(self, config: ModelConfig) -> None:
        self.opened = "<|assistant|>\n"

    def apply_chat_template(self, turns: list[dict[str, str]], tokenize: bool = False, add_generation_prompt: bool = True) -> str:
        return "".join(self.chat_template.format(**t) for t in turns) + (self.opened if add_generation_prompt else "")


_ENGINES: dict[tuple[str, str, str, str], Engine] = {}  # of this worker


def devices(config: ModelConfig) -> str:
    """Addresses of the devices that the cluster gave this task; else those that the configuration names."""
    task = TaskContext.get()
    own = task.resources().get(config.resource) if task is not None else None
    return ",".join(own.addresses) if own is not None else config.devices


def _engine(make: Callable[[ModelConfig], Engine], config: ModelConfig) -> Engine:
    """The engine of this worker for a model on the task's devices.

    A worker serves task after task, each perhaps with other devices, so an
    engine stands for both.  It sees its devices in its configuration and in
    CUDA_VISIBLE_DEVICES, as libraries read that when they are first used.
    """
    at = devices(config)
    key = (make.__module__, make.__qualname__, config.name, at)
    if at:
        os.environ["CUDA_VISIBLE_DEVICES"] = at
    if key not in _ENGINES:
        _ENGINES[key] = make(replace(config, devices=at))
    return _ENGINES[key]


def device_profile(amount: int = 1, resource: str = "gpu", cpus: int = 1, of_executor: int | None = None, script: str = "") -> ResourceProfile:
    """What every task of a model stage asks for: ``amount`` devices and ``cpus`` cores.

    With ``of_executor`` the stage gets executors of its own with so many
    devices, found by ``script`` (this needs dynamic allocation); without, it
    runs on executors that have devices already.
    """
    builder = ResourceProfileBuilder().require(TaskResourceRequests().cpus(cpus).resource(resource, amount))
    if of_executor is not None:
        builder = builder.require(ExecutorResourceRequests().resource(resource, of_executor, script))
    return builder.build


def answers(rows: DataFrame, prompt: Column, make: Callable[[ModelConfig], Engine], config: ModelConfig = ModelConfig(), out: str = "answer", schema: dict | None = None, profile: ResourceProfile | None = None) -> DataFrame:
    """``rows`` with the model's answers in a stage that can have a profile of its own; else like ``generator``.

    Without a profile, tasks run where all others do, with one engine in each worker.
    """
    ship(rows.sparkSession)
    asked = rows.withColumn("__prompt", F.coalesce(prompt, F.lit("")))
    columns = [c for c in rows.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _engine(make, config)
        guided = {} if schema is None else {"schema": schema}
        for batch in batches:
            texts, said = batch.column(batch.num_columns - 1).to_pylist(), []
            for i in range(0, len(texts), config.batch_size):
                said += [t.strip() for t in engine.generate(texts[i : i + config.batch_size], **guided)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), pa.array(said, pa.string())], [*columns, out])

    kept = asked.select(*[F.col(c) for c in columns], "__prompt")
    fields = S.StructType([*kept.schema.fields[:-1], S.StructField(out, S.StringType())])
    return kept.mapInArrow(run, fields, profile=profile)


def chat_prompt(system: Column, user: Column) -> Column:
    """"role: content" lines, for models without a chat template; an empty system part is left out."""
    return F.concat(F.when(F.coalesce(system, F.lit("")) != "", F.concat(F.lit("system: "), system, F.lit("\n"))).otherwise(""), F.lit("user: "), user)


def continue_prompt(problem: Column, prefix: Column) -> Column:
    return chat_prompt(F.lit(CONTINUE), F.concat(F.lit("Problem:\n"), problem, F.lit("\nSolution so far:\n"), T.strip(prefix)))


def judge_prompt(generated: Column, reference: Column) -> Column:
    return chat_prompt(F.lit(JUDGE), F.concat(F.lit("Candidate:\n"), generated, F.lit("\nReference:\n"), reference))


def pair_prompt(a: Column, b: Column) -> Column:
    return chat_prompt(F.lit(PAIR), F.concat(F.lit("First:\n"), a, F.lit("\nSecond:\n"), b))


def claims_prompt(x: Column) -> Column:
    return chat_prompt(F.lit(CLAIMS), x)


def rewrite_prompt(style: Column, x: Column) -> Column:
    return chat_prompt(F.concat(F.lit(REWRITE + "\n"), style), x)


def generator(make: Callable[[ModelConfig], Engine], config: ModelConfig = ModelConfig()) -> Callable[..., Column]:
    """A text column (and a schema) to the model's answers, ``batch_size`` prompts a call; ``make`` runs once in each worker."""

    def call(prompt: Column, schema: dict | None = None) -> Column:
        @F.pandas_udf(S.StringType())
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            engine = _engine(make, config)
            guided = {} if schema is None else {"schema": schema}
            for prompts in batches:
                out: list[str] = []
                rows = prompts.fillna("").tolist()
                for i in range(0, len(rows), config.batch_size):
                    out += [t.strip() for t in engine.generate(rows[i : i + config.batch_size], **guided)]
                yield pd.Series(out, dtype=object)

        return run(prompt)

    return call


def templated_prompt(make: Callable[[ModelConfig], object], config: ModelConfig = ModelConfig()) -> Callable[[Column, Column], Column]:
    """(system, user) to the prompt of the model's own chat template, with the turn of the model opened.

    ``make`` gives a tokenizer; one without a template falls back to the lines of ``chat_prompt``.
    """

    def call(system: Column, user: Column) -> Column:
        @F.pandas_udf(S.StringType())
        def run(systems: pd.Series, users: pd.Series) -> pd.Series:
            tokenizer = _engine(make, config)
            out = []
            for s, u in zip(systems.fillna(""), users.fillna(""), strict=True):
                turns = ([{"role": "system", "content": s}] if s else []) + [{"role": "user", "content": u}]
                if getattr(tokenizer, "chat_template", None):
                    out.append(tokenizer.apply_chat_template(turns, tokenize=False, add_generation_prompt=True))
                else:
                    out.append("\n".join(f"{t['role']}: {t['content']}" for t in turns))
            return pd.Series(out, dtype=object)

        return run(system, user)

    return call


def probe_style(spark: SparkSession, generate: Callable[[Column], Column], path: str | None = None) -> str:
    """The model's own words about its style, asked for once; kept in ``path`` if that file exists."""
    asked = spark.range(1).select(generate(chat_prompt(F.lit(PROBE), F.lit("Your style, please."))).alias("s"))
    style = (asked.first().s or "").strip()
    if path and style and os.path.exists(path):
        with open(path, "w", encoding="utf-8") as f:
            f.write(style)
    return style


def rewriter(generate: Callable[[Column], Column], style: str) -> Callable[[Column], Column]:
    """Texts in the style that ``probe_style`` gave."""
    return lambda x: T.truncate_at_sentinel(generate(rewrite_prompt(F.lit(style), x)))


def jaccard_scorer(generated: Column, reference: Column) -> Column:
    return T.jaccard(generated, reference)


def jaccard_pair(a: Column, b: Column) -> Column:
    """Share of b's words that a holds, and of a's words that b holds."""

    def shares(w: Column) -> Column:
        empty = (F.size(w["x"]) == 0) | (F.size(w["y"]) == 0)
        return T.let(F.size(F.array_intersect(w["x"], w["y"])), lambda both: F.struct(*[F.when(empty, 0.0).otherwise(both / F.size(w[k])).alias(n) for k, n in (("y", "forward"), ("x", "backward"))]))

    return T.let(F.struct(T._word_set(a).alias("x"), T._word_set(b).alias("y")), shares)


def words_pair(sentences: Column, reference: Column) -> Column:
    """``jaccard_pair`` of many sentences with one reference, whose words are taken once: array<struct<forward, backward>>."""
    words = F.struct(F.transform(sentences, T._word_set).alias("s"), T._word_set(reference).alias("y"))

    def each(x: Column, y: Column) -> Column:
        empty = (F.size(x) == 0) | (F.size(y) == 0)
        return T.let(F.size(F.array_intersect(x, y)), lambda both: F.struct(F.when(empty, 0.0).otherwise(both / F.size(y)).alias("forward"), F.when(empty, 0.0).otherwise(both / F.size(x)).alias("backward")))

    return T.let(words, lambda w: F.transform(w["s"], lambda x: each(x, w["y"])))


def model_scorer(generate: Callable[[Column], Column]) -> Scorer:
    """Scores from a judge model's answers; what can't be read is 0."""
    return lambda generated, reference: J.last_score(generate(judge_prompt(generated, reference), SCORE_SCHEMA))


def model_pair(generate: Callable[[Column], Column]) -> Scorer:
    def score(a: Column, b: Column) -> Column:
        got = J.score_pair(J.safe_json(generate(pair_prompt(a, b), PAIR_SCHEMA))["json"])
        return F.struct(F.try_element_at(got, F.lit(1)).alias("forward"), F.try_element_at(got, F.lit(2)).alias("backward"))

    return score


def sentence_claims(x: Column) -> Column:
    """Stand-in for a claim model: the sentences."""
    return T.sentence_split_evaluation(x)


def model_claims(generate: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: J.claim_texts(generate(claims_prompt(x), CLAIMS_SCHEMA))


def claim_judgement(score: Column, label: Column | None = None, justification: Column | None = None) -> Column:
    """struct<score, label, justification> with the score in [0, 1], the label in lower case and a short reason."""
    name = F.lit(None).cast("string") if label is None else label
    reason = F.lit(None).cast("string") if justification is None else justification
    return F.struct(T.clamp_score(score).alias("score"), T.clean_label(name).alias("label"), T.cut_justification(reason).alias("justification"))


def once_per_text(rows: DataFrame, text: str, call: Callable[[Column], Column], out: str) -> DataFrame:
    """``call`` on every distinct text once, joined back: a memo that is distributed."""
    unique = rows.select(text).distinct().withColumn(out, call(F.col(text))).withColumnRenamed(text, "__text")
    return rows.join(unique, F.col(text).eqNullSafe(F.col("__text")), "left").drop("__text")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = [F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, w: s + w)) for v in (a, b)]
    return F.try_divide(dot, norm[0] * norm[1])
