"""Tolerant JSON: repairs as JVM expressions, exact Python parsing as one Arrow UDF."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quillmark.functions.text import normalize_quotes

# What each repair looks for and what it puts there, in the order in which repairs build on each other.
# They are patterns of Python; the column functions below run the same ones.
REPAIRS = {
    "trailing commas": [(r",\s*([}\]])", r"\1")],
    "single quotes": [(r"""([{\[,]\s*)'([^'"\\]+?)'\s*:""", r'\1"\2":'), (r""":\s*'([^'"\\]*?)'(\s*[,}\]])""", r': "\1"\2')],
    "bare keys": [(r"([{\[,]\s*)([A-Za-z_][A-Za-z0-9_\-]*)\s*:", r'\1"\2":')],
    "literals": [(r"\bTrue\b", "true"), (r"\bFalse\b", "false"), (r"\bNone\b", "null")],
}


def _column(name: str, x: Column) -> Column:
    """A repair as an expression; (?U) gives Java's classes the width of Python's."""
    return reduce(lambda t, rule: F.regexp_replace(t, "(?U)" + rule[0], re.sub(r"\\(\d)", r"$\1", rule[1])), REPAIRS[name], x)


_RULES = {name: [(re.compile(find), put) for find, put in rules] for name, rules in REPAIRS.items()}
#: A repair changes nothing in a text that holds none of these.
_SIGNS = {"trailing commas": (",",), "single quotes": ("'",), "bare keys": (":",), "literals": ("True", "False", "None")}
_BRACKETS = {"{": re.compile(r"[{}]"), "[": re.compile(r"[\[\]]")}


def mend(name: str, text: str) -> str:
    """A repair of one text."""
    if not any(sign in text for sign in _SIGNS[name]):
        return text
    for find, put in _RULES[name]:
        text = find.sub(put, text)
    return text


def strip_trailing_commas(x: Column) -> Column:
    return _column("trailing commas", x)


def fix_unquoted_keys(x: Column) -> Column:
    """Double quotes around bare identifier keys."""
    return _column("bare keys", x)


def single_to_double_quotes(x: Column) -> Column:
    """Double quotes around single-quoted keys, then values, that hold no quote or backslash."""
    return _column("single quotes", x)


def replace_py_literals(x: Column) -> Column:
    return _column("literals", x)


def fix_json_format(x: Column) -> Column:
    return F.regexp_replace(x, "'([^']+)':", '"$1":')


def last_score(x: Column) -> Column:
    """The number of a closing {"score": n}; 0.0 where there is none."""
    return F.coalesce(F.regexp_extract(x, r'(?d)\{"score":\s*([0-9]*\.?[0-9]+)\}$', 1).try_cast("double"), F.lit(0.0))


def score_parsed(x: Column) -> Column:
    """Whether ``last_score`` found its number."""
    return F.coalesce(F.regexp_like(x, F.lit(r'(?d)\{"score":\s*([0-9]*\.?[0-9]+)\}$')), F.lit(False))


def score_pair(x: Column) -> Column:
    """array<double> of a two-number answer."""
    return F.from_json(x, "array<double>")


def claim_texts(x: Column) -> Column:
    """Texts of {"segments": [{"id", "text"}]}; none if it can't be read."""
    parsed = F.from_json(x, "struct<segments:array<struct<id:int,text:string>>>")
    return F.coalesce(F.transform(parsed["segments"], lambda s: s["text"]), F.array().cast("array<string>"))


def first_chunk(s: str | None) -> str | None:
    """From the first { or [ to where brackets of that kind are level again; quotes are not looked at."""
    opened = re.search(r"[{\[]", s or "")
    if not opened:
        return None
    left, depth = opened.group(), 0
    for m in _BRACKETS[left].finditer(s, opened.start()):
        depth += 1 if m.group() == left else -1
        if depth == 0:
            return s[opened.start() : m.end()]
    return None


def _readings(text: str) -> Iterator[object]:
    """All ways to read a normalised text, the strictest first; each may fail with an error or give None."""
    tried = {text}
    yield lambda: json.loads(text)
    part, now = first_chunk(text) or text, text
    for name in (None, *REPAIRS):  # one upon the other
        mended = now if name is None else mend(name, now)
        if mended != now:
            now, part = mended, first_chunk(mended) or mended
        if part not in tried:  # what has failed fails again
            tried.add(part)
            yield lambda t=part: json.loads(t)
    # as a Python value, with keys and quotes as they came
    plain = reduce(lambda t, name: mend(name, t), ("trailing commas", "single quotes", "literals"), text)
    yield lambda: json.loads(json.dumps(ast.literal_eval(first_chunk(plain) or plain)))


def repair(s: str | None) -> str | None:
    """JSON text of a tolerant reading of normalised text; None if every attempt fails.

    The text as it is and its first chunk; then the first chunk after each
    repair in turn (the whole text where there is none); at last as a Python
    literal.  A reading of null counts as a failure.
    """
    for read in _readings(s) if s is not None else ():
        try:
            value = read()
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            continue
        if value is not None:
            return json.dumps(value, ensure_ascii=False)
    return None


@F.pandas_udf(S.StringType())
def first_json_chunk(x: pd.Series) -> pd.Series:
    return x.map(first_chunk)


@F.pandas_udf(S.BooleanType())
def is_json(x: pd.Series) -> pd.Series:
    """Whether Python's json.loads takes it."""

    def ok(s: str | None) -> bool:
        try:
            json.loads(s)
        except (TypeError, ValueError):
            return False
        return True

    return x.map(ok)


@F.pandas_udf(S.StringType())
def _repair(x: pd.Series) -> pd.Series:
    return x.map(repair)


def safe_json(x: Column) -> Column:
    """struct<json, parse_error>: canonical JSON text, or null and true."""
    got = _repair(normalize_quotes(x))
    return F.struct(got.alias("json"), got.isNull().alias("parse_error"))
