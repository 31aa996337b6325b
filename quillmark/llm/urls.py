"""URL filters: rules first, then a naive Bayes score over segmented names.

Rules are "host/path" prefixes.  A rule fits its host and all subdomains if
the url's path starts with the rule's path; the longest rule wins.

Where no rule fits, names are read as words: each host label and path part is
split by a unigram Viterbi search over a lexicon of all words of the pages'
titles, so that "goodfood" becomes "good food".  A multinomial naive Bayes
model over these words then decides.  It learns from the urls that rules judge.

The lexicon and the word counts of both classes are tables.  While they have at
most ``broadcast_words`` rows they go to all tasks and urls are only mapped.
Beyond that every distinct name meets the lexicon by a join on its substrings,
and its words meet the counts by another; both ways give the same results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.store import apart, bound_batches, materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NAME = re.compile(r"[a-z\u0080-\U0010ffff]+|[0-9]+")

Rule = tuple[str, str]  # "host/path", "allow" or "block"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """From the end of the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(set(rules), key=lambda r: (len(r[0]), r[0])):  # later ones win
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, says).otherwise(verdict)
    return rule, verdict


@dataclass
class Lexicon:
    """Word counts, lower-cased runs of letters: a table (w, n) and its totals."""

    words: DataFrame
    total: int
    types: int
    least: int  # count of the rarest word
    lengths: list[int]  # of words

    def log(self, n: int) -> float:
        return math.log10(n / self.total)

    @property
    def unknown(self) -> float:
        return self.log(self.least) if self.types else 0.0

    def at_hand(self) -> tuple[dict[str, float], float, list[int]]:
        """Collected; only for a lexicon that may be broadcast."""
        return {r.w: self.log(r.n) for r in self.words.collect()}, self.unknown, self.lengths


def lexicon(text: Column, rows: DataFrame) -> Lexicon:
    """All words of ``text`` with their counts; null texts hold none."""
    words = rows.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\p{L}+)"), 1)).alias("w"))
    words = materialize(words.groupBy("w").agg(F.count("*").alias("n")), "lexicon")
    total, types, least, lengths = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.min("n"), F.lit(1)), F.collect_set(F.length("w"))).first()
    return Lexicon(words, total, types, least, sorted(lengths))


def unknown_log(unknown: float, length: int) -> float:
    """Of a word of so many letters that is not in the lexicon: 10 ** -(letters + 1) of a rare word's probability."""
    return unknown - length - 1


def best_split(name: str, logs: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """The most probable words of a name; ``logs`` has the known pieces (begin, end).

    Of equal splits that with the later last cut.  An unknown piece costs its
    letters and one more, so of all unknown pieces that end at a place the best
    begins where the log so far plus the letters before it is greatest.
    """
    known: dict[int, list[tuple[int, float]]] = {}
    for (begin, end), p in logs.items():
        known.setdefault(end, []).append((begin, p))
    best, cut, lead = [0.0], [0], (0.0, 0)
    for end in range(1, len(name) + 1):
        lead = max(lead, (best[-1] + end - 1, end - 1))
        p, begin = max([(unknown_log(unknown, end) + lead[0], lead[1]), *((best[b] + p, b) for b, p in known.get(end, ()))])
        best.append(p)
        cut.append(begin)
    out, end = [], len(name)
    while end:
        out.append(name[cut[end] : end])
        end = cut[end]
    return out[::-1]


def pieces(name: str, lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Begin and end of every part of a name that has the length of a word."""
    for n in lengths:
        if n > len(name):
            break
        for begin in range(len(name) - n + 1):
            yield begin, begin + n


class Segmenter:
    """Splits names by a lexicon that is at hand; the cache holds at most ``_CACHE`` letters."""

    _CACHE = 4_000_000

    def __init__(self, words: dict[str, float], unknown: float, lengths: list[int]) -> None:
        self.words, self.unknown, self.lengths = words, unknown, lengths
        self.cache: dict[str, list[str]] = {}
        self.held = 0

    def split(self, name: str) -> list[str]:
        got = self.cache.get(name)
        if got is None:
            if self.held > self._CACHE:
                self.cache.clear()
                self.held = 0
            logs = {at: p for at in pieces(name, self.lengths) if (p := self.words.get(name[at[0] : at[1]])) is not None}
            got = self.cache[name] = best_split(name, logs, self.unknown)
            self.held += len(name) + 16
        return got


def names(host: str, path: str) -> list[tuple[str, str, bool]]:
    """(mark, name, whether it is split) of all names: "h:" for the host, "p:" for the path.

    The host's last label is a word as it is; of digits only their number counts.
    """
    host, dot, last = host.rpartition(".")
    out = [("h:", last, False)] if dot else []
    host = host if dot else last
    for mark, part in (("h:", host), ("p:", path.lower())):
        out += [(mark, f"#{len(n)}", False) if n[0] in "0123456789" else (mark, n, True) for n in _NAME.findall(part)]
    return out


def tokens(host: str, path: str, split) -> list[str]:
    return [mark + w for mark, name, cut in names(host, path) for w in (split(name) if cut else [name])]


@dataclass
class Bayes:
    """Multinomial naive Bayes with add-one counts: a table (token, block, allow) and its totals."""

    counts: DataFrame
    types: int
    tokens: tuple[int, int]  # of allowed and of blocked urls
    urls: tuple[int, int]

    def odds(self, allow: int, block: int) -> float:
        """Log odds of block that one token adds; (0, 0) for a token that was never seen."""
        return math.log((block + 1) / (self.tokens[1] + self.types + 1)) - math.log((allow + 1) / (self.tokens[0] + self.types + 1))

    @property
    def prior(self) -> float:
        return math.log((self.urls[1] + 1) / (self.urls[0] + 1))


def _segmented(rows: DataFrame, words: Lexicon, broadcast_words: int) -> DataFrame:
    """(host, path, tokens) of all distinct pairs of ``rows(host, path)``."""
    pairs = rows.select("host", "path").distinct()
    schema = "host string, path string, tokens array<string>"
    if words.types <= broadcast_words:
        bound = rows.sparkSession.sparkContext.broadcast(words.at_hand())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seg = Segmenter(*bound.value)
            for batch in batches:
                got = [tokens(h, p, seg.split) for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.list_(pa.string()))], ["host", "path", "tokens"])

        return pairs.mapInArrow(run, schema)
    lengths, unknown, total = words.lengths, words.unknown, words.total

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = names(h, p)
                n = len(got)
                yield pa.RecordBatch.from_arrays([pa.array([h] * n, pa.string()), pa.array([p] * n, pa.string()), pa.array(range(n), pa.int32()), *(pa.array([x[i] for x in got], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_())))], ["host", "path", "place", "mark", "name", "cut"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                at = list(pieces(name, lengths))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array([name[b:e] for b, e in at], pa.string()), pa.array([b for b, _ in at], pa.int32())], ["name", "w", "begin"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out.append(best_split(name, {(f["begin"], f["begin"] + f["size"]): math.log10(f["n"] / total) for f in found or ()}, unknown))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["name", "words"])

    each = materialize(pairs.mapInArrow(cut, "host string, path string, place int, mark string, name string, cut boolean"), "names")
    distinct = each.where("cut").select("name").distinct()
    found = distinct.mapInArrow(parts, "name string, w string, begin int").join(words.words, "w").groupBy("name").agg(F.collect_list(F.struct("begin", F.length("w").alias("size"), "n")).alias("found"))
    split = distinct.join(found, "name", "left").mapInArrow(solve, "name string, words array<string>")
    own = each.where("cut").join(split, "name").unionByName(each.where("NOT cut").withColumn("words", F.array("name")))
    marked = F.transform("words", lambda w: F.concat(F.col("mark"), w))
    lists = own.select("host", "path", "place", marked.alias("words")).groupBy("host", "path").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("place", "words"))), lambda x: x["words"])).alias("tokens"))
    return pairs.join(lists, ["host", "path"], "left").select("host", "path", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))


def fit(judged: DataFrame, segmented: DataFrame) -> Bayes:
    """From ``judged(host, path, verdict)``, rows that a rule judges, and the words of their names."""
    urls = judged.where("verdict IS NOT NULL").groupBy("host", "path").agg(F.count(F.when(F.col("verdict") == "allow", 1)).alias("allow"), F.count(F.when(F.col("verdict") == "block", 1)).alias("block"))
    urls = materialize(urls.join(segmented, ["host", "path"]), "judged")
    counts = urls.select(F.explode("tokens").alias("token"), "allow", "block").groupBy("token").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    counts = materialize(counts, "bayes")
    zero = F.lit(0)
    n = urls.agg(F.coalesce(F.sum("allow"), zero), F.coalesce(F.sum("block"), zero)).first()
    t = counts.agg(F.count("*"), F.coalesce(F.sum("allow"), zero), F.coalesce(F.sum("block"), zero)).first()
    return Bayes(counts, t[0], (t[1], t[2]), (n[0], n[1]))


def judge(pages: DataFrame, url: Column, keep: list[str], rules: list[Rule], words: Lexicon, model: Bayes | None = None, broadcast_words: int = 200_000) -> DataFrame:
    """Columns ``keep`` with host, path, rule, verdict, ``tokens`` (the segmented words) and ``block_odds``.

    Null urls and urls without "://" have an empty host and path; they have no
    word and the odds of the prior.  Odds of 0 allow.  Urls of any length are
    split whole; repeated rows are judged each.  Without a model it is learned
    from the rows that a rule judges; without any such row all odds are 0.
    """
    keep = apart(keep, ["host", "path", "rule", "verdict", "tokens", "block_odds"])
    spark = pages.sparkSession
    bound_batches(spark)
    rows = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], url.alias("__url"))
    rows = rows.select(*[f"k{i}" for i in range(len(keep))], host(F.col("__url")).alias("host"), path(F.col("__url")).alias("path"))
    rule, verdict = match(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("verdict"))
    if model is None:
        judged = rows.where("verdict IS NOT NULL")
        model = fit(judged, _segmented(judged, words, broadcast_words))
    decided = F.coalesce("verdict", F.when(F.col("block_odds") > 0, "block").otherwise("allow"))
    out = [*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", "rule", decided.alias("verdict"), "tokens", "block_odds"]
    if max(words.types, model.types) <= broadcast_words:
        bound = spark.sparkContext.broadcast((words.at_hand(), {r.token: model.odds(r.allow, r.block) for r in model.counts.collect()}, model.odds(0, 0), model.prior))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon_, weights, unseen, prior = bound.value
            seg = Segmenter(*lexicon_)
            for batch in batches:
                got = [tokens(h, p, seg.split) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
                odds = [math.fsum([prior, *(weights.get(t, unseen) for t in ts)]) for ts in got]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(pa.string())), pa.array(odds, pa.float64())], [*batch.schema.names, "tokens", "block_odds"])

        return rows.mapInArrow(run, f"{_ddl(rows)}, tokens array<string>, block_odds double").select(*out)
    named = materialize(_segmented(rows, words, broadcast_words), "segmented")
    own = F.log((F.col("block") + 1) / F.lit(model.tokens[1] + model.types + 1)) - F.log((F.col("allow") + 1) / F.lit(model.tokens[0] + model.types + 1))
    each = named.select("host", "path", F.explode("tokens").alias("token")).join(model.counts.select("token", own.alias("odds")), "token", "left")
    sums = each.groupBy("host", "path").agg(F.sum(F.coalesce("odds", F.lit(model.odds(0, 0)))).alias("odds"))
    named = named.join(sums, ["host", "path"], "left").select("host", "path", "tokens", (F.coalesce("odds", F.lit(0.0)) + F.lit(model.prior)).alias("block_odds"))
    return rows.join(named, ["host", "path"]).select(*out)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
