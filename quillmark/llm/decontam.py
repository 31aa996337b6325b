"""Decontamination from evaluation items by winnowing.

Both sides keep the minimum hash of k consecutive words in every sliding
window of w = window - k + 1 such hashes.  Two texts that share ``window``
consecutive words share that minimum, so joining fingerprints finds every such
span; each hit is then extended to the whole window and checked there.  Items
shorter than a window are matched as a whole.

The fingerprints of the items are broadcast only while their number is within
``broadcast_windows``; then documents are only mapped.  Beyond it the same
fingerprints are joined by shuffles: a text sends each run of equal minima
once, about a third as many as it has words, and only the places that hit are
taken from the text again and extended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm import kernels as K
from quillmark.llm.store import apart, bound_batches, materialize

K_WORDS = 5
_SPAN = "n long, hash long"


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` hashes."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = grams[:n].copy()
    for j in range(1, width):
        np.minimum(out, grams[j : j + n], out=out)
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def windows(bench: DataFrame, item_id: Column, text: Column, window: int = 10) -> DataFrame:
    """Distinct (n words, hash, fingerprint, item_id) of all windows of all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = K.hashed(batch.column(1), K.ALNUM)
            for i, item in enumerate(batch.column(0).to_pylist()):
                w = words[first[i] : first[i + 1]]
                if not len(w):
                    continue
                n = min(window, len(w))
                hashes = K.ngrams(w, n)
                prints = winnow(K.ngrams(w, K_WORDS), window - K_WORDS + 1) if n == window else hashes
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), n)), pa.array(_signed(hashes)), pa.array(_signed(prints)), pa.array([item] * len(hashes), pa.string())], ["n", "hash", "print", "item_id"])

    rows = bench.select(item_id.cast("string").alias("item_id"), text.alias("text")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    return rows.mapInArrow(run, "n bigint, hash bigint, print bigint, item_id string").distinct()


class _Index:
    """Windows by length, each a sorted array of hashes, with the items that hold them."""

    def __init__(self, rows: list, window: int) -> None:
        self.window = window
        by: dict[int, dict[int, set[str]]] = {}
        for r in rows:
            by.setdefault(r.n, {}).setdefault(r.hash & (2**64 - 1), set()).add(r.item_id)
        self.sets = {n: (keys := np.array(sorted(d), np.uint64), [sorted(d[int(k)]) for k in keys]) for n, d in by.items()}
        self.prints = K.Prober(np.array(sorted({r.print & (2**64 - 1) for r in rows if r.n == window}), np.uint64))
        self.probers = {n: K.Prober(k) for n, (k, _) in self.sets.items()}

    def matches(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(n, text, positions, window numbers) of all windows that occur."""
        for n in sorted(self.sets):
            if n == self.window:
                low = winnow(K.ngrams(words, K_WORDS), n - K_WORDS + 1)
                turn = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else np.zeros(0, np.int64)
                hit = self.prints.find(low[turn]) >= 0
                size = np.diff(np.concatenate([turn, [len(low)]]))[hit]
                at = np.repeat(turn[hit] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if hit.any() else np.zeros(0, np.int64)
            else:
                at = np.arange(max(0, len(words) - n + 1))
            if not len(at):
                continue
            text = np.searchsorted(first, at, side="right") - 1
            at = at[at + n <= first[text + 1]]
            grams = K.ngrams(words, n)[at] if len(at) > 1000 or n != self.window else np.array([K.ngrams(words[a : a + n], n)[0] for a in at], np.uint64)
            found = self.probers[n].find(grams)
            ok = found >= 0
            at, found = at[ok], found[ok]
            text = np.searchsorted(first, at, side="right") - 1
            for t in np.unique(text):
                yield n, int(t), at[text == t], found[text == t]


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def scan(docs: DataFrame, text: Column, bench: DataFrame, item_id: Column, item_text: Column, keep: list[str], window: int = 10, broadcast_windows: int = 500_000) -> DataFrame:
    """Columns ``keep`` with n_words, n_hit, n_items and items (sorted item ids found).

    A null, empty or wordless text has no words; texts of any length are read
    whole; an empty table of documents gives an empty one; an empty table of items
    hits nothing; items with null id or text take no part; items with equal
    windows all count.  ``keep`` may hold any columns, also null or repeated
    ones: each row is judged alone, and repeated rows are judged alike.
    """
    spark = docs.sparkSession
    keep = apart(keep, ["n_words", "n_hit", "n_items", "items"])
    bound_batches(spark, 8)
    wins = materialize(windows(bench, item_id, item_text, window), "windows")
    rows = docs.select(*[F.col(c) for c in keep], text.alias("__text"))
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    if wins.count() > broadcast_windows:
        return _scan_by_join(rows, wins, keep, kept, window)
    bound = spark.sparkContext.broadcast(_Index(wins.collect(), window))  # at most broadcast_windows rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = K.hashed(batch.column(len(keep)), K.ALNUM)
            n = batch.num_rows
            hits, items = np.zeros(n, np.int64), [[] for _ in range(n)]
            cover: dict[int, np.ndarray] = {}
            found: dict[int, set[str]] = {}
            for length, t, at, which in bound.value.matches(words, first):
                c = cover.setdefault(t, np.zeros(first[t + 1] - first[t] + 1, np.int64))
                np.add.at(c, at - first[t], 1)
                np.add.at(c, at - first[t] + length, -1)
                names = bound.value.sets[length][1]
                found.setdefault(t, set()).update(x for w in np.unique(which) for x in names[w])
            for t, c in cover.items():
                hits[t] = int((np.cumsum(c) > 0).sum())
                items[t] = sorted(found[t])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.diff(first)), pa.array(hits), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string()))], [*keep, "n_words", "n_hit", "n_items", "items"])

    return rows.mapInArrow(run, f"{kept}, n_words bigint, n_hit bigint, n_items bigint, items array<string>")


def _turns(words: np.ndarray, n: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of a text for items of n words: runs of equal minima as (fingerprint, first place, number of places)."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = winnow(K.ngrams(words, K_WORDS), n - K_WORDS + 1) if n == window else K.ngrams(words, n)
    at = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    return low[at], at, np.diff(np.concatenate([at, [len(low)]]))


def _scan_by_join(rows: DataFrame, wins: DataFrame, keep: list[str], kept: str, window: int) -> DataFrame:
    """The same for items of any number, by joins of stored tables.

    Texts are named by a hash of their words, so equal texts are matched once.
    A text sends (n, fingerprint) pairs without repeats; those that the
    item side has come back as its list of fingerprints that hit.  The windows
    of the text at these alone join with the windows of the items.
    """
    short = [r.n for r in wins.where(F.col("n") < window).select("n").distinct().collect()]  # below 10 values
    lengths = sorted({*short, window})

    def prints_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = K.hashed(batch.column(0), K.ALNUM)
            for i in range(batch.num_rows):
                w = words[first[i] : first[i + 1]]
                if not len(w):
                    continue
                key = _signed(K.whole(w))[0]
                for n in lengths:
                    low = np.unique(_turns(w, n, window)[0])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(low), key)), pa.array(np.full(len(low), n)), pa.array(_signed(low))], ["key", "n", "print"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = K.hashed(batch.column(0), K.ALNUM)
            for i, (key, hits) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                w = words[first[i] : first[i + 1]]
                by: dict[int, list[int]] = {}
                for h in hits:
                    by.setdefault(h["n"], []).append(h["print"])
                for n, wanted in by.items():
                    low, at, size = _turns(w, n, window)
                    some = np.flatnonzero(np.isin(low, np.array(wanted, np.int64).view(np.uint64)))
                    places = np.concatenate([np.zeros(0, np.int64), *(np.arange(at[j], at[j] + size[j]) for j in some)]).astype(np.int64)
                    grams = K.ngrams(w, n)[places]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), key)), pa.array(np.full(len(places), n)), pa.array(places), pa.array(_signed(grams))], ["key", "n", "at", "hash"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = K.hashed(batch.column(len(keep)), K.ALNUM)
            keys = np.array([_signed(K.whole(words[first[i] : first[i + 1]]))[0] if first[i + 1] > first[i] else 0 for i in range(batch.num_rows)], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.diff(first)), pa.array(keys), batch.column(len(keep))], [*keep, "n_words", "__key", "__text"])

    prints = materialize(rows.select("__text").mapInArrow(prints_, "key bigint, n bigint, print bigint"), "prints")
    common = prints.join(wins.select("n", "print").distinct(), ["n", "print"], "left_semi").distinct()
    asked = common.groupBy("key").agg(F.collect_list(F.struct("n", "print")).alias("hits"))  # no more than a text has fingerprints
    asked = materialize(asked.withColumnRenamed("key", "__key"), "asked")
    named = rows.mapInArrow(count, f"{kept}, n_words bigint, __key bigint, __text string")
    texts = named.join(asked, "__key").groupBy("__key").agg(F.first("__text").alias("__text"), F.first("hits").alias("hits"))  # equal words, whichever of the texts
    spans = materialize(texts.select("__text", "__key", "hits").mapInArrow(extend, "key bigint, n bigint, at bigint, hash bigint"), "spans")
    found = materialize(spans.join(wins.select("n", "hash", "item_id"), ["n", "hash"]).select("key", "n", "at", "item_id").distinct(), "found")
    before = Window.partitionBy("key").orderBy("at", "end").rowsBetween(Window.unboundedPreceding, -1)
    places = found.select("key", "at", (F.col("at") + F.col("n")).alias("end")).distinct()
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("at"), F.coalesce(F.max("end").over(before), F.lit(0))))
    hits = places.select("key", new.alias("new")).groupBy("key").agg(F.sum("new").alias("n_hit"))
    items = found.groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    out = named.drop("__text").join(hits.join(items, "key").withColumnRenamed("key", "__key"), "__key", "left")
    return out.select(*[F.col(c) for c in keep], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.greatest(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
