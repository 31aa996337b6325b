"""Probabilistic suffix tree over words, learned from and applied to whole tables.

Symbols are the words that occur ``support`` times; all other words are one
symbol, inside which a word has its share of the add-one unigram model.  A
context is a run of one to ``depth`` symbols before a token; contexts and the
words after them enter the tree if they occur ``support`` times, so the tree
grows with the corpus.  A context is retained if the distribution after it
diverges from that after its longest retained suffix by more than chance
allows (a likelihood-ratio test).  Each retained context smooths into that
suffix; at the root stands the add-one unigram model over all words seen.

A retained entry (context, word) adds to a token's score what it says beyond
the next shorter context; a retained context without the word adds what it
passes on.  So a text's score is its unigram score plus a sum over places and
depths, and every term can be looked up on its own.

Nothing that grows with the corpus is collected or broadcast.  A run of words
is known by a 64-bit id, made of the ids of its first and its last words but
one: those are the context and the entry one level below that smooths it.
Counts and levels stay in tables, cut into buckets by hash, as many as the
bytes of text ask for; runs travel to them in packed rows, one for each batch
and bucket, and what comes back are sums for each text.  Sieves of bounded
size hold back most of the runs that are in no table; what passes by chance is
sorted out there.  Texts are read once for each count and once for scoring.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import kernels as K
from quillmark.llm.store import apart, bound_batches, discard, materialize

RARE, END, START = 0, 1, 2  # symbols; words are numbered from 3 on
_RARE_HASH, _END_HASH, _START_HASH = K.U64(0x5EED0FE4D0000003), K.U64(0x5EED0FE4D0000001), K.U64(0x5EED0FE4D0000005)
_ENTRY, _CONTEXT = K.U64(0x3C6EF372FE94F82B), K.U64(0xA54FF53A5F1D36F1)  # tell the keys of one lookup table apart
_WAITING, _FLUSH = 500_000, 1_000_000
_AT_ONCE = 16  # buckets that leave a task in one batch
_BUCKET_BYTES, _BUCKETS_A_TASK = 6 << 20, 4  # bytes of text that make a bucket; buckets of one task
_SIEVE_BITS = 28
_COMMON, _NEAR = 1_000_000, 1_000_000  # words, and entries or contexts of a level, that go to all tasks
_PACKED = "bucket int, keys binary, counts binary"


@dataclass
class Level:
    """Entries (context, next symbol) of one depth, sorted by key = context * 2**32 + symbol."""

    keys: np.ndarray
    counts: np.ndarray
    log_p: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: of each context, by its number: retained, and the log of what it passes on to its suffix
    retained: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    back: np.ndarray = field(default_factory=lambda: np.zeros(0))


class Sieve:
    """A set of 64-bit ids that may hold more than was put in, of at most 2 ** _SIEVE_BITS bits."""

    def __init__(self, bits: int, data: np.ndarray) -> None:
        self.bits, self.data = bits, data

    def maybe(self, ids: np.ndarray) -> np.ndarray:
        per = K.U64((self.bits >> 6) - 1)
        at = (ids >> K.U64(58)) * K.U64(self.bits >> 6) + (ids & per)
        return (self.data[(at >> K.U64(3)).astype(np.int64)] >> (7 - (at & K.U64(7)).astype(np.uint8))) & 1 > 0


@dataclass
class Tree:
    tokens: int  # N
    types: int  # V
    ends: int  # texts
    rare: float  # log10 probability of the symbol of rare words at the root
    least: float  # count of a symbol or entry
    symbols: DataFrame  # id, n, lp
    entries: list[DataFrame]  # of each level: id, ctx, sfx, n, lp, lq (one level below), root (at the root), retained
    contexts: list[DataFrame]  # of each level: ctx, total, retained, back
    common: np.ndarray  # hashes of the most frequent symbols, sorted
    common_n: np.ndarray  # and their counts
    kinds: int  # how many symbols there are
    sieve: Sieve  # of all of them

    @property
    def log_unit(self) -> float:
        """log10 of one count in the unigram model."""
        return -math.log10(self.tokens + self.types + 1)

    # A small tree as arrays, to look into; learning and scoring do not use these.

    @cached_property
    def _words(self) -> tuple[np.ndarray, np.ndarray]:
        rows = self.symbols.where("NOT special").select("id", "n").toPandas()
        ids = rows["id"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(ids)
        return ids[order], rows["n"].to_numpy(np.int64)[order]

    @property
    def counts(self) -> np.ndarray:
        """Of all symbols."""
        return np.concatenate([[0, self.ends, self.ends], self._words[1]])

    @property
    def log_root(self) -> np.ndarray:
        out = np.log10(self.counts + 1) + self.log_unit
        out[RARE], out[START] = self.rare, -np.inf
        return out

    @cached_property
    def levels(self) -> list[Level]:
        special = np.array([_RARE_HASH, _END_HASH, _START_HASH])
        ids = np.concatenate([special, self._words[0]])
        symbol = np.arange(len(ids))
        out = []
        for entries, contexts in zip(self.entries, self.contexts, strict=True):
            order = np.argsort(ids)
            number = lambda x, o=order, i=ids: o[np.searchsorted(i[o], x.to_numpy(np.int64).view(np.uint64))]
            e, c = entries.toPandas(), contexts.toPandas()
            n = len(ids)
            last = symbol[number(e["sfx"])]
            keys = _key(number(e["ctx"]), last)
            at = np.argsort(keys)
            level = Level(keys[at], e["n"].to_numpy(np.int64)[at], e["lp"].to_numpy(float)[at], np.zeros(n, bool), np.zeros(n))
            level.retained[number(c["ctx"])] = c["retained"].to_numpy(bool)
            level.back[number(c["ctx"])] = c["back"].to_numpy(float)
            out.append(level)
            ids, symbol = e["id"].to_numpy(np.int64).view(np.uint64)[at], last[at]
        return out


def _key(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return (context.astype(np.uint64) << K.U64(32)) | symbol.astype(np.uint64)


def _id(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Of a run: from the runs without its last and without its first word."""
    return K.mix(context * K._MULT + suffix)


def _split(hashes: np.ndarray, buckets: int, then: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order that groups hashes by bucket, and where each bucket begins (buckets + 1 values).

    Inside a bucket rows follow ``then``, so that equal values lie together and shrink when compressed.
    """
    number = ((hashes >> K.U64(32)) % K.U64(buckets)).astype(np.uint32)
    order = np.argsort(number, kind="stable") if then is None else np.lexsort((then, number))
    return order, np.searchsorted(number[order], np.arange(buckets + 1))


class _Runs:
    """Sums of runs in one task, packed by bucket: keys are one column (words) or two (context, suffix)."""

    def __init__(self, width: int, buckets: int) -> None:
        self.width, self.buckets, self.waiting, self.size = width, buckets, [], 0
        self.sums = np.zeros((width, 0), np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        self.waiting.append((keys, np.ones(keys.shape[1], np.int64) if counts is None else counts))
        self.size += keys.shape[1]
        if self.size > _WAITING:
            self.fold()
            if len(self.sums[1]) > _FLUSH:
                yield from self.out()

    def fold(self) -> None:
        parts = [self.sums, *self.waiting]
        whole = [np.concatenate([k for k, _ in parts], 1), np.concatenate([c for _, c in parts])]
        parts.clear()
        self.waiting, self.size, self.sums = [], 0, None  # what is held twice is held by every worker
        self.sums = _tally(*whole)

    def out(self) -> Iterator[pa.RecordBatch]:
        self.fold()
        keys, counts = self.sums
        self.sums = np.zeros((self.width, 0), np.uint64), np.zeros(0, np.int64)
        order, begin = _split(K.mix(_whole(keys)), self.buckets, keys[0] if self.width > 1 else None)
        if counts.max(initial=0) >= 1 << 32:
            raise OverflowError("a run occurs 2 ** 32 times in one task: use more partitions")
        keys, counts = keys[:, order], counts[order].astype(np.uint32)
        del order
        filled = [b for b in range(self.buckets) if begin[b + 1] > begin[b]]
        for i in range(0, len(filled), _AT_ONCE):
            full = filled[i : i + _AT_ONCE]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([keys[:, begin[b] : begin[b + 1]].tobytes() for b in full], pa.binary()), pa.array([counts[begin[b] : begin[b + 1]].tobytes() for b in full], pa.binary())], ["bucket", "keys", "counts"])


def _whole(keys: np.ndarray) -> np.ndarray:
    return keys[0] if len(keys) == 1 else _id(keys[0], keys[1])


def _tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(counts):
        return keys, counts
    whole = _whole(keys)
    order = np.argsort(whole)
    whole = whole[order]
    head = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
    del whole
    counts = np.add.reduceat(counts[order], head)
    return keys[:, order[head]], counts


def _merged(packed: DataFrame, width: int, buckets: int, least: float = 1) -> DataFrame:
    """Sums of packed runs that reach ``least``: (bucket, keys, counts, types, tokens)."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, size = None, [], 0

        def fold() -> tuple[np.ndarray, np.ndarray]:
            return _tally(np.concatenate([k for k, _ in parts], 1), np.concatenate([c for _, c in parts]))

        def out() -> pa.RecordBatch:
            k, c = fold()
            k, c = k[:, c >= least], c[c >= least]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([k.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary()), pa.array([len(c)], pa.int64()), pa.array([int(c.sum())], pa.int64())], ["bucket", "keys", "counts", "types", "tokens"])

        for batch in batches:
            for b, k, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if b != now and now is not None:
                    yield out()
                    parts, size = [], 0
                now = b
                parts.append((np.frombuffer(k, np.uint64).reshape(width, -1), np.frombuffer(c, np.uint32).astype(np.int64)))
                size += len(parts[-1][1])
                if size > _WAITING and len(parts) > 64:
                    parts, size = [fold()], 0
        if now is not None:
            yield out()

    return packed.repartition(_tasks(buckets), "bucket").sortWithinPartitions("bucket").mapInArrow(K.tidy(merge), f"{_PACKED}, types bigint, tokens bigint")


def _tasks(buckets: int) -> int:
    return max(1, buckets // _BUCKETS_A_TASK)


def _gather(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys (long, sorted) and values (double) of a table of bounded size, packed by its tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = (np.ascontiguousarray(batch.column(i).to_numpy(zero_copy_only=False)).tobytes() for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array([keys], pa.binary()), pa.array([values], pa.binary())], ["keys", "values"])

    got = rows.mapInArrow(K.tidy(run), "keys binary, values binary").collect()
    keys = np.frombuffer(b"".join(bytes(r[0]) for r in got), np.uint64)
    values = np.frombuffer(b"".join(bytes(r[1]) for r in got), np.float64)
    order = np.argsort(keys)
    return keys[order], values[order]


def _at_most(rows: DataFrame, n: Column, most: int) -> DataFrame:
    """The rows with the largest n, as many as can be told apart by a power of two without more than ``most``."""
    cuts = [1 << k for k in range(48)]
    counts = rows.agg(*[F.count(F.when(n >= c, 1)) for c in cuts]).first()
    return rows.where(n >= next((c for c, m in zip(cuts, counts, strict=True) if m <= most), 1 << 48))


def _sieve(ids: DataFrame, n: int) -> Sieve:
    """Of a column of ids; each of 64 parts is made in one task."""
    bits = 1 << max(12, min(_SIEVE_BITS, (16 * n).bit_length()))
    per = bits >> 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            part, at = (k >> K.U64(58)).astype(np.int64), (k & K.U64(per - 1)).astype(np.int64)
            for p in np.unique(part).tolist():
                got.setdefault(p, np.zeros(per, bool))[at[part == p]] = True
        for p, x in got.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(x).tobytes()], pa.binary())], ["part", "data"])

    data = np.zeros(bits >> 3, np.uint8)
    only = ids.toDF("id")
    for p, x in only.repartition(64, F.shiftrightunsigned("id", 58)).mapInArrow(K.tidy(run), "part int, data binary").collect():
        data[p * (per >> 3) : (p + 1) * (per >> 3)] |= np.frombuffer(x, np.uint8)
    return Sieve(bits, data)


def _with_ends(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts, each with START before and END after it; and the place of each in its text."""
    n = len(first) - 1
    out = np.full(len(words) + 2 * n, _END_HASH, np.uint64)
    begin = first[:-1] + 2 * np.arange(n)
    out[begin] = _START_HASH
    at = np.arange(len(words)) + 2 * np.repeat(np.arange(n), np.diff(first)) + 1
    out[at] = words
    return out, np.arange(len(out)) - np.repeat(begin, np.diff(first) + 2)


def _windows(stream: np.ndarray, depth: int, rare: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each level: context and suffix of the run that ends at each place, as it is or (``rare``) with a rare last word."""
    whole, last = stream, np.full(len(stream), _RARE_HASH) if rare else stream
    for _ in range(depth):
        context = np.concatenate([whole[:1], whole[:-1]])  # the first place of a text has none
        yield context, last
        whole, last = _id(context, whole), _id(context, last)


def fit(texts: DataFrame, text: Column, depth: int = 3, floor: float = 0.0, support: int = 5, prior: float = 2.0) -> tuple[Tree, DataFrame, int]:
    """The tree, the table of all word counts and its number of buckets.

    Null texts are empty: they hold one end token.  With no row at all the
    tree is a bare root over an unknown word.  A ``floor`` above 0 also asks
    for that share of all tokens; it makes a smaller tree than the corpus gives.
    """
    spark = texts.sparkSession
    bound_batches(spark, 2)
    rows = texts.select(text.alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(64, -(-size // _BUCKET_BYTES))

    def unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(1, buckets)
        for batch in batches:
            words, first = K.hashed(batch.column(0), K.BLANK)
            yield from runs.add(np.concatenate([words, np.full(len(first) - 1, _END_HASH)])[None])
        yield from runs.out()

    table = materialize(_merged(rows.mapInArrow(K.tidy(unigrams), _PACKED), 1, buckets), "words")
    total = table.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    types, tokens = int(total[0]), int(total[1])
    least = max(support, floor * tokens)
    unit = 1 / (tokens + types + 1)
    counted = materialize(_rows(table, 1).select(F.col("ctx").alias("id"), "n").where((F.col("n") >= least) | (F.col("id") == _signed(_END_HASH))), "symbols")
    is_end = F.col("id") == _signed(_END_HASH)
    ends, kinds, mass = counted.agg(F.coalesce(F.sum(F.when(is_end, F.col("n"))), F.lit(0)), F.count(F.when(~is_end, 1)), F.coalesce(F.sum(F.when(~is_end, F.col("n"))), F.lit(0))).first()
    rare = max(1 - (ends + 1) * unit - (mass + kinds) * unit, unit) if tokens else 1.0
    lp = F.log10(F.col("n") + 1) + math.log10(unit)
    special = spark.createDataFrame([(_signed(_RARE_HASH), 0, math.log10(rare)), (_signed(_END_HASH), ends, math.log10((ends + 1) * unit)), (_signed(_START_HASH), ends, 0.0)], "id long, n long, lp double")
    symbols = counted.where(~is_end).select("id", "n", lp.alias("lp"), F.lit(False).alias("special")).unionAll(special.select("*", F.lit(True)))
    common, common_n = _gather(_at_most(counted.where(~is_end), F.col("n"), _COMMON).select("id", F.col("n").cast("double")))
    before, size = symbols.select("id", "n", "lp", F.col("lp").alias("root")), kinds + 3
    sieve0 = sieve = _sieve(before.select("id"), size)
    tree = Tree(tokens, types, ends, math.log10(rare), least, symbols, [], [], common, common_n, kinds, sieve0)
    for d in range(1, depth + 1):
        _release(spark)
        before, sieve = _grow(tree, rows, table, before, sieve0, sieve, d, buckets, prior, d < depth)
    _release(spark)
    return tree, table, buckets


def _grow(tree: Tree, rows: DataFrame, table: DataFrame, before: DataFrame, sieve0: Sieve, sieve: Sieve, d: int, buckets: int, prior: float, more: bool) -> tuple[DataFrame, Sieve | None]:
    """Add level ``d`` to the tree; returns its runs, and the sieve of them if ``more`` levels follow."""
    spark = rows.sparkSession
    bound = spark.sparkContext.broadcast((tree.common, len(tree.common) == tree.kinds, sieve0, sieve))
    counted = materialize(_level(rows, table, bound, d, buckets, tree.least), f"runs{d}")
    _release(spark)
    a = _rows(counted, 2).select("id", "ctx", "sfx", "n").join(before.select(F.col("id").alias("sfx"), F.col("lp").alias("lq"), "root"), "sfx").withColumn("q", F.pow(F.lit(10.0), "lq"))
    a = materialize(a, f"below{d}")
    sums = a.groupBy("ctx").agg(F.sum("n").alias("inside"), F.count("*").alias("kinds"), F.sum("q").alias("qs"), F.sum(F.col("n") * F.log(F.col("n") / F.col("q"))).alias("s"))
    sums = sums.join(before.select(F.col("id").alias("ctx"), F.col("n").alias("total")), "ctx").withColumn("rest", F.col("total") - F.col("inside"))
    g = F.col("s") - F.col("inside") * F.log("total") + F.when(F.col("rest") > 0, F.col("rest") * F.log(F.col("rest") / (F.col("total") * F.greatest(1 - F.col("qs"), F.lit(1e-12))))).otherwise(0.0)
    retained = 2 * g > F.col("kinds") + 4 * F.sqrt(2 * F.col("kinds")) + 8
    contexts = materialize(sums.select("ctx", "total", "rest", retained.alias("retained"), F.log10((F.col("rest") + prior) / (F.col("total") + prior)).alias("back")), f"contexts{d}")
    own = F.log10((F.col("n") + (F.col("rest") + prior) * F.col("q")) / (F.col("total") + prior))
    entries = a.join(contexts, "ctx").select("id", "ctx", "sfx", "n", F.when(F.col("retained"), own).otherwise(F.col("lq")).alias("lp"), "lq", "root", "retained")
    entries = materialize(entries, f"level{d}")
    discard(counted, a)
    tree.entries.append(entries)
    tree.contexts.append(contexts.select("ctx", "total", "retained", "back"))
    before = entries.select("id", "n", "lp", "root")
    bound.destroy()
    return before, _sieve(before.select("id"), before.count()) if more else None


def _release(spark: SparkSession) -> None:
    """Shuffle files of tables that are stored by now go when the driver collects its garbage.

    Python's references are given up with the next call to the driver's JVM, so one goes first.
    """
    gc.collect()
    system = spark.sparkContext._jvm.System
    system.nanoTime()
    system.gc()


def _signed(x: np.uint64) -> int:
    return int(np.array([x]).view(np.int64)[0])


def _rows(table: DataFrame, width: int) -> DataFrame:
    """Packed runs as rows: id, ctx, sfx, n (of words, all three are the word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                keys, counts = np.frombuffer(k, np.uint64).reshape(width, -1), np.frombuffer(c, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (_whole(keys), keys[0], keys[-1])] + [pa.array(counts)], ["id", "ctx", "sfx", "n"])

    return table.select("bucket", "keys", "counts").mapInArrow(K.tidy(run), "id long, ctx long, sfx long, n long")


def _level(rows: DataFrame, table: DataFrame, bound, d: int, buckets: int, least: float) -> DataFrame:
    """Counts of the runs of d + 1 symbols that reach ``least``.

    A run is counted with its last word as it is, and with the symbol of rare
    words if that word is rare.  Words that may be either ask the count table.
    """

    def places(batch: pa.RecordBatch) -> tuple:
        common, all_, sieve0, sieve = bound.value
        stream, place = _with_ends(*K.hashed(batch.column(0), K.BLANK))
        *_, (context, suffix) = _windows(stream, d)
        *_, (_, other) = _windows(stream, d, rare=True)
        at = np.flatnonzero(place >= d)
        at = at[sieve.maybe(context[at])]
        word = stream[at]
        plain = sieve.maybe(suffix[at])
        sure = word == _END_HASH
        return common, all_, sieve0, sieve, context[at], suffix[at], other[at], word, plain, sure

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, prober = _Runs(2, buckets), K.Prober(bound.value[0])
        for batch in batches:
            _, all_, sieve0, sieve, context, suffix, other, word, plain, sure = places(batch)
            yield from runs.add(np.stack([context[plain], suffix[plain]]))
            rare = ~sure & (prober.find(word) < 0 if all_ else ~sieve0.maybe(word)) & sieve.maybe(other)
            yield from runs.add(np.stack([context[rare], other[rare]]))
        yield from runs.out()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prober = K.Prober(bound.value[0])
        for batch in batches:
            _, _, sieve0, sieve, context, _, other, word, _, sure = places(batch)
            at = np.flatnonzero(~sure & sieve0.maybe(word) & sieve.maybe(other))
            at = at[prober.find(word[at]) < 0]
            order, begin = _split(K.mix(word[at]), buckets)
            at = at[order]
            full = [b for b in range(buckets) if begin[b + 1] > begin[b]]
            data = [np.stack([x[at[begin[b] : begin[b + 1]]] for x in (word, context, other)]).tobytes() for b in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([1] * len(full), pa.int32()), pa.array(data, pa.binary())], ["bucket", "kind", "data"])

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for k, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data.append(np.frombuffer(k, np.uint64)[np.frombuffer(c, np.int64) < least].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([0] * len(data), pa.int32()), pa.array(data, pa.binary())], ["bucket", "kind", "data"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, prober, runs = None, K.Prober(np.zeros(0, np.uint64)), _Runs(2, buckets)
        for batch in batches:
            for bucket, kind, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket != now:
                    now, prober = bucket, K.Prober(np.zeros(0, np.uint64))
                x = np.frombuffer(data, np.uint64)
                if kind == 0:
                    prober = K.Prober(np.sort(x))
                    continue
                word, context, other = x.reshape(3, -1)
                rare = prober.find(word) >= 0
                yield from runs.add(np.stack([context[rare], other[rare]]))
        yield from runs.out()

    if bound.value[1]:  # all symbols are at hand: no word may be either
        return _merged(rows.mapInArrow(K.tidy(direct), _PACKED), 2, buckets, least)
    wire = "bucket int, kind int, data binary"
    asked = rows.mapInArrow(K.tidy(ask), wire).unionAll(table.select("bucket", "keys", "counts").mapInArrow(K.tidy(known), wire))
    answered = asked.repartition(_tasks(buckets), "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(K.tidy(answer), _PACKED)
    return _merged(rows.mapInArrow(K.tidy(direct), _PACKED).unionAll(answered), 2, buckets, least)


def _suffix_log(tree: Tree, context: np.ndarray, symbol: np.ndarray, depth: int) -> np.ndarray:
    """log10 probability of symbols after the longest retained proper suffix of contexts of ``depth`` symbols.

    A context of depth d is an entry of level d - 1; its suffix drops the first symbol.
    """
    if depth == 1:
        return tree.log_root[symbol]
    shorter = _drop_first(tree, context, depth)
    return _log(tree, shorter, symbol, depth - 1)


def _drop_first(tree: Tree, context: np.ndarray, depth: int) -> np.ndarray:
    """The context without its oldest symbol, as a context one shallower (-1: not in the tree)."""
    if depth == 2:
        return (tree.levels[0].keys[context] & K.U64(0xFFFFFFFF)).astype(np.int64)
    key = tree.levels[depth - 2].keys[context]
    inner = _drop_first(tree, (key >> K.U64(32)).astype(np.int64), depth - 1)
    last = (key & K.U64(0xFFFFFFFF)).astype(np.int64)
    found = K.lookup(tree.levels[depth - 3].keys, _key(np.maximum(inner, 0), last))
    return np.where(inner >= 0, found, -1)


def _log(tree: Tree, context: np.ndarray, symbol: np.ndarray, depth: int) -> np.ndarray:
    """log10 probability of symbols after contexts of ``depth`` symbols (not retained: after their suffix)."""
    level = tree.levels[depth - 1]
    known = context >= 0
    safe = np.where(known, context, 0)
    entry = np.where(known, K.lookup(level.keys, _key(safe, symbol)), -1)
    kept = known & level.retained[safe] if len(level.retained) else np.zeros(len(context), bool)
    hit = kept & (entry >= 0)
    out = np.empty(len(context))
    out[hit] = level.log_p[entry[hit]]
    rest = np.flatnonzero(~hit)
    if len(rest):
        below = _suffix_log(tree, safe[rest], symbol[rest], depth) if depth > 1 else tree.log_root[symbol[rest]]
        out[rest] = below + np.where(kept[rest], level.back[safe[rest]], 0.0)
    return out


def _lookup(tree: Tree) -> DataFrame:
    """Retained entries and contexts: (ctx, key, value, near, n); value is what they add, near what an entry adds to the root."""
    out = tree.symbols.sparkSession.createDataFrame([], "ctx long, key long, value double, near double, n long, level int")
    for d, (entries, contexts) in enumerate(zip(tree.entries, tree.contexts, strict=True)):
        key = F.col("id").bitwiseXOR(F.lit(_signed(_ENTRY)))
        out = out.unionAll(entries.where("retained").select("ctx", key, F.col("lp") - F.col("lq"), F.col("lp") - F.col("root"), "n", F.lit(2 * d)))
        key = F.col("ctx").bitwiseXOR(F.lit(_signed(_CONTEXT)))
        out = out.unionAll(contexts.where("retained").select("ctx", key, "back", "back", "total", F.lit(2 * d + 1)))
    return out


def _frequent(tree: Tree, lookup: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The part of the table that most texts ask for, sorted: of each level at most _NEAR entries and contexts."""
    parts = [_gather(_at_most(lookup.where(F.col("level") == i), F.col("n"), _NEAR).select("key", "near")) for i in range(2 * len(tree.entries))]
    keys, values = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0))
    order = np.argsort(keys)
    return keys[order], values[order]


class _Scorer:
    """What a task can add up by itself, and what it must ask for."""

    def __init__(self, unit: float, depth: int, ends: int, complete: bool, symbols: Sieve, lookup: Sieve, common: np.ndarray, common_n: np.ndarray, near: np.ndarray, near_values: np.ndarray) -> None:
        self.unit, self.depth, self.ends, self.symbols, self.lookup = unit, depth, ends, symbols, lookup
        self.complete = complete  # all symbols are among the common ones
        self.common, self.common_n = K.Prober(common), common_n
        self.near, self.near_values = K.Prober(near), near_values

    def batch(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, ...]]]:
        """Sums (known, base, added) of each text, and by kind the questions: columns of numbers, the first of which gives the bucket."""
        n = len(first) - 1
        stream, place = _with_ends(words, first)
        text = np.repeat(np.arange(n, dtype=np.int32), np.diff(first) + 2)
        is_word = (place > 0) & (stream != _END_HASH)
        at = np.flatnonzero(is_word)
        found = self.common.find(stream[at])
        hit, miss = at[found >= 0], at[found < 0]
        base = np.log10(self.common_n[found[found >= 0]] + 1.0) + self.unit if len(hit) else np.zeros(0)
        sums = np.zeros((3, n))
        sums[0] = np.bincount(text[hit], minlength=n) + (self.ends > 0)
        sums[1] = np.bincount(text[hit], base, n) + math.log10(self.ends + 1) + self.unit
        maybe = np.zeros(len(miss), bool) if self.complete else self.symbols.maybe(stream[miss])
        rare, unsure = np.zeros(len(stream), bool), np.zeros(len(stream), bool)
        rare[miss[~maybe]] = unsure[miss[maybe]] = True
        asked = {1: (stream[miss], text[miss])}

        contexts, runs, run = [], [], stream
        for _ in range(self.depth):
            context = np.concatenate([run[:1], run[:-1]])  # the first place of a text has none
            run = _id(context, run)
            contexts.append(context)
            runs.append(run)
        other = np.full(len(miss), _RARE_HASH)  # the same runs with the symbol of rare words at the end
        others = []
        for context in contexts:
            other = _id(context[miss], other)
            others.append(other)
        number = np.full(len(stream), -1)
        number[miss] = np.arange(len(miss))

        open_ = place > 0
        plain, double = [], []
        for d in range(self.depth, 0, -1):
            context, run, other = contexts[d - 1], runs[d - 1], others[d - 1]
            at = np.flatnonzero(open_ & (place >= d))
            at = at[self.lookup.maybe(context[at] ^ _CONTEXT)]
            key = run[at]
            key[rare[at]] = other[number[at[rare[at]]]]
            found = self.near.find(key ^ _ENTRY)
            hit = found >= 0
            sums[2] += np.bincount(text[at[hit]], self.near_values[found[hit]] if hit.any() else None, n)
            open_[at[hit]] = False  # shorter contexts are in that value
            at, key = at[~hit], key[~hit]
            both = np.zeros(len(at), bool)
            u = np.flatnonzero(unsure[at])
            both[u] = self.lookup.maybe(other[number[at[u]]] ^ _ENTRY)
            double.append((context[at[both]], run[at[both]], other[number[at[both]]], text[at[both]], at[both].astype(np.int32)))
            at, key = at[~both], key[~both]
            has = self.lookup.maybe(key ^ _ENTRY)
            found = self.near.find(context[at] ^ _CONTEXT)
            alone = ~has & (found >= 0)
            sums[2] += np.bincount(text[at[alone]], self.near_values[found[alone]] if alone.any() else None, n)
            at, key, has = at[~alone], key[~alone], has[~alone]
            plain.append((context[at], np.where(has, key, K.U64(0)), text[at]))
        asked[2] = tuple(np.concatenate(x) for x in zip(*plain, strict=True)) if plain else (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int32),)
        if any(len(x[0]) for x in double):
            asked[4] = tuple(np.concatenate(x) for x in zip(*double, strict=True))
            which = np.unique(asked[4][4])
            asked[3] = (stream[which], which)
        return sums, asked


def _pack_columns(columns: tuple[np.ndarray, ...]) -> bytes:
    return len(columns[0]).to_bytes(8, "little") + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _columns(data: bytes, kinds: tuple) -> list[np.ndarray]:
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


_U, _I, _D = np.uint64, np.int32, np.float64
_ASKED = {1: (_U, _I), 2: (_U, _U, _I), 3: (_U, _I), 4: (_U, _U, _U, _I, _I)}  # words and texts; runs and texts; words and places; runs that are one of two
_SAID = {1: (_I, _D, _D), 2: (_I, _D), 3: (_I, np.int8), 4: (_I, _I, _D, _D)}  # texts, known, base; texts, sums; places, rare; texts, places, either value


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], *(np.add.reduceat(v[order], head) if len(head) else v for v in values)


def score(docs: DataFrame, text: Column, keep: list[str], tree: Tree, table: DataFrame, buckets: int) -> DataFrame:
    """Columns ``keep`` with n_tokens, n_known, base_score and score for every row.

    Null and empty texts hold one end token; rows may repeat, and ``keep`` may
    hold any columns, also null ones.  Texts of any length are scored whole.
    """
    spark = docs.sparkSession
    keep = apart(keep, ["n_tokens", "n_known", "base_score", "score"])
    bound_batches(spark, 2)
    rows = docs.select(*[F.col(c) for c in keep], text.alias("__text"))
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    lookup = _lookup(tree)
    sieve = _sieve(lookup.select("key"), lookup.count())
    bound = spark.sparkContext.broadcast((tree.log_unit, len(tree.entries), tree.ends, len(tree.common) == tree.kinds, tree.sieve, sieve, tree.common, tree.common_n, *_frequent(tree, lookup)))
    unit, least = tree.log_unit, tree.least
    names = ["bucket", "kind", "block", "data"]
    wire = "bucket int, kind int, block bigint, data binary"

    def packed(bucket: list[int], kind: list[int], block: list[int], data: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(block, pa.int64()), pa.array(data, pa.binary())], names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(*bound.value)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            words, first = K.hashed(batch.column(len(keep)), K.BLANK)
            sums, asked = scorer.batch(words, first)
            own = pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.diff(first) + 1), *(pa.array(x) for x in sums)], [*keep, "n", "known", "base", "added"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema) as w:
                w.write_batch(own)
            bucket, kind, data = [block * 7919 % buckets], [9], [sink.getvalue().to_pybytes()]
            for k, columns in asked.items():
                order, begin = _split(K.mix(columns[0]), buckets, columns[0])
                columns = [c[order] if c.dtype.itemsize == 8 else c[order].astype(_I) for c in columns]
                for b in np.flatnonzero(np.diff(begin)).tolist():
                    bucket.append(b)
                    kind.append(k)
                    data.append(_pack_columns(tuple(c[begin[b] : begin[b + 1]] for c in columns)))
            yield packed(bucket, kind, [block] * len(bucket), data)
            block += 1

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Word counts as rows of kind -1."""
        for batch in batches:
            data = [_pack_columns((np.frombuffer(k, _U), np.frombuffer(c, np.int64).astype(float))) for k, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield packed(batch.column(0).to_pylist(), [-1] * len(data), [0] * len(data), data)

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries and contexts, in the bucket of the context, as rows of kind 0."""
        waiting: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            context, keys, values = (np.concatenate(x) for x in zip(*waiting, strict=True))
            order, begin = _split(K.mix(context), buckets)
            keys, values = keys[order], values[order]
            full = np.flatnonzero(np.diff(begin)).tolist()
            return packed(full, [0] * len(full), [0] * len(full), [_pack_columns((keys[begin[b] : begin[b + 1]], values[begin[b] : begin[b + 1]])) for b in full])

        for batch in batches:
            waiting.append(tuple(batch.column(i).to_numpy(zero_copy_only=False).view(t) for i, t in enumerate((_U, _U, _D))))
            if sum(len(x[0]) for x in waiting) > _WAITING:
                yield out()
                waiting.clear()
        if waiting:
            yield out()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, tables = None, {}, {}

        def find(kind: int, keys: np.ndarray) -> np.ndarray:
            """Values of the bucket's words (-1) or runs (0); nan where there is none."""
            if kind not in tables:
                got = parts.pop(kind, [])
                own = np.concatenate([np.zeros(0, _U), *(k for k, _ in got)])
                order = np.argsort(own)
                tables[kind] = K.Prober(own[order]), np.concatenate([np.zeros(0), *(v for _, v in got)])[order]
            prober, values = tables[kind]
            at = prober.find(keys)
            return np.where(at >= 0, values[at], np.nan) if len(values) else np.full(len(keys), np.nan)

        def runs(context: np.ndarray, run: np.ndarray) -> np.ndarray:
            back = np.nan_to_num(find(0, context ^ _CONTEXT))
            own = find(0, run ^ _ENTRY)
            return np.where(np.isnan(own), back, own)

        for batch in batches:
            out = []
            for bucket, kind, block, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket != now:
                    now, parts, tables = bucket, {}, {}
                if kind <= 0:
                    parts.setdefault(kind, []).append(_columns(data, (_U, _D)))
                    continue
                if kind == 1:
                    word, where = _columns(data, _ASKED[1])
                    n = np.nan_to_num(find(-1, word))
                    data = _pack_columns(_sum_by(where, (n > 0).astype(_D), np.log10(n + 1) + unit))
                elif kind == 2:
                    context, run, where = _columns(data, _ASKED[2])
                    data = _pack_columns(_sum_by(where, runs(context, run)))
                elif kind == 3:
                    word, where = _columns(data, _ASKED[3])
                    data = _pack_columns((where, (np.nan_to_num(find(-1, word)) < least).astype(np.int8)))
                elif kind == 4:
                    context, run, other, where, place = _columns(data, _ASKED[4])
                    data = _pack_columns((where, place, runs(context, run), runs(context, other)))
                out.append((bucket, kind, block, data))
            if out:
                yield packed(*(list(x) for x in zip(*out, strict=True)))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, sums, seldom, two = None, None, None, [], []

        def out() -> pa.RecordBatch:
            known, base, added = sums
            if two:
                place, rare = (np.concatenate(x) for x in zip(*seldom, strict=True))
                is_rare = np.zeros(int(place.max()) + 1, bool)
                is_rare[place] = rare > 0
                for where, at, plain, other in two:
                    np.add.at(added, where, np.where(is_rare[at], other, plain))
            return pa.RecordBatch.from_arrays([*own.columns[: len(keep) + 1], pa.array(known.astype(np.int64)), pa.array(base), pa.array(base + added)], [*keep, "n_tokens", "n_known", "base_score", "score"])

        for batch in batches:
            for block, kind, data in zip(*(batch.column(i).to_pylist() for i in (2, 1, 3)), strict=True):
                if block != now:
                    if own is not None:
                        yield out()
                    now, seldom, two = block, [], []
                    own = pa.ipc.open_stream(pa.py_buffer(data)).read_next_batch()  # kind 9 comes first
                    sums = [own.column(len(keep) + i).to_numpy().copy() for i in (1, 2, 3)]
                elif kind == 3:
                    seldom.append(_columns(data, _SAID[3]))
                elif kind == 4:
                    two.append(_columns(data, _SAID[4]))
                else:
                    where, *values = _columns(data, _SAID[kind])
                    for total, v in zip(sums[:2] if kind == 1 else sums[2:], values, strict=True):
                        total[where] += v  # no text twice in one answer
        if own is not None:
            yield out()

    asked = rows.mapInArrow(K.tidy(ask), wire).unionAll(table.select("bucket", "keys", "counts").mapInArrow(K.tidy(known), wire)).unionAll(lookup.select("ctx", "key", "value").mapInArrow(K.tidy(learned), wire))
    answered = asked.repartition(_tasks(buckets), "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(K.tidy(answer), wire)
    return answered.repartition("block").sortWithinPartitions("block", F.desc("kind")).mapInArrow(K.tidy(join), f"{kept}, n_tokens bigint, n_known bigint, base_score double, score double")
