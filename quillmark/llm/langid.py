"""Language identification by hyperdimensional profiles.

Every letter owns a random vector of +1/-1, drawn from a hash of its code
point.  A letter trigram is the product (binding) of its letters' vectors,
each rotated (permuted) by its distance from the end; a text is the sum
(bundling) of its trigrams; a language is the sum over its training texts.  A
text is compared with every language by cosine.

Letter vectors are a pure function of seed and letter, so workers make those
they meet, and nothing but the language vectors (languages x dimensions
numbers) is broadcast.  Training adds vectors up inside each task first and
sums them with one aggregation on (language, component), then puts each
language's sums into one row.  Up to MOST_LANGUAGES languages are compared at
once; more stay a table, of which one block after the other is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm import kernels as K
from quillmark.llm.store import apart, bound_batches, materialize
from quillmark.sources.readers import numbered

UNDETERMINED = "und"
MOST_LANGUAGES = 2_000  # prototypes that are collected and broadcast at a time
_TABLE = 0x3000
_BITS = 21  # of a code point in a trigram's code
_PIECE = 2048  # trigrams bound at once


def _letter(cp: int) -> int:
    """The lower case of a letter, as a code point; 0 for what is no letter."""
    c = chr(cp)
    return ord(c.lower()[0]) if c.isalpha() else 0


@lru_cache(maxsize=1)
def alphabet() -> np.ndarray:
    """``_letter`` of every code point below 0x3000."""
    return np.array([_letter(cp) for cp in range(_TABLE)], np.int64)


def letter_vectors(letters: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """int8, letters x dims: each letter's own vector of +1/-1 (0, the gap between words, has one too)."""
    words = -(-dims // 64)
    with np.errstate(over="ignore"):
        at = letters.astype(np.uint64)[:, None] * K.U64(words) + np.arange(words, dtype=np.uint64)
        bits = K.mix(K.mix(at + K.U64(seed) * K._MULT) + K._MULT)
    return (np.unpackbits(bits.view(np.uint8), axis=1)[:, :dims].astype(np.int8) << 1) - np.int8(1)


def bind(codes: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """int8, trigrams x dims: the product of the rotated letter vectors."""
    mask = (1 << _BITS) - 1
    places = [codes >> (2 * _BITS), (codes >> _BITS) & mask, codes & mask]
    letters = np.unique(np.concatenate(places))
    vectors = letter_vectors(letters, dims, seed)
    out = np.ones((len(codes), dims), np.int8)
    for turn, at in zip((2, 1, 0), places, strict=True):
        out *= np.roll(vectors, turn, axis=1)[np.searchsorted(letters, at)]
    return out


def _letters(text: str) -> np.ndarray:
    """Letters of a text in lower case, runs of non-letters as one 0, a 0 at both ends."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = alphabet()
    out = np.zeros(len(codes) + 2, np.int64)
    far = codes >= _TABLE
    if far.any():
        out[1:-1] = table[np.where(far, 0, codes)]
        distinct, index = np.unique(codes[far], return_inverse=True)
        out[1:-1][far] = np.array([_letter(int(c)) for c in distinct], np.int64)[index]
    else:
        out[1:-1] = table[codes]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram codes of a text and their counts; none if it has no letter."""
    c = _letters(text) if text else np.zeros(0, np.int64)
    if not c.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return K.tally((c[:-2] << (2 * _BITS)) | (c[1:-1] << _BITS) | c[2:])


def bundles(texts: list[str | None], dims: int, seed: int) -> np.ndarray:
    """One vector for each text (rows of zeros where there is no letter)."""
    grams = [trigrams(t) for t in texts]
    used = np.unique(np.concatenate([g for g, _ in grams])) if grams else np.zeros(0, np.int64)
    out = np.zeros((len(texts), dims), np.float64)
    for lo in range(0, len(used), _PIECE):
        part = used[lo : lo + _PIECE]
        weights = np.zeros((len(texts), len(part)), np.float32)
        for i, (g, n) in enumerate(grams):
            a, b = np.searchsorted(g, part[0]), np.searchsorted(g, part[-1], side="right")
            weights[i, np.searchsorted(part, g[a:b])] = n[a:b]
        out += weights @ bind(part, dims, seed).astype(np.float32)
    return out


def _groups(texts: list[str | None], most: int = 96, chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and j - i < most and (j == i or n + len(texts[j] or "") <= chars):
            n += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def fit(docs: DataFrame, text: Column, lang: Column, dims: int = 1024, seed: int = 7) -> dict[str, np.ndarray] | DataFrame:
    """Language vectors from all rows with a text and a language; unit length.

    Each text counts with its own length, so long and short ones weigh by their
    letters; repeated rows count each.  Without rows there is no language.
    More than MOST_LANGUAGES languages are given as a table (lang, vector).
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, tuple[list, list]] = {}
        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g, n = trigrams(t)
                if len(g):
                    keys, sizes = counts.setdefault(name, ([], []))
                    keys.append(g)
                    sizes.append(n)
                    if len(keys) >= 256:
                        k, c = K.tally(np.concatenate(keys), np.concatenate(sizes))
                        counts[name] = ([k], [c])
        for name, (keys, sizes) in counts.items():
            k, c = K.tally(np.concatenate(keys), np.concatenate(sizes))
            total = np.zeros(dims, np.int64)
            for lo in range(0, len(k), _PIECE):
                total += np.rint(c[lo : lo + _PIECE].astype(np.float64) @ bind(k[lo : lo + _PIECE], dims, seed).astype(np.float64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * dims), pa.array(np.arange(dims, dtype=np.int32)), pa.array(total)], ["lang", "dim", "value"])

    bound_batches(docs.sparkSession)
    rows = docs.select(text.alias("text"), lang.alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sums = rows.mapInArrow(partial, "lang string, dim int, value bigint").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    # a row for each language: as many numbers as a vector has components
    rows = sums.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"].cast("double")).alias("vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    vectors = materialize(rows.where(square > 0), "profiles")
    return vectors if vectors.count() > MOST_LANGUAGES else _collected(vectors)


def _collected(vectors: DataFrame) -> dict[str, np.ndarray]:
    """Unit vectors of MOST_LANGUAGES languages at most, in order of their names."""
    rows = sorted(vectors.select("lang", "vector").collect(), key=lambda r: r.lang)
    whole = ((r.lang, np.array(r.vector)) for r in rows)
    return {name: v / np.linalg.norm(v) for name, v in whole}


def identify(docs: DataFrame, text: Column, profiles: dict[str, np.ndarray] | DataFrame, keep: list[str], dims: int = 1024, seed: int = 7) -> DataFrame:
    """Columns ``keep`` with ``lang_pred`` and ``score`` (the cosine, not below 0).

    Null texts, texts without any letter and, if no language was learned, all
    texts get ``und`` and 0.  Ties go to the language that sorts first.
    Rows are only mapped: no shuffle.  A kept column with the name of an output
    gives way to it.  Of a table of languages one block after the other is
    compared, and the best so far kept beside the text, which is stored each time.
    """
    keep = apart(keep, ["lang_pred", "score"])
    bound_batches(docs.sparkSession)
    kept = docs.select(*[F.col(c) for c in keep], text.alias("__text"))
    if isinstance(profiles, dict):
        return _compared(kept, profiles, keep, dims, seed).withColumn("score", _share(F.col("score")))
    placed = materialize(numbered(profiles.select("lang", "vector"), ["lang"], "n"), "blocks")
    for block in range(-(-placed.count() // MOST_LANGUAGES)):
        part = _collected(placed.where((F.col("n") > block * MOST_LANGUAGES) & (F.col("n") <= (block + 1) * MOST_LANGUAGES)))
        now = _compared(kept, part, [*kept.columns], dims, seed).withColumnsRenamed({"lang_pred": "__new", "score": "__cos"})
        if block == 0:
            best = now.select(*keep, "__text", F.col("__new").alias("__lang"), F.col("__cos").alias("__best"))
        else:  # names of later blocks sort later, so a tie stays with the first
            better = F.col("__cos") > F.col("__best")
            best = now.select(*keep, "__text", F.when(better, F.col("__new")).otherwise(F.col("__lang")).alias("__lang"), F.greatest("__cos", "__best").alias("__best"))
        kept = materialize(best, "best")
    return kept.select(*keep, F.col("__lang").alias("lang_pred"), _share(F.col("__best")).alias("score"))


def _share(cosine: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine))


def _compared(kept: DataFrame, profiles: dict[str, np.ndarray], keep: list[str], dims: int, seed: int) -> DataFrame:
    """Columns ``keep`` with the best of these languages and its cosine; the text is the column __text."""
    names = list(profiles)
    matrix = np.array([profiles[n] for n in names]).T.reshape(dims, len(names))
    bound = kept.sparkSession.sparkContext.broadcast((names, matrix))
    kept = kept.select(*keep, F.col("__text").alias("__read"))
    schema = ", ".join([*(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string", "score double"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = bound.value
        for batch in batches:
            column = batch.column(len(keep))
            n = len(column)
            best, cos = np.full(n, -1), np.zeros(n)
            texts = column.to_pylist()
            for i, j in _groups(texts) if names else ():
                v = bundles(texts[i:j], dims, seed)
                norm = np.linalg.norm(v, axis=1)
                some = norm > 0
                c = np.zeros((j - i, len(names)))
                c[some] = (v[some] @ matrix) / norm[some, None]
                best[i:j] = np.where(some, c.argmax(axis=1), -1)
                cos[i:j] = np.where(some, c.max(axis=1), 0)
            pred = pa.array([names[b] if b >= 0 else UNDETERMINED for b in best], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pred, pa.array(cos)], [*keep, "lang_pred", "score"])

    return kept.mapInArrow(score, schema)
