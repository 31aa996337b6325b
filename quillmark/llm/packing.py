"""Power-of-two packing: every document is cut into pieces of binary length.

A document of L tokens becomes L // max_length pieces of ``max_length`` and one
piece for each set bit of the rest, longest first.  Each piece is a sequence
of its own and goes to the bucket of its length: sequences of one bucket form
batches without any padding, and no sequence holds tokens of two documents.
A piece depends on its document alone, so the operator only maps rows: no
shuffle, nothing kept between batches but the tokenizer's word cache.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.store import bound_batches

_CHUNKS, _PIECES = 300_000, 400_000  # entries that the caches may hold
_ODD = regex.compile("[\x1c-\x1f]")  # str.split() splits here, tokenizers do not
_PLAIN = regex.compile("[\x21-\x7e\xa1-\xac\xae-įĲ-ɏ]+")  # stable under NFC, lower case by character


class _Table(dict):
    """Text to index; new texts get the next index and wait in ``new``."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        self[key] = n = len(self)
        return n


class WordBpe:
    """Ids of a whitespace-dropping, lower-casing BPE with word ends, as ``tokenizers`` gives them.

    White space never joins tokens there, so a text's ids are the ids of its
    blank-separated chunks in turn.  Chunks are cached by text.  A new chunk of
    plain characters is cut into words by the tokenizer's own pattern and each
    new word merged by a rank table; any other chunk goes through the
    tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._ranks(spec)
        self.pieces: dict[str, bytes] = {}
        self.reset()

    def _ranks(self, spec: dict) -> None:
        from tiktoken import _tiktoken

        model, normal, pre = spec["model"], spec["normalizer"], spec["pre_tokenizer"]
        kinds = [n["type"] for n in normal.get("normalizers", [])] if normal else []
        self.fast = kinds == ["NFC", "Replace", "Lowercase"] and model["end_of_word_suffix"] == "</w>" and [p["type"] for p in pre["pretokenizers"]] == ["Split", "ByteLevel"]
        if not self.fast:
            raise ValueError("this tokenizer isn't a lower-casing BPE with word ends")
        self.words = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"])
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

        def raw(token: str) -> bytes:  # 0xFF never occurs in UTF-8: it stands for the word end
            return bytes(byte_of[c] for c in token.removesuffix("</w>")) + b"\xff" * token.endswith("</w>")

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 255]): 256 + b for b in range(255)}
        for m in model["merges"]:
            ranks.setdefault(raw("".join(m if isinstance(m, list) else m.split(" "))), len(ranks))
        ids = {raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.id_of = np.full(len(ranks) + 1, -1, np.int32)
        for t, k in ranks.items():
            self.id_of[k] = ids.get(t, -1)
        self.merge = _tiktoken.CoreBPE(ranks, {}, "(?s).+").encode_single_piece

    def reset(self) -> None:
        self.chunks: _Table = _Table()
        self.flat, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _new(self, chunk: str) -> bytes:
        """Ids of a chunk that isn't in the cache, as int32."""
        if not _PLAIN.fullmatch(chunk) or ("<" in chunk and any(s in chunk for s in self.special)):
            return np.array(self.full.encode(chunk, add_special_tokens=False).ids, np.int32).tobytes()
        words = self.words.findall(chunk.lower())
        try:
            return b"".join([self.pieces[w] for w in words])
        except KeyError:
            pass
        if len(self.pieces) >= _PIECES:
            self.pieces.clear()
        for w in words:
            if w not in self.pieces:
                self.pieces[w] = self.id_of[self.merge(w.encode() + b"\xff")].tobytes()
        return b"".join([self.pieces[w] for w in words])

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, ``end`` after each, and where each text's begin (n + 1 values)."""
        if len(self.chunks) > _CHUNKS:
            self.reset()
        rows, odd = [], {}
        get = self.chunks.__getitem__
        for i, t in enumerate(texts):
            if _ODD.search(t):
                odd[i] = np.array(self.full.encode(t, add_special_tokens=False).ids, np.int32)
                rows.append(np.zeros(0, np.int32))
            else:
                words = t.split()
                rows.append(np.fromiter(map(get, words), np.int32, len(words)))
        if self.chunks.new:
            fresh = [self._new(c) for c in self.chunks.new]
            self.chunks.new.clear()
            sizes = np.fromiter(map(len, fresh), np.int64, len(fresh)) // 4
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(fresh), np.int32)])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        size = np.diff(self.begin)
        out = []
        for i, row in enumerate(rows):
            if i in odd:
                out.append(odd[i])
            elif len(row):
                n = size[row]
                total = int(n.sum())
                at = np.repeat(self.begin[row] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
                out.append(self.flat[at])
            else:
                out.append(row)
            out.append(np.array([end], np.int32))
        lengths = np.array([len(out[2 * i]) + 1 for i in range(len(texts))], np.int64)
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(lengths)])


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    return WordBpe(path)


def piece_lengths(n: int, most: int) -> list[int]:
    """Full pieces, then the powers of two in the rest, longest first."""
    out = [most] * (n // most)
    rest = n % most
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, doc_id: Column, text: Column, tokenizer: str, end_id: int = 2, max_length: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset, bucket.

    ``max_length`` must be a power of two.  Null texts are empty and give one
    piece with the end id alone; repeated rows are packed each on its own;
    doc_id may be null.  sequence_id is the task's number and a counter, so it
    is unique in one run and comes out the same when a task is run again.
    """
    if max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    bound_batches(docs.sparkSession, 4)
    rows = docs.select(doc_id.cast("long").alias("doc_id"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        next_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, begin = enc.encode([t or "" for t in batch.column(1).to_pylist()], end_id)
            total = np.diff(begin)
            lengths = [piece_lengths(int(n), max_length) for n in total]
            row = np.repeat(np.arange(len(total)), [len(x) for x in lengths])
            length = np.array([x for p in lengths for x in p], np.int64)
            at = np.concatenate([[0], np.cumsum(length)])
            n = len(length)
            binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(at[:-1] - begin[row]), pa.array(length), binary, pa.array(total[row]), pa.array(np.arange(next_id, next_id + n)), pa.array(np.zeros(n, np.int64)), pa.array(length.astype(np.int32))],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "bucket"],
            )
            next_id += n

    return rows.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, bucket int")


def digest(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
