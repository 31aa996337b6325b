"""Chat formatting at token level.

Segments are encoded one by one, each turn on the map side, and reserved ids
are spliced between them: a turn is its role's id, the ids of its text, and
the id that ends a turn.  No text can give a reserved id, as they lie beyond
the tokenizer's own; control strings that occur in a text are escaped all the
same, so that the rendered form is reversible too.  The loss mask is the
running sum of +1 where an assistant's text begins and -1 where it ends.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.store import bound_batches

#: Names in the template; a role that is none of the first three is written out after "Other".
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
OTHER = "Other"
CLOSE = "</turn>"
_CONTROL = r"(?:### (?:System|User|Assistant|Other):|</turn>)"
_PLAIN = re.compile(rf"(\\*){_CONTROL}")
_ESCAPED = re.compile(rf"\\((?:\\*){_CONTROL})")


def escape(text: str) -> str:
    """One backslash before every control string and the backslashes that precede it."""
    return _PLAIN.sub(lambda m: "\\" + m.group(0), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Codec:
    """A byte-level tokenizer with reserved ids behind its own: roles, the end of a written-out role, the end of a turn."""

    def __init__(self, path: str, pattern: str, names: int) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.first = names
        self.role = {r: names + i for i, r in enumerate(ROLES)}
        self.other, self.named, self.close = names + 3, names + 4, names + 5

    def encode(self, text: str) -> list[int]:
        return self.enc.encode_ordinary(text)

    def decode(self, ids: np.ndarray) -> str:
        return self.enc.decode_bytes(ids.tolist()).decode("utf-8")

    def head(self, role: str) -> list[int]:
        return [self.role[role]] if role in self.role else [self.other, *self.encode(role), self.named]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str, names: int) -> Codec:
    return Codec(path, pattern, names)


def assemble(c: Codec, role: str, text: list[int]) -> tuple[list[int], bytes]:
    """Ids of a turn, and its loss mask by prefix sums."""
    head = c.head(role)
    ids = [*head, *text, c.close]
    step = np.zeros(len(ids) + 1, np.int8)
    if role == "assistant":
        step[len(head)] += 1
        step[len(head) + len(text)] -= 1
    return ids, np.cumsum(step, dtype=np.int8)[: len(ids)].tobytes()


def render(c: Codec, ids: np.ndarray) -> str:
    """The template as text."""
    return "".join(f"### {ROLES.get(role, OTHER)}:{'' if role in ROLES else f' {escape(role)}'}\n{body}\n{CLOSE}\n" for role, body in _segments(c, ids))


def parse(c: Codec, ids: np.ndarray) -> list[tuple[str, str]]:
    """Roles and texts, read back from the ids."""
    return [(role, unescape(body)) for role, body in _segments(c, ids)]


def _segments(c: Codec, ids: np.ndarray) -> Iterator[tuple[str, str]]:
    names = {v: k for k, v in c.role.items()}
    begin = 0
    for end in np.flatnonzero(ids == c.close).tolist():
        head = int(ids[begin])
        if head == c.other:
            cut = begin + int(np.flatnonzero(ids[begin:end] == c.named)[0])
            yield c.decode(ids[begin + 1 : cut]), c.decode(ids[cut + 1 : end])
        else:
            yield names[head], c.decode(ids[begin + 1 : end])
        begin = end + 1


def loss_texts(c: Codec, ids: np.ndarray, mask: np.ndarray) -> list[str]:
    """The texts under the mask, unescaped, in order."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]).astype(np.int8)))
    return [unescape(c.decode(ids[a:b])) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def format_chats(rows: DataFrame, conv: Column, turn: Column, role: Column, text: Column, tokenizer: str, pattern: str, names: int = 50_257) -> DataFrame:
    """One row for each turn: conv_id, place (from 0), start, ids (binary, little-endian uint32), loss_mask (binary, a byte for each id).

    A conversation is its turns' ids in order of place; start counts the ids
    before a turn.  Turns are ordered by turn (null first), then role and a
    hash of the text, so repeated turn numbers have one order.  Null texts are
    empty; a null role is the empty role; any other role than system, user and
    assistant is written out.  Rows with a null conv_id form one conversation.

    Turns are encoded where they are read.  Only places and starts need a
    conversation's rows together, and those are running sums over a sort that
    spills: memory does not grow with the length of a conversation.
    """
    spark = rows.sparkSession
    bound_batches(spark, 8)
    got = rows.select(conv.cast("long").alias("conv_id"), turn.cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    got = got.withColumn("tie", F.xxhash64("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer, pattern, names)
        for batch in batches:
            turns = [assemble(c, r, c.encode(escape(t))) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            ids = pa.array([np.array(i, "<u4").tobytes() for i, _ in turns], pa.binary())
            size = pa.array([len(i) for i, _ in turns], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), size, ids, pa.array([m for _, m in turns], pa.binary())], ["conv_id", "turn", "role", "tie", "size", "ids", "loss_mask"])

    coded = got.mapInArrow(encode, "conv_id bigint, turn bigint, role string, tie bigint, size bigint, ids binary, loss_mask binary")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "tie")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    coded = coded.repartition("conv_id")
    return coded.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("place"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), "ids", "loss_mask")


class _Reader:
    """What a reader of one conversation has seen so far."""

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.whole, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, c: Codec, ids: np.ndarray, mask: np.ndarray) -> None:
        for role, text in parse(c, ids):
            self.turns += 1
            self.whole.update(f"{role}\n{text}\n".encode())
        for text in loss_texts(c, ids, mask):
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.chars += len(render(c, ids))


def digests(chats: DataFrame, tokenizer: str, pattern: str, names: int = 50_257) -> DataFrame:
    """One row for each conversation: what a reader of ``format_chats``' ids and masks sees, as digests.

    Rows must lie by conv_id, as ``format_chats`` leaves them.  They are read
    in order with running digests, so a conversation's length costs no memory.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer, pattern, names)
        now, reader, done = None, _Reader(), []

        def flush() -> pa.RecordBatch:
            rows = [(k, r.turns, r.whole.hexdigest(), r.loss_chars, r.loss.hexdigest(), r.chars) for k, r in done]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for conv, ids, mask in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if now != (conv,):
                    if now:
                        done.append((now[0], reader))
                    now, reader = (conv,), _Reader()
                reader.read(c, np.frombuffer(ids, "<u4").astype(np.int64), np.frombuffer(mask, np.uint8))
            if done:
                yield flush()
        if now:
            done.append((now[0], reader))
            yield flush()

    rows = chats.sortWithinPartitions("conv_id", "place").select("conv_id", "ids", "loss_mask")
    return rows.mapInArrow(read, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
