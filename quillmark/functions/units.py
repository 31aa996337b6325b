"""Segmentation of texts as Arrow kernels.

Sentence ends, separators and display math depend on what was found before, so
expressions would fold over growing arrays; here a text is cut once, in one
pass of a worker over an Arrow batch.  Wherever a piece must be hidden for a
while, a character stands for it that does not occur in the text, so no
character of a text is ever taken for a mark.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Abbreviations whose dots are no sentence ends.
REFERENCE_ABBREVIATIONS = ["e.g.", "i.e.", "etc.", "Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "vs.", "Fig.", "Eq.", "Prop.", "Thm.", "Cor.", "No."]
EVALUATION_ABBREVIATIONS = [
    "Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Sr.", "Jr.", "St.", "Co.", "Inc.", "Ltd.", "vs.", "etc.", "e.g.", "i.e.", "cf.", "Fig.", "Eq.", "Sec.", "No.", "pp.", "Ch.",
    "et al.", "al.",
    "U.S.", "U.K.", "U.N.",
]

_REFERENCE_LONGEST_FIRST, _EVALUATION_LONGEST_FIRST = (sorted(a, key=len, reverse=True) for a in (REFERENCE_ABBREVIATIONS, EVALUATION_ABBREVIATIONS))

# What ends a sentence of a reference and of a generation, what a long sentence may be cut at, and LaTeX environments.
REFERENCE_END = re.compile(r"[.!?;]+(?:\s+|\Z)")
EVALUATION_END = re.compile(r"""(?:(?<!\d)\.(?!\d)|[!?;])(?=[)"'\]}]*\s+|\Z)""")
SEPARATOR = re.compile(r"(,|;|:|\band\b|\bor\b|\bthen\b|\bwhich\b)")
BEGIN = re.compile(r"\\begin\{([a-zA-Z*]+)\}")
BRACKETS, DOLLARS = re.compile(r"(?s)\\\[(.+?)\\\]"), re.compile(r"(?s)\$\$.+?\$\$")
EDGES = " ,;:"

UNIT = "struct<id:int,type:string,content:string,paragraph_index:int>"
Unit = tuple[str, str, int]  # type, content, paragraph


def free(text: str) -> str:
    """A character that does not occur in the text."""
    code = 0xE000
    while chr(code) in text:
        code += 1
    return chr(code)


def _cut(text: str, abbreviations: list[str], end: re.Pattern, clean: Callable[[str], str]) -> list[str]:
    dot, held = free(text), False
    for a in abbreviations:
        if a in text:
            held, text = True, text.replace(a, a.replace(".", dot))
    edges = [0, *(m.end() for m in end.finditer(text)), len(text)]
    pieces = [clean(text[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return [p.replace(dot, ".") if held else p for p in pieces if p]


def reference_sentences(text: str) -> list[str]:
    """Runs of . ! ? ; before white space or the end close a sentence."""
    return _cut(text, _REFERENCE_LONGEST_FIRST, REFERENCE_END, str.strip)


def evaluation_sentences(text: str) -> list[str]:
    """One ender before closing marks and white space closes a sentence, but no dot beside a digit; white space is collapsed."""
    return _cut(text, _EVALUATION_LONGEST_FIRST, EVALUATION_END, lambda s: " ".join(s.split()))


def wrapped(sentence: str, most: int, fix_spacing: bool = False) -> list[str]:
    """A long sentence in pieces of up to ``most`` characters, filled one separator or stretch after the other."""
    whole = sentence.strip()
    if len(whole) <= most:
        return [whole]
    trim = (lambda s: s) if fix_spacing else str.strip
    lines = [""]
    for part in SEPARATOR.split(whole):
        longer = trim(lines[-1] + part)
        if len(longer.strip()) <= most:
            lines[-1] = longer
        elif lines[-1]:
            lines.append(trim(part))
        else:
            lines[-1] = trim(part)
    kept = [line.strip(EDGES) for line in lines]
    return [line for line in kept if line] or [whole]


def environments(text: str) -> list[tuple[int, int]]:
    """Places of LaTeX environments: each from its begin to the first end of its name after it; those that overlap or touch are one."""
    spans: list[tuple[int, int]] = []
    ends: dict[str, int] = {}  # of each name, where its next end is; looked for again only once passed
    for m in BEGIN.finditer(text):
        mark = f"\\end{{{m.group(1)}}}"
        at = ends.get(mark, 0)
        if 0 <= at < m.end():
            at = ends[mark] = text.find(mark, m.end())
        if at < 0:
            continue
        start, stop = m.start(), at + len(mark)
        if spans and start <= spans[-1][1]:
            start, stop = spans[-1][0], max(spans.pop()[1], stop)
        spans.append((start, stop))
    return spans


def math_blocks(text: str, compat: bool = False) -> list[tuple[str, str]]:
    """Display math and the text around it, in order; environments outside of it hide what they contain."""
    if "\\[" in text:
        text = BRACKETS.sub(lambda m: f"$${m.group(1)}$$", text)
    if "$$" not in text:  # environments stay in the text as they are
        return [("text", whole)] if (whole := text.strip()) else []
    places = environments(text)
    hidden, mark = [text[a:b] for a, b in places], free(text)
    shown = mark.join(text[a:b] for a, b in zip([0, *(b for _, b in places)], [*(a for a, _ in places), len(text)], strict=True))
    out, at, seen = [], 0, 0

    def back(piece: str, numbered: bool) -> str:
        nonlocal seen
        parts = piece.split(mark)
        names = [f"@@LATEXENV{seen + i}@@" if numbered else hidden[seen + i] for i in range(len(parts) - 1)]
        seen += len(names)
        return "".join(a + b for a, b in zip(parts, [*names, ""], strict=True)).strip()

    for m in DOLLARS.finditer(shown):
        out += [("text", back(shown[at : m.start()], False)), ("math", back(m.group(), compat))]
        at = m.end()
    out.append(("text", back(shown[at:], False)))
    return [b for b in out if b[1]]


def paragraphs(text: str) -> list[str]:
    """Of a normalised text: what lies between blank lines, stripped, without empty ones."""
    return [p for p in map(str.strip, re.split(r"\n\s*\n+", text)) if p]


def normalized(text: str) -> str:
    return re.sub(r"[ \t\r\f\v]+", " ", text.replace("\r\n", "\n").replace("\r", "\n")).strip("\n ")


def raw(text: str, most: int = 220, keep_math: bool = True, compat: bool = False) -> list[Unit]:
    """Units of a solution before short ones are merged."""
    out: list[Unit] = []
    for number, paragraph in enumerate(paragraphs(normalized(text))):
        for kind, content in math_blocks(paragraph, compat):
            if kind == "math" and keep_math:
                out.append((kind, content, number))
            else:
                out += [("text", piece, number) for s in reference_sentences(content) for piece in wrapped(s, most) if piece]
    return out


def merged(units: Iterable[Unit], least: int = 60) -> list[Unit]:
    """Every text unit shorter than ``least`` joins the shorter text neighbour of its paragraph, on a tie the next one.

    One pass with the unit in hand and those that are done gives the same as
    merging until nothing changes: a done unit is long, or has no neighbour.
    """
    done: list[Unit] = []
    hand: Unit | None = None
    for new in [*units, ("end", "", -1)]:
        if hand is not None:
            near = [done and done[-1][0] == "text" and done[-1][2] == hand[2], new[0] == "text" and new[2] == hand[2]]
            if hand[0] == "text" and len(hand[1]) < least and any(near):
                if near[1] and not (near[0] and len(done[-1][1]) < len(new[1])):
                    hand = ("text", f"{hand[1]} {new[1]}".strip(), hand[2])
                    continue
                done[-1] = ("text", f"{done[-1][1]} {hand[1]}".strip(), hand[2])
            else:
                done.append(hand)
        hand = new
    return done


def count_sentences(text: str, count_math: bool = False) -> int:
    blocks = (b for p in paragraphs(normalized(text)) for b in math_blocks(p))
    return sum(len(reference_sentences(c)) if kind == "text" else int(count_math) for kind, c in blocks)


# as columns

_PLACES = pa.struct([("id", pa.int32()), ("type", pa.string()), ("content", pa.string()), ("paragraph_index", pa.int32())])


def _lists(items: list[list], child: Callable[[list], pa.Array]) -> pa.Array:
    ends = [0]
    for x in items:
        ends.append(ends[-1] + len(x))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), child([y for x in items for y in x]))


def _ready() -> None:
    """Workers need this package."""
    from quillmark.session import ship

    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def strings_of(function: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """A function of a text to a list of texts, as one of columns; null reads as empty."""

    def make(x: Column) -> Column:
        _ready()

        @F.arrow_udf("array<string>")
        def run(column: pa.Array) -> pa.Array:
            return _lists([function(t) for t in _texts(column)], lambda flat: pa.array(flat, pa.string()))

        return run(x)

    return make


def _units(items: list[list[Unit]]) -> pa.Array:
    numbered = [[(i, *u) for i, u in enumerate(units)] for units in items]
    return _lists(numbered, lambda flat: pa.StructArray.from_arrays([pa.array([u[k] for u in flat], f.type) for k, f in enumerate(_PLACES)], fields=list(_PLACES)))


def units_of(function: Callable[[str], list[Unit]], x: Column) -> Column:
    _ready()

    @F.arrow_udf(f"array<{UNIT}>")
    def run(column: pa.Array) -> pa.Array:
        return _units([function(t) for t in _texts(column)])

    return run(x)


def merge_units(units: Column, least: int) -> Column:
    _ready()

    @F.arrow_udf(f"array<{UNIT}>")
    def run(column: pa.Array) -> pa.Array:
        return _units([merged([(u["type"], u["content"], u["paragraph_index"]) for u in row or []], least) for row in column.to_pylist()])

    return run(units)


def blocks_of(x: Column, compat: bool) -> Column:
    _ready()

    @F.arrow_udf("array<struct<type:string,content:string>>")
    def run(column: pa.Array) -> pa.Array:
        fields = [pa.field("type", pa.string()), pa.field("content", pa.string())]
        return _lists([math_blocks(t, compat) for t in _texts(column)], lambda flat: pa.StructArray.from_arrays([pa.array([b[k] for b in flat], pa.string()) for k in (0, 1)], fields=fields))

    return run(x)


def count_of(x: Column, count_math: bool) -> Column:
    _ready()

    @F.arrow_udf("int")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([count_sentences(t, count_math) for t in _texts(column)], pa.int32())

    return run(x)
