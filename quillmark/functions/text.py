"""Text functions, Column to Column: JVM expressions, and Arrow kernels where sentences are cut.

Java and Python differ in white space, line ends and vertical tabs; the
patterns below name their classes so that results equal Python's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions import units as U
from quillmark.functions.units import EVALUATION_ABBREVIATIONS, REFERENCE_ABBREVIATIONS  # noqa: F401

_SPACE = r"[\s\x1C-\x1F]"  # with (?U): what Python's \s and strip() take

# Characters that JSON text should not hold, and what they become.
DELETED = "\ufeff\u200b\u200c\u200d\u2060"
BLANKS = "\u00a0\u2007\u202f"
LINE_ENDS = "\u2028\u2029"
DOUBLE_QUOTES = "\u201c\u201d\u201e\u201f"
SINGLE_QUOTES = "\u2018\u2019\u201a\u201b"


def strip(x: Column) -> Column:
    """White space off both ends, as Python's strip()."""
    return F.regexp_replace(x, rf"(?U)^{_SPACE}+|{_SPACE}+\z", "")


def is_blank(x: Column) -> Column:
    return F.coalesce(strip(x) == "", F.lit(True))


def normalize_text(x: Column) -> Column:
    """One kind of line end, runs of other blanks as one blank, no line ends or blanks at the ends; null becomes empty."""
    lines = F.regexp_replace(F.coalesce(x, F.lit("")), r"\r\n?", "\n")
    return F.btrim(F.regexp_replace(lines, r"[ \t\r\f\x0B]+", " "), F.lit("\n "))


def split_paragraphs(x: Column) -> Column:
    """Paragraphs between blank lines, stripped, without empty ones."""
    parts = F.transform(F.split(F.coalesce(x, F.lit("")), rf"(?U)\n{_SPACE}*\n+"), strip)
    return F.filter(parts, lambda p: p != "")


def approx_token_count(x: Column) -> Column:
    """Runs of ASCII word characters, and every other character that is no white space."""
    return F.regexp_count(F.coalesce(x, F.lit("")), F.lit(rf"(?U)[A-Za-z0-9_]+|[^\s\x1C-\x1FA-Za-z0-9_]"))


def sentence_split_reference(x: Column) -> Column:
    """Sentences of a reference text: runs of . ! ? ; before white space or the end."""
    return U.strings_of(U.reference_sentences)(x)


def sentence_split_evaluation(x: Column) -> Column:
    """Sentences of a generated text: one ender before closing marks and white space, no dot beside a digit; white space collapsed."""
    return U.strings_of(U.evaluation_sentences)(x)


def soft_wrap(x: Column, max_chars: int = 220, fix_spacing: bool = False) -> Column:
    """Cut a long sentence at commas, semicolons, colons and coordinators, and repack up to ``max_chars``.

    The blank before a coordinator is lost on repacking unless ``fix_spacing``.
    """
    return U.strings_of(lambda t: U.wrapped(t, max_chars, fix_spacing))(x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _word_set(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("([A-Za-z0-9_]+)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words of two texts; 0 if either has none."""

    def share(w: Column) -> Column:
        n = F.size(w["x"]) + F.size(w["y"])
        return F.when((F.size(w["x"]) == 0) | (F.size(w["y"]) == 0), 0.0).otherwise(let(F.size(F.array_intersect(w["x"], w["y"])), lambda both: both / (n - both)))

    return let(F.struct(_word_set(a).alias("x"), _word_set(b).alias("y")), share)


def extract_floats(x: Column) -> Column:
    """All numbers; a sign counts only before a decimal point form."""
    found = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"([-+]?\d*\.\d+|\d+)"), F.lit(1))
    return F.transform(found, lambda n: n.cast("double"))


def normalize_quotes(x: Column) -> Column:
    """JSON-friendly white space and quotes, without code fences and runs of blank lines."""
    source = BLANKS + LINE_ENDS + DOUBLE_QUOTES + SINGLE_QUOTES + DELETED
    target = " " * len(BLANKS) + "\n" * len(LINE_ENDS) + '"' * len(DOUBLE_QUOTES) + "'" * len(SINGLE_QUOTES)
    plain = F.translate(F.coalesce(x, F.lit("")), source, target)
    bare = F.regexp_replace(plain, rf"(?dmU)^```[a-zA-Z0-9_-]*{_SPACE}*|{_SPACE}*```$", "")
    return strip(F.regexp_replace(bare, r"\n{3,}", "\n\n"))


def to_atom(x: Column, kind: str = "string") -> Column:
    """Text of one value: null is empty, strings are stripped, nested values become JSON."""
    if kind.startswith(("array", "struct", "map")):
        return F.coalesce(F.to_json(x), F.lit(""))
    return F.coalesce(strip(x.cast("string")), F.lit(""))


def flatten_to_string(x: Column, depth: int = 1, sep: str = " ") -> Column:
    """Atoms of an array of strings nested ``depth`` deep, joined without empty ones."""
    for _ in range(depth - 1):
        x = F.flatten(x)
    atoms = F.filter(F.transform(x, lambda v: to_atom(v)), lambda a: a != "")
    return F.coalesce(F.array_join(atoms, sep), F.lit(""))


def normalize_generation(x: Column, depth: int = 0) -> Column:
    """A generation given as text (depth 0) or as nested arrays of texts."""
    return to_atom(x) if depth == 0 else flatten_to_string(x, depth)


def sentence_head(sentences: Column, max_len: int = 10, sep: str = " ") -> Column:
    """The first sentences, joined."""
    return F.array_join(F.slice(sentences, 1, max_len), sep)


def truncate_at_sentinel(x: Column, sentinel: str = "<<<END>>>") -> Column:
    """Text before the first sentinel, white space off its end; the whole text if that is empty."""
    head = F.regexp_replace(F.substring_index(x, sentinel, 1), rf"(?U){_SPACE}+\z", "")
    return F.coalesce(F.nullif(head, F.lit("")), x)


def clamp_score(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))


def clean_label(x: Column) -> Column:
    return F.lower(strip(F.coalesce(x, F.lit("irrelevant"))))


def cut_justification(x: Column) -> Column:
    return F.substring(F.coalesce(x, F.lit("")), 1, 200)
