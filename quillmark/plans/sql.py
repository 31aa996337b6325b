"""DuckDB SQL fragments that state the text functions once more, independently."""

from __future__ import annotations

# written out once more, so that a wrong entry of the library is a difference
REFERENCE_ABBREVIATIONS = "e.g. i.e. etc. Mr. Mrs. Ms. Dr. Prof. vs. Fig. Eq. Prop. Thm. Cor. No.".split()
EVALUATION_ABBREVIATIONS = [*"Mr. Mrs. Ms. Dr. Prof. Sr. Jr. St. Co. Inc. Ltd. vs. etc. e.g. i.e. cf. Fig. Eq. Sec. No. pp. Ch. U.S. U.K. U.N. al.".split(), "et al."]
HOLD, CUT, EDGE, DIGIT, MATH = "chr(3)", "chr(4)", "chr(5)", "chr(7)", "chr(6)"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def normalize(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '\r\n?', chr(10), 'g'), '[ \t\r\f\x0B]+', ' ', 'g'), ' ' || chr(10))"


def each(items: str, var: str, expr: str) -> str:
    """All items mapped, without empty ones."""
    return f"list_filter(list_transform({items}, lambda {var}: {expr}), lambda {var}: {var} <> '')"


def paragraphs(x: str) -> str:
    return each(rf"regexp_split_to_array({x}, '\n\s*\n+')", "p", strip("p"))


def protect(x: str, abbreviations: list[str]) -> str:
    for a in sorted(abbreviations, key=len, reverse=True):
        x = f"replace({x}, '{a}', '{a}'.replace('.', {HOLD}))"
    return x


def sentences_reference(x: str) -> str:
    marked = rf"regexp_replace({protect(x, REFERENCE_ABBREVIATIONS)}, '([.!?;]+)(\s+|$)', '\1' || {CUT}, 'g')"
    return each(f"string_split({marked}, {CUT})", "s", strip(f"replace(s, {HOLD}, '.')"))


def sentences_evaluation(x: str) -> str:
    held = rf"regexp_replace({protect(x, EVALUATION_ABBREVIATIONS)}, '([0-9])\.', '\1' || {DIGIT}, 'g')"
    marked = rf"""regexp_replace({held}, '([.!?;])([)"''\]}}]*\s+|$)', '\1' || {CUT} || '\2', 'g')"""
    clean = strip(rf"regexp_replace(replace(replace(s, {HOLD}, '.'), {DIGIT}, '.'), '\s+', ' ', 'g')")
    return each(f"string_split({marked}, {CUT})", "s", clean)


def wrap(s: str, cap: int) -> str:
    """Pieces of one stripped sentence."""
    parts = rf"string_split(regexp_replace({s}, '(,|;|:|\band\b|\bor\b|\bthen\b|\bwhich\b)', {EDGE} || '\1' || {EDGE}, 'g'), {EDGE})"
    fit = strip("a.c || x.c")
    fold = f"""list_reduce(list_transform({parts}, lambda w: {{'o': CAST([] AS VARCHAR[]), 'c': w}}),
      lambda a, x: CASE WHEN length({fit}) <= {cap} THEN {{'o': a.o, 'c': {fit}}}
        ELSE {{'o': CASE WHEN a.c <> '' THEN list_append(a.o, a.c) ELSE a.o END, 'c': {strip("x.c")}}} END,
      {{'o': CAST([] AS VARCHAR[]), 'c': ''}})"""
    pieces = f"list_filter(list_transform(list_transform([{fold}], lambda r: list_append(r.o, r.c))[1], lambda q: trim(q, ' ,;:')), lambda q: q <> '')"
    return f"CASE WHEN length({s}) <= {cap} THEN [{s}] WHEN len({pieces}) > 0 THEN {pieces} ELSE [{s}] END"


def math_blocks(x: str) -> str:
    """Structs (t, c) of a paragraph without environments."""
    norm = rf"regexp_replace({x}, '(?s)\\\[(.+?)\\\]', '$$\1$$', 'g')"
    marked = rf"regexp_replace({norm}, '(?s)\$\$(.+?)\$\$', {CUT} || {MATH} || '$$\1$$' || {CUT}, 'g')"
    block = f"{{'t': CASE WHEN starts_with(b, {MATH}) THEN 'math' ELSE 'text' END, 'c': {strip(f'replace(b, {MATH}, {chr(39)}{chr(39)})')}}}"
    return f"list_filter(list_transform(string_split({marked}, {CUT}), lambda b: {block}), lambda b: b.c <> '')"


UNITS = "STRUCT(t VARCHAR, c VARCHAR, p BIGINT)"


def merge(units: str, least: int) -> str:
    """Short text units merged; ``units`` is a list of (t, c, p)."""
    short = f"a.cur.t = 'text' AND length(a.cur.c) < {least}"
    right = "x.cur.t = 'text' AND x.cur.p = a.cur.p"
    left = "len(a.o) > 0 AND a.o[-1].t = 'text' AND a.o[-1].p = a.cur.p"
    return f"""list_reduce(list_transform(list_append({units}, CAST({{'t': 'end', 'c': '', 'p': -1}} AS {UNITS})), lambda one: {{'o': CAST([] AS {UNITS}[]), 'cur': one}}),
      lambda a, x: CASE
        WHEN {short} AND {right} AND (NOT ({left}) OR length(x.cur.c) <= length(a.o[-1].c))
          THEN {{'o': a.o, 'cur': CAST({{'t': 'text', 'c': a.cur.c || ' ' || x.cur.c, 'p': a.cur.p}} AS {UNITS})}}
        WHEN {short} AND {left}
          THEN {{'o': list_append(a.o[1:len(a.o) - 1], CAST({{'t': 'text', 'c': a.o[-1].c || ' ' || a.cur.c, 'p': a.cur.p}} AS {UNITS})), 'cur': x.cur}}
        ELSE {{'o': list_append(a.o, a.cur), 'cur': x.cur}} END).o"""


def word_set(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[A-Za-z0-9_]+'))"


def jaccard(a: str, b: str) -> str:
    x, y = word_set(a), word_set(b)
    both = f"len(list_intersect({x}, {y}))"
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE CAST({both} AS DOUBLE) / (len({x}) + len({y}) - {both}) END"
