from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillmark.functions import jsonrepair as J
from quillmark.functions import segment as G
from quillmark.functions import text as T

ALPHA = "alpha beta and gamma delta, epsilon or zeta"


@pytest.mark.parametrize(
    ("function", "given_", "want"),
    [
        (T.normalize_text, "\n a\t b \r\n\r\nc\x0bd \n", "a b \n\nc d"),
        (T.normalize_text, None, ""),
        (T.split_paragraphs, "a\n \nb\n\n\n c", ["a", "b", "c"]),
        (T.split_paragraphs, "", []),
        (T.approx_token_count, "x_1 + y=2.5, éa", 10),
        (T.sentence_split_reference, "See Fig. 2. We note x?! Then; done", ["See Fig. 2.", "We note x?!", "Then;", "done"]),
        (T.sentence_split_reference, "Answer: No. Next. a.b c", ["Answer: No. Next.", "a.b c"]),
        (T.sentence_split_evaluation, "The integral. Next one. Done", ["The integral. Next one.", "Done"]),
        (T.sentence_split_evaluation, 'He said "yes." Then (x.) go', ['He said "yes.', '" Then (x.', ") go"]),
        (T.sentence_split_evaluation, "It equals 5. Next. End", ["It equals 5. Next.", "End"]),
        (lambda x: T.soft_wrap(x, 20), ALPHA, ["alpha betaand", "gamma delta, epsilon", "or zeta"]),
        (lambda x: T.soft_wrap(x, 30), ALPHA, ["alpha betaand gamma delta", "epsilonor zeta"]),
        (lambda x: T.soft_wrap(x, 30, fix_spacing=True), ALPHA, ["alpha beta and gamma delta", "epsilon or zeta"]),
        (lambda x: T.soft_wrap(x, 5), " ,;: ,;:", [",;: ,;:"]),
        (T.sentence_split_reference, "a\x03b c. D\x04e f. \x05\ue000 e.g. g. h", ["a\x03b c.", "D\x04e f.", "\x05\ue000 e.g. g.", "h"]),
        (T.sentence_split_evaluation, "a\x03b c. D\x04e\ue000 f! g", ["a\x03b c.", "D\x04e\ue000 f!", "g"]),
        (lambda x: T.soft_wrap(x, 8), "ab\x05cd, efghi", ["ab\x05cd", "efghi"]),
        (T.extract_floats, "-5", [5.0]),
        (T.extract_floats, "-.5", [-0.5]),
        (T.extract_floats, "1e-3", [1.0, 3.0]),
        (T.extract_floats, "a1.25b+2.5", [1.25, 2.5]),
        (T.normalize_quotes, "```json\n{“a”: 1}\n```", '{"a": 1}'),
        (T.truncate_at_sentinel, "a b \n<<<END>>>c", "a b"),
        (T.truncate_at_sentinel, "<<<END>>>c", "<<<END>>>c"),
        (J.strip_trailing_commas, '{"a":[1,2, ],}', '{"a":[1,2]}'),
        (J.fix_unquoted_keys, "{a: 1, b_c: 2}", '{"a": 1, "b_c": 2}'),
        (J.single_to_double_quotes, "{'a': 'x', 'b': 'it\"s'}", '{"a": "x", "b": \'it"s\'}'),
        (J.last_score, 'x {"score": 0.75}', 0.75),
        (J.last_score, '{"score": .5}', 0.5),
        (J.last_score, '{"score": 7}', 7.0),
        (J.last_score, '{"score": 0.5 }', 0.0),
        (J.last_score, '{"score":1.}', 0.0),
        (J.last_score, '{"score": 1e-3}', 0.0),
        (J.last_score, '{"score": -0.2}', 0.0),
        (J.last_score, '{"score": 0.5} ok', 0.0),
        (J.claim_texts, "no json", []),
    ],
)
def test_vectors(one, function, given_, want):
    assert one(function, given_) == want


@pytest.mark.parametrize(
    ("text", "compat", "want"),
    [
        (r"Let \[x+1\] be. So $$y$$ end", False, [("text", "Let"), ("math", "$$x+1$$"), ("text", "be. So"), ("math", "$$y$$"), ("text", "end")]),
        (r"A \begin{align}a $$b$$ c\end{align} B", False, [("text", r"A \begin{align}a $$b$$ c\end{align} B")]),
        (r"$$\begin{cases}1\end{cases}$$ z", True, [("math", "$$@@LATEXENV0@@$$"), ("text", "z")]),
        (r"$$\begin{cases}1\end{cases}$$ z", False, [("math", r"$$\begin{cases}1\end{cases}$$"), ("text", "z")]),
        ("open $$x", False, [("text", "open $$x")]),
        ("p $q$ r", False, [("text", "p $q$ r")]),
        (r"\begin{a}x", False, [("text", r"\begin{a}x")]),
        (r"\begin{a} x \begin{b} y \end{a} $$p$$ \end{b} t $$q$$", False, [("text", r"\begin{a} x \begin{b} y \end{a} $$p$$ \end{b} t"), ("math", "$$q$$")]),
        (r"\begin{a}\begin{a}$$1$$\end{a}$$2$$\end{a}", False, [("text", r"\begin{a}\begin{a}$$1$$\end{a}"), ("math", "$$2$$"), ("text", r"\end{a}")]),
        (r"$$x \begin{a}1\end{a}\begin{b*}$$\end{b*} y$$", True, [("math", "$$x @@LATEXENV0@@ y$$")]),
        (r"$$\begin{a}1\end{a} \begin{b}2\end{b}$$ z \begin{c}$$\end{c}", True, [("math", "$$@@LATEXENV0@@ @@LATEXENV1@@$$"), ("text", r"z \begin{c}$$\end{c}")]),
        (r"\begin{a} \begin{b} $$x$$ \end{b} \begin{c} $$y$$", False, [("text", r"\begin{a} \begin{b} $$x$$ \end{b} \begin{c}"), ("math", "$$y$$")]),
        ("x\x04y z $$\x06\x01\x02$$ \ue000", False, [("text", "x\x04y z"), ("math", "$$\x06\x01\x02$$"), ("text", "\ue000")]),
        (r"\begin{a}$$\end{a} \ue000 $$\begin{b}1\end{b}\begin{b}2\end{b}$$".replace("\\ue000", "\ue000"), False, [("text", r"\begin{a}$$\end{a} " + "\ue000"), ("math", r"$$\begin{b}1\end{b}\begin{b}2\end{b}$$")]),
    ],
)
def test_math_blocks(one, text, compat, want):
    assert [(b["type"], b["content"]) for b in one(lambda x: G.split_math_blocks(x, compat), text)] == want


@pytest.mark.parametrize(("text", "want"), [('ok {"a":[1]} z', '{"a":[1]}'), ('{"a":"}"}', '{"a":"}'), ('{"a":1', None), (None, None), ("", None)])
def test_first_chunk(text, want):
    assert J.first_chunk(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [('x {"a": 1} y', '{"a": 1}'), ("{'a': True, b: None,}", '{"a": true, "b": null}'), ("(1, 2)", "[1, 2]"), ("nothing", None), (None, None), ("[1, 2", None),
     ("so {'a': (1, 2)} ok", '{"a": [1, 2]}'), ("x {'a': (1,2),} y", '{"a": [1, 2]}'), ("{1: 'a', 2: (3,)}", '{"1": "a", "2": [3]}'), ("null", None), ("[" * 100_000, None), ("{'a': {1, 2}}", None), ("a {b} [1, 2]", None)],
)
def test_repair(text, want):
    assert J.repair(text) == want


def _merge_plain(units, least):
    """Merging as it is told: again and again until nothing changes."""
    units = [dict(u) for u in units]
    i = 0
    while i < len(units):
        cur = units[i]
        if cur["type"] != "text" or len(cur["content"]) >= least:
            i += 1
            continue
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(units) and units[j]["type"] == "text" and units[j]["paragraph_index"] == cur["paragraph_index"]]
        if not near:
            i += 1
            continue
        j = min(near, key=lambda j: (len(units[j]["content"]), -j))
        a, b = min(i, j), max(i, j)
        units[a]["content"] = units[a]["content"] + " " + units[b]["content"]
        del units[b]
        i = a
    return [(u["type"], u["content"], u["paragraph_index"]) for u in units]


def test_merge_equals_fixpoint(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(5)
    lists = []
    for _ in range(300):
        p, units = 0, []
        for _ in range(rng.randint(0, 9)):
            p += rng.random() < 0.25
            units.append({"id": 0, "type": "math" if rng.random() < 0.15 else "text", "content": "x" * rng.randint(1, 14), "paragraph_index": p})
        lists.append(units)
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(lists)], f"i int, u array<{G.UNIT}>").select("i", G.merge_short_units(F.col("u"), 8).alias("m")).collect()
    for r in rows:
        assert [(u.type, u.content, u.paragraph_index) for u in r.m] == _merge_plain(lists[r.i], 8)
        assert [u.id for u in r.m] == list(range(len(r.m)))


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab .!?;$\n\\[]", max_size=60), min_size=1, max_size=8))
def test_segmentation_keeps_characters(spark, texts):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", G.fine_segment(F.col("t"), 10_000).alias("s")).collect()
    for r in rows:
        shown = "".join(u.content for u in r.s).replace("$", "").replace("\\[", "").replace("\\]", "")
        assert "".join(shown.split()) == "".join(r.t.replace("$", "").replace("\\[", "").replace("\\]", "").split())
