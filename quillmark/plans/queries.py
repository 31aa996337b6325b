"""One query for each operator, over whole tables, with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.config import SegmentConfig
from quillmark.functions import jsonrepair as J
from quillmark.functions import nested as N
from quillmark.functions import segment as G
from quillmark.functions import tables as B
from quillmark.functions import text as T
from quillmark.operators import align as A
from quillmark.operators import evaluation as E
from quillmark.operators import joins as JN
from quillmark.operators import memo as X
from quillmark.operators import models as M
from quillmark.operators import scoring as W
from quillmark.operators import solutions as P
from quillmark.operators import stats as D
from quillmark.plans import sql as Q
from quillmark.schemas import CASE, GENERATION_LOG, SEGMENTS, SUMMARY
from quillmark.session import materialize, new_path, ship
from quillmark.sources import charts as C
from quillmark.sources import jsonlines as J_
from quillmark.sources import readers as R
from quillmark.sources import writers as K
from quillmark.streaming import cases as Y
from quillmark.streaming import evaluate as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
BAR = " | "


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _joined(x: Column) -> Column:
    return F.array_join(x, BAR)


def _big(x: Column) -> Column:
    return x.cast("bigint")


# solutions: documents with blank lines between their lines, display math and a closing remark
_CLOSING = "So it holds, e.g. for n = 2. Next; then we are done and the rest follows, see Fig. 3 for it."


def _solution() -> Column:
    mid = F.concat(F.lit("\n\nHence $$x_"), F.col("doc_id").cast("string"), F.lit("$$ and \\[y+1\\] are found.\n\n" + _CLOSING))
    return F.concat(F.replace("text", F.lit("\n"), F.lit("\n\n")), mid)


_SOLUTION_SQL = rf"(replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) || 'Hence $$x_' || doc_id || '$$ and \[y+1\] are found.' || chr(10) || chr(10) || '{_CLOSING}')"


@query(f"SELECT doc_id, {Q.normalize("(' ' || chr(10) || replace(replace(text, '. ', '.' || chr(13) || chr(10) || chr(9) || ' '), ', ', ',' || chr(11) || chr(13)) || chr(10))")} AS norm FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit(" \n"), F.replace(F.replace("text", F.lit(". "), F.lit(".\r\n\t ")), F.lit(", "), F.lit(",\x0b\r")), F.lit("\n"))
    return _t(spark, d, "documents").select("doc_id", T.normalize_text(raw).alias("norm"))


@query(f"SELECT doc_id, CAST(len(p) AS BIGINT) AS n, array_to_string(p, '{BAR}') AS parts FROM (SELECT doc_id, {Q.paragraphs("replace(text, chr(10), chr(10) || ' ' || chr(10))")} AS p FROM documents)")
def split_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", T.split_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n \n"))).alias("p"))
    return rows.select("doc_id", _big(F.size("p")).alias("n"), _joined("p").alias("parts"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^\sA-Za-z0-9_]')) AS BIGINT) AS n_tokens FROM documents")
def approx_token_count(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", _big(T.approx_token_count(F.col("text"))).alias("n_tokens"))


@query(f"SELECT doc_id, CAST(len(b) AS BIGINT) AS n, array_to_string(list_transform(b, lambda x: x.t || ':' || x.c), '{BAR}') AS blocks FROM (SELECT doc_id, {Q.math_blocks(_SOLUTION_SQL)} AS b FROM documents)")
def split_math_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", G.split_math_blocks(_solution()).alias("b"))
    return rows.select("doc_id", _big(F.size("b")).alias("n"), _joined(F.transform("b", lambda x: F.concat(x["type"], F.lit(":"), x["content"]))).alias("blocks"))


# environments that cross, touch, nest, have no end, or lie inside display math; the first hides what the text holds, the others a formula
_FORMS = {
    0: (r"\begin{a} ", r" \begin{b} y \end{a} $$p$$ \end{b} t $$q$$ end", r"'text:\begin{a} ' || text || ' \begin{b} y \end{a} $$p$$ \end{b} t | math:$$q$$ | text:end'"),
    1: (r"$$u \begin{a}$$\end{a}\begin{b*} ", r" \end{b*} v$$ w", r"'math:$$u \begin{a}$$\end{a}\begin{b*} ' || text || ' \end{b*} v$$ | text:w'"),
    2: (r"\begin{a}\begin{a} ", r" \end{a}$$2$$\end{a} \begin{c} $$3$$", r"'text:\begin{a}\begin{a} ' || text || ' \end{a} | math:$$2$$ | text:\end{a} \begin{c} | math:$$3$$'"),
}
_FORM_SQL = "CASE doc_id % 3 " + " ".join(f"WHEN {k} THEN {want}" for k, (_, _, want) in _FORMS.items()) + " END"


@query(f"SELECT doc_id, {_FORM_SQL} AS blocks FROM documents")
def math_environments(spark: SparkSession, d: str) -> DataFrame:
    x = F.lit(None).cast("string")
    for k, (before, after, _) in _FORMS.items():
        x = F.when(F.col("doc_id") % 3 == k, F.concat(F.lit(before), "text", F.lit(after))).otherwise(x)
    rows = _t(spark, d, "documents").select("doc_id", G.split_math_blocks(x).alias("b"))
    return rows.select("doc_id", _joined(F.transform("b", lambda x: F.concat(x["type"], F.lit(":"), x["content"]))).alias("blocks"))


@query(f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n, array_to_string(s, '{BAR}') AS sentences FROM (SELECT doc_id, {Q.sentences_reference(_SOLUTION_SQL)} AS s FROM documents)")
def sentence_split_ref(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", T.sentence_split_reference(_solution()).alias("s"))
    return rows.select("doc_id", _big(F.size("s")).alias("n"), _joined("s").alias("sentences"))


@query(f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n, array_to_string(s, '{BAR}') AS sentences FROM (SELECT doc_id, {Q.sentences_evaluation(_SOLUTION_SQL)} AS s FROM documents)")
def sentence_split_eval(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", T.sentence_split_evaluation(_solution()).alias("s"))
    return rows.select("doc_id", _big(F.size("s")).alias("n"), _joined("s").alias("sentences"))


_SENTENCES = f"(SELECT doc_id, unnest(s) AS s, unnest(range(len(s))) AS i FROM (SELECT doc_id, {Q.sentences_reference('text')} AS s FROM documents))"


@query(f"SELECT doc_id, i + 1 AS index, array_to_string({Q.wrap('s', 80)}, '{BAR}') AS pieces FROM {_SENTENCES}")
def soft_wrap(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", F.posexplode(T.sentence_split_reference(F.col("text"))).alias("i", "s"))
    return rows.select("doc_id", _big(F.col("i") + 1).alias("index"), _joined(T.soft_wrap(F.col("s"), 80)).alias("pieces"))


def _units_sql(cap: int) -> str:
    """All units of all solutions in order, before the merge: doc_id, u."""
    return f"""
p AS (SELECT doc_id, unnest(p) AS p, unnest(range(len(p))) AS pi FROM (SELECT doc_id, {Q.paragraphs(Q.normalize(_SOLUTION_SQL))} AS p FROM documents)),
b AS (SELECT doc_id, pi, unnest(b) AS b, unnest(range(len(b))) AS bi FROM (SELECT doc_id, pi, {Q.math_blocks('p')} AS b FROM p)),
s AS (SELECT doc_id, pi, bi, t, unnest(s) AS s, unnest(range(len(s))) AS si FROM (SELECT doc_id, pi, bi, b.t AS t, CASE WHEN b.t = 'math' THEN [b.c] ELSE {Q.sentences_reference('b.c')} END AS s FROM b)),
w AS (SELECT doc_id, pi, bi, si, t, unnest(w) AS c, unnest(range(len(w))) AS wi FROM (SELECT doc_id, pi, bi, si, t, CASE WHEN t = 'math' THEN [s] ELSE {Q.wrap('s', cap)} END AS w FROM s)),
u AS (SELECT doc_id, list(CAST({{'t': t, 'c': c, 'p': pi}} AS {Q.UNITS}) ORDER BY pi, bi, si, wi) AS u FROM w GROUP BY doc_id)"""


_SHOWN = f"array_to_string(list_transform(m, lambda x: x.p || ':' || x.t || ':' || x.c), '{BAR}')"


def _show(units: str) -> Column:
    return _joined(F.transform(units, lambda x: F.concat(x["paragraph_index"].cast("string"), F.lit(":"), x["type"], F.lit(":"), x["content"])))


@query(f"WITH {_units_sql(220)}, m AS (SELECT doc_id, {Q.merge('u', 90)} AS m FROM u) SELECT doc_id, CAST(len(m) AS BIGINT) AS n, {_SHOWN} AS units FROM m")
def merge_short_units(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", G.merge_short_units(G.raw_units(_solution()), 90).alias("u"))
    return rows.select("doc_id", _big(F.size("u")).alias("n"), _show("u").alias("units"))


@query(f"WITH {_units_sql(200)}, m AS (SELECT doc_id, {Q.merge('u', 60)} AS m FROM u), x AS (SELECT doc_id, unnest(m) AS e, unnest(range(len(m))) AS id FROM m) SELECT doc_id, id, e.t AS type, e.c AS content, e.p AS paragraph_index FROM x")
def fine_segment(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", F.explode(G.fine_segment(_solution(), 200, min_chars=60)).alias("e"))
    return rows.select("doc_id", _big(F.col("e.id")).alias("id"), "e.type", "e.content", _big(F.col("e.paragraph_index")).alias("paragraph_index"))


def _count_sentences_sql(x: str) -> str:
    blocks = f"flatten(list_transform({Q.paragraphs(x)}, lambda p: {Q.math_blocks('p')}))"
    return f"list_sum(list_transform({blocks}, lambda b: CASE WHEN b.t = 'text' THEN len({Q.sentences_reference('b.c')}) ELSE 0 END))"


@query(
    rf"SELECT doc_id FROM (SELECT doc_id, {Q.normalize(_SOLUTION_SQL)} AS x FROM documents) WHERE length(x) >= 1500 OR len(regexp_extract_all(x, '[A-Za-z0-9_]+|[^\sA-Za-z0-9_]')) >= 300 OR {_count_sentences_sql('x')} >= 24"
)
def filter_long(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", _solution().alias("solution"))
    return P.filter_long(rows, SegmentConfig(min_chars=1500, min_tokens=300, min_sentences=24)).select("doc_id")


@query(
    f"WITH {_units_sql(200)}, m AS (SELECT doc_id, {Q.merge('u', 60)} AS m FROM u) SELECT doc_id, source, CAST(len(m) AS BIGINT) AS segment_num, {_SHOWN} AS units FROM m JOIN documents USING (doc_id) WHERE length({Q.normalize(_SOLUTION_SQL)}) >= 700"
)
def process_dataset(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", "source", _solution().alias("solution"))
    out = P.process_solutions(rows, SegmentConfig(min_chars=700, max_unit_chars=200))
    return out.select("doc_id", "source", _big(F.col("segment_num")).alias("segment_num"), _show("segments").alias("units"))


@query(f"SELECT doc_id, item_id, round({Q.jaccard('d.text', 'b.text')}, 9) AS jaccard FROM documents d JOIN (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS n, count(*) OVER () AS items FROM benchmark) b ON b.n = d.doc_id % items")
def jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Every document with one item; all items take part, dealt by their rank."""
    b = R.numbered(_t(spark, d, "benchmark").select("item_id", F.col("text").alias("ref")), ["item_id"], "n").withColumn("n", F.col("n") - 1)
    items = b.agg(F.count("*").alias("items"))
    rows = _t(spark, d, "documents").select("doc_id", "text").crossJoin(F.broadcast(items)).withColumn("n", F.col("doc_id") % F.col("items"))  # one row
    return rows.join(b, "n").select("doc_id", "item_id", F.round(T.jaccard(F.col("text"), F.col("ref")), 9).alias("jaccard"))


@query(r"SELECT event_id, CAST(len(n) AS BIGINT) AS n, round(list_sum(n), 6) AS total FROM (SELECT event_id, list_transform(regexp_extract_all('-5 ' || props || ' -.5e' || event_id || ' a1.25', '[-+]?[0-9]*\.[0-9]+|[0-9]+'), lambda x: CAST(x AS DOUBLE)) AS n FROM events)")
def extract_floats(spark: SparkSession, d: str) -> DataFrame:
    x = F.concat(F.lit("-5 "), "props", F.lit(" -.5e"), F.col("event_id").cast("string"), F.lit(" a1.25"))
    rows = _t(spark, d, "events").select("event_id", T.extract_floats(x).alias("n"))
    return rows.select("event_id", _big(F.size("n")).alias("n"), F.round(F.aggregate("n", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query(
    r"""SELECT doc_id, trim(regexp_replace(replace(replace(text, ', ', ', "'), '. ', '. '''), '\n{3,}', chr(10) || chr(10), 'g')) AS clean FROM documents"""
)
def normalize_quotes(spark: SparkSession, d: str) -> DataFrame:
    dirty = F.replace(F.replace("text", F.lit(", "), F.lit(", “")), F.lit(". "), F.lit(". ’​"))
    fenced = F.concat(F.lit("```json\n"), dirty, F.lit("\n```"))
    return _t(spark, d, "documents").select("doc_id", T.normalize_quotes(fenced).alias("clean"))


@query("SELECT event_id, props AS chunk FROM events")
def first_json_chunk(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return _t(spark, d, "events").select("event_id", J.first_json_chunk(F.concat(F.lit("ok: "), "props", F.lit(" and {more} ]"))).alias("chunk"))


@query("SELECT event_id, replace(props, '}', ', \"t\": [1, 2]}') AS fixed FROM events")
def strip_trailing_commas(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", J.strip_trailing_commas(F.replace("props", F.lit("}"), F.lit(', "t": [1, 2, ],}'))).alias("fixed"))


@query("SELECT event_id, replace(props, '}', ', \"b_c\": {\"d-e\": 2}}') AS fixed FROM events")
def fix_unquoted_keys(spark: SparkSession, d: str) -> DataFrame:
    bare = F.replace(F.replace("props", F.lit('"'), F.lit("")), F.lit("}"), F.lit(", b_c: {d-e: 2}}"))
    return _t(spark, d, "events").select("event_id", J.fix_unquoted_keys(bare).alias("fixed"))


@query("SELECT event_id, replace(props, '}', ', \"t\": \"' || event_type || '\", \"u\": ''it\"s''}') AS fixed FROM events")
def single_to_double_quotes(spark: SparkSession, d: str) -> DataFrame:
    quoted = F.concat(F.replace(F.replace("props", F.lit('"'), F.lit("'")), F.lit("}"), F.lit(", 't': '")), "event_type", F.lit("', 'u': 'it\"s'}"))
    return _t(spark, d, "events").select("event_id", J.single_to_double_quotes(quoted).alias("fixed"))


@query("SELECT event_id, replace(props, '}', ', \"a\": true, \"b\": false, \"c\": null, \"d\": \"Trueish\"}') AS fixed FROM events")
def replace_py_literals(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", J.replace_py_literals(F.replace("props", F.lit("}"), F.lit(', "a": True, "b": False, "c": None, "d": "Trueish"}'))).alias("fixed"))


@query(
    """SELECT event_id, CASE WHEN event_id % 7 = 6 THEN '{"k": [' || regexp_extract(props, '[0-9]+') || ', 2], "e": [1]}' WHEN event_id % 5 = 4 THEN NULL ELSE '{"k": ' || regexp_extract(props, '[0-9]+') || ', "t": "' || event_type || '"' || CASE WHEN event_id % 5 = 3 THEN ', "ok": true' ELSE '' END || '}' END AS json,
    event_id % 5 = 4 AND event_id % 7 <> 6 AS parse_error FROM events"""
)
def safe_json(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    n, t = F.regexp_extract("props", "[0-9]+", 0), F.col("event_type")
    forms = [
        F.concat(F.lit("Here:\n```json\n{\"k\": "), n, F.lit(', "t": "'), t, F.lit('",}\n```')),
        F.concat(F.lit("{'k': "), n, F.lit(", 't': '"), t, F.lit("'} thanks")),
        F.concat(F.lit("answer {k: "), n, F.lit(", t: “"), t, F.lit("”}")),
        F.concat(F.lit("{'k': "), n, F.lit(", 't': '"), t, F.lit("', 'ok': True}")),
        F.concat(F.lit("no json, "), n),
    ]
    raw = forms[4]
    for i in range(4):
        raw = F.when(F.col("event_id") % 5 == i, forms[i]).otherwise(raw)
    raw = F.when(F.col("event_id") % 7 == 6, F.concat(F.lit("so {'k': ("), n, F.lit(", 2,), 'e': (1,),} ok"))).otherwise(raw)
    return _t(spark, d, "events").select("event_id", J.safe_json(raw).alias("j")).select("event_id", "j.json", "j.parse_error")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN 0.0 ELSE CAST(l_discount AS DOUBLE) END AS score, l_linenumber % 3 <> 0 AS parsed FROM lineitem")
def extract_last_score(spark: SparkSession, d: str) -> DataFrame:
    number = F.format_string("%.4f", F.col("l_discount").cast("double"))
    x = F.concat(F.lit('so {"score": 1} but {"score": '), number, F.when(F.col("l_linenumber") % 3 == 0, " }").otherwise("}"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", J.last_score(x).alias("score"), J.score_parsed(x).alias("parsed"))


@query("SELECT conv_id, turn, role || ' ' || trim(text) || ' end' AS flat FROM conversations")
def flatten_to_string(spark: SparkSession, d: str) -> DataFrame:
    nested = F.array(F.array(F.concat(F.lit(" "), "role"), F.lit(None).cast("string")), F.array(F.lit("  "), F.concat("text", F.lit("\n")), F.lit("end")))
    return _t(spark, d, "conversations").select("conv_id", "turn", T.flatten_to_string(nested, 2).alias("flat"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '<<<END>>>' || text WHEN doc_id % 3 = 1 THEN regexp_replace(text, '\\s+$', '') ELSE text END AS cut FROM documents")
def sentinel_truncate(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<<<END>>>"), "text")).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit(" \n<<<END>>> more <<<END>>>"))).otherwise(T.strip(F.col("text")))
    return _t(spark, d, "documents").select("doc_id", T.truncate_at_sentinel(x).alias("cut"))


@query("SELECT conv_id, turn, chr(10) || string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS prefix FROM conversations")
def prefix_window(spark: SparkSession, d: str) -> DataFrame:
    return W.prefixes(_t(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "prefix")


@query("SELECT conv_id, turn, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_content FROM conversations")
def next_step_pairs(spark: SparkSession, d: str) -> DataFrame:
    return W.next_step(_t(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "next_content")


_PAIRS = "(SELECT conv_id, turn, text AS gen, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM conversations)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = W.next_step(_t(spark, d, "conversations"), "conv_id", "turn", "text", "ref").where("ref IS NOT NULL")
    return rows.select("conv_id", "turn", F.col("text").alias("gen"), "ref")


def _share(a: str, b: str, of: str) -> str:
    x, y = Q.word_set(a), Q.word_set(b)
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({x}, {y})) AS DOUBLE) / len({Q.word_set(of)}) END"


@query(f"""WITH p AS (SELECT * FROM {_PAIRS} WHERE ref IS NOT NULL),
s AS (SELECT conv_id, turn, ref, unnest(s) AS s, unnest(range(len(s))) AS i FROM (SELECT conv_id, turn, ref, {Q.sentences_evaluation('gen')}[1:10] AS s FROM p)),
m AS (SELECT conv_id, turn, i, ({_share('s', 'ref', 'ref')} + {_share('s', 'ref', 's')}) / 2.0 AS v FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM m WHERE v >= 0.4),
a AS (SELECT conv_id, turn, sum(v) FILTER (WHERE n <= 3) / 3.0 AS score, count(*) AS n_matches FROM r GROUP BY 1, 2)
SELECT conv_id, turn, round(coalesce(score, 0.0), 9) AS score, coalesce(score, 0.0) < 0.6 AS hallucination, coalesce(n_matches, 0) AS n_matches FROM p LEFT JOIN a USING (conv_id, turn)""")
def align_1(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(spark, d).withColumn("r", A.align_pairs(F.col("gen"), F.col("ref")))
    return rows.select("conv_id", "turn", F.round("r.score", 9).alias("score"), "r.hallucination", _big(F.col("r.n_matches")).alias("n_matches"))


_PREFIX_SCORE = Q.jaccard(f"array_to_string({Q.sentences_evaluation('gen')}[1:10], ' ')", "ref")


@query(f"SELECT conv_id, turn, round(v, 9) AS score, v < 0.6 AS hallucination FROM (SELECT conv_id, turn, {_PREFIX_SCORE} AS v FROM {_PAIRS} WHERE ref IS NOT NULL)")
def align_2(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(spark, d).withColumn("r", A.align_prefix(F.col("gen"), F.col("ref")))
    return rows.select("conv_id", "turn", F.round("r.score", 9).alias("score"), "r.hallucination")


_CLAIMS = f"""p AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY conv_id, turn) AS k, gen, ref FROM {_PAIRS} WHERE ref IS NOT NULL)),
rc AS (SELECT k, unnest(s) AS ref, unnest(range(len(s))) AS ref_pos FROM (SELECT k, {Q.sentences_evaluation('ref')} AS s FROM p)),
gc AS (SELECT k, unnest(s) AS gen, unnest(range(len(s))) AS gen_pos FROM (SELECT k, {Q.sentences_evaluation("array_to_string(" + Q.sentences_evaluation('gen') + "[1:10], '')")} AS s FROM p)),
j AS (SELECT k, ref_pos, gen_pos, gen, {Q.jaccard('gen', 'ref')} AS v FROM rc JOIN gc USING (k)),
w AS (SELECT k, ref_pos, gen, v FROM j WHERE v > 0 QUALIFY row_number() OVER (PARTITION BY k, ref_pos ORDER BY v DESC, gen_pos) = 1),
m AS (SELECT k, ref_pos, ref, coalesce(gen, '') AS best_gen, coalesce(v, -1.0) AS score FROM rc LEFT JOIN w USING (k, ref_pos))"""


def _claims(spark: SparkSession, d: str) -> DataFrame:
    from quillmark.sources.readers import numbered

    rows = numbered(_pairs(spark, d), ["conv_id", "turn"], "k")

    def judge(gen: Column, ref: Column) -> Column:
        score = T.jaccard(gen, ref)
        return M.claim_judgement(score, F.when(score > 0, " Entailed ").otherwise("irrelevant"))

    return A.claim_matches(rows, "k", "gen", "ref", judge)


@query(f"WITH {_CLAIMS} SELECT k, ref_pos, best_gen, round(score, 9) AS score, NOT score > 0.6 AS is_hallucination FROM m")
def align_claims(spark: SparkSession, d: str) -> DataFrame:
    return _claims(spark, d).select(_big(F.col("k")).alias("k"), _big(F.col("ref_pos")).alias("ref_pos"), "best_gen", F.round("score", 9).alias("score"), "is_hallucination")


@query(f"""WITH {_CLAIMS}, r AS (SELECT k, count(*) AS n FROM (SELECT k, best_gen FROM m WHERE best_gen <> '' GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY k),
a AS (SELECT k, avg(score) AS v, count(*) AS n_claims FROM m GROUP BY k)
SELECT k, n_claims, coalesce(n, 0) AS n_repeats, round(v - 0.5 * coalesce(n, 0), 6) AS score, round(v - 0.5 * coalesce(n, 0), 6) < 0.6 AS hallucination FROM a LEFT JOIN r USING (k)""")
def duplicate_penalty(spark: SparkSession, d: str) -> DataFrame:
    out = A.claim_scores(_claims(spark, d), "k")
    return out.select(_big(F.col("k")).alias("k"), "n_claims", "n_repeats", F.round("score", 6).alias("score"), (F.round("score", 6) < 0.6).alias("hallucination"))


def _case_sql(steps: str, key: str) -> str:
    """Scores of cases from steps (key, i, n, v): the last of n steps isn't scored."""
    return f"SELECT {key}, n AS num_steps, 1 + ({key} % 17) / 2.0 AS difficulty, coalesce(sum((n - i + 1) * v / (n * (n + 1) / 2.0)) FILTER (WHERE i < n), 0.0) AS total FROM {steps} GROUP BY {key}, n"


_TURNS = f"(SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n, coalesce({_PREFIX_SCORE}, 0.0) AS v FROM {_PAIRS})"


def _cases(steps: DataFrame, key: str) -> DataFrame:
    return steps.groupBy(key).agg(F.count("*").alias("num_steps")).withColumn("difficulty", 1 + (F.col(key) % 17) / 2.0)


@query(f"SELECT conv_id, num_steps, round(total, 6) AS total_score, round(total * exp((difficulty - 5) / 10), 6) AS score FROM ({_case_sql(_TURNS, 'conv_id')})")
def case_scores(spark: SparkSession, d: str) -> DataFrame:
    turns = _t(spark, d, "conversations").select("conv_id", "turn", "text")
    steps = W.score_steps(turns, "conv_id", "turn", "text")
    out = W.case_scores(steps, _cases(turns, "conv_id"), "conv_id")
    return out.select("conv_id", "num_steps", F.round("total_score", 6).alias("total_score"), F.round("score", 6).alias("score"))


@query(f"SELECT conv_id AS id, num_steps, true AS complete, round(total, 6) AS total_score, round(total * exp((difficulty - 5) / 10), 6) AS score FROM ({_case_sql(_TURNS, 'conv_id')})")
def case_scores_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The steps of all cases in four files without order, a third of them with a wrong score that a later file corrects, replayed as a stream."""
    turns = _t(spark, d, "conversations").select("conv_id", "turn", "text")
    steps = W.score_steps(turns, "conv_id", "turn", "text")
    sizes = _cases(turns, "conv_id")
    whole = sizes.join(steps.drop("num_steps"), "conv_id", "left")  # cases of one step have none that is scored
    mixed = F.pmod(F.hash("conv_id", "index"), F.lit(3))
    right = whole.select(F.col("conv_id").alias("id"), F.col("index").cast("int").alias("index"), F.col("num_steps").cast("int").alias("num_steps"), "difficulty", "step_score", F.lit(1).cast("long").alias("version"), (mixed + 1).cast("int").alias("file"))
    wrong = right.where("file = 3").withColumns({"step_score": F.col("step_score") + 0.5, "version": F.lit(0).cast("long"), "file": F.lit(0)})
    rows = materialize(right.unionByName(wrong), "steps")
    feed, out = new_path(spark, "feed"), new_path(spark, "revisions")
    for n in range(4):
        rows.where(F.col("file") == n).drop("file").orderBy(F.hash("id", "index")).coalesce(1).write.mode("append").json(feed)
    stream = V.stream_jsonl(spark, feed, Y.STEP, files_per_batch=1)
    with V.rocks(spark):
        V.run_batches(Y.revisions(stream), lambda b: b, out, new_path(spark, "offsets")).awaitTermination()
    given = spark.read.schema("id bigint, revision bigint, complete boolean, num_steps bigint, difficulty double, total_score double, score double").json(out)  # with its batch
    return Y.latest(given).select("id", "num_steps", "complete", F.round("total_score", 6).alias("total_score"), F.round("score", 6).alias("score"))


# a larger table of steps: order lines, their discount as score
_LINES = "(SELECT l_orderkey, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, l_discount * 10 AS v FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))"
_ORDERS = _case_sql(_LINES, "l_orderkey")


def _order_scores(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    own = Window.partitionBy("l_orderkey")
    lines = _t(spark, d, "lineitem")
    steps = lines.select(
        "l_orderkey",
        F.row_number().over(own.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("index"),
        F.count("*").over(own).alias("num_steps"),
        (F.col("l_discount") * 10).alias("step_score"),
    )
    # cases come from the steps themselves: one aggregation on the same key, no join
    part = F.when(F.col("index") < F.col("num_steps"), W.step_share(F.col("index"), F.col("num_steps")) * F.col("step_score"))
    sums = steps.groupBy("l_orderkey", "num_steps").agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("sum"))
    totals = sums.withColumn("total_score", F.col("sum") / W.weight_total(F.col("num_steps")))
    difficulty = 1 + (F.col("l_orderkey") % 17) / 2.0
    return totals.select("l_orderkey", "num_steps", difficulty.alias("difficulty"), "total_score", (F.col("total_score") * W.difficulty_factor(difficulty)).alias("score"))


@query(f"SELECT l_orderkey, num_steps, difficulty, round(total, 6) AS total_score, round(total * exp((difficulty - 5) / 10), 6) AS score FROM ({_ORDERS})")
def difficulty_adjusted(spark: SparkSession, d: str) -> DataFrame:
    return _order_scores(spark, d).select("l_orderkey", "num_steps", "difficulty", F.round("total_score", 6).alias("total_score"), F.round("score", 6).alias("score"))


@query(f"SELECT count(*) AS num, round(sum(total * exp((difficulty - 5) / 10)) * 10 / count(*), 6) AS avg_score FROM ({_ORDERS})")
def model_summary(spark: SparkSession, d: str) -> DataFrame:
    return W.model_summary(_order_scores(spark, d)).select("num", F.round("avg_score", 6).alias("avg_score"))


@query(f"SELECT num, round(a, 6) AS running_avg FROM (SELECT row_number() OVER (ORDER BY l_orderkey) AS num, avg(total * exp((difficulty - 5) / 10)) OVER (ORDER BY l_orderkey ROWS UNBOUNDED PRECEDING) AS a FROM ({_ORDERS})) WHERE num % 50 = 0")
def running_average(spark: SparkSession, d: str) -> DataFrame:
    out = W.running_average(_order_scores(spark, d), "l_orderkey")
    return out.select("num", F.round("running_avg", 6).alias("running_avg"))


@query("SELECT p_size AS key, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percentage FROM part GROUP BY p_size ORDER BY key")
def distribution_numeric(spark: SparkSession, d: str) -> DataFrame:
    return D.distribution(_t(spark, d, "part"), "p_size", digits=6)


@query("SELECT event_type AS key, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percentage FROM events GROUP BY event_type ORDER BY count DESC, key")
def distribution_count_desc(spark: SparkSession, d: str) -> DataFrame:
    return D.distribution(_t(spark, d, "events"), "event_type", "count", digits=6)


@query(
    "SELECT count(*) AS n, min(c) AS min, quantile_cont(c, 0.25) AS q1, quantile_cont(c, 0.5) AS median, quantile_cont(c, 0.75) AS q3, max(c) AS max, round(avg(c), 6) AS mean, round(stddev_samp(c), 6) AS sd, round(stddev_pop(c), 6) AS sd_pop FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM lineitem GROUP BY l_orderkey)"
)
def five_number_summary(spark: SparkSession, d: str) -> DataFrame:
    counts = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("double").alias("c"))
    out = D.five_numbers(counts, "c")
    return out.select("n", "min", "q1", "median", "q3", "max", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "sd_pop")])


@query("SELECT round(avg(s), 6) AS avg_score, round(var_samp(s), 6) AS score_variance, round(avg(f), 6) AS avg_difficulty, round(var_samp(f), 6) AS difficulty_variance FROM (SELECT o_totalprice AS s, 1 + (o_orderkey % 17) / 2.0 AS f FROM orders ORDER BY o_orderkey LIMIT 25)")
def head25_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").select("o_orderkey", "o_totalprice", (1 + (F.col("o_orderkey") % 17) / 2.0).alias("difficulty"))
    out = D.head_stats(rows, "o_orderkey", "o_totalprice", "difficulty")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity) AS n FROM lineitem")
def regression(spark: SparkSession, d: str) -> DataFrame:
    out = D.regression(_t(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


@query("""WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
c AS (SELECT CAST(least(floor(10 * (value - lo) / (hi - lo)), 9) AS BIGINT) AS bin, count(*) AS count FROM events, s GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, round(lo + i * ((hi - lo) / 10), 6) AS low, round(lo + (i + 1) * ((hi - lo) / 10), 6) AS high, coalesce(count, 0) AS count FROM range(10) r(i) CROSS JOIN s LEFT JOIN c ON bin = i""")
def histogram10(spark: SparkSession, d: str) -> DataFrame:
    out = D.histogram(_t(spark, d, "events"), "value")
    return out.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "count")


@query("""WITH s AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, stddev_samp(c_acctbal) * pow(count(*), -0.2) AS h FROM customer),
g AS (SELECT (lo - 3 * h) + (hi - lo + 6 * h) * i / 49 AS x, h FROM range(50) r(i), s)
SELECT round(x, 4) AS x, round(avg(exp(-0.5 * pow((x - c_acctbal) / h, 2)) / (h * sqrt(2 * pi()))), 12) AS density FROM g, customer GROUP BY x""")
def kde_grid(spark: SparkSession, d: str) -> DataFrame:
    return D.kde(_t(spark, d, "customer"), "c_acctbal").select(F.round("x", 4).alias("x"), F.round("density", 12).alias("density"))


@query("SELECT CAST(count(*) AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS density, r AS copy FROM customer, range(3) t(r) GROUP BY r")
def kde_constant(spark: SparkSession, d: str) -> DataFrame:
    """A column that has the number of rows in every row has no bandwidth: all points are its value, without a density."""
    rows = _t(spark, d, "customer")
    same = rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))  # one row
    out = D.kde(same, "n", points=3)
    return out.groupBy("x", "density").agg(F.count("*").alias("n")).select("x", "density", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(value * 600000000 AS BIGINT) AS t FROM events),
f AS (SELECT *, CASE WHEN s > max(t) OVER (PARTITION BY user_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM e),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS grp FROM f)
SELECT user_id, min(s) AS start, max(t) AS "end" FROM g GROUP BY user_id, grp""")
def interval_merge(spark: SparkSession, d: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = _t(spark, d, "events").select("user_id", us.alias("start"), (us + F.round(F.col("value") * 600_000_000).cast("bigint")).alias("end"))
    return P.merge_intervals(rows, ["user_id"])


@query(rf"""WITH s AS (SELECT conv_id, i, n, v FROM {_TURNS}),
c AS (SELECT conv_id, num_steps, difficulty, total FROM ({_case_sql('s', 'conv_id')})),
l AS (SELECT conv_id, string_agg('  - Step ' || i || printf(': score=%.4f, weighted=%.4f, hallucination=%d', v, v, CASE WHEN v < 0.6 THEN 1 ELSE 0 END), chr(10) ORDER BY i) AS steps FROM s WHERE i < n GROUP BY conv_id),
t AS (SELECT conv_id, first(text ORDER BY turn) AS problem, string_agg('  [' || (turn + 1) || '] ' || trim(text), chr(10) ORDER BY turn) AS gens FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(['Case #' || conv_id, 'Difficulty: ' || printf('%.1f', difficulty), printf('Weighted Score: %.4f', round(total * exp((difficulty - 5) / 10), 6)), 'Total Steps: ' || num_steps, 'Problem:', trim(problem), 'Answer:', 'a' || conv_id, 'Step Scores:', coalesce(steps, '  <no step scores>'), 'Generated Outputs:', gens, '{"-" * 80}'], chr(10)) AS log
FROM c JOIN t USING (conv_id) LEFT JOIN l USING (conv_id)""")
def case_log_text(spark: SparkSession, d: str) -> DataFrame:
    turns = _t(spark, d, "conversations").select("conv_id", "turn", "text")
    steps = W.score_steps(turns, "conv_id", "turn", "text")
    scores = W.case_scores(steps, _cases(turns, "conv_id"), "conv_id").withColumn("score", F.round("score", 6))
    texts = turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("gens"))
    rows = W.case_records(scores, steps, "conv_id").join(texts, "conv_id")
    log = K.case_log(F.col("conv_id"), F.col("difficulty"), F.col("score"), F.col("num_steps"), F.col("gens")[0], F.concat(F.lit("a"), F.col("conv_id").cast("string")), F.col("steps"), F.col("gens"))
    return rows.select("conv_id", log.alias("log"))


@query("SELECT event_id, greatest(0.0, least(1.0, value - 5)) AS score, event_type AS label, substr(repeat(props, 40), 1, 200) AS justification FROM events")
def claim_judgement(spark: SparkSession, d: str) -> DataFrame:
    j = M.claim_judgement(F.col("value") - 5, F.concat(F.lit(" "), F.upper("event_type"), F.lit("\n")), F.repeat("props", F.lit(40)))
    return _t(spark, d, "events").select("event_id", j.alias("j")).select("event_id", "j.*")


@query("SELECT event_id, event_type || ', ' || event_id AS claims FROM events")
def claims_parse(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit('{"segments": [{"id": 1, "text": "'), "event_type", F.lit('"}, {"id": 2, "text": "'), F.col("event_id").cast("string"), F.lit('"}]}'))
    return _t(spark, d, "events").select("event_id", F.array_join(J.claim_texts(raw), ", ").alias("claims"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, round(coalesce(CAST(l_discount AS DOUBLE), 0.0), 9) AS forward, round(l_tax, 9) AS backward, (l_discount + l_tax) / 2.0 >= 0.05 AS kept, l_discount * 10 < 0.6 AS hallucination FROM lineitem")
def pair_flags(spark: SparkSession, d: str) -> DataFrame:
    pair = J.score_pair(F.concat(F.lit("["), F.col("l_discount").cast("string"), F.lit(", "), F.col("l_tax").cast("string"), F.lit("]")))
    rows = _t(spark, d, "lineitem").withColumn("p", pair)
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", F.round(F.col("p")[0], 9).alias("forward"), F.round(F.col("p")[1], 9).alias("backward"), ((F.col("p")[0] + F.col("p")[1]) / 2.0 >= 0.05).alias("kept"), (F.col("p")[0] * 10 < 0.6).alias("hallucination"))


@query("""SELECT a.vec_id, round(list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y)), 6) AS cosine
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) a JOIN (SELECT vec_id - 1 AS vec_id, CAST(embedding AS DOUBLE[]) AS y FROM embeddings) b USING (vec_id)""")
def cosine_alignment(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    both = e.select("vec_id", F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    return both.select("vec_id", F.round(M.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


# readers: each query writes files of lines, in several parts, and reads them back
def _event_lines(spark: SparkSession, d: str, line: Column, name: str) -> str:
    path = new_path(spark, name)
    rows = _t(spark, d, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0))
    rows.repartitionByRange(5, "event_id").sortWithinPartitions("event_id").select(line.alias("value")).write.text(path)
    return path


def _event() -> Column:
    return F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "k": '), F.col("k"), F.lit("}"))


@query("SELECT row_number() OVER (ORDER BY event_id) AS id, event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events WHERE event_id % 7 <> 3")
def jsonl_tolerant(spark: SparkSession, d: str) -> DataFrame:
    line = F.when(F.col("event_id") % 7 == 3, F.concat(_event(), F.lit(" thanks"))).otherwise(F.concat(F.lit(" "), _event(), F.lit(" \n")))
    path = _event_lines(spark, d, line, "tolerant")
    return R.read_jsonl(spark, path, "event_id bigint, k bigint").select(_big(F.col("id")).alias("id"), "event_id", "k")


@query("SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events")
def jsonl_strict(spark: SparkSession, d: str) -> DataFrame:
    path = _event_lines(spark, d, F.concat(_event(), F.lit("\n")), "strict")
    return R.read_jsonl_strict(spark, path, "event_id bigint, k bigint")


@query("SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events")
def jsonl_all_or_nothing(spark: SparkSession, d: str) -> DataFrame:
    """A file of single-quoted keys, and the same with one bad line, which gives no row."""
    single = F.replace(_event(), F.lit('"'), F.lit("'"))
    good = _event_lines(spark, d, single, "quoted")
    bad = _event_lines(spark, d, F.when(F.col("event_id") == 5, "{'event_id': ").otherwise(single), "damaged")
    schema = "event_id bigint, k bigint"
    return R.read_jsonl_all_or_nothing(spark, good, schema).unionByName(R.read_jsonl_all_or_nothing(spark, bad, schema))


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def hub_copy(spark: SparkSession, d: str) -> DataFrame:
    return R.read_hub_copy(spark, f"{d}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("""SELECT event_id, '{"a": ' || event_id || ', "b": ''x''}' AS fixed FROM events""")
def fix_json_format(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("{'a': "), F.col("event_id").cast("string"), F.lit(", 'b': 'x'}"))
    return _t(spark, d, "events").select("event_id", J.fix_json_format(raw).alias("fixed"))


# records of no fixed type
_SHAPES = {
    0: """'[1, [2.5, [true, null, " x ", []], ["é", ["' || role || '"]]], {"k":' || turn || ',"l":["z"]}, ' || conv_id || ']'""",
    1: "to_json(text)",
    2: "'[[[[[' || to_json(text) || ']]], \"\", 1e3], false]'",
    3: """'{"turn":' || turn || ',"b":[1,null]}'""",
    4: "CASE turn % 3 WHEN 0 THEN 'null' WHEN 1 THEN '[]' ELSE turn || '.50' END",
}
_SHAPE_SQL = "CASE (conv_id + turn) % 5 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _SHAPES.items()) + " END"


@query(f"""WITH RECURSIVE r AS (
  SELECT conv_id, turn, CAST([] AS BIGINT[]) AS p, CAST({_SHAPE_SQL} AS JSON) AS j FROM conversations
  UNION ALL
  SELECT conv_id, turn, list_append(p, i), json_extract(j, '$[' || i || ']') FROM (SELECT *, unnest(range(CAST(json_array_length(j) AS BIGINT))) AS i FROM r WHERE json_type(j) = 'ARRAY')),
a AS (
  SELECT conv_id, turn, p, CASE json_type(j) WHEN 'NULL' THEN '' WHEN 'VARCHAR' THEN trim(j ->> '$', ' ' || chr(9) || chr(10) || chr(13)) WHEN 'BOOLEAN' THEN upper(CAST(j AS VARCHAR)[1]) || CAST(j AS VARCHAR)[2:]
    WHEN 'OBJECT' THEN replace(replace(CAST(j AS VARCHAR), ':', ': '), ',', ', ') WHEN 'DOUBLE' THEN CAST(CAST(j AS DOUBLE) AS VARCHAR) ELSE CAST(j AS VARCHAR) END AS s
  FROM r WHERE json_type(j) <> 'ARRAY')
SELECT conv_id, turn, coalesce(flat, '') AS flat, coalesce(flat, '') AS from_text FROM conversations LEFT JOIN (SELECT conv_id, turn, string_agg(s, ' ' ORDER BY p) FILTER (s <> '') AS flat FROM a GROUP BY ALL) USING (conv_id, turn)""")
def flatten_variant(spark: SparkSession, d: str) -> DataFrame:
    """Strings, numbers, nulls, objects and lists nested to different depths in one column, as VARIANT and as JSON text."""
    text = F.to_json(F.struct(F.col("text").alias("t")))
    quoted = F.substring(text, F.lit(6), F.length(text) - 6)  # of {"t":"..."}
    turn, conv = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    shapes = [
        F.concat(F.lit('[1, [2.5, [true, null, " x ", []], ["é", ["'), "role", F.lit('"]]], {"k":'), turn, F.lit(',"l":["z"]}, '), conv, F.lit("]")),
        quoted,
        F.concat(F.lit("[[[[["), quoted, F.lit(']]], "", 1e3], false]')),
        F.concat(F.lit('{"turn":'), turn, F.lit(',"b":[1,null]}')),
        F.when(F.col("turn") % 3 == 0, "null").when(F.col("turn") % 3 == 1, "[]").otherwise(F.concat(turn, F.lit(".50"))),
    ]
    value = F.element_at(F.array(*shapes), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    rows = _t(spark, d, "conversations").select("conv_id", "turn", value.alias("j"))
    # a VARIANT sorts an object's keys, so the objects that have two go as text
    sorted_keys = F.when(F.col("j").startswith('{"turn"'), N.flatten_nested(F.col("j"), variant=False)).otherwise(N.flatten_nested(F.parse_json("j")))
    return rows.select("conv_id", "turn", sorted_keys.alias("flat"), N.flatten_nested(F.col("j"), variant=False).alias("from_text"))


_EXTRA = "CASE event_id % 3 WHEN 0 THEN ', \"more\": {\"a\": [' || event_id || ', null]}' WHEN 1 THEN ', \"é x\": \"' || event_type || '\"' ELSE '' END"


@query(f"SELECT row_number() OVER (ORDER BY event_id) AS id, event_id, k, '{{\"event_id\": ' || event_id || ', \"k\": ' || k || {_EXTRA} || ', \"seen\": true}}' AS record FROM (SELECT *, regexp_extract(props, '[0-9]+') AS k FROM events WHERE event_id % 7 <> 3)")
def jsonl_records(spark: SparkSession, d: str) -> DataFrame:
    """Lines of different keys, some bad, cut into ranges of 64 kB: ordinals, and records that keep what no schema names."""
    extra = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "more": {"a": ['), F.col("event_id").cast("string"), F.lit(", null]}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit(', "é x": "'), "event_type", F.lit('"'))).otherwise("")
    whole = F.concat(F.lit(' {"event_id": '), F.col("event_id").cast("string"), F.lit(', "k": '), "k", extra, F.lit("}"))
    path = _event_lines(spark, d, F.when(F.col("event_id") % 7 == 3, F.concat(whole, F.lit(" thanks"))).otherwise(F.concat(whole, F.lit("\r\n"))), "records")
    rows = J_.read_records(spark, path, split_bytes=1 << 16)
    record = N.with_fields(F.col("record"), F.lit('{"seen": true}'))
    return rows.select("id", J_.field(F.col("value"), "event_id", "bigint").alias("event_id"), J_.field(F.col("value"), "k", "string").alias("k"), record.alias("record"))


@query("SELECT row_number() OVER (ORDER BY event_id) AS id, event_id, (SELECT CAST(sum(length(line) + 1) AS BIGINT) FROM (SELECT event_id, '{''event_id'': ' || event_id || '}' AS line FROM events) l WHERE l.event_id < 5) AS bad_byte FROM events")
def jsonl_records_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Single-quoted keys repaired, all or nothing: a damaged copy gives no row, and the strict read names the byte of its bad line."""
    line = F.concat(F.lit("{'event_id': "), F.col("event_id").cast("string"), F.lit("}"))
    good, bad = new_path(spark, "quoted"), new_path(spark, "damaged")
    events = _t(spark, d, "events").select("event_id")
    events = events.repartitionByRange(1 + events.count() // 1_000_000, "event_id").sortWithinPartitions("event_id")  # files follow each other by name
    events.select(line.alias("value")).write.text(good)
    events.select(F.when(F.col("event_id") == 5, F.replace(line, F.lit("}"), F.lit(""))).otherwise(line).alias("value")).write.text(bad)
    rows = J_.read_records_all_or_nothing(spark, good, split_bytes=2048).unionByName(J_.read_records_all_or_nothing(spark, bad, split_bytes=2048))
    return rows.select("id", J_.field(F.col("value"), "event_id", "bigint").alias("event_id"), F.lit(J_.first_bad_byte(spark, bad, "repair")).cast("bigint").alias("bad_byte"))


# thresholds on odd rows
_ODD_SOLUTION = "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' || chr(10) || chr(9) ELSE replace(text, chr(10), chr(10) || ' ' || chr(10)) END"


def _odd_solutions(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 4 == 0, F.lit(None)).when(F.col("doc_id") % 4 == 1, " \n\t").otherwise(F.replace("text", F.lit("\n"), F.lit("\n \n")))
    return _t(spark, d, "documents").select("doc_id", text.alias("solution"))


@query("SELECT doc_id FROM documents WHERE doc_id % 4 > 1 AND regexp_matches(text, '\\S')")
def blank_reject(spark: SparkSession, d: str) -> DataFrame:
    return P.filter_long(_odd_solutions(spark, d), SegmentConfig(min_chars=0)).select("doc_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, {Q.paragraphs(Q.normalize(_ODD_SOLUTION))} AS p FROM documents) WHERE len(p) >= 3")
def paragraph_threshold(spark: SparkSession, d: str) -> DataFrame:
    return P.filter_long(_odd_solutions(spark, d), SegmentConfig(min_chars=None, use_paragraphs=True, min_paragraphs=3)).select("doc_id")


@query("SELECT conv_id, turn, trim(text) AS plain, role || ' ' || trim(text) AS one, trim(text) || ' ' || role AS two FROM conversations")
def normalize_generation(spark: SparkSession, d: str) -> DataFrame:
    padded = F.concat(F.lit(" \n"), "text", F.lit("\t"))
    none = F.lit(None).cast("string")
    forms = [T.normalize_generation(padded), T.normalize_generation(F.array(F.col("role"), none, padded), 1), T.normalize_generation(F.array(F.array(padded, F.lit(" ")), F.array(F.col("role"), none)), 2)]
    return _t(spark, d, "conversations").select("conv_id", "turn", *[f.alias(n) for f, n in zip(forms, ("plain", "one", "two"), strict=True)])


# joins on order and overlap, and table functions
_ORDER_US = "1704067200000000 + (o_orderkey * 173 % 2592000) * 1000000"


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey, {_ORDER_US} AS us FROM orders),
e AS (SELECT user_id, epoch_us(ts) AS us, event_id, event_type FROM events),
m AS (SELECT o_orderkey, e.event_id, event_type FROM o JOIN e ON user_id = o_custkey AND e.us <= o.us QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY e.us DESC, e.event_id DESC) = 1)
SELECT o_orderkey, event_id, event_type FROM o LEFT JOIN m USING (o_orderkey)""")
def asof_event(spark: SparkSession, d: str) -> DataFrame:
    """The last event of a customer before each of the orders, which are moved into the month of the events."""
    orders = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.expr(_ORDER_US).alias("us"))
    events = _t(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "event_type")
    return JN.asof_join(orders, events, ["user_id"], "us", "us", ["event_id", "event_type"], ["event_id"]).select("o_orderkey", "event_id", "event_type")


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(value * 600000000 AS BIGINT) AS t FROM events)
SELECT a.event_id AS first, b.event_id AS second FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.s <= b.t AND b.s <= a.t""")
def interval_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Spans of events against each other, a third of them of one user, whose stretches are split."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = _t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")).alias("user_id"), us.alias("s"), (us + F.round(F.col("value") * 600_000_000).cast("bigint")).alias("t"))
    both = JN.interval_join(spans, spans, ["user_id"], ("s", "t"), ("s", "t"), most=50)
    return both.where("l.event_id < r.event_id").select(F.col("l.event_id").alias("first"), F.col("r.event_id").alias("second"))


@query(f"WITH {_units_sql(200)}, m AS (SELECT doc_id, {Q.merge('u', 60)} AS m FROM u), x AS (SELECT doc_id, unnest(m) AS e, unnest(range(len(m))) AS id FROM m) SELECT doc_id, id, e.t AS type, e.c AS content, e.p AS paragraph_index FROM x")
def fine_segment_sql(spark: SparkSession, d: str) -> DataFrame:
    """The units as a table function of SQL."""
    B.register(spark)
    _t(spark, d, "documents").select("doc_id", _solution().alias("solution")).createOrReplaceTempView("quillmark_solutions")
    return spark.sql("SELECT doc_id, CAST(id AS BIGINT) AS id, type, content, CAST(paragraph_index AS BIGINT) AS paragraph_index FROM quillmark_solutions, LATERAL fine_segment(solution, 200, 60)")


# prompts, engines, the whole evaluation
def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _prompt_sql(system: str, user: str) -> str:
    return f"{_quoted(f'system: {system}')} || chr(10) || 'user: ' || {user}"


# written out once more, so that a change of the library's texts is a difference
_CONTINUE = "Continue the solution below with the next step only. At most 18 lines and 400 words. Write <<<END>>> when the step is complete."
_JUDGE = 'Does the candidate step entail the reference step? Answer with {"score": x}, x from 0 to 1, and nothing after it.'
_PAIR = "Score how far the first text entails the second and the second the first. Answer with [forward, backward], each from 0 to 1."
_CLAIM_TEXT = 'List the propositions of the text, at most 80 characters each. Answer with {"segments": [{"id": 1, "text": "..."}]}.'
_REWRITE = "Rewrite the text in this style without a change of content."


@query(f"""SELECT conv_id, turn, {_prompt_sql(_CONTINUE, "'Problem:' || chr(10) || role || chr(10) || 'Solution so far:' || chr(10) || trim(text)")} AS next,
{_prompt_sql(_JUDGE, "'Candidate:' || chr(10) || text || chr(10) || 'Reference:' || chr(10) || role")} AS judge,
{_prompt_sql(_PAIR, "'First:' || chr(10) || text || chr(10) || 'Second:' || chr(10) || role")} AS pair,
{_prompt_sql(_CLAIM_TEXT, "text")} AS claims, {_quoted("system: " + _REWRITE + chr(10))} || role || chr(10) || 'user: ' || text AS rewrite, 'user: ' || text AS bare FROM conversations""")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    text, role = F.col("text"), F.col("role")
    each = {
        "next": M.continue_prompt(role, F.concat(F.lit("\n"), text)), "judge": M.judge_prompt(text, role), "pair": M.pair_prompt(text, role),
        "claims": M.claims_prompt(text), "rewrite": M.rewrite_prompt(role, text), "bare": M.chat_prompt(F.lit(""), text),
    }
    return _t(spark, d, "conversations").select("conv_id", "turn", *[c.alias(n) for n, c in each.items()])


def _no_template(config) -> None:
    """A tokenizer that has no chat template."""


def _judge_length() -> str:
    prompt = _prompt_sql(_JUDGE, "'Candidate:' || chr(10) || text || chr(10) || 'Reference:' || chr(10) || role")
    return f"length({prompt})"


@query(f"SELECT conv_id, turn, ({_judge_length()} % 101) / 100.0 AS score, CAST(0.25 AS DOUBLE) AS forward, CAST(0.75 AS DOUBLE) AS backward, regexp_extract('user: ' || text, '[^ ]*$')[1:80] AS claim, 'system: ' || role || chr(10) || 'user: ' || text AS chat FROM conversations")
def guided_answers(spark: SparkSession, d: str) -> DataFrame:
    """Judge, pair and claims models with their schemas, and a chat template, through an engine in each worker."""
    ship(spark)
    call = M.generator(M.EchoEngine)
    rows = _t(spark, d, "conversations").select("conv_id", "turn", M.model_scorer(call)(F.col("text"), F.col("role")).alias("score"), M.model_pair(call)(F.col("text"), F.col("role")).alias("p"), M.model_claims(call)(F.col("text")).alias("c"), M.templated_prompt(_no_template)(F.col("role"), F.col("text")).alias("chat"))
    return rows.select("conv_id", "turn", "score", "p.forward", "p.backward", F.coalesce(F.col("c")[0], F.lit("")).alias("claim"), "chat")


@query("SELECT conv_id, turn, '<|system|>' || chr(10) || role || '<|end|>' || chr(10) || '<|user|>' || chr(10) || text || '<|end|>' || chr(10) || '<|assistant|>' || chr(10) AS chat, '<|user|>' || chr(10) || text || '<|end|>' || chr(10) || '<|assistant|>' || chr(10) AS bare FROM conversations")
def templated_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Every turn through a tokenizer that has a template, with a system part and without."""
    ship(spark)
    prompt = M.templated_prompt(M.MarkedTurns)
    rows = _t(spark, d, "conversations")
    return rows.select("conv_id", "turn", prompt(F.col("role"), F.col("text")).alias("chat"), prompt(F.lit(""), F.col("text")).alias("bare"))


class Measure:
    """An engine that tells how long a prompt is and how its second line begins; asked for its style, it names one."""

    def __init__(self, config) -> None:
        self.stop = config.stop

    def generate(self, prompts: list[str], schema: dict | None = None) -> list[str]:
        return [" terse; dry " if p.endswith("Your style, please.") else f"{len(p)} {p.splitlines()[1][:9]} {self.stop} more" for p in prompts]


@query(f"SELECT conv_id, turn, length({_quoted('system: ' + _REWRITE + chr(10) + 'terse; dry' + chr(10) + 'user: ')}) + length(text) || ' terse; dr' AS rewritten FROM conversations")
def styled(spark: SparkSession, d: str) -> DataFrame:
    """The style is asked for once, and every text rewritten in it."""
    ship(spark)
    call = M.generator(Measure)
    write = M.rewriter(call, M.probe_style(spark, call))
    return _t(spark, d, "conversations").select("conv_id", "turn", write(F.col("text")).alias("rewritten"))


def _problems(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as segmented problems: each turn is a segment, its line ends as blanks."""
    segment = F.struct(F.col("turn").cast("int").alias("id"), F.lit("text").alias("type"), F.translate("text", "\n", " ").alias("content"), F.lit(0).alias("paragraph_index"))
    rows = _t(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", segment.alias("s")))), lambda x: x["s"]).alias("segments"))
    return rows.select(F.col("conv_id").alias("id"), F.concat(F.lit("p"), F.col("conv_id").cast("string")).alias("problem"), F.concat(F.lit("a"), F.col("conv_id").cast("string")).alias("answer"), (1 + (F.col("conv_id") % 17) / 2.0).alias("difficulty"), "segments")


def _evaluated(spark: SparkSession, d: str) -> E.Evaluation:
    ship(spark)
    return E.evaluate(_problems(spark, d), M.generator(M.EchoEngine), store=lambda x: materialize(x, "evaluation"))


# the echo gives back the last line of the prefix, so a step scores its overlap with the next one
_LINES_ = "(SELECT conv_id, turn, translate(text, chr(10), ' ') AS text FROM conversations)"
_ECHO = f"(SELECT conv_id, turn, trim(text) AS gen, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM {_LINES_})"
_ECHO_STEPS = f"(SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n, coalesce({_PREFIX_SCORE}, 0.0) AS v FROM {_ECHO})"


@query(f"SELECT conv_id AS id, i AS index, n AS num_steps, round(v, 9) AS score, CAST(v < 0.6 AS INTEGER) AS hallucination FROM {_ECHO_STEPS} WHERE i < n")
def evaluation_steps(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d).steps.select("id", _big(F.col("index")).alias("index"), _big(F.col("num_steps")).alias("num_steps"), F.round("score", 9).alias("score"), "hallucination")


@query(f"SELECT conv_id AS id, 'p' || conv_id AS problem, 'a' || conv_id AS answer, num_steps, num_steps - 1 AS scored, difficulty, round(total * exp((difficulty - 5) / 10), 6) AS score FROM ({_case_sql(_ECHO_STEPS, 'conv_id')})")
def evaluation_cases(spark: SparkSession, d: str) -> DataFrame:
    cases = _evaluated(spark, d).cases
    return cases.select("id", "problem", "answer", _big(F.col("num_steps")).alias("num_steps"), _big(F.size("steps")).alias("scored"), "difficulty", F.round("score", 6).alias("score"))


@query(f"SELECT conv_id AS id, string_agg(trim(text), '{BAR}' ORDER BY turn) AS generated FROM {_LINES_} GROUP BY conv_id")
def evaluation_generations(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d).generations.select("id", F.array_join("gen_output", BAR).alias("generated"))


@query("SELECT conv_id, turn, upper(role) || '!' AS said FROM conversations")
def memo(spark: SparkSession, d: str) -> DataFrame:
    return M.once_per_text(_t(spark, d, "conversations"), "role", lambda x: F.concat(F.upper(x), F.lit("!")), "said").select("conv_id", "turn", "said")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 OR text IN (SELECT role FROM conversations) THEN upper(role) || '!1' ELSE length(text) || '!2' END AS said FROM conversations")
def memo_again(spark: SparkSession, d: str) -> DataFrame:
    """A first run over all roles, a second one over roles and texts: it asks for the texts alone and remembers the roles' answers."""
    rows, path = _t(spark, d, "conversations"), new_path(spark, "memo")
    X.Memo(spark, path, "m").answer(rows.select("role"), "role", lambda x: F.concat(F.upper(x), F.lit("!1")), "said")
    both = rows.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(F.col("text")).alias("asked"))
    later = X.Memo(spark, path, "m").answer(both, "asked", lambda x: F.concat(F.length(x).cast("string"), F.lit("!2")), "said")
    return later.select("conv_id", "turn", "said")


@query(f"SELECT conv_id, turn, role, regexp_extract('user: ' || text, '[^{chr(10)}]*$') || ' <<<END>>> and more' AS answer FROM conversations")
def placed_answers(spark: SparkSession, d: str) -> DataFrame:
    """A model stage that can have a resource profile; without one it runs like any other."""
    rows = _t(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return M.answers(rows, M.chat_prompt(F.lit(""), F.col("text")), M.EchoEngine).select("conv_id", "turn", "role", "answer")


# charts: drawn, written, and read back
@query("""WITH c AS (SELECT event_type || CASE WHEN event_id % 2 = 0 THEN ' <&">' ELSE '' END AS key, count(*) AS count FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY count DESC, key) AS rank, count(*) OVER () AS n, max(count) OVER () AS most FROM c),
s AS (SELECT *, least(6.0 + greatest(n - 10, 0) * 0.25, 20.0)::DOUBLE * 100 - 60 - 20 AS w, (CASE WHEN n <= 15 THEN 4.5 ELSE 5.5 END)::DOUBLE * 100 AS h FROM r),
t AS (SELECT *, w / n AS step, CAST(count AS DOUBLE) / most * (h - 40 - 60) * 0.95::DOUBLE AS tall FROM s)
SELECT key, CAST(count AS DOUBLE) AS count, CAST(printf('%.2f', 60 + step * (rank - 1) + step * 0.1::DOUBLE) AS DOUBLE) AS x, CAST(printf('%.2f', step * 0.8::DOUBLE) AS DOUBLE) AS width, CAST(printf('%.2f', tall) AS DOUBLE) AS height, CAST(printf('%.2f', h - 60 - tall) AS DOUBLE) AS y FROM t""")
def chart_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars of a distribution by count, with names that need escapes."""
    name = F.concat("event_type", F.when(F.col("event_id") % 2 == 0, ' <&">').otherwise(""))
    counts = D.distribution(_t(spark, d, "events").select(name.alias("k")), "k").withColumn("down", -F.col("count"))
    path = new_path(spark, "bars")
    C.write_chart(C.bar_chart(counts, ["down", "key"], "Events", "type"), path)
    return C.read_marks(spark, path).select("key", "count", "x", "width", "height", "y")


@query("""WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
c AS (SELECT CAST(least(floor(10 * (value - lo) / (hi - lo)), 9) AS BIGINT) AS bin, count(*) AS count FROM events, s GROUP BY 1)
SELECT CAST(i AS VARCHAR) AS key, CAST(coalesce(count, 0) AS DOUBLE) AS count, CAST(60 + i * 82 AS DOUBLE) AS x FROM range(10) r(i) LEFT JOIN c ON bin = i""")
def chart_histogram(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "histogram")
    C.write_chart(C.histogram_chart(_t(spark, d, "events"), "value", "Values"), path)
    return C.read_marks(spark, path, "bin").select("key", "count", "x")


@query("""WITH p AS (SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS x, CAST(c_acctbal AS DOUBLE) AS y FROM customer)
SELECT round(x, 4) AS x, round(y, 4) AS y, count(*) AS n FROM p GROUP BY ALL""")
def chart_regression(spark: SparkSession, d: str) -> DataFrame:
    """Every pair is a dot of the chart; the chart is left out where a line, or one edge of its band, is not there."""
    path = new_path(spark, "regression")
    C.write_chart(C.regression_chart(_t(spark, d, "customer"), "c_nationkey", "c_acctbal", F.col("c_custkey"), "Balance", points=20, resamples=40), path)
    lines = spark.read.text(path)
    curves = lines.where("value RLIKE 'class=.(fit|low|high).* d=.M([0-9.]+,[0-9.]+ L){19}[0-9.]+,[0-9.]+.'").agg(F.count("*").alias("curves"))
    dots = lines.where(F.col("value").contains('class="dot"')).select(F.regexp_extract("value", 'data-x="([^"]*)"', 1).cast("double").alias("x"), F.regexp_extract("value", 'data-y="([^"]*)"', 1).cast("double").alias("y"))
    both = dots.crossJoin(F.broadcast(curves)).where("curves = 3")  # one row
    return both.groupBy(F.round("x", 4).alias("x"), F.round("y", 4).alias("y")).agg(F.count("*").alias("n"))


# writers: round trips through files
_CASES = _case_sql(_TURNS, "conv_id")


def _case_rows(spark: SparkSession, d: str) -> DataFrame:
    turns = _t(spark, d, "conversations").select("conv_id", "turn", "text")
    steps = W.score_steps(turns, "conv_id", "turn", "text")
    scores = W.case_scores(steps, _cases(turns, "conv_id"), "conv_id").withColumn("score", F.round("score", 6))
    records = W.case_records(scores, steps, "conv_id").withColumnRenamed("conv_id", "id")
    return records.select("id", "difficulty", "score", F.col("num_steps").cast("int").alias("num_steps"), "steps", F.when(F.col("id") % 2 == 0, F.lit("é \"q\"\nx")).alias("problem"), F.lit("a").alias("answer"))


_ROUND = f"SELECT conv_id AS id, difficulty, round(total * exp((difficulty - 5) / 10), 6) AS score, num_steps, num_steps - 1 AS scored, CASE WHEN conv_id % 2 = 0 THEN 'é \"q\"' || chr(10) || 'x' END AS problem FROM ({_CASES})"


def _round(rows: DataFrame) -> DataFrame:
    return rows.select("id", "difficulty", "score", _big(F.col("num_steps")).alias("num_steps"), _big(F.size("steps")).alias("scored"), "problem")


@query(_ROUND)
def sink_jsonl(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "cases")
    K.write_jsonl(_case_rows(spark, d), path)
    return _round(R.read_jsonl_strict(spark, path, CASE))


@query(_ROUND)
def sink_pretty_json(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "pretty")
    K.write_pretty_json(_case_rows(spark, d), path)
    return _round(K.read_pretty_json(spark, path, CASE))


_RUN_SQL = f"""WITH s AS (SELECT conv_id, i, n, v FROM {_ECHO_STEPS}),
c AS (SELECT conv_id, num_steps, difficulty, total * exp((difficulty - 5) / 10) AS score FROM ({_case_sql('s', 'conv_id')})),
t AS (SELECT conv_id, string_agg(i || ':' || printf('%.6f', v) || ':' || CAST(v < 0.6 AS INTEGER), ';' ORDER BY i) FILTER (i < n) AS steps,
  string_agg('  - Step ' || i || printf(': score=%.4f, weighted=%.4f, hallucination=%d', v, v, CAST(v < 0.6 AS INTEGER)), chr(10) ORDER BY i) FILTER (i < n) AS logged FROM s GROUP BY conv_id),
g AS (SELECT conv_id, string_agg(trim(text), '{BAR}' ORDER BY turn) AS texts, string_agg('  [' || (turn + 1) || '] ' || trim(text), chr(10) ORDER BY turn) AS shown FROM {_LINES_} GROUP BY conv_id),
r AS (SELECT conv_id, difficulty, printf('%.6f', score) AS score6, printf('%.4f', score) AS score4, score, num_steps, coalesce(steps, '') AS steps, coalesce(logged, '  <no step scores>') AS logged, texts, shown FROM c JOIN t USING (conv_id) JOIN g USING (conv_id)),
k AS (SELECT conv_id AS id, 'p' || conv_id || ' a' || conv_id || ' ' || difficulty || ' ' || num_steps || ' ' || score6 || ' ' || steps AS record FROM r)
SELECT 'cases' AS output, id, record FROM k UNION ALL SELECT 'pretty', id, record FROM k
UNION ALL SELECT 'generations', conv_id, difficulty || ' ' || score6 || ' ' || steps || ' ' || texts FROM r
UNION ALL SELECT 'log', conv_id, array_to_string(['Case #' || conv_id, 'Difficulty: ' || difficulty, 'Weighted Score: ' || score4, 'Total Steps: ' || num_steps, 'Problem:', 'p' || conv_id, 'Answer:', 'a' || conv_id, 'Step Scores:', logged, 'Generated Outputs:', shown], chr(10)) FROM r
UNION ALL SELECT 'summary', count(*), printf('%.6f', sum(score) * 10 / count(*)) FROM r"""


@query(_RUN_SQL)
def sink_run(spark: SparkSession, d: str) -> DataFrame:
    """The five outputs of a run, written and read back, every record whole."""
    e = _evaluated(spark, d)
    base = K.run_path(new_path(spark, "runs"), "a/model", "judge", 7)
    log = K.case_log(F.col("id"), F.col("difficulty"), F.col("score"), F.col("num_steps"), F.col("problem"), F.col("answer"), F.col("steps"), F.col("gen_output"))
    K.write_run(base, e.cases, e.generations, e.summary, log)
    steps = F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["index"], K.fixed(s["score"], 6), s["hallucination"])), ";")
    record = F.concat_ws(" ", "problem", "answer", "difficulty", "num_steps", K.fixed(F.col("score"), 6), steps)
    cases, pretty = R.read_jsonl_strict(spark, f"{base}/case_results.jsonl", CASE), K.read_pretty_json(spark, f"{base}/case_results_pretty.json", CASE)
    made = R.read_jsonl_strict(spark, f"{base}/gen_and_scores.jsonl", GENERATION_LOG)
    logs = spark.read.option("lineSep", f"\n{K.RULE}\n").text(f"{base}/case.log")
    total = R.read_jsonl_strict(spark, f"{base}/summary.json", SUMMARY)
    parts = [
        cases.select(F.lit("cases").alias("output"), "id", record.alias("record")),
        pretty.select(F.lit("pretty").alias("output"), "id", record.alias("record")),
        made.select(F.lit("generations").alias("output"), "id", F.concat_ws(" ", "difficulty", K.fixed(F.col("final_total_score"), 6), steps, F.array_join("gen_output", BAR)).alias("record")),
        logs.select(F.lit("log").alias("output"), F.regexp_extract("value", r"^Case #(\d+)", 1).cast("bigint").alias("id"), F.col("value").alias("record")),
        total.select(F.lit("summary").alias("output"), F.col("num").alias("id"), K.fixed(F.col("avg_score"), 6).alias("record")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT p_size AS difficulty, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percentage FROM part GROUP BY p_size")
def sink_distribution(spark: SparkSession, d: str) -> DataFrame:
    """The table and the report, written and read back; the report must name every key of the table."""
    base = new_path(spark, "distribution")
    K.write_distribution(_t(spark, d, "part"), "p_size", f"{base}/text", f"{base}/csv")
    rows = spark.read.schema("difficulty int, count bigint, percentage double").option("header", True).csv(f"{base}/csv")
    lines = spark.read.text(f"{base}/text").select(F.regexp_extract("value", r"^(\d+)\t(\d+)\t\(.*%\)$", 1).try_cast("int").alias("difficulty"), F.regexp_extract("value", r"^(\d+)\t(\d+)\t", 2).try_cast("bigint").alias("count"))
    return rows.join(lines, ["difficulty", "count"]).select("difficulty", "count", F.round("percentage", 2).alias("percentage"))


@query("SELECT 'Average score' AS label, round(avg(s), 4) AS value FROM (SELECT o_totalprice AS s FROM orders ORDER BY o_orderkey LIMIT 25) UNION ALL SELECT 'Average difficulty', round(avg(f), 4) FROM (SELECT 1 + (o_orderkey % 17) / 2.0 AS f FROM orders ORDER BY o_orderkey LIMIT 25)")
def sink_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").select("o_orderkey", "o_totalprice", (1 + (F.col("o_orderkey") % 17) / 2.0).alias("difficulty"))
    path = new_path(spark, "stats")
    K.stats_text(D.head_stats(rows, "o_orderkey", "o_totalprice", "difficulty")).write.text(path)
    line = spark.read.text(path).select(F.regexp_extract("value", "^(Average \\w+) for the first 25 cases: (.*)$", 1).alias("label"), F.regexp_extract("value", "cases: (.*)$", 1).try_cast("double").alias("v"))
    return line.where("label <> ''").select("label", F.round("v", 4).alias("value"))


@query(
    f"WITH {_units_sql(220)}, m AS (SELECT doc_id, {Q.merge('u', 60)} AS m FROM u) SELECT doc_id, CAST(len(m) AS BIGINT) AS segment_num, {_SHOWN} AS units FROM m JOIN documents USING (doc_id) WHERE length({Q.normalize(_SOLUTION_SQL)}) >= 800"
)
def sink_segmented(spark: SparkSession, d: str) -> DataFrame:
    """The segmented dataset as JSON lines, read back."""
    rows = _t(spark, d, "documents").select("doc_id", _solution().alias("solution"))
    path = new_path(spark, "segmented")
    K.write_jsonl(P.process_solutions(rows).drop("solution"), path)
    back = R.read_jsonl_strict(spark, path, f"doc_id bigint, segment_num int, segments {SEGMENTS}")
    return back.select("doc_id", _big(F.col("segment_num")).alias("segment_num"), _show("segments").alias("units"))


_DRAW = "SELECT b, k, x, y, CAST((k * 48271 + b * 40692 + 69621) % 2147483647 AS BIGINT) AS r FROM (SELECT (l_orderkey * 8 + l_linenumber) % 2147483647 AS k, l_quantity AS x, l_extendedprice AS y FROM lineitem) CROSS JOIN (SELECT range AS b FROM range(40))"


@query(f"""WITH r1 AS (SELECT b, k, x, y, (r * r + k) % 2147483647 AS r FROM ({_DRAW})),
r2 AS (SELECT b, x, y, ((r * r + 12345) % 2147483647) / 2147483647.0 AS u FROM r1),
p AS (SELECT list(c) AS cuts FROM (SELECT exp(-1.0) * sum(1.0 / factorial(CAST(j AS INTEGER))) OVER (ORDER BY j) AS c FROM range(13) t(j))),
w AS (SELECT b, x, y, len(list_filter(cuts, lambda c: u >= c)) AS w FROM r2, p),
s AS (SELECT b, sum(w) AS w, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM w GROUP BY b),
l AS (SELECT (w * sxy - sx * sy) / (w * sxx - sx * sx) AS m, w, sx, sy FROM s),
c AS (SELECT m, (sy - m * sx) / w AS c FROM l),
a AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, regr_slope(l_extendedprice, l_quantity) AS m0, regr_intercept(l_extendedprice, l_quantity) AS c0 FROM lineitem),
g AS (SELECT lo + (hi - lo) * i / 9.0 AS x, m0, c0 FROM a CROSS JOIN (SELECT range AS i FROM range(10)))
SELECT round(x, 6) AS x, round(any_value(m0 * x + c0), 3) AS fit, round(quantile_cont(m * x + c, 0.025), 3) AS low, round(quantile_cont(m * x + c, 0.975), 3) AS high FROM g CROSS JOIN c GROUP BY x""")
def regression_band(spark: SparkSession, d: str) -> DataFrame:
    out = D.regression_band(_t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", points=10, resamples=40, key=F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return out.select(F.round("x", 6).alias("x"), *[F.round(c, 3).alias(c) for c in ("fit", "low", "high")])


# written out once more, so that a change of the library's table is a difference; some of the words are common in these texts
_ROLE_WORDS = {
    "LowerBound": "lower bound|at least|necessary|must be ≥|cannot be less",
    "UpperBound/Construction": "upper bound|construction|we can achieve|it suffices to construct",
    "Conclusion/Answer": r"therefore|thus|hence|in conclusion|we conclude|\\boxed",
    "CaseSplit": "case|otherwise|when|if|suppose that",
    "Claim": "claim|lemma|proposition",
    "Observation": "observe that|note that|we note",
    "Verification": "verify|check|it remains to show|it remains to verify",
    "Inequality/Algebra": "inequality|rearranging|algebraically|by am-gm|by cauchy",
}


def _roles_sql(roles: dict[str, str] = _ROLE_WORDS) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '(^|[^\\pL\\pN_])({words})([^\\pL\\pN_]|$)') THEN '{role}'" for role, words in roles.items()) + " END"


@query(f"SELECT doc_id, sentence, {_roles_sql()} AS role FROM (SELECT doc_id, unnest(range(len(s))) AS sentence, unnest(s) AS text FROM (SELECT doc_id, {Q.sentences_reference(_SOLUTION_SQL)} AS s FROM documents))")
def role_table(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", F.posexplode(T.sentence_split_reference(_solution())).alias("sentence", "text"))
    return rows.select("doc_id", _big(F.col("sentence")).alias("sentence"), P.tag_role(F.col("text")).alias("role"))


@query(f"SELECT doc_id, {_roles_sql({'Claim': 'that the|se', 'CaseSplit': 'of the|la'})} AS role FROM documents")
def role_hints(spark: SparkSession, d: str) -> DataFrame:
    hints = {"Claim": ["that the", "se"], "CaseSplit": ["of the", "la"]}
    return _t(spark, d, "documents").select("doc_id", P.tag_role(F.col("text"), hints).alias("role"))
