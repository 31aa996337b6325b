"""Operators on documents against plain versions, with odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from oracle import same
from pyspark.sql import functions as F

from quillmark.llm import components, decontam, langid, neardup, packing, quality, queries, suffix

SMALL = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [(1, None), (2, ""), (3, " \n"), (None, "one two three four"), (None, None), (5, "one two three four"), (5, "one two three four"), (6, "Éa" * 200_000 + " end"), (7, "x"), (8, "12 !?")]


def odd(spark):
    """Null, empty, blank, repeated and very long texts, with extra columns whose names clash."""
    rows = [(i, t, "zz", 0.5, "k", 1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double, n_words string, component_id int")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SMALL)


# packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_packing_is_the_tokenizers(spark, tokenizer):
    path, tk = tokenizer
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text").where("doc_id IS NOT NULL AND doc_id <> 5").withColumn("doc_id", F.col("doc_id") + 10_000))
    got = packing.pack(docs, F.col("doc_id"), F.col("text"), path, max_length=64).toPandas()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert got.sequence_id.is_unique and (got.offset == 0).all()
    assert set(got.length) <= {1 << i for i in range(7)}
    for i, g in got.groupby("doc_id"):
        g = g.sort_values("start")
        ids = np.concatenate([np.frombuffer(x, "<u4") for x in g.ids])
        assert ids.tolist() == [*tk.encode(texts[i], add_special_tokens=False).ids, 2]
        assert g.start.tolist() == np.concatenate([[0], np.cumsum(g.length)[:-1]]).tolist()
        assert (g.doc_tokens == len(ids)).all() and (g.length == g.bucket).all()
        lengths = [x for x in g.length if x < 64]
        assert lengths == sorted(set(lengths), reverse=True)
    assert len(got.groupby("doc_id")) == len(texts)


def test_word_bpe_on_random_text(tokenizer):
    path, tk = tokenizer
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCÉéßñİΣσ漢字'’0123456789!?.,<|>\x1c\x85\u00a0\u0301 \n\t"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["<|endoftext|> x", "a<|startoftext|>b", "don't we're o'clock", "ΣΑΣ", "e\u0301 \u0301x"]
    ids, begin = packing.WordBpe(path).encode(texts, 2)
    for i, t in enumerate(texts):
        assert ids[begin[i] : begin[i + 1]].tolist() == [*tk.encode(t, add_special_tokens=False).ids, 2], t


def test_piece_lengths():
    assert packing.piece_lengths(1, 4) == [1] and packing.piece_lengths(15, 4) == [4, 4, 4, 2, 1] and packing.piece_lengths(8, 4) == [4, 4]


def test_packing_odd_rows(spark, tokenizer):
    got = packing.digest(packing.pack(odd(spark), F.col("doc_id"), F.col("text"), tokenizer[0]))
    assert got.where("doc_id IN (1, 2, 3)").select("length", "ids_crc32").distinct().collect() == [(1, zlib.crc32(np.array([2], "<u4").tobytes()))]
    assert packing.pack(odd(spark).limit(0), F.col("doc_id"), F.col("text"), tokenizer[0]).count() == 0


# language


def test_langid_held_out(spark):
    got = queries.op9_hyperdimensional_langid(spark, "/root/testdata/sf0.01").toPandas()
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    both = got.merge(docs, on="doc_id")
    held = both[both.held_out]
    assert len(held) > 200 and (held.lang == held.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all() and len(got) == len(docs)


def plain_vector(text, dims, seed):
    """The sum of a text's trigrams' bound and permuted letters."""
    spaced = re.sub(r"[^\W\d_]+", lambda m: m.group(), text or "")
    letters, gap = [0], True
    for ch in spaced:
        if ch.isalpha():
            letters.append(ord(ch.lower()[0]))
            gap = False
        elif not gap:
            letters.append(0)
            gap = True
    if not gap:
        letters.append(0)
    own = {x: langid.letter_vectors(np.array([x]), dims, seed)[0].astype(int) for x in set(letters)}
    out = np.zeros(dims, int)
    for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
        out += np.roll(own[a], 2) * np.roll(own[b], 1) * own[c]
    return out


def test_langid_is_the_bundle():
    texts = ["Ab, c!", "Ünïcödé wörter", "漢字かな 한국어", "\U0001f600 x \U00020000\U00020001", None, "12"]
    got = langid.bundles(texts, 256, 7)
    for t, v in zip(texts, got, strict=True):
        assert (v == plain_vector(t, 256, 7)).all(), t
    assert (got[4:] == 0).all()
    each = langid.letter_vectors(np.arange(97, 97 + 2000), 1024, 7).astype(int)
    cos = each @ each.T / 1024
    np.fill_diagonal(cos, 0)
    assert abs(cos).max() < 0.2  # every letter has a vector of its own


def test_langid_is_the_plain_one(spark):
    """Prototypes are sums over texts; the prediction is the greatest cosine, the first by name if equal."""
    docs = pd.read_parquet(f"{SMALL}/documents.parquet").head(60)
    docs.loc[docs.index[:3], "lang"] = ["el", "zh", "zz"]
    docs.loc[docs.index[:3], "text"] = ["αβγδ εζηθ ικλμ", "漢字文本 內容", "αβγδ εζηθ ικλμ"]
    frame = spark.createDataFrame(docs[["doc_id", "text", "lang"]]).repartition(3)
    profiles = langid.fit(frame, F.col("text"), F.col("lang"), dims=256)
    vectors = {i: plain_vector(t, 256, 7) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    sums = {n: sum(vectors[i] for i in g.doc_id) for n, g in docs.groupby("lang")}
    want = {n: v / np.linalg.norm(v) for n, v in sums.items()}
    assert sorted(profiles) == sorted(want) and all(np.allclose(profiles[n], want[n]) for n in want)
    for r in langid.identify(frame, F.col("text"), profiles, ["doc_id"], dims=256).collect():
        v = vectors[r.doc_id]
        cos = {n: v @ w / np.linalg.norm(v) for n, w in want.items()}
        best = max(cos.values())
        assert r.lang_pred == min(n for n in cos if cos[n] > best - 1e-9) and r.score == pytest.approx(max(best, 0), abs=1e-6)
    assert {r.lang_pred for r in langid.identify(frame.where("lang IN ('el', 'zh')"), F.col("text"), profiles, ["doc_id"], dims=256).collect()} == {"el", "zh"}


def test_langid_with_languages_beyond_the_bound(spark, monkeypatch):
    """Blocks of three languages, one after the other, are the same as all at once; ties go to the first name."""
    rng = random.Random(9)
    kinds = {f"l{i}": "".join(rng.sample("abcdefghijklmnopqrstuvwxyzäöü", 9)) for i in range(8)}
    texts = [(i, " ".join("".join(rng.choice(kinds[f"l{i % 8}"]) for _ in range(rng.randint(2, 7))) for _ in range(12)), f"l{i % 8}") for i in range(80)]
    texts += [(100 + i, t, n) for i, (_, t, _) in enumerate(texts[:8]) for n in ("l3", "m3")] + [(200, "", None), (201, None, None), (202, "12", None), (203, "жжж ж", None)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    out = []
    for most in (2_000, 3, 1):
        monkeypatch.setattr(langid, "MOST_LANGUAGES", most)
        profiles = langid.fit(frame, F.col("text"), F.col("lang"), dims=256)
        assert isinstance(profiles, dict) == (most > 9)
        out.append(sorted((r.doc_id, r.lang, r.lang_pred, round(r.score, 9)) if r.lang else (r.doc_id, "", r.lang_pred, round(r.score, 9)) for r in langid.identify(frame, F.col("text"), profiles, ["doc_id", "lang"], dims=256).collect()))
    assert out[0] == out[1] == out[2] and {r[2] for r in out[0]} > {"und", "l0", "l7"}


def test_langid_odd_rows(spark):
    docs = odd(spark)
    none = langid.identify(docs, F.col("text"), {}, docs.columns)
    assert none.count() == len(ODD) and [r.lang_pred for r in none.select("lang_pred").distinct().collect()] == ["und"]
    profiles = langid.fit(docs, F.col("text"), F.when(F.col("text").startswith("one"), "en").when(F.col("doc_id") == 6, "fr"))
    assert sorted(profiles) == ["en", "fr"]
    got = {(r.doc_id, r.text): r for r in langid.identify(docs, F.col("text"), profiles, docs.columns).collect()}
    assert got[6, ODD[7][1]].lang_pred == "fr" and got[5, ODD[5][1]].lang_pred == "en"
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in ((1, None), (2, ""), (3, " \n"), (8, "12 !?"), (None, None)))
    assert langid.fit(docs.limit(0), F.col("text"), F.col("lang_pred")) == {}


# quality


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op2_rule_ensemble_quality(spark, d).toPandas()
    both = got.merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.93
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all() and len(got) == 1000


def test_quality_rules_equal_expressions(spark):
    rng = np.random.default_rng(1)
    x = rng.random((500, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(int)
    model = quality.learn(x, y, quality.STATISTICS)
    rows = spark.createDataFrame(pd.DataFrame(x, columns=quality.STATISTICS))
    got = rows.select(model.logit({n: F.col(n) for n in quality.STATISTICS}).alias("z")).toPandas().z.to_numpy()
    want = np.full(500, model.intercept)
    for bounds, w in model.rules:
        hit = np.ones(500, bool)
        for n, above, v in bounds:
            col = x[:, quality.STATISTICS.index(n)]
            hit &= col > v if above else col <= v
        want += w * hit
    assert np.allclose(got, want) and ((got > 0) == y).mean() > 0.97
    assert 0 < len(model.rules) < 200 and any(len(b) > 1 for b, _ in model.rules)


def plain_statistics(text):
    t = text or ""
    words = [w for w in re.split("[ \\t-\\r]+", t) if w]
    lines = t.split("\n")
    share = lambda a, b: a / b if b else 0.0
    import unicodedata

    kind = [unicodedata.category(c) for c in t]
    plain = sum(k[0] in "LN" or c in " \t\n\x0b\f\r.," for c, k in zip(t, kind, strict=True))
    return [
        math.log1p(len(words)), share(len(t), len(words)), share(len(set(words)), len(words)), share(len(set(lines)), len(lines)), share(len(words), len(lines)),
        share(kind.count("Lu"), len(t)), share(sum(c in "0123456789" for c in t), len(t)), share(len(t) - plain, len(t)),
        share(t.count("."), len(words)), share(t.count(","), len(words)), share(t.count("|"), len(words)),
    ]


def test_quality_statistics_are_the_plain_ones(spark):
    texts = [None, "", " \n", "One two two.\nOne, TWO | 3%\n\nx", "É ß 漢字 _ a.b", "a\tb\x0bc\r\nd"] + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", *[c.cast("double").alias(n) for n, c in quality.statistics(F.col("t")).items()])
    for r in rows.collect():
        assert [r[n] for n in quality.STATISTICS] == pytest.approx(plain_statistics(texts[r.i]))


def test_quality_tree_takes_the_best_split():
    """Each path's last bound is the split of greatest gain, found here by trying all."""
    rng = np.random.default_rng(4)
    x = rng.random((120, 3))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 9)[1:-1])) for f in range(3)]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    g, h = rng.normal(size=120), rng.random(120) * 0.25
    paths, values = quality._tree(codes, edges, g, h, 2, 5)

    def gain(at, f, b):
        low = at & (codes[:, f] <= b)
        if low.sum() < 5 or (at & ~low).sum() < 5:
            return -1
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        return part(low) + part(at & ~low) - part(at)

    assert paths
    for path in paths:
        at = np.ones(120, bool)
        for f, above, b in path[:-1]:
            at &= (codes[:, f] > b) == above
        f, _, b = path[-1]
        assert gain(at, f, b) == pytest.approx(max(gain(at, k, c) for k in range(3) for c in range(len(edges[k]))))
    for path in (p for p in paths if len(p) == 2):
        leaf = np.ones(120, bool)
        for f, above, b in path:
            leaf &= (codes[:, f] > b) == above
        assert np.allclose(values[leaf], g[leaf].sum() / (h[leaf].sum() + 1))


def test_quality_lasso_is_optimal():
    """No weight can be moved for the better: the gradient balances the penalty exactly."""
    rng = np.random.default_rng(5)
    x = (rng.random((400, 12)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1.5 * x[:, 1] - 0.5)))).astype(float)
    b, w = quality._lasso(x, y, 0.02, rounds=4000)
    sd = np.maximum(x.std(axis=0), 1e-3)
    grad = (x / sd).T @ (1 / (1 + np.exp(-(x @ w + b))) - y) / 400
    assert (np.abs(grad) <= 0.02 + 1e-4).all() and 0 < (w != 0).sum() < 12
    assert np.allclose(grad[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-4) and abs((1 / (1 + np.exp(-(x @ w + b))) - y).mean()) < 1e-4


def test_quality_does_not_depend_on_order(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    fit = lambda a, b: quality.fit(a, F.col("doc_id"), F.col("text"), b, F.col("doc_id"), F.col("quality"), sample=300)
    one = fit(docs, labels)
    twice = docs.unionAll(docs.limit(5)).repartition(7), labels.orderBy(F.rand(3)).unionAll(labels.limit(9))
    other = fit(*twice)
    assert one.rules and one.intercept == other.intercept and one.rules == other.rules


def test_quality_odd_rows(spark):
    docs = odd(spark)
    model = quality.fit(docs, F.col("doc_id"), F.col("text"), docs.limit(0), F.col("doc_id"), F.col("component_id"))
    assert model.rules == [] and quality.classify(docs, F.col("text"), docs.columns, model).where("score BETWEEN 0 AND 1").count() == len(ODD)
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (7, None), (6, 3), (99, 1)], "id long, y int")
    assert quality.fit(docs, F.col("doc_id"), F.col("text"), labels, F.col("id"), F.col("y")).rules == []


# suffix tree


def plain_tree(texts: list[str], depth: int, floor: float, support: int, prior: float):
    """The same model from dictionaries of tuples of words."""
    words = [BLANK.findall(t.translate(LOW)) for t in texts]
    unigram = collections.Counter(w for ws in words for w in [*ws, None])
    n, v = sum(unigram.values()), len(unigram)
    least = max(support, floor * n)
    frequent = {w for w, c in unigram.items() if w is not None and c >= least}
    root = {w: (unigram[w] + 1) / (n + v + 1) for w in [*frequent, None]}
    root["?"] = 1 - sum(root.values())

    def symbols(ws):
        return ["^", *[w if w in frequent else "?" for w in ws], None]

    streams = [symbols(ws) for ws in words]
    kept, totals, tables, retained = None, None, {}, {}
    for d in range(1, depth + 1):
        runs = collections.Counter()
        for s in streams:
            for i in range(d, len(s)):
                context = tuple(s[i - d : i])
                if "?" not in context and (d == 1 or context in kept):
                    runs[(*context, s[i])] += 1
        runs = {k: c for k, c in runs.items() if c >= least}
        totals = {("^",): len(texts)} | {(w,): unigram[w] for w in frequent} if d == 1 else kept
        by = collections.defaultdict(dict)
        for k, c in runs.items():
            by[k[:-1]][k[-1]] = c

        def below(context, w):
            for m in range(len(context) - 1, 0, -1):
                if context[-m:] in retained:
                    return prob(context[-m:], w)
            return root[w]

        def prob(context, w):
            counts, total = tables[context]
            rest = total - sum(counts.values())
            return (counts.get(w, 0) + (rest + prior) * below(context, w)) / (total + prior)

        new = {}
        for context, counts in by.items():
            total = totals[context]
            q = {w: below(context, w) for w in counts}
            rest, rest_q = total - sum(counts.values()), max(1 - sum(q.values()), 1e-12)
            g = sum(c * math.log(c / (total * q[w])) for w, c in counts.items()) + (rest * math.log(rest / (total * rest_q)) if rest else 0)
            if 2 * g > len(counts) + 4 * math.sqrt(2 * len(counts)) + 8:
                new[context] = (counts, total)
        tables.update(new)
        retained.update(dict.fromkeys(new))
        kept = {k: c for k, c in runs.items() if k[-1] not in ("?", None)}

    def score(text):
        ws = BLANK.findall(text.translate(LOW))
        s, out = symbols(ws), 0.0
        for i, w in enumerate([*ws, None], start=1):
            p = None
            for m in range(min(depth, i), 0, -1):
                if tuple(s[i - m : i]) in retained:
                    p = prob(tuple(s[i - m : i]), s[i])
                    break
            p = root[s[i]] if p is None else p
            if s[i] == "?":
                p *= (unigram[w] + 1) / (n + v + 1) / root["?"]
            out += math.log10(p)
        return out

    base = lambda text: sum(math.log10((unigram[w] + 1) / (n + v + 1)) for w in [*BLANK.findall(text.translate(LOW)), None])
    known = lambda text: sum(unigram[w] > 0 for w in [*BLANK.findall(text.translate(LOW)), None])
    return score, base, known, n, len(retained)


@pytest.mark.parametrize(("depth", "floor"), [(1, 1e-4), (2, 1e-6), (3, 1e-4)])
def test_suffix_tree_is_the_plain_one(spark, depth, floor):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    train = docs.text[docs.doc_id % 3 != 0].tolist()
    score, base, known, n, states = plain_tree(train, depth, floor, 5, 2.0)
    frame = spark.createDataFrame(docs[["doc_id", "text"]])
    tree, table, buckets = suffix.fit(frame.where("doc_id % 3 <> 0"), F.col("text"), depth=depth, floor=floor)
    got = suffix.score(frame, F.col("text"), ["doc_id"], tree, table, buckets).toPandas().merge(docs, on="doc_id")
    assert tree.tokens == n and sum(int(x.retained.sum()) for x in tree.levels) == states > 5
    for r in got.itertuples():
        assert r.base_score == pytest.approx(base(r.text), rel=1e-9) and r.n_known == known(r.text)
        assert r.score == pytest.approx(score(r.text), rel=1e-7)


def test_suffix_tree_beats_unigrams(spark):
    got = queries.op3_suffix_tree_scoring(spark, "/root/testdata/sf0.01").toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and len(got) == 1000


def test_suffix_distribution_sums_to_one(spark):
    """Over all symbols, after every context."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    tree, _, _ = suffix.fit(docs, F.col("text"))
    symbols = np.concatenate([[suffix.RARE, suffix.END], np.arange(3, len(tree.counts))])
    for depth, level in enumerate(tree.levels, start=1):
        for context in np.flatnonzero(level.retained)[:40]:
            p = 10 ** suffix._log(tree, np.full(len(symbols), context), symbols, depth)
            assert p.sum() == pytest.approx(1, abs=1e-6)


def test_suffix_tree_keeps_what_occurs_often_enough_in_a_large_corpus(spark):
    """Eight occurrences in twelve million tokens make symbols and contexts all the same."""
    filler = spark.range(0, 1200, 1, 8).select(F.expr("repeat('the of ', 5000)").alias("text"))
    seldom = spark.createDataFrame([("zig zag zog",)] * 8, "text string")
    tree, table, buckets = suffix.fit(filler.unionAll(seldom), F.col("text"))
    assert tree.tokens > 12_000_000 and sorted(tree.counts[3:].tolist())[:3] == [8, 8, 8]
    assert 8 in tree.levels[0].counts and 8 in tree.levels[1].counts
    got = suffix.score(seldom.limit(1), F.col("text"), ["text"], tree, table, buckets).first()
    assert got.score > got.base_score + 10


def test_suffix_odd_rows(spark):
    docs = odd(spark)
    for train in (docs, docs.limit(0)):
        tree, table, buckets = suffix.fit(train, F.col("text"))
        got = suffix.score(docs, F.col("text"), docs.columns, tree, table, buckets).collect()
        assert len(got) == len(ODD) and all(r.score <= 0 and r.base_score <= 0 and math.isfinite(r.score) for r in got)
        assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert suffix.score(docs.limit(0), F.col("text"), ["doc_id"], tree, table, buckets).count() == 0


# near duplicates


def plain_groups(docs: list[tuple[int, str | None]], k: int, percent: int) -> dict[int, int]:
    sets = {}
    for i, t in docs:
        w = BLANK.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def chain(seed: int) -> list[tuple[int, str]]:
    """Groups whose texts drift away step by step, so that the first and last are no copies."""
    rng = random.Random(seed)
    out, n = [], 0
    for group in range(6):
        words = [f"w{rng.randrange(10_000)}" for _ in range(80)]
        for _ in range(rng.randint(1, 30)):
            out.append((n, " ".join(words)))
            n += 1
            words[rng.randrange(80)] = f"w{rng.randrange(10_000)}"
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("block", "ids", "links"), [(256, 10**6, 10**6), (4, 0, 3)])
def test_neardup_is_the_plain_one(spark, monkeypatch, block, ids, links):
    monkeypatch.setattr(neardup, "components", lambda e: components.components(e, one_task=links))
    docs = chain(1)
    want = plain_groups(docs, 3, 85)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = neardup.near_duplicates(frame, F.col("doc_id"), F.col("text"), 3, 85, block=block, broadcast_ids=ids).collect()
    assert {r.doc_id: r.component_id for r in got} == want and all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len(set(want.values())) < len(want)


def pages(seed: int, share: tuple[int, ...]) -> list[tuple[int, str]]:
    """Pages of one template with own words, in groups of near copies of different sizes."""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(60)]
    out = []
    for group in range(70):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice(share))]
        at = rng.randint(0, 60)
        for copy in range(rng.choice([1, 1, 1, 2, 5])):
            out.append((len(out), " ".join([*template[:at], *own, *template[at:], *["x"] * copy])))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("share", [(14,), (2, 4, 6, 8), (1, 5, 10, 20, 40)])
def test_neardup_of_templated_pages(spark, monkeypatch, share):
    monkeypatch.setattr(neardup, "PAIRS", 10**9)
    ran = []
    plain = neardup._by_shingles
    monkeypatch.setattr(neardup, "_by_shingles", lambda *a: ran.append(1) or plain(*a))
    monkeypatch.setattr(neardup, "HUB", 3)
    docs = pages(len(share), share)
    want = plain_groups(docs, 3, 85)
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id"), F.col("text"), 3, 85, block=8).collect()
    assert {r.doc_id: r.component_id for r in got} == want and ran
    assert 1 < len(set(want.values())) < len(want)


@pytest.mark.parametrize(("paragraphs", "dense", "pairs"), [(33, 256, 64), (33, 10**9, 0), (36, 1, 0)])
def test_neardup_of_pages_made_of_shared_paragraphs(spark, monkeypatch, paragraphs, dense, pairs):
    """No shingle is rare: the blocks of the area meet in strips, sets compared one by one or by matrices, in several columns."""
    ran = []
    plain = neardup._by_strips
    monkeypatch.setattr(neardup, "_by_strips", lambda *a: ran.append(1) or plain(*a))
    for name, value in (("HUB", 3), ("DENSE", dense), ("PAIRS", pairs), ("COLUMNS", 50), ("STRIP", (2, 3))):
        monkeypatch.setattr(neardup, name, value)
    rng = random.Random(paragraphs)
    pool = [" ".join(f"p{i}w{j}" for j in range(7)) for i in range(40)]
    docs = [(i, " ".join(pool[j] for j in sorted(rng.sample(range(40), paragraphs)))) for i in range(260)]
    want = plain_groups(docs, 3, 85)
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id"), F.col("text"), 3, 85, block=16).collect()
    assert {r.doc_id: r.component_id for r in got} == want and ran
    assert 1 < len(set(want.values())) < len(want)


def test_shared_values_by_matrices(monkeypatch):
    monkeypatch.setattr(neardup, "COLUMNS", 7)
    rng = np.random.default_rng(4)
    left, right = ([np.unique(rng.integers(0, 60, rng.integers(1, 40), dtype=np.uint64)) for _ in range(n)] for n in (9, 5))
    assert neardup.shared(left, right).tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert neardup.shared(left, [np.array([99], np.uint64)]).tolist() == [[0]] * 9


def test_neardup_odd_rows(spark):
    got = neardup.near_duplicates(odd(spark), F.col("doc_id"), F.col("text")).collect()
    assert len(got) == len(ODD)
    alone = {r.doc_id: r for r in got if r.doc_id in (1, 2, 3)}
    assert all(r.kept and r.component_id == i and r.n_shingles == 0 for i, r in alone.items())
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert [r.component_id for r in got if r.doc_id == 5] == [5, 5]
    assert neardup.near_duplicates(odd(spark).limit(0), F.col("doc_id"), F.col("text")).count() == 0


def test_bbit_estimate():
    h = neardup.MinHash()
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**63, 2000, dtype=np.uint64))
    for share in (0.2, 0.6, 0.9):
        n = int(len(base) * 2 * share / (1 + share))
        other = np.unique(np.concatenate([base[:n], rng.integers(0, 2**63, len(base) - n, dtype=np.uint64)]))
        m = h.minima(np.concatenate([base, other]), np.array([0, len(base), len(base) + len(other)]))
        s = h.signatures(m)
        true = n / (2 * len(base) - n)
        assert abs(h.estimate(s[:1], s[1:])[0, 0] - true) < 0.13
    assert h.floor(0.85) < 0.7


def test_components_both_ways(spark):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, 100)]
    up = {x: x for e in links for x in e}
    for _ in range(60):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    want = {x: c for x, c in up.items() if x != 100}
    for limit in (10**6, 2):
        got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long"), limit).collect()}
        assert {x: c for x, c in want.items() if x in got} == got and all(want[x] == x for x in set(want) - set(got))


# decontamination


def plain_hits(docs, items, window=10):
    grams = collections.defaultdict(set)
    for item, t in items:
        w = ALNUM.findall((t or "").translate(LOW)) if item is not None else []
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[i : i + n])].add(str(item))
    out = []
    for t in docs:
        w = ALNUM.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit.update(range(i, i + n))
                    found |= grams[g]
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("most", [10**6, 0])
def test_decontamination_is_the_plain_one(spark, most):
    rng = random.Random(6)
    word = lambda: f"v{rng.randrange(40)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(20)] + [(20, None), (21, ""), (None, "v1 v2"), (22, "v3, V4;v5")]
    texts = [" ".join(word() for _ in range(rng.randrange(40))) for _ in range(60)]
    texts += [f"{texts[i]} {items[i % 20][1].upper()} {texts[i + 1]}" for i in range(40)] + [None, "", "v3-v4-v5"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.scan(docs, F.col("text"), bench, F.col("item_id"), F.col("text"), ["doc_id"], broadcast_windows=most).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in got] == plain_hits(texts, items)
    assert any(r.n_hit for r in got)


def test_winnowing_guarantee():
    """Every shared span of ten words shares a fingerprint, wherever it stands."""
    from quillmark.llm import kernels as K

    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 2**62, 60, dtype=np.uint64), rng.integers(0, 2**62, 60, dtype=np.uint64)
        i, j = rng.integers(0, 50, 2)
        b[j : j + 10] = a[i : i + 10]
        x, y = (set(decontam.winnow(K.ngrams(w, 5), 6).tolist()) for w in (a, b))
        assert x & y


def test_decontamination_odd_rows(spark):
    docs = odd(spark)
    bench = spark.createDataFrame([(1, "three four")], "item_id long, text string")
    for most in (10**6, 0):
        got = decontam.scan(docs, F.col("text"), bench, F.col("item_id"), F.col("text"), docs.columns, broadcast_windows=most).collect()
        assert len(got) == len(ODD) and sorted(r.n_hit for r in got) == [0] * 7 + [2] * 3
        assert decontam.scan(docs, F.col("text"), bench.limit(0), F.col("item_id"), F.col("text"), ["doc_id"], broadcast_windows=most).where("n_hit > 0").count() == 0


def test_digest_of_nothing(spark):
    got = queries.op10_winnowing_decontamination(spark, SMALL).where("n_items = 0").first()
    assert got.items_sha256 == hashlib.sha256(b"").hexdigest()
