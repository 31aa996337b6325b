"""Operators on urls, vectors, conversations and pages."""

from __future__ import annotations

import hashlib
import random
import struct
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmark.llm import chat, queries, topk, urls, warc

SMALL = "/root/testdata/sf0.001"


# urls


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def plain_rule(host, path):
    best = None
    for rule, verdict in queries.URL_RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return best


ODD_URLS = [None, "", "no scheme", "http://", "https://A.Example.COM/en/7?x=/#y", "ftp://example.com#/en/", "x://net/de/", "x://notcom/en/1", "http://example.net/de/81", "http://a.example.net/de/9", "http://É.org/es/x", "a://b\nc/d\ne?f", "http://u:p@h.com:80/en/1://z", "http://example.com/EN/7"]


def plain_judge(rows, titles, least_odds=0.0):
    """Verdict and odds of every (id, url): counts over all title words, every split tried, multinomial Bayes by hand."""
    import collections
    import math
    import re

    lexicon = collections.Counter(w for t in titles for w in re.findall(r"[^\W\d_]+", (t or "").lower()))
    total = sum(lexicon.values())
    rare = math.log10(min(lexicon.values()) / total) if lexicon else 0.0
    memo = {}

    def split(name):
        if not name:
            return 0.0, ()
        if name not in memo:
            def piece(w):
                return math.log10(lexicon[w] / total) if w in lexicon else rare - len(w) - 1

            memo[name] = max(((split(name[:b])[0] + piece(name[b:])), b, (*split(name[:b])[1], name[b:])) for b in range(len(name)))[::2]
        return memo[name]

    def tokens(host, path):
        host, dot, last = host.rpartition(".")
        out = [f"h:{last}"] if dot else []
        for mark, part in (("h:", host if dot else last), ("p:", path.lower())):
            for name in re.findall("[a-z\u0080-\U0010ffff]+|[0-9]+", part):
                out += [f"{mark}#{len(name)}"] if name.isascii() and name.isdigit() else [mark + w for w in split(name)[1]]
        return out

    seen, urls_ = {"allow": collections.Counter(), "block": collections.Counter()}, collections.Counter()
    for _, u in rows:
        h, p = plain_host_path(u)
        if rule := plain_rule(h, p):
            seen[rule[1]].update(tokens(h, p))
            urls_[rule[1]] += 1
    kinds = len(seen["allow"].keys() | seen["block"].keys())
    out = {}
    for i, u in rows:
        h, p = plain_host_path(u)
        odds = math.log((urls_["block"] + 1) / (urls_["allow"] + 1))
        for t in tokens(h, p):
            odds += math.log((seen["block"][t] + 1) / (sum(seen["block"].values()) + kinds + 1)) - math.log((seen["allow"][t] + 1) / (sum(seen["allow"].values()) + kinds + 1))
        rule = plain_rule(h, p)
        out[i] = (h, p, rule and rule[0], rule[1] if rule else "block" if odds > 0 else "allow", tuple(tokens(h, p)), odds)
    return out


@pytest.mark.parametrize("most", [200_000, 0])
def test_urls_are_the_plain_ones(spark, most):
    """With the lexicon and the counts at hand, and with both joined."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("t"))
    more = [(10_000 + i, u, "Good food; foo bar") for i, u in enumerate(ODD_URLS)] + [(20_000, "http://goodfood.org/es/" + "foobarx" * 12, None), (20_001, "http://goodfood.org/es/x", None), (20_001, "http://goodfood.org/es/x", None)]
    pages = pages.unionByName(spark.createDataFrame(more, "page_id long, url string, t string"))
    words = urls.lexicon(F.col("t"), pages)
    got = urls.judge(pages, F.col("url"), ["page_id"], queries.URL_RULES, words, broadcast_words=most).collect()
    rows = [(r.page_id, r.url) for r in pages.collect()]
    want = plain_judge(rows, [r.t for r in pages.collect()])
    assert sorted(r.page_id for r in got) == sorted(i for i, _ in rows)
    for r in got:
        h, p, rule, verdict, words_, odds = want[r.page_id]
        assert (r.host, r.path, r.rule, tuple(r.tokens)) == (h, p, rule, words_)
        assert r.block_odds == pytest.approx(odds, abs=1e-9)
        assert r.verdict == verdict or abs(odds) < 1e-9
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"} or most == 0


def test_segmentation_is_the_best_split():
    rng = random.Random(1)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 3))): -rng.random() * 3 for _ in range(8)}
    unknown = min(words.values())
    seg = urls.Segmenter(words, unknown, sorted({len(w) for w in words}))

    def cost(w):
        return words.get(w, unknown - len(w) - 1)

    def best(name):
        return max((cost(name[:n]) + best(name[n:]) for n in range(1, len(name) + 1)), default=0.0)

    for _ in range(200):
        name = "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
        got = seg.split(name)
        assert "".join(got) == name
        assert sum(map(cost, got)) == pytest.approx(best(name))
    assert urls.Segmenter({"good": -1.0, "food": -1.0}, -1.0, [4]).split("goodfood") == ["good", "food"]
    long = urls.Segmenter({"pneumonoultramicroscopic": -2.0, "x": -5.0}, -5.0, [1, 24])
    assert long.split("xpneumonoultramicroscopic" + "q" * 5000) == ["x", "pneumonoultramicroscopic", "q" * 5000]


def test_urls_of_nothing(spark):
    none = spark.createDataFrame([], "page_id long, url string, host string")
    words = urls.lexicon(F.col("url"), none)
    assert (words.total, words.types) == (0, 0)
    for most in (10, 0):
        assert urls.judge(none, F.col("url"), none.columns, queries.URL_RULES, words, broadcast_words=most).count() == 0
        one = spark.createDataFrame([(None, None, "clash")], "page_id long, url string, host string")
        r = urls.judge(one, F.col("url"), one.columns, queries.URL_RULES, words, broadcast_words=most).first()
        assert (r.page_id, r.host, r.verdict) == (None, "", "allow")


# top k


def plain_top(rows, k):
    ok = [(i, np.floor(64 * np.asarray(v, float)).astype(np.int64)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for i, q in ok:
        if i % 20 == 0:
            s = sorted((-int(q @ v), j) for j, v in ok if j != i and len(v) == len(q))
            out[i] = [(j, -n) for n, j in s[:k]]
    return out


@pytest.mark.parametrize(("scale", "bucket", "strip"), [(1.0, 16, 2), (0.02, 64, 16), (1.0, 4096, 16)])
def test_top_k_is_brute_force(spark, scale, bucket, strip):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(260):
        v = rng.normal(size=8) * rng.choice([0.2, 1, 3])
        if i % 3 == 0:
            v = np.array([1.0, 2, 0, 0, 0, 0, 0, 1]) * 2 + rng.normal(size=8) * scale * 0.1
        if i % 7 == 0:
            v = np.ones(8)
        rows.append((i, [float(np.float32(x)) for x in v]))
    rows += [(300, None), (301, [1.0, None] * 4), (302, [float("nan")] * 8), (320, [float("inf")] * 8), (340, [1.0, 2.0]), (341, [2.0, 2.0]), (360, []), (None, [1.0] * 8), (380, [0.0] * 8), (400, [-1.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(frame, F.col("vec_id"), F.col("embedding"), F.col("vec_id") % 20 == 0, k=5, bucket_rows=bucket, query_rows=7, strip=strip, most_tasks=strip // 2).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    want = {q: v for q, v in plain_top(rows, 5).items() if v}
    assert found == want


def test_top_k_of_nothing(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(frame, F.col("vec_id"), F.col("embedding"), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_repeated_ids(spark):
    """Every row with a repeated id counts, but none with the query's own; a query row that occurs twice is answered twice."""
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id"), F.col("embedding"), F.col("vec_id") % 20 == 0, k=3, most_strips=1).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted([(20, 1, 1, 64 * 192), (20, 2, 1, 64 * 128), (20, 3, 1, 64 * 128)] * 2)


def test_coordinate_pruning_runs(monkeypatch):
    """Near copies of the queries set bounds that leave only coordinate pruning for what follows."""
    ran = []
    plain = np.argsort
    rng = np.random.default_rng(9)
    q = rng.integers(-60, 60, (4, 16))
    near = np.repeat(q, 12, axis=0)
    far = rng.normal(size=(300, 16))
    far[:40] = q[rng.integers(0, 4, 40)] + rng.normal(size=(40, 16)) * 15
    far = np.rint(far / np.linalg.norm(far, axis=1, keepdims=True) * 1.1 * np.linalg.norm(q, axis=1).max()).astype(np.int64)
    near, far = (x[np.argsort(-(x**2).sum(1), kind="stable")] for x in (near, far))
    best = topk.Best(4, 10)
    topk.search(best, np.arange(1000, 1004), q, topk.Bucket(np.arange(48), near))
    monkeypatch.setattr(topk.np, "argsort", lambda *a, **b: ran.append(1) or plain(*a, **b))
    topk.search(best, np.arange(1000, 1004), q, topk.Bucket(np.arange(48, 348), far))
    assert ran
    v = np.concatenate([near, far])
    for i in range(4):
        s = sorted((-int(v[j] @ q[i]), j) for j in range(len(v)))[:10]
        assert list(zip((-best.scores[i]).tolist(), best.ids[i].tolist(), strict=True)) == s


def test_pruning_loses_nothing():
    rng = np.random.default_rng(8)
    q = rng.integers(-60, 60, (5, 16))
    v = (q[rng.integers(0, 5, 400)] + rng.integers(-6, 6, (400, 16))) * rng.integers(1, 4, (400, 1))
    v = v[np.argsort(-(v**2).sum(1), kind="stable")]
    best = topk.Best(5, 10)
    for lo in range(0, 400, 50):
        topk.search(best, np.arange(1000, 1005), q, topk.Bucket(np.arange(lo, lo + 50), v[lo : lo + 50]))
    for i in range(5):
        s = sorted((-int(v[j] @ q[i]), j) for j in range(400))[:10]
        assert list(zip((-best.scores[i]).tolist(), best.ids[i].tolist(), strict=True)) == s


# chat


@pytest.fixture(scope="module")
def tok():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def plain_chat(rows):
    turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows)
    loss = "".join(r[3] or "" for r in rows if r[2] == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_round_trip(spark, tok):
    nasty = ["\\### Assistant: </turn> ok", "### User:", "\\\\</turn>\\</turn></turn>", "</turn", "<|endoftext|>", "", None, " \n", "é漢🙂", "x" * 50_000, "### Other: ### System:\\"]
    rows = [(c, t, r, nasty[(c + t) % len(nasty)]) for c in range(11) for t, r in enumerate(["system", "user", "assistant", "assistant", "tool </turn>", None])]
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (50, None, "assistant", "only")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(frame.repartition(5), *(F.col(c) for c in frame.columns), *tok)
    got = {r.conv_id: r for r in chat.digests(chats, *tok).collect()}
    for c in {r[0] for r in rows}:
        want = plain_chat(sorted([r for r in rows if r[0] == c], key=lambda r: -1 if r[1] is None else r[1]))
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == want and g.formatted_chars > g.loss_chars
    assert chat.format_chats(frame.limit(0), *(F.col(c) for c in frame.columns), *tok).count() == 0
    for r in chats.where("conv_id = 0").orderBy("place").collect():
        assert len(r.loss_mask) * 4 == len(r.ids)
    starts = chats.where("conv_id = 0").orderBy("place").collect()
    assert [r.start for r in starts] == np.concatenate([[0], np.cumsum([len(r.loss_mask) for r in starts])[:-1]]).tolist()


@pytest.mark.parametrize("text", ["", "\\", "</turn>", "\\</turn>", "\\\\### User:x</turn>", "### Users:", "a\\b### System:"])
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not chat._PLAIN.fullmatch(chat.escape(text)) or not text or chat.escape(text).startswith("\\")


def test_chat_query(spark):
    got = {r.conv_id: r for r in queries.op7_token_level_chat(spark, SMALL).collect()}
    rows = pd.read_parquet(f"{SMALL}/conversations.parquet").sort_values(["conv_id", "turn"])
    for c, g in rows.groupby("conv_id"):
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == plain_chat([tuple(x) for x in g[["conv_id", "turn", "role", "text"]].itertuples(index=False)])
    planted = "\\### Assistant: </turn> ok"
    assert got[-7].loss_sha256 == hashlib.sha256(planted.encode()).hexdigest() and len(got) == rows.conv_id.nunique() + 1


# archives


def test_archives(spark):
    same_ = "<p>" + "x" * 200
    rows = [(5, "http://a", same_), (3, "http://b", same_), (9, None, same_), (None, "u", same_), (4, "http://c\r\nX: y", "short"), (6, "", "short"), (7, "d", None), (8, "e", ""), (10, "f", "é" * 60), (10, "f", "é" * 60), (11, "g", "\r\n\r\nWARC/1.1\r\n\r\n" * 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for few in (10**6, 0):
        m = warc.write_archives(pages, F.col("page_id"), F.col("url"), F.encode("html", "UTF-8"), warc.archive_folder(pages), most_records=3, broadcast_digests=few)
        got = warc.read_archives(m, chunk_bytes=300).collect()
        assert m.count() >= 3 and len(got) == len(rows)
        by = sorted((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to) for r in got)
        assert by == [(-1, "revisit", 3), (3, "response", None), (4, "response", None), (5, "revisit", 3), (6, "response", None), (7, "response", None), (8, "response", None), (9, "revisit", 3), (10, "response", None), (10, "response", None), (11, "response", None)]
        for r in got:
            html = next(x[2] for x in rows if x[0] == r.page_id) or ""
            assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
            assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html.encode()
    none = warc.write_archives(pages.limit(0), F.col("page_id"), F.col("url"), F.encode("html", "UTF-8"), warc.archive_folder(pages))
    assert warc.read_archives(none).count() == 0


def test_archives_of_many_copies(spark, monkeypatch):
    """Sieves so small that they let much pass by chance, long payloads, repeated rows and rows without an id."""
    monkeypatch.setattr(warc, "_SIEVE_BITS", 9)
    rng = random.Random(6)
    rows = [(i, f"u{i}", f"{rng.randrange(400)} " + "y" * 120) for i in range(900)] + [(3000, "l", "z" * 3_000_000), (3001, "l", "z" * 3_000_000)] + [(None, "n", "alone" * 40), (None, "n", "alone" * 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h] = min(first.get(h, i), i)
    m = warc.write_archives(pages, F.col("page_id"), F.col("url"), F.encode("html", "UTF-8"), warc.archive_folder(pages), broadcast_digests=0)
    got = warc.read_archives(m).collect()
    html = {i: h for i, _, h in rows}
    assert len(got) == len(rows)
    for r in got:
        want = first.get(html[r.page_id])
        assert (r.record_type, r.refers_to) == (("response", None) if want in (None, r.page_id) else ("revisit", want))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload).decode() == html[r.page_id]


def test_archive_is_a_zip(tmp_path):
    w = warc.ArchiveWriter(f"file://{tmp_path}/a.zip")
    for i in range(5):
        w.add(str(i), f"http://{i}", warc.record(i, f"http://{i}", b"body", hashlib.sha256(b"body").hexdigest(), 4, None), "d")
    w.close()
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
    a = warc.Archive(f"file://{tmp_path}/a.zip")
    assert sorted(a.members) == sorted([warc.DATA, warc.INDEX]) and len(a.index()) == 5


def test_zip64_directory(tmp_path):
    """Sizes, offsets and counts of a small file written in their ZIP64 forms."""
    body, name = b"hello range", b"archive/data.warc.gz"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(body), len(body))
    prefix = b"junk" * 3
    extra = struct.pack("<HHH", 0x5455, 2, 7) + struct.pack("<HHQQQ", 1, 24, len(body), len(body), len(prefix))
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 3, 0, 0, 0, 0xFFFFFFFF) + name + extra + b"com"
    at = len(prefix) + len(local) + len(body)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 4) + b"note"
    (tmp_path / "b.zip").write_bytes(prefix + local + body + central + end64 + locator + end)
    a = warc.Archive(f"file://{tmp_path}/b.zip")
    m = a.members["archive/data.warc.gz"]
    assert a.range(a.begin(m.name), m.size) == body
    with pytest.raises(ValueError):
        (tmp_path / "c.zip").write_bytes(b"no zip at all")
        warc.Archive(f"file://{tmp_path}/c.zip")


def test_damaged_record():
    data = warc.record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), 3, None)
    assert warc.parse_record(data).payload == b"abc"
    with pytest.raises(ValueError):
        warc.parse_record(data.replace(b"abc", b"abd"))
