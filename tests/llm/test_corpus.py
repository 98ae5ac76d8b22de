"""The other corpus operators against brute force, round trips or held-out accuracy, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from teleskein.llm import bpe, exact_dedup, html_extract, jaccard_join, langid, mixing, registry, simhash, toxicity, url_filter

from ..oracle import check

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, _id string"
LONG = "lorem ipsum dolor sit amet " * 20000
EDGE = [
    (None, None, None, None, None, "x", "y"), (None, "a b c d", "en", "s", 7, None, None), (1, "", "en", "s", 0, "", ""), (2, "", "de", None, 0, "", ""), (3, "a b c d", "en", "s", 7, "", ""),
    (3, "a b c d", "en", "s", 7, "", ""), (4, LONG, "fr", "t", len(LONG), "", ""), (5, "!!! ...", "en", "t", 7, "", ""), (6, "a b c d", "es", "s", 7, "", ""), (7, "x y", "en", "t", 3, "", ""),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    check(registry.QUERIES[name](spark, sf_dir), registry.ORACLE_SQL[name], sf_dir)


def test_exact_dedup_edges(edge, nothing):
    got = exact_dedup.exact_duplicates(edge).collect()
    assert len(got) == len(EDGE)
    assert sorted(r["group_size"] for r in got) == [1, 1, 1, 1, 2, 2, 4, 4, 4, 4]
    kept = exact_dedup.drop_exact_duplicates(edge)
    assert kept.columns == edge.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.where("doc_id IS NOT NULL").select("doc_id", "text").collect()) == [(1, ""), (3, "a b c d"), (4, LONG), (5, "!!! ..."), (7, "x y")]
    assert exact_dedup.exact_duplicates(nothing).count() == exact_dedup.drop_exact_duplicates(nothing).count() == 0


def grams(text, n):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_jaccard_join_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    shared = " ".join(rng.choices(words, k=55))
    texts = []
    for _ in range(60):
        base = rng.choices(words, k=rng.randint(1, 60))
        for _ in range(rng.randint(1, 4)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w) + (" " + shared if rng.random() < 0.3 else ""))
    sets = [grams(t, 3) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j]) - 1e-9}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for leaf in (1024, 8, 2):
        assert {(r["doc_a"], r["doc_b"]) for r in jaccard_join.jaccard_join(df, leaf=leaf).collect()} == want
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        for i, j in want:
            root[i] = root[j] = min(root[i], root[j])
    for leaf in (1024, 8):
        groups = {r["doc_id"]: (r["keep_id"], r["n_links"]) for r in jaccard_join.near_groups(df, leaf=leaf).collect()}
        assert groups == {i: (root[i], sum(i in p for p in want)) for i in range(len(texts))}
    assert {r["doc_id"] for r in jaccard_join.drop_near_duplicates(df).collect()} == {i for i in range(len(texts)) if root[i] == i}


def test_regions_divide_on_the_cluster(spark):
    """Three kinds of text around one shared passage: one region, which its pivots divide; and copies of one text, which they can't."""
    rng = random.Random(8)
    words = [f"v{i}" for i in range(4000)]
    passage = rng.choices(words, k=40)
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=25)
        texts += [" ".join(passage + base[:k] + [rng.choice(words)] + base[k + 1 :]) for k in rng.sample(range(20), 6)]
    sets = [grams(t, 3) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(sets[i] & sets[j]) >= 0.9 * len(sets[i] | sets[j]) - 1e-9}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    chunks = jaccard_join._spark.table(jaccard_join.coded(jaccard_join._texts(df, "doc_id", "text"), 3))
    placed, stats = jaccard_join.regions(jaccard_join.reaching(chunks, 3, 0.6, 4)[1])
    assert stats.agg(F.max("n")).first()[0] > 16
    assert len(jaccard_join.leaves(placed, stats, 0.6, 10**6)) == 1
    assert len(jaccard_join.leaves(placed, stats, 0.9, 8)) > 2
    for leaf in (10**6, 16, 4):
        assert {(r["doc_a"], r["doc_b"]) for r in jaccard_join.jaccard_join(df, 0.9, leaf=leaf).collect()} == want


def test_grams_that_agree_in_32_bits_stay_apart():
    """Cells are whole 64-bit grams."""
    keys = np.array([5, 5 + (1 << 32), 5 + (1 << 40), 7], np.uint64)
    low = [np.zeros(0, np.int64)] * 2
    i, j, near = jaccard_join.leaf_pairs([keys[:3], keys], np.array([3.0, 4.0]), low, np.ones(2, bool), np.full(2, -1), 0.6)
    assert (list(i), list(j), list(near)) == ([0], [1], [0.75])
    number, first, times = jaccard_join._chunks.numbered(np.array([9, 3, 9, 0]))
    assert (list(number), list(first), list(times)) == ([2, 1, 2, 0], [3, 1, 0], [1, 1, 2])


def test_jaccard_edges(spark, edge, nothing):
    assert {(r["doc_a"], r["doc_b"]) for r in jaccard_join.jaccard_join(edge).collect()} == {(3, 6)}
    groups = [tuple(r) for r in jaccard_join.near_groups(edge).collect()]
    assert sorted(groups, key=str) == sorted([(None, None, 0), (None, None, 0), (1, 1, 0), (2, 2, 0), (3, 3, 2), (3, 3, 2), (6, 3, 2), (4, 4, 0), (5, 5, 0), (7, 7, 0)], key=str)
    kept = jaccard_join.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "5", "7", "None", "None"]
    assert jaccard_join.jaccard_join(nothing).count() == jaccard_join.drop_near_duplicates(nothing).count() == jaccard_join.near_groups(nothing).count() == 0
    odd = spark.createDataFrame([(5, "a b c d e f"), (1, "a b c d e f"), (5, "quite another text of its own"), (2, None), (3, ""), (4, "e f"), (6, "E F")], "`a``b` long, `t``x` string")
    kept = jaccard_join.drop_near_duplicates(odd, id_col="a`b", text_col="t`x").collect()
    assert sorted((r[0], r[1] or "") for r in kept) == [(1, "a b c d e f"), (2, ""), (3, ""), (4, "e f"), (5, "quite another text of its own")]


def test_bpe_equals_the_library_and_returns_the_bytes():
    tiktoken = pytest.importorskip("tiktoken")
    e = bpe.encoder()
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=e.vocabulary.rank, special_tokens={})
    rng = random.Random(5)
    texts = ["", " ", "Hello  world\n\n x", "naïve café ☃ 漢字", "<|endoftext|>", "a" * 300, "".join(chr(rng.choice([rng.randint(1, 0x2FF), 32, 32])) for _ in range(2000))]
    for t in texts:
        assert e.encode(t) == other.encode_ordinary(t)
        assert e.decode(e.encode(t)) == t.encode()


def test_bpe_appends_and_edits():
    v, rng = bpe.encoder().vocabulary, random.Random(6)
    for _ in range(20):
        text = bytes(rng.choices(b"the and ing abc   xyz", k=60))
        p = bpe.Prefixes(v, text[:30])
        p.append(text[30:])
        assert p.last == bpe.Prefixes(v, text).last
        a = rng.randint(0, 60)
        b = rng.randint(a, 60)
        p.replace(a, b, b"thing")
        assert p.last == bpe.Prefixes(v, text[:a] + b"thing" + text[b:]).last


def test_bpe_edges(edge, nothing):
    got = bpe.encode_documents(edge).collect()
    assert len(got) == len(EDGE)
    assert all(r["round_trip"] for r in got if r["n_bytes"] is not None)
    assert sum(r["tokens"] is None for r in got) == 1
    assert bpe.encode_documents(nothing).count() == 0


def test_mixing_keeps_totals(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), rng.choice("abbbbcc")) for i in range(3000)]
    found = mixing.cube_sample(mixing.units(spark.createDataFrame(rows, "doc_id long, text string, source string")), block=256).collect()
    assert len(found) == 3000
    for s in "abc":
        own = [r for r in found if r["_source"] == s]
        assert abs(sum(r["_p"] for r in own) - sum(r["_take"] for r in own)) <= 1 + 1e-6
        assert abs(sum(r["_p"] * r["_tokens"] for r in own) - sum(r["_tokens"] for r in own if r["_take"])) <= 80


def test_flight_is_unbiased():
    p, tokens = np.array([0.3, 0.5, 0.7, 0.2, 0.9, 0.4]), np.array([1, 5, 2, 9, 4, 4])
    mean = np.mean([mixing.land(p, tokens, np.random.default_rng(k)) for k in range(4000)], axis=0)
    assert np.allclose(mean, p, atol=0.03)


def test_mixing_edges(edge, nothing):
    kept = mixing.mix(edge, rate=1.0)
    assert kept.columns == edge.columns
    assert kept.where("n_chars > 0 AND text <> '!!! ...'").count() >= 5
    assert mixing.mix(nothing).count() == 0


def test_url_filter_equals_brute_force(spark):
    urls = ["http://user@WWW.Cheap-Pills.example.com:80/fr/1?x=1#f", "https://spam-farm.example.org", "http://1.2.3.4/a/b", "nonsense", "", None, "http://m.free-bets.example.com/en/27", "http://a.b.casino-win.example.org/x/y/z.html?q", "http://x/"]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)] + [(0, urls[0], "r")], "page_id long, url string, rule string")
    rules = spark.createDataFrame(url_filter.RULES, "rule string, action string")
    got = {r["page_id"]: (r["action"], r["rule"]) for r in url_filter.filter_urls(df, rules).collect()}
    known = dict(url_filter.RULES)

    def want(url):
        m = re.match(r"\s*[A-Za-z][\w+.\-]*://([^/?#\s]*)([^?#\s]*)(\?[^#\s]*)?", url or "")
        if not m or not m[1]:
            return "none", None
        host = re.sub(r":\d*$", "", re.sub(r"^.*@", "", m[1].lower())).strip(".")
        path = m[2] or "/"
        labels = host.split(".")
        hosts = [host] if re.fullmatch(r"\d+(\.\d+){3}", host) or len(labels) < 2 else [".".join(labels[i:]) for i in range(len(labels) - 1)]
        paths = {path, path + (m[3] or "")} | {path[: k + 1] for k, c in enumerate(path) if c == "/"}
        found = max(((len(h), len(p), known[h + p] == "allow", h + p) for h in hosts for p in paths if h + p in known), default=None)
        return (known[found[3]], found[3]) if found else ("none", None)

    assert got == {i: want(u) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0


def test_simhash_pairs_equal_brute_force(spark):
    rng = random.Random(8)
    prints = {rng.getrandbits(64) for _ in range(200)}
    for x in list(prints)[:60]:
        for k in (1, 2, 3, 4):
            y = x
            for b in rng.sample(range(64), k):
                y ^= 1 << b
            prints.add(y)
    prints = sorted(simhash._signed(x) for x in prints)
    want = {(a, b, bin((a ^ b) & (2**64 - 1)).count("1")) for i, a in enumerate(prints) for b in prints[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    df = spark.createDataFrame([(x,) for x in prints], "fingerprint long")
    assert {tuple(r) for r in simhash.near_fingerprints(df).collect()} == want


def test_simhash_edges(edge, nothing):
    pairs = {(r["doc_a"], r["doc_b"]): r["distance"] for r in simhash.near_documents(edge, radius=3).collect()}
    assert pairs == {(3, 6): 0}
    groups = [(r["doc_id"], r["keep_id"], r["n_links"]) for r in simhash.near_groups(edge, radius=3).collect()]
    assert sorted(groups, key=str) == sorted([(None, None, 0), (None, None, 0), (1, 1, 0), (2, 2, 0), (3, 3, 2), (3, 3, 2), (6, 3, 2), (4, 4, 0), (5, 5, 0), (7, 7, 0)], key=str)
    assert simhash.near_documents(nothing).count() == 0


def test_gru_gradient_and_edges(spark, edge, nothing):
    w = {k: v.astype(float) for k, v in langid.start_weights(3, 4).items()}
    rng = np.random.default_rng(2)
    chars, mask, label = rng.integers(0, 256, (7, 5)).astype(np.uint8), (rng.random((7, 5)) < 0.9).astype(float), rng.integers(0, 3, 5)
    _, grads = langid.loss_and_gradient(w, chars, mask, label)
    for k in w:
        at = np.unravel_index(np.argmax(np.abs(grads[k])), grads[k].shape)
        for sign in (1, -1):
            w[k][at] += sign * 1e-5
            loss = langid.loss_and_gradient(w, chars, mask, label)[0]
            w[k][at] -= sign * 1e-5
            up = loss if sign == 1 else up
        assert (up - loss) / 2e-5 == pytest.approx(grads[k][at], rel=1e-3, abs=1e-7)
    model = (["a", "b", "c"], {k: v.astype(np.float32) for k, v in w.items()})
    got = langid.identify(edge, model).collect()
    assert len(got) == len(EDGE)
    assert all(r["language"] is None and r["runs"] == [] for r in got if r["doc_id"] in (1, 2))
    assert langid.identify(nothing, model).count() == 0


def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.pmod(F.xxhash64("text"), F.lit(3)) == 0
    got = langid.identify(docs.where(held_out), langid.train(docs.where(~held_out)))
    both = got.join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars > 100")
    assert both.where("language = lang").count() / both.count() > 0.9


def test_html_rules():
    good = "the cat and the dog are in the house with all of the others and it is what they do when there is a lot of it " * 3
    page = f"<html><head><title>no</title></head><body><nav><a href=x>Home</a> <a href=y>About us</a></nav><h1>Title of it</h1><p>{good}</p><p>Short one.</p><p>{good}</p><script>var x='<p>no</p>'</script><!-- <p>no</p> --><footer>&copy; x</footer><p>tail"
    found = html_extract.read_page(page)
    assert [b["label"] for b in found] == ["bad", "good", "good", "good", "good", "bad", "bad"]
    texts = [b["text"] for b in found if b["label"] == "good"]
    assert "Short one." in texts and " ".join(good.split()) in texts
    assert "no" not in {b["text"] for b in found}


def test_second_pass():
    f = lambda *first: html_extract.second_pass(list(first), [10] * len(first), [False] * len(first))
    assert f("good", "short", "good") == ["good"] * 3
    assert f("bad", "short", "bad") == ["bad"] * 3
    assert f("good", "short", "bad") == ["good", "bad", "bad"]
    assert f("good", "near", "bad") == ["good", "good", "bad"]
    assert f("good", "short", "near", "bad") == ["good", "good", "good", "bad"]
    assert f("short") == ["bad"] and f() == []


def test_html_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (3, "<p <p <a <!-- x", "c"), (None, "<div>" * 30000 + "x", "d")], "page_id long, html string, text string")
    got = html_extract.extract(df).collect()
    assert len(got) == 5
    assert [r["text"] for r in got if r["page_id"] == 1] == [None]
    assert all(r["text"] == "" for r in got if r["page_id"] == 2)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_pipeline_equals_its_stages(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = {r["doc_id"] for r in toxicity.toxicity(docs, model).where("is_toxic").collect()}
    kept: dict = {}
    for i in sorted(set(rows) - bad):
        kept.setdefault(hashlib.sha256(rows[i].encode()).digest(), i)
    ids = sorted(kept.values())
    sets = {i: grams(rows[i], 3) for i in ids}
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    ids = [i for i in ids if root[i] == i]
    taken = {r["doc_id"] for r in mixing.mix(docs.where(F.col("doc_id").isin(ids))).collect()}
    got = {r["doc_id"]: r["tokens"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == taken
    assert all(bpe.encoder().decode(t).decode() == rows[i] for i, t in got.items())
