"""Operators that SQL can't express, against plain versions of the same formulas."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from teleskein.llm import _chunks, _text, exact_dedup, html_extract, langid, mixing, toxicity

from .test_corpus import EDGE, SCHEMA


# toxicity ---------------------------------------------------------------------------------------


def _labelled(texts, labels):
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(labels, pa.int32())], ["_text", "_y"])
    t = pa.Table.from_batches(list(toxicity._features([batch])))
    return t["y"].to_numpy(), [np.frombuffer(b.as_py(), np.int32) for b in t["words"]], [np.frombuffer(b.as_py(), np.int32) for b in t["sizes"]]


def _loss(weights, bias, y, feats, sizes):
    """Mean negative log-likelihood of the bags, sentence by sentence."""
    total = 0.0
    for label, words, size in zip(y, feats, sizes):
        clean, at = 1.0, 0
        for n in size:
            z = bias + sum(float(weights[w]) for w in words[at * toxicity._WIDTH : (at + n) * toxicity._WIDTH])
            clean *= 1 - 1 / (1 + math.exp(-z))
            at += n
        p = min(max(1 - clean, 1e-12), 1 - 1e-12)
        total -= math.log(p if label else 1 - p)
    return total / len(y)


def test_noisy_or_fit_equals_a_search():
    rng = random.Random(2)
    calm, bad = ["river", "stone", "cloud", "grass"], ["venom"]
    texts, labels = [], []
    for i in range(40):
        sentences = [" ".join(rng.choices(calm, k=3)) for _ in range(rng.randint(1, 4))]
        if i % 2:
            sentences[rng.randrange(len(sentences))] += " venom"
        texts.append(". ".join(sentences) + ".")
        labels.append(i % 2)
    y, feats, sizes = _labelled(texts, labels)
    weights, bias = toxicity.fit(y, feats, sizes, l1=0.0)
    fitted = _loss(weights, bias, y, feats, sizes)
    flat = np.zeros_like(weights)
    assert fitted < 0.05 < min(_loss(flat, b / 4, y, feats, sizes) for b in range(-20, 9))
    for w in (-0.5, 0.5):  # no step along a coordinate that is shared by all is much better
        assert fitted <= _loss(weights, bias + w, y, feats, sizes) + 0.02
    buf, offs = _text.string_column(pa.array(texts))
    p, count, doc, first, past, each = toxicity.score(buf, offs, weights, bias)
    assert list(p > 0.5) == [bool(x) for x in labels]
    for i, t in enumerate(texts):
        parts = [s for s in re.split(r"[.!?\n\r]", t) if s.strip()]
        assert count[i] == len(parts)
        assert p[i] == pytest.approx(1 - np.prod(1 - each[doc == i]), abs=1e-9)
        assert [bad[0] in s for s in parts] == list(each[doc == i] > 0.5)
    rare, _ = toxicity.fit(y, feats, sizes, min_documents=len(texts) + 1)
    assert not rare.any()


def test_contradicting_labels_count_as_toxic(spark):
    docs = spark.createDataFrame([(i, "good morning" if i % 2 else "you venom") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(40)] + [(i, 1) for i in range(0, 40, 2)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["is_toxic"] for r in toxicity.toxicity(docs, toxicity.train(docs, labels)).collect()}
    assert got == {i: i % 2 == 0 for i in range(40)}


# HTML extraction --------------------------------------------------------------------------------


def _second_pass(first, lengths, heading):
    """By looking at every neighbour anew."""
    n, known = len(first), list(first)
    for i in range(n):
        if heading[i] and first[i] == "short":
            away = 0
            for j in range(i + 1, n):
                if first[j] == "good":
                    if away <= html_extract.HEADING_REACH:
                        known[i] = "near"
                    break
                away += lengths[j]

    def decided(i, step):
        near, j = False, i + step
        while 0 <= j < n:
            if known[j] in ("good", "bad"):
                return known[j], near
            near |= known[j] == "near"
            j += step
        return "bad", near

    out = []
    for i in range(n):
        (a, near_a), (b, near_b) = decided(i, -1), decided(i, 1)
        if known[i] in ("good", "bad"):
            out.append(known[i])
        elif a == b:
            out.append(a)
        elif known[i] == "near":
            out.append("good")
        else:
            out.append("good" if (a == "bad" and near_a) or (b == "bad" and near_b) else "bad")
    return out


def test_second_pass_equals_brute_force():
    rng = random.Random(1)
    for _ in range(3000):
        n = rng.randint(0, 9)
        first = rng.choices(["good", "bad", "short", "near"], k=n)
        lengths, heading = [rng.choice([5, 60, 150, 400]) for _ in range(n)], [rng.random() < 0.3 for _ in range(n)]
        assert html_extract.second_pass(first, lengths, heading) == _second_pass(first, lengths, heading)


def test_unclosed_parts_hide_the_rest():
    assert [b[0] for b in html_extract.blocks("<p>one</p><script>var x = '<p>two</p>'")] == ["one"]
    assert [b[0] for b in html_extract.blocks("<p>one</p><!-- <p>two</p>")] == ["one"]
    assert [b[0] for b in html_extract.blocks("<p>one</p><style>a</style><p>two")] == ["one", "two"]


# language identification ------------------------------------------------------------------------


def test_positions_pool_and_runs_equal_brute_force(spark):
    w = {k: v.astype(np.float32) for k, v in langid.start_weights(3, 4, 7).items()}
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdé ß", k=k)) for k in (1, 5, 95, 96, 97, 300)] + ["", None]
    df = spark.createDataFrame([*enumerate(texts), (0, texts[2]), (None, texts[1])], "doc_id long, text string")
    names = ["x", "y", "z"]
    got = langid.identify(df, (names, w)).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = texts[1] if r["doc_id"] is None else None
        options = [t for t in ([text] if text else [texts[r["doc_id"]], *([texts[2]] if r["doc_id"] == 0 else [])])]
        if not options[0]:
            assert (r["language"], r["probability"], r["runs"]) == (None, None, [])
            continue
        fits = []
        for t in options:
            raw = np.frombuffer(t.encode(), np.uint8)
            p = np.zeros((len(raw), 3))
            for k in reversed(range(-(-len(raw) // langid.WINDOW))):  # where windows meet, the earlier counts
                a = max(0, min(k * langid.WINDOW, len(raw) - langid.WINDOW))
                chars = raw[a : a + langid.WINDOW][:, None]
                p[a : a + len(chars)] = langid.softmax(langid.logits(w, langid.forward(w, "f", chars, None)[0], langid.forward(w, "b", chars, None)[0]))[:, :, 0]
            mean, best = p.mean(0), p.argmax(1)
            want, at = [], 0
            while at < len(best):
                stop = at + 1
                while stop < len(best) and best[stop] == best[at]:
                    stop += 1
                want.append((at, stop, names[best[at]]))
                at = stop
            fits.append(r["language"] == names[mean.argmax()] and abs(r["probability"] - mean.max()) < 2e-4 and [tuple(x) for x in r["runs"]] == want)
        assert any(fits)


def test_no_language_gives_null(spark):
    docs = spark.createDataFrame([(1, "abc", None), (None, "abc", "en"), (2, "", "de")], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model == ([], {})
    assert {(r["language"], r["probability"]) for r in langid.identify(docs, model).collect()} == {(None, None)}
    one = langid.train(spark.createDataFrame([(1, "abc " * 90, "en"), (1, "abc " * 90, "en"), (2, "xyz " * 90, "de"), (3, "q", None)], "doc_id long, text string, lang string"), per_document=2)
    assert one[0] == ["de", "en"]


# mixing -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_flight_keeps_both_totals(seed):
    rng = np.random.default_rng(seed)
    p, tokens = rng.uniform(0, 1, 200), rng.integers(0, 50, 200)
    after = mixing.flight(p, tokens, rng)
    assert after.sum() == pytest.approx(p.sum(), abs=1e-6) and (after * tokens).sum() == pytest.approx((p * tokens).sum(), abs=1e-5)
    assert ((after > 0) & (after < 1)).sum() <= 2
    landed = mixing.land(p, tokens, rng)
    assert set(landed) <= {0.0, 1.0} and abs(landed.sum() - p.sum()) <= 1 + 1e-9
    assert abs((landed * tokens).sum() - (p * tokens).sum()) <= 2 * tokens.max()


def test_blocks_keep_totals_below_full_rate(spark, monkeypatch):
    rows = [(i, " ".join(["w"] * (i % 23)), "ab"[i % 3 == 0], None) for i in range(400)] + [(7, "w w", None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _tokens string")
    found = mixing.cube_sample(mixing.units(df), None, 0.4, 16).collect()
    by: dict = {}
    for r in found:
        s = by.setdefault(r["_source"], np.zeros(4))
        s += [r["_p"], r["_take"], r["_p"] * r["_tokens"], r["_take"] * r["_tokens"]]
    for source, (p, took, tokens, taken) in by.items():
        assert abs(took - p) <= 1 + 1e-6, source
        assert abs(taken - tokens) <= 2 * 23
    assert [r["_rows"] for r in found if r["_source"] is None] == [3]
    kept = mixing.mix(df, None, 0.4)
    assert kept.columns == df.columns
    assert kept.where("source IS NULL").count() in (0, 3)


# others -----------------------------------------------------------------------------------------


def test_numbers_of_codes_equal_unique():
    rng = np.random.default_rng(0)
    for high in (3, 1 << 20, 1 << 62):
        code = rng.integers(0, high, 500)
        number, first, times = _chunks.numbered(code)
        values, f, inverse, t = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        assert (number == inverse).all() and (first == f).all() and (times == t).all()
        keys = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        order, cut = _chunks.by_part(keys, 7)
        part = [(int(k) >> 32) * 7 >> 32 for k in keys[order]]
        assert part == sorted(part) and sorted(order) == list(range(300))
        assert all(set(part[cut[p] : cut[p + 1]]) <= {p} for p in range(7))
        assert (_chunks.unwrap_keys(_chunks.wrap_keys(keys[order])) == keys[order]).all()
        assert (_chunks.unwrap_small(_chunks.wrap_small(code)) == code).all()
        assert (_chunks.unwrap_ranks(_chunks.wrap_ranks(np.sort(code))) == np.sort(code)).all()


def test_column_names_with_backticks(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y")], "`i``d` long, `te``xt` string, `o``.ther` string")
    assert [tuple(r) for r in exact_dedup.drop_exact_duplicates(df, "i`d", "te`xt").collect()] == [(1, "a", "x")]


def test_pipeline_edges(spark, tmp_path):
    """Null, empty, repeated and long rows, and extra columns."""
    docs = spark.createDataFrame(EDGE, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (3, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} <= {None, 1, 3, 4, 5, 7}
    assert all(r["round_trip"] in (None, True) for r in rows)
    assert sum(r["doc_id"] == 3 for r in rows) <= 1
    docs.where(F.lit(False)).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
