import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from teleskein.llm import toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    words, bad = [f"word{i}" for i in range(200)], [f"vile{i}" for i in range(12)]
    rows = []
    for i in range(n):
        sentences = [[rng.choice(words) for _ in range(8)] for _ in range(rng.randint(1, 12))]
        toxic = rng.random() < 0.4
        if toxic:
            sentences[rng.randrange(len(sentences))][2:5] = rng.sample(bad, 3)
        rows.append((i, ". ".join(" ".join(s) for s in sentences) + ".", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.createDataFrame(corpus(500, 1), "doc_id long, text string, toxic int")
    return toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))


def test_held_out_accuracy_and_places(spark, fitted):
    rows = corpus(300, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, fitted).collect()}
    assert sum(got[i]["is_toxic"] == bool(y) for i, _, y in rows) / len(rows) > 0.95
    for i, text, y in rows:
        if y and got[i]["is_toxic"]:
            assert any("vile" in text[s["start"] : s["stop"]] for s in got[i]["offending"])
            break


def test_noisy_or(fitted):
    raw = b"vile1 vile2 vile3 here. word1 word2. word3"
    buf, offs = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    p, n, _, _, _, each = toxicity.score(buf, offs, *fitted)
    assert n[0] == 3
    assert p[0] == pytest.approx(1 - np.prod(1 - each))


def test_blocks_do_not_change_the_fit(monkeypatch):
    rng = np.random.default_rng(0)
    feats = [rng.integers(0, 50, (9, toxicity._WIDTH)).astype(np.int32).ravel() for _ in range(40)]
    sizes = [np.array([4, 5], np.int32)] * 40
    y = np.arange(40) % 2
    whole = toxicity.fit(y, feats, sizes, rounds=5)
    monkeypatch.setattr(toxicity, "BLOCK", 30)
    parts = toxicity.fit(y, feats, sizes, rounds=5)
    assert np.allclose(whole[0], parts[0], atol=1e-5) and whole[1] == pytest.approx(parts[1])


def test_edge_cases(spark, fitted):
    schema = "doc_id long, text string, _text string, _id string"
    rows = [(None, None, "a", "b"), (1, "", "a", "b"), (1, "", "a", "b"), (2, "!!!", None, None), (3, "vile1 vile2 vile3. " * 5000, "", "")]
    df = spark.createDataFrame(rows, schema)
    got = toxicity.toxicity(df, fitted).collect()
    assert len(got) == 5
    assert all(r["toxic_prob"] == 0 and r["n_sentences"] == 0 and r["offending"] == [] for r in got if r["doc_id"] != 3)
    kept = toxicity.drop_toxic(df, fitted)
    assert kept.columns == df.columns and kept.count() == 4
    assert toxicity.toxicity(spark.createDataFrame([], schema), fitted).count() == 0
    nothing = toxicity.train(df, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert toxicity.toxicity(df, nothing).agg(F.max("toxic_prob")).first()[0] == pytest.approx(0, abs=1e-6)
