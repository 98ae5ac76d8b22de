"""The full Katz model, in which n-grams that occur once are seen, against the formulas."""

import math
import re
from collections import Counter

import pytest

from teleskein.llm import katz, registry

from .test_katz import TEXTS, _discounts


def full_model(texts, n):
    """(log probability of each document, discount of n-grams that occur once, by length)."""
    docs = {i: re.findall(r"\w+", t.lower()) if t else [] for i, t in texts.items()}
    counts = {m: Counter(tuple(w[i - m + 1 : i + 1]) for w in docs.values() for i in range(m - 1, len(w))) for m in range(1, n + 1)}
    d = {m: _discounts(counts[m], 1) for m in counts}
    followers: dict = {}
    for m in counts:
        for g in counts[m]:
            followers.setdefault(g[:-1], set()).add(g[-1])
    total = sum(counts[1].values())

    def p(history, word):  # of a word that is seen after the history
        m = len(history) + 1
        number = {w: counts[m][*history, w] for w in (followers[history] if history else [word])}
        kept = d[m](number[word]) * number[word]
        if not history:
            return kept / total
        times = sum(number.values())
        seen = sum(d[m](c) * c for c in number.values())
        if 1 - sum(p(history[1:], w) for w in number) <= 1e-12:
            return kept / seen
        return kept / (times if times - seen > 1e-12 * times else times + 1)

    return {i: sum(math.log(p(tuple(w[max(0, k - n + 1) : k]), w[k])) for k in range(len(w))) for i, w in docs.items()}, {m: d[m](1) for m in d}


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_full_model_equals_the_formulas(spark, monkeypatch, n):
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 12)
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").repartition(3)
    want, _ = full_model(TEXTS, n)
    got = {r["doc_id"]: r for r in katz.score(df, n, min_count=1).collect()}
    assert got.keys() == want.keys()
    for i, log in want.items():
        assert got[i]["log_prob"] == pytest.approx(log, abs=1e-5)
        assert got[i]["backed_off"] == 0


def test_registered_query_is_the_full_model(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 600").orderBy("doc_id").limit(60).select("doc_id", "text")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    want, once = full_model({r["doc_id"]: r["text"] for r in rows.collect()}, 3)
    assert 0 < once[2] < 1 and 0 < once[3] < 1
    got = {r["doc_id"]: r["log_prob"] for r in registry.QUERIES["op7_lm_scoring"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    for i, log in want.items():
        assert got[i] == pytest.approx(log, abs=1e-4)
