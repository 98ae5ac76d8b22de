import math
import re
from collections import Counter

import pytest

from teleskein.llm import katz

TEXTS = {
    1: "the cat sat on the mat and the cat ran",
    2: "the cat sat on the hat. The dog sat on the mat",
    3: "",
    4: None,
    5: "dog",
    6: "the dog ran and the cat sat on the dog",
    7: "the cat sat on the mat and the cat ran",
    8: "a b a b a b a c a b a d a b",
    9: "!!! ... ???",
    10: "on the mat the cat sat and the dog ran on the hat",
}


UNKNOWN = "<unknown>"


def _discounts(counts, least):
    n = Counter(counts.values())
    d = {}
    k = katz.K
    for r in range(1, k + 1):
        x = None
        if n[r] and n[1] and (cut := (k + 1) * n[k + 1] / n[1]) != 1:
            x = ((r + 1) * n[r + 1] / n[r] / r - cut) / (1 - cut)
        d[r] = x if x is not None and 0 < x <= 1 else 1.0
    return lambda r: 0.0 if r < least else d.get(r, 1.0)


def brute_force(texts, n):
    """A model by the formulas, word by word; (probability of each token by document, p)."""
    docs = {i: re.findall(r"\w+", t.lower()) if t else [] for i, t in texts.items()}
    counts = {m: Counter(tuple(w[i - m + 1 : i + 1]) for w in docs.values() for i in range(m - 1, len(w))) for m in range(1, n + 1)}
    d = {m: _discounts(counts[m], 1 if m == 1 else 2) for m in counts}
    vocabulary = [g[0] for g in counts[1]]
    total = sum(counts[1].values())
    memory = {}

    def p(history, word):
        m = len(history) + 1
        if m == 1:
            if word == UNKNOWN:
                return 1 - sum(d[1](c) * c for c in counts[1].values()) / total
            c = counts[1][word,]
            return d[1](c) * c / total
        if (history, word) in memory:
            return memory[history, word]
        seen = {g[-1]: d[m](c) * c for g, c in counts[m].items() if g[:-1] == history and c >= 2}
        followed = sum(c for g, c in counts[m].items() if g[:-1] == history)
        lower = sum(p(history[1:], w) for w in seen)
        if 1 - lower <= 1e-12 and seen:
            denominator, alpha = sum(seen.values()), 0.0
        else:
            denominator = followed if followed - sum(seen.values()) > 1e-12 * followed else followed + 1.0
            alpha = (1 - sum(seen.values()) / denominator) / (1 - lower) if followed else 1.0
        for w in [*vocabulary, UNKNOWN]:
            memory[history, w] = seen[w] / denominator if w in seen else alpha * p(history[1:], w)
        return memory[history, word]

    return {i: [p(tuple(w[max(0, k - n + 1) : k]), w[k]) for k in range(len(w))] for i, w in docs.items()}, p, vocabulary, counts


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_scores_equal_the_formulas(spark, monkeypatch, n):
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 12)
    df = spark.createDataFrame([(i, t, "x") for i, t in TEXTS.items()], "doc_id long, text string, n_tokens string").repartition(3)
    got = {r["doc_id"]: r for r in katz.score(df, n, min_count=2).collect()}
    want, _, _, counts = brute_force(TEXTS, n)
    assert got.keys() == TEXTS.keys()
    for i, ps in want.items():
        assert got[i]["n_tokens"] == len(ps)
        assert got[i]["log_prob"] == pytest.approx(sum(map(math.log, ps)), abs=1e-5)
        if ps:
            assert got[i]["perplexity"] == pytest.approx(math.exp(-sum(map(math.log, ps)) / len(ps)), rel=1e-5)
        else:
            assert got[i]["perplexity"] is None


def test_probabilities_of_the_formulas_sum_to_one():
    _, p, vocabulary, _ = brute_force(TEXTS, 3)
    for history in [("the",), ("on", "the"), ("a", "b"), ("dog",), ("b", "a")]:
        assert sum(p(history, w) for w in [*vocabulary, UNKNOWN]) == pytest.approx(1, abs=1e-9)


def test_whole_table_equals_the_formulas(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect() if len(r["text"]) < 600}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_force(texts, 3)[0]
    got = {r["doc_id"]: r["log_prob"] for r in katz.score(df, 3, min_count=2).collect()}
    for i, ps in want.items():
        assert got[i] == pytest.approx(sum(map(math.log, ps)), abs=1e-4)


def test_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert katz.score(spark.createDataFrame([], schema)).collect() == []
    rows = katz.score(spark.createDataFrame([(None, "a b c a b c"), (1, "a b c a b c"), (1, "a b c a b c"), (2, None)], schema)).collect()
    assert len(rows) == 4
    assert len({r["log_prob"] for r in rows if r["doc_id"] != 2}) == 1
