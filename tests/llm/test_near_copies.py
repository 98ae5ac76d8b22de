"""op10_fingerprints against true near copies."""

import random
from itertools import combinations

import numpy as np
import pytest

from teleskein.llm import registry, simhash

from .test_corpus import grams


@pytest.mark.parametrize("radius", [0, 5, 10])
def test_search_is_exact_at_any_radius(spark, monkeypatch, radius):
    monkeypatch.setattr(simhash, "PAIRS", 50)
    rng = random.Random(radius)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for x in list(prints)[:70]:
        for k in (1, radius, radius + 1):
            y = x
            for b in rng.sample(range(64), k):
                y ^= 1 << b
            prints.add(y)
    prints = np.array(sorted(simhash._signed(x) for x in prints))
    apart = np.bitwise_count(prints[:, None].view(np.uint64) ^ prints.view(np.uint64))
    want = {(int(prints[i]), int(prints[j]), int(apart[i, j])) for i, j in zip(*np.nonzero(apart <= radius)) if i < j}
    df = spark.createDataFrame([(int(x),) for x in prints], "fingerprint long")
    got = [tuple(r) for r in simhash.near_fingerprints(df, radius).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_most_near_copies_are_found_and_few_others(spark, tmp_path):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(4000)]
    texts = []
    for _ in range(150):
        base = rng.choices(words, k=120)
        copy = [w if rng.random() > 0.06 else rng.choice(words) for w in base]
        texts += [" ".join(base), " ".join(copy)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    sets = [grams(t, 3) for t in texts]
    jaccard = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in combinations(range(len(texts)), 2)}
    near = {p for p, x in jaccard.items() if x >= 0.6}
    got = {(r["doc_a"], r["doc_b"]) for r in simhash.near_documents(df).collect()}
    assert len(near) > 80
    assert len(near & got) >= 0.8 * len(near)
    assert sum(jaccard[p] < 0.2 for p in got) <= 0.02 * len(got)
    rows = {r["doc_id"]: r for r in registry.QUERIES["op10_fingerprints"](spark, str(tmp_path)).collect()}
    assert {i: r["n_links"] for i, r in rows.items()} == {i: sum(i in p for p in got) for i in range(len(texts))}
    root = list(range(len(texts)))
    for _ in range(8):
        for i, j in got:
            root[i] = root[j] = min(root[i], root[j])
    assert {i: r["keep_id"] for i, r in rows.items()} == dict(enumerate(root))


def test_fingerprint_equals_brute_force():
    """Weighted votes, word by word."""
    texts = ["the cat sat on the mat", "the", "Éa éA b_1 ünï zzz zzz zzz", "", "q " * 70000 + "end"]
    from teleskein.llm import _text

    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    counts = np.zeros(1 << simhash.TABLE_BITS, np.int64)
    bucket = lambda w: _text.word_hash(w) >> (64 - simhash.TABLE_BITS)
    for t in texts:
        for w in t.split():
            counts[bucket(w)] += 1
    for floor in (0.0, 9.0):
        weights = simhash.word_weights(counts, floor)
        prints, have = simhash.fingerprint(buf, offs, weights)
        assert list(have) == [True, True, True, False, True]
        for t, got in zip(texts[:3], prints):
            w = [(float(weights[bucket(x)]), int(_text.mix64(np.array([_text.word_hash(x)], np.uint64))[0])) for x in t.split()]
            flat = not any(x for x, _ in w)
            bytes_ = [[(h >> 8 * b) & 255 for b in range(8)] for _, h in w]
            votes = [sum((1 if flat else x) * (1 if bits[k // 8] >> (7 - k % 8) & 1 else -1) for (x, _), bits in zip(w, bytes_)) for k in range(64)]
            want = np.packbits(np.array(votes) > 1e-6).view(np.uint64)[0]
            close = sum(abs(v) < 1e-4 for v in votes)
            assert np.bitwise_count(got ^ want) <= close
