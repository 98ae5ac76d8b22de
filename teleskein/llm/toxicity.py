"""Toxicity by multiple-instance learning: sentences are instances, documents are labelled bags.

A sentence's probability is logistic in its words' weights; a document's is the noisy-or of its
sentences', p = 1 - prod(1 - p_s). Weights are fitted to document labels alone, by full-batch Adam
with proximal L1; the fitted sentence scores then locate the offending sentences.

Defined results: a null, empty or word-free text has no sentences, probability 0 and is kept; ids
may be null or repeat (each row is scored by itself); an empty table gives an empty result; with
no toxic or no clean label there is nothing to learn and every probability is 0; an id whose labels
contradict each other counts as toxic. A sentence ends
at ``.``, ``!``, ``?`` or a line break and holds at least one word. Offsets count characters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark, _text

BUCKETS = 1 << 18
#: Beginnings of a word, in bytes, that are features beside the word: inflected forms share them.
STEMS = (4, 5)
_WIDTH = 1 + len(STEMS)
#: At most so many labelled documents of each class are learned from, chosen by hash of their id.
TRAIN_PER_CLASS = 4000
#: What occurs in fewer training documents can't be told from chance; 1 leaves out nothing.
MIN_DOCUMENTS = 1
#: Features that a step of the fit looks at together.
BLOCK = 1 << 20
THRESHOLD = 0.5
OUT = "toxic_prob double, is_toxic boolean, n_sentences bigint, offending array<struct<sentence:int,start:int,stop:int,score:double>>"

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n\r"]] = True


def sentences(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(features of each word: itself and its stems, first word of each sentence, its document, its first and past-last byte)."""
    start, end, hashes, pointer = _text.words(buf, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(pointer))
    part = np.searchsorted(np.flatnonzero(_ENDS[buf]), start)
    new = np.ones(len(start), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(start)) - 1 if len(head) else head
    low = _text._fold(buf)
    feats = np.empty((len(start), 1 + len(STEMS)), np.int32)
    feats[:, 0] = hashes >> np.uint64(46)
    value = np.zeros(len(start), np.uint64)
    at = 1
    for k in range(max(STEMS)):
        value = value * np.uint64(257) + np.where(start + k < end, low[np.minimum(start + k, len(low) - 1)], 0)
        if k + 1 in STEMS:
            feats[:, at] = np.where(end - start > k + 1, _text.mix64(value + np.uint64(k << 56)) >> np.uint64(46), feats[:, 0])
            at += 1
    return feats, head, doc[head], start[head], end[last]


def _features(batches):
    """(y, blob of features, blob of sentence lengths) of each labelled document."""
    for batch in _text.slices(batches, "_text"):
        feats, head, doc, _, _ = sentences(*_text.string_column(batch.column("_text")))
        sizes = np.diff(np.append(head, len(feats)))
        n = batch.num_rows
        s_at = np.searchsorted(doc, np.arange(n + 1))
        w_at = np.append(head, len(feats))[s_at]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_y"), pa.array([feats[w_at[i] : w_at[i + 1]].tobytes() for i in range(n)], pa.binary()), pa.array([sizes[s_at[i] : s_at[i + 1]].astype(np.int32).tobytes() for i in range(n)], pa.binary())],
            ["y", "words", "sizes"],
        )


def fit(y: np.ndarray, feats: list[np.ndarray], sizes: list[np.ndarray], class_weight: tuple[float, float] = (1.0, 1.0), min_documents: int = MIN_DOCUMENTS, rounds: int = 120, rate: float = 0.15, l1: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias). A feature that fewer than min_documents of the training documents hold has no weight."""
    weights = np.zeros(BUCKETS, np.float32)
    use = [i for i in range(len(y)) if len(sizes[i])]
    if not use or y[use].min() == y[use].max():
        return weights, -30.0
    y = y[use].astype(float)
    per_doc = np.array([len(sizes[i]) for i in use])
    held_by = np.zeros(BUCKETS, np.int64)
    for i in use:
        held_by[np.unique(feats[i])] += 1
    common = np.flatnonzero(held_by >= max(min_documents, 1))
    index = np.full(BUCKETS, -1, np.int32)
    index[common] = np.arange(len(common))
    blocks, some, begin, held = [], [], 0, 0  # (first sentence, number of sentences, features, their sentences counted from the first)
    for k, i in enumerate(use):
        some.append(i)
        held += len(feats[i])
        if held < BLOCK and k + 1 < len(use):
            continue
        word = index[np.concatenate([feats[j] for j in some])]
        size = np.concatenate([sizes[j] for j in some]) * _WIDTH
        sentence = np.repeat(np.arange(len(size), dtype=np.int32), size)
        known = word >= 0
        blocks.append((begin, len(size), word[known], sentence[known]))
        begin, some, held = begin + len(size), [], 0
    sentence_doc = np.repeat(np.arange(len(use)), per_doc)
    cost = np.where(y > 0, class_weight[1], class_weight[0])
    cost /= cost.sum()
    theta = np.zeros(len(common) + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    z = np.empty(begin)
    for t in range(1, rounds + 1):
        for at, n, word, sentence in blocks:
            z[at : at + n] = np.bincount(sentence, theta[:-1][word], n) + theta[-1]
        total = np.bincount(sentence_doc, np.logaddexp(0, z), len(use))
        grad_doc = cost * np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0)
        g_z = grad_doc[sentence_doc] * np.exp(-np.logaddexp(0, -z))
        grad = np.append(sum(np.bincount(word, g_z[at : at + n][sentence], len(common)) for at, n, word, sentence in blocks), g_z.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        step = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        theta -= step * m / (1 - 0.9**t)
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(0, np.abs(theta[:-1]) - step[:-1] * l1)
    weights[common] = theta[:-1]
    return weights, float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = TRAIN_PER_CLASS, min_documents: int = MIN_DOCUMENTS) -> tuple[np.ndarray, float]:
    """Fit on at most ``per_class`` labelled documents of each class; the classes' true shares weight them."""
    said = labels.select(_spark.column(id_col).alias("_id"), _spark.column(label_col).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IN (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y"))
    shares = {r["_y"]: r["count"] for r in said.groupBy("_y").count().collect()}
    if len(shares) < 2:
        return np.zeros(BUCKETS, np.float32), -30.0
    order = F.xxhash64(F.col("_id"), F.lit(17))
    chosen = [said.where(F.col("_y") == k).orderBy(order, "_id").limit(per_class) for k in (0, 1)]
    ids = F.broadcast(_spark.pin(chosen[0].unionByName(chosen[1])))  # 2 x per_class rows at most
    texts = docs.select(_spark.column(id_col).alias("_id"), _spark.column(text_col).alias("_text")).join(ids, "_id").select("_y", "_text")
    found = texts.mapInArrow(_spark.frugal(_features), "y int, words binary, sizes binary").toPandas()
    y = found["y"].to_numpy()
    if not len(y) or y.min() == y.max():
        return np.zeros(BUCKETS, np.float32), -30.0
    feats, sizes = ([np.frombuffer(b, np.int32) for b in found[c]] for c in ("words", "sizes"))
    order = sorted(range(len(y)), key=lambda i: (y[i], bytes(found["words"][i])))  # the fit does not depend on the order of arrival
    return fit(y[order], [feats[i] for i in order], [sizes[i] for i in order], tuple(shares[k] / (y == k).sum() for k in (0, 1)), min_documents)


def score(buf: np.ndarray, offs: np.ndarray, weights: np.ndarray, bias: float):
    """(probability of each document, its sentences' number, and document, span and probability of each sentence)."""
    n = len(offs) - 1
    feats, head, doc, first, past = sentences(buf, offs)
    if not len(head):
        return np.zeros(n), np.zeros(n, np.int64), doc, first, past, np.zeros(0)
    z = np.add.reduceat(weights[feats].sum(axis=1, dtype=np.float64), head) + bias
    total = np.bincount(doc, np.logaddexp(0, z), n)
    return -np.expm1(-total), np.bincount(doc, minlength=n), doc, first, past, np.exp(-np.logaddexp(0, -z))


def toxicity(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: id, toxic_prob, is_toxic, n_sentences, and the sentences at or above the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one float for each of BUCKETS: it doesn't grow

    def run(batches):
        for batch in _text.slices(batches, "_text"):
            buf, offs = _text.string_column(batch.column("_text"))
            p, count, doc, first, past, each = score(buf, offs, *sent.value)
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            at = np.searchsorted(doc, np.arange(batch.num_rows))
            for k in np.flatnonzero(each >= threshold):
                d = doc[k]
                before = len(buf[offs[d] : first[k]].tobytes().decode("utf-8", "replace"))
                long = len(buf[first[k] : past[k]].tobytes().decode("utf-8", "replace"))
                spans[d].append({"sentence": int(k - at[d]), "start": before, "stop": before + long, "score": round(float(each[k]), 6)})
            kind = pa.list_(pa.struct([("sentence", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(np.round(p, 6)), pa.array(p >= threshold), pa.array(count.astype(np.int64)), pa.array(spans, kind)], [id_col, "toxic_prob", "is_toxic", "n_sentences", "offending"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(_spark.column(id_col).alias("_id"), _spark.column(text_col).alias("_text")).mapInArrow(_spark.frugal(run), f"{_spark.quoted(id_col)} {kind}, {OUT}")


def drop_toxic(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose documents aren't toxic, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        whole = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["_text"])
        parts = [score(*_text.string_column(b.column("_text")), *sent.value)[0] < threshold for b in _text.slices([whole], "_text")]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0, bool))

    return docs.where(clean(_spark.column(text_col)))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = _spark.read(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, _spark.read(spark, sf_dir, "labels")))
