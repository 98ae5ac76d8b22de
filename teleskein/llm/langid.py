"""Language identification by a bidirectional gated recurrent network over bytes.

Trained here, in numpy, by backpropagation through time. Texts are read in windows of WINDOW bytes, a
batch of windows at once; both directions start each window anew. Every byte gets a distribution over
languages, and a document's is the mean over all its bytes.

Defined results: a null or empty text has null language, probability and an empty list of runs; ids
may be null or repeat; a null language in the training table is left out; a training table of no
languages gives null everywhere; an empty table gives an empty result; other columns play no part.
Runs are maximal stretches of bytes with one most probable language; with ``shortest`` above 1 one that
is shorter than so many bytes joins the run before it. Training takes per_language documents of each
language and per_document windows of each, parameters of ``train``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _spark, _text

WINDOW = 96
HIDDEN = 10
#: At most so many documents of each language are learned from, chosen by hash of their id; so many windows of each.
TRAIN_DOCS, TRAIN_WINDOWS = 150, 8
BATCH = 1536


def start_weights(languages: int, hidden: int = HIDDEN, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.normal(0, 1, shape)
    w = {"out": normal(languages, 2 * hidden) * 0.3, "bias": np.zeros((languages, 1))}
    for d in "fb":
        w[d + "in"] = normal(3 * hidden, 256) * 0.3  # of each byte to update gate, reset gate, candidate
        w[d + "gate"] = normal(2 * hidden, hidden) / np.sqrt(hidden)
        w[d + "cand"] = normal(hidden, hidden) / np.sqrt(hidden)
    return w


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(w: dict, d: str, chars: np.ndarray, mask: np.ndarray | None, keep: bool = False):
    """States of direction d, (time, hidden, batch), and what backpropagation needs. chars: (time, batch); where the mask is 0 the state is 0."""
    steps, size = chars.shape
    hidden = w[d + "cand"].shape[0]
    table, gate, cand = w[d + "in"], w[d + "gate"], w[d + "cand"]
    state = np.zeros((hidden, size), table.dtype)
    out = np.empty((steps, hidden, size), table.dtype)
    kept = []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        x = table[:, chars[t]]
        g = _sigmoid(x[: 2 * hidden] + gate @ state)
        z, r = g[:hidden], g[hidden:]
        c = np.tanh(x[2 * hidden :] + cand @ (r * state))
        new = state + z * (c - state)
        if mask is not None:
            new = new * mask[t]
        if keep:
            kept.append((t, state, z, r, c))
        state = out[t] = new
    return out, kept


def backward(w: dict, d: str, chars: np.ndarray, mask: np.ndarray | None, grad_out: np.ndarray, kept: list) -> dict[str, np.ndarray]:
    hidden = w[d + "cand"].shape[0]
    gate, cand = w[d + "gate"], w[d + "cand"]
    g_in, g_gate, g_cand = np.zeros_like(w[d + "in"]), np.zeros_like(gate), np.zeros_like(cand)
    carry = np.zeros_like(grad_out[0])
    for t, state, z, r, c in reversed(kept):
        g = grad_out[t] + carry
        if mask is not None:
            g = g * mask[t]
        g_c = g * z * (1 - c * c)
        g_z = g * (c - state) * z * (1 - z)
        back = cand.T @ g_c
        g_r = back * state * r * (1 - r)
        g_cand += g_c @ (r * state).T
        both = np.concatenate([g_z, g_r])
        g_gate += both @ state.T
        carry = g * (1 - z) + back * r + gate.T @ both
        every = np.concatenate([both, g_c])
        for row in range(3 * hidden):
            g_in[row] += np.bincount(chars[t], every[row], 256)
    return {d + "in": g_in, d + "gate": g_gate, d + "cand": g_cand}


def logits(w: dict, f: np.ndarray, b: np.ndarray) -> np.ndarray:
    hidden = f.shape[1]
    return np.matmul(w["out"][:, :hidden], f) + np.matmul(w["out"][:, hidden:], b) + w["bias"]


def softmax(x: np.ndarray, axis: int = 1) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def loss_and_gradient(w: dict, chars: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy of every byte against its document's language. chars and mask: (time, batch)."""
    (f, kept_f), (b, kept_b) = forward(w, "f", chars, mask, True), forward(w, "b", chars, mask, True)
    p = softmax(logits(w, f, b))
    total = mask.sum()
    steps, size = chars.shape
    loss = -(np.log(np.maximum(p[:, label, np.arange(size)], 1e-12)) * mask).sum() / total
    g = p
    g[:, label, np.arange(size)] -= 1
    g *= mask[:, None, :] / total
    hidden = f.shape[1]
    out = np.concatenate([np.einsum("tcn,thn->ch", g, f, optimize=True), np.einsum("tcn,thn->ch", g, b, optimize=True)], axis=1)
    grads = {"out": out, "bias": g.sum(axis=(0, 2))[:, None]}
    grads |= backward(w, "f", chars, mask, np.matmul(w["out"][:, :hidden].T, g), kept_f)
    grads |= backward(w, "b", chars, mask, np.matmul(w["out"][:, hidden:].T, g), kept_b)
    return float(loss), grads


def fit(chars: np.ndarray, mask: np.ndarray, label: np.ndarray, languages: int, rounds: int = 240, size: int = 192, rate: float = 0.02, hidden: int = HIDDEN, seed: int = 3) -> dict[str, np.ndarray]:
    """Adam over random batches. chars and mask: (windows, time)."""
    w = start_weights(languages, hidden, seed)
    rng = np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    for t in range(1, rounds + 1):
        at = rng.integers(0, len(chars), min(size, len(chars)))
        _, grads = loss_and_gradient(w, chars[at].T, mask[at].T.astype(float), label[at])
        norm = np.sqrt(sum((g * g).sum() for g in grads.values()))
        step = rate * min(1.0, 3 * (1 - t / (rounds + 1)))
        for k, g in grads.items():
            g = g / max(1.0, norm)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            w[k] -= step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return {k: x.astype(np.float32) for k, x in w.items()}


def windows(raw: np.ndarray, count: int, rng: np.random.Generator, width: int = WINDOW) -> list[np.ndarray]:
    """Some windows of a text, as training has them: its first, and others from anywhere."""
    spots = [0, *rng.integers(0, max(1, len(raw) - width + 1), count - 1)] if len(raw) > width else [0]
    return [raw[s : s + width] for s in spots]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_DOCS, per_document: int = TRAIN_WINDOWS) -> tuple[list[str], dict[str, np.ndarray]]:
    """(languages, weights), from at most ``per_language`` labelled documents of each language and ``per_document`` windows of each of these."""
    text = _spark.column(text_col)
    known = docs.select(_spark.column(id_col).alias("_id"), _spark.column(lang_col).alias("_lang"), text.alias("_text")).where("_id IS NOT NULL AND _lang IS NOT NULL AND octet_length(_text) > 0")
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id", F.lit(3)), "_id", F.xxhash64("_text"))
    chosen = known.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_language)  # each task passes on so many at most

    def cut(batches):
        for batch in batches:
            found = [(lang, n, [w.tobytes() for w in windows(np.frombuffer(text.encode(), np.uint8), per_document, np.random.default_rng([5, n]))]) for lang, n, text in zip(*(batch.column(c).to_pylist() for c in ("_lang", "_n", "_text")))]
            yield pa.RecordBatch.from_arrays([pa.array([str(f[0]) for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.list_(pa.binary()))], ["lang", "n", "windows"])

    rows = sorted(chosen.select("_lang", "_n", "_text").mapInArrow(cut, "lang string, n int, windows array<binary>").collect(), key=lambda r: (r["lang"], r["n"]))
    names = sorted({r["lang"] for r in rows})
    parts = [(np.frombuffer(w, np.uint8), names.index(r["lang"])) for r in rows for w in r["windows"]]
    if not parts:
        return [], {}
    chars, mask = np.zeros((len(parts), WINDOW), np.uint8), np.zeros((len(parts), WINDOW), bool)
    for i, (w, _) in enumerate(parts):
        chars[i, : len(w)], mask[i, : len(w)] = w, True
    return names, fit(chars, mask, np.array([k for _, k in parts]), len(names))


def label_bytes(buf: np.ndarray, offs: np.ndarray, w: dict[str, np.ndarray], width: int = WINDOW) -> np.ndarray:
    """Probability of each language at each byte, (bytes, languages)."""
    out = np.empty((len(buf), w["out"].shape[0]), np.float32)
    length = np.diff(offs)
    number = -(-length // width)  # windows of each text; its last one ends with it
    doc = np.repeat(np.arange(len(length)), number)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
    begin = offs[doc] + np.minimum(k * width, np.maximum(length[doc] - width, 0))
    full = length[doc] >= width
    step = np.arange(width)[:, None]
    for which, masked in ((np.flatnonzero(full), False), (np.flatnonzero(~full), True)):
        for at in range(0, len(which), BATCH):
            some = which[at : at + BATCH]
            place = begin[some][None, :] + step
            mask = None
            if masked:
                inside = step < length[doc[some]][None, :]
                mask, place = inside.astype(np.float32), np.minimum(place, len(buf) - 1)
            chars = buf[place]
            p = softmax(logits(w, forward(w, "f", chars, mask)[0], forward(w, "b", chars, mask)[0])).transpose(0, 2, 1)
            if masked:
                out[place[inside]] = p[inside]
            else:
                out[place] = p
    return out


def runs(best: np.ndarray, offs: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, stop, label) of the runs; start and stop count bytes from the text's start."""
    z = np.zeros(0, np.int64)
    if not len(best):
        return z, z, z, z
    edge = np.ones(len(best), bool)
    edge[1:] = best[1:] != best[:-1]
    heads_doc = offs[:-1][np.diff(offs) > 0]
    edge[heads_doc] = True
    start = np.flatnonzero(edge)
    stop = np.append(start[1:], len(best))
    first = np.isin(start, heads_doc)
    keep = (stop - start >= shortest) | first
    start, label = start[keep], best[start[keep]]
    first = first[keep]
    new = first.copy()
    new[0] = True
    new[1:] |= label[1:] != label[:-1]
    start, label = start[new], label[new]
    doc = np.searchsorted(offs, start, "right") - 1
    stop = np.append(start[1:], len(best))
    stop = np.minimum(stop, offs[doc + 1])
    return doc, start - offs[doc], stop - offs[doc], label


def identify(docs: DataFrame, model: tuple[list[str], dict[str, np.ndarray]], id_col: str = "doc_id", text_col: str = "text", shortest: int = 1) -> DataFrame:
    """A row for each document: id, language, probability, and the runs of bytes of one language; shortest: 1 for the label of every position, more to smooth."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few kilobytes
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("language", pa.string())]))

    def run(batches):
        names, w = sent.value
        for batch in _text.slices(batches, "_text"):
            buf, offs = _text.string_column(batch.column("_text"))
            n = batch.num_rows
            some = np.diff(offs) > 0
            language, prob = np.full(n, None, object), np.zeros(n)
            lists = pa.array([[]] * n, kind)
            if names and some.any():
                p = label_bytes(buf, offs, w)
                mean = np.add.reduceat(p, offs[:-1][some], axis=0, dtype=np.float64) / np.diff(offs)[some][:, None]
                language[some] = np.array(names, object)[mean.argmax(1)]
                prob[some] = mean.max(1)
                doc, start, stop, label = runs(p.argmax(1), offs, shortest)
                values = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(names).take(pa.array(label))], fields=list(kind.value_type))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), values).cast(kind)
            blank = np.array([x is None for x in language])
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(language, pa.string()), pa.array(np.round(prob, 4), mask=blank), lists], [id_col, "language", "probability", "runs"])

    t = docs.schema[id_col].dataType.simpleString()
    return docs.select(_spark.column(id_col).alias("_id"), _spark.column(text_col).alias("_text")).mapInArrow(_spark.frugal(run), f"{_spark.quoted(id_col)} {t}, language string, probability double, runs array<struct<start:int,stop:int,language:string>>")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = _spark.read(spark, sf_dir, "documents")
    return identify(docs, train(docs))
