"""Katz backoff language model: counted over all documents, and applied to every token of them.

p(w | h) = d_r r / c(h) where h w is seen, that is, occurs r >= min_count times, else alpha(h) p(w | h'),
h' being h without its first word; words themselves have d_r r / N. d_r is the Good-Turing discount
for r <= K, else 1. alpha(h) gives exactly the mass that h's seen words leave to the mass that h' gives
to the words not seen after h. Two cases differ: where h' gives all its mass to words seen after h there
is nothing to back off to, so the denominator is their discounted number in place of c(h) and alpha is 0;
where no count is discounted it is c(h) + 1, so that words not seen keep some mass.
The registered query has min_count = 1, no n-gram left out; with a higher one, rarer n-grams of two
words or more count as unseen.

Counts live in tables that are partitioned by hash of the n-gram. Texts are coded once, in chunks of
about CHUNK_TOKENS words. A chunk sends each distinct n-gram of its own with its number to the part
that holds it and gets the number over all documents back; one of the chunks that sent an n-gram is
its owner and adds it to its context, which has a part in the same way: how many n-grams of each number
follow, and how many of each number the same words have after h', as whole numbers, from which the part
makes the sums of the formula. So every level is evaluated from the one below, per token, and nothing
but the numbers of n-grams by frequency comes to the driver. Messages of neighbouring levels go in one
pass over the chunks.

Defined results: null, empty and word-free texts have n_tokens 0, log_prob 0 and null perplexity; ids
may be null or repeat, each row counts and is scored by itself; a document's first words have as much
history as there is; a discount outside (0, 1] is taken as 1; an empty table gives an empty result;
other columns play no part. Words and n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _chunks, _spark, _text
from ._chunks import unwrap as _unwrap
from ._chunks import wrap as _wrap

N = 3
#: Counts up to this one are discounted.
K = 5
CHUNK_TOKENS = _chunks.CHUNK_TOKENS
#: Of numbers: keys, and x, the number here. Of contexts: in place of keys their ranks, how often followed (x), numbers after it, numbers after its suffix, denominator of that.
SENT = "part int, chunk bigint, kind string, level int, keys binary, x binary, after binary, below binary, total binary"
REPLY = "chunk bigint, kind string, level int, part int, x binary, y binary"
_SENT = [c.split()[0] for c in SENT.split(", ")]
_REPLY = [c.split()[0] for c in REPLY.split(", ")]


def chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk, ids, size of each document, hash and number of each distinct word, word of each token)."""

    def code(batches):
        held: list[tuple] = []
        total = made = 0

        def out():
            nonlocal made
            ids = pa.concat_arrays([h[0] for h in held])
            hashes = np.concatenate([h[1] for h in held])
            vocab, idx, times = np.unique(hashes, return_inverse=True, return_counts=True)
            by = np.argsort(-times, kind="stable")  # frequent words get small numbers, which compress
            place = np.empty(len(by), np.uint32)
            place[by] = np.arange(len(by), dtype=np.uint32)
            size = np.concatenate([h[2] for h in held]).astype(np.int32)
            made += 1
            blobs = [_wrap(size), vocab[by].tobytes(), _wrap(times[by].astype(np.uint32)), _wrap(place[idx])]
            columns = [pa.array([TaskContext.get().partitionId() << 32 | made], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
            held.clear()
            return pa.RecordBatch.from_arrays([*columns, *[pa.array([b], pa.binary()) for b in blobs]], ["chunk", "ids", "size", "vocab", "times", "idx"])

        for batch in _text.slices(batches, "_text"):
            _, _, hashes, pointer = _text.words(*_text.string_column(batch.column("_text")))
            held.append((batch.column("_id"), hashes, np.diff(pointer)))
            total += len(hashes) + batch.num_rows
            if total > CHUNK_TOKENS:
                yield out()
                total = 0
        if held:
            yield out()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(_spark.column(id_col).alias("_id"), _spark.column(text_col).alias("_text"))
    return rows.mapInArrow(_spark.frugal(code), f"chunk bigint, ids array<{kind}>, size binary, vocab binary, times binary, idx binary")


def _sent_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.int32(), *[pa.binary()] * 5]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], _SENT)


def _reply_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], _REPLY)


def _by_number(place: np.ndarray, number: np.ndarray, m: int) -> np.ndarray:
    """(K + 1, m): how many of each number up to K there are at each place, and the sum of those beyond it."""
    small = number <= K
    out = np.empty((K + 1, m), np.int64)
    out[:K] = np.bincount((number[small] - 1) * m + place[small], minlength=K * m).reshape(K, m)
    out[K] = np.bincount(place[~small], number[~small], m)
    return out


def _wrap_numbers(matrix: np.ndarray) -> bytes:
    return b"".join(len(b).to_bytes(4, "big") + b for b in (_chunks.wrap_small(matrix[:K].ravel()), _chunks.wrap_small(matrix[K])))


def _unwrap_numbers(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "big")
    few, many = _chunks.unwrap_small(blob[4 : 4 + n]), _chunks.unwrap_small(blob[8 + n :])
    return np.concatenate([few, many]).reshape(K + 1, -1)


def answer(discount: dict, n: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["level"], r["chunk"]))
        out = []
        for kind, level in sorted({(r["kind"], r["level"]) for r in rows}):
            own = [r for r in rows if (r["kind"], r["level"]) == (kind, level)]
            out += answer_counts(own, level < n) if kind == "count" else answer_contexts(own, discount)
        return _reply_table(out)

    return run


def answer_counts(rows: list[dict], ranks: bool) -> list[tuple]:
    """Of one part: to each chunk its n-grams' numbers over all documents, doubled, plus 1 where it is the owner, and with ranks their places among all n-grams of the part, by which they are named from then on; and, in rows of chunk -1, how many n-grams have each number."""
    keys = [_chunks.unwrap_keys(r["keys"]) for r in rows]
    at, first = _chunks.same(np.concatenate(keys))
    total = np.bincount(at, np.concatenate([_chunks.unwrap_small(r["x"]) for r in rows])).astype(np.int64)
    reply = total[at] * 2
    reply[first] += 1
    level, part, out, stop = rows[0]["level"], rows[0]["part"], [], np.cumsum([len(k) for k in keys])
    for r, k, e in zip(rows, keys, stop):
        out.append((r["chunk"], "count", level, part, _chunks.wrap_small(reply[e - len(k) : e]), _chunks.wrap_ranks(at[e - len(k) : e]) if ranks else None))
    out.append((-1, "count", level, part, np.bincount(np.minimum(total, K + 2), minlength=K + 3)[: K + 2].astype(np.int64).tobytes(), np.array([total.sum()], np.int64).tobytes()))
    return out


def answer_contexts(rows: list[dict], discount: dict) -> list[tuple]:
    """Of one part: to each chunk the denominator of its contexts, and the backoff weight of those after which it backs off."""
    level = rows[0]["level"]
    keys = [_chunks.unwrap_ranks(r["keys"]) for r in rows]
    at = np.concatenate(keys)
    m = int(at.max()) + 1
    asked = np.concatenate([_chunks.unwrap_small(r["x"]) for r in rows])
    times = np.bincount(at, asked >> 1, m)
    below = np.bincount(at, np.concatenate([_unwrap(r["total"], np.float64) for r in rows]), m)  # of one chunk, the owner; the others say 0
    seen, lower = np.zeros(m), np.zeros(m)
    for name, out, d in (("after", seen, discount[level]), ("below", lower, discount[level - 1])):
        numbers = np.concatenate([_unwrap_numbers(r[name]) for r in rows], axis=1)
        for k in range(K + 1):
            out += np.bincount(at, numbers[k], m) * (d[k + 1] * (k + 1) if k < K else 1.0)
    lower /= np.where(below > 0, below, 1.0)
    total, alpha = normalised(times, seen, lower)
    out, begin = [], 0
    for r, k in zip(rows, keys):
        mine, backs_off = at[begin : begin + len(k)], asked[begin : begin + len(k)] & 1
        begin += len(k)
        out.append((r["chunk"], "context", level, r["part"], _wrap(total[mine]), _wrap(np.where(backs_off, alpha[mine], 0.0))))
    return out


def normalised(times: np.ndarray, seen: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(denominator, alpha): times the context is followed, discounted number of what is seen after it, lower-order mass of the same."""
    free = 1 - lower
    full = (free <= 1e-12) & (seen > 0)  # every word is seen: nothing to back off to
    total = np.where(full, seen, np.where(times - seen <= 1e-12 * times, times + 1.0, times))
    with np.errstate(all="ignore"):
        return total, np.where(full, 0.0, (1 - seen / total) / free)


def discounts(by_number: np.ndarray, least: int) -> np.ndarray:
    """d_0 to d_K+1; by_number[r] n-grams occur r times. Numbers below ``least`` are unseen."""
    n = by_number.astype(float)
    d = np.ones(K + 2)
    with np.errstate(all="ignore"):
        cut = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            x = ((r + 1) * n[r + 1] / n[r] / r - cut) / (1 - cut)
            d[r] = x if 0 < x <= 1 else 1.0
    d[:least] = 0
    return d


class Chunk:
    """A chunk's tokens, and what the replies so far say of them."""

    def __init__(self, row: dict, replies: list[dict], known: dict, parts: int):
        self.id, self.parts, self.known, self.least = row["chunk"], parts, known, known["min_count"]
        self.replies: dict = {}
        for r in sorted(replies, key=lambda r: r["part"]):
            self.replies.setdefault((r["kind"], r["level"]), []).append(r)
        size = _unwrap(row["size"], np.int32)
        self.doc = np.repeat(np.arange(len(size)), size)
        self.offset = np.arange(len(self.doc)) - np.repeat(np.cumsum(size, dtype=np.int64) - size, size)
        self.keys = {1: np.frombuffer(row["vocab"], np.uint64)}
        self.times = {1: _unwrap(row["times"], np.uint32)}
        self.local = {1: _unwrap(row["idx"], np.uint32).astype(np.int64)}  # n-gram that ends with each token, -1 where the document has fewer words
        self.prefix: dict[int, np.ndarray] = {}
        self.suffix: dict[int, np.ndarray] = {}
        self.count: dict[int, np.ndarray] = {}
        self.owner: dict[int, np.ndarray] = {}
        self.order: dict[int, tuple] = {}

    def extend(self, level: int) -> None:
        """n-grams of this level, from those of the level below."""
        below, keys = self.local[level - 1], self.keys[level - 1]
        at = np.flatnonzero(self.offset >= level - 1)
        number, first, times = _chunks.numbered(below[at - 1] * len(keys) + below[at])
        self.prefix[level], self.suffix[level] = below[at[first] - 1], below[at[first]]
        self.keys[level] = _text.mix64(_text.mix64(keys[self.prefix[level]] + np.uint64(0x9E3779B97F4A7C15 * level % 2**64)) + keys[self.suffix[level]])
        self.times[level] = times
        self.local[level] = np.full(len(self.doc), -1)
        self.local[level][at] = number

    def ordered(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        if level not in self.order:
            self.order[level] = _chunks.by_part(self.keys[level], self.parts)
        return self.order[level]

    def received(self, kind: str, level: int, column: str, of: int, read) -> np.ndarray:
        """Column of the replies, for each n-gram of level ``of``."""
        rows = self.replies.get((kind, level), [])
        value = np.concatenate([read(r[column]) for r in rows]) if rows else np.zeros(0, np.int64)
        out = np.empty(len(self.keys[of]), value.dtype)
        out[self.ordered(of)[0]] = value
        return out

    def learn(self, level: int) -> None:
        """Numbers over all documents of this level's n-grams."""
        reply = self.received("count", level, "x", level, _chunks.unwrap_small)
        self.count[level], self.owner[level] = reply >> 1, (reply & 1) > 0

    def ranks(self, level: int) -> np.ndarray:
        """Of this level's n-grams in the order of their parts: their places there."""
        rows = self.replies.get(("count", level), [])
        return np.concatenate([_chunks.unwrap_ranks(r["y"]) for r in rows]) if rows else np.zeros(0, np.int64)

    def send(self, kind: str, level: int, of: int, names: tuple, columns: list[tuple]) -> list[tuple]:
        """A row for each part. names: of the n-grams in the order of parts; columns: of those in their own order; each (values, how they are wrapped)."""
        order, cut = self.ordered(of)
        columns = [names, *((v[..., order], w) for v, w in columns)]
        rows = []
        for p in np.flatnonzero(np.diff(cut)):
            at = slice(cut[p], cut[p + 1])
            blobs = [w(v[..., at]) for v, w in columns]
            rows.append((int(p), self.id, kind, level, *blobs, *[None] * (5 - len(blobs))))
        return rows

    def send_counts(self, level: int) -> list[tuple]:
        names = (self.keys[level][self.ordered(level)[0]], _chunks.wrap_keys)
        return self.send("count", level, level, names, [(self.times[level], _chunks.wrap_small)])

    def seen(self, level: int) -> np.ndarray:
        """Of each token: whether its n-gram occurs often enough."""
        return np.append(self.count[level] >= (1 if level == 1 else self.least), False)[self.local[level]]

    def context(self, level: int) -> np.ndarray:
        """Of each token: the n-gram before it, -1 where there is none or it is unseen."""
        before = np.concatenate([[-1], self.local[level - 1][:-1]])[: len(self.doc)]
        known = np.append(self.count[level - 1] >= (1 if level == 2 else self.least), False)
        return np.where((self.offset >= level - 1) & known[before], before, -1)

    def send_contexts(self, level: int) -> list[tuple]:
        context, m = self.context(level), len(self.keys[level - 1])
        times = np.bincount(context[context >= 0], minlength=m)
        gram = np.flatnonzero(self.owner[level] & (self.count[level] >= self.least))
        prefix, suffix = self.prefix[level][gram], self.suffix[level][gram]
        after = _by_number(prefix, self.count[level][gram], m)
        below = _by_number(prefix, self.count[level - 1][suffix], m)
        total = np.full(m, float(max(self.known["tokens"], 1)))
        if level > 2:
            total = self.received("context", level - 1, "x", level - 2, _float)[self.suffix[level - 1]]
        total = np.where(self.owner[level - 1], total, 0.0)
        unseen = context[(context >= 0) & ~self.seen(level)]
        backs_off = np.bincount(unseen, minlength=m) > 0
        names = (self.ranks(level - 1), _chunks.wrap_ranks)
        return self.send("context", level, level - 1, names, [(times * 2 + backs_off, _chunks.wrap_small), (after, _wrap_numbers), (below, _wrap_numbers), (total, _wrap)])

    def prob(self, level: int) -> np.ndarray:
        """Of each token, with a history of up to level - 1 words."""
        number = np.append(self.count[level], 0)[self.local[level]]
        discounted = self.known["discount"][level][np.minimum(number, K + 1)] * number
        if level == 1:
            return discounted / max(self.known["tokens"], 1)
        out = self.prob(level - 1)
        context = self.context(level)
        total, alpha = (self.received("context", level, c, level - 1, _float) for c in ("x", "y"))
        have = np.flatnonzero(context >= 0)
        out[have] *= alpha[context[have]]
        have = np.flatnonzero(self.seen(level))
        out[have] = discounted[have] / total[self.prefix[level][self.local[level][have]]]
        return out


def _float(blob: bytes) -> np.ndarray:
    return _unwrap(blob, np.float64)


def _restored(table: pa.Table, replies: list[dict], known: dict, parts: int, upto: int):
    """The chunk with its n-grams up to a level, and such numbers of them as are known."""
    row = table.to_pylist()[0] if table.num_rows else None
    if row is None:
        return None
    chunk = Chunk(row, replies, known, parts)
    for level in range(1, upto + 1):
        if level > 1:
            chunk.extend(level)
        if level in known["discount"]:
            chunk.learn(level)
    return chunk


def _messages(contexts: int, counts: int, known: dict, parts: int):
    """Contexts of one level and numbers of another; level 0: none."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = _restored(left, right.to_pylist(), known, parts, max(contexts, counts))
        if chunk is None:
            return _sent_table([])
        return _sent_table([*(chunk.send_contexts(contexts) if contexts else []), *(chunk.send_counts(counts) if counts else [])])

    return send


def score(docs: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", min_count: int = 1) -> DataFrame:
    """(id, n_tokens, log_prob, perplexity, backed_off) of each document; log_prob is natural, backed_off counts tokens that had a full history and used less of it. n-grams of two words or more that occur less than min_count times count as unseen."""
    parts = _spark.parts_for(docs.select(_spark.column(text_col)))
    coded = _spark.table(chunks(docs, id_col, text_col))
    slim = coded.drop("ids")
    known: dict = {"discount": {}, "tokens": 0, "min_count": min_count}
    replies: list[DataFrame] = []

    def all_replies(ranks: int) -> DataFrame:
        """Ranks go along only of the level whose n-grams are sent as contexts, backoff weights only to the end."""
        out = replies[0]
        for r in replies[1:]:
            out = out.unionByName(r)
        y = F.expr(f"kind = 'count' AND level = {ranks}" if ranks else "kind = 'context'")
        return out.where("chunk >= 0").withColumn("y", F.when(y, F.col("y")))

    def passed(step, source: DataFrame, schema: str, ranks: int = 0) -> DataFrame:
        return source.groupBy("chunk").cogroup(all_replies(ranks).groupBy("chunk")).applyInArrow(_spark.frugal(step), schema)

    def first_levels(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row, [], known, parts)
                rows = chunk.send_counts(1)
                if n > 1:
                    chunk.extend(2)
                    rows += chunk.send_counts(2)
                yield from _sent_table(rows).to_batches()

    def answered(sent: DataFrame, *levels: int) -> None:
        found = _spark.table(sent.groupBy("part").applyInArrow(_spark.frugal(answer(dict(known["discount"]), n)), REPLY))
        replies.append(found)
        numbers = found.where("chunk = -1").select("level", "x", "y").toLocalIterator()  # small rows, one for each part and level
        sums = {level: [np.zeros(K + 2, np.int64), 0] for level in levels}
        for r in numbers:
            sums[r["level"]][0] += np.frombuffer(r["x"], np.int64)
            sums[r["level"]][1] += int(np.frombuffer(r["y"], np.int64)[0])
        for level, (by_number, tokens) in sums.items():
            known["discount"][level] = discounts(by_number, 1 if level == 1 else min_count)
            if level == 1:
                known["tokens"] = tokens

    answered(slim.mapInArrow(_spark.frugal(first_levels), SENT), *range(1, min(n, 2) + 1))
    for level in range(2, n + 1):
        after = level + 1 if level < n else 0
        so_far = known | {"discount": dict(known["discount"])}
        answered(passed(_messages(level, after, so_far, parts), slim, SENT, level - 1), *([after] if after else []))

    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", "log_prob", "perplexity", "backed_off"]
    shape = f"{_spark.quoted(id_col)} {kind}, n_tokens bigint, log_prob double, perplexity double, backed_off bigint"

    def final(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = _restored(left, right.to_pylist(), known, parts, n)
        if chunk is None:
            return pa.table([pa.array([], k) for k in (left["ids"].type.value_type, pa.int64(), pa.float64(), pa.float64(), pa.int64())], names)
        ids = left["ids"].combine_chunks().flatten()
        tokens = np.bincount(chunk.doc, minlength=len(ids))
        log = np.bincount(chunk.doc, np.log(np.maximum(chunk.prob(n), 1e-300)), len(ids)).astype(np.float64)
        less = (chunk.offset >= n - 1) & ~chunk.seen(n)
        some = tokens > 0
        ppl = np.exp(np.minimum(-log / np.maximum(tokens, 1), 700))
        return pa.table([ids, pa.array(tokens), pa.array(np.round(log, 6)), pa.array(np.round(ppl, 6), mask=~some), pa.array(np.bincount(chunk.doc, less, len(ids)).astype(np.int64))], names)

    return passed(final, coded, shape)


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(_spark.read(spark, sf_dir, "documents"), min_count=1)
