"""Document fingerprints: SimHash with permuted block tables.

Every word votes on 64 signed bits with its hash; its weight is its inverse corpus frequency, beyond
a floor (parameter ``floor_bits``, 0 for none) below which a word is too common to tell documents apart. Frequencies are counted over all
documents, in a hashed table of fixed size. For all pairs within Hamming radius r the 64 bits are cut
into r + 3 blocks: some three of them agree in any such pair, so one table for each choice of three
blocks meets every pair in an equi-join. Fingerprints are sent once for each block that can come first
among the three, by its value; the tables that begin with it are sorted and run through where they
arrive. Each pair is reported by the first table that holds it, after its distance is confirmed.
What comes out of a table is, of each fingerprint, its number of links and one that it hangs together
with, so output doesn't grow with the pairs; ``near_documents`` gives pairs.
Nothing is approximate below the fingerprint. Texts of cosine c are about 64 arccos(c) / pi bits apart,
so near copies that share most of their words, but not all, lie within 10 bits and rarely within 3.

Defined results: null, empty and word-free texts have no fingerprint and no partner, but a row; where
all words are below the floor, all weigh the same; ids that are null have no partner, but a row; rows
that repeat an id are documents of their own in ``near_groups``, and count once for each fingerprint in
``near_documents``; equal fingerprints are partners at distance 0; an empty table gives
an empty result; other columns play no part.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _groups, _spark, _text

#: Between documents: of near copies by word 3-grams the most lie within it, of other pairs few.
RADIUS = 10
#: Pairs that are compared at once.
PAIRS = 1 << 20
TABLE_BITS = 18
#: Words more frequent than one in 2 ** FLOOR_BITS weigh nothing.
FLOOR_BITS = 9.0


def word_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Occurrences over all documents by hash bucket; fixed size, so it can go to the driver and back."""

    def count(batches):
        total = np.zeros(1 << TABLE_BITS, np.int64)
        for batch in _text.slices(batches, "_text"):
            hashes = _text.words(*_text.string_column(batch.column("_text")))[2]
            total += np.bincount((hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64), minlength=1 << TABLE_BITS)
        for at in range(0, len(total), 4096):  # slices of the table are added up in parallel
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total[at : at + 4096].tobytes()], pa.binary())], ["at", "part"])

    def add(key, tables):
        total = np.zeros(4096, np.int64)
        for batch in tables:
            for blob in batch.column("part"):
                total += np.frombuffer(blob.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["at", "part"])

    parts = docs.select(_spark.column(text_col).alias("_text")).mapInArrow(_spark.frugal(count), "at int, part binary")
    added = parts.groupBy("at").applyInArrow(lambda key, table: pa.Table.from_batches(list(add(key, table.to_batches()))), "at int, part binary")
    out = np.zeros(1 << TABLE_BITS, np.int64)
    for row in added.toLocalIterator():
        out[row["at"] : row["at"] + 4096] = np.frombuffer(row["part"], np.int64)
    return out


def word_weights(counts: np.ndarray, floor_bits: float = FLOOR_BITS) -> np.ndarray:
    rare = np.log2(max(counts.sum(), 1)) - np.log2(np.maximum(counts, 1))
    return np.maximum(rare - floor_bits, 0).astype(np.float32)


def fingerprint(buf: np.ndarray, offs: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, whether there is one) of each document."""
    _, _, hashes, pointer = _text.words(buf, offs)
    have = np.diff(pointer) > 0
    out = np.zeros(len(offs) - 1, np.uint64)
    heads = pointer[:-1][have]
    if len(heads):
        w = weights[(hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
        flat = np.add.reduceat(w, heads) == 0
        if flat.any():
            w = w + np.repeat(flat, np.diff(np.append(heads, len(hashes)))).astype(np.float32)
        bits = np.unpackbits(_text.mix64(hashes).view(np.uint8).reshape(-1, 8), axis=1)
        votes = np.empty((len(heads), 64), np.float64)
        ends = np.append(heads[1:], len(hashes))
        at = 0
        while at < len(heads):  # about 64k words at once
            to = max(at + 1, int(np.searchsorted(ends, heads[at] + 65536, "right")))
            lo, hi = heads[at], ends[to - 1]
            if hi - lo > 1 << 18:  # one very long document
                votes[at] = sum(w[k : k + 65536].astype(np.float64) @ (bits[k : k + 65536] * 2.0 - 1) for k in range(lo, hi, 65536))
            else:
                votes[at:to] = np.add.reduceat((bits[lo:hi] * np.float32(2) - np.float32(1)) * w[lo:hi, None], heads[at:to] - lo, axis=0)
            at = to
        out[have] = np.packbits(votes > 0, axis=1).view(np.uint64).ravel()
    return out, have


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", floor_bits: float = FLOOR_BITS) -> DataFrame:
    """(id, fingerprint), null where a text has no words."""
    sent = docs.sparkSession.sparkContext.broadcast(word_weights(word_counts(docs, text_col), floor_bits))

    def run(batches):
        for batch in _text.slices(batches, "_text"):
            prints, have = fingerprint(*_text.string_column(batch.column("_text")), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(prints.view(np.int64), mask=~have)], [id_col, "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(_spark.column(id_col).alias("_id"), _spark.column(text_col).alias("_text")).mapInArrow(_spark.frugal(run), f"{_spark.quoted(id_col)} {kind}, fingerprint bigint")


def masks(radius: int) -> tuple[list[int], list[tuple[int, ...]], list[int]]:
    """(mask of each block, the blocks of each table, mask of each table)."""
    n = radius + 3
    cuts = [64 * i // n for i in range(n + 1)]
    block = [((1 << cuts[i + 1]) - (1 << cuts[i])) for i in range(n)]
    tables = list(combinations(range(n), 3))
    return block, tables, [sum(block[i] for i in t) for t in tables]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _in_runs(key: np.ndarray):
    """Places (x, y), x < y, of all pairs of equal neighbours in a sorted key, about PAIRS at once."""
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    stop = np.repeat(np.append(start[1:], len(key)), np.diff(np.append(start, len(key))))
    after = stop - np.arange(len(key)) - 1
    ends = np.cumsum(after)
    at = 0
    while at < len(key):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - after[at] + PAIRS, "right")))
        number = after[at:to]
        x = np.repeat(np.arange(at, to), number)
        if len(x):
            yield x, x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(number) - number, number)
        at = to


def _meet(prints: np.ndarray, first: int, radius: int):
    """Places (x, y) in prints, and distance, of the pairs whose first three agreeing blocks begin with block ``first``, some at a time."""
    block, tables, mask = masks(radius)
    block = [np.uint64(m) for m in block]
    for table, m in zip(tables, mask):
        if table[0] != first:
            continue
        key = prints & np.uint64(m)
        order = np.argsort(key)
        key, sorted_prints = key[order], prints[order]
        for x, y in _in_runs(key):
            a, b = sorted_prints[x], sorted_prints[y]
            near = np.flatnonzero(np.bitwise_count(a ^ b) <= radius)
            a, b, x, y = a[near], b[near], x[near], y[near]
            for k in range(table[2]):
                if k not in table:
                    own = (a ^ b) & block[k] != 0
                    a, b, x, y = a[own], b[own], x[own], y[own]
            if len(a):
                yield order[x], order[y], np.bitwise_count(a ^ b).astype(np.int32)


def _tables(prints: DataFrame, radius: int, run, schema: str) -> DataFrame:
    """run(fingerprints, copies, first block) of what meets in a part. prints: distinct fingerprints, with the documents of each."""
    block = masks(radius)[0]
    firsts = F.array(*[F.struct(F.lit(i).alias("first"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(block[:-2])])
    spread = prints.where("fingerprint IS NOT NULL").select("fingerprint", "copies", F.explode(firsts).alias("e"))
    part = F.pmod(F.xxhash64("e.first", "e.k"), F.lit(64 * _spark.parts_for(prints)))
    names = [c.split()[0] for c in schema.split(", ")]

    def meet(table: pa.Table) -> pa.Table:
        first, held, copies = (table[c].to_numpy() for c in ("first", "fingerprint", "copies"))
        found = []
        for i in np.unique(first):
            own, at = np.unique(held[first == i], return_index=True)
            found += run(own, copies[first == i][at], int(i))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c) for c in columns], names).cast(pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.int32() if names[2] == "distance" else pa.int64())))))

    return spread.select("fingerprint", "copies", "e.first", part.alias("part")).groupBy("part").applyInArrow(_spark.frugal(meet), schema)


def near_fingerprints(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b, distance), a < b: all pairs of distinct values of column fingerprint within the radius."""

    def pairs(own, copies, first):
        return [(own[np.minimum(x, y)], own[np.maximum(x, y)], d) for x, y, d in _meet(own.view(np.uint64), first, radius)]

    return _tables(prints.select("fingerprint", F.lit(1).cast("bigint").alias("copies")), radius, pairs, "a bigint, b bigint, distance int")


def linked_fingerprints(prints: DataFrame, radius: int) -> DataFrame:
    """(a, b, links): of each fingerprint with partners here, one that it hangs together with, and how many documents its partners have. prints: (fingerprint, copies), distinct."""

    def links(own, copies, first):
        total, low = np.zeros(len(own), np.int64), np.arange(len(own))
        for x, y, _ in _meet(own.view(np.uint64), first, radius):
            total += np.bincount(x, copies[y], len(own)).astype(np.int64) + np.bincount(y, copies[x], len(own)).astype(np.int64)
            low = _groups.least_of(np.concatenate([np.arange(len(own)), x]), np.concatenate([low, y]), len(own))
        who = np.flatnonzero(total)
        return [(own[who], own[low[who]], total[who])]

    return _tables(prints, radius, links, "a bigint, b bigint, links bigint")


def near_groups(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", floor_bits: float = FLOOR_BITS) -> DataFrame:
    """A row for each input row: its id, fingerprint, keep_id (the least id of all documents that it hangs together with by pairs within the radius), n_links (its own number of such pairs)."""
    known = _spark.pin(fingerprints(docs, id_col, text_col, floor_bits).select(_spark.column(id_col).alias("id"), F.col("fingerprint").alias("sid")))
    has = F.col("id").isNotNull() & F.col("sid").isNotNull()
    firsts = _spark.table(known.where(has).groupBy("sid").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id")).alias("row")))
    found = _spark.table(linked_fingerprints(firsts.select(F.col("sid").alias("fingerprint"), "copies"), radius))
    sets = _groups.grouped(firsts, found).select("sid", F.col("row.id").alias("keep_id"), F.col("links").alias("n_links"))
    near = known.where(has).join(sets, "sid").select(F.col("id").alias(id_col), F.col("sid").alias("fingerprint"), "keep_id", "n_links")
    return near.unionByName(known.where(~has).select(F.col("id").alias(id_col), F.col("sid").alias("fingerprint"), F.col("id").alias("keep_id"), F.lit(0).cast("bigint").alias("n_links")))


def near_documents(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", floor_bits: float = FLOOR_BITS) -> DataFrame:
    """(doc_a, doc_b, distance), doc_a < doc_b: all pairs of documents whose fingerprints are within the radius. Its rows grow as the square of a group of near copies; ``near_groups`` gives one for each document."""
    id_ = _spark.column(id_col)
    known = _spark.pin(fingerprints(docs, id_col, text_col, floor_bits).where(F.col("fingerprint").isNotNull() & id_.isNotNull()).select(id_.alias("_id"), "fingerprint").distinct())
    pairs = near_fingerprints(known.select("fingerprint").distinct(), radius)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    copies = known.groupBy("fingerprint").count().where("count > 1").select(F.col("fingerprint").alias("a"), F.col("fingerprint").alias("b"), F.lit(0).alias("distance"))
    left, right = known.select(F.col("_id").alias("doc_a"), F.col("fingerprint").alias("a")), known.select(F.col("_id").alias("doc_b"), F.col("fingerprint").alias("b"))
    return both.unionByName(copies).join(left, "a").join(right, "b").where("doc_a < doc_b").groupBy("doc_a", "doc_b").agg(F.min("distance").alias("distance"))


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    return near_groups(_spark.read(spark, sf_dir, "documents"))
