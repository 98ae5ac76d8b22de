"""N-gram Jaccard join in the metric space of Jaccard distance.

All pairs of documents whose sets of word n-grams have Jaccard similarity of at least t, that is a
distance of at most e = 1 - t. Documents with one and the same set enter once.

1. Reach. Each n-gram's number of documents is counted over all of them (copies of a set count once in
   a chunk of documents, so a number is never too low). A document of whose grams
   more than a share of e occur nowhere else is farther than e from all others, so it is alone. With
   grams ordered by rising count, two documents within e share one of the first |x| - ceil(t |x|) + 1
   grams of both; those grams that others hold are the cells of a document.
2. Pivots. The document that is least by hash in a cell is the cell's pivot, and a document goes to
   the pivots of all its cells: regions, which overlap. Any pair within e shares a cell, so it meets in
   a region; it counts in the least region that both are in. (Jaccard distance of n-grams is near 1
   between most texts, so a window of 2e around pivots drawn without regard to cells spans all.)
3. Recursion. A region beyond LEAF documents or LEAF_GRAMS grams chooses pivots of its own, each the
   farthest from those before; documents go to the Voronoi cell of the nearest by exact distance, and
   also into cell j where d(x, p_j) <= d(x, p_home) + 2e, which the triangle inequality shows to be
   enough. Cells divide again until they fit. A region that pivots don't divide, as all of it is close
   together, is compared by blocks, two at a time. All of this is distributed, and a task holds one
   leaf. Leaves compare exactly.

What comes out of a leaf is, of each document, its number of links and the least document that it
hangs together with, so output doesn't grow with the pairs; ``jaccard_join`` gives pairs.

Exact, but for collisions of 64-bit hashes.

Defined results: grams are word n-grams; a text of fewer words has one gram of them all; null, empty
and word-free texts and null ids have no partner, and a row of their own; rows that repeat an id are
documents of their own, whether text repeats or not, but ``jaccard_join`` makes no pair of one id and
itself and of others gives the best; an empty table gives an empty result; other columns play no part,
except that ``drop_near_duplicates`` decides between rows of one id and one text by their JSON text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _chunks, _groups, _spark, _text

N = 3
THRESHOLD = 0.6
#: Documents, and grams, of the largest region that one task compares.
LEAF = 1024
LEAF_GRAMS = 8_000_000
#: Pivots of a region that divides, and documents by hash of which they are chosen.
PIVOTS = 8
#: Words of a chunk of documents.
CHUNK_TOKENS = 1 << 19
SEEDS = 64
_MOST = (1 << 16) - 1
_STEP = 0x9E3779B97F4A7C15
PLACED = "region bigint, sid bigint, size int, copies bigint, grams binary, lower array<bigint>, home boolean, side int"
_PLACED = [c.split()[0] for c in PLACED.split(", ")]


def least(size: np.ndarray, threshold: float) -> np.ndarray:
    return np.ceil(threshold * size - 1e-9).astype(np.int64)


# sets -------------------------------------------------------------------------------------------


def gram_sets(idx: np.ndarray, vocab: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, gram) of all distinct pairs, by document, and the hash of each gram. idx: word of each token in vocab."""
    doc = np.repeat(np.arange(len(size)), size)
    offset = np.arange(len(idx)) - np.repeat(np.cumsum(size) - size, size)
    last = np.cumsum(size) - 1
    gram, keys = idx, vocab
    short_doc, short_key = [], []
    for level in range(2, n + 1):
        short = np.flatnonzero(size == level - 1)
        if len(short):
            short_doc.append(short)
            short_key.append(_text.mix64(keys[gram[last[short]]] + np.uint64(level)))
        at = np.flatnonzero(offset >= level - 1)
        code = gram[at - 1] * len(vocab) + idx[at]
        number, first, _ = _chunks.numbered(code)
        keys = _text.mix64(_text.mix64(keys[gram[at[first] - 1]] + np.uint64(_STEP * level % 2**64)) + vocab[idx[at[first]]]) if len(first) else np.zeros(0, np.uint64)
        gram = np.full(len(idx), -1)
        gram[at] = number
    at = np.flatnonzero(offset >= n - 1)
    bits = max(len(keys), 1).bit_length()
    pair = (doc[at].astype(np.uint64) << np.uint64(bits)) | gram[at].astype(np.uint64)
    pair.sort()
    if len(pair):
        pair = pair[np.append(True, pair[1:] != pair[:-1])]
    doc, gram = (pair >> np.uint64(bits)).astype(np.int64), (pair & np.uint64((1 << bits) - 1)).astype(np.int64)
    if short_doc:
        extra, key = np.concatenate(short_doc), np.concatenate(short_key)
        doc, gram, keys = np.concatenate([doc, extra]), np.concatenate([gram, len(keys) + np.arange(len(key))]), np.concatenate([keys, key])
        order = np.argsort(doc, kind="stable")
        doc, gram = doc[order], gram[order]
    return doc, gram, keys


def coded(texts: DataFrame, n: int) -> DataFrame:
    """Chunks of documents. texts: _id, _text and _key. sids: of each document the hash of its gram set, null without words."""
    kind = texts.schema["_id"].dataType.simpleString()

    def code(batches):
        held: list[tuple] = []
        total = made = 0

        def out():
            nonlocal made
            made += 1
            vocab, idx = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True)
            size = np.concatenate([h[3] for h in held]).astype(np.int32)
            doc, gram, keys = gram_sets(idx, vocab, size.astype(np.int64), n)
            sid = np.zeros(len(size), np.uint64)
            heads = np.flatnonzero(np.diff(doc, prepend=-1))
            if len(heads):
                sid[doc[heads]] = _text.mix64(np.add.reduceat(_text.mix64(keys[gram] ^ np.uint64(0xA5A5A5A5A5A5A5A5)), heads)) >> np.uint64(1)
            lists = [pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]), pa.array(sid.view(np.int64), mask=size == 0)]
            span = pa.array([0, len(size)], pa.int32())
            blobs = [_chunks.wrap(size), vocab.tobytes(), _chunks.wrap(idx.astype(np.uint32))]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() << 32 | made], pa.int64()), *[pa.ListArray.from_arrays(span, x) for x in lists], *[pa.array([b], pa.binary()) for b in blobs]],
                ["chunk", "ids", "row_keys", "sids", "size", "vocab", "idx"],
            )

        for batch in _text.slices(batches, "_text"):
            _, _, hashes, pointer = _text.words(*_text.string_column(batch.column("_text")))
            held.append((batch.column("_id"), batch.column("_key"), hashes, np.diff(pointer)))
            total += len(hashes) + batch.num_rows
            if total > CHUNK_TOKENS:
                yield out()
                total = 0
        if held:
            yield out()

    return texts.mapInArrow(_spark.frugal(code), f"chunk bigint, ids array<{kind}>, row_keys array<bigint>, sids array<bigint>, size binary, vocab binary, idx binary")


def _decoded(row: dict, place: np.ndarray, n: int):
    """(document among these places, gram, hash of each gram)."""
    size = _chunks.unwrap(row["size"], np.int32).astype(np.int64)
    idx = _chunks.unwrap(row["idx"], np.uint32).astype(np.int64)
    use = np.zeros(len(size), bool)
    use[place] = True
    return gram_sets(idx[np.repeat(use, size)], np.frombuffer(row["vocab"], np.uint64), size[place], n)


def reaching(chunks: DataFrame, n: int, threshold: float, parts: int) -> tuple[DataFrame, DataFrame]:
    """(sid, copies, least row of each set; sid, size, copies, grams that others hold, cells of those sets that others may reach)."""
    rows = chunks.select("chunk", F.posexplode(F.arrays_zip("ids", "row_keys", "sids")).alias("place", "m")).where("m.sids IS NOT NULL")
    row = F.struct(F.col("m.ids").alias("id"), F.col("m.row_keys").alias("key"))
    firsts = _spark.table(rows.groupBy(F.col("m.sids").alias("sid")).agg(F.min(F.struct("chunk", "place")).alias("at"), F.count(F.lit(1)).alias("copies"), F.min(row).alias("row")))
    work = chunks.select("chunk", "sids", "size", "vocab", "idx")

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sid, place = np.unique([-1 if s is None else s for s in row["sids"]], return_index=True)
                if not len(place := np.sort(place[sid >= 0])):
                    continue
                _, gram, keys = _decoded(row, place, n)
                times = np.bincount(gram, minlength=len(keys)).astype(np.uint32)
                order, cut = _chunks.by_part(keys, parts)
                at = np.flatnonzero(np.diff(cut))
                blobs = [[_chunks.wrap_keys(keys[order[cut[p] : cut[p + 1]]]) for p in at], [_chunks.wrap(times[order[cut[p] : cut[p + 1]]]) for p in at]]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([row["chunk"]] * len(at), pa.int64()), *[pa.array(b, pa.binary()) for b in blobs]], ["part", "chunk", "keys", "times"])

    def answer(table: pa.Table) -> pa.Table:
        keys = [_chunks.unwrap_keys(b.as_py()) for b in table["keys"]]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.minimum(np.bincount(at, np.concatenate([_chunks.unwrap(b.as_py(), np.uint32) for b in table["times"]])), _MOST).astype(np.uint16)[at]
        stop = np.cumsum([len(k) for k in keys])
        found = [_chunks.wrap(total[e - len(k) : e]) for k, e in zip(keys, stop)]
        return pa.table([table["chunk"], table["part"], pa.array(found, pa.binary())], ["chunk", "part", "number"])

    sent = work.mapInArrow(_spark.frugal(send), "part int, chunk bigint, keys binary, times binary")
    replies = _spark.table(sent.groupBy("part").applyInArrow(_spark.frugal(answer), "chunk bigint, part int, number binary"))
    replied = work.join(replies.groupBy("chunk").agg(F.collect_list(F.struct("part", "number")).alias("replies")), "chunk")
    replied = replied.join(firsts.groupBy(F.col("at.chunk").alias("chunk")).agg(F.collect_list(F.struct("at.place", "copies")).alias("firsts")), "chunk")

    def keep(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = np.sort(np.unique([-1 if s is None else s for s in row["sids"]], return_index=True)[1])
                own = own[[row["sids"][p] is not None for p in own]]
                doc, gram, keys = _decoded(row, own, n)
                order, _ = _chunks.by_part(keys, parts)
                number = np.empty(len(keys), np.int64)
                number[order] = np.concatenate([_chunks.unwrap(r["number"], np.uint16) for r in sorted(row["replies"], key=lambda r: r["part"])])
                firsts = sorted((f["place"], f["copies"]) for f in row["firsts"])  # of the sets that have been told apart in this chunk, those that stand for their copies everywhere
                place, copies = (np.array([f[k] for f in firsts], np.int64) for k in range(2))
                among = np.full(len(own), -1)
                among[np.searchsorted(own, place)] = np.arange(len(place))
                doc = among[doc]
                doc, gram = doc[doc >= 0], gram[doc >= 0]
                size = np.bincount(doc, minlength=len(place))
                shared = number[gram] >= 2
                cells = np.bincount(doc[shared], minlength=len(place)) - least(size, threshold) + 1
                live = cells > 0
                shared &= live[doc]
                doc, gram = doc[shared], gram[shared]
                by_key = np.lexsort((keys[gram], doc))
                doc, gram = doc[by_key], gram[by_key]
                who = np.flatnonzero(live)
                held = np.bincount(doc, minlength=len(place))[who]
                ends = np.append(0, np.cumsum(held))
                by_number = np.lexsort((keys[gram], number[gram], doc))
                first = np.arange(len(doc)) - np.repeat(ends[:-1], held) < np.repeat(cells[who], held)
                sid = np.array(row["sids"], object)[place[who]].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(sid), pa.array(size[who].astype(np.int32)), pa.array(copies[who]), pa.array([keys[gram[a:b]].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(cells[who])), pa.int32()), pa.array(keys[gram[by_number[first]]].view(np.int64))),
                    ], ["sid", "size", "copies", "grams", "cells"],
                )

    sets = replied.mapInArrow(_spark.frugal(keep), "sid bigint, size int, copies bigint, grams binary, cells array<bigint>")
    return firsts, _spark.table(sets)


# regions ----------------------------------------------------------------------------------------


def regions(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents as they go to the regions of pivots; region, n and grams of each)."""
    cells = sets.select("sid", "size", F.explode("cells").alias("cell"))
    order = F.struct(F.xxhash64("sid").alias("h"), F.col("sid").alias("s"))
    pivots = cells.groupBy("cell").agg(F.min(order).getField("s").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    reach = _spark.table(cells.join(pivots, "cell").groupBy("sid", "pivot").agg(F.first("size").alias("size")))
    stats = reach.groupBy(F.col("pivot").alias("region")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("g"))
    lists = reach.groupBy("sid").agg(F.sort_array(F.collect_list("pivot")).alias("pivots"))
    placed = sets.drop("cells").join(lists, "sid").withColumn("region", F.explode("pivots"))
    return placed.select("region", "sid", "size", "copies", "grams", F.filter("pivots", lambda p: p < F.col("region")).alias("lower"), F.lit(True).alias("home"), F.lit(-1).alias("side")), stats


def distances(sets: list[np.ndarray], size: np.ndarray, pivot: np.ndarray, pivot_size: int) -> np.ndarray:
    """From the pivot; sets hold, sorted, what others hold too, sizes count all."""
    flat = np.concatenate(sets)
    where = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    hit = pivot[np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)] == flat
    common = np.bincount(where[hit], minlength=len(sets))
    return 1 - common / (size + pivot_size - common)


def _chosen(table: pa.Table) -> pa.Table:
    """Pivots of a region: each is farthest from those before."""
    sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in table["grams"]]
    size = table["size"].to_numpy().astype(np.int64)
    at, far, picked = int(np.argmin(table["sid"].to_numpy())), np.full(len(sets), 2.0), []
    while len(picked) < PIVOTS and far[at] > 0:
        picked.append(at)
        far = np.minimum(far, distances(sets, size, sets[at], int(size[at])))
        at = int(far.argmax())
    return table.select(["region", "sid", "size", "grams"]).take(pa.array(picked))


def _windows(threshold: float):
    def assign(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.select(_PLACED).append_column("parent", rows["region"])
        pivots = pivots.sort_by("sid")
        sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in rows["grams"]]
        size = rows["size"].to_numpy().astype(np.int64)
        far = np.array([distances(sets, size, np.frombuffer(p["grams"], np.uint64), p["size"]) for p in pivots.select(["grams", "size"]).to_pylist()])
        nearest = far.argmin(0)
        cell, x = np.nonzero(far <= far.min(0) + 2 * (1 - threshold) + 1e-9)
        region = rows["region"].to_numpy().view(np.uint64)[x]
        into = _text.mix64(_text.mix64(region) + cell.astype(np.uint64)).view(np.int64)
        home = rows["home"].to_numpy(zero_copy_only=False)[x] & (nearest[x] == cell)
        out = rows.select(_PLACED).take(pa.array(x))
        out = out.set_column(0, "region", pa.array(into)).set_column(_PLACED.index("home"), "home", pa.array(home))
        return out.append_column("parent", pa.array(region.view(np.int64)))

    return assign


def leaves(placed: DataFrame, stats: DataFrame, threshold: float, leaf: int = LEAF, leaf_grams: int = LEAF_GRAMS) -> list[DataFrame]:
    """The same documents in regions that a task can hold."""
    large = f"n > {leaf} OR g > {leaf_grams}"
    stats = _spark.table(stats)
    big = stats.where(large).withColumn("blocks", F.ceil(F.greatest(F.col("n") / leaf, F.col("g") / leaf_grams)).cast("int"))
    if not big.limit(1).count():
        return [placed]
    side = _spark.sized_side(big.select("region", "blocks"))
    out = [placed.join(side, "region", "left_anti")]
    rows = _spark.table(placed.join(side, "region"))
    while True:
        rows = rows.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
        first = F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("sid"), "sid"))
        pivots = rows.withColumn("first", first).where(f"first <= {SEEDS}").groupBy("region").applyInArrow(_chosen, "region bigint, sid bigint, size int, grams binary")
        pivots = pivots.join(big.select("region", "blocks"), "region").select("region", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "sid", "size", "grams")
        cut = rows.groupBy("region", "block").cogroup(pivots.groupBy("region", "block")).applyInArrow(_windows(threshold), PLACED + ", parent bigint")
        cut = _spark.table(cut)
        after = _spark.table(cut.groupBy("parent", "region").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("g"), F.max("home").alias("home")))
        sums = after.groupBy(F.col("parent").alias("region")).agg(F.max("n").alias("most"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("work"))
        judged = big.join(sums, "region").withColumn("divides", F.expr("most <= 0.8 * n AND total <= 2 * n AND work <= 0.7 * n * n"))
        close = judged.where("NOT divides").select("region")
        out.append(_in_blocks(rows.join(_spark.sized_side(close), "region", "left_semi")))
        apart = after.join(judged.where("divides").select(F.col("region").alias("parent")), "parent", "left_semi").where("home")
        out.append(cut.join(_spark.sized_side(apart.where(f"NOT ({large})").select("region")), "region", "left_semi").drop("parent"))
        big = _spark.table(apart.where(large).select("region", "n", "g", F.ceil(F.greatest(F.col("n") / leaf, F.col("g") / leaf_grams)).cast("int").alias("blocks")))
        if not big.limit(1).count():
            return [d.select(_PLACED) for d in out]
        rows = _spark.table(cut.drop("parent").join(_spark.sized_side(big.select("region", "blocks")), "region"))


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Each block with itself and with each other one. rows: with block and blocks."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = rows.withColumn("other", other)
    pair = F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other"))
    return met.withColumns({"side": F.when(F.col("block") == F.col("other"), -1).otherwise(F.col("block")), "region": pair}).select(_PLACED)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many grams each two of the sets share."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    if len(sets) == 2:
        out[0, 1] = out[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
        return out
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat)
    flat, who = flat[order], who[order]
    new = np.append(True, flat[1:] != flat[:-1])
    alone = new & np.append(new[1:], True)
    who, at = who[~alone], (np.cumsum(new & ~alone) - 1)[~alone]
    width = max(256, 8_000_000 // len(sets))
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        i, j = np.searchsorted(at, (lo, lo + width))
        block = np.zeros((len(sets), min(width, int(at[-1]) + 1 - lo)), np.float32)
        block[who[i:j], at[i:j] - lo] = 1
        out += block @ block.T
    return out


def leaf_pairs(sets, size, lower, home, side, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity), i < j, of the pairs that this leaf reports: i is at home, sides differ or there are none, and no lesser region holds both."""
    both = overlaps(sets)
    union = size[:, None] + size[None, :] - both
    i, j = np.nonzero(np.triu(both >= threshold * union - 1e-9, 1))
    ok = home[i] & ((side[i] < 0) | (side[i] != side[j]))
    i, j = i[ok], j[ok]
    some = [k for k, low in enumerate(lower) if len(low)]
    if len(i) and len(some) > 1:
        flat, at = np.unique(np.concatenate([lower[k] for k in some]), return_inverse=True)
        known = np.zeros((len(sets), len(flat)), np.float32)
        known[np.repeat(some, [len(lower[k]) for k in some]), at] = 1
        for a in range(0, len(i), 65536):
            b = slice(a, a + 65536)
            ok[: len(i)][b] = np.einsum("ij,ij->i", known[i[b]], known[j[b]]) == 0
        i, j = i[ok[: len(i)]], j[ok[: len(j)]]
    return i, j, both[i, j].astype(np.float64) / (size[i] + size[j] - both[i, j])


def _solved(batches, threshold: float, pairs: bool):
    """Rows come by region. pairs: (a, b, jaccard); else (document, least document that it hangs together with here, its links)."""
    names, kinds = (["a", "b", "jaccard"], (pa.int64(), pa.int64(), pa.float64())) if pairs else (["a", "b", "links"], (pa.int64(), pa.int64(), pa.int64()))
    held: list[pa.RecordBatch] = []
    out: list[list[np.ndarray]] = []

    def solve():
        table = pa.Table.from_batches(held)
        held.clear()
        if table.num_rows < 2:
            return
        table = table.sort_by("sid")
        sid, size, copies = (table[c].to_numpy() for c in ("sid", "size", "copies"))
        sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in table["grams"]]
        i, j, near = leaf_pairs(sets, size.astype(np.float64), table["lower"].to_pylist(), table["home"].to_numpy(zero_copy_only=False), table["side"].to_numpy(), threshold)
        if not len(i):
            return
        if pairs:
            out.append([sid[i], sid[j], near])
            return
        links = np.bincount(i, copies[j], len(sid)) + np.bincount(j, copies[i], len(sid))
        who = np.flatnonzero(links)
        out.append([sid[who], sid[_groups.least_of(i, j, len(sid))[who]], links[who].astype(np.int64)])

    def table():
        columns = [np.concatenate([o[k] for o in out]) if out else [] for k in range(3)]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    now = None
    for batch in batches:
        region = batch.column("region").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(region)) + 1), len(region)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                if region[a] != now:
                    if held:
                        solve()
                    now = region[a]
                held.append(batch.slice(a, b - a))
        if sum(len(o[0]) for o in out) > 100_000:
            yield table()
    if held:
        solve()
    yield table()


def _compared(texts: DataFrame, n: int, threshold: float, leaf: int, pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, sets, what the leaves found)."""
    parts = _spark.parts_for(texts)
    chunks = _spark.table(coded(texts, n))
    firsts, sets = reaching(chunks, n, threshold, parts)
    placed, stats = regions(sets)
    schema = "a bigint, b bigint, jaccard double" if pairs else "a bigint, b bigint, links bigint"
    whole, *rest = leaves(placed, stats, threshold, leaf)
    for r in rest:
        whole = whole.unionByName(r)

    def solve(batches):
        yield from _solved(batches, threshold, pairs)

    by_region = whole.repartition(parts, "region").sortWithinPartitions("region")
    return chunks, firsts, _spark.table(by_region.mapInArrow(_spark.frugal(solve), schema))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = _spark.column(text_col)
    return docs.select(_spark.column(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_key")).where("_id IS NOT NULL AND _text IS NOT NULL")


def _members(chunks: DataFrame) -> DataFrame:
    """(id, key, sid) of each row."""
    rows = chunks.select(F.explode(F.arrays_zip("ids", "row_keys", "sids")).alias("m"))
    return rows.select(F.col("m.ids").alias("id"), F.col("m.row_keys").alias("key"), F.col("m.sids").alias("sid"))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b: all pairs at or above the threshold. Its rows grow as the square of a group of near copies; ``near_groups`` gives one for each document."""
    chunks, firsts, found = _compared(_texts(docs, id_col, text_col), n, threshold, leaf, True)
    copies = firsts.where("copies > 1").select(F.col("sid").alias("a"), F.col("sid").alias("b"), F.lit(1.0).alias("jaccard"))
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard")).unionByName(copies)
    members = _members(chunks).where("sid IS NOT NULL")
    left, right = members.select(F.col("id").alias("doc_a"), F.col("sid").alias("a")), members.select(F.col("id").alias("doc_b"), F.col("sid").alias("b"))
    return both.join(left, "a").join(right, "b").where("doc_a < doc_b").groupBy("doc_a", "doc_b").agg(F.round(F.max("jaccard"), 6).alias("jaccard"))


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """A row for each input row: its id, keep_id (the least id of all documents that it hangs together with by pairs at or above the threshold), n_links (its own number of such pairs)."""
    chunks, firsts, found = _compared(_texts(docs, id_col, text_col), n, threshold, leaf, False)
    sets = _groups.grouped(firsts, found).select("sid", F.col("row.id").alias("keep_id"), F.col("links").alias("n_links"))
    members = _members(chunks)
    near = members.where("sid IS NOT NULL").join(sets, "sid").select(F.col("id").alias(id_col), "keep_id", "n_links")
    alone = members.where("sid IS NULL").select("id").unionByName(docs.where(_spark.column(id_col).isNull() | _spark.column(text_col).isNull()).select(_spark.column(id_col).alias("id")))
    return near.unionByName(alone.select(F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(0).cast("bigint").alias("n_links")))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """The rows that stay, with all their columns: of each group of rows that hang together by near pairs, one that has the least id; if rows of other texts have that id too, one of them."""
    chunks, firsts, found = _compared(_texts(docs, id_col, text_col), n, threshold, leaf, False)
    sets = _groups.grouped(firsts, found).where("links > 0").select("sid", "row")
    members = _members(chunks).join(sets, "sid")
    gone = members.where("row.id <> id OR row.key <> key").select("id", "key").distinct()
    stays = members.where("row.id = id AND row.key = key").groupBy("id", "key").count().where("count > 1").select("id", "key")
    rows = docs.select(_spark.row_struct(docs).alias("_row"), _spark.column(id_col).alias("id"), F.xxhash64(_spark.column(text_col)).alias("key"))
    repeated = _spark.table(stays)
    if not repeated.limit(1).count():
        return rows.join(_spark.sized_side(gone), ["id", "key"], "left_anti").select("_row.*")
    out = rows.join(_spark.sized_side(gone.unionByName(repeated)), ["id", "key"], "left_anti").select("_row")
    one = rows.join(_spark.sized_side(repeated), ["id", "key"], "left_semi").groupBy("id", "key").agg(F.min_by("_row", F.to_json(F.struct("_row"))).alias("_row"))
    return out.unionByName(one.select("_row")).select("_row.*")


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_groups(_spark.read(spark, sf_dir, "documents"))


SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9A-Za-z_\x{{80}}-\x{{10FFFF}}]+') AS ws FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {N - 1}, 1) + 1)) AS k FROM w WHERE len(ws) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + {N - 1}], ' ') AS gram FROM i),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
near AS MATERIALIZED (SELECT a, b FROM o JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= {THRESHOLD} - 1e-9),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
links AS (SELECT a, count(*) AS n FROM near GROUP BY a)
SELECT reach.a AS doc_id, min(reach.b) AS keep_id, CAST(coalesce(any_value(links.n), 0) AS BIGINT) AS n_links FROM reach LEFT JOIN links ON links.a = reach.a GROUP BY reach.a
"""
