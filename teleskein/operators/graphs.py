"""Traces and profiles: nested sets, structural joins, symbol tables and stacks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V


#: A trace of more spans is numbered by joins instead of in one Python call.
MOST_SPANS = 50_000
_ORDER = ("ts", "span_id", "parent_span_id")


def nested_sets(spans: DataFrame, most: int = MOST_SPANS) -> DataFrame:
    """Adds parent_id, nested_set_left and nested_set_right: preorder numbers within each trace. Children go by start, span id and parent's id; a span whose parent is missing is a root; spans of a cycle are roots by the same order. Spans are counted by trace at once, as traces of more than ``most`` take another way; all else is lazy."""
    known = spans.where("trace_id IS NOT NULL")
    sizes = known.groupBy("trace_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    large = sizes.collect()  # one of at least ``most`` spans
    if not large:
        return _sets_of_small(known)
    large = F.broadcast(spans.sparkSession.createDataFrame(large, sizes.schema))
    rest = known.join(large, "trace_id", "left_anti").select(*spans.columns)
    return _sets_of_large(known, large).unionByName(_sets_of_small(rest))


def _sets_of_small(spans: DataFrame) -> DataFrame:
    """Many traces per Python call."""
    names = spans.columns

    def number(frames):
        """Rows come by trace; the last trace of a batch may go on in the next, and its pieces are put together once."""
        rest: list[pd.DataFrame] = []
        for pdf in frames:
            if not len(pdf):
                continue
            trace = pdf["trace_id"].to_numpy()
            if rest and rest[0]["trace_id"].iloc[0] == trace[-1]:
                rest.append(pdf)
                continue
            cut = int((trace == trace[-1]).argmax())
            if rest or cut:
                yield _numbered(pd.concat([*rest, pdf.iloc[:cut]], ignore_index=True))
            rest = [pdf.iloc[cut:]]
        if rest:
            yield _numbered(pd.concat(rest, ignore_index=True))

    shape = ", ".join(f"`{n}` {t}" for n, t in spans.dtypes)
    placed = spans.repartition("trace_id").sortWithinPartitions("trace_id", *_ORDER)
    return placed.mapInPandas(number, f"{shape}, parent_id bigint, nested_set_left bigint, nested_set_right bigint").select(*names, "parent_id", "nested_set_left", "nested_set_right")


def _sets_of_large(spans: DataFrame, large: DataFrame) -> DataFrame:
    """Numbers by joins. Python sees but the frame of a trace, as numbers: spans that have children, and leaves that don't start after their parent, which may be roots if they hang on a cycle. Leaves beside it follow from what is before them. large: trace_id, _n."""
    names = spans.columns
    of_id = Window.partitionBy("trace_id", "span_id")
    named = F.col("parent_span_id").isNotNull() & (F.col("parent_span_id") != "")
    nodes = spans.join(large, "trace_id", "left_semi")
    asked = nodes.where(named).select("trace_id", F.col("parent_span_id").alias("span_id"), F.lit(True).alias("_asked")).distinct()
    nodes = nodes.withColumn("_asked", F.lit(False)).unionByName(asked, allowMissingColumns=True)
    nodes = nodes.withColumn("_d", F.row_number().over(of_id.orderBy("_asked", "ts", "parent_span_id")))  # children go to the first of an id
    nodes = nodes.withColumn("_inner", F.max("_asked").over(of_id) & (F.col("_d") == 1)).where(~F.col("_asked")).drop("_asked")
    above = nodes.where("_inner").select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_p"), F.col("ts").alias("_pts"))
    own = (F.col("_d") == 1) & (F.col("parent_span_id") == F.col("span_id"))
    # null-safe, so that no filter of nulls keeps the sides from sharing a shuffle
    rows = nodes.join(above, (F.col("trace_id") == F.col("_t")) & F.col("parent_span_id").eqNullSafe(F.col("_p")) & named & ~F.coalesce(own, F.lit(False)), "left")
    later = (F.col("ts") > F.col("_pts")) | ((F.col("ts") == F.col("_pts")) & (F.col("span_id") > F.col("_p")))
    rows = rows.withColumn("_framed", F.col("_inner") | (F.col("_p").isNotNull() & ~F.coalesce(later, F.lit(False)))).drop("_t", "_pts", "_inner")

    earlier = Window.partitionBy("trace_id", "_p").orderBy(*_ORDER, "_d").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.count_if(~F.col("_framed")).over(earlier))
    rows = rows.withColumn("_beside", F.last(F.when(F.col("_framed"), F.struct("span_id", "_d", "_before")), True).over(earlier))

    # counted from _before, and joined null-safe without a filter, so that this reads the shuffle of the windows
    leaves = rows.groupBy(F.col("trace_id").alias("_t"), F.col("_p").alias("_s")).agg(F.max(F.when(~F.col("_framed"), F.col("_before") + 1)).alias("_leaves"))
    frame = rows.where("_framed").select("trace_id", *_ORDER, "_d", "_p", "_before")
    frame = frame.join(leaves, (F.col("trace_id") == F.col("_t")) & F.col("span_id").eqNullSafe(F.col("_s")), "left").join(large, "trace_id")
    frame = frame.withColumn("_leaves", F.when((F.col("_d") == 1) & F.col("span_id").isNotNull(), F.coalesce("_leaves", F.lit(0))).otherwise(0).cast("bigint"))
    frame = frame.repartition("trace_id").sortWithinPartitions("trace_id", *_ORDER, "_d").select("trace_id", "span_id", "_d", "_p", "_before", "_leaves", "_n")
    types = dict(spans.dtypes)
    placed = frame.mapInArrow(_framed, f"_t {types['trace_id']}, _s {types['span_id']}, _sd int, _left bigint, _right bigint, _up bigint, _after bigint, _above bigint")

    framed, beside = F.col("_framed"), F.col("_beside").isNotNull()
    key = F.when(framed, F.col("span_id")).when(beside, F.col("_beside.span_id")).otherwise(F.col("_p"))
    key_d = F.when(framed, F.col("_d")).when(beside, F.col("_beside._d")).when(F.col("_p").isNotNull(), 1)
    rows = rows.withColumns({"_key": key, "_key_d": key_d})
    out = rows.join(placed, (F.col("trace_id") == F.col("_t")) & F.col("_key").eqNullSafe(F.col("_s")) & (F.col("_key_d") == F.col("_sd")), "left")
    first = F.col("_p").isNull()  # a root before any of the frame
    left = F.when(framed, F.col("_left")).when(beside, F.col("_after") + 2 * (F.col("_before") - F.col("_beside._before"))).when(first, 1 + 2 * F.col("_before")).otherwise(F.col("_left") + 1 + 2 * F.col("_before"))
    up = F.when(framed, F.col("_up")).when(beside, F.col("_above")).when(first, F.lit(-1)).otherwise(F.col("_left"))
    out = out.withColumns({"parent_id": up.cast("bigint"), "nested_set_left": left.cast("bigint")})
    return out.withColumn("nested_set_right", F.when(framed, F.col("_right")).otherwise(F.col("nested_set_left") + 1)).select(*names, "parent_id", "nested_set_left", "nested_set_right")


def _framed(batches):
    """Rows come by trace and in the order of siblings; only this trace's are held."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        trace = b.column(0)
        cuts = np.flatnonzero(pc.not_equal(trace.slice(1), trace.slice(0, len(trace) - 1)).to_numpy(zero_copy_only=False)) + 1 if len(trace) > 1 else []
        for begin, end in zip([0, *cuts], [*cuts, len(trace)]):
            piece = b.slice(begin, end - begin)
            if held and piece.num_rows and held[0].column(0)[0] != piece.column(0)[0]:
                yield from _framed_trace(held)
                held = []
            if piece.num_rows:
                held.append(piece)
    if held:
        yield from _framed_trace(held)


def _framed_trace(held: list[pa.RecordBatch]):
    t = pa.Table.from_batches(held)
    ints = lambda c: t[c].to_numpy()
    up = pc.fill_null(pc.index_in(t["_p"], value_set=t["span_id"], skip_nulls=True), -1).to_numpy()
    numbers = frame_preorder(up.astype("int64"), ints("_before"), ints("_leaves"), t["_n"][0].as_py())
    out = pa.table([t["trace_id"], t["span_id"], t["_d"], *map(pa.array, numbers)], names=["_t", "_s", "_sd", "_left", "_right", "_up", "_after", "_above"])
    yield from out.to_batches(max_chunksize=10_000)


def frame_preorder(parent: np.ndarray, before: np.ndarray, leaves: np.ndarray, total: int) -> tuple[np.ndarray, ...]:
    """(left, right, left of the parent or -1, where a leaf beside it goes on, that leaf's parent's left or -1) of each node of a frame; nodes come in the order of siblings. before: siblings outside of the frame that come first; leaves: children outside of it; total: spans of the trace."""
    n = len(parent)
    order = np.argsort(parent, kind="stable")
    count = np.bincount(parent + 1, minlength=n + 1)
    begin = np.cumsum(count) - count
    cut, seen = np.zeros(n, bool), np.zeros(n, bool)

    def levels(nodes):
        while len(nodes):
            seen[nodes] = True
            yield nodes
            c = count[nodes + 1]
            at = np.repeat(begin[nodes + 1] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            nodes = order[at]
            nodes = nodes[~cut[nodes]]

    def ahead(w, group):
        """Sum of what is ahead in the same group; groups are contiguous."""
        total = np.cumsum(w) - w
        new = np.concatenate([[True], group[1:] != group[:-1]])
        return total - total[np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))]

    trees = list(levels(order[: count[0]]))
    rings: list[np.ndarray] = []
    rest = np.flatnonzero(~seen)  # on a cycle or below one: a root is what precedes all above it
    if len(rest):
        local = np.zeros(n, "int64")
        local[rest] = np.arange(len(rest))
        jump, least = local[parent[rest]], np.arange(len(rest))
        for _ in range(len(rest).bit_length()):
            least, jump = np.minimum(least, least[jump]), jump[jump]
        roots = rest[least == np.arange(len(rest))]
        cut[roots] = True
        rings = list(levels(roots))
    size = 1 + leaves
    for nodes in [*reversed(trees[1:]), *reversed(rings[1:])]:
        np.add.at(size, parent[nodes], size[nodes])
    left = np.zeros(n, "int64")
    for k, nodes in enumerate(trees):
        left[nodes] = (left[parent[nodes]] if k else 0) + 1 + 2 * (before[nodes] + ahead(size[nodes], parent[nodes]))
    for k, nodes in enumerate(rings):
        s = size[nodes]
        left[nodes] = left[parent[nodes]] + 1 + 2 * (before[nodes] + ahead(s, parent[nodes])) if k else 1 + 2 * (total - s.sum() + np.cumsum(s) - s)
    above = np.where(parent >= 0, left[parent], -1)
    after = left + 2 * size
    if cut.any():
        w = np.where(cut, 0, size)[order]
        place = np.empty(n, "int64")
        place[order] = ahead(w, parent[order])
        after = np.where(cut, above + 1 + 2 * (before + place), after)
    return left, left + 2 * size - 1, np.where(cut, -1, above), after, above


def _numbered(pdf: pd.DataFrame) -> pd.DataFrame:
    traces, spans, parents = (pdf[c].tolist() for c in ("trace_id", "span_id", "parent_span_id"))
    left, right, up = [], [], []
    begin = 0
    while begin < len(traces):
        end = begin
        while end < len(traces) and traces[end] == traces[begin]:
            end += 1
        for whole, part in zip((left, right, up), preorder(spans[begin:end], parents[begin:end])):
            whole += part
        begin = end
    return pdf.assign(parent_id=up, nested_set_left=left, nested_set_right=right)


def preorder(spans: list, parents: list) -> tuple[list[int], list[int], list[int]]:
    """(left, right, left of the parent or -1) of each span of a trace; spans come in the order of siblings."""
    n = len(spans)
    at = {s: i for i, s in reversed(list(enumerate(spans)))}
    children: list[list[int]] = [[] for _ in range(n)]
    roots = []
    for i, parent in enumerate(parents):
        p = at.get(parent) if parent else None
        if p is None or p == i:
            roots.append(i)
        else:
            children[p].append(i)
    left, right, up = [0] * n, [0] * n, [-1] * n
    clock = 0
    for root in [*roots, *range(n)]:  # what no root reaches is on a cycle
        stack = [] if left[root] else [(root, False)]
        while stack:
            i, done = stack.pop()
            if not done and left[i]:
                continue
            clock += 1
            if done:
                right[i] = clock
                continue
            left[i] = clock
            stack.append((i, True))
            for c in reversed(children[i]):
                if not left[c]:
                    up[c] = i
                    stack.append((c, False))
    return left, right, [left[u] if u >= 0 else -1 for u in up]


def descendants(above: DataFrame, below: DataFrame, cell: int = 2 * MOST_SPANS) -> DataFrame:
    """(trace_id, ancestor, descendant): pairs by nested sets; an equi-join on the trace and a cell of its numbers, then the range. A span above is in every cell that it covers, so copies are fewer than pairs by a factor of the cell, and a task holds no more of a trace than a cell."""
    of = lambda x: F.call_function("div", F.col(x), F.lit(cell))
    a = above.select("trace_id", F.col("span_id").alias("ancestor"), F.col("nested_set_left").alias("_l"), F.col("nested_set_right").alias("_r"))
    a = a.withColumn("_cell", F.explode(F.sequence(of("_l"), of("_r"))))
    b = below.select("trace_id", F.col("span_id").alias("descendant"), F.col("nested_set_left").alias("_l2"), F.col("nested_set_right").alias("_r2"))
    return a.join(b.withColumn("_cell", of("_l2")), ["trace_id", "_cell"]).where("_l < _l2 AND _r2 < _r").select("trace_id", "ancestor", "descendant")


def children(spans: DataFrame) -> DataFrame:
    a, b = spans.select("trace_id", F.col("span_id").alias("parent")), spans.select("trace_id", F.col("span_id").alias("child"), F.col("parent_span_id").alias("parent"))
    return a.join(b, ["trace_id", "parent"])


def logs_for_traces(logs: DataFrame, spans: DataFrame) -> DataFrame:
    return logs.join(spans.select("trace_id").distinct(), "trace_id", "left_semi")


# profiles ---------------------------------------------------------------------------------------


def flatten_samples(profiles: DataFrame) -> DataFrame:
    """One row for each timestamp and value; without timestamps one row of the summed values at the profile's time."""
    rows = profiles.withColumn("_p", F.when(F.size(F.coalesce("timestamps", F.array().cast("array<bigint>"))) > 0, F.arrays_zip(F.col("timestamps").alias("t"), F.col("values").alias("v"))).otherwise(
        F.array(F.struct(F.col("time_nanos").alias("t"), F.aggregate("values", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("v")))
    ))
    return rows.select("*", F.explode("_p").alias("_e")).select(*[c for c in profiles.columns if c not in ("timestamps", "values", "time_nanos")], F.col("_e.t").alias("ts"), F.col("_e.v").alias("value"))


def linked_spans(samples: DataFrame, spans: DataFrame) -> DataFrame:
    """Profile samples with the span that they were taken in. samples and spans: trace_id, span_id."""
    return samples.where("trace_id IS NOT NULL").join(spans, ["trace_id", "span_id"])


def symbol_tables(stacks: DataFrame) -> dict[str, DataFrame]:
    """Content-addressed tables of frames. stacks: frames array<string>, leaf first, each 'function' or 'function:line'."""
    frames = stacks.select(F.explode("frames").alias("frame")).distinct()
    cut = frames.select("frame", F.split_part("frame", F.lit(":"), F.lit(1)).alias("name"), F.coalesce(F.try_element_at(F.split("frame", ":"), F.lit(2)).cast("bigint"), F.lit(0)).alias("line"))
    strings = cut.select(V.content_id(F.lit("string"), "name").alias("id"), F.col("name").alias("value")).dropDuplicates(["id"])
    functions = cut.select(V.content_id(F.lit("function"), V.content_id(F.lit("string"), "name")).alias("id"), V.content_id(F.lit("string"), "name").alias("name_id")).dropDuplicates(["id"])
    fid = V.content_id(F.lit("function"), V.content_id(F.lit("string"), "name"))
    locations = cut.select(V.content_id(F.lit("location"), fid, "line").alias("id"), fid.alias("function_id"), "line").dropDuplicates(["id"])
    return {"strings": strings, "functions": functions, "locations": locations}


def location_id(frame: Column) -> Column:
    name = F.split_part(frame, F.lit(":"), F.lit(1))
    line = F.coalesce(F.try_element_at(F.split(frame, ":"), F.lit(2)).cast("bigint"), F.lit(0))
    return V.content_id(F.lit("location"), V.content_id(F.lit("function"), V.content_id(F.lit("string"), name)), line)


def stack_totals(samples: DataFrame) -> DataFrame:
    """(id, location_ids, frames, value): values added up by stack. Frames are grouped as they are, so that each distinct stack is hashed once."""
    totals = samples.groupBy("frames").agg(F.sum("value").alias("value"))
    ids = totals.withColumn("location_ids", F.transform("frames", location_id))
    return ids.select(V.content_id(F.lit("stack"), F.array_join("location_ids", ",")).alias("id"), "location_ids", "frames", "value")


def stack_table(stacks: DataFrame) -> DataFrame:
    """(id, location_ids) of the distinct stacks."""
    return stack_totals(stacks.select("frames", F.lit(1).alias("value"))).select("id", "location_ids").dropDuplicates(["id"])


def resolve_stacks(stacks: DataFrame, symbols: dict[str, DataFrame]) -> DataFrame:
    """(stack_id, depth, function, line), leaf at depth 0. Catalyst picks the joins by the sizes of the tables."""
    at = stacks.select(F.col("id").alias("stack_id"), F.posexplode("location_ids").alias("depth", "location_id"))
    located = at.join(symbols["locations"].withColumnRenamed("id", "location_id"), "location_id")
    functions = located.join(symbols["functions"].withColumnRenamed("id", "function_id"), "function_id")
    return functions.join(symbols["strings"].select(F.col("id").alias("name_id"), F.col("value").alias("function")), "name_id").select("stack_id", "depth", "function", "line")


def union_symbols(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.dropDuplicates(["id"])
