"""Range, step and sliding-window aggregates, counts, and the catalogue of series and labels."""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V


def partial(weighted: bool = False) -> list[Column]:
    """What is kept of samples; weighted multiplies by the sampling weight."""
    w = V.weight() if weighted else F.lit(1)
    return [
        (F.sum(w) if weighted else F.count(F.lit(1))).alias("count"),
        F.sum(F.col("value") * w if weighted else F.col("value")).alias("sum"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    ]


def combine() -> list[Column]:
    return [F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max")]


def finish(df: DataFrame) -> DataFrame:
    """Doubles, and the average."""
    return df.withColumns({c: F.col(c).cast("double") for c in ("sum", "min", "max")}).withColumn("avg", F.col("sum") / F.col("count"))


def range_agg(samples: DataFrame, by=("series_id",), weighted: bool = False) -> DataFrame:
    """Over the whole range; a series without samples has no row."""
    return finish(samples.groupBy(*by).agg(*partial(weighted)))


def step_agg(samples: DataFrame, step: int, by=("series_id",), weighted: bool = False) -> DataFrame:
    """In cells [b, b + step) of the absolute grid; step <= 0: one cell at 0."""
    start = V.floor_to("ts", step) if step > 0 else F.lit(0).cast("bigint")
    return finish(samples.withColumn("bucket_start", start).groupBy(*by, "bucket_start").agg(*partial(weighted)))


#: A cell is copied into its windows where these are no more than so many; else windows look up two running aggregates.
MOST_COPIES = 16


def window_agg(samples: DataFrame, step: int, window: int, anchor: int = 0, end: int | None = None, by=("series_id",), weighted: bool = False) -> DataFrame:
    """In windows (t - window, t] that end at anchor + k step and not after end; empty windows have no row.

    Samples are first added up in cells (b - g, b], g being the common divisor of step and window, so
    that borders of windows are borders of cells. Where a cell is in few windows it is copied into each.
    """
    phase, grain = V.phase_of(anchor, step), gcd(step, window)
    last = None if end is None else end - (end - phase) % step
    clip = lambda c: c if last is None else F.least(c, F.lit(last))
    cells = samples.withColumn("_b", V.ceil_to("ts", grain, phase % grain)).groupBy(*by, "_b").agg(*partial(weighted))
    cells = cells.withColumns({"_first": V.ceil_to("_b", step, phase), "_last": clip(V.floor_to(F.col("_b") + F.lit(window - grain), step, phase))})
    if window <= MOST_COPIES * step:
        spread = cells.where("_first <= _last").withColumn("window_end", F.explode(F.sequence("_first", "_last", F.lit(step))))
        return finish(spread.groupBy(*by, "window_end").agg(*combine()))
    return finish(_long_windows(cells, step, window, phase, by))


def _long_windows(cells: DataFrame, step: int, window: int, phase: int, by) -> DataFrame:
    """Of windows that hold many steps: no cell is copied into them.

    Time is cut in blocks as long as a window, so that a window is the end of one block and the beginning
    of the next. Aggregates that run from a block's beginning, and from its end, are looked up by the
    last cell at or before the window's end and the first one after its begin.
    """
    names = ["count", "sum", "min", "max"]
    run = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    block = lambda x: x - F.pmod(x, F.lit(window))
    cells = cells.withColumn("_k", block(F.col("_b")))
    own = [*by, "_k"]
    up, down = (Window.partitionBy(*own).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col("_b").asc(), F.col("_b").desc()))
    # ends of windows that hold a cell, each given by the last cell before it in its block: so hardly any twice
    nearer = F.lead("_first").over(Window.partitionBy(*own).orderBy("_b")) - F.lit(step)
    ends = cells.withColumn("_last", F.least("_last", F.coalesce(nearer, F.col("_last")))).where("_first <= _last")
    ends = ends.select(*by, F.explode(F.sequence("_first", "_last", F.lit(step))).alias("window_end")).distinct()

    def looked_up(way, order, k, at, query_first: bool) -> DataFrame:
        running = cells.select(*own, F.col("_b").alias("_at"), F.lit(1 if query_first else 0).alias("_tag"), F.lit(None).cast("bigint").alias("window_end"), F.struct(*[run[c](c).over(way).alias(c) for c in names]).alias("_v"))
        asked = ends.select(*by, k.alias("_k"), at.alias("_at"), F.lit(0 if query_first else 1).alias("_tag"), "window_end", F.lit(None).cast(running.schema["_v"].dataType).alias("_v"))
        before = Window.partitionBy(*own).orderBy(order, "_tag").rowsBetween(Window.unboundedPreceding, 0)
        found = running.unionByName(asked).withColumn("_v", F.last("_v", ignorenulls=True).over(before))
        return found.where("window_end IS NOT NULL AND _v IS NOT NULL").select(*by, "window_end", "_v.*")

    t = F.col("window_end")
    begin = looked_up(up, F.col("_at").asc(), block(t), t, False)
    rest = looked_up(down, F.col("_at").desc(), block(t) - F.lit(window), t - F.lit(window), True)
    return begin.unionByName(rest).groupBy(*by, "window_end").agg(*combine())


def merge_aggregates(*shards: DataFrame, by=("series_id",)) -> DataFrame:
    """Final merge of aggregates that shards made by themselves."""
    all_ = reduce(lambda a, b: a.unionByName(b), [s.drop("avg") for s in shards])
    return finish(all_.groupBy(*by).agg(*combine()))


def named(aggregates: DataFrame, series: DataFrame) -> DataFrame:
    return aggregates.join(series.select("series_id", "labels").dropDuplicates(["series_id"]), "series_id")


def count_series(samples: DataFrame) -> DataFrame:
    return samples.agg(F.countDistinct("series_id").alias("n_series"))


def count_by(samples: DataFrame, label: str, labels: str = "labels") -> DataFrame:
    """Series by a label's value; a series without it counts under the empty string."""
    return samples.groupBy(F.coalesce(F.col(labels)[label], F.lit("")).alias("label_value")).agg(F.countDistinct("series_id").alias("n_series"))


def label_values(series: DataFrame, name: str, labels: str = "labels") -> DataFrame:
    value = F.col(labels)[name]
    return series.where(value.isNotNull() & (value != "")).select(value.alias("value")).distinct().orderBy("value")


def label_names(series: DataFrame, labels: str = "labels") -> DataFrame:
    return series.select(F.explode(F.map_keys(labels)).alias("name")).distinct().orderBy("name")


def series_in_window(facts: DataFrame, start: int | None, end: int | None, key: str = "stream_id") -> DataFrame:
    from .fetch import in_window

    return in_window(facts, start, end).select(key).distinct()


#: Bits that say where an attribute key was found.
RESOURCE, SCOPE, RECORD = 1, 2, 4


def attribute_keys(**maps: Column) -> Column:
    """Array of (key, scope bit) of a row; maps: resource=, scope=, record=."""
    bits = {"resource": RESOURCE, "scope": SCOPE, "record": RECORD}

    def tagged(where: str, map_: Column) -> Column:
        return F.transform(F.map_keys(map_), lambda k: F.struct(k.alias("key"), F.lit(bits[where]).alias("scope")))

    return F.concat(*[tagged(where, m) for where, m in maps.items()])


def keys(records: DataFrame, **maps: Column) -> DataFrame:
    """(key, scopes): distinct keys, with the places where they occur OR-ed."""
    found = records.select(F.explode(attribute_keys(**maps)).alias("k"))
    return found.groupBy(F.col("k.key").alias("key")).agg(F.bit_or("k.scope").cast("bigint").alias("scopes")).orderBy("key")


def union_keys(*shards: DataFrame) -> DataFrame:
    """Keys of several inputs, each made by keys(): the places where one occurs are OR-ed."""
    return reduce(DataFrame.unionByName, shards).groupBy("key").agg(F.bit_or("scopes").alias("scopes")).orderBy("key")


def cardinality(series: DataFrame, top: int = 0, labels: str = "labels") -> DataFrame:
    """(name, n_series, n_values) by falling n_series, then name; top <= 0: all."""
    found = series.select("series_id", F.explode(labels).alias("name", "value"))
    out = found.groupBy("name").agg(F.countDistinct("series_id").alias("n_series"), F.countDistinct("value").alias("n_values")).orderBy(F.desc("n_series"), "name")
    return out.limit(top) if top > 0 else out


def approximate_cardinality(series: DataFrame, labels: str = "labels", error: float = 0.016) -> DataFrame:
    found = series.select(F.explode(labels).alias("name", "value"))
    return found.groupBy("name").agg(F.approx_count_distinct("value", error).alias("n_values"))


def parts(table: DataFrame) -> DataFrame:
    """A row for each file: rows, series and bounds."""
    return table.groupBy(F.col("_metadata.file_name").alias("part")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("series_id").alias("n_series"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.max("_metadata.file_size").alias("bytes")
    )


def series_stats(table: DataFrame) -> DataFrame:
    """A row for each series of each file: samples, bounds of time, and count, sum, least and greatest of values."""
    return finish(table.groupBy(F.col("_metadata.file_name").alias("part"), "series_id").agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), *partial()))


def efficiency(table: DataFrame) -> DataFrame:
    return parts(table).agg(F.sum("n_rows").alias("points"), F.sum("bytes").alias("bytes"), (F.sum("bytes") / F.sum("n_rows")).alias("bytes_per_point"))


def inspect(**tables: DataFrame) -> DataFrame:
    """(table, n_rows, min_ts, max_ts) of each."""
    each = [t.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts")) for name, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), each)
