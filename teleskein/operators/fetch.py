"""Reading: matchers over labels, conditions over columns and attributes, windows, merges and top-N.

A predicate says what holds for a value and, apart from it, whether an absent one passes, as SQL's
NULL would drop rows that a negative matcher accepts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V


@dataclass(frozen=True)
class Predicate:
    """holds: of a present value; absent: the verdict on an absent one."""

    name: str
    holds: Callable[[Column], Column]
    absent: bool = False
    literal: str | None = None

    def on(self, value: Column) -> Column:
        return F.when(value.isNull(), F.lit(self.absent)).otherwise(self.holds(value))


def eq(name: str, value) -> Predicate:
    return Predicate(name, lambda c: c == F.lit(value), value == "")


def neq(name: str, value) -> Predicate:
    return Predicate(name, lambda c: c != F.lit(value), value != "")


def regex(name: str, pattern: str, negate: bool = False) -> Predicate:
    """Anchored at both ends; an absent value is judged as the empty string."""
    import re

    empty = re.fullmatch(pattern, "") is not None
    whole = f"^(?:{pattern})$"
    return Predicate(name, (lambda c: ~c.rlike(whole)) if negate else (lambda c: c.rlike(whole)), empty != negate)


def exists(name: str) -> Predicate:
    return Predicate(name, lambda c: F.lit(True))


def absent(name: str) -> Predicate:
    return Predicate(name, lambda c: F.lit(False), True)


def contains(name: str, literal: str) -> Predicate:
    return Predicate(name, lambda c: F.contains(c, F.lit(literal)), literal == "", literal)


def compare(name: str, op: str, value) -> Predicate:
    ops = {"<": lambda c: c < value, "<=": lambda c: c <= value, ">": lambda c: c > value, ">=": lambda c: c >= value, "=": lambda c: c == value, "!=": lambda c: c != value}
    return Predicate(name, ops[op], op == "!=")


def pushable(predicates: list[Predicate]) -> tuple[list[Predicate], list[Predicate]]:
    """(those that an index of present values can answer, those that accept absence)."""
    return [p for p in predicates if not p.absent], [p for p in predicates if p.absent]


@dataclass(frozen=True)
class Request:
    start: int | None = None
    end: int | None = None
    tenants: tuple[str, ...] = ()
    matchers: tuple[Predicate, ...] = ()
    conditions: tuple[Predicate, ...] = ()
    all_conditions: bool = True
    projection: tuple[str, ...] = ()
    limit: int = 0
    reverse: bool = False
    second_pass: Callable[[DataFrame], DataFrame] | None = field(default=None, compare=False)


def in_window(df: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Both ends belong to it."""
    if start is not None:
        df = df.where(F.col("ts") >= start)
    return df if end is None else df.where(F.col("ts") <= end)


def of_tenants(df: DataFrame, tenants) -> DataFrame:
    return df.where(F.col("tenant").isin(*tenants)) if tenants else df


def match_labels(df: DataFrame, matchers, labels: str = "labels") -> DataFrame:
    """Rows of which all matchers hold; an absent label is judged, not dropped."""
    tests = [m.on(F.col(labels)[m.name]) for m in matchers]
    return df.where(reduce(and_, tests)) if tests else df


def value_of(df: DataFrame, name: str, attrs: str = "attrs") -> Column:
    """A column of that name, else an attribute."""
    return F.col(f"`{name}`") if name in df.columns else F.col(attrs)[name] if attrs in df.columns else F.lit(None).cast("string")


def match_rows(df: DataFrame, conditions, attrs: str = "attrs") -> DataFrame:
    tests = [c.on(value_of(df, c.name, attrs)) for c in conditions]
    return df.where(reduce(and_, tests)) if tests else df


def project(df: DataFrame, names, always=("tenant", "stream_id", "ts")) -> DataFrame:
    """No names: all columns. Unknown names are skipped."""
    if not names:
        return df
    return df.select(*[c for c in dict.fromkeys([*always, *names]) if c in df.columns])


def freshest(samples: DataFrame, keys=("series_id", "ts"), order: str = "ingest_seq", columns=None) -> DataFrame:
    """One row for each (series, ts): the last written. An aggregate, so that it combines before the shuffle. columns: what is wanted beside the keys, by default all; what isn't named isn't carried."""
    if columns is not None:
        samples = samples.select(*keys, *columns, *([order] if order not in columns else []))
    rest = [c for c in samples.columns if c not in keys and (columns is None or c in columns)]
    best = samples.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_b"))
    return best.select(*[c if c in keys else F.col(f"_b.`{c}`").alias(c) for c in samples.columns if c in keys or c in rest])


def fetch_metrics(samples: DataFrame, series: DataFrame | None, request: Request, named: bool = False) -> DataFrame:
    """Samples of the series that match, merged; named adds their labels. Catalyst picks the join by the size of the series table."""
    rows = in_window(of_tenants(samples, request.tenants), request.start, request.end)
    if series is None:
        rows = match_labels(rows, request.matchers)
    elif request.matchers or named:
        chosen = match_labels(of_tenants(series, request.tenants), request.matchers).select("series_id", *(["labels"] if named else [])).dropDuplicates(["series_id"])
        rows = rows.join(chosen, "series_id", "inner" if named else "left_semi")
    return freshest(rows)


def fetch_split(samples: DataFrame, series: DataFrame | None, request: Request, step: int) -> DataFrame:
    """As fetch_metrics, one fetch for each sub-window of the grid; these don't overlap, so their results add up by union."""
    if request.start is None or request.end is None:
        raise ValueError("a window that is split has both ends")
    out, begin = None, request.start
    while begin <= request.end:
        end = min(begin - begin % step + step - 1, request.end)
        part = fetch_metrics(samples, series, replace(request, start=begin, end=end))
        out, begin = part if out is None else out.unionByName(part), end + 1
    return out if out is not None else fetch_metrics(samples, series, request)


def top_n(df: DataFrame, limit: int, reverse: bool = True) -> DataFrame:
    """The newest (or oldest) rows by ts, with all ties of the last. The boundary comes from a distributed top-N; no global sort."""
    if limit <= 0:
        return df
    edge = df.select("ts").orderBy(F.col("ts").desc() if reverse else F.col("ts").asc()).limit(limit)
    edge = edge.agg((F.min("ts") if reverse else F.max("ts")).alias("_edge"))
    return df.join(F.broadcast(edge), (F.col("ts") >= F.col("_edge")) if reverse else (F.col("ts") <= F.col("_edge"))).drop("_edge")  # one row


def fetch_records(records: DataFrame, request: Request, attrs: str = "attrs", labels: str = "labels") -> DataFrame:
    """Filter, second pass, limit, projection. Rows that agree are all kept."""
    rows = in_window(of_tenants(records, request.tenants), request.start, request.end)
    rows = match_labels(rows, request.matchers, labels)
    if request.all_conditions:
        rows = match_rows(rows, request.conditions, attrs)
    if request.second_pass:
        rows = request.second_pass(rows)
    return project(top_n(rows, request.limit, request.reverse), request.projection)


def with_tokens(records: DataFrame, text: str = "body") -> DataFrame:
    """Adds body_tokens, which lets substring search skip rows."""
    return records.withColumn(f"{text}_tokens", F.array_distinct(V.tokenize(text)))


def search(records: DataFrame, literal: str, text: str = "body") -> DataFrame:
    """Rows that contain the literal; where tokens are stored they are looked at first, and the text decides."""
    hits = F.contains(F.col(text), F.lit(literal))
    if f"{text}_tokens" in records.columns:
        for token in V.safe_tokens(literal):
            hits = F.array_contains(f"{text}_tokens", token) & hits
    return records.where(hits)


def by_id(records: DataFrame, column: str, value) -> DataFrame:
    return records.where(F.col(column) == F.lit(value))


def merge_metrics(*children: DataFrame) -> DataFrame:
    """Union of samples; of one (series, ts) the later child's, and in it the last written, stays."""
    return merge_ordered([c.withColumn("_child", F.lit(i)) for i, c in enumerate(children)])


def merge_ordered(children: list[DataFrame]) -> DataFrame:
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), children)
    return freshest(all_.withColumn("_order", F.struct("_child", "ingest_seq")), order="_order").drop("_order", "_child")


def merge_records(*children: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), children)


def split_windows(spark, start: int, end: int, interval: int) -> DataFrame:
    """(start, end): the window cut at multiples of interval, both ends inclusive."""
    first = start - start % interval
    grid = spark.range(0, (end - first) // interval + 1 if end >= start else 0).select((F.lit(first) + F.col("id") * F.lit(interval)).alias("b"))
    return grid.select(F.greatest("b", F.lit(start)).alias("start"), F.least(F.col("b") + F.lit(interval - 1), F.lit(end)).alias("end"))


class ResultCache:
    """Fetched DataFrames by request; only windows that end before ``fresh_after`` are kept, as newer ones may still change."""

    def __init__(self, size: int = 64):
        self.size, self.held = size, {}

    def get(self, key, end: int | None, fresh_after: int, make: Callable[[], DataFrame]) -> DataFrame:
        if end is None or end >= fresh_after:
            return make()
        if key in self.held:
            self.held[key] = self.held.pop(key)
            return self.held[key]
        while len(self.held) >= self.size:
            self.held.pop(next(iter(self.held))).unpersist()
        self.held[key] = make().persist(StorageLevel.MEMORY_AND_DISK)
        return self.held[key]


def in_order(df: DataFrame, keys=("series_id", "ts")) -> DataFrame:
    return df.orderBy(*keys)


def rank_in(df: DataFrame, keys, order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
