"""Metrics as a query engine of the Prometheus kind asks for them: selectors, metadata and counts, in milliseconds.

A matcher judges an absent label as the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from . import aggregate as A
from . import fetch as R


def _request(matchers, start_ms: int | None, end_ms: int | None, tenants=()) -> R.Request:
    ns = lambda ms: None if ms is None else max(-V.MAX_NS, min(V.MAX_NS, ms * 1_000_000))
    return R.Request(matchers=tuple(matchers), start=ns(start_ms), end=ns(end_ms), tenants=tuple(tenants))


def label_set(labels: Column) -> Column:
    """Labels in the order of their names, by which series sort."""
    return F.array_sort(F.map_entries(labels))


def matched_series(series: DataFrame, matchers) -> DataFrame:
    """(series_id, labels) of the series that match, each once."""
    return R.match_labels(series, tuple(matchers)).select("series_id", "labels").dropDuplicates(["series_id"])


def select(samples: DataFrame, series: DataFrame, matchers, start_ms: int | None = None, end_ms: int | None = None, tenants=(), ordered: bool = False) -> DataFrame:
    """(series_id, labels, points) with points array<struct<t ms, v>> by rising time; ordered: by label set. A series without samples in the window has no row."""
    rows = R.fetch_metrics(samples, None, _request((), start_ms, end_ms, tenants)).join(matched_series(series, matchers).drop("labels"), "series_id", "left_semi")
    samples_of = F.array_sort(F.collect_list(F.struct("ts", F.col("value").cast("double").alias("v"))))  # by nanoseconds, as several may share a millisecond
    points = rows.groupBy("series_id").agg(samples_of.alias("points")).withColumn("points", F.transform("points", lambda p: F.struct(V.ns_to_ms(p["ts"]).alias("t"), p["v"].alias("v"))))
    out = points.join(matched_series(series, matchers), "series_id").select("series_id", "labels", "points")
    return out.orderBy(label_set(F.col("labels"))) if ordered else out


def seek(points: Column, t_ms: int) -> Column:
    """What of a series' points is at or after a time."""
    return F.filter(points, lambda p: p["t"] >= t_ms)


def label_values(series: DataFrame, name: str, matchers=()) -> DataFrame:
    return A.label_values(matched_series(series, matchers), name)


def label_names(series: DataFrame, matchers=()) -> DataFrame:
    return A.label_names(matched_series(series, matchers))


def series_labels(series: DataFrame, matchers=()) -> DataFrame:
    """(name, value, n_series) over the series that match."""
    return matched_series(series, matchers).select(F.explode("labels").alias("name", "value")).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n_series"))


def _active(samples: DataFrame, series: DataFrame, matchers, start_ms, end_ms) -> DataFrame:
    r = _request(matchers, start_ms, end_ms)
    live = R.in_window(samples, r.start, r.end).select("series_id").distinct()
    return matched_series(series, matchers).join(live, "series_id", "left_semi")


def count(samples: DataFrame, series: DataFrame, matchers=(), start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """n_series that match and have a sample in the window; samples themselves are never merged for it."""
    return _active(samples, series, matchers, start_ms, end_ms).agg(F.count(F.lit(1)).alias("n_series"))


def count_by(samples: DataFrame, series: DataFrame, label: str, matchers=(), start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """(label_value, n_series); a series without the label counts under the empty string."""
    return A.count_by(_active(samples, series, matchers, start_ms, end_ms), label)
