"""Groups of documents that hang together by links, without a row for each link."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark


def least_of(i: np.ndarray, j: np.ndarray, m: int) -> np.ndarray:
    """The least member of each one's component."""
    low = np.arange(m)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id of each connected component. edges: (a, b). Rounds of hooking to the least neighbour; each halves long paths."""
    now = _spark.pin(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        ways = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours hang on the least; then small star: smaller ones do
        large = ways.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least_ = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least_, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = _spark.pin(small.unionByName(least_.select("a", F.col("m").alias("b"))).distinct())
        changed = after.join(now, ["a", "b"], "left_anti").limit(1).count() + now.join(after, ["a", "b"], "left_anti").limit(1).count()
        now = after
        if not changed:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))


def grouped(firsts: DataFrame, found: DataFrame) -> DataFrame:
    """(sid, links, row) of each class: how many documents each of its own is linked to, and the least row of all that hang together. firsts: (sid, copies, row) of each class of like documents, row being its least; found: (a, b, links), the links of class a that one task saw, to documents of other classes, and a class that a hangs together with."""
    links = found.groupBy(F.col("a").alias("sid")).agg(F.sum("links").alias("links"))
    roots = components(found.select("a", "b")).withColumnRenamed("id", "sid")
    sets = firsts.select("sid", "copies", "row").join(links, "sid", "left").join(roots, "sid", "left")
    sets = sets.select("sid", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.col("row"), "root")
    low = sets.groupBy(F.coalesce("root", "sid").alias("root")).agg(F.min("row").alias("row"))
    return _spark.table(sets.select("sid", "links", F.coalesce("root", "sid").alias("root")).join(low, "root").select("sid", "links", "row"))
