"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Lengths that occur once end their rows' search; of the rest, (length, prefix hash) pairs that
occur once do; only rows of the surviving pairs have their full content hashed (SHA-256).

Defined results: a null text equals nothing and its row is kept; empty texts are equal to each
other; a group's representative is its smallest id, nulls last; of rows that agree in id and text
exactly one is kept; an empty table gives an empty result; other columns play no part, whatever
their names, except that ties between kept rows of one id go by their JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _spark

PREFIX_BYTES = 64


def _length(text: Column) -> Column:
    return F.octet_length(text)


def _prefix(text: Column) -> Column:
    return F.xxhash64(F.substring(F.encode(text, "UTF-8"), 1, PREFIX_BYTES))


def _survivors(texts: DataFrame) -> DataFrame:
    """(_len, _pre) of groups that content has yet to tell apart. texts: one column, _text."""
    some = texts.where(F.col("_text").isNotNull()).withColumn("_len", _length(F.col("_text")))
    lengths = _spark.sized_side(some.groupBy("_len").count().where("count > 1").select("_len"))
    rest = some.join(lengths, "_len", "left_semi").withColumn("_pre", _prefix(F.col("_text")))
    return _spark.sized_side(rest.groupBy("_len", "_pre").count().where("count > 1").select("_len", "_pre"))


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"_len": _length(F.col("_text")), "_pre": _prefix(F.col("_text"))})


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: its id, keep_id (the group's representative), group_size, is_duplicate (it goes)."""
    base = docs.select(_spark.column(id_col).alias("_id"), _spark.column(text_col).alias("_text"))
    groups = _survivors(base.select("_text"))
    keyed = _keyed(base)
    alone = keyed.drop("_text").join(groups, ["_len", "_pre"], "left_anti").select(
        F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(False).alias("is_duplicate")
    )
    full = keyed.join(groups, ["_len", "_pre"], "left_semi").select("_id", "_len", "_pre", F.sha2("_text", 256).alias("_full"))
    same = Window.partitionBy("_len", "_pre", "_full")
    rank = F.row_number().over(same.orderBy(F.col("_id").asc_nulls_last()))
    found = full.select(
        F.col("_id").alias(id_col), F.min("_id").over(same).alias("keep_id"), F.count(F.lit(1)).over(same).alias("group_size"), (rank > 1).alias("is_duplicate")
    )
    return alone.unionByName(found)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Only rows of surviving groups are shuffled, and those combine before it."""
    base = docs.select(_spark.row_struct(docs).alias("_row"), _spark.column(id_col).alias("_id"), _spark.column(text_col).alias("_text"))
    groups = _survivors(base.select("_text"))
    keyed = _keyed(base)
    alone = keyed.select("_len", "_pre", "_row").join(groups, ["_len", "_pre"], "left_anti").select("_row")
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    tie = F.to_json(F.struct(*[F.col(f"_row.{_spark.quoted(c)}") for c in others])) if others else F.lit("")
    first = F.min_by("_row", F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), tie.alias("t")))
    found = keyed.join(groups, ["_len", "_pre"], "left_semi").groupBy("_len", "_pre", F.sha2("_text", 256).alias("_full")).agg(first.alias("_row")).select("_row")
    return alone.unionByName(found).select("_row.*")


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(_spark.read(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER g END AS keep_id,
       CASE WHEN text IS NULL THEN CAST(1 AS BIGINT) ELSE count(*) OVER g END AS group_size,
       text IS NOT NULL AND row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) > 1 AS is_duplicate
FROM documents WINDOW g AS (PARTITION BY text)
"""
