import pytest
from pyspark.sql import functions as F

from teleskein.operators import lifecycle as L
from teleskein.plans.registry import ORACLE_SQL, QUERIES

from .oracle import check


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    check(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)


def test_sampling_is_unbiased(spark):
    """Under a steady load weights add up to what came in, second by second, but for chance."""
    second = 1_000_000_000
    rows = spark.range(20_000).selectExpr("'t' AS tenant", "CAST(id % 37 AS STRING) AS series_id", f"id * {second // 2000} AS ts", "1.0D AS value")
    out = L.sampled(rows, 100).groupBy(F.expr(f"ts div {second}").alias("at")).agg(F.sum("sf").alias("weight"), F.count(F.lit(1)).alias("kept")).collect()
    by = {r["at"]: (r["weight"], r["kept"]) for r in out}
    assert by[0] == (2000.0, 2000)
    assert all(50 <= kept <= 160 for at, (_, kept) in by.items() if at)
    assert sum(w for w, _ in by.values()) == pytest.approx(20_000, rel=0.1)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
