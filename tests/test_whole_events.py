import pytest
from pyspark.sql import functions as F

from teleskein.plans.registry import ORACLE_SQL, QUERIES

from .oracle import check

NAMES = ["window_agg_anchored_whole", "window_agg_misaligned_whole", "range_agg_open", "count_series_open"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sf_dir, name):
    check(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)


def test_all_events_are_aggregated(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert QUERIES["range_agg_open"](spark, sf_dir).agg(F.sum("count")).first()[0] == events.count()
    assert QUERIES["count_series_open"](spark, sf_dir).first()["n_series"] == events.select("event_type", "user_id").distinct().count()
    last = events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0] * 1000
    for name in NAMES[:2]:
        assert QUERIES[name](spark, sf_dir).agg(F.max("window_end")).first()[0] >= last
