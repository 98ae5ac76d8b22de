from pyspark.sql import functions as F

from teleskein.functions import values as V
from teleskein.operators import prom as P
from teleskein.plans.registry import ORACLE_SQL, QUERIES

from .oracle import check


def test_milliseconds_are_exact(spark):
    """1704188235106 ms is 128 ns above the double below it, which a division takes for the millisecond before."""
    ms = list(range(1_704_188_235_100, 1_704_188_235_200))
    want = [(m * 1_000_000 + x, m) for m in [*ms, -2, -1, 0, 1] for x in (0, 1, 999_999)]
    got = spark.createDataFrame(want, "ns bigint, ms bigint").where(V.ns_to_ms("ns") != F.col("ms")).collect()
    assert got == []
    edge = spark.createDataFrame([(V.MAX_NS,), (-V.MAX_NS,)], "ns bigint").select(V.ns_to_ms("ns")).collect()
    assert [r[0] for r in edge] == [9_223_372_036_854, -9_223_372_036_855]


def test_points_of_one_millisecond_go_by_time(spark):
    rows = [("t", "a", {"k": "1"}, 5_000_100, 9.0, 1), ("t", "a", {"k": "1"}, 5_000_200, 1.0, 2), ("t", "a", {"k": "1"}, 4_999_999, 7.0, 3)]
    df = spark.createDataFrame(rows, "tenant string, series_id string, labels map<string,string>, ts bigint, value double, ingest_seq bigint")
    points = P.select(df.drop("labels"), df, []).first()["points"]
    assert [(p["t"], p["v"]) for p in points] == [(4, 7.0), (5, 9.0), (5, 1.0)]


def test_select_equals_its_sql_at_whole_milliseconds(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    whole = events.withColumn("ts", F.date_trunc("millisecond", "ts").cast("timestamp_ntz"))
    whole.write.parquet(str(tmp_path / "events.parquet"))
    for t in ("region nation customer supplier part orders lineitem documents embeddings pages benchmark labels conversations").split():
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    check(QUERIES["prom_select"](spark, str(tmp_path)), ORACLE_SQL["prom_select"], str(tmp_path))
