import json
import random

import pytest
from pyspark.sql import functions as F

from teleskein.functions import values as V
from teleskein.operators import aggregate as A
from teleskein.operators import fetch as R
from teleskein.operators import graphs as G
from teleskein.operators import lifecycle as L
from teleskein.sources import otlp
from teleskein.sources.tables import Store
from teleskein.streaming import ingest


@pytest.mark.parametrize("x,text", [(5.0, "5"), (1e21, "1e+21"), (1e20, "1e+20"), (1234567.0, "1.234567e+06"), (999999.5, "999999.5"), (0.0001, "0.0001"), (0.00001, "1e-05"), (-2.5, "-2.5"), (0.0, "0"), (float("inf"), "+Inf"), (123456.789, "123456.789"), (1.5e-7, "1.5e-07")])
def test_float_text(x, text):
    assert V.go_float(x) == text


def test_safe_tokens():
    assert V.safe_tokens("ab cd ef") == ["cd"]
    assert V.safe_tokens("ab cd", True, True) == ["ab", "cd"]
    assert V.safe_tokens(" x ") == ["x"]


@pytest.mark.parametrize("step,window,anchor", [(10, 30, 0), (10, 25, 3), (7, 7, 5), (5, 2, 0)])
def test_windows_equal_a_fold(spark, step, window, anchor):
    rng = random.Random(step)
    rows = [(rng.choice("ab"), rng.randint(-50, 120), float(rng.randint(0, 9)), i) for i in range(60)]
    end = 100
    want = {}
    for t in range(-200, end + 1):
        if (t - anchor) % step == 0:
            for s in "ab":
                v = [x[2] for x in rows if x[0] == s and t - window < x[1] <= t]
                if v:
                    want[s, t] = (len(v), sum(v), min(v), max(v))
    df = spark.createDataFrame(rows, "series_id string, ts long, value double, ingest_seq long")
    got = {(r["series_id"], r["window_end"]): (r["count"], r["sum"], r["min"], r["max"]) for r in A.window_agg(df, step, window, anchor, end).collect()}
    assert got == want


def test_predicates_judge_absence(spark):
    df = spark.createDataFrame([(1, {"a": "x"}), (2, {"a": ""}), (3, {})], "id int, labels map<string,string>")
    ids = lambda *m: [r["id"] for r in R.match_labels(df, m).orderBy("id").collect()]
    assert ids(R.eq("a", "x")) == [1]
    assert ids(R.neq("a", "x")) == [2, 3]
    assert ids(R.regex("a", "x|")) == [1, 2, 3]
    assert ids(R.regex("a", "x|", negate=True)) == []
    assert ids(R.exists("a")) == [1, 2]
    assert ids(R.absent("a")) == [3]
    assert ids(R.contains("a", "x")) == [1]


def test_preorder_of_cycles_and_missing_parents():
    left, right, up = G.preorder(["r", "a", "b", "x", "y", "z"], [None, "r", "r", "y", "x", "gone"])
    assert (left[0], right[0]) == (1, 6)
    assert up[1] == 1 and up[2] == 1 and up[5] == -1
    assert sorted([*left, *right]) == list(range(1, 13))


def test_nested_sets_of_a_deep_trace(spark):
    n = 3000
    df = spark.createDataFrame([("t", f"s{i:05d}", f"s{i - 1:05d}" if i else None, i) for i in range(n)], "trace_id string, span_id string, parent_span_id string, ts long")
    rows = {r["span_id"]: r for r in G.nested_sets(df).collect()}
    assert rows["s00000"]["nested_set_right"] == 2 * n
    assert rows[f"s{n - 1:05d}"]["nested_set_left"] == n


def test_rollup_keeps_the_weight_of_extremes(spark):
    df = spark.createDataFrame([("s", 1, 5.0, 2.0), ("s", 3, 1.0, 4.0), ("s", 12, 7.0, None)], "series_id string, ts long, value double, sf double")
    get = lambda agg: {(r["ts"], r["value"], r["sf"]) for r in L.downsample(df, [(10, 10, agg)]).collect()}
    assert get("min") == {(0, 1.0, 4.0), (12, 7.0, 1.0)}
    assert get("last") == {(0, 1.0, 4.0), (12, 7.0, 1.0)}
    assert get("sum") == {(0, 14.0, 1.0), (12, 7.0, 1.0)}
    assert get("count") == {(0, 6.0, 1.0), (12, 7.0, 1.0)}


def test_tiers_of_one_interval_keep_their_own_aggregation(spark):
    df = spark.createDataFrame([("s", 1, 5.0), ("s", 3, 1.0), ("s", 22, 9.0), ("s", 25, 2.0), ("s", 12, 4.0), ("s", 17, 6.0), ("s", 40, 3.0)], "series_id string, ts long, value double").withColumn("sf", F.lit(1.0))
    get = lambda *tiers: {(r["ts"], r["value"]) for r in L.downsample(df, list(tiers)).collect()}
    assert get((10, 10, "last"), (30, 10, "max")) == {(0, 1.0), (10, 6.0), (20, 9.0), (40, 3.0)}
    assert get((30, 10, "max"), (15, 10, "first"), (99, 0, "sum")) == {(0, 5.0), (10, 4.0), (20, 9.0), (40, 3.0)}  # a cell on the border goes by its oldest sample
    assert get() == {(r["ts"], r["value"]) for r in df.collect()}


@pytest.mark.parametrize("copies", [0, 16])
def test_long_windows_equal_copied_ones(spark, monkeypatch, copies):
    monkeypatch.setattr(A, "MOST_COPIES", copies)
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice([rng.randint(-80, 40), rng.randint(300, 330)]), float(rng.randint(0, 9))) for _ in range(40)]
    df = spark.createDataFrame(rows, "series_id string, ts long, value double")
    for step, window, anchor, end in ((5, 60, 3, 345), (7, 30, 0, None), (1, 9, 0, 320)):
        want = {}
        for t in range(-200, 500):
            for s in "ab":
                v = [x[2] for x in rows if x[0] == s and t - window < x[1] <= t]
                if v and (t - anchor) % step == 0 and (end is None or t <= end):
                    want[s, t] = (len(v), sum(v), min(v), max(v))
        got = [((r["series_id"], r["window_end"]), (r["count"], r["sum"], r["min"], r["max"])) for r in A.window_agg(df, step, window, anchor, end).collect()]
        assert len(got) == len(want) and dict(got) == want


def test_window_of_ten_thousand_steps(spark):
    df = spark.createDataFrame([("s", 0, 1.0), ("s", 9_999, 2.0), ("s", 10_000, 4.0)], "series_id string, ts long, value double")
    out = A.window_agg(df, 1, 10_000)
    assert "Generate" in out._jdf.queryExecution().toString()
    got = {r["window_end"]: (r["count"], r["sum"]) for r in out.collect()}
    assert len(got) == 20_000
    assert (got[0], got[9_999], got[10_000], got[19_998], got[19_999]) == ((1, 1.0), (2, 3.0), (2, 6.0), (2, 6.0), (1, 4.0))


def test_token_bucket(spark):
    s = 1_000_000_000
    df = spark.createDataFrame([("t", 0, 8), ("t", 1, 5), ("t", s, 9), ("t", 5 * s, 11)], "tenant string, arrived long, cost long")
    assert [r["allowed"] for r in L.rate_limited(df, 10.0).orderBy("arrived").collect()] == [True, False, True, False]


def test_store_round_trip(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    df = spark.createDataFrame([("t1", "a", {"x": "1"}, 1, 1.0, 1.0, 1), ("t2", "b", {"x": "2"}, 2, 2.0, 1.0, 2)], "tenant string, series_id string, labels map<string,string>, ts long, value double, sf double, ingest_seq long")
    store.write_metrics(df)
    store.write_metrics(df)
    assert store.read("series").count() == 2
    got = R.fetch_metrics(store.read("samples"), store.read("series"), R.Request(matchers=(R.eq("x", "1"),)))
    assert [(r["series_id"], r["value"]) for r in got.collect()] == [("a", 1.0)]
    assert A.parts(store.read("samples")).agg(F.sum("n_rows")).first()[0] == 4


def test_top_n_keeps_ties(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (3,)], "ts long")
    assert sorted(r["ts"] for r in R.top_n(df, 2).collect()) == [2, 2, 3]
    assert sorted(r["ts"] for r in R.top_n(df, 1, reverse=False).collect()) == [1]


def test_otlp_metrics(spark, tmp_path):
    attr = [{"key": "route", "value": {"stringValue": "/a"}}]
    doc = {"resourceMetrics": [{"resource": {"attributes": [{"key": "job", "value": {"stringValue": "svc"}}]}, "scopeMetrics": [{"scope": {"name": "lib"}, "metrics": [
        {"name": "g", "gauge": {"dataPoints": [{"attributes": attr, "timeUnixNano": "5", "asInt": "3"}, {"timeUnixNano": "6"}]}},
        {"name": "h", "histogram": {"aggregationTemporality": 2, "dataPoints": [{"timeUnixNano": "7", "count": "6", "sum": 9.5, "bucketCounts": ["1", "2", "3"], "explicitBounds": [1.0, 2.5]}]}},
        {"name": "e", "exponentialHistogram": {"dataPoints": [{"timeUnixNano": "8", "count": "7", "sum": 1.0, "scale": 0, "zeroCount": "1", "positive": {"offset": 0, "bucketCounts": ["2", "1"]}, "negative": {"offset": 0, "bucketCounts": ["2", "1"]}}]}},
        {"name": "s", "summary": {"dataPoints": [{"timeUnixNano": "9", "count": "4", "sum": 8.0, "quantileValues": [{"quantile": 0.5, "value": 2.0}]}]}},
    ]}]}]}
    (tmp_path / "m.json").write_text(json.dumps(doc) + "\n")
    points = otlp.metric_points(otlp.read(spark, str(tmp_path / "m.json"), otlp.METRICS))
    assert otlp.dropped_points(points).first()[0] == 1
    rows = {(r["name"], r["point"].get("le") or r["point"].get("quantile") or r["point"].get("route")): r["value"] for r in points.where("value IS NOT NULL").collect()}
    assert rows["g", "/a"] == 3.0
    assert [rows["h_bucket", le] for le in ("1", "2.5", "+Inf")] == [1.0, 3.0, 6.0]
    assert [rows["e_bucket", le] for le in ("-2", "-1", "0", "2", "4", "+Inf")] == [1.0, 3.0, 4.0, 6.0, 7.0, 7.0]
    assert rows["s", "0.5"] == 2.0 and rows["s_count", None] == 4.0
    samples = otlp.project_metrics(points)
    assert samples.where(F.col("labels")["job"] == "svc").count() == samples.count()


def _points(spark, path, *resources):
    path.write_text(json.dumps({"resourceMetrics": list(resources)}) + "\n")
    return otlp.metric_points(otlp.read(spark, str(path), otlp.METRICS))


def _text(key, value):
    return {"key": key, "value": {"stringValue": value}}


def test_identity_goes_by_level_and_type(spark, tmp_path):
    """One attribute of the resource, of the scope, of the point, and of another type or schema: as many series."""
    a, point = _text("a", "1"), {"timeUnixNano": "1", "asDouble": 1.0}

    def metric(**attributes):
        return [{"name": "m", "gauge": {"dataPoints": [point | attributes]}}]

    resources = [
        {"resource": {"attributes": [a]}, "scopeMetrics": [{"metrics": metric()}]},
        {"scopeMetrics": [{"metrics": metric(attributes=[a])}]},
        {"scopeMetrics": [{"scope": {"name": "", "attributes": [a]}, "metrics": metric()}]},
        {"scopeMetrics": [{"metrics": metric(attributes=[{"key": "a", "value": {"intValue": "1"}}])}]},
        {"schemaUrl": "u", "scopeMetrics": [{"metrics": metric(attributes=[a])}]},
        {"scopeMetrics": [{"schemaUrl": "u", "metrics": metric(attributes=[a])}]},
        {"scopeMetrics": [{"metrics": metric(attributes=[a, _text("a", "2")])}]},  # the second 'a' doesn't count
    ]
    ids = [r["series_id"] for r in otlp.project_metrics(_points(spark, tmp_path / "m.json", *resources)).collect()]
    assert len(ids) == 7 and len(set(ids)) == 6


def test_hostile_attribute_names_pass(spark, tmp_path):
    names = [_text(n, "x") for n in ("__name__", "__unit__", "le", "quantile")]
    metrics = [
        {"name": "g", "gauge": {"dataPoints": [{"timeUnixNano": "1", "asDouble": 1.0, "attributes": names}]}},
        {"name": "h", "histogram": {"dataPoints": [{"timeUnixNano": "1", "count": "1", "attributes": names, "bucketCounts": ["1", "0"], "explicitBounds": [1e7]}]}},
        {"name": "s", "summary": {"dataPoints": [{"timeUnixNano": "1", "count": "1", "sum": 1.0, "attributes": names, "quantileValues": [{"quantile": 0.5, "value": 2.0}]}]}},
    ]
    rows = otlp.project_metrics(_points(spark, tmp_path / "m.json", {"resource": {"attributes": names}, "scopeMetrics": [{"metrics": metrics}]})).collect()
    assert {r["labels"]["__name__"] for r in rows} == {"g", "h_count", "h_bucket", "s", "s_count", "s_sum"}
    assert {r["labels"]["le"] for r in rows if r["labels"]["__name__"] == "h_bucket"} == {"1e+07", "+Inf"}
    assert [r["labels"]["quantile"] for r in rows if r["labels"]["__name__"] == "s"] == ["0.5"]


def test_canonical_texts_of_values(spark, tmp_path):
    values = {
        "d": ({"doubleValue": 1e10}, "1e+10"), "h": ({"doubleValue": 2.0}, "2"), "i": ({"intValue": "7"}, "7"), "b": ({"boolValue": True}, "true"), "y": ({"bytesValue": "aGk="}, "hi"), "e": ({}, None),
        "l": ({"arrayValue": {"values": [{"stringValue": 'a"\n\u00e9'}, {"intValue": "2"}, {"doubleValue": 0.5}, {"arrayValue": {}}, {}]}}, '["a\\"\\né",2,0.5,[],]'),
        "m": ({"kvlistValue": {"values": [{"key": "z", "value": {"boolValue": False}}, {"key": "a", "value": {"stringValue": "x"}}, {"key": "a", "value": {"stringValue": "y"}}]}}, '{"a":"x","z":false}'),
    }
    log = {"timeUnixNano": "5", "body": values["m"][0], "attributes": [{"key": k, "value": v} for k, (v, _) in values.items()]}
    (tmp_path / "l.json").write_text(json.dumps({"resourceLogs": [{"scopeLogs": [{"scope": {"name": "lib"}, "logRecords": [log]}, {"scope": {"name": "other"}, "logRecords": [log]}]}]}) + "\n")
    rows = otlp.log_records(otlp.read(spark, str(tmp_path / "l.json"), otlp.LOGS)).collect()
    assert rows[0]["attrs"] == {k: text for k, (_, text) in values.items()}
    assert rows[0]["body"] == '{"a":"x","z":false}'
    assert {r["labels"]["otel.scope.name"] for r in rows} == {"lib", "other"} and len({r["stream_id"] for r in rows}) == 2


def test_a_trace_over_many_batches_is_numbered_once(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        spans = [("a", f"a{i}", "a0" if i else None, i) for i in range(40)] + [("b", f"b{i}", f"b{i - 1}" if i else None, i) for i in range(3)] + [("c", f"c{i}", "c0" if i else None, i) for i in range(15)]
        df = spark.createDataFrame(spans, "trace_id string, span_id string, parent_span_id string, ts long")
        got = {r["span_id"]: (r["nested_set_left"], r["nested_set_right"]) for r in G.nested_sets(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == 58
    assert (got["a0"], got["a1"], got["a39"], got["b0"], got["b2"], got["c0"], got["c14"]) == ((1, 80), (2, 3), (78, 79), (1, 6), (3, 4), (1, 30), (28, 29))


def test_stream_lateness_is_per_series(spark, tmp_path):
    rows = [("a", 100, 1.0, 1), ("a", 50, 1.0, 2), ("b", 10, 1.0, 3), ("a", 95, 1.0, 4)]
    schema = "series_id string, ts long, value double, ingest_seq long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    ingest.append_once(ingest.admit_stream(stream, 10), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r["ingest_seq"]: r["reason"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: None, 2: "late", 3: None, 4: None}
    batch = {r["ingest_seq"]: r["reason"] for r in L.lateness(spark.createDataFrame(rows, schema), 10).collect()}
    assert batch == got
