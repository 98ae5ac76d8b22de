import json

from pyspark.sql import functions as F

from teleskein.operators import graphs as G
from teleskein.operators import prom as P
from teleskein.operators import fetch as R
from teleskein.operators import aggregate as A
from teleskein.operators import lifecycle as L
from teleskein.sources import otlp, otlp_profiles
from teleskein.sources.tables import Store


def _document():
    dictionary = {
        "stringTable": ["", "cpu", "nanoseconds", "main", "work", "app.go", "bin/app", "route", "heap", "bytes"],
        "functionTable": [{}, {"nameStrindex": 3, "filenameStrindex": 5, "startLine": "10"}, {"nameStrindex": 4, "filenameStrindex": 5}],
        "mappingTable": [{}, {"filenameStrindex": 6}],
        "locationTable": [{}, {"mappingIndex": 1, "address": "16", "lines": [{"functionIndex": 1, "line": "12"}]}, {"lines": [{"functionIndex": 2, "line": "7"}, {"functionIndex": 99}]}],
        "stackTable": [{}, {"locationIndices": [2, 1]}],
        "linkTable": [{}, {"traceId": "AB", "spanId": "CD"}],
        "attributeTable": [{}, {"keyStrindex": 7, "value": {"stringValue": "/a"}}, {"keyStrindex": 7, "value": {"doubleValue": 0.5}}],
    }
    cpu = {"sampleType": {"typeStrindex": 1, "unitStrindex": 2}, "periodType": {"typeStrindex": 1, "unitStrindex": 2}, "timeUnixNano": "100", "period": "5", "attributeIndices": [2]}
    cpu["samples"] = [
        {"stackIndex": 1, "values": ["3", "4"], "timestampsUnixNano": ["101", "102"], "linkIndex": 1, "attributeIndices": [1]},
        {"stackIndex": 1, "values": ["5", "6"]},
        {"stackIndex": 77, "values": ["1"], "linkIndex": 55, "attributeIndices": [88]},
    ]
    heap = {"sampleType": {"typeStrindex": 8, "unitStrindex": 9}, "timeUnixNano": "100", "samples": [{"stackIndex": 1, "values": ["9"]}]}
    return {"dictionary": dictionary, "resourceProfiles": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "svc"}}]}, "scopeProfiles": [{"scope": {"name": "lib"}, "profiles": [cpu, heap]}]}]}


def _samples(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps(_document()) + "\n")
    return otlp_profiles.samples(otlp.read(spark, str(tmp_path / "p.json"), otlp_profiles.PROFILES))


def test_profiles_resolve_through_the_dictionary(spark, tmp_path):
    rows = _samples(spark, tmp_path).collect()
    got = sorted((r["labels"]["__sample_type__"], r["ts"], r["value"], len(r["frames"]), r["trace_id"], r["span_id"], r["attrs"].get("route")) for r in rows)
    # of a repeated key the first stays, and the sample's come first
    assert got == [("cpu", 100, 1, 0, None, None, "0.5"), ("cpu", 100, 11, 3, None, None, "0.5"), ("cpu", 101, 3, 3, "ab", "cd", "/a"), ("cpu", 102, 4, 3, "ab", "cd", "/a"), ("heap", 100, 9, 3, None, None, None)]
    assert len({r["stream_id"] for r in rows}) == 2 and {r["labels"]["service.name"] for r in rows} == {"svc"}
    frames = next(r["frames"] for r in rows if r["ts"] == 101)
    assert [(f["function"], f["file"], f["line"], f["address"], f["mapping"]) for f in frames] == [("work", "app.go", 7, 0, ""), ("", "", 0, 0, ""), ("main", "app.go", 12, 16, "bin/app")]


def test_profile_store_keeps_each_symbol_once(spark, tmp_path):
    rows, store = _samples(spark, tmp_path), Store(spark, str(tmp_path / "store"))
    store.write_profiles(rows)
    sizes = {n: store.read(f"symbols_{n}").count() for n in ("strings", "functions", "mappings", "locations", "stacks")}
    store.write_profiles(rows)
    assert {n: store.read(f"symbols_{n}").count() for n in sizes} == sizes
    assert sizes == {"strings": 5, "functions": 3, "mappings": 2, "locations": 3, "stacks": 2}
    symbols = store.symbols()
    resolved = G.resolve_stacks(symbols["stacks"], symbols)
    read = store.read("profile_samples").where("ts = 101").join(resolved, "stack_id").select("depth", "function", "line").distinct().orderBy("depth").collect()
    assert [(r["function"], r["line"]) for r in read] == [("work", 7), ("", 0), ("main", 12)]
    spans = spark.createDataFrame([("ab", "cd"), ("ab", "ef")], "trace_id string, span_id string")
    assert G.linked_spans(rows, spans).select("span_id", "value").orderBy("value").collect() == [("cd", 3), ("cd", 4)]


def test_spans_carry_events_and_links(spark, tmp_path):
    attr = lambda k, **v: {"key": k, "value": v}
    span = {
        "traceId": "AA", "spanId": "01", "name": "op", "startTimeUnixNano": "5", "endTimeUnixNano": "9", "attributes": [attr("x", doubleValue=2.5)],
        "events": [{"timeUnixNano": "6", "name": "e1", "attributes": [attr("n", doubleValue=1.0), attr("m", stringValue="z")], "droppedAttributesCount": 2}, {"timeUnixNano": "7", "name": "e2"}, {"timeUnixNano": "8", "name": "e3", "attributes": [attr("k", intValue="4")]}],
        "links": [{"traceId": "BB", "spanId": "02", "traceState": "s", "attributes": [attr("l", boolValue=True)]}],
    }
    child = {"traceId": "aa", "spanId": "02", "parentSpanId": "01", "name": "in", "startTimeUnixNano": "6", "endTimeUnixNano": "7"}
    (tmp_path / "t.json").write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span, child]}]}]}) + "\n")
    store = Store(spark, str(tmp_path / "store"))
    store.write_spans(otlp.span_records(otlp.read(spark, str(tmp_path / "t.json"), otlp.SPANS)))
    r, c = store.read("spans").orderBy("ts").collect()
    assert (r["duration"], r["attrs"], r["nested_set_left"], r["nested_set_right"], c["parent_id"]) == (4, {"x": "2.5"}, 1, 4, 1)
    assert [(e["ts"], e["name"], e["attrs"], e["dropped"]) for e in r["events"]] == [(6, "e1", {"n": "1", "m": "z"}, 2), (7, "e2", {}, 0), (8, "e3", {"k": "4"}, 0)]
    assert [(x["trace_id"], x["span_id"], x["trace_state"], x["attrs"]) for x in r["links"]] == [("bb", "02", "s", {"l": "true"})]
    assert c["events"] == [] and c["links"] == []


def test_engine_view_and_admission(spark, tmp_path):
    rows = [("t", f"s{i % 4}", {"__name__": "m", "k": str(i % 4)} if i % 4 else {"__name__": "m"}, i * 1_500_000, float(i), 1.0, i) for i in range(12)]
    df = spark.createDataFrame(rows, "tenant string, series_id string, labels map<string,string>, ts long, value double, sf double, ingest_seq long")
    out = P.select(df.drop("labels"), df, [R.regex("k", "[123]|")], 3, 15, ordered=True).collect()
    assert [r["series_id"] for r in out] == ["s0", "s1", "s2", "s3"]
    assert [(p["t"], p["v"]) for p in out[1]["points"]] == [(7, 5.0), (13, 9.0)]
    assert P.count_by(df, df, "k", [R.neq("k", "2")]).orderBy("label_value").collect() == [("", 1), ("1", 1), ("3", 1)]
    assert [r["name"] for r in P.label_names(df, [R.eq("k", "")]).collect()] == ["__name__"]
    assert out[1].asDict() and spark.createDataFrame(out).select(P.seek(F.col("points"), 10).alias("p")).where("size(p) > 1").count() == 0
    taken, tally = L.admit(df, hard=3, soft=1)
    assert tally.collect() == [(9, 3, "cardinality")]
    assert {(r["series_id"] == "s0", r["labels"].get("__overflow__")) for r in taken.collect()} == {(True, None), (False, "true")}
    store = Store(spark, str(tmp_path))
    store.write_metrics(df)
    stats = A.series_stats(store.read("samples")).groupBy("series_id").agg(F.sum("count").alias("n"), F.max("max").alias("m")).orderBy("series_id").collect()
    assert stats == [("s0", 3, 8.0), ("s1", 3, 9.0), ("s2", 3, 10.0), ("s3", 3, 11.0)]
    L.compact_metrics(store.read("samples").unionByName(store.read("samples")), str(tmp_path / "compacted"), cutoff=3_000_000, tiers=[(9_000_000, 4_500_000, "sum")])
    assert spark.read.parquet(str(tmp_path / "compacted")).agg(F.sum("value")).first()[0] == sum(range(2, 12))
