"""OTLP/JSON as rows: gauges, sums, histograms, summaries, logs and spans.

One document per line; readers get a fixed schema, so nothing is inferred. 64-bit integers are
strings in OTLP/JSON and cast here. Histograms of every kind become plain series.
"""

from __future__ import annotations

import base64
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import values as V

_ANY = "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double,bytesValue:string,arrayValue:string,kvlistValue:string>"
_ATTRS = f"array<struct<key:string,value:{_ANY}>>"
_NUMBER = f"struct<attributes:{_ATTRS},startTimeUnixNano:string,timeUnixNano:string,asDouble:double,asInt:string>"
_HIST = f"struct<attributes:{_ATTRS},timeUnixNano:string,count:string,sum:double,bucketCounts:array<string>,explicitBounds:array<double>>"
_BUCKETS = "struct<offset:int,bucketCounts:array<string>>"
_EXP = f"struct<attributes:{_ATTRS},timeUnixNano:string,count:string,sum:double,scale:int,zeroCount:string,zeroThreshold:double,positive:{_BUCKETS},negative:{_BUCKETS}>"
_SUMMARY = f"struct<attributes:{_ATTRS},timeUnixNano:string,count:string,sum:double,quantileValues:array<struct<quantile:double,value:double>>>"
_METRIC = (
    f"struct<name:string,unit:string,gauge:struct<dataPoints:array<{_NUMBER}>>,sum:struct<dataPoints:array<{_NUMBER}>,aggregationTemporality:int,isMonotonic:boolean>,"
    f"histogram:struct<dataPoints:array<{_HIST}>,aggregationTemporality:int>,exponentialHistogram:struct<dataPoints:array<{_EXP}>,aggregationTemporality:int>,summary:struct<dataPoints:array<{_SUMMARY}>>>"
)
_SCOPE = f"struct<name:string,version:string,attributes:{_ATTRS}>"
_LOG = f"struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,body:{_ANY},attributes:{_ATTRS},traceId:string,spanId:string,flags:bigint,droppedAttributesCount:bigint>"
_EVENT = f"struct<timeUnixNano:string,name:string,attributes:{_ATTRS},droppedAttributesCount:bigint>"
_LINK = f"struct<traceId:string,spanId:string,traceState:string,attributes:{_ATTRS},droppedAttributesCount:bigint>"
_SPAN = f"struct<events:array<{_EVENT}>,links:array<{_LINK}>,traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRS},status:struct<code:int,message:string>>"


def _schema(outer: str, inner: str, items: str, kind: str) -> str:
    return f"{outer} array<struct<resource:struct<attributes:{_ATTRS}>,schemaUrl:string,{inner}:array<struct<scope:{_SCOPE},schemaUrl:string,{items}:array<{kind}>>>>>"


METRICS = _schema("resourceMetrics", "scopeMetrics", "metrics", _METRIC)
LOGS = _schema("resourceLogs", "scopeLogs", "logRecords", _LOG)
SPANS = _schema("resourceSpans", "scopeSpans", "spans", _SPAN)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def go_quote(text: str) -> str:
    """Text in double quotes, with what can't be printed escaped."""
    short = {"\a": "\\a", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v", '"': '\\"', "\\": "\\\\"}

    def one(c: str) -> str:
        if c in short or c.isprintable():
            return short.get(c, c)
        n = ord(c)
        return f"\\x{n:02x}" if n < 0x80 else f"\\u{n:04x}" if n < 0x10000 else f"\\U{n:08x}"

    return f'"{"".join(map(one, text))}"'


def plain_text(value, inside: bool = False) -> str:
    """Canonical text of an OTLP value, as parsed JSON or as a row of the schema (there lists and maps are JSON text). inside: within a list or map."""
    if not value:
        return ""
    kind, x = next(((k, v) for k, v in value.items() if v is not None), (None, None))
    if kind in ("arrayValue", "kvlistValue"):
        values = (json.loads(x) if isinstance(x, str) else x).get("values") or []
        if kind == "arrayValue":
            return "[" + ",".join(plain_text(v, True) for v in values) + "]"
        first: dict = {}
        for e in values:
            first.setdefault(e.get("key", ""), e.get("value"))
        return "{" + ",".join(f"{go_quote(k)}:{plain_text(first[k], True)}" for k in sorted(first, key=lambda k: k.encode())) + "}"
    if kind == "doubleValue":
        return V.go_float(float(x))
    if kind == "boolValue":
        return "true" if x in (True, "true") else "false"
    text = "" if kind is None else base64.b64decode(x).decode("utf-8", "replace") if kind == "bytesValue" else str(x)
    return go_quote(text) if inside and kind in ("stringValue", "bytesValue") else text


_KINDS = ("stringValue", "boolValue", "intValue", "doubleValue", "bytesValue", "arrayValue", "kvlistValue")


def _texts_of(values) -> list[str | None]:
    return [plain_text(v) if v and any(x is not None for x in v.values()) else None for v in values]


@F.pandas_udf(ArrayType(StringType()))
def _rich_texts(lists: pd.Series) -> pd.Series:
    return lists.map(lambda values: None if values is None else _texts_of(values))


def _is_rich(v: Column) -> Column:
    return v["doubleValue"].isNotNull() | v["bytesValue"].isNotNull() | v["arrayValue"].isNotNull() | v["kvlistValue"].isNotNull()


def _simple_text(v: Column) -> Column:
    return F.coalesce(v["stringValue"], v["boolValue"].cast("string"), v["intValue"])


def texts(values: Column) -> Column:
    """Canonical texts of an array of values, null for empty ones. Only arrays that hold doubles, bytes, lists or maps go to Python, in Arrow batches."""
    return F.coalesce(_rich_texts(F.when(F.exists(values, _is_rich), values)), F.transform(values, _simple_text))


def any_text(v: Column) -> Column:
    """Canonical text of an OTLP value; null if it has none."""
    return F.get(texts(F.array(v)), F.lit(0))


def _firsts(list_: Column) -> Column:
    """Entries of which a key repeats count once, the first."""
    some = F.coalesce(list_, F.array().cast(_ATTRS))
    names = F.transform(some, lambda a: a["key"])
    return F.filter(some, lambda a, i: F.array_position(names, a["key"]) == i + 1)


def attributes(list_: Column) -> Column:
    """Map of canonical texts; of a repeated key the first stays."""
    first = _firsts(list_)
    return F.map_from_arrays(F.transform(first, lambda a: a["key"]), texts(F.transform(first, lambda a: a["value"])))


@F.pandas_udf(StringType())
def _rich_nested(rows: pd.Series) -> pd.Series:
    """Lists of lists go through JSON, as Arrow's way to pandas and back has no nested ones."""
    return rows.map(lambda text: None if text is None else json.dumps([_texts_of(values) for values in json.loads(text)["v"]]))


def nested_values(items: Column) -> Column:
    """Values of the attributes of an array of structs, a list for each."""
    return F.transform(items, lambda e: F.transform(_firsts(e["attributes"]), lambda a: a["value"]))


def nested_texts(values: str) -> Column:
    """Canonical texts of nested_values. values: the name of a column, as Spark fails to take a Python function of nested lambdas out of an expression."""
    lists = F.col(values)
    rich = F.exists(lists, lambda list_: F.exists(list_, _is_rich))
    found = F.from_json(_rich_nested(F.when(rich, F.to_json(F.struct(lists.alias("v"))))), "array<array<string>>")
    return F.coalesce(found, F.transform(lists, lambda list_: F.transform(list_, _simple_text)))


def _with_attributes(items: Column, texts_: str, struct) -> Column:
    """struct(item, map of its attributes) of each."""
    return F.zip_with(items, F.col(texts_), lambda e, t: struct(e, F.map_from_arrays(F.transform(_firsts(e["attributes"]), lambda a: a["key"]), t)))


def typed(list_: Column) -> Column:
    """Attributes as one text that tells types apart, in the order of keys: the number 1 is not the text '1'."""
    first = _firsts(list_)
    kind = lambda a: F.coalesce(*[F.when(a["value"][k].isNotNull(), F.lit(i)) for i, k in enumerate(_KINDS)], F.lit(-1))
    rows = F.arrays_zip(F.transform(first, lambda a: a["key"]).alias("k"), F.transform(first, kind).alias("t"), texts(F.transform(first, lambda a: a["value"])).alias("v"))
    return F.to_json(F.array_sort(rows))


def _leaves(df: DataFrame, outer: str, inner: str, items: str, keep=()) -> DataFrame:
    """Resource and scope with their identity by level, and each leaf. keep: columns of the document that go along."""
    r = df.select(*keep, F.explode(outer).alias("r"))
    r = r.select(*keep, attributes(F.col("r.resource.attributes")).alias("resource"), typed(F.col("r.resource.attributes")).alias("resource_id"), F.col("r.schemaUrl").alias("resource_schema"), F.explode(f"r.{inner}").alias("s"))
    s = r.select(*keep, "resource", "resource_id", "resource_schema", F.col("s.scope").alias("_scope"), F.col("s.schemaUrl").alias("scope_schema"), F.col(f"s.{items}").alias("_items"))
    s = s.withColumns({"_attrs": attributes(F.col("_scope.attributes")), "_typed": typed(F.col("_scope.attributes"))})
    scope = F.struct(F.col("_scope.name").alias("name"), F.col("_scope.version").alias("version"), F.col("scope_schema").alias("schema"), F.col("_attrs").alias("attributes"), F.col("_typed").alias("typed"))
    return s.select(*keep, "resource", "resource_id", "resource_schema", scope.alias("scope"), F.explode("_items").alias("x"))


def _identity(*more) -> Column:
    return V.identity("resource_id", "resource_schema", F.col("scope.name"), F.col("scope.version"), F.col("scope.schema"), F.col("scope.typed"), *more)


def _labels(point: Column | None = None) -> Column:
    return V.prom_labels(F.col("resource"), F.col("scope.name"), F.col("scope.version"), point if point is not None else F.create_map().cast("map<string,string>"), F.col("scope.attributes"))


def _points(leaves: DataFrame, kind: str) -> DataFrame:
    temporality = F.col(f"x.{kind}.aggregationTemporality") if kind in ("sum", "histogram", "exponentialHistogram") else F.lit(None).cast("int")
    monotonic = F.col("x.sum.isMonotonic") if kind == "sum" else F.lit(None).cast("boolean")
    rows = leaves.where(F.col(f"x.{kind}").isNotNull())
    return rows.select("resource", "resource_id", "resource_schema", "scope", F.col("x.name").alias("name"), F.col("x.unit").alias("unit"), F.lit(kind).alias("kind"), temporality.alias("temporality"), monotonic.alias("monotonic"), F.explode(f"x.{kind}.dataPoints").alias("p"))


_OUT = ["resource", "resource_id", "resource_schema", "scope", "name", "unit", "kind", "temporality", "monotonic"]


def numbers(leaves: DataFrame, kind: str) -> DataFrame:
    p = _points(leaves, kind)
    return p.select(*_OUT, attributes(F.col("p.attributes")).alias("point"), typed(F.col("p.attributes")).alias("point_id"), F.col("p.timeUnixNano").cast("bigint").alias("ts"), F.coalesce(F.col("p.asDouble"), F.col("p.asInt").cast("double")).alias("value"))


def _series(p: DataFrame, suffix: str, value: Column, extra: tuple[str, Column] | None = None) -> DataFrame:
    """extra: a label that the series adds; an attribute of its name gives way."""
    point, point_id = attributes(F.col("p.attributes")), typed(F.col("p.attributes"))
    if extra is not None:
        name, text = extra
        point = F.map_concat(F.map_filter(point, lambda k, v: k != name), F.create_map(F.lit(name), text))
        point_id = F.concat(point_id, F.lit(f" {name} "), text)
    return p.select(*[F.concat("name", F.lit(suffix)).alias("name") if c == "name" else c for c in _OUT], point.alias("point"), point_id.alias("point_id"), F.col("p.timeUnixNano").cast("bigint").alias("ts"), value.cast("double").alias("value"))


def cumulative(p: DataFrame, buckets: Column) -> DataFrame:
    """_bucket series from array<struct<le double, n double>> in rising order of le."""
    with_running = F.transform(F.sequence(F.lit(1), F.size(buckets)), lambda i: F.struct(buckets[i - 1]["le"].alias("le"), F.aggregate(F.slice(buckets, 1, i), F.lit(0.0), lambda a, b: a + b["n"]).alias("n")))
    rows = p.select("*", F.explode(with_running).alias("_b"))
    return _series(rows.withColumn("_le", V.float_text(F.col("_b.le"))), "_bucket", F.col("_b.n"), ("le", F.col("_le")))


def histograms(leaves: DataFrame) -> DataFrame:
    """_count, _sum and cumulative _bucket series; the last bound is +Inf."""
    p = _points(leaves, "histogram")
    infinity = F.lit(float("inf"))
    buckets = F.transform(F.col("p.bucketCounts"), lambda n, i: F.struct(F.coalesce(F.get(F.col("p.explicitBounds"), i), infinity).alias("le"), n.cast("double").alias("n")))
    full = p.where(F.size(F.coalesce(F.col("p.bucketCounts"), F.array().cast("array<string>"))) > 0)
    return reduce(DataFrame.unionByName, [_series(p, "_count", F.col("p.count")), _series(p.where("p.sum IS NOT NULL"), "_sum", F.col("p.sum")), cumulative(full, buckets)])


def exponential_bounds(scale: Column, offset: Column, counts: Column, negative: bool = False) -> Column:
    """array<struct<le, n>>; the bucket at index i ends at base ** (i + 1), base = 2 ** 2 ** -scale; a negative one at -(base ** i)."""
    base = F.pow(F.lit(2.0), F.pow(F.lit(2.0), -scale.cast("double")))
    some = F.coalesce(counts, F.array().cast("array<string>"))
    if negative:
        return F.transform(some, lambda n, i: F.struct((-F.pow(base, (offset + i).cast("double"))).alias("le"), n.cast("double").alias("n")))
    return F.transform(some, lambda n, i: F.struct(F.pow(base, (offset + i + 1).cast("double")).alias("le"), n.cast("double").alias("n")))


def exponential_histograms(leaves: DataFrame) -> DataFrame:
    """As histograms; negative, zero and positive buckets are sorted by bound before they add up."""
    p = _points(leaves, "exponentialHistogram")
    zero = F.array(F.struct(F.coalesce(F.col("p.zeroThreshold"), F.lit(0.0)).alias("le"), F.coalesce(F.col("p.zeroCount").cast("double"), F.lit(0.0)).alias("n")))
    sides = [exponential_bounds(F.col("p.scale"), F.coalesce(F.col(f"p.{s}.offset"), F.lit(0)), F.col(f"p.{s}.bucketCounts"), s == "negative") for s in ("negative", "positive")]
    top = F.array(F.struct(F.lit(float("inf")).alias("le"), F.lit(0.0).alias("n")))
    return reduce(DataFrame.unionByName, [_series(p, "_count", F.col("p.count")), _series(p.where("p.sum IS NOT NULL"), "_sum", F.col("p.sum")), cumulative(p, F.array_sort(F.concat(sides[0], zero, sides[1], top)))])


def summaries(leaves: DataFrame) -> DataFrame:
    p = _points(leaves, "summary")
    q = p.select("*", F.explode("p.quantileValues").alias("_q")).withColumn("_t", V.float_text(F.col("_q.quantile")))
    return reduce(DataFrame.unionByName, [_series(p, "_count", F.col("p.count")), _series(p, "_sum", F.col("p.sum")), _series(q, "", F.col("_q.value"), ("quantile", F.col("_t")))])


def metric_points(df: DataFrame) -> DataFrame:
    """(resource, scope, name, unit, kind, temporality, monotonic, point, ts, value); a point without value has null, so that it can be counted before it is dropped."""
    leaves = _leaves(df, "resourceMetrics", "scopeMetrics", "metrics")
    return reduce(DataFrame.unionByName, [numbers(leaves, "gauge"), numbers(leaves, "sum"), histograms(leaves), exponential_histograms(leaves), summaries(leaves)])


def project_metrics(points: DataFrame, tenant: Column | None = None) -> DataFrame:
    """samples with labels: identity goes by level (resource, scope, point, then name, unit, kind, temporality and monotonicity), labels fold it into one map."""
    kind, order = V.temporality("temporality"), F.col("monotonic")
    labels = V.fold_identity(_labels(F.col("point")), "name", "unit", "kind", kind, "monotonic")
    rows = points.where("value IS NOT NULL").withColumns({"labels": labels, "series_id": _identity("point_id", "name", "unit", "kind", kind, order)})
    return rows.select((tenant if tenant is not None else F.lit("default")).alias("tenant"), "series_id", "labels", "ts", "value", F.lit(1.0).alias("sf"))


def dropped_points(points: DataFrame) -> DataFrame:
    return points.agg(F.count_if(F.col("value").isNull()).alias("dropped"))


def log_records(df: DataFrame) -> DataFrame:
    x = _leaves(df, "resourceLogs", "scopeLogs", "logRecords")
    rows = x.withColumn("body", any_text(F.col("x.body")))
    return rows.select(
        F.lit("default").alias("tenant"), _identity().alias("stream_id"), _labels().alias("labels"), F.col("x.timeUnixNano").cast("bigint").alias("ts"), F.col("x.observedTimeUnixNano").cast("bigint").alias("observed"),
        F.col("x.severityNumber").alias("severity"), F.col("x.severityText").alias("severity_text"), F.coalesce("body", F.lit("")).alias("body"), F.lower("x.traceId").alias("trace_id"), F.lower("x.spanId").alias("span_id"),
        attributes(F.col("x.attributes")).alias("attrs"), F.col("x.flags").alias("flags"), F.col("x.droppedAttributesCount").alias("dropped"),
    )


def span_records(df: DataFrame) -> DataFrame:
    """Spans without nested sets; nested_sets() adds them."""
    x = _leaves(df, "resourceSpans", "scopeSpans", "spans")
    x = x.withColumns({"_events": F.coalesce(F.col("x.events"), F.array().cast(f"array<{_EVENT}>")), "_links": F.coalesce(F.col("x.links"), F.array().cast(f"array<{_LINK}>"))})
    x = x.withColumns({f"_{k}_values": nested_values(F.col(f"_{k}")) for k in ("events", "links")})
    x = x.withColumns({f"_{k}_texts": nested_texts(f"_{k}_values") for k in ("events", "links")})
    start, end = F.col("x.startTimeUnixNano").cast("bigint"), F.col("x.endTimeUnixNano").cast("bigint")
    return x.select(
        F.lit("default").alias("tenant"), _identity().alias("stream_id"), _labels().alias("labels"), start.alias("ts"), (end - start).alias("duration"), F.col("x.kind").alias("kind"),
        F.col("x.status.code").alias("status_code"), F.col("x.status.message").alias("status_message"), F.lower("x.traceId").alias("trace_id"), F.lower("x.spanId").alias("span_id"), F.lower("x.parentSpanId").alias("parent_span_id"),
        F.col("x.name").alias("name"), attributes(F.col("x.attributes")).alias("attrs"), _events().alias("events"), _links().alias("links"),
    )


def _dropped(e: Column) -> Column:
    return F.coalesce(e["droppedAttributesCount"], F.lit(0).cast("bigint")).alias("dropped")


def _events() -> Column:
    return _with_attributes(F.col("_events"), "_events_texts", lambda e, m: F.struct(e["timeUnixNano"].cast("bigint").alias("ts"), e["name"].alias("name"), m.alias("attrs"), _dropped(e)))


def _links() -> Column:
    return _with_attributes(F.col("_links"), "_links_texts", lambda e, m: F.struct(F.lower(e["traceId"]).alias("trace_id"), F.lower(e["spanId"]).alias("span_id"), e["traceState"].alias("trace_state"), m.alias("attrs"), _dropped(e)))
