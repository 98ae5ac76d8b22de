"""Scalar functions of the data model, as Spark columns.

Times are BIGINT nanoseconds. ANSI overflow throws, so conversions clamp. An absent value is NULL
and is not the empty string.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

RESERVED = ("__name__", "__unit__", "__kind__", "__temporality__", "__monotonic__")
MAX_NS = (1 << 63) - 1
AGGREGATIONS = ("last", "first", "min", "max", "sum", "avg", "count")
SIGNALS = {1: "metric", 2: "log", 3: "trace", 4: "profile"}


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# grids ------------------------------------------------------------------------------------------


def floor_to(ts, step: int, phase: int = 0) -> Column:
    """Start of the grid cell that holds ts; also right for negative times."""
    ts = _col(ts)
    return ts - F.pmod(ts - F.lit(phase), F.lit(step))


def ceil_to(ts, step: int, phase: int = 0) -> Column:
    ts = _col(ts)
    return ts + F.pmod(F.lit(phase) - ts, F.lit(step))


def phase_of(anchor: int, step: int) -> int:
    return anchor % step


def ms_to_ns(ms) -> Column:
    ms, most = _col(ms), MAX_NS // 1_000_000
    return F.when(ms > most, F.lit(MAX_NS)).when(ms < -most, F.lit(-MAX_NS)).otherwise(ms * F.lit(1_000_000))


def ns_to_ms(ns) -> Column:
    """The millisecond that holds a time, in whole numbers: doubles have no digits for 10^18 nanoseconds. Also right for negative times."""
    ns, step = _col(ns), F.lit(1_000_000).cast("bigint")
    return F.call_function("div", ns, step) - (ns % step < 0).cast("bigint")


def to_ns(ts) -> Column:
    """Nanoseconds of a timestamp with or without time zone; the session's zone must be UTC."""
    return F.unix_micros(_col(ts).cast("timestamp")) * F.lit(1000)


# text -------------------------------------------------------------------------------------------


def tokenize(text) -> Column:
    """Lower-cased maximal runs of ASCII letters and digits; extracted first, as lowering maps the Kelvin sign into ASCII."""
    return F.transform(F.regexp_extract_all(_col(text), F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda x: F.lower(x))


def count_tokens(text) -> Column:
    return F.regexp_count(_col(text), F.lit("[A-Za-z0-9]+"))


def attribute_tokens(attrs) -> Column:
    """What a filter of attributes indexes: of each its key with the whole value, and its key with each word of it."""
    pair = lambda key, x: F.concat(key, F.lit("\0"), x)
    each = F.transform(F.map_entries(_col(attrs)), lambda e: F.concat(F.array(pair(e["key"], e["value"])), F.transform(tokenize(e["value"]), lambda w: pair(e["key"], w))))
    return F.array_distinct(F.flatten(each))


def safe_tokens(literal: str, left_pinned: bool = False, right_pinned: bool = False) -> list[str]:
    """Tokens that every text containing the literal must have: those that can't continue beyond it."""
    out, at, n = [], 0, len(literal)
    word = lambda c: c.isascii() and c.isalnum()
    while at < n:
        if not word(literal[at]):
            at += 1
            continue
        end = at
        while end < n and word(literal[end]):
            end += 1
        if (at > 0 or left_pinned) and (end < n or right_pinned):
            out.append(literal[at:end].lower())
        at = end
    return out


def go_float(x: float | None) -> str | None:
    """Shortest text of a float in the form 'g': with an exponent where it is below -4 or above 5."""
    if x is None:
        return None
    x = float(x)
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    mantissa, _, exponent = f"{x!r}".lower().partition("e")
    sign, mantissa = ("-", mantissa[1:]) if mantissa[0] == "-" else ("", mantissa)
    whole, _, part = mantissa.partition(".")
    point = len(whole) + int(exponent or 0)
    digits = whole + part
    lead = len(digits) - len(digits.lstrip("0"))
    digits, point = digits.lstrip("0").rstrip("0"), point - lead
    if not -4 <= point - 1 < 6:
        e = point - 1
        return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'-' if e < 0 else '+'}{abs(e):02d}"
    if point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    if point >= len(digits):
        return sign + digits + "0" * (point - len(digits))
    return f"{sign}{digits[:point]}.{digits[point:]}"


@F.pandas_udf(StringType())
def float_text(values: pd.Series) -> pd.Series:
    """go_float over Arrow batches; each distinct value is formatted once."""
    known = {x: go_float(x) for x in values.dropna().unique()}
    return values.map(lambda x: "NaN" if isinstance(x, float) and math.isnan(x) else known.get(x), na_action="ignore")


def any_value_text(v: Column) -> Column:
    """Canonical text of struct<kind, s, b, i, d, y, j>; an empty value has none."""
    return (
        F.when(v["kind"] == 1, v["s"])
        .when(v["kind"] == 2, v["b"].cast("string"))
        .when(v["kind"] == 3, v["i"].cast("string"))
        .when(v["kind"] == 4, float_text(v["d"]))
        .when(v["kind"] == 5, F.base64(v["y"]))
        .when(v["kind"].isin(6, 7), v["j"])
    )


# identity ---------------------------------------------------------------------------------------


def content_id(*parts) -> Column:
    """128-bit content hash in hex; lengths go in, so that no two lists of parts look alike."""
    listed = F.array(*[_col(p).cast("string") for p in parts])  # in a lambda each part is computed once, however deep ids nest
    return F.md5(F.array_join(F.transform(listed, lambda p: F.concat(F.coalesce(F.length(p).cast("string"), F.lit("n")), F.lit(":"), F.coalesce(p, F.lit("")))), ""))


def series_id(labels: Column) -> Column:
    """Of a map of labels, whatever the order of its entries."""
    return content_id(map_text(labels))


def map_text(labels: Column) -> Column:
    """A map as text, whatever the order of its entries."""
    return F.to_json(F.array_sort(F.map_entries(labels)))


def identity(resource, resource_schema, scope_name, scope_version, scope_schema, scope_attributes, *more) -> Column:
    """Content id of an identity by level: resource, scope, and what the signal adds. Each level is delimited, so one attribute of the resource and the same of a point tell two series apart. Attributes: typed lists in order, as text."""
    empty = [F.coalesce(_col(x).cast("string"), F.lit("")) for x in (resource_schema, scope_name, scope_version, scope_schema)]
    return content_id(F.lit("identity"), resource, *empty, scope_attributes, *more)


def fold_identity(labels: Column, name, unit=None, kind=None, temporality=None, monotonic=None) -> Column:
    """The metric's identity as reserved labels beside its own; labels of these names give way."""
    pairs = zip(RESERVED, (name, unit, kind, temporality, monotonic))
    given = [x for key, v in pairs if v is not None for x in (F.lit(key), _col(v).cast("string"))]
    own = F.map_filter(labels, lambda k, v: ~k.isin(*given_names(name, unit, kind, temporality, monotonic)))
    return F.map_filter(F.map_concat(own, F.create_map(*given)), lambda k, v: v.isNotNull())


def given_names(*values) -> list[str]:
    return [key for key, v in zip(RESERVED, values) if v is not None]


def prom_labels(resource: Column, scope_name, scope_version, point: Column, scope_attributes: Column | None = None) -> Column:
    """One flat map; point wins over scope, scope over resource; reserved keys are hidden: fold_identity says what they are. The scope's own attributes go under otel.scope."""
    own = F.map_filter(F.create_map(F.lit("otel.scope.name"), _col(scope_name), F.lit("otel.scope.version"), _col(scope_version)), lambda k, v: v.isNotNull() & (v != ""))
    keep = lambda m, over: F.map_filter(m, lambda k, v: ~F.map_contains_key(over, k))
    scope = own
    if scope_attributes is not None:
        named = F.transform_keys(F.coalesce(scope_attributes, F.create_map().cast("map<string,string>")), lambda k, v: F.concat(F.lit("otel.scope."), k))
        scope = F.map_concat(own, keep(named, own))
    merged = F.map_concat(point, keep(scope, point))
    merged = F.map_concat(merged, keep(resource, merged))
    return F.map_filter(merged, lambda k, v: ~k.isin(*RESERVED))


def overflow_labels(name) -> Column:
    return F.create_map(F.lit("__name__"), _col(name), F.lit("__overflow__"), F.lit("true"))


def sample_hash(sid, ts) -> Column:
    """60 bits, the same in any engine that has MD5."""
    text = F.concat(_col(sid).cast("string"), F.lit(":"), _col(ts).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def shard_of(sid, shards: int) -> Column:
    return F.pmod(F.xxhash64(_col(sid)), F.lit(shards)).cast("int")


def tenant_scope(tenants: list[str]) -> str:
    return "*" if not tenants else ",".join(sorted(set(tenants)))


def weight(sf="sf") -> Column:
    return F.coalesce(_col(sf), F.lit(1.0))


def parse_aggregation(name: str) -> str:
    if name.lower() not in AGGREGATIONS:
        raise ValueError(f"no aggregation {name!r}; there are {', '.join(AGGREGATIONS)}")
    return name.lower()


def parse_signal(name: str) -> int:
    for number, known in SIGNALS.items():
        if name.lower() == known:
            return number
    raise ValueError(f"no signal {name!r}")


def temporality(code) -> Column:
    code = _col(code)
    return F.when(code == 1, "delta").when(code == 2, "cumulative").otherwise("unspecified")


@F.pandas_udf(DoubleType())
def _rounded(values: pd.Series, bits: pd.Series) -> pd.Series:
    import numpy as np

    m, e = np.frexp(values.to_numpy(float))
    scale = np.exp2(bits.to_numpy(float))
    return pd.Series(np.ldexp(np.round(m * scale) / scale, e))


def keep_bits(value, bits: int | Column) -> Column:
    """Value with so many significant bits of mantissa."""
    return _rounded(_col(value), bits if isinstance(bits, Column) else F.lit(bits))
