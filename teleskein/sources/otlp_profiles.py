"""OTLP/JSON profiles as rows, resolved through their dictionary.

One document per line, whose dictionary is a set of arrays; indices are looked up within the row, so
nothing is joined. An index out of range gives nothing, so a malformed document doesn't fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import graphs as G
from . import otlp

_TYPE = "struct<typeStrindex:int,unitStrindex:int>"
_SAMPLE = "struct<stackIndex:int,values:array<string>,attributeIndices:array<int>,linkIndex:int,timestampsUnixNano:array<string>>"
_PROFILE = f"struct<sampleType:{_TYPE},periodType:{_TYPE},samples:array<{_SAMPLE}>,timeUnixNano:string,durationNano:string,period:string,profileId:string,attributeIndices:array<int>>"
_DICTIONARY = (
    f"struct<stringTable:array<string>,functionTable:array<struct<nameStrindex:int,systemNameStrindex:int,filenameStrindex:int,startLine:string>>,"
    f"mappingTable:array<struct<memoryStart:string,memoryLimit:string,fileOffset:string,filenameStrindex:int>>,"
    f"locationTable:array<struct<mappingIndex:int,address:string,lines:array<struct<functionIndex:int,line:string,column:string>>>>,stackTable:array<struct<locationIndices:array<int>>>,"
    f"linkTable:array<struct<traceId:string,spanId:string>>,attributeTable:array<struct<keyStrindex:int,value:{otlp._ANY},unitStrindex:int>>>"
)
PROFILES = otlp._schema("resourceProfiles", "scopeProfiles", "profiles", _PROFILE) + f", dictionary {_DICTIONARY}"
TYPE_LABELS = ("__sample_type__", "__sample_unit__", "__period_type__", "__period_unit__")


def _at(table: Column, index: Column) -> Column:
    """Entry of a dictionary's table, null if there is none."""
    return F.when(index >= 0, F.get(table, index))


def _number(x: Column) -> Column:
    return F.coalesce(x.cast("bigint"), F.lit(0).cast("bigint"))


def samples(df: DataFrame) -> DataFrame:
    """A row for each timestamp and value of a sample; without timestamps one of its summed values at the profile's time.

    (tenant, stream_id, labels, ts, value, period, duration, profile_id, frames, trace_id, span_id, attrs).
    The four strings of the profile's type belong to the stream's identity. frames, leaf first:
    struct<function, system, file, start_line, line, column, address, mapping>. attrs: those of the
    profile and of the sample, which wins. The first link of a dictionary stands for none.
    """
    leaves = otlp._leaves(df.withColumn("_d", F.col("dictionary")), "resourceProfiles", "scopeProfiles", "profiles", keep=("_d",))
    strings = F.col("_d.stringTable")
    text = lambda i: F.coalesce(_at(strings, i), F.lit(""))
    kinds = [F.col("x.sampleType.typeStrindex"), F.col("x.sampleType.unitStrindex"), F.col("x.periodType.typeStrindex"), F.col("x.periodType.unitStrindex")]
    rows = leaves.withColumn("_kinds", F.array(*[text(F.coalesce(k, F.lit(0))) for k in kinds])).withColumn("s", F.explode("x.samples"))
    values, stamps = F.transform("s.values", lambda v: v.cast("bigint")), F.transform("s.timestampsUnixNano", lambda t: t.cast("bigint"))
    rows = rows.withColumns({"values": F.coalesce(values, F.array().cast("array<bigint>")), "timestamps": F.coalesce(stamps, F.array().cast("array<bigint>")), "time_nanos": _number(F.col("x.timeUnixNano"))})
    link = F.col("s.linkIndex")
    linked = F.when(link > 0, F.get("_d.linkTable", link))
    named = F.transform(F.col("_d.attributeTable"), lambda a: F.struct(text(a["keyStrindex"]).alias("key"), a["value"].alias("value")))
    wanted = F.concat(F.coalesce(F.col("s.attributeIndices"), F.array().cast("array<int>")), F.coalesce(F.col("x.attributeIndices"), F.array().cast("array<int>")))
    chosen = F.filter(F.transform(wanted, lambda i: _at(F.coalesce(named, F.array().cast(otlp._ATTRS)), i)), lambda a: a.isNotNull())
    places = F.get("_d.stackTable", F.coalesce("s.stackIndex", F.lit(0)))["locationIndices"]

    def lines(place: Column) -> Column:
        location = _at(F.col("_d.locationTable"), place)
        mapping = text(_at(F.col("_d.mappingTable"), location["mappingIndex"])["filenameStrindex"])
        own = F.coalesce(location["lines"], F.array().cast("array<struct<functionIndex:int,line:string,column:string>>"))
        bare = F.array(F.lit(None).cast("struct<functionIndex:int,line:string,column:string>"))

        def frame(line: Column) -> Column:
            function = _at(F.col("_d.functionTable"), line["functionIndex"])
            return F.struct(
                text(function["nameStrindex"]).alias("function"), text(function["systemNameStrindex"]).alias("system"), text(function["filenameStrindex"]).alias("file"), _number(function["startLine"]).alias("start_line"),
                _number(line["line"]).alias("line"), _number(line["column"]).alias("column"), _number(location["address"]).alias("address"), mapping.alias("mapping"),
            )

        return F.transform(F.when(F.size(own) > 0, own).otherwise(bare), frame)

    frames = F.flatten(F.transform(F.coalesce(places, F.array().cast("array<int>")), lines))
    types = F.map_from_arrays(F.array(*[F.lit(k) for k in TYPE_LABELS]), F.col("_kinds"))
    flat = rows.select(
        F.lit("default").alias("tenant"), otlp._identity(F.array_join("_kinds", "\0")).alias("stream_id"), F.map_concat(F.map_filter(otlp._labels(), lambda k, v: ~k.isin(*TYPE_LABELS)), types).alias("labels"), "values", "timestamps", "time_nanos",
        _number(F.col("x.period")).alias("period"), _number(F.col("x.durationNano")).alias("duration"), F.col("x.profileId").alias("profile_id"), frames.alias("frames"), F.lower(linked["traceId"]).alias("trace_id"), F.lower(linked["spanId"]).alias("span_id"), otlp.attributes(chosen).alias("attrs"),
    )
    return G.flatten_samples(flat)


def symbols(rows: DataFrame) -> dict[str, DataFrame]:
    """Content-addressed tables of the frames of samples: strings, functions, mappings, locations, stacks. The same symbols of two batches have the same ids, so tables add up by union."""
    stacks = rows.select("frames").distinct()
    f = stacks.select(F.explode("frames").alias("f")).distinct().select("f.*")
    ids = {"name_id": "function", "system_name_id": "system", "file_id": "file"}
    f = f.withColumns({k: string_id(c) for k, c in ids.items()} | {"mapping_id": V.content_id(F.lit("mapping"), string_id("mapping"))})
    f = f.withColumn("function_id", V.content_id(F.lit("function"), "name_id", "system_name_id", "file_id", "start_line"))
    texts = f.select(F.explode(F.array("function", "system", "file", "mapping")).alias("value")).distinct()
    located = F.transform("frames", frame_id)
    return {
        "strings": texts.select(string_id("value").alias("id"), "value"),
        "functions": f.select(F.col("function_id").alias("id"), "name_id", "system_name_id", "file_id", "start_line").distinct(),
        "mappings": f.select(F.col("mapping_id").alias("id"), string_id("mapping").alias("file_id")).distinct(),
        "locations": f.select(V.content_id(F.lit("location"), "function_id", "mapping_id", "address", "line", "column").alias("id"), "mapping_id", "address", "function_id", "line", "column").distinct(),
        "stacks": stacks.select(located.alias("location_ids")).select(stack_id("location_ids").alias("id"), "location_ids").distinct(),
    }


def string_id(text) -> Column:
    return V.content_id(F.lit("string"), text)


def stack_id(location_ids) -> Column:
    return V.content_id(F.lit("stack"), F.array_join(location_ids, ","))


def frame_id(f: Column) -> Column:
    """Id of the location of a frame."""
    function = V.content_id(F.lit("function"), string_id(f["function"]), string_id(f["system"]), string_id(f["file"]), f["start_line"])
    return V.content_id(F.lit("location"), function, V.content_id(F.lit("mapping"), string_id(f["mapping"])), f["address"], f["line"], f["column"])


def with_stacks(rows: DataFrame) -> DataFrame:
    """Samples with stack_id in place of frames."""
    return rows.withColumn("stack_id", stack_id(F.transform("frames", frame_id))).drop("frames")


def delta(tables: dict[str, DataFrame], known: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Symbols that aren't known yet."""
    return {name: t.join(known[name].select("id"), "id", "left_anti") if name in known else t for name, t in tables.items()}
