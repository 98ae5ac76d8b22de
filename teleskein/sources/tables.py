"""Tables at rest, and the views that map the bundled tables onto the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import graphs, lifecycle


class Store:
    """Tables of one root folder: samples, series, logs, spans, profile_samples; partitioned by tenant."""

    KEYS = {"samples": ("series_id", "ts"), "logs": ("stream_id", "ts"), "spans": ("stream_id", "ts"), "profile_samples": ("stream_id", "ts")}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, table: str, df: DataFrame) -> None:
        lifecycle.write_sorted(df, self.path(table), self.KEYS[table], mode="append", partition_by=("tenant",))

    def write_metrics(self, samples: DataFrame) -> None:
        """Samples go without labels; new series go to the dimension table."""
        self.write("samples", samples.drop("labels"))
        fresh = samples.select("tenant", "series_id", "labels").dropDuplicates(["tenant", "series_id"])
        if self.exists("series"):
            fresh = fresh.join(self.read("series").select("tenant", "series_id"), ["tenant", "series_id"], "left_anti")
        fresh.write.mode("append").partitionBy("tenant").parquet(self.path("series"))

    def write_spans(self, spans: DataFrame) -> None:
        """Spans with the nested sets of their traces, as far as the batch holds these."""
        self.write("spans", graphs.nested_sets(spans))

    def write_profiles(self, samples: DataFrame) -> None:
        """Samples with the ids of their stacks; symbols that aren't stored yet go to the tables symbols_*."""
        from . import otlp_profiles

        tables = otlp_profiles.symbols(samples)
        known = {name: self.read(f"symbols_{name}") for name in tables if self.exists(f"symbols_{name}")}
        for name, t in otlp_profiles.delta(tables, known).items():
            t.write.mode("append").parquet(self.path(f"symbols_{name}"))
        self.write("profile_samples", otlp_profiles.with_stacks(samples))

    def symbols(self) -> dict[str, DataFrame]:
        """Stored symbols; two writers may have stored one twice."""
        return {name: self.read(f"symbols_{name}").dropDuplicates(["id"]) for name in ("strings", "functions", "mappings", "locations", "stacks")}

    def exists(self, table: str) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(table))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, table: str, *tenants: str) -> DataFrame:
        df = self.spark.read.parquet(self.path(table))
        return df.where(F.col("tenant").isin(*tenants)) if tenants else df

    def reset(self, table: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(table))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a metric of labels event_type and user_id; tenant is the event type."""
    e = _read(spark, sf_dir, "events")
    labels = F.create_map(F.lit("__name__"), F.lit("event.value"), F.lit("event_type"), F.col("event_type"), F.lit("user_id"), F.col("user_id").cast("string"))
    sid = F.md5(F.concat_ws(",", F.lit("event.value"), "event_type", F.col("user_id").cast("string")))
    return e.select(F.col("event_type").alias("tenant"), sid.alias("series_id"), labels.alias("labels"), V.to_ns("ts").alias("ts"), F.col("value").cast("decimal(18,4)").alias("value"), F.lit(1.0).alias("sf"), F.col("event_id").alias("ingest_seq"))


def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a metric in which many samples share series and time; tenant is the line's status."""
    x = _read(spark, sf_dir, "lineitem")
    sid = F.md5(F.concat_ws(",", F.lit("line.price"), "l_returnflag", "l_linestatus"))
    labels = F.create_map(F.lit("__name__"), F.lit("line.price"), F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus"))
    return x.select(
        F.col("l_linestatus").alias("tenant"), sid.alias("series_id"), labels.alias("labels"), V.to_ns("l_shipdate").alias("ts"), F.col("l_extendedprice").cast("decimal(18,4)").alias("value"), F.lit(1.0).alias("sf"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ingest_seq"),
    )


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as logs of streams (lang, source); attributes quality and toxic only where there are labels."""
    d, x = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = d.join(x, "doc_id", "left")
    attrs = F.map_filter(F.create_map(F.lit("n_chars"), F.col("n_chars").cast("string"), F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string")), lambda k, v: v.isNotNull())
    return rows.select(
        F.col("lang").alias("tenant"), F.md5(F.concat_ws(",", "lang", "source")).alias("stream_id"), F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("labels"),
        F.col("doc_id").alias("ts"), F.col("n_chars").cast("int").alias("severity"), F.col("text").alias("body"), F.pmod("doc_id", F.lit(50)).cast("string").alias("trace_id"), attrs.alias("attrs"),
    )


def conversation_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations")
    return c.select(F.lit("chat").alias("tenant"), F.md5("role").alias("stream_id"), F.create_map(F.lit("role"), F.col("role")).alias("labels"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ts"), F.col("text").alias("body"), F.col("conv_id").cast("string").alias("trace_id"))


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace for each order: the order is the root, its lines are the children."""
    o, x = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem")
    root = o.select(F.col("o_orderkey").cast("string").alias("trace_id"), F.lit("o").alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.col("o_orderstatus").alias("name"), F.lit(0).cast("bigint").alias("ts"))
    number = F.row_number().over(_lines())
    lines = x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", number.alias("n"))
    child = lines.select(F.col("l_orderkey").cast("string").alias("trace_id"), F.col("n").cast("string").alias("span_id"), F.lit("o").alias("parent_span_id"), F.col("l_returnflag").alias("name"), F.col("n").cast("bigint").alias("ts"))
    return root.unionByName(child)


def _lines():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")


def place_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace for each region, three levels below it: nations, customers, orders."""
    r, n, c, o = (_read(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    none = F.lit(None).cast("string")
    cn = c.join(n, c["c_nationkey"] == n["n_nationkey"])
    levels = [
        r.select(F.col("r_name").alias("trace_id"), F.concat(F.lit("r"), "r_regionkey").alias("span_id"), none.alias("parent_span_id"), F.lit(0).cast("bigint").alias("ts")),
        n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("trace_id"), F.concat(F.lit("n"), "n_nationkey").alias("span_id"), F.concat(F.lit("r"), "r_regionkey").alias("parent_span_id"), F.col("n_nationkey").cast("bigint").alias("ts")),
        cn.join(r, cn["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("trace_id"), F.concat(F.lit("c"), "c_custkey").alias("span_id"), F.concat(F.lit("n"), "n_nationkey").alias("parent_span_id"), F.col("c_custkey").alias("ts")),
        o.join(cn, o["o_custkey"] == cn["c_custkey"]).join(r, F.col("n_regionkey") == r["r_regionkey"]).select(F.col("r_name").alias("trace_id"), F.concat(F.lit("o"), "o_orderkey").alias("span_id"), F.concat(F.lit("c"), "c_custkey").alias("parent_span_id"), F.col("o_orderkey").alias("ts")),
    ]
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def part_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile samples: the stack is brand below type, the value the quantity."""
    p, x = _read(spark, sf_dir, "part"), _read(spark, sf_dir, "lineitem")
    return x.join(p, x["l_partkey"] == p["p_partkey"]).select(F.array("p_brand", "p_type", F.lit("main")).alias("frames"), F.col("l_quantity").cast("bigint").alias("value"), F.col("l_returnflag").alias("sample_type"))
