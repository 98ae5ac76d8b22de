"""Rollups, retention, compaction, sampling and admission over tables at rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from .fetch import freshest


def _rolled(agg: str) -> tuple[Column, Column]:
    """(value, weight) of a cell. An extreme keeps the weight of its sample; folded ones have 1."""
    w, one = V.weight(), F.lit(1.0)
    value = F.col("value")
    return {
        "last": (F.max_by(value, F.col("ts")), F.max_by(w, F.col("ts"))),
        "first": (F.min_by(value, F.col("ts")), F.min_by(w, F.col("ts"))),
        "min": (F.min(value), F.min_by(w, F.struct(value, F.col("ts")))),
        "max": (F.max(value), F.min_by(w, F.struct(-value, F.col("ts")))),
        "sum": (F.sum(value * w), F.max(one)),
        "avg": (F.sum(value * w) / F.sum(w), F.max(one)),
        "count": (F.sum(w), F.max(one)),
    }[V.parse_aggregation(agg)]


def downsample(samples: DataFrame, tiers: list[tuple[int, int, str]]) -> DataFrame:
    """(series_id, ts, value, sf). tiers: (before, interval, aggregation), those without interval don't count; a sample older than several goes by the one with the least ``before``; newer ones stay.

    Cells are those of an interval: where tiers of one interval meet in a cell, the tier of its oldest
    sample says how all of it is combined. Where cells of two intervals begin together the finer stays.
    """
    tiers = sorted((t for t in tiers if t[1] > 0), key=lambda t: t[0])
    tier, interval = F.lit(len(tiers)), F.lit(0).cast("bigint")
    for k, (before, step, _) in reversed(list(enumerate(tiers))):
        older = F.col("ts") < before
        tier, interval = F.when(older, F.lit(k)).otherwise(tier), F.when(older, F.lit(step).cast("bigint")).otherwise(interval)
    tagged = samples.withColumns({"_tier": tier, "_iv": interval})
    start = F.when(F.col("_iv") > 0, F.col("ts") - F.pmod(F.col("ts"), F.greatest(F.col("_iv"), F.lit(1)))).otherwise(F.col("ts"))
    kinds = list(dict.fromkeys(["last", *(V.parse_aggregation(agg) for _, _, agg in tiers)]))
    rolled = {agg: _rolled(agg) for agg in kinds}
    cells = tagged.groupBy("series_id", "_iv", start.alias("_start")).agg(F.min("_tier").alias("_tier"), *[c[k].alias(f"_{agg}{k}") for agg, c in rolled.items() for k in (0, 1)])

    def chosen(k: int) -> Column:
        out = F.col(f"_last{k}")
        for at, (_, _, agg) in enumerate(tiers):
            out = F.when(F.col("_tier") == at, F.col(f"_{agg.lower()}{k}")).otherwise(out)
        return out

    out = cells.select("series_id", F.col("_start").alias("ts"), "_iv", chosen(0).alias("value"), chosen(1).alias("sf"))
    if len({step for _, step, _ in tiers}) < 2:
        return out.drop("_iv")
    best = out.groupBy("series_id", "ts").agg(F.min_by(F.struct("value", "sf"), F.col("_iv")).alias("b"))
    return best.select("series_id", "ts", "b.value", "b.sf")


def precision(samples: DataFrame, tiers: list[tuple[int, int]]) -> DataFrame:
    """Values with fewer significant bits the older they are. tiers: (before, bits); a sample older than several goes by the one with the least ``before``, newer ones stay."""
    bits = F.lit(None).cast("int")
    for before, n in sorted(tiers, reverse=True):
        bits = F.when(F.col("ts") < before, F.lit(n)).otherwise(bits)
    value = F.col("value").cast("double")
    return samples.withColumn("_bits", bits).withColumn("value", F.when(F.col("_bits").isNull(), value).otherwise(V.keep_bits(value, F.coalesce("_bits", F.lit(52))))).drop("_bits")


def compaction_groups(parts: DataFrame, fan: int = 4, most: int = 1 << 30) -> DataFrame:
    """Adds group: files of like size (by powers of fan) that are next to each other in time and begin within ``most`` bytes of each other; those that stay alone have null. parts: tenant, part, min_ts, bytes: a row for each file."""
    tier = F.floor(F.log(F.greatest(F.col("bytes"), F.lit(1)).cast("double")) / F.log(F.lit(float(fan)))).cast("int")
    order = Window.partitionBy("tenant", "_tier").orderBy("min_ts", "part")
    rows = parts.withColumn("_tier", tier).withColumn("_run", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_cell", F.floor((F.col("_run") - F.col("bytes")) / F.lit(most)))
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("tenant", "_tier", "_cell")))
    name = F.concat_ws("/", "tenant", F.col("_tier").cast("string"), F.col("_cell").cast("string"))
    return rows.withColumn("group", F.when(F.col("_n") > 1, name)).drop("_tier", "_run", "_cell", "_n")


def retain(df: DataFrame, cutoff: int) -> DataFrame:
    """Rows that are not older."""
    return df.where(F.col("ts") >= cutoff)


def size_cutoff(parts: DataFrame, budget: int) -> DataFrame:
    """One row, cutoff: newest parts stay within the budget, and the newest always does. parts: (max_ts, bytes), as many rows as files."""
    newest = Window.orderBy(F.col("max_ts").desc())
    ranked = parts.groupBy("max_ts").agg(F.sum("bytes").alias("bytes")).withColumns({"_run": F.sum("bytes").over(newest), "_n": F.row_number().over(newest)})
    return ranked.where((F.col("_run") > budget) & (F.col("_n") > 1)).agg(F.coalesce(F.max("max_ts") + 1, F.lit(0)).alias("cutoff"))


def compact_metrics(samples: DataFrame, path: str, cutoff: int | None = None, tiers=(), level: int = 3) -> None:
    """Merge, drop what is too old, roll up, and write sorted by series and time. path: a new folder; one that is being read can't be written."""
    rows = freshest(samples if cutoff is None else retain(samples, cutoff))
    if tiers:
        rows = downsample(rows, list(tiers))
    write_sorted(rows, path, ("series_id", "ts"), level)


def compact_records(records: DataFrame, path: str, cutoff: int | None = None, level: int = 3) -> None:
    write_sorted(records if cutoff is None else retain(records, cutoff), path, ("stream_id", "ts"), level)


def write_sorted(df: DataFrame, path: str, keys, level: int = 3, mode: str = "overwrite", partition_by=()) -> None:
    """Range-partitioned and sorted, so that footers' bounds let readers skip row groups."""
    out = df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).option(f"parquet.bloom.filter.enabled#{keys[0]}", "true")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def sampled(samples: DataFrame, budget: int, second: int = 1_000_000_000) -> DataFrame:
    """Lossy admission: in each second of a tenant one in sf samples stays, with weight sf = ceil(samples of the second before / budget)."""
    cell = V.floor_to("ts", second)
    seconds = samples.groupBy("tenant", cell.alias("_sec")).agg(F.count(F.lit(1)).alias("_n"))
    before = seconds.select("tenant", (F.col("_sec") + F.lit(second)).alias("_sec"), F.greatest(F.ceil(F.col("_n") / budget), F.lit(1)).alias("_sf"))
    rows = samples.withColumn("_sec", cell).join(before, ["tenant", "_sec"], "left").withColumn("_sf", F.coalesce("_sf", F.lit(1)))
    return rows.where(F.pmod(V.sample_hash("series_id", "ts"), F.col("_sf")) == 0).withColumn("sf", F.col("_sf").cast("double")).drop("_sec", "_sf")


def lateness(samples: DataFrame, allowed: int) -> DataFrame:
    """Adds reason: 'late' where a sample is older than its own series' newest one before it by more than allowed; else null. allowed <= 0: never late."""
    if allowed <= 0:
        return samples.withColumn("reason", F.lit(None).cast("string"))
    before = Window.partitionBy("series_id").orderBy("ingest_seq").rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max("ts").over(before)
    return samples.withColumn("reason", F.when(F.col("ts") < newest - F.lit(allowed), "late"))


def capped(samples: DataFrame, hard: int = 0, soft: int = 0) -> DataFrame:
    """Adds reason and overflow: of each tenant the first ``soft`` series by arrival stay themselves, further ones up to ``hard`` overflow, later ones are rejected; 0: no bound."""
    first = samples.groupBy("tenant", "series_id").agg(F.min("ingest_seq").alias("_first"))
    place = first.withColumn("_place", F.row_number().over(Window.partitionBy("tenant").orderBy("_first"))).drop("_first")
    rows = samples.join(place, ["tenant", "series_id"])
    reject = F.col("_place") > hard if hard else F.lit(False)
    return rows.withColumns({"reason": F.when(reject, "cardinality"), "overflow": (F.col("_place") > soft) & ~reject if soft else F.lit(False)}).drop("_place")


def overflowed(rows: DataFrame, name: str = "__name__") -> DataFrame:
    """What capped() lets in: rejected samples go, and those that overflow get the one identity of their metric's overflow series."""
    kept = rows.where(F.col("reason").isNull())
    folded = V.overflow_labels(F.coalesce(F.col("labels")[name], F.lit("")))
    labels = F.when(F.col("overflow"), folded).otherwise(F.col("labels"))
    sid = F.when(F.col("overflow"), V.series_id(folded)).otherwise(F.col("series_id"))
    return kept.withColumns({"labels": labels, "series_id": sid}).drop("reason", "overflow")


def admit(samples: DataFrame, allowed: int = 0, hard: int = 0, soft: int = 0) -> tuple[DataFrame, DataFrame]:
    """(samples to write, (accepted, rejected, reason) of the batch): what is late or beyond the cap is rejected with its reason."""
    judged = capped(lateness(samples, allowed).withColumnRenamed("reason", "_late"), hard, soft)
    judged = judged.withColumn("reason", F.coalesce("_late", "reason")).drop("_late")
    return overflowed(judged), accepted(judged)


def accepted(rows: DataFrame) -> DataFrame:
    """Partial success: (accepted, rejected, reason): the most frequent reason, with '+others' where there are more."""
    tally = rows.groupBy("reason").count()
    bad = F.col("reason").isNotNull()
    out = tally.agg(
        F.coalesce(F.sum(F.when(~bad, F.col("count"))), F.lit(0)).alias("accepted"),
        F.coalesce(F.sum(F.when(bad, F.col("count"))), F.lit(0)).alias("rejected"),
        F.max_by("reason", F.when(bad, F.struct("count", "reason"))).alias("reason"),
        F.count("reason").alias("_kinds"),
    )
    return out.withColumn("reason", F.when(F.col("_kinds") > 1, F.concat("reason", F.lit("+others"))).otherwise(F.col("reason"))).drop("_kinds")


def rate_limited(batches: DataFrame, rate: float) -> DataFrame:
    """Adds allowed: a token bucket of one second's burst for each tenant; a batch (tenant, arrived ns, cost) passes whole or not at all. State is carried in arrival order, so a tenant's batches go through one task."""
    import pandas as pd

    names = batches.columns

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("arrived", kind="stable")
        level, last, ok = rate, None, []
        for now, cost in zip(pdf["arrived"], pdf["cost"]):
            if last is not None:
                level = min(rate, level + (now - last) / 1e9 * rate)
            last = now
            ok.append(cost <= level)
            if ok[-1]:
                level -= cost
        return pdf.assign(allowed=ok)[[*names, "allowed"]]

    shape = ", ".join(f"`{n}` {t}" for n, t in batches.dtypes)
    return batches.groupBy("tenant").applyInPandas(go, f"{shape}, allowed boolean")
