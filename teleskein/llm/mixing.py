"""Mixing sources to target weights by cube-method balanced sampling.

Each source's share of the token budget sets one inclusion probability for its documents. The
flight phase moves the vector of probabilities along null-space directions of the constraints
(document total and token total of the source), so both totals stay exact while documents become
0 or 1; a block of documents ends with at most two undecided. The undecided of many blocks fly
again together, level after level, until at most two are left in a source: the landing problem.

Defined results: a document's tokens are its runs of characters other than white space; null and
empty texts have none; a null source is a source of its own; rows that agree in id, source and
text are one unit, whose tokens add up, and are selected together; an empty table gives an empty
result. Random numbers come from hashes: the same table gives the same sample.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark

#: Share of all tokens that the sample should hold.
RATE = 0.5
#: Documents that fly together.
BLOCK = 4096
_EPS = 1e-9


def flight(p: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: sum(p) and sum(p * tokens) are as before; at most two are not 0 or 1."""
    p = p.astype(float).copy()
    wait = [i for i in range(len(p)) if _EPS < p[i] < 1 - _EPS]
    wait.reverse()
    draws = iter(rng.random(len(wait) + 3).tolist())
    act: list[int] = []
    value, size = p.tolist(), tokens.astype(float).tolist()
    while True:
        while len(act) < 3 and wait:
            act.append(wait.pop())
        if len(act) == 3:
            a, b, c = (size[i] for i in act)
            u = (c - b, a - c, b - a)  # orthogonal to (1, 1, 1) and to the tokens
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
        elif len(act) == 2 and size[act[0]] == size[act[1]]:
            u = (1.0, -1.0)
        else:
            break
        up = min((1 - value[i]) / d if d > 0 else -value[i] / d for i, d in zip(act, u) if d)
        down = min(value[i] / d if d > 0 else (value[i] - 1) / d for i, d in zip(act, u) if d)
        step = up if next(draws) * (up + down) < down else -down
        rest = []
        for i, d in zip(act, u):
            x = value[i] + step * d
            value[i] = 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x
            if 0 < value[i] < 1:
                rest.append(i)
        act = rest
    return np.array(value)


def land(p: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide what a flight left, keeping the document total to within one and each probability in expectation."""
    p = flight(p, tokens, rng)
    open_ = np.flatnonzero((p > 0) & (p < 1))
    level = np.cumsum(p[open_])
    u = rng.random()
    p[open_] = np.floor(level + u) - np.floor(np.concatenate([[0.0], level[:-1]]) + u)
    return p


def shares(tokens: dict, weights: dict | None, rate: float) -> dict:
    """Inclusion probability of each source: budget by target weight, what full sources can't take going to the others."""
    left = rate * sum(tokens.values())
    weight = {s: float((weights or {}).get(s, 0.0 if weights else 1.0)) for s in tokens}
    out = dict.fromkeys(tokens, 0.0)
    live = [s for s in tokens if weight[s] > 0 and tokens[s] > 0]
    for s in sorted(live, key=lambda s: tokens[s] / weight[s]):
        total = sum(weight[x] for x in live)
        take = min(tokens[s], left * weight[s] / total)
        out[s] = take / tokens[s]
        left -= take
        live.remove(s)
    return {s: (1.0 if s in out and out[s] > 1 - 1e-12 else out[s]) for s in tokens}


def _seed(*parts) -> np.random.Generator:
    import xxhash

    return np.random.default_rng(xxhash.xxh64_intdigest(repr(parts).encode()))


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(_k1, _k2, _id, _source, _tokens, _rows): rows that agree in id, source and text, as one."""
    text = F.col(text_col)
    key = [F.col(id_col), F.col(source_col), text, text.isNull()]
    rows = docs.select(
        F.xxhash64(*key).alias("_k1"), F.xxhash64(F.lit(1), *key[::-1]).alias("_k2"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint").alias("_tokens")
    )
    return rows.groupBy("_k1", "_k2").agg(F.first("_id").alias("_id"), F.first("_source").alias("_source"), F.sum("_tokens").alias("_tokens"), F.count(F.lit(1)).alias("_rows"))


def _step(final: bool, level: int):
    """What a block goes through at a level."""

    def fly(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["_k1", "_k2"], ignore_index=True)
        source = block["_source"][0]
        rng = _seed(level, None if pd.isna(source) else source, int(block["_block"][0]))
        block["_now"] = (land if final else flight)(block["_now"].to_numpy(), block["_tokens"].to_numpy(), rng)
        return block

    return fly


def cube_sample(found: DataFrame, weights: dict | None = None, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """Units with _p, the inclusion probability, and _take, whether it is selected. One row for each source comes to the driver."""
    spark = found.sparkSession
    found = _spark.pin(found)
    per = {r["_source"]: (r["t"], r["n"]) for r in found.groupBy("_source").agg(F.sum("_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    prob = shares({s: float(t) for s, (t, _) in per.items()}, weights, rate)
    for s, (t, _) in per.items():
        if not t:
            prob[s] = rate if (weights or {}).get(s, 0.0 if weights else 1.0) else 0.0  # a source of empty documents
    schema = f"_source {found.schema['_source'].dataType.simpleString()}, _prob double, _blocks bigint"
    table = spark.createDataFrame([(s, prob[s], max(1, math.ceil(n / block))) for s, (_, n) in per.items()], schema)
    table = F.broadcast(table) if sum(len(str(s)) + 48 for s in per) <= _spark.BROADCAST_BYTES else table
    joined = found.join(table.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    state = joined.withColumns({"_p": F.col("_prob"), "_now": F.col("_prob"), "_block": F.pmod(F.xxhash64("_k1", F.lit(5)), F.col("_blocks"))})
    columns = "_k1 bigint, _k2 bigint, _id {}, _source {}, _tokens bigint, _rows bigint, _prob double, _blocks bigint, _p double, _now double, _block bigint".format(*(found.schema[c].dataType.simpleString() for c in ("_id", "_source")))
    most = max([1, *(math.ceil(n / block) for _, n in per.values())])
    decided, level = None, 0
    while True:
        final = most == 1
        flown = _spark.pin(state.groupBy("_source", "_block").applyInPandas(_step(final, level), columns))
        done = flown if final else flown.where("_now <= 0 OR _now >= 1")
        decided = done if decided is None else decided.unionByName(done)
        if final:
            break
        fan = block // 2  # a block leaves two at most
        most = math.ceil(most / fan)
        state = flown.where("_now > 0 AND _now < 1").withColumn("_block", F.expr(f"_block div {fan}"))
        level += 1
    return decided.select("_k1", "_k2", "_id", "_source", "_tokens", "_rows", "_p", (F.col("_now") >= 1).alias("_take"))


def mix(docs: DataFrame, weights: dict | None = None, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The selected rows, with all their columns."""
    taken = cube_sample(units(docs, id_col, text_col, source_col), weights, rate).where("_take").select("_k1", "_k2")
    text = F.col(text_col)
    key = [F.col(id_col), F.col(source_col), text, text.isNull()]
    rows = docs.select(_spark.row_struct(docs).alias("_row"), F.xxhash64(*key).alias("_k1"), F.xxhash64(F.lit(1), *key[::-1]).alias("_k2"))
    return rows.join(_spark.sized_side(taken), ["_k1", "_k2"], "left_semi").select("_row.*")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """One row for each unit; the target gives every source the same share of half of all tokens."""
    found = cube_sample(units(_spark.read(spark, sf_dir, "documents")))
    return found.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"), F.col("_rows").alias("n_rows"), F.round("_p", 9).alias("inclusion_prob"), F.col("_take").alias("selected"))
