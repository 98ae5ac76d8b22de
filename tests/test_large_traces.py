import random

from teleskein.operators import graphs as G

SHAPE = "trace_id string, span_id string, parent_span_id string, ts bigint"


def _sets(spans, most):
    return sorted(map(repr, (tuple(r) for r in G.nested_sets(spans, most).collect())))


def _trace(rng, name, n):
    """Any parent, so that there are cycles, spans that are their own parents, missing parents, several spans of an id and equal times."""
    ids = [None if rng.random() < 0.03 else f"s{rng.randrange(n)}" for _ in range(n)]
    low = rng.random() < 0.5  # a tree, but for the odd span
    parents = [f"s{rng.randrange(max(1, i // 2) if low and rng.random() < 0.95 else n)}" if rng.random() < 0.9 else rng.choice([None, "", "gone", ids[i]]) for i in range(n)]
    if low:
        ids = [f"s{i}" if rng.random() < 0.95 else x for i, x in enumerate(ids)]
    return [(name, ids[i], parents[i], rng.choice([i, i, rng.randrange(n), None, 5])) for i in range(n)]


def test_large_traces_are_numbered_as_small_ones(spark):
    rng = random.Random(7)
    rows = [r for k in range(60) for r in _trace(rng, f"t{k}", rng.choice([1, 2, 3, 5, 9, 30, 80]))]
    rows += [(None, "a", None, 1), ("chain", "c0", None, 0), *[("chain", f"c{i}", f"c{i - 1}", -i) for i in range(1, 300)]]
    rows += [("ring", f"r{i}", f"r{(i + 1) % 40}", 40 - i) for i in range(40)] + [("ring", f"x{i}", f"r{i % 40}", i) for i in range(100)]
    rng.shuffle(rows)
    spans = spark.createDataFrame(rows, SHAPE).repartition(3).cache()
    want = _sets(spans, 10**9)
    assert len(want) == len(rows) - 1
    assert _sets(spans, 0) == want
    assert _sets(spans, 20) == want


def test_python_sees_but_the_frame_of_a_large_trace(spark):
    """300,000 leaves below 100 spans: what a Python worker holds doesn't grow with the leaves."""
    spans = spark.range(300_100).selectExpr("'t' AS trace_id", "CAST(id AS STRING) AS span_id", "CASE WHEN id >= 100 THEN CAST(id % 100 AS STRING) END AS parent_span_id", "id AS ts")
    out = G.nested_sets(spans)
    assert out.where("nested_set_right - nested_set_left = 6001 AND parent_id = -1").count() == 100
    assert out.selectExpr("count(DISTINCT nested_set_left) = 300100 AND max(nested_set_right) = 600200").first()[0]
    assert "mapinpandas" not in G._sets_of_large(spans, spark.createDataFrame([("t", 300_100)], "trace_id string, _n bigint"))._jdf.queryExecution().toString().lower()


def test_descendants_over_several_cells(spark):
    rng = random.Random(5)
    rows = [("a", f"s{i}", f"s{rng.randrange(i)}" if i else None, i) for i in range(60)] + [("b", f"s{i}", f"s{i - 1}", i) for i in range(20)]
    up = {(t, s): (t, p) for t, s, p, _ in rows}
    want = set()
    for t, s in up:
        at = up[t, s]
        while at in up:
            want.add((t, at[1], s))
            at = up[at]
    sets = G.nested_sets(spark.createDataFrame(rows, SHAPE))
    for cell in (1, 7, 10**6):
        got = [tuple(r) for r in G.descendants(sets, sets, cell).collect()]
        assert len(got) == len(want) and set(got) == want
