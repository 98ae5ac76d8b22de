"""Queries of the library over the bundled tables, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import aggregate as A
from ..operators import fetch as R
from ..operators import graphs as G
from ..operators import lifecycle as L
from ..operators import prom as P
from ..sources import tables as T

SECOND = 1_000_000_000
HOUR, DAY = 3600 * SECOND, 86400 * SECOND
T0 = 1_704_067_200 * SECOND  # 2024-01-01
END = T0 + 20 * DAY

QUERIES: dict = {}
ORACLE_SQL: dict = {}

EVENTS = "ev AS (SELECT event_type AS tenant, md5(concat_ws(',', 'event.value', event_type, CAST(user_id AS VARCHAR))) AS series_id, event_type, user_id, epoch_us(ts) * 1000 AS ts, CAST(value AS DECIMAL(18,4)) AS value, event_id AS ingest_seq FROM events)"
LINES = "li AS (SELECT l_linestatus AS tenant, md5(concat_ws(',', 'line.price', l_returnflag, l_linestatus)) AS series_id, l_returnflag, epoch_us(l_shipdate) * 1000 AS ts, CAST(l_extendedprice AS DECIMAL(18,4)) AS value, l_orderkey * 100 + l_linenumber AS ingest_seq FROM lineitem)"
LOGS = "lb AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id), lg AS (SELECT d.doc_id AS ts, d.text AS body, d.lang, d.source, d.n_chars, quality, toxic, md5(concat_ws(',', d.lang, d.source)) AS stream_id FROM documents d LEFT JOIN lb ON d.doc_id = lb.doc_id)"
AGG = "CAST(count(*) AS BIGINT) AS count, CAST(sum(value) AS DOUBLE) AS sum, CAST(min(value) AS DOUBLE) AS min, CAST(max(value) AS DOUBLE) AS max, CAST(sum(value) AS DOUBLE) / count(*) AS avg"


def _floor(x: str, step: int) -> str:
    return f"({x} - ((({x}) % {step}) + {step}) % {step})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# aggregates -------------------------------------------------------------------------------------

_WINDOWS = "SELECT tenant, t AS window_end, {agg} FROM ev JOIN (SELECT unnest(range({first}, {end} + 1, {step})) AS t) g ON ev.ts > t - {window} AND ev.ts <= t GROUP BY tenant, t"


@query(f"WITH {EVENTS} " + _WINDOWS.format(agg=AGG, first=T0, end=T0 + 40 * DAY, step=6 * HOUR, window=DAY))
def window_agg(spark, sf):
    return A.window_agg(T.event_samples(spark, sf), 6 * HOUR, DAY, end=T0 + 40 * DAY, by=("tenant",))


@query(f"WITH {EVENTS} " + _WINDOWS.format(agg=AGG, first=T0 + 1800 * SECOND, end=END, step=12 * HOUR, window=2 * DAY))
def window_agg_anchored(spark, sf):
    return A.window_agg(T.event_samples(spark, sf), 12 * HOUR, 2 * DAY, anchor=T0 + 1800 * SECOND, end=END, by=("tenant",))


@query(f"WITH {EVENTS} " + _WINDOWS.format(agg=AGG, first=T0 + 1800 * SECOND, end=T0 + 40 * DAY, step=12 * HOUR, window=2 * DAY))
def window_agg_anchored_whole(spark, sf):
    return A.window_agg(T.event_samples(spark, sf), 12 * HOUR, 2 * DAY, anchor=T0 + 1800 * SECOND, end=T0 + 40 * DAY, by=("tenant",))


@query(f"WITH {EVENTS} " + _WINDOWS.format(agg=AGG, first=T0, end=END, step=6 * HOUR, window=15 * HOUR))
def window_agg_misaligned(spark, sf):
    return A.window_agg(T.event_samples(spark, sf), 6 * HOUR, 15 * HOUR, end=END, by=("tenant",))


@query(f"WITH {EVENTS} " + _WINDOWS.format(agg=AGG, first=T0, end=T0 + 40 * DAY, step=6 * HOUR, window=15 * HOUR))
def window_agg_misaligned_whole(spark, sf):
    return A.window_agg(T.event_samples(spark, sf), 6 * HOUR, 15 * HOUR, end=T0 + 40 * DAY, by=("tenant",))


@query(f"WITH {EVENTS} SELECT series_id, {AGG} FROM ev WHERE ts BETWEEN {T0} AND {END} GROUP BY series_id")
def range_agg(spark, sf):
    return A.range_agg(R.in_window(T.event_samples(spark, sf), T0, END))


@query(f"WITH {EVENTS} SELECT series_id, {AGG} FROM ev GROUP BY series_id")
def range_agg_open(spark, sf):
    return A.range_agg(R.in_window(T.event_samples(spark, sf), None, None))


@query(f"WITH {EVENTS} SELECT series_id, {_floor('ts', DAY)} AS bucket_start, {AGG} FROM ev GROUP BY 1, 2")
def step_agg(spark, sf):
    return A.step_agg(T.event_samples(spark, sf), DAY)


@query(f"WITH {EVENTS} SELECT series_id, CAST(0 AS BIGINT) AS bucket_start, {AGG} FROM ev GROUP BY 1")
def step_agg_whole(spark, sf):
    return A.step_agg(T.event_samples(spark, sf), 0)


@query(f"WITH {EVENTS} SELECT series_id, event_type, CAST(user_id AS VARCHAR) AS user_id, {AGG} FROM ev GROUP BY 1, 2, 3")
def range_agg_named(spark, sf):
    s = T.event_samples(spark, sf)
    out = A.named(A.range_agg(s), s)
    return out.select("*", F.col("labels")["event_type"].alias("event_type"), F.col("labels")["user_id"].alias("user_id")).drop("labels")


@query(f"WITH {EVENTS} SELECT series_id, {AGG} FROM ev GROUP BY 1")
def shard_merge(spark, sf):
    s = T.event_samples(spark, sf)
    return A.merge_aggregates(*[A.range_agg(s.where(V.shard_of("ingest_seq", 3) == k)) for k in range(3)])


_NAMED = f"WITH {EVENTS} SELECT series_id, event_type, CAST(user_id AS VARCHAR) AS user_id, "


def _with_names(aggregates, samples):
    out = A.named(aggregates, samples)
    return out.select("*", F.col("labels")["event_type"].alias("event_type"), F.col("labels")["user_id"].alias("user_id")).drop("labels")


@query(_NAMED + f"{_floor('ts', DAY)} AS bucket_start, {AGG} FROM ev GROUP BY 1, 2, 3, 4")
def step_agg_named(spark, sf):
    s = T.event_samples(spark, sf)
    return _with_names(A.step_agg(s, DAY), s)


@query(_NAMED + f"t AS window_end, {AGG} FROM ev JOIN (SELECT unnest(range({T0}, {T0 + 40 * DAY} + 1, {5 * DAY})) AS t) g ON ev.ts > t - {10 * DAY} AND ev.ts <= t GROUP BY 1, 2, 3, 4")
def window_agg_named(spark, sf):
    s = T.event_samples(spark, sf)
    return _with_names(A.window_agg(s, 5 * DAY, 10 * DAY, anchor=T0, end=T0 + 40 * DAY), s)


@query(f"WITH {EVENTS} " + _WINDOWS.format(agg=AGG, first=T0, end=T0 + 70 * DAY, step=6 * HOUR, window=30 * DAY))
def window_agg_long(spark, sf):
    return A.window_agg(T.event_samples(spark, sf), 6 * HOUR, 30 * DAY, end=T0 + 70 * DAY, by=("tenant",))


@query(f"WITH {EVENTS} SELECT tenant, {_floor('ts', DAY)} AS bucket_start, {AGG} FROM ev GROUP BY 1, 2")
def shard_merge_steps(spark, sf):
    s = T.event_samples(spark, sf)
    by = ("tenant", "bucket_start")
    return A.merge_aggregates(*[A.step_agg(s.where(V.shard_of("series_id", 3) == k), DAY, by=("tenant",)) for k in range(3)], by=by)


# merges and matchers ----------------------------------------------------------------------------


@query(f"WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY ingest_seq DESC, value DESC) AS n FROM li) SELECT series_id, ts, CAST(value AS DOUBLE) AS value, ingest_seq FROM r WHERE n = 1")
def dedup_last_wins(spark, sf):
    rows = T.line_samples(spark, sf).withColumn("_o", F.struct("ingest_seq", "value"))
    return R.freshest(rows, order="_o", columns=["value", "ingest_seq"]).select("series_id", "ts", F.col("value").cast("double").alias("value"), "ingest_seq")


@query(f"WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY tenant DESC, ingest_seq DESC, value DESC) AS n FROM li) SELECT series_id, ts, CAST(value AS DOUBLE) AS value FROM r WHERE n = 1")
def merge_tenants_dedup(spark, sf):
    rows = T.line_samples(spark, sf).drop("labels")
    rows = rows.withColumn("ingest_seq", F.struct("ingest_seq", "value"))
    return R.merge_metrics(rows.where("tenant = 'F'"), rows.where("tenant = 'O'")).select("series_id", "ts", F.col("value").cast("double").alias("value"))


_M = f"WITH {EVENTS} SELECT series_id, ts, CAST(value AS DOUBLE) AS value FROM ev WHERE "


def _matched(spark, sf, *matchers):
    s = T.event_samples(spark, sf)
    return R.fetch_metrics(s.drop("labels"), s.select("tenant", "series_id", "labels").dropDuplicates(["series_id"]), R.Request(matchers=matchers)).select("series_id", "ts", F.col("value").cast("double").alias("value"))


@query(_M + "event_type = 'click'")
def matcher_eq(spark, sf):
    return _matched(spark, sf, R.eq("event_type", "click"))


@query(_M + "event_type <> 'click'")
def matcher_neq_absent(spark, sf):
    return _matched(spark, sf, R.neq("event_type", "click"), R.neq("no_such_label", "x"))


@query(_M + f"event_type = 'click' AND ts BETWEEN {T0 + DAY + 5} AND {T0 + 30 * DAY}")
def fetch_split(spark, sf):
    s = T.event_samples(spark, sf)
    request = R.Request(matchers=(R.eq("event_type", "click"),), start=T0 + DAY + 5, end=T0 + 30 * DAY)
    rows = R.fetch_split(s.drop("labels"), s.select("tenant", "series_id", "labels").dropDuplicates(["series_id"]), request, 10 * DAY)
    return rows.select("series_id", "ts", F.col("value").cast("double").alias("value"))


@query(_M + "true")
def all_series(spark, sf):
    return _matched(spark, sf)


@query(_M + "tenant IN ('click', 'view')")
def of_two_tenants(spark, sf):
    rows = R.fetch_metrics(T.event_samples(spark, sf), None, R.Request(tenants=("click", "view")))
    return rows.select("series_id", "ts", F.col("value").cast("double").alias("value"))


@query(_M + "regexp_full_match(event_type, 'c.*|view') AND NOT regexp_full_match(CAST(user_id AS VARCHAR), '1.*')")
def matcher_regex(spark, sf):
    return _matched(spark, sf, R.regex("event_type", "c.*|view"), R.regex("user_id", "1.*", negate=True))


_L = f"WITH {LOGS} SELECT ts, stream_id FROM lg WHERE "


def _logged(spark, sf, **request):
    return R.fetch_records(T.document_logs(spark, sf), R.Request(**request)).select("ts", "stream_id")


@query(_L + "toxic IS NULL OR toxic <> 1")
def cond_attr_missing(spark, sf):
    return _logged(spark, sf, conditions=(R.neq("toxic", "1"),))


@query(_L + "quality IS NOT NULL AND toxic = 0 AND n_chars >= 500")
def cond_attr_and_column(spark, sf):
    return _logged(spark, sf, conditions=(R.exists("quality"), R.eq("toxic", "0"), R.compare("severity", ">=", 500)))


@query(_L + "contains(body, ' the ') AND lang = 'en'")
def cond_contains(spark, sf):
    return _logged(spark, sf, matchers=(R.eq("lang", "en"),), conditions=(R.contains("body", " the "),))


@query(_L + "contains(body, ', the ')")
def token_search(spark, sf):
    return R.search(R.with_tokens(T.document_logs(spark, sf)), ", the ").select("ts", "stream_id")


@query(_L + "quality IS NULL")
def cond_absent(spark, sf):
    return _logged(spark, sf, conditions=(R.absent("quality"),))


@query(f"WITH {LOGS} SELECT ts, len(regexp_extract_all(body, '[A-Za-z0-9]+')) AS n_tokens FROM lg")
def tokens_count(spark, sf):
    return T.document_logs(spark, sf).select("ts", V.count_tokens("body").alias("n_tokens"))


@query("SELECT trace_id, ts FROM (SELECT CAST(conv_id AS VARCHAR) AS trace_id, turn AS ts, rank() OVER (ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 50")
def topn_newest_ties(spark, sf):
    rows = T.conversation_logs(spark, sf).withColumn("ts", F.pmod("ts", F.lit(1000)))
    return R.fetch_records(rows, R.Request(limit=50, reverse=True)).select("trace_id", "ts")


@query("SELECT trace_id, ts FROM (SELECT CAST(conv_id AS VARCHAR) AS trace_id, turn AS ts, rank() OVER (ORDER BY turn) AS r FROM conversations WHERE role = 'assistant') WHERE r <= 20")
def topn_oldest_filtered(spark, sf):
    rows = T.conversation_logs(spark, sf).withColumn("ts", F.pmod("ts", F.lit(1000)))
    return R.fetch_records(rows, R.Request(matchers=(R.eq("role", "assistant"),), limit=20)).select("trace_id", "ts")


@query("SELECT conv_id * 1000 + turn AS ts, role FROM conversations WHERE conv_id = 7")
def trace_by_id(spark, sf):
    return R.by_id(T.conversation_logs(spark, sf), "trace_id", "7").select("ts", F.col("labels")["role"].alias("role"))


@query(f"WITH {LOGS} SELECT ts, stream_id FROM lg UNION ALL SELECT conv_id * 1000 + turn AS ts, md5(role) AS stream_id FROM conversations")
def records_union_all(spark, sf):
    return R.merge_records(T.document_logs(spark, sf), T.conversation_logs(spark, sf)).select("ts", "stream_id")


@query(f"SELECT greatest(b, {T0 + 5}) AS start, least(b + {DAY} - 1, {END + 7}) AS \"end\" FROM (SELECT unnest(range({T0}, {END + 8}, {DAY})) AS b)")
def split_windows(spark, sf):
    return R.split_windows(spark, T0 + 5, END + 7, DAY)


@query(_L.replace("stream_id FROM", "stream_id, body FROM") + "lang = 'en'")
def projected(spark, sf):
    return R.fetch_records(T.document_logs(spark, sf), R.Request(matchers=(R.eq("lang", "en"),), projection=("body", "no_such_column"))).select("ts", "stream_id", "body")


@query(_L + "true")
def conditions_ignored(spark, sf):
    return _logged(spark, sf, conditions=(R.eq("toxic", "1"),), all_conditions=False)


@query("SELECT event_id, CASE WHEN ms > 9223372036854 THEN 9223372036854775807 WHEN ms < -9223372036854 THEN -9223372036854775807 ELSE CAST(ms AS BIGINT) * 1000000 END AS ns FROM (SELECT event_id, (event_id - 5000) * CAST(4000000000 AS HUGEINT) AS ms FROM events)")
def clamped_times(spark, sf):
    ms = (F.col("ingest_seq") - 5000) * F.lit(4_000_000_000)
    return T.event_samples(spark, sf).select(F.col("ingest_seq").alias("event_id"), V.ms_to_ns(ms).alias("ns"))


@query(f"WITH {EVENTS}, x AS (SELECT ingest_seq, CAST(value AS DOUBLE) AS v, floor(log2(abs(CAST(value AS DOUBLE)))) + 1 AS e FROM ev) SELECT ingest_seq AS event_id, CASE WHEN v = 0 THEN 0.0 ELSE round_even(v / pow(2, e) * 64, 0) / 64 * pow(2, e) END AS value FROM x")
def kept_bits(spark, sf):
    return T.event_samples(spark, sf).select(F.col("ingest_seq").alias("event_id"), V.keep_bits(F.col("value").cast("double"), 6).alias("value"))


@query(
    f"WITH {EVENTS}, x AS (SELECT ingest_seq, ts, CAST(value AS DOUBLE) AS v, floor(log2(abs(CAST(value AS DOUBLE)))) + 1 AS e, CASE WHEN ts < {T0 + 5 * DAY} THEN 16 ELSE 256 END AS s FROM ev) "
    f"SELECT ingest_seq AS event_id, CASE WHEN v = 0 OR ts >= {END} THEN v ELSE round_even(v / pow(2, e) * s, 0) / s * pow(2, e) END AS value FROM x"
)
def precision_tiers(spark, sf):
    return L.precision(T.event_samples(spark, sf), [(END, 8), (T0 + 5 * DAY, 4)]).select(F.col("ingest_seq").alias("event_id"), "value")


@query(
    f"WITH {EVENTS}, p AS (SELECT tenant, {_floor('ts', DAY)} AS min_ts, CAST({_floor('ts', DAY)} AS VARCHAR) AS part, count(*) AS bytes FROM ev GROUP BY 1, 2), t AS (SELECT *, CAST(floor(ln(CAST(bytes AS DOUBLE)) / ln(4)) AS INTEGER) AS tier FROM p), "
    "r AS (SELECT *, sum(bytes) OVER (PARTITION BY tenant, tier ORDER BY min_ts, part) - bytes AS run FROM t), c AS (SELECT *, CAST(floor(run / 500) AS BIGINT) AS cell FROM r) "
    "SELECT tenant, part, CASE WHEN count(*) OVER (PARTITION BY tenant, tier, cell) > 1 THEN tenant || '/' || tier || '/' || cell END AS \"group\" FROM c"
)
def compaction_groups(spark, sf):
    day = V.floor_to("ts", DAY)
    parts = T.event_samples(spark, sf).groupBy("tenant", day.alias("min_ts")).agg(F.count(F.lit(1)).alias("bytes")).withColumn("part", F.col("min_ts").cast("string"))
    return L.compaction_groups(parts, 4, 500).select("tenant", "part", "group")


@query(
    "WITH r AS (SELECT DISTINCT role FROM conversations), p AS (SELECT doc_id, 'lang' AS k, lang AS v FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents), "
    "t AS (SELECT k || chr(0) || v AS token, doc_id FROM p UNION SELECT k || chr(0) || unnest(regexp_extract_all(lower(v), '[a-z0-9]+')), doc_id FROM p) SELECT token, count(*) AS n FROM t GROUP BY token"
)
def attribute_tokens(spark, sf):
    tokens = T.document_logs(spark, sf).select(F.explode(V.attribute_tokens("labels")).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


# a query engine's view --------------------------------------------------------------------------


def _prom(spark, sf):
    s = T.event_samples(spark, sf)
    return s.drop("labels"), s.select("tenant", "series_id", "labels")


_MS = f"BETWEEN {T0} AND {T0 + 25 * DAY}"


@query(f"WITH {EVENTS}, p AS (SELECT series_id, event_type, user_id, list({{'t': ts // 1000000, 'v': CAST(value AS DOUBLE)}} ORDER BY ts) AS l FROM ev WHERE regexp_full_match(event_type, 'c.*') AND ts {_MS} GROUP BY 1, 2, 3) SELECT series_id, event_type, CAST(len(l) AS INTEGER) AS n, l[1].t AS first_ms, l[len(l)].v AS last_value FROM p")
def prom_select(spark, sf):
    out = P.select(*_prom(spark, sf), [R.regex("event_type", "c.*")], T0 // 1_000_000, (T0 + 25 * DAY) // 1_000_000)
    return out.select("series_id", F.col("labels")["event_type"].alias("event_type"), F.size("points").alias("n"), F.col("points")[0]["t"].alias("first_ms"), F.element_at("points", -1)["v"].alias("last_value"))


@query(f"WITH {EVENTS} SELECT count(DISTINCT series_id) AS n_series FROM ev WHERE event_type <> 'click' AND ts {_MS}")
def prom_count(spark, sf):
    return P.count(*_prom(spark, sf), [R.neq("event_type", "click")], T0 // 1_000_000, (T0 + 25 * DAY) // 1_000_000)


@query(f"WITH {EVENTS} SELECT event_type AS label_value, count(DISTINCT series_id) AS n_series FROM ev WHERE regexp_full_match(CAST(user_id AS VARCHAR), '.*[02468]') GROUP BY 1")
def prom_count_by(spark, sf):
    return P.count_by(*_prom(spark, sf), "event_type", [R.regex("user_id", ".*[02468]")])


@query("SELECT 'event_type' AS name, 'click' AS value, count(DISTINCT user_id) AS n_series FROM events WHERE event_type = 'click' UNION ALL SELECT '__name__', 'event.value', count(DISTINCT user_id) FROM events WHERE event_type = 'click' UNION ALL SELECT DISTINCT 'user_id', CAST(user_id AS VARCHAR), 1 FROM events WHERE event_type = 'click'")
def prom_series_labels(spark, sf):
    return P.series_labels(_prom(spark, sf)[1], [R.eq("event_type", "click")])


# counts and catalogue ---------------------------------------------------------------------------


@query(f"WITH {EVENTS} SELECT count(DISTINCT series_id) AS n_series FROM ev WHERE ts <= {END}")
def count_series(spark, sf):
    return A.count_series(R.in_window(T.event_samples(spark, sf), None, END))


@query(f"WITH {EVENTS} SELECT count(DISTINCT series_id) AS n_series FROM ev")
def count_series_open(spark, sf):
    return A.count_series(R.in_window(T.event_samples(spark, sf), None, None))


@query(f"WITH {EVENTS} SELECT event_type AS label_value, count(DISTINCT series_id) AS n_series FROM ev GROUP BY 1")
def count_by_label(spark, sf):
    return A.count_by(T.event_samples(spark, sf), "event_type")


@query(f"WITH {EVENTS} SELECT '' AS label_value, count(DISTINCT series_id) AS n_series FROM ev")
def count_by_absent_label(spark, sf):
    return A.count_by(T.event_samples(spark, sf), "no_such_label")


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS value FROM events WHERE event_type = 'click'")
def label_values(spark, sf):
    return A.label_values(R.match_labels(T.event_samples(spark, sf), [R.eq("event_type", "click")]), "user_id")


@query(f"WITH {EVENTS} SELECT DISTINCT '__name__' AS name FROM ev UNION SELECT 'event_type' FROM ev WHERE event_type IS NOT NULL UNION SELECT 'user_id' FROM ev WHERE user_id IS NOT NULL")
def label_names(spark, sf):
    return A.label_names(T.event_samples(spark, sf))


@query(f"WITH {LOGS} SELECT DISTINCT stream_id FROM lg WHERE ts BETWEEN 10 AND 60")
def series_in_window(spark, sf):
    return A.series_in_window(T.document_logs(spark, sf), 10, 60)


@query(f"WITH {LOGS} SELECT DISTINCT stream_id FROM lg")
def series_in_window_open(spark, sf):
    return A.series_in_window(T.document_logs(spark, sf), None, None)


@query(
    f"WITH {LOGS}, k AS (SELECT 'lang' AS key, 1 AS bit FROM lg UNION ALL SELECT 'source', 1 FROM lg UNION ALL SELECT 'lib.' || lang, 2 FROM lg UNION ALL SELECT 'source', 2 FROM lg WHERE n_chars > 500 "
    "UNION ALL SELECT 'n_chars', 4 FROM lg WHERE n_chars IS NOT NULL UNION ALL SELECT 'quality', 4 FROM lg WHERE quality IS NOT NULL UNION ALL SELECT 'toxic', 4 FROM lg WHERE toxic IS NOT NULL) SELECT key, CAST(bit_or(bit) AS BIGINT) AS scopes FROM k GROUP BY key"
)
def attr_keys_all_scopes(spark, sf):
    rows = T.document_logs(spark, sf)
    scope = F.map_filter(F.create_map(F.concat(F.lit("lib."), F.col("labels")["lang"]), F.lit("1"), F.lit("source"), F.when(F.col("severity") > 500, "1")), lambda k, v: v.isNotNull())
    return A.keys(rows, resource=F.col("labels"), scope=scope, record=F.col("attrs"))


@query(ORACLE_SQL["attr_keys_all_scopes"])
def attr_keys_of_shards(spark, sf):
    rows = T.document_logs(spark, sf)
    scope = F.map_filter(F.create_map(F.concat(F.lit("lib."), F.col("labels")["lang"]), F.lit("1"), F.lit("source"), F.when(F.col("severity") > 500, "1")), lambda k, v: v.isNotNull())
    shards = [rows.where(V.shard_of("stream_id", 3) == k) for k in range(3)]
    return A.union_keys(*[A.keys(s, resource=F.col("labels"), scope=scope, record=F.col("attrs")) for s in shards])


@query(f"WITH {LOGS} SELECT 'lang' AS key, CAST(1 AS BIGINT) AS scopes FROM lg UNION SELECT 'source', 1 FROM lg UNION SELECT 'n_chars', 4 FROM lg WHERE n_chars IS NOT NULL UNION SELECT 'quality', 4 FROM lg WHERE quality IS NOT NULL UNION SELECT 'toxic', 4 FROM lg WHERE toxic IS NOT NULL")
def attr_keys_scope(spark, sf):
    return A.keys(T.document_logs(spark, sf), resource=F.col("labels"), record=F.col("attrs"))


@query(f"WITH {EVENTS}, x AS (SELECT series_id, '__name__' AS name, 'event.value' AS value FROM ev UNION ALL SELECT series_id, 'event_type', event_type FROM ev UNION ALL SELECT series_id, 'user_id', CAST(user_id AS VARCHAR) FROM ev) SELECT name, count(DISTINCT series_id) AS n_series, count(DISTINCT value) AS n_values FROM x GROUP BY name ORDER BY n_series DESC, name LIMIT 2")
def cardinality_topn(spark, sf):
    return A.cardinality(T.event_samples(spark, sf), 2)


# rollups, retention and admission ---------------------------------------------------------------

_ROLLED = {
    "last": "arg_max(CAST(value AS DOUBLE), ts)", "first": "arg_min(CAST(value AS DOUBLE), ts)", "min": "CAST(min(value) AS DOUBLE)", "max": "CAST(max(value) AS DOUBLE)",
    "sum": "round(sum(CAST(value AS DOUBLE)), 4)", "avg": "round(sum(CAST(value AS DOUBLE)) / count(*), 4)", "count": "CAST(count(*) AS DOUBLE)",
}


def _rollup(agg):
    def run(spark, sf):
        s = T.event_samples(spark, sf).withColumn("value", F.col("value").cast("double"))
        out = L.downsample(s, [(T0 + 60 * DAY, DAY, agg)])
        return out.select("series_id", "ts", F.round("value", 4).alias("value") if agg in ("sum", "avg") else "value")

    run.__name__ = f"rollup_{agg}"
    return run


for _agg, _sql in _ROLLED.items():
    query(f"WITH {EVENTS} SELECT series_id, {_floor('ts', DAY)} AS ts, {_sql} AS value FROM ev GROUP BY 1, 2")(_rollup(_agg))


@query(
    f"WITH {EVENTS}, t AS (SELECT *, CASE WHEN ts < {T0 + 10 * DAY} THEN {DAY} WHEN ts < {END} THEN {HOUR} ELSE 0 END AS iv FROM ev), "
    f"c AS (SELECT series_id, {DAY} AS iv, {_floor('ts', DAY)} AS ts, arg_max(CAST(value AS DOUBLE), ts) AS value FROM t WHERE iv = {DAY} GROUP BY 1, 2, 3 UNION ALL "
    f"SELECT series_id, {HOUR}, {_floor('ts', HOUR)}, CAST(max(value) AS DOUBLE) FROM t WHERE iv = {HOUR} GROUP BY 1, 2, 3 UNION ALL SELECT series_id, 0, ts, CAST(value AS DOUBLE) FROM t WHERE iv = 0) "
    "SELECT series_id, ts, arg_min(value, iv) AS value FROM c GROUP BY 1, 2"
)
def rollup_two_tier(spark, sf):
    s = T.event_samples(spark, sf).withColumn("value", F.col("value").cast("double"))
    return L.downsample(s, [(T0 + 10 * DAY, DAY, "last"), (END, HOUR, "max")]).select("series_id", "ts", "value")


@query(
    f"WITH {EVENTS}, c AS (SELECT series_id, {_floor('ts', DAY)} AS ts, CASE WHEN min(ts) < {T0 + 10 * DAY + 6 * HOUR} THEN arg_max(CAST(value AS DOUBLE), ts) ELSE CAST(max(value) AS DOUBLE) END AS value FROM ev WHERE ts < {END} GROUP BY 1, 2) "
    f"SELECT * FROM c UNION ALL SELECT series_id, ts, CAST(arg_max(value, ts) AS DOUBLE) FROM ev WHERE ts >= {END} GROUP BY 1, 2"
)
def rollup_tiers_of_one_interval(spark, sf):
    s = T.event_samples(spark, sf).withColumn("value", F.col("value").cast("double"))
    return L.downsample(s, [(END, DAY, "max"), (T0 + 10 * DAY + 6 * HOUR, DAY, "last"), (END + DAY, 0, "sum")]).select("series_id", "ts", "value")


@query(
    f"WITH {EVENTS}, f AS (SELECT tenant, series_id, min(ingest_seq) AS first FROM ev GROUP BY 1, 2), p AS (SELECT tenant, series_id, row_number() OVER (PARTITION BY tenant ORDER BY first) AS place FROM f) "
    "SELECT tenant, count(DISTINCT CASE WHEN place > 20 THEN 'overflow' ELSE ev.series_id END) AS n_series, count(*) FILTER (place > 20) AS folded FROM ev JOIN p USING (tenant, series_id) WHERE place <= 60 GROUP BY tenant"
)
def overflow_identity(spark, sf):
    rows = L.overflowed(L.capped(T.event_samples(spark, sf), hard=60, soft=20))
    folded = F.coalesce(F.col("labels")["__overflow__"] == "true", F.lit(False))
    return rows.groupBy("tenant").agg(F.countDistinct("series_id").alias("n_series"), F.count_if(folded).alias("folded"))


@query(f"WITH {EVENTS} SELECT series_id, ts FROM ev WHERE ts >= {END}")
def retention_age(spark, sf):
    return L.retain(T.event_samples(spark, sf), END).select("series_id", "ts")


@query(
    f"WITH {EVENTS}, p AS (SELECT {_floor('ts', DAY)} AS max_ts, count(*) * 100 AS bytes FROM ev GROUP BY 1), r AS (SELECT max_ts, sum(bytes) OVER (ORDER BY max_ts DESC) AS run, row_number() OVER (ORDER BY max_ts DESC) AS n FROM p) "
    "SELECT CAST(coalesce(max(max_ts) + 1, 0) AS BIGINT) AS cutoff FROM r WHERE run > 20000 AND n > 1"
)
def retention_size(spark, sf):
    parts = T.event_samples(spark, sf).groupBy(V.floor_to("ts", DAY).alias("max_ts")).agg((F.count(F.lit(1)) * 100).alias("bytes"))
    return L.size_cutoff(parts, 20000)


@query(
    f"WITH {EVENTS}, m AS (SELECT *, max(ts) OVER (PARTITION BY event_type ORDER BY (ingest_seq * 7919) % 10007, ingest_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM ev) "
    f"SELECT ingest_seq AS event_id, CASE WHEN ts < newest - {5 * DAY} THEN 'late' END AS reason FROM m"
)
def lateness(spark, sf):
    s = T.event_samples(spark, sf).withColumns({"series_id": F.col("tenant"), "event_id": F.col("ingest_seq")})
    s = s.withColumn("ingest_seq", F.struct(((F.col("event_id") * 7919) % 10007).alias("a"), F.col("event_id").alias("b")))
    return L.lateness(s, 5 * DAY).select("event_id", "reason")


@query(
    f"WITH {EVENTS}, f AS (SELECT tenant, series_id, min(ingest_seq) AS first FROM ev GROUP BY 1, 2), p AS (SELECT tenant, series_id, row_number() OVER (PARTITION BY tenant ORDER BY first) AS place FROM f) "
    "SELECT tenant, CAST(count(*) FILTER (place <= 20) AS BIGINT) AS own, CAST(count(*) FILTER (place > 20 AND place <= 60) AS BIGINT) AS overflow, CAST(count(*) FILTER (place > 60) AS BIGINT) AS rejected FROM ev JOIN p USING (tenant, series_id) GROUP BY tenant"
)
def cardinality_caps(spark, sf):
    rows = L.capped(T.event_samples(spark, sf), hard=60, soft=20)
    over, bad = F.col("overflow"), F.col("reason").isNotNull()
    return rows.groupBy("tenant").agg(F.count_if(~over & ~bad).alias("own"), F.count_if(over).alias("overflow"), F.count_if(bad).alias("rejected"))


@query(
    f"WITH {EVENTS}, s AS (SELECT tenant, {_floor('ts', HOUR)} AS sec, count(*) AS n FROM ev GROUP BY 1, 2), r AS (SELECT ev.*, coalesce(greatest(ceil(s.n / 20), 1), 1) AS sf FROM ev LEFT JOIN s ON s.tenant = ev.tenant AND s.sec + {HOUR} = {_floor('ev.ts', HOUR)}) "
    "SELECT tenant, count(*) AS kept, sum(sf) AS weight FROM r WHERE CAST('0x' || substr(md5(series_id || ':' || CAST(ts AS VARCHAR)), 1, 15) AS BIGINT) % CAST(sf AS BIGINT) = 0 GROUP BY tenant"
)
def sampled(spark, sf):
    rows = L.sampled(T.event_samples(spark, sf), 20, second=HOUR)
    return rows.groupBy("tenant").agg(F.count(F.lit(1)).alias("kept"), F.sum("sf").alias("weight"))


@query("SELECT CAST(count(*) FILTER (value < 20) AS BIGINT) AS accepted, CAST(count(*) FILTER (value >= 20) AS BIGINT) AS rejected, (SELECT CASE WHEN count(*) FILTER (value >= 40) > count(*) FILTER (value >= 20 AND value < 40) THEN 'huge' ELSE 'large' END || '+others' FROM events) AS reason FROM events")
def partial_success(spark, sf):
    v = F.col("value")
    return L.accepted(T.event_samples(spark, sf).withColumn("reason", F.when(v >= 40, "huge").when(v >= 20, "large")))


# traces and profiles ----------------------------------------------------------------------------


@query(
    "WITH k AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT o_orderkey, unnest(range(0, coalesce(n, 0) + 1)) AS i, coalesce(n, 0) AS n FROM orders LEFT JOIN k ON l_orderkey = o_orderkey UNION ALL SELECT l_orderkey, unnest(range(1, n + 1)), -1 FROM k WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) "
    "SELECT CAST(o_orderkey AS VARCHAR) AS trace_id, CASE WHEN i = 0 THEN 'o' ELSE CAST(i AS VARCHAR) END AS span_id, CASE WHEN n < 0 OR i = 0 THEN -1 ELSE 1 END AS parent_id, CASE WHEN n < 0 THEN 2 * i - 1 WHEN i = 0 THEN 1 ELSE 2 * i END AS nested_set_left, CASE WHEN n < 0 THEN 2 * i WHEN i = 0 THEN 2 * n + 2 ELSE 2 * i + 1 END AS nested_set_right FROM s"
)
def nested_set_two_level(spark, sf):
    return G.nested_sets(T.order_spans(spark, sf)).select("trace_id", "span_id", "parent_id", "nested_set_left", "nested_set_right")


@query(
    "WITH cn AS (SELECT c_custkey, n_nationkey, r_name, r_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) "
    "SELECT r_name AS trace_id, 'n' || n_nationkey AS ancestor, 'c' || c_custkey AS descendant FROM cn UNION ALL SELECT r_name, 'n' || n_nationkey, 'o' || o_orderkey FROM orders JOIN cn ON o_custkey = c_custkey"
)
def structural_descendants(spark, sf):
    spans = G.nested_sets(T.place_spans(spark, sf))
    return G.descendants(spans.where("span_id LIKE 'n%'"), spans)


@query("SELECT conv_id * 1000 + turn AS ts FROM conversations WHERE CAST(conv_id AS VARCHAR) IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders)")
def logs_for_traces(spark, sf):
    return G.logs_for_traces(T.conversation_logs(spark, sf), T.order_spans(spark, sf).where("span_id = 'o'")).select("ts")


@query(
    "WITH s AS (SELECT p_brand, p_type, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) "
    "SELECT value, CAST(unnest([0, 1, 2]) AS INTEGER) AS depth, unnest([p_brand, p_type, 'main']) AS function FROM s"
)
def symbol_resolve(spark, sf):
    p = T.part_profiles(spark, sf)
    totals = G.stack_totals(p)
    symbols = G.symbol_tables(totals)
    return G.resolve_stacks(totals.select("id", "location_ids"), symbols).join(totals.select(F.col("id").alias("stack_id"), "value"), "stack_id").select("value", "depth", "function")


@query(f"WITH {LINES}, b AS (SELECT l_returnflag AS flag, CASE WHEN value <= 10000 THEN 10000.0 WHEN value <= 50000 THEN 50000.0 ELSE 'Infinity'::DOUBLE END AS le FROM li), n AS (SELECT flag, le, count(*) AS n FROM b GROUP BY 1, 2) SELECT flag, CAST(le AS VARCHAR) AS le, CAST(sum(n) OVER (PARTITION BY flag ORDER BY n.le) AS BIGINT) AS cumulative FROM n")
def histogram_cumulative(spark, sf):
    from pyspark.sql import Window

    v = F.col("value")
    n = T.line_samples(spark, sf).groupBy(F.col("labels")["flag"].alias("flag"), F.when(v <= 10000, 10000.0).when(v <= 50000, 50000.0).otherwise(float("inf")).alias("le")).count()
    out = n.withColumn("cumulative", F.sum("count").over(Window.partitionBy("flag").orderBy("le")))
    return out.select("flag", F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string")).alias("le"), "cumulative")
