"""URL filters: host-suffix and path-prefix expressions, met with rules by hash prefix, then by digest.

Each URL gives all its expressions: the host and every suffix of it of two labels or more, times the
path with its query, the path, and every directory above it. Expressions and rules meet in an
equi-join on the first four bytes of their SHA-256; the whole digest then confirms. Of the rules
that hold, the longest host decides, then the longest path, then ``allow`` before ``block``.

Defined results: scheme, user, port, fragment, case of the host and dots around it don't matter; an
IPv4 address has no suffixes; a URL without ``scheme://host``, a null or an empty one has action
``none``; rows with equal ids or URLs are decided each by itself; an empty table or rule list gives
an empty result or ``none``; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spark

#: (rule, action): host and path prefix as in the expressions above.
RULES = [
    ("spam-farm.example.org/", "block"), ("cheap-pills.example.com/", "block"), ("casino-win.example.org/", "block"), ("free-bets.example.com/", "block"), ("ads-track.example.org/", "block"),
    ("cheap-pills.example.com/fr/", "allow"), ("www.cheap-pills.example.com/fr/176/", "block"), ("m.free-bets.example.com/en/27", "allow"), ("blog.tionsh.example.net/nl/", "block"),
]


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query); host is empty where there is none."""
    authority = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\s]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r":[0-9]*$", ""), r"^\.+|\.+$", "")
    path = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\s]*([^?#\s]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#\s]*)", 1)
    return host, F.when(path == "", "/").otherwise(path), query


def expressions(url: Column) -> Column:
    """Array of struct(host, path)."""
    host, path, query = parts(url)
    labels = F.split(host, r"\.")
    hosts = F.when(host.rlike(r"^[0-9]+(\.[0-9]+){3}$") | (F.size(labels) < 2), F.array(host)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )
    steps = F.split(path, "/")  # '/a/b' is ['', 'a', 'b']
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.lit("/")))
    paths = F.array_distinct(F.concat(F.when(query != "", F.array(F.concat(path, query))).otherwise(F.array().cast("array<string>")), F.array(path), above))
    each = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    return F.when(host != "", each)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A row for each page: id, url, action, and the deciding rule. rules: (rule, action)."""
    listed = rules.where("rule IS NOT NULL AND action IN ('allow', 'block')").groupBy("rule", "action").agg(F.lit(1).alias("n"))
    listed = listed.select(F.sha2("rule", 256).alias("_digest"), F.col("action").alias("_action"), F.col("rule").alias("_rule")).withColumn("_short", F.substring("_digest", 1, 8))
    listed = _spark.sized_side(listed)
    rows = pages.select(_spark.column(id_col).alias("_id"), _spark.column(url_col).alias("_url"))
    spread = rows.select("_url").where("_url IS NOT NULL").distinct().select("_url", F.explode(expressions(F.col("_url"))).alias("_e"))
    spread = spread.select("_url", F.length("_e.h").alias("_hl"), F.length("_e.p").alias("_pl"), F.sha2(F.concat("_e.h", "_e.p"), 256).alias("_full"))
    met = spread.withColumn("_short", F.substring("_full", 1, 8)).join(listed, "_short").where(F.col("_full") == F.col("_digest"))
    best = met.groupBy("_url").agg(F.max_by(F.struct("_action", "_rule"), F.struct("_hl", "_pl", F.col("_action") == "allow")).alias("_best"))
    best = best.select("_url", "_best._action", "_best._rule")
    nothing = rows.where("_url IS NULL").withColumns({"_action": F.lit(None).cast("string"), "_rule": F.lit(None).cast("string")})  # apart, as rows without a key would meet in one task
    found = rows.where("_url IS NOT NULL").join(best, "_url", "left").select("_id", "_url", "_action", "_rule").unionByName(nothing)
    return found.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), F.coalesce("_action", F.lit("none")).alias("action"), F.col("_rule").alias("rule"))


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(_spark.read(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "rule string, action string"))


_LIST = ", ".join(f"('{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{a}')" for r, a in RULES)
SQL = rf"""
WITH rules(rh, rp, action) AS (VALUES {_LIST}),
cut AS (SELECT page_id, url, row_number() OVER () AS k,
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\s]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '^\.+|\.+$', '', 'g') AS host,
  regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\s]*([^?#\s]*)', 1) AS path, regexp_extract(url, '^[^?#]*(\?[^#\s]*)', 1) AS query FROM pages),
whole AS (SELECT page_id, url, k, host, CASE WHEN path = '' THEN '/' ELSE path END AS path, query FROM cut),
held AS (SELECT k, rh, rp, action, row_number() OVER (PARTITION BY k ORDER BY length(rh) DESC, length(rp) DESC, action) AS n
  FROM whole JOIN rules ON (host = rh OR (ends_with(host, '.' || rh) AND contains(rh, '.') AND NOT regexp_full_match(host, '[0-9]+(\.[0-9]+){{3}}')))
   AND (path || query = rp OR path = rp OR (ends_with(rp, '/') AND starts_with(path, rp))))
SELECT page_id, url, coalesce(action, 'none') AS action, rh || rp AS rule FROM whole LEFT JOIN held ON whole.k = held.k AND n = 1
"""
