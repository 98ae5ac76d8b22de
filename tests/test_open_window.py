from pyspark.sql import functions as F

from teleskein.plans.registry import ORACLE_SQL, QUERIES

from .oracle import check


def test_streams_of_documents_outside_the_narrow_window_are_listed(spark, tmp_path):
    docs = [(10, "a", "en", "s", 1), (60, "b", "en", "s", 1), (61, "c", "de", "s", 1), (9, "d", "fr", "t", 1), (5000, "e", "es", "u", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["stream_id"] for r in QUERIES["series_in_window_open"](spark, str(tmp_path)).collect()}
    want = {r["s"] for r in spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").select(F.md5(F.concat_ws(",", "lang", "source")).alias("s")).collect()}
    assert got == want and len(got) == 4


def test_open_window_equals_its_sql(spark, sf_dir):
    check(QUERIES["series_in_window_open"](spark, sf_dir), ORACLE_SQL["series_in_window_open"], sf_dir)
