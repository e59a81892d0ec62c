"""Structured Streaming smoke: documents arriving as files are routed with fixed statistics."""

from routewise.streaming.routing import route_queries, start_routed_counts
from routewise.sources.fixtures import queries_from_documents
from tests.conftest import SF001

STATS = {"query_chars_count_min": 10, "query_chars_count_max": 400, "query_words_count_min": 1,
         "query_words_count_max": 60, "query_unique_word_count_min": 1, "query_unique_word_count_max": 60,
         "query_special_tokens_count_min": 0, "query_special_tokens_count_max": 40, "query_keywords_count_min": 0,
         "query_keywords_count_max": 3, "query_readability_score_min": -5.0, "query_readability_score_max": 20.0}


def test_stream_counts_match_batch(spark, tmp_path):
    src = tmp_path / "incoming"
    src.mkdir()
    (src / "part-0.parquet").symlink_to(f"{SF001}/documents.parquet")
    q = start_routed_counts(spark, str(src), STATS, query_name="rc_test", checkpoint=str(tmp_path / "ckpt"))
    try:
        q.processAllAvailable()
        got = {r["routed_to"]: r["n"] for r in spark.sql("SELECT * FROM rc_test").collect()}
    finally:
        q.stop()
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    batch = route_queries(queries_from_documents(docs), STATS).groupBy("routed_to").count().collect()
    assert got == {r["routed_to"]: r["count"] for r in batch}
    assert sum(got.values()) == docs.count()
