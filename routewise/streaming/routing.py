"""Structured Streaming: route arriving queries with fixed statistics.

Scoring a new query needs only the row and constants: the text features
(S1-S8), the complexity score with statistics fixed at training time (S10 with
a ``dict`` of D1 values), the router probabilities and the confidence rule
(Q5).  The same column functions as the batch path run unchanged on the
stream; a running routed-count aggregate (D9) is the only state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import features as FT
from ..operators import routing as RT
from ..session import scratch_path
from ..sources.fixtures import proba_columns, queries_from_documents

DOCUMENT_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


def route_queries(queries: DataFrame, stats: dict, probability_threshold: float = 0.5) -> DataFrame:
    """Stateless per-row routing (batch or stream): features, complexity with
    fixed statistics, probabilities, confidence rule."""
    f = FT.with_query_features(FT.with_category(FT.with_query(queries)))
    f = FT.with_complexity(f, stats_from=stats)
    f = f.withColumns(proba_columns(k=0))
    return f.withColumn("routed_to", RT.route_by_confidence(threshold=probability_threshold))


def routing_stream(spark: SparkSession, source: str, stats: dict, probability_threshold: float = 0.5,
                   files_per_trigger: int = 1) -> DataFrame:
    """Streaming DataFrame of routed queries from document files arriving under ``source``."""
    docs = (spark.readStream.schema(DOCUMENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
                 .parquet(source))
    return route_queries(queries_from_documents(docs.select("doc_id", "text")), stats, probability_threshold)


def start_routed_counts(spark: SparkSession, source: str, stats: dict, query_name: str = "routed_counts",
                        checkpoint: str | None = None) -> StreamingQuery:
    """D9 over the stream: running count per routed model (complete mode, memory sink)."""
    counts = routing_stream(spark, source, stats).groupBy("routed_to").agg(F.count(F.lit(1)).alias("n"))
    return (counts.writeStream.outputMode("complete").format("memory").queryName(query_name)
                  .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt"))
                  .start())
