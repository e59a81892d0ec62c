"""A1 / A2: JSON-lines scan and sink with explicit schemas.

The study exchanges every intermediate table as JSON lines and writes
explicit ``null`` fields; reads never infer a schema (``FAILFAST`` by default,
``PERMISSIVE`` with a corrupt-record column on request).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Source query rows (the instruction dataset after column reduction).
SOURCE_QUERY_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("instruction", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("output", T.StringType()),
])

#: Raw source rows with sampled candidates and pairwise comparisons.
CANDIDATE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("instruction", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("output", T.StringType()),
    T.StructField("candidates", T.ArrayType(T.StructType([
        T.StructField("decoding_method", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("scores", T.MapType(T.StringType(), T.DoubleType())),
    ]))),
    T.StructField("cmp_results", T.StringType()),
])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, permissive: bool = False) -> DataFrame:
    """A1: one JSON object per line into a typed table."""
    r = spark.read.schema(schema)
    if permissive:
        schema = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
        r = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    else:
        r = r.option("mode", "FAILFAST")
    return r.json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A2: one compact object per row, NULL fields written as ``null``."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
