"""A score store: tables bucketed and sorted by ``id``, so that merging, averaging and joining them moves no rows.

The study passes its long score tables from step to step (merge C1, averages D4,
model merge C3), every time grouped or joined by keys that start with the query id.  Written
once as buckets of ``id``, an aggregate by ``id`` and more is complete within a bucket,
and a join by ``id`` meets equal buckets.  The one exchange is that of writing.  Template
and score files are lines of one table (a union of two would lose its buckets); later
files are appended to their buckets and win by their line numbers.

The files lie in the shared checkpoint folder; the session's catalog only names them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators import scores as SC
from ..session import scratch_path


def write_bucketed(df: DataFrame, name: str, buckets: int | None = None, key: str = "id", sort: Sequence[str] = ()) -> DataFrame:
    """The table written in buckets of ``key`` (each sorted by ``key`` and ``sort``) and read back.

    A key's rows lie in one bucket, as in any grouping by it; buckets are files of the
    shared folder, read by as many tasks.  ``buckets`` must agree between tables that
    are to be joined (default: the session's shuffle partitions)."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"store_{name}_{uuid.uuid4().hex}"
    (df.repartition(n, key).write.format("parquet").option("compression", "zstd").option("path", scratch_path(spark, table))
     .bucketBy(n, key).sortBy(key, *sort).saveAsTable(table))
    return spark.table(table)


def drop_names(spark: SparkSession) -> int:
    """Forget the store's tables in the session catalog (their files stay); returns how many."""
    names = [t.name for t in spark.catalog.listTables() if t.name.startswith("store_")]
    for t in names:
        spark.sql(f"DROP TABLE {t}")
    return len(names)


def score_store(template: DataFrame, files: DataFrame, buckets: int | None = None, default: float = 0.0) -> DataFrame:
    """Template and score-file rows (``row_idx``: the line order) as one bucketed table of lines."""
    lines = SC.score_lines(template, default=default).unionByName(SC.score_lines(files))
    return write_bucketed(lines, "scores", buckets, sort=SC.SCORE_KEY[1:])


def append_scores(store: DataFrame, files: DataFrame) -> DataFrame:
    """Further score-file rows added to the store's buckets; the rows already there stay in place."""
    spark = store.sparkSession
    table = store._jdf.queryExecution().analyzed().collectLeaves().head().catalogTable().get()
    buckets, name = table.bucketSpec().get().numBuckets(), table.identifier().table()
    (SC.score_lines(files).repartition(buckets, "id").write.format("parquet").option("compression", "zstd").mode("append")
     .bucketBy(buckets, "id").sortBy("id", *SC.SCORE_KEY[1:]).saveAsTable(name))
    return spark.table(name)


def merged_averages(store: DataFrame) -> DataFrame:
    """C1 then D4 over the store: ``id, model, metric, avg_score``, without an exchange."""
    return SC.score_averages(SC.merge_lines(store))


def by_model(per_model: Sequence[DataFrame], values: Sequence[str], models=config.MODELS) -> DataFrame:
    """One bucketed table per model (``id`` and ``values``) merged on ``id`` into columns
    ``<value>_<model>``; ids that a model lacks are dropped, as in the study's merge."""
    out = None
    for model, df in zip(models, per_model):
        df = df.select("id", *[F.col(v).alias(f"{v}_{model}") for v in values])
        out = df if out is None else out.join(df.hint("merge"), "id")
    return out
