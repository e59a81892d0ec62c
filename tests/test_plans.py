"""Physical-plan guards: native expressions, no cartesian
products, no unpartitioned windows on big tables, pushdown and pruning."""

from routewise.operators import features as FT
from routewise.sources import fixtures as FX
from tests.conftest import SF001


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_are_native(spark):
    p = plan(FT.query_feature_table(FX.fx_queries(spark, SF001)))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_scan_prunes_columns_and_pushes_filters(spark):
    import __spark_entry__ as E
    df = E.queries()["A3_parquet_scan"](spark, SF001)
    p = plan(df)
    assert "PushedFilters: [IsNotNull(n_chars), GreaterThan(n_chars,1000)]" in p
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string,n_chars:bigint>" in p
    q = plan(FX.fx_queries(spark, SF001))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in q


def test_sweep_plan_has_no_global_window_or_cartesian(spark):
    from routewise.plans.flagship import routing_sweep
    df = routing_sweep(spark, SF001)
    p = plan(df)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "Window" not in p
    assert df.count() == 70


def test_texts_are_never_shuffled(spark):
    """Whole texts stay in their scan partition: after the fan-out only the partial
    per-(id, model) sums cross the exchange."""
    from routewise.operators.responses import response_rows, response_summary
    s = response_summary(response_rows(FT.with_query(FX.fx_responses(spark, SF001, with_text=True))))
    p = plan(s)
    for line in p.splitlines():
        if "hashpartitioning" in line:
            assert "text" not in line and "response" not in line
    assert "REPARTITION_BY_NUM" not in p.replace("RoundRobinPartitioning", "") or "RoundRobin" in p
    assert "partial_sum" in p and "CartesianProduct" not in p


def test_metrics_keep_one_row_per_pair(spark):
    from routewise.operators import textmetrics as TM
    p = plan(TM.pair_metrics(FX.fx_pairs(spark, SF001), ["id", "model", "resp_no"]))
    assert p.count("ArrowEvalPython") == 1 and "hashpartitioning" not in p and "Window" not in p


def test_prompt_batches_use_no_single_partition(spark):
    import __spark_entry__ as E
    p = plan(E.queries()["A5_prompt_batches"](spark, SF001))
    assert "SinglePartition" not in p


def test_trash_predicate_joins_narrow_rows(spark):
    """The text of a response is read before the join with the runtimes and does not cross its exchange."""
    import __spark_entry__ as E
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan(E.queries()["S12_trash_predicate"](spark, SF001)).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    at = [i for i, line in enumerate(lines) if "hashpartitioning" in line]
    assert at and all("response" not in lines[i + 1] and "text" not in lines[i + 1] for i in at)
