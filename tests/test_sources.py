"""Sources and sinks: JSONL round trip, report render/parse, reply parsing, batches, merge."""

import re

import pytest
from pyspark.sql import functions as F

from routewise.session import local_fs_path, scratch_path
from routewise.sources import batches as BT
from routewise.sources import jsonl as JL
from routewise.sources import reports as RP


def test_jsonl_roundtrip_keeps_nulls(spark):
    df = spark.createDataFrame([("a", "i", None, "o"), ("b", "", "x", None)], JL.SOURCE_QUERY_SCHEMA)
    path = scratch_path(spark, "t-jsonl")
    JL.write_jsonl(df, path)
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert any('"input":null' in x for x in lines) and any('"output":null' in x for x in lines)
    back = JL.read_jsonl(spark, path, JL.SOURCE_QUERY_SCHEMA)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_jsonl_permissive_keeps_bad_lines(spark, tmp_path):
    p = tmp_path / "bad.jsonl"
    p.write_text('{"id":"a","instruction":"i","input":"x","output":"o"}\n{"id": broken\n')
    back = JL.read_jsonl(spark, str(p), JL.SOURCE_QUERY_SCHEMA, permissive=True)
    rows = back.collect()
    assert len(rows) == 2 and sum(r["_corrupt_record"] is not None for r in rows) == 1


def test_reply_parser_rejects(spark):
    df = spark.createDataFrame([(0, 'ok {"id":"a/1","category":7}, {"id":"b","category":} x {"id":"c","category":3}')],
                               "batch_no int, reply string")
    got = BT.parse_category_replies(df).orderBy("obj_no").collect()
    assert [(r["id"], r["category"], r["is_valid"]) for r in got] == [("a/1", 7, True), (None, None, False),
                                                                       ("c", 3, True)]


def test_prompt_batches_bounded(spark):
    rows = [(i, f"doc/{i}", "i", "x", "o") for i in range(0, 1000, 2)]
    df = spark.createDataFrame(rows, "row_idx long, id string, instruction string, input string, output string")
    b = BT.prompt_batches(df, size=230).orderBy("batch_no").collect()
    assert [r["n_rows"] for r in b] == [230, 230, 40]
    first = b[0]["prompt"].split("\n")
    assert first[-230].startswith('{"id":"doc/0"') and first[-1].startswith('{"id":"doc/458"')


def test_report_roundtrip(spark):
    card = spark.createDataFrame(
        [("t0", 0.1, -2.31, 0.62, -23.35, 9.46, 69.42, 43459.92, 198, 266, 3536)],
        "t_threshold string, prob_threshold double, quality_loss_gt double, quality_loss_xl double, "
        "compute_savings_gt double, compute_savings_xl double, routing_accuracy double, compute_units double, "
        "n_base bigint, n_large bigint, n_xl bigint")
    lines = RP.render_sweep_report(card)
    text = [r["line"] for r in lines.orderBy("line_no").collect()]
    assert text[0] == "--- Evaluating Model for t-threshold: t0 ---"
    assert "Quality Loss compared to GT: -2.31%" in text and "Total Compute Units Used: 43459.92 CUs" in text
    path = scratch_path(spark, "t-report")
    RP.write_report(lines, path)
    back = RP.parse_sweep_report(RP.read_report(spark, path)).first()
    assert back["t_threshold"] == "t0"
    assert back["n_xl"] == 3536 and back["compute_units"] == pytest.approx(43459.92)
    assert back["quality_loss_gt"] == pytest.approx(-2.31) and back["prob_threshold"] == pytest.approx(0.1)


def test_score_merge_rules(spark):
    from routewise.operators.scores import merge_scores
    key = "id string, model string, resp_no int, metric string"
    tpl = spark.createDataFrame([("a", "m", 1, "bleu"), ("b", "m", 1, "bleu"), ("c", "m", 1, "bleu")], key)
    files = spark.createDataFrame([("a", "m", 1, "bleu", 1.0, 1), ("a", "m", 1, "bleu", 2.0, 5),
                                   ("b", "m", 1, "bleu", None, 3), ("z", "m", 1, "bleu", 9.0, 4)],
                                  key + ", score double, row_idx long")
    got = {r["id"]: r["score"] for r in merge_scores(tpl, files).collect()}
    assert got == {"a": 2.0, "b": None, "c": 0.0}


def test_fixtures_use_whole_texts(spark):
    from routewise.sources import fixtures as FX
    from routewise.sources.tables import load
    from tests.conftest import SF001
    docs = load(spark, SF001, "documents").agg(F.sum(F.length("text"))).first()[0]
    q = FX.fx_queries(spark, SF001)
    tail = F.when(F.col("doc_id") % 10 > 2, F.when(F.col("output").contains("\n"), 1).otherwise(0)).otherwise(0)  # the line break between the parts
    extra = (F.when(F.col("doc_id") % 10 == 1, 0).when(F.col("doc_id") % 10 == 2, 0)
             .when(F.col("doc_id") % 13 == 0, F.length(F.concat(F.lit(" see https://example.org/p/"), F.col("doc_id").cast("string"))))
             .when(F.col("doc_id") % 17 == 0, len(" ![fig](img.png)")).otherwise(0))
    got = q.agg(F.sum(F.length("instruction") + F.length("input") + tail - extra), F.sum(F.length("output"))).first()
    assert tuple(got) == (docs, docs)
    source = open(FX.__file__).read()
    assert "substr(" not in source and ".limit(" not in source


def test_every_query_runs_twice(spark):
    """Calling a query must not change what the next call sees."""
    import __spark_entry__ as E
    from tests.conftest import SF001
    qs = E.queries()
    for name in ("A1_jsonl_scan", "A2_jsonl_sink", "A7_report_parser", "C1_score_merge", "F1_fan_out_responses"):
        first, second = (qs[name](spark, SF001) for _ in range(2))
        assert first.columns == second.columns and first.count() == second.count()


def test_misaligned_tables_raise(spark):
    from routewise.operators.scores import assert_aligned
    a = spark.createDataFrame([(0, "a"), (1, "b")], "row_idx int, id string")
    assert_aligned(a, a)
    with pytest.raises(ValueError, match="1 positions"):
        assert_aligned(a, spark.createDataFrame([(0, "a"), (1, "x")], "row_idx int, id string"))


def test_checkpoint_folder_must_be_named_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from routewise import session

    class Conf(dict):
        def get(self, k, d=None):
            return d
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=Conf, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=Conf()))


def _objects(text):
    """Outermost objects, character by character."""
    out, depth, quoted, start, i = [], 0, False, 0, 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if quoted:
            quoted = c != '"'
        elif c == '"':
            quoted = depth > 0
        elif c == "{":
            start = start if depth else i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                out.append(text[start:i + 1])
        i += 1
    return out, text[start + 1:] if depth else ""


def test_reply_objects(spark):
    """Nested objects, braces and escaped quotes in strings, prose quotes, stray braces, empty texts."""
    import random

    from routewise.sources import batches as BT
    rng = random.Random(0)
    texts = ['5" tall {"id":"a","category":1} and {"x":{"y":"}"},"z":"\\"}"}', "{ never closed {\"id\":\"b\",\"category\":2} \" {}", "", None, "}{}}{", "\\", '{"a":"\\\\"} {"b":1}',
             "{" * 50 + "}" * 50, '{"long":"' + "x{" * 20000 + '"}']
    texts += ["".join(rng.choices(['{', '}', '"', "\\", "a", " ", '\\"', "é"], k=rng.randint(1, 30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = {r["n"]: r["o"] for r in df.select("n", BT.objects_in("t").alias("o")).collect()}
    flat = re.compile(r'\{(?:[^{}"]|"(?:[^"\\]|\\.)*")*\}', re.S)
    for i, t in enumerate(texts):
        whole, rest = _objects(t or "")
        assert got[i] == whole + flat.findall(rest), t
