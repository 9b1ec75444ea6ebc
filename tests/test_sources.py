"""Sources, sinks, models and the stream."""

import pytest
from pyspark.sql import functions as F

from chartloom import schemas
from chartloom.functions import models
from chartloom.operators import notes
from chartloom.sources import readers, sinks
from chartloom.streaming import notes_stream


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'a "quoted"\nline, x', ["p", "q"], float("nan")), (2, None, [], 1.5)]
    df = spark.createDataFrame(rows, "id int, t string, xs array<string>, v double")
    sinks.write_csv(df.drop("v"), str(tmp_path / "c"))
    back = readers.read(spark, "csv", path=str(tmp_path / "c"), schema="id int, t string, xs string").orderBy("id").collect()
    assert back[0].t == rows[0][1] and back[0].xs == '["p","q"]'
    sinks.write_json(df, str(tmp_path / "j"))
    assert readers.read(spark, "json", path=str(tmp_path / "j"), schema="id int, v double").orderBy("id").first()["v"] is None


def test_missing_crosswalk_is_empty(spark, tmp_path):
    assert readers.read(spark, "crosswalk", path=str(tmp_path / "none.csv")).count() == 0


def test_unknown_source(spark):
    with pytest.raises(ValueError):
        readers.read(spark, "nowhere")


def test_pdf_source_is_pluggable(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\ntwo")
    files = readers.read_pdf(spark, str(tmp_path), extract=lambda b: b.decode())
    row = readers.uploaded_notes(files, 1, 2, "RR").first()
    assert (row.note_id, row.note_type, row.text) == ("a.pdf", "radiology", "one\ntwo")


def test_lexicon_offsets(spark):
    t = "Given ASPIRIN for congestive heart failure; aspirinate."
    df = spark.createDataFrame([("n", 1, 0, t), ("m", 1, 0, None)], "note_id string, hadm_id bigint, sentence_index bigint, sentence_text string")
    got = models.lexicon_entities(df).collect()
    assert {(t[r.start : r.end_], r.entity_group) for r in got} == {("ASPIRIN", "DRUG"), ("congestive heart failure", "problem")}


def test_models_plug_in(spark):
    df = spark.createDataFrame([("n", 1, 0, "abc")], "note_id string, hadm_id bigint, sentence_index bigint, sentence_text string")
    with pytest.warns(UserWarning):
        assert models.model_entities(df, "absent", "X").count() == 0
    models.register("first", lambda: lambda texts: [[("DRUG", t[:1], 0, 1, 1.0)] for t in texts])
    assert models.model_entities(df, "first", "X").first()["word"] == "a"
    models.register("rel", lambda: lambda texts: [("TREATS", 0.9) for _ in texts])
    label, score = models.relation_classifier("rel")(F.col("sentence_text"))
    assert df.select(label.alias("l"), score.alias("s")).first() == ("TREATS", 0.9)


def test_stream_runs_the_batch_functions(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, 1, "a", "radiology", "Findings:\nmass")], schemas.NOTES).write.json(str(src))
    q = notes_stream.process_notes(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp"), notes.segment_sections)
    q.awaitTermination(60)
    assert [r.section_name for r in spark.read.parquet(str(tmp_path / "out" / "batch_id=0")).collect()] == ["Findings"]
    assert notes_stream.job_status(spark, str(tmp_path / "out")).first()["status"] == "done"


def test_relations_fall_in_confidence_over_all_files(spark, tmp_path):
    rows = [("n%d" % k, "CAUSES" if k % 3 else "TREATS", (k * 37 % 100) / 100) for k in range(200)]
    df = spark.createDataFrame(rows, "note_id string, relation_type string, model_confidence double").repartition(7)
    assert sinks.write_relations(df, str(tmp_path / "r"))
    import pyarrow.parquet as pq

    files = sorted((tmp_path / "r").glob("part-*.parquet"))
    got = [x for f in files for x in pq.read_table(f)["model_confidence"].to_pylist()]
    assert len(got) == 200 and got == sorted(got, reverse=True)


def test_no_relations_write_nothing(spark, tmp_path):
    assert not sinks.write_relations(spark.createDataFrame([], schemas.RELATIONS), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_parquet_sink_and_one_admission(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "hadm_id bigint, t string")
    sinks.write_parquet(df, str(tmp_path / "p"), ["hadm_id"])
    assert readers.read(spark, "parquet", path=str(tmp_path / "p")).count() == 3
    path = sinks.export_admission(df, str(tmp_path), "edges", 1)
    assert path.endswith("edges_1.csv") and sorted(r.t for r in readers.read_csv(spark, path, "hadm_id bigint, t string").collect()) == ["a", "c"]


def test_json_safe_reaches_every_depth(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(nan, [1.0, nan], {1: inf}, (nan, [(2.0,)]), "x"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "a double, b array<double>, m map<int,double>, s struct<p:double,q:array<struct<r:double>>>, t string")
    first, second = sinks.json_safe(df).collect()
    assert (first.a, first.b, first.m, first.s.p, first.s.q[0].r, first.t) == (None, [1.0, None], {"1": None}, None, 2.0, "x")
    assert list(second) == [None] * 5


def test_graph_json_has_no_nan(spark):
    from chartloom.operators import graph

    e = spark.createDataFrame([(1, "A", "a", "B", "b", "TREATS", ["1"], ["x"], 1, float("nan"), float("nan"))], schemas.EDGES)
    assert "NaN" not in graph.to_json_graph(graph.knowledge_graph(e)).first()["graph_json"]


def test_crosswalk_keeps_the_last_line(spark, tmp_path):
    (tmp_path / "gem.csv").write_text("icd9_code,icd10_code\n4019,X\n4019,I10\n4019,A1\n")
    g = readers.read(spark, "crosswalk", path=str(tmp_path / "gem.csv"))
    d = spark.createDataFrame([(1, 1, 1, "4019", "9")], schemas.DIAGNOSES)
    assert notes.icd_map(d, g).first()["icd_code"] == "A1"


def test_jdbc_reads_only_what_is_asked(spark, tmp_path):
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    try:
        spark._jvm.java.lang.Class.forName(driver)
    except Exception:
        pytest.skip("no JDBC driver here")
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.createDataFrame([(k, k * 10, "x") for k in range(20)], "id int, v int, t string").write.format("jdbc").options(url=url, dbtable="things", driver=driver).save()
    df = readers.read(spark, "jdbc", url=url, dbtable="things", driver=driver, columns=["v"], where="id >= 15", partition_column="id", bounds=(0, 20), parts=3)
    assert sorted(r.v for r in df.collect()) == [150, 160, 170, 180, 190]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual" in plan and "t#" not in plan


def test_model_is_made_once_per_worker(spark, tmp_path):
    made = tmp_path / "made"

    def factory():
        with open(made, "a") as f:
            f.write("x")
        return lambda texts: [[] for _ in texts]

    models.register("counted", factory)
    df = spark.range(4000).selectExpr("cast(id as string) note_id", "id hadm_id", "id sentence_index", "'t' sentence_text").coalesce(1)
    models.model_entities(df, "counted", "X").count()
    assert made.read_text() == "x"


def test_cut_tables_are_released(spark):
    from chartloom import runtime

    runtime.release(spark)
    assert runtime.cut_lineage(spark.range(5)).count() == 5
    assert runtime.release(spark) == 1 and runtime.release(spark) == 0
