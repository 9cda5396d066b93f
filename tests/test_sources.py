import pytest
from pyspark.sql import functions as F

from compostat.plans import reports as R
from compostat.sources import readers, sinks
from compostat.streaming import incremental

A, B = "k.p.c.o.f.g1", "k.p.c.o.f.g2.x"


def test_wide_csv(spark, tmp_path):
    (tmp_path / "w.csv").write_text(f",sample,{A},{B}\n0,s1,3,0\n1,s2,0,0\n2,s3,1,5\n")
    counts, taxa = readers.read_wide_counts(spark, str(tmp_path / "w.csv"))
    assert sorted(map(tuple, counts.collect())) == [("s1", A, 3), ("s3", A, 1), ("s3", B, 5)]
    assert [r["parts"][-1] for r in taxa.orderBy("taxon_id").collect()] == ["g1", "g2.x"]
    (tmp_path / "bad.csv").write_text(f"name,{A}\n")
    with pytest.raises(ValueError, match="first column"):
        readers.read_header(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "short.csv").write_text("sample,a.b\n")
    with pytest.raises(ValueError, match="6 ranks"):
        readers.read_header(spark, str(tmp_path / "short.csv"))


def test_tags_keep_quotes_and_order(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('project\tsrs\tsrr\ttag\tvalue\np\ts\tr\ta\tsaid "hi\np\ts\tr\tb\t\n')
    rows = readers.read_tags(spark, str(tmp_path / "t.tsv")).orderBy("row_id").collect()
    assert [(r["tag"], r["value"]) for r in rows] == [("a", 'said "hi'), ("b", None)]


def test_byte_order_mark(spark, tmp_path):
    (tmp_path / "p.csv").write_bytes("project,condition\nP1,x\n".encode("utf-8-sig"))
    assert readers.read_projects(spark, str(tmp_path / "p.csv")).columns == ["project", "condition"]


def test_counts_sink_and_key_scan(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1), ("b", "x", 0), ("b", "y", 2)], "sample string, taxon string, n bigint")
    sinks.write_counts(df, str(tmp_path / "c"), 2)
    keys = spark.createDataFrame([("b",)], "sample string")
    assert [tuple(r) for r in readers.read_keys(spark, str(tmp_path / "c"), keys, ["n"]).collect()] == [("b", 2)]


def test_runs_resume(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "fold int, auc double")
    for run in ("r1", "r2", "r1"):
        sinks.append_run(df, str(tmp_path / "runs"), run)
    done = spark.read.parquet(str(tmp_path / "runs"))
    assert sorted(r["run"] for r in done.collect()) == ["r1", "r2"]
    work = spark.createDataFrame([("r1",), ("r3",)], "run string")
    assert [r["run"] for r in readers.not_done(work, done, ["run"]).collect()] == ["r3"]


def test_result_csv_has_json(spark, tmp_path):
    sinks.write_result(spark.createDataFrame([({"a": 1}, 2)], "m map<string,int>, n int"), str(tmp_path / "r"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "r")).first()["m"] == '{"a":1}'


def test_rule_files(spark):
    rules, default = readers.rules_of(readers.load_yaml("rules:\n- match: [ab]\n  category: X\ndefault: other\n"))
    assert (rules, default) == ([(["ab"], "X")], "other")
    assert readers.null_rules_of(readers.load_yaml("global: [na]\nconditional: {none: {except: [f]}}\n")) == (["na"], {"none": ["f"]})
    assert readers.priors_of(spark, {"C": {"up": ["G"], "down": None}}).count() == 1


def test_reports(spark):
    df = spark.createDataFrame([("a", 0.5), (None, 2.0)], "x string, y double")
    assert R.markdown_table(df).split("\n")[2:] == ["| a | 0.500 |", "|  | 2.000 |"]
    text = "# T\n\n## One\nbody\n### Sub\nmore\n## Two\nrest"
    assert R.section(text, "One") == "body\n### Sub\nmore"
    assert "#### Sub" not in R.demote(text, 0) and "#### Sub" in R.demote(text)
    assert R.assemble("All", [("A", "# x")]).endswith("### x\n")
    with pytest.raises(ValueError):
        R.markdown_table(df, max_rows=1)
    flow = spark.createDataFrame([(1, "s", 3, 1, 2)], "step_no int, step string, n_in int, n_removed int, n_out int")
    assert "| s | 3 | 1 | 2 |" in R.flow_report(flow, {"all": 2})
    prof = spark.createDataFrame([("t", 3, "v", 2), ("t", 3, "w", 1)], "tag string, n_samples int, value string, n int")
    assert R.profile_text(prof).first()["line"] == "t: 3 samples; v (2), w (1)"
    assert [tuple(r) for r in R.level_counts(df, F.col("x")).collect()] == [("a", 1), ("unresolved", 1)]


def test_streams_agree_with_batches(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 4)], "sample string, taxon string, n bigint")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = incremental.running_depth(stream).writeStream.format("memory").queryName("depths").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("depths").collect())) == [("a", 3, 2), ("b", 4, 1)]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    want = incremental.windowed_counts(events).count()
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    q = incremental.windowed_counts(stream, late="100 days").writeStream.format("memory").queryName("wins").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("wins").count() == want
