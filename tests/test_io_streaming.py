import tempfile

from pyspark.sql import functions as F

from cohortspark.functions.labels import ANALYTE_SHORT_NAMES
from cohortspark.sources import io
from cohortspark.sources.fixture import assay_raw
from cohortspark.streaming import rowwise

from .conftest import SF_SMALL


def test_csv_sink_roundtrip(spark):
    out = tempfile.mkdtemp(prefix="cohortspark-test-") + "/t"
    df = spark.createDataFrame([(1, "NC", 1.5, None)], io.ASSAY_LONG_SCHEMA)
    io.write_result(df, out, "csv")
    back = io.read_assay(spark, out, fmt="csv")
    assert [tuple(r) for r in back.collect()] == [(1, "NC", 1.5, None)]


def test_rowwise_on_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="cohortspark-stream-")
    raw = assay_raw(spark, SF_SMALL).select(
        "lab_id", F.col("antigen_raw").alias("antigen"), "value", "visit_date")
    raw.repartition(3).write.parquet(base + "/in")
    stream = rowwise.prepare_assay_rows(rowwise.assay_stream(spark, base + "/in", max_files_per_trigger=1),
                                        2000.0, 0.01, ANALYTE_SHORT_NAMES)
    q = (rowwise.detected_above_counts(stream).writeStream.outputMode("complete")
         .format("memory").queryName("cs_counts")
         .option("checkpointLocation", rowwise.checkpoint_location(spark, "cs_counts" + base[-6:]))
         .start())
    q.processAllAvailable()
    q.stop()
    got = {r.antigen: (r.n, r.n_above) for r in spark.table("cs_counts").collect()}
    batch = rowwise.detected_above_counts(rowwise.prepare_assay_rows(
        io.read_assay(spark, base + "/in"), 2000.0, 0.01, ANALYTE_SHORT_NAMES))
    exp = {r.antigen: (r.n, r.n_above) for r in batch.collect()}
    assert got == exp and len(got) == 7


def test_bucketed_assay_needs_no_shuffle_for_subject_panel(spark):
    from cohortspark.operators import cohort as K
    from cohortspark.sources.fixture import assay
    path = tempfile.mkdtemp(prefix="cohortspark-bucket-") + "/assay"
    io.write_bucketed(assay(spark, SF_SMALL).select("lab_id", "group5", "antigen", "value"),
                      "cs_assay_bucketed", ["lab_id"], 8, path=path)
    t = spark.table("cs_assay_bucketed")
    panel = K.subject_panel(t, "lab_id", "group5", "antigen", "value", ["NC", "M", "SCT"], 2000.0)
    plan = panel._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    direct = K.subject_panel(assay(spark, SF_SMALL), "lab_id", "group5", "antigen", "value",
                             ["NC", "M", "SCT"], 2000.0)
    assert sorted(map(tuple, panel.collect())) == sorted(map(tuple, direct.collect()))


def test_parquet_sink_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, "NC", float("nan"), None), (2, None, 0.5, None)],
                               io.ASSAY_LONG_SCHEMA)
    io.write_result(df, str(tmp_path / "t"), "parquet")
    back = io.read_assay(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.collect())) == [(1, "NC", None, None), (2, None, 0.5, None)]


def test_new_files_are_seen(spark, tmp_path):
    """A table may grow in a subfolder between two queries of a session."""
    from cohortspark.sources import fixture
    folder = tmp_path / "lineitem.parquet"
    for prefix in (str(tmp_path), f"file:{tmp_path}"):
        for part, n in (("p=1", 10), ("p=2", 5)):
            spark.range(n).write.mode("overwrite").parquet(str(folder / part))
            seen = fixture.read_table(spark, prefix, "lineitem").count()
            assert seen == (10 if part == "p=1" and prefix == str(tmp_path) else 15)


def test_scale_settings():
    from cohortspark.session import MAX_REDUCERS, scale_settings
    s = scale_settings(100 * 1024 ** 4, 8000)
    assert int(s["spark.sql.shuffle.partitions"]) == max(MAX_REDUCERS, 8000)
    assert int(scale_settings(1024, 8)["spark.sql.shuffle.partitions"]) == 24
    assert int(scale_settings(1024 ** 4, 100)["spark.sql.shuffle.partitions"]) == 4096


def test_session_leaves_submit_settings_alone(spark, monkeypatch):
    from pyspark.sql import SparkSession
    from cohortspark import session
    set_ = {}

    class Builder:
        def __getattr__(self, name):
            def call(*a):
                set_[a[0] if name == "config" else name] = a[-1] if a else None
                return spark if name == "getOrCreate" else self
            return call

    monkeypatch.setattr(SparkSession, "builder", Builder())
    monkeypatch.delenv("COHORTSPARK_MASTER", raising=False)
    session.build_session()
    assert "master" not in set_ and "spark.sql.shuffle.partitions" not in set_
    assert not any("checkpoint.dir" in k for k in set_)
    session.build_session("local[2]", shuffle_partitions=3, extra={"spark.x": "1"})
    assert set_["master"] == "local[2]" and set_["spark.sql.shuffle.partitions"] == "3"
    assert set_["spark.x"] == "1"


def test_checkpoint_folder(spark):
    import pytest
    from cohortspark import session

    class Context:
        def __init__(self, master, folder=None, current=None):
            self.master, self.folder, self.current = master, folder, current

        def getCheckpointDir(self):
            return self.current

        def setCheckpointDir(self, folder):
            self.current = folder

        def getConf(self):
            return {"spark.checkpoint.dir": self.folder}

    class Session:
        def __init__(self, *a):
            self.sparkContext = Context(*a)
            self.conf = {}

    ensure = session.ensure_checkpoint_dir
    assert ensure(Session("yarn", None, "hdfs:/kept")) == "hdfs:/kept"
    assert ensure(Session("yarn", "hdfs:/named")) == "hdfs:/named"
    assert "cohortspark-ckpt-" in ensure(Session("local[4]"))
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            ensure(Session(master))


def _same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_cli_lists_runs_and_writes(spark, capsys, tmp_path):
    from cohortspark.__main__ import main
    from cohortspark.plans.registry import QUERIES
    assert main(["list"]) == 0
    assert "fig3a_distribution" in capsys.readouterr().out.split()
    want = QUERIES["floor_zeros"](spark, SF_SMALL)
    assert main(["run", "floor_zeros", "--data", SF_SMALL]) == 0
    lines = capsys.readouterr().out.rstrip("\n").split("\n")
    assert lines[0] == "\t".join(want.columns) and len(lines) == want.count() + 1 > 101
    out = str(tmp_path / "parquet")
    assert main(["run", "floor_zeros", "--data", SF_SMALL, "--out", out,
                 "--format", "parquet"]) == 0
    assert _same(spark.read.parquet(out), want)
    out = str(tmp_path / "csv")
    assert main(["run", "cohort_size_k3", "--data", SF_SMALL, "--out", out]) == 0
    got = spark.read.option("header", "true").schema("group5 string, n_ind long").csv(out)
    assert _same(got, QUERIES["cohort_size_k3"](spark, SF_SMALL))


def test_cli_on_assay_files(spark, tmp_path):
    from cohortspark.__main__ import main
    from cohortspark.plans import reports
    from cohortspark.plans.context import Inputs, Parameters, StudyInputs
    test = Inputs(spark, SF_SMALL)
    test.assay_long().coalesce(1).write.parquet(str(tmp_path / "assay"))
    test.subject().coalesce(1).write.parquet(str(tmp_path / "subjects"))
    files = ["--assay", str(tmp_path / "assay"), "--subjects", str(tmp_path / "subjects")]
    assert main(["run", "fig3a_distribution", *files, "--cutoff", "2000", "--panel3", "NC,M",
                 "--out", str(tmp_path / "out"), "--format", "parquet"]) == 0
    study = StudyInputs.read(spark, files[1], files[3],
                             parameters=Parameters(cutoff=2000.0, panel3=["NC", "M"]))
    want = reports.fig3a_distribution(study)
    assert want.count() > 0 and _same(spark.read.parquet(str(tmp_path / "out")), want)
