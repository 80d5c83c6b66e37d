"""The versioned store: whole versions or the one before, never a mix."""

import os

import pytest
from pyspark.sql import functions as F

from tracewell.sources.artefacts import Store


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_broken_run_leaves_the_last_version(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/store")
    with s.run():
        s.stage("edges", spark.range(3))
        s.stage("leads", spark.range(0))
    before = set(os.listdir(tmp_path / "store/tables"))
    with pytest.raises(ZeroDivisionError), s.run():
        s.stage("edges", spark.range(9))
        assert rows(Store(spark, s.root).read("edges")) == [(0,), (1,), (2,)]  # a reader during the run
        raise ZeroDivisionError
    with pytest.raises(Exception, match="bad"), s.run():  # a task that fails while a table is written
        s.stage("edges", spark.range(9))
        s.stage("leads", spark.range(9).select(F.raise_error(F.lit("bad")).cast("string").alias("x")))
    assert s.versions() == [1] and rows(s.read("edges")) == [(0,), (1,), (2,)] and rows(s.contents()) == [("edges", 3), ("leads", 0)]
    assert before == set(os.listdir(tmp_path / "store/tables")) and s.read("leads").columns == ["id"]


def test_versions_defaults_and_pruning(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/store")
    assert s.versions() == [] and s.manifest() == {} and s.contents().count() == 0 and s.read("card", "a int, b string").columns == ["a", "b"]
    with pytest.raises(KeyError):
        s.read("card")
    for k in (1, 2, 3):
        s.stage("edges", spark.range(99))
        s.stage("edges", spark.range(k))  # the later one counts
        if k == 1:
            s.stage("leads", spark.createDataFrame([("x", None)], "rows string, name int"))
        assert s.publish(keep_others=k == 2) == k
    assert [s.read("edges", version=v).count() for v in (1, 2, 3)] == [1, 2, 3]
    assert s.read("leads", version=2).collect() == s.read("leads", version=1).collect() and set(s.manifest(3)) == {"edges"}
    s.prune(2)
    assert s.versions() == [2, 3] and s.read("leads", version=2).count() == 1 and len(os.listdir(tmp_path / "store/tables")) == 3
    with pytest.raises(KeyError):
        s.read("edges", version=1)
    with pytest.raises(ValueError):
        s.prune(0)


def test_another_writer_is_seen(spark, tmp_path, monkeypatch):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    a.stage("t", spark.range(1))
    b.stage("t", spark.range(2))
    a.publish()
    monkeypatch.setattr(b, "versions", lambda: [])  # as if both had looked before
    with pytest.raises(RuntimeError), b.run():
        pass
    assert a.read("t").count() == 1 and a.versions() == [1] and len([x for x in os.listdir(tmp_path / "tables")]) == 1
