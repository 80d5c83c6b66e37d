"""The audit reads calls and relations, which several of its rules and tables need, from what is stored once."""

from pyspark.sql import functions as F

from tracewell.plans import audit
from tracewell.plans import views as V


def test_calls_and_relations_are_worked_out_once(spark, sf_dir, monkeypatch):
    seen = {name: spark.sparkContext.accumulator(0) for name in ("v_comm", "v_rel")}
    rows = {name: getattr(V, name)(spark, sf_dir).count() for name in seen}

    def counting(name, column, kind):
        add, view = seen[name], getattr(V, name)

        @F.udf(kind)
        def counted(x):
            add.add(1)
            return x

        monkeypatch.setattr(V, name, lambda s, d: view(s, d).withColumn(column, counted(column)))

    counting("v_comm", "callee", "long")
    counting("v_rel", "dst", "long")
    got = audit.QUERIES["dataset_audit"](spark, sf_dir).collect()
    assert len(got) == len(audit.RULES)
    assert {name: add.value for name, add in seen.items()} == rows
