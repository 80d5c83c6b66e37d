"""Findings and their recall: payments are worked out once for all detectors, and only findings that are shown are numbered."""

from pyspark.sql import functions as F

from tracewell.operators import ordering
from tracewell.plans import anomalies
from tracewell.plans import views as V


def test_payments_are_joined_once_and_recall_numbers_nothing(spark, sf_dir, monkeypatch):
    rows, seen = V.table(spark, sf_dir, "lineitem").count(), spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    joined = V.v_tx
    monkeypatch.setattr(V, "v_tx", lambda s, d: joined(s, d).withColumn("amount", counted(F.col("amount"))))
    monkeypatch.setattr(ordering, "numbered", lambda *a: (_ for _ in ()).throw(AssertionError("numbered")))
    got = {r["pattern"]: r for r in anomalies.QUERIES["anomaly_recall"](spark, sf_dir).collect()}
    assert seen.value == rows
    assert set(got) == {"STRUCTURING_SMURFING", "MULE_FANOUT", "_overall"}
    assert got["_overall"]["planted"] == got["STRUCTURING_SMURFING"]["planted"] + got["MULE_FANOUT"]["planted"]
