"""What layers are fused from is worked out once."""

from pyspark.sql import functions as F

from tracewell.operators import graph


def test_pairs_are_summed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    tx = spark.createDataFrame([(i % 7, i % 5 + 10, float(i)) for i in range(100)], "src long, dst long, amount double").withColumn("amount", counted("amount"))
    rows = graph.layer_rows({"money": graph.undirected_money(graph.money_layer(tx))})
    edges, leads = graph.fuse(rows)
    assert edges.count() == 35 and edges.select("weight").distinct().count() > 1 and leads.count() == 0
    assert seen.value == 100
