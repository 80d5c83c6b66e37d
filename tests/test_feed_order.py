"""Places of rows are those of a single reader, whatever files and splits there are."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import graph, indices
from tracewell.sources.catalog import Catalog, Feed


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{k}")


def written(path, rows_a_file):
    rows = []
    path.mkdir()
    for f, n in enumerate(rows_a_file):
        own = [(f"P{(f * 31 + i * 7) % 23}", f"PH{i % 11}", "x" * (i % 60)) for i in range(n)]
        (path / f"part-{f}.csv").write_text("person_id,phone_id,usage_type\n" + "".join(",".join(r) + "\n" for r in own))
        rows += own
    return rows


@pytest.mark.parametrize("files", [(500,), (3, 400, 0, 90)])
def test_places_of_several_files_and_splits(spark, tmp_path, small_splits, files):
    rows = written(tmp_path / "feed", files)
    c = Catalog(spark, [Feed("person_phone", str(tmp_path / "feed"))])
    assert c["person_phone"].rdd.getNumPartitions() > 5
    got = c.ordered("person_phone")
    assert [(r.person_id, r.phone_id, r.usage_type or "") for r in got.orderBy("_row").collect()] == rows
    assert [r["_row"] for r in got.select("_row").orderBy("_row").collect()] == list(range(len(rows)))
    owner, last, every = {}, {}, {}
    for p, ph, _ in rows:
        owner.setdefault(ph, p)
        last[ph] = p
        every.setdefault(ph, []).append(p)
    assert {r.phone_id: r.person_id for r in indices.first_owner(got, "phone_id", "person_id").collect()} == owner
    assert {r.phone_id: r.person_id for r in indices.last_wins(got, "phone_id", "person_id").collect()} == last
    assert {r.phone_id: r.person_id for r in indices.listed(got, "phone_id", "person_id").collect()} == {k: "|".join(v) for k, v in every.items()}
    assert {r.phone_id: r.person_id for r in indices.by_id(got, "phone_id").collect()} == owner


def test_other_kinds_and_missing_feeds(spark, tmp_path, small_splits):
    (tmp_path / "fir.jsonl").write_text("".join(f'{{"doc_id": "D{i}", "text": "{"t" * 50}"}}\n' for i in range(100)))
    spark.range(200).select(F.col("id").alias("k")).coalesce(1).write.parquet(f"{tmp_path}/p")
    c = Catalog(spark, [Feed("fir", f"{tmp_path}/fir.jsonl", kind="json"), Feed("nums", f"{tmp_path}/p", kind="parquet"), Feed("cdr", f"{tmp_path}/none.csv")])
    assert [r.doc_id for r in c.ordered("fir").orderBy("_row").collect()] == [f"D{i}" for i in range(100)]
    assert all(r.k == r["_row"] for r in c.ordered("nums").collect())
    assert c.ordered("cdr").count() == 0 and "_row" in c.ordered("cdr").columns
    with pytest.raises(KeyError):
        c.ordered("nothing")


def test_repeated_ids_have_a_stated_row(spark):
    df = spark.createDataFrame([("a", "z", 1), ("a", None, 2), ("b", "q", 3)], "k string, v string, n int")
    for parts in (1, 3):
        assert {tuple(r) for r in indices.by_id(df.repartition(parts), "k").collect()} == {("a", "", 2), ("b", "q", 3)}
        people, places = (spark.createDataFrame(rows, "id string, label string").repartition(parts) for rows in ([("1", "y"), ("1", "x")], [("1", "a"), ("2", "b")]))
        nodes, edges = graph.hetero({"PERSON": people, "PLACE": places}, {"AT": spark.createDataFrame([("1", "2"), ("1", "2"), ("1", "9")], "src string, dst string")})
        assert {tuple(r) for r in nodes.collect()} == {("1", "PERSON", "x"), ("2", "PLACE", "b")} and [tuple(r) for r in edges.collect()] == [("1", "2", "AT")]
