"""Catalogue, stages and quantised search beyond what the registered queries reach."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import catalogue, dense, stages
from siltstone.operators import text as op
from siltstone.sources.tables import save_tables, table


def test_quantised_search_finds_the_nearest(spark, sf):
    points = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asks = points.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    exact = {(r["query_id"], r["id"]) for r in dense.top(dense.scores(points, asks), 10).collect()}
    near = {(r["query_id"], r["id"]) for r in dense.approximate(dense.quantised(points, 6), asks, 10).collect()}
    assert len(near) == len(exact) and len(near & exact) >= 0.9 * len(exact)


def test_quantised_odd_vectors(spark):
    rows = [(1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0, -1.0]), (6, [float(1 << 40), 0.0])]
    points = spark.createDataFrame(rows, "id long, vector array<double>")
    codes = {r["id"]: list(r["codes"]) for r in dense.quantised(points, 2).collect()}
    assert codes == {1: [0, 0], 2: [0, 0], 5: [3, 0], 6: [3, 0]}
    asks = spark.createDataFrame([(1, [1.0, 1.0])], "query_id long, vector array<double>")
    assert [r["id"] for r in dense.approximate(dense.quantised(points), asks, 0).collect()] == [1]  # k is 1 at least
    assert dense.approximate(dense.quantised(points), asks, 500, 0.9).count() == 1
    with pytest.raises(ValueError):
        dense.quantised(points, 8)


def test_stages_without_need_or_budget(spark):
    rows = spark.createDataFrame([(1, 5.0, True), (2, 20.0, None), (3, 20.0, True)], "id int, budget_ms double, go boolean").withColumn("x", F.lit(0))
    steps = [stages.Stage("a", {"x": F.col("x") + 1}, F.col("go"), 10, 15), stages.Stage("b", {"x": F.col("x") * 10}, F.lit(True), 5), stages.Stage("c", {"x": F.lit(-1)}, F.lit(True), enabled=False)]
    got = {r["id"]: (r["x"], r["budget_ms"], r["trace"]) for r in stages.run(rows, steps).collect()}
    assert got == {1: (0, 5.0, ["b"]), 2: (0, 20.0, ["b"]), 3: (10, 5.0, ["a", "b"])}
    assert stages.run(rows, []).where("size(trace) > 0").count() == 0


def test_feeds_that_are_none(spark):
    rows = [(1, "p", 0, "<feed></feed>"), (2, "p", 0, "no xml"), (3, "p", 0, None), (4, "p", 0, "<feed><totalResults>many</totalResults><entry><id></id></entry></feed>")]
    out = catalogue.papers(spark.createDataFrame(rows, "feed int, href_prefix string, page int, body string"), "http://x")
    assert [(r["feed"], r["name"], r["modified"]) for r in out.collect()] == [(4, ": ", None)]


def test_sample_of_more_sources_than_asked(spark):
    rows = spark.createDataFrame([(i, None if i % 9 == 0 else f"s{i % 9}") for i in range(90)] + [(i, "hot") for i in range(100, 400)], "id long, source string")
    few = op.sample_each(rows, 3).collect()
    assert len(few) == 3 and len({r["source"] for r in few}) == 3 and "hot" in {r["source"] for r in few}
    many = op.sample_each(rows, 30).collect()
    assert len({r["id"] for r in many}) == 30 and len({r["source"] for r in many}) == 10
    assert op.sample_each(rows, 1000).count() == 390


def test_tables_are_replaced(spark, tmp_path):
    save_tables(str(tmp_path), facts=spark.range(5), schemas=spark.range(2))
    save_tables(str(tmp_path), facts=spark.range(7))
    assert table(spark, str(tmp_path), "facts").count() == 7 and table(spark, str(tmp_path), "schemas").count() == 2
