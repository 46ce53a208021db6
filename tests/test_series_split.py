"""The labelled series of the model queries are built once, whatever reads them."""

from pyspark.sql import functions as F

from flowsieve.catalog import models
from flowsieve.operators import rollup


def _lines(spark, folder):
    rows = spark.range(4000).selectExpr(
        "id div 4 AS l_orderkey", "id % 37 AS l_partkey", "id % 11 AS l_suppkey", "CAST(id % 4 AS INT) AS l_linenumber", "CAST(id % 50 AS DOUBLE) AS l_quantity",
        "CAST(id * 3 AS DOUBLE) AS l_extendedprice", "CASE WHEN id % 3 = 0 THEN 'R' ELSE 'N' END AS l_returnflag",
    )
    rows.write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_split_reads_written_rows(spark, tmp_path):
    sf = _lines(spark, tmp_path)
    for scale in (False, True):
        train, test = models._split(spark, sf, scale=scale)
        for part in (train, test):
            plan = part._jdf.queryExecution().executedPlan().toString()
            assert "lineitem" not in plan and "Exchange" not in plan and "ubquery" not in plan and "parquet" in plan
        ids = [r.row_id for r in train.select("row_id").collect() + test.select("row_id").collect()]
        assert sorted(ids) == list(range(1000)) and test.count() > 0
        assert train.unionByName(test).where("anomaly = 1").count() == 10


def test_bounds_are_read_once(spark):
    df = spark.createDataFrame([(1, 2.0, 5), (2, 4.0, 5), (3, None, 5)], "id int, a double, b int")
    scaled = rollup.scaled_columns(df, ["a", "b"])
    assert "ubquery" not in scaled._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in scaled.orderBy("id").collect()] == [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, None, 0.0)]
    assert rollup.scaled_columns(df.where(F.lit(False)), ["a"]).count() == 0
