from lumenvec.llm import common


def test_unused(spark):
    df = spark.createDataFrame([(1, 2)], "_row int, _ROW_ int")
    assert common.unused(df, "_row", "x", "x") == ["__row", "x", "_x"]


def test_stable(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where("id > 3")
    assert common.stable(df) is df
    dealt = df.repartition(5, "id")
    out = common.stable(dealt)
    assert out is not dealt and out.schema == dealt.schema and out.count() == 96 and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
