import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lumenvec import shared


def test_shared_dir(spark):
    assert shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    bare = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(applicationId="app-1", master=master))
    first = shared.shared_dir(bare("local[4]"))
    assert first.startswith("file:///") and shared.shared_dir(bare("local[*]")) == first
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared.shared_dir(bare(master))


def test_written_keeps_schema_and_rows(spark):
    df = spark.createDataFrame([(1, "a"), (None, None)], "id long, t string")
    out = shared.written(df, "x")
    assert out.schema == df.schema and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert shared.written(df.limit(0), "x").collect() == []
    path = out._written_to.removeprefix("file://")
    assert os.path.isdir(path)
    shared.dropped(out)
    assert not os.path.exists(path)


def test_in_order(spark):
    df = spark.range(500).select((F.col("id") % 97).alias("x"), "id").repartition(5)
    got = shared.in_order(df, F.col("x").desc(), F.col("id")).orderBy("_part", "_n").collect()
    assert [(r["x"], r["id"]) for r in got] == sorted([(k % 97, k) for k in range(500)], key=lambda r: (-r[0], r[1]))


def test_nothing_else_imports_the_training_operators():
    for d, _, names in os.walk(os.path.dirname(shared.__file__)):
        for name in names:
            if name.endswith(".py") and "llm" not in d:
                assert "llm" not in open(os.path.join(d, name)).read(), name
