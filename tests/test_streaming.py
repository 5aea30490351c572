"""Streams: footprints by state, windows with late data, batches that run again."""

import datetime

import pytest

from lumenvec.operators import footprint
from lumenvec.sources import store
from lumenvec.streaming import ingest

SCHEMA = "user_id long, ts long, click array<double>, query array<double>"
CLICKS = [(1, 1, [1.0, 0.0], [0.5, 0.5]), (1, 2, [0.0, 1.0], [0.0, 0.5]), (2, 1, [2.0, 2.0], [1.0, 0.5]), (1, 3, [0.5, 0.5], [1.0, 1.0])]


def test_live_footprints_equal_the_batch_ones(spark, tmp_path):
    for k, part in enumerate((CLICKS[:1], CLICKS[1:3], CLICKS[3:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = ingest.source(spark, str(tmp_path / "in/*"), spark.createDataFrame([], SCHEMA).schema, 1)
    out = []
    q = ingest.live_footprints(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r["user_id"]: r for r in out}
    for r in footprint.footprints(spark.createDataFrame(CLICKS, SCHEMA)).collect():
        assert last[r["user_id"]]["footprint"] == pytest.approx(r["footprint"]) and last[r["user_id"]]["n"] == r["n"]


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    schema = "id long, vector array<double>, category string"
    spark.createDataFrame([(1, [1.0], "a"), (2, [3.0], "a")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    root = str(tmp_path / "out")
    for k in range(2):  # a lost checkpoint: batch 0 runs again
        import shutil

        shutil.rmtree(f"{root}/checkpoint", ignore_errors=True)
        ingest.start(ingest.source(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), root, ("category",)).awaitTermination()
        assert ingest.hot(spark, root).count() == 2, k
    assert ingest.statistics(spark, root, "category").first()["n"] == 2


def test_windows_on_a_stream(spark, tmp_path):
    rows = spark.sql("select timestamp_seconds(s) as ts, 1L as user_id from values (0), (10), (70), (4000) as t(s)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.source(spark, str(tmp_path / "in"), rows.schema)
    q = ingest.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.sql("select n from counts").collect()) == [1, 1, 2]
    assert sorted(r["n"] for r in ingest.windowed_counts(rows).collect()) == [1, 1, 2]


def test_hot_records_move_to_the_base(spark, tmp_path):
    """The last batch of an id stands, deleted ones leave the base, other days stay as they are."""
    schema = "id long, vector array<double>, created_at timestamp, op string"
    at = lambda d: datetime.datetime(2024, 1, d, 12)
    root, base = str(tmp_path / "hot"), str(tmp_path / "base")

    def batch(n, data):
        spark.createDataFrame(data, schema).write.parquet(f"{root}/hot/batch={n}")

    batch(0, [(1, [1.0], at(1), "insert"), (2, [2.0], at(2), "insert"), (3, [3.0], at(3), "insert")])
    batch(1, [(2, [2.5], at(2), "update")])
    assert sorted((r["id"], r["vector"]) for r in ingest.current(spark, root, op="op").collect()) == [(1, [1.0]), (2, [2.5]), (3, [3.0])]
    assert ingest.drain(spark, root, base, op="op") == 3 and ingest.drain(spark, root, base, op="op") == 0
    files = {p.name for p in (tmp_path / "base" / "day=19723").glob("*.parquet")}
    batch(2, [(3, None, None, "delete"), (2, [9.0], at(5), "update"), (4, [4.0], at(5), "insert")])
    assert ingest.drain(spark, root, base, op="op") == 2
    got = {r["id"]: (r["vector"], r["day"]) for r in store.read_base(spark, base).collect()}
    assert got == {1: ([1.0], 19723), 2: ([9.0], 19727), 4: ([4.0], 19727)}
    assert {p.name for p in (tmp_path / "base" / "day=19723").glob("*.parquet")} == files


def test_duplicate_ids(spark):
    known = spark.createDataFrame([(1, "a")], "id long, t string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c"), (None, "d")], "id long, t string")
    ids = lambda df: sorted(str(r["id"]) for r in df.collect())
    assert [ids(x) for x in ingest.accepted(new, known)] == [["1", "2"], ["None"]]
    assert [ids(x) for x in ingest.accepted(new, known, "refuse")] == [["2"], ["1", "None"]]
    with pytest.raises(ValueError):
        ingest.accepted(new, known, "other")


def test_log_and_days_in_memory(spark, tmp_path):
    path = str(tmp_path / "log")
    store.append_log(spark.createDataFrame([(1, "insert", 7, "a"), (2, "update", 7, "b")], "txn_id long, op string, id long, v string"), path)
    store.append_log(spark.createDataFrame([(3, "delete", 7, None), (4, "insert", 8, "c")], "txn_id long, op string, id long, v string"), path)
    assert [(r["id"], r["v"]) for r in store.replayed(spark.read.parquet(path)).collect()] == [(8, "c")]
    held = store.promoted(spark.createDataFrame([(1, 5), (2, 6)], "id long, day long"), [6])
    assert held.is_cached and [r["id"] for r in held.collect()] == [2]
    held.unpersist()
