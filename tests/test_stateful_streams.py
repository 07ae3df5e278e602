"""Streams that keep state: stopped, started again, and compared with a fold over all rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.streaming import operators as ST

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_posteriors_resume_from_their_checkpoint_and_forget_silent_arms(spark, tmp_path, rocks):
    schema = "arm string, source string, ts timestamp, x double"
    batches = [
        [("a", "p", START + dt.timedelta(hours=h), 0.1 * h) for h in range(4)] + [("b", "q", START, 1.0)],
        [("a", "q", START + dt.timedelta(hours=5 + h), -0.2) for h in range(3)],
        [("a", "p", START + dt.timedelta(days=3), 0.5)],
        [("c", "p", START + dt.timedelta(days=3, hours=1), 0.5)],
    ]
    at, out = tmp_path / "in", []

    def run():
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(at))
        q = ST.forgetting_posteriors(src).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
        q.foreachBatch(lambda df, _: out.extend(df.collect())).start().awaitTermination()

    for rows in batches:
        land(spark, at, rows, schema)
        run()  # every run starts anew from the checkpoint
    # Time passes by what has been read: a is heard of again before its quiet day is over, b is not.
    assert [(r["arm"], r["n"], r["sources"]) for r in out if r["gone"]] == [("b", 1, 1)]
    state, heard = (0.0, 1.0, 2.0, 1.0, 0), [r for r in out if r["arm"] == "a"]
    assert [r["n"] for r in heard] == [4, 7, 8] and [r["sources"] for r in heard] == [1, 2, 2]
    for r, rows in zip(heard, batches, strict=False):
        state = ST.decayed_posterior(state, [x for arm, _, _, x in rows if arm == "a"])
        assert (r["mu"], r["kappa"], r["alpha"], r["beta"]) == pytest.approx(state[:4])


def test_experience_survives_a_crash_and_takes_new_columns(spark, tmp_path):
    src, path, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    land(spark, src, [(i, START + dt.timedelta(hours=7 * i), float(i)) for i in range(10)], "id long, ts timestamp, x double")

    def run(schema, broken=False):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        if broken:
            rows = rows.withColumn("x", F.when(F.col("id") == 15, F.raise_error(F.lit("crash")).cast("double")).otherwise(F.col("x")))
        ST.experience_sink(rows, path, ck).trigger(availableNow=True).start().awaitTermination()

    run("id long, ts timestamp, x double")
    land(spark, src, [(i, START + dt.timedelta(hours=7 * i), float(i)) for i in range(10, 20)], "id long, ts timestamp, x double")
    with pytest.raises(Exception, match="crash"):
        run("id long, ts timestamp, x double", broken=True)
    assert ST.experience(spark, path).count() == 10
    run("id long, ts timestamp, x double")
    land(spark, src, [(20, START, 1.0, "new")], "id long, ts timestamp, x double, note string")
    run("id long, ts timestamp, x double, note string")
    run("id long, ts timestamp, x double, note string")
    got = ST.experience(spark, path).collect()
    assert sorted(r["id"] for r in got) == list(range(21))
    assert {r["note"] for r in got if r["id"] < 20} == {None} and [r["note"] for r in got if r["id"] == 20] == ["new"]
    assert {str(r["day"]) for r in got} == {str((START + dt.timedelta(hours=7 * i)).date()) for i in range(20)}
