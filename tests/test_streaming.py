from pyspark.sql import functions as F

from pagewarden.functions import terms as T
from pagewarden.streaming import lifecycle as L


def test_lifecycle_stream(spark, tmp_path):
    src = f"{tmp_path}/in"
    days = [[("a", 1, "x"), ("b", 1, "x")], [("a", 2, "x"), ("b", 2, "y")], [("a", 4, "x"), ("a", 1, "late")]]
    schema = "issue_key string, run_day int, facts string"
    for i, rows in enumerate(days):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        q = L.lifecycle_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).outputMode("append").start()
        q.awaitTermination(120)
        assert q.exception() is None, i
    got = sorted((r.issue_key, r.run_day, r.status, r.recurred_count) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", 1, T.NEW, 0), ("a", 2, T.PERSISTING, 0), ("a", 4, T.RECURRED, 1), ("b", 1, T.NEW, 0), ("b", 2, T.CHANGED, 0)]


def test_resolving_stream_is_the_reconciliation_run_by_run(spark, tmp_path):
    """Over a table of events, a batch a run, each run by a query that starts again from its checkpoint."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("concat('k', user_id % 7) issue_key", "cast(event_id % 6 as int) run_day", "concat('f', (event_id % 6) div 3) facts").where("(hash(issue_key) + run_day) % 3 <> 0")
    rows = {(r.issue_key, r.run_day): r.facts for r in events.groupBy("issue_key", "run_day").agg(F.max("facts").alias("facts")).collect()}
    want, was, facts = [], {}, {}
    for day in range(7):
        for key in sorted({k for k, _ in rows}):
            own = rows.get((key, day))
            if own is not None:
                status = T.NEW if key not in was else T.RECURRED if was[key] == T.RESOLVED else T.PERSISTING if facts[key] == own else T.CHANGED
                was[key], facts[key] = status, own
                want.append((key, day, status))
            elif key in was and was[key] != T.RESOLVED:
                was[key] = T.RESOLVED
                want.append((key, day, T.RESOLVED))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", L.ROCKSDB)
    try:
        schema = "issue_key string, run_day int, facts string"
        for day in range(7):
            own = [(k, d, f) for (k, d), f in rows.items() if d == day] or [("tick", day, "")]
            spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
            q = L.resolving_stream(stream, retention_days=1000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).outputMode("append").start()
            q.awaitTermination(120)
            assert q.exception() is None, day
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r.issue_key, r.run_day, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.issue_key != "tick")
    assert sorted(set(want) - set(got)) == sorted(set(got) - set(want)) == [] and len(got) == len(want) and {s for *_, s in got} == {T.NEW, T.PERSISTING, T.CHANGED, T.RESOLVED, T.RECURRED}


def test_verdict_windows(spark):
    df = spark.createDataFrame([("2026-01-01 10:00:00", "t", T.OK), ("2026-01-01 11:00:00", "t", T.ERROR), ("2026-01-02 01:00:00", "t", T.OK)], "at string, target_id string, verdict string").withColumn("checked_at", F.to_timestamp("at"))
    assert sorted((str(r.window.start), r.ok, r.error) for r in L.verdict_windows(df).collect()) == [("2026-01-01 00:00:00", 1, 1), ("2026-01-02 00:00:00", 1, 0)]
