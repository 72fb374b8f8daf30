import datetime

from pyspark.sql import functions as F

from rivulet.operators import match
from rivulet.streaming import rematch


def _arrive(spark, tmp_path, k, rows):
    spark.createDataFrame(rows, "stream_id long, name string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_winners_of_several_batches_merge_and_replays_change_nothing(spark, tmp_path):
    channels = spark.createDataFrame([(1, "Fox Sports"), (2, "Discovery"), (3, "Nothing like it")], "channel_id long, name string")
    batches = [[(10, "Fox Sport"), (11, "Discovry")], [(5, "Discovery HD"), (12, "Fox Sportz")], [(3, "FoxSports"), (4, "Discovery"), (9, "other")]]
    best = lambda b: match.winners(channels, b, 80, unicode=False)
    sink = str(tmp_path / "out")

    def run(check):
        rematch.on_arrival(spark, str(tmp_path / "in"), "stream_id long, name string", best, sink, str(tmp_path / check), max_files=1).awaitTermination()

    for k, rows in enumerate(batches):
        _arrive(spark, tmp_path, k, rows)
        run("check")
        arrived = spark.createDataFrame([r for b in batches[: k + 1] for r in b], "stream_id long, name string")
        state = {tuple(r) for r in match.described(rematch.current(spark, sink)).collect()}
        assert state == {tuple(r) for r in match.gate(channels, arrived, 80, unicode=False).collect()}
    assert rematch._versions(spark, sink) == [1, 2]
    before = sorted(rematch.current(spark, sink).collect())
    # The last batch once more, as after a failure: its version is made out of the one before it again.
    each = spark.createDataFrame(batches[2], "stream_id long, name string")
    merged = best(each).unionByName(spark.read.parquet(rematch._version(sink, 1))).groupBy("name").agg(F.min("m").alias("m"))
    assert sorted(merged.collect()) == before
    run("another checkpoint")  # all batches again under other numbers
    assert sorted(rematch.current(spark, sink).collect()) == before


def test_values_live_on_while_newer_ones_come(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    start = datetime.datetime(2025, 1, 1, 12)
    minute = lambda m: start + datetime.timedelta(minutes=m)
    # Key 1 is renewed at 50, across the edge of an hour, and so lives to 110; key 2 goes at 65.
    batches = [[(1, minute(0), 5.0), (2, minute(5), 6.0)], [(1, minute(50), 7.0), (1, minute(40), 1.0)], [(3, minute(70), 8.0)], [(3, minute(100), 9.0)], [(4, minute(120), 1.0)], [(4, minute(121), 2.0)]]
    schema = "key long, at timestamp, mbps double"
    rows = []

    def each(batch, number):
        rows.extend((number, r.key, r.mbps, r.alive) for r in batch.collect())

    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        probes = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = rematch.latest_within(probes, "key", "at", 60)
        out.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    seen = [r[1:] for r in rows]
    assert (1, 7.0, True) in seen and (1, 1.0, True) not in seen
    gone = [(key, mbps) for key, mbps, alive in seen if not alive]
    assert gone == [(2, 6.0), (1, 7.0)], seen
