"""The streaming forms with a running stream each, against the same rows as a table."""

from pyspark.sql import functions as F

from evloom import streaming


def _stream(spark, rows, schema, folder, files):
    """Writes rows as `files` files, read one for each micro-batch."""
    n = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * n : (i + 1) * n], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_event_windows(spark, tmp_path):
    rows = [("a" if i % 3 else "b", f"2024-01-{1 + i // 8:02d} 0{i % 8}:00:00", float(i)) for i in range(32)]
    schema = "event_type string, ts string, value double"
    stream = _stream(spark, rows, schema, tmp_path / "in", 2)
    out = streaming.event_windows(stream.withColumn("ts", F.to_timestamp("ts")))
    q = out.writeStream.outputMode("complete").format("memory").queryName("windows_out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    table = streaming.event_windows(spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts")))
    assert sorted(spark.table("windows_out").collect()) == sorted(table.collect())


def test_bounded_queues(spark, tmp_path):
    rows = [("k", i, "work", "") for i in range(6)] + [("k", 6, "done", ""), ("j", 7, "work", "")]
    stream = _stream(spark, rows, "key string, seq long, type string, payload string", tmp_path / "in", 1)
    q = streaming.bounded_queues(stream, 3).writeStream.outputMode("update").format("memory").queryName("queues_out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["key"]: (r["size"], r["oldest"], r["closed"]) for r in spark.table("queues_out").collect()} == {"k": (3, 4, True), "j": (1, 7, False)}


def test_rounds_restart(spark, tmp_path):
    seen = []
    rows = [(i,) for i in range(4)]
    for _ in range(2):
        stream = _stream(spark, rows, "x long", tmp_path / "in", 2)
        streaming.process_rounds(stream, lambda df, n: seen.append((n, df.count())), str(tmp_path / "ck")).awaitTermination(120)
    assert [n for n, _ in seen] == list(range(len(seen))) and sum(c for _, c in seen) == 8


def test_event_feed_timers_and_restart(spark, tmp_path):
    """Silence gives keep-alives; a restart goes on with the queue it left; a terminal event clears its key after a while and no other."""
    import time

    schema = "key string, seq long, event string, data string, status string"
    got = []
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streaming.ROCKSDB)

    def start():
        events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = streaming.event_feed(events, silence=1500, linger=4000, most=3)
        return out.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()

    def put(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def wait(q, ready):
        until = time.time() + 60
        while not ready():
            assert q.isActive and time.time() < until, (q.exception(), got)
            time.sleep(0.2)

    lines = lambda key: [r.line for r in got if r.key == key]
    try:
        put(*(("a", k, "step", f"{{{k}}}", None) for k in range(5)), ("b", 0, "step", "x", None))
        q = start()
        wait(q, lambda: ": keepalive\n\n" in lines("a") and ": keepalive\n\n" in lines("b"))
        q.stop()
        assert lines("a")[:5] == [f"event: step\ndata: {{{k}}}\n\n" for k in range(5)] and {r.held for r in got if r.key == "a"} == {3}
        mark = len(got)
        put(("a", 5, "status", "over", "done"), ("b", 1, "status", "on", "running"))
        q = start()
        wait(q, lambda: "" in lines("a"))
        q.stop()
        after = got[mark:]
        assert [r.held for r in after if r.key == "b" and r.seq == 1] == [2] and [r.held for r in after if r.key == "a" and r.seq == 5] == [3]
        ends = [r for r in after if r.key == "a"][-1]
        assert (ends.line, ends.held) == ("", 0) and "" not in lines("b")
        assert ends.at - next(r.at for r in after if r.seq == 5) >= 4000
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
