from driftline.operators import stays
from driftline.sources import traces
from driftline.streaming import sessions


def test_streamed_sessions_equal_the_batch_cut(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    points = traces.points_of_events(events).filter("user_id < 6")
    points.repartition(1).sortWithinPartitions("datetime").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    query = sessions.gap_sessions(stream).writeStream.outputMode("complete").format("memory").queryName("sessions").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.user_id, r.num_points) for r in spark.table("sessions").collect())
    want = stays.gap_chains(points).groupBy("user_id", "chain").count().collect()
    assert got == sorted((r.user_id, r["count"]) for r in want)


def test_plt_scan(spark, tmp_path):
    folder = tmp_path / "Data" / "007" / "Trajectory"
    folder.mkdir(parents=True)
    head = "".join(f"h{i}\n" for i in range(6))
    body = "39.9,116.3,0,492,39744.1,2008-10-23,02:53:04\nbad,116.3,0,-777,39744.1,2008-10-23,02:53:10\n39.9,116.3,0,492,x,not,a-date\n"
    (folder / "a.plt").write_text(head + body)
    rows = traces.read_plt(spark, str(tmp_path / "Data" / "*" / "Trajectory" / "*.plt")).orderBy("ord").collect()
    assert [(r.user_id, r.source_file, r.ord, r.lat, r.altitude) for r in rows] == [("007", "a.plt", 6, 39.9, 492.0), ("007", "a.plt", 7, None, -777.0)]
