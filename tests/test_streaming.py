from fissure.streaming.edges import append_edges, read_edges, running_degrees


def test_edges_stream(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    edge = "src bigint, dst bigint"
    spark.createDataFrame([(1, 2), (1, 2)], edge).write.parquet(source)
    append_edges(read_edges(spark, source), out, f"{tmp_path}/c").awaitTermination(60)
    spark.createDataFrame([(2, 1)], edge).write.mode("append").parquet(source)
    append_edges(read_edges(spark, source), out, f"{tmp_path}/c").awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, 2), (1, 2), (2, 1)]
    q = running_degrees(read_edges(spark, source)).writeStream.format("memory").queryName("degrees").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("degrees").collect())) == [(1, 2), (2, 1)]
