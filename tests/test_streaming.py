from ratingloom.operators.serving import live_ratings
from ratingloom.sources import testdata
from ratingloom.streaming import ratings as streaming


def test_stream_equals_the_batch(spark, sf_dir, tmp_path):
    events = testdata.rating_events(spark, sf_dir)
    source = f"{tmp_path}/events"
    events.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = streaming.maintain(stream, f"{tmp_path}/state", f"{tmp_path}/checkpoint", delay="3650 days")
    query.awaitTermination(120)
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "state").iterdir())
    key = lambda df: sorted((r["user_id"], r["item_id"], r["rating"]) for r in df.collect())
    assert last >= 2 and key(streaming.current(spark, f"{tmp_path}/state", last)) == key(live_ratings(events))


def test_windows_count_events(spark, sf_dir, tmp_path):
    events = testdata.rating_events(spark, sf_dir)
    events.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    query = streaming.counted(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("windows").groupBy().sum("n").first()[0] == events.count()
