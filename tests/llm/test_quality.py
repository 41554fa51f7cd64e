import zlib

from pyspark.sql import functions as F

from ratingloom.llm import quality

from .helpers import documents, nothing, words


def labelled(spark, n=240):
    rows = [(i, words(i, 60) if i % 4 else " ".join(w.upper() + "!!" for w in words(i, 60).split()), int(i % 4 > 0)) for i in range(n)]
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, quality int, toxic int")


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    out = F.crc32(F.col("__id").cast("string").cast("binary")) % 3 == 1
    model = quality.fit(docs, labels, learn=~out)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(r["score"], truth[r["doc_id"]]) for r in quality.score(docs, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 50 and auc(held) > 0.98


def test_held_out_accuracy_of_the_tables(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, learn=F.crc32(F.col("__id").cast("string").cast("binary")) % 3 != 1)
    rows = quality.score(docs, model).join(labels, "doc_id").collect()
    assert auc([(r["score"], r["quality"]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]) > 0.9


def test_equal_texts_score_alike_and_rows_stay(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels)
    hard = documents(spark)
    scores = quality.score(hard, model)
    assert scores.count() == hard.count()
    assert all(0 <= r["score"] <= 1 for r in scores.collect())
    kept = quality.accepted(hard, model, 0.0)
    assert kept.columns == hard.columns and kept.count() == hard.count()
    assert quality.accepted(hard, model, 1.1).count() == 0


def test_without_labels(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels.where("quality = 1"))
    assert 0.99 < quality.score(docs, model).first()["score"] < 1
    empty = quality.fit(nothing(spark), labels.limit(0))
    assert quality.score(documents(spark), empty).select("score").distinct().collect() == [(0.5,)]
    assert quality.score(nothing(spark), empty).count() == 0
