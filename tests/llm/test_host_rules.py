import re
from collections import Counter

from pyspark.sql import functions as F

from ratingloom.llm import host_rules
from ratingloom.llm.host_rules import RULES

from .helpers import documents, hard_texts, nothing, words


def brute(text):
    text = text or ""
    found = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    earlier = sum(line in lines[:i] for i, line in enumerate(lines))
    return (len(found), sum(len(w) for w in found), len(re.findall("[#*$%&|<>]", text)), earlier, len(covered), len(lines), sum(w.endswith("!!") for w in found))


def test_measures_equal_a_plain_count():
    texts = [*hard_texts(), "a b c a b c a b", "a b\n\n a b\na b\n\x0b\n \n", "a a a a", "a b c", "x\x1cy z #*$%&|<> &&", "no!! no!! !!\n!!", " em space　wide", "a\rb\rc a\rb\rc"]
    for text in texts:
        if text is None or len(text) < 30_000:
            assert host_rules.measures(text) == brute(text), text
    assert host_rules.measures(hard_texts()[12])[0] == 20_000


def test_one_row_for_each_document_with_nulls_and_clashing_columns(spark):
    docs = documents(spark).withColumn("host", F.lit(1)).withColumn("n_words", F.lit("x")).withColumn("kept", F.lit("x"))
    rows = host_rules.judge(docs, F.col("source")).collect()
    assert len(rows) == docs.count()
    texts = dict(enumerate(hard_texts()))
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] != 3 and len(texts[r["doc_id"]] or "") < 30_000:
            assert tuple(r[m] for m in host_rules.MEASURES) == brute(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert any(r["kept"] for r in rows)
    assert host_rules.judge(nothing(spark).withColumn("n_words", F.lit("x")), F.col("source")).collect() == []


def _hosts(spark):
    clean = [words(i, 80) for i in range(60)]
    marked = [" ".join(w + ("#" if k % 7 == 0 else "") for k, w in enumerate(words(100 + i, 80).split())) for i in range(40)]  # a strict failure, not a severe one
    severe = [" ".join(w + "###" for w in words(200 + i, 80).split()) for i in range(5)]
    rows = [(i, t, "good") for i, t in enumerate(clean)] + [(100 + i, t, "bad") for i, t in enumerate(marked[:30])] + [(130, marked[30], "good"), (131, clean[0], "bad"), (132, marked[31], None), (133, marked[32], "new")]
    return spark.createDataFrame(rows + [(200 + i, t, "good") for i, t in enumerate(severe)], "doc_id long, text string, source string"), rows


def test_a_bad_host_is_held_to_the_strict_limits_and_its_clean_documents_stay(spark):
    docs, rows = _hosts(spark)
    kept = {r["doc_id"]: r["kept"] for r in host_rules.judge(docs, F.col("source")).collect()}
    assert all(kept[i] for i in range(60)) and kept[131]  # clean, whatever the host
    assert not any(kept[100 + i] for i in range(30))  # strict failures of a host that is bad at it
    assert kept[130]  # the same failure of a good host
    assert not any(kept[200 + i] for i in range(5))  # severe ones anywhere
    verdicts = {r["host"]: r for r in host_rules.host_verdicts(host_rules.host_counts(host_rules.measure(docs, F.col("source")))).collect()}
    # a single document doesn't make a rate of 1
    assert verdicts["bad"]["symbols_bad"] and not verdicts["good"]["symbols_bad"] and 0.3 < verdicts["new"]["symbols_rate"] < 1 and "" in verdicts
    assert verdicts["bad"]["symbols_rate"] < 30 / 31 and not any(verdicts["bad"][f"{r.name}_bad"] for r in RULES if r.name != "symbols")


def test_verdicts_are_the_same_without_a_broadcast(spark, monkeypatch):
    docs, _ = _hosts(spark)
    want = sorted(map(tuple, host_rules.judge(docs, F.col("source")).collect()))
    monkeypatch.setattr(host_rules, "SENT", -1)
    assert sorted(map(tuple, host_rules.judge(docs, F.col("source")).collect())) == want


def test_prior_moments():
    # hosts that are all alike, or all or none: the least and the most that is told by a host
    assert sum(host_rules.prior(0.5, 0.0, 10, 1000.0, 100_000.0)) == 999
    assert sum(host_rules.prior(0.5, 250.0, 10, 1000.0, 100_000.0)) == 1
    # 100 hosts of 50 documents whose rates are spread by a beta of strength 9
    mean, n, hosts = 0.3, 50, 100
    spread = mean * (1 - mean) * ((hosts - 1) + 0.1 * (n * hosts - n - (hosts - 1)))
    assert abs(sum(host_rules.prior(mean, spread, hosts, float(n * hosts), float(n * n * hosts))) - 9) < 1e-9


def test_labelled_documents(spark, sf_dir):
    """Of the labelled documents that aren't short or repeated, all good ones stay; of the bad ones most go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = host_rules.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("source")).join(labels, "doc_id").where("not base_failed or quality = 0").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert all(good) and sum(bad) <= 0.5 * len(bad)
