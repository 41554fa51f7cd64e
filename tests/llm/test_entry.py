import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from ratingloom.llm import entry, pii, quality, simhash, storage

from .helpers import hard_texts, words
from .test_suffix_dedup import brute as brute_repeats


def test_all_operators_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert names["pipeline"] is corpus_pipeline.run
    assert set(entry.ORACLES) <= set(entry.QUERIES)


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_queries_equal_their_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for table in ("embeddings", "pages", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.execute(entry.ORACLES[name]).df()
    got = entry.QUERIES[name](spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = lambda df: df[columns].astype(str).replace({"<NA>": "nan", "None": "nan"}).replace(r"\.0$", "", regex=True).sort_values(columns).values.tolist()
    assert order(got) == order(want)


def _corpus(spark, tmp_path):
    shared = words(77, 60)
    texts = [words(i, 80) for i in range(40)] + [" ".join(w.upper() + "!!" for w in words(i, 80).split()) for i in range(40, 60)]
    texts += [texts[0], texts[1] + " " + shared, texts[2] + " " + shared, "write to me@host.example.com or 10.1.2.3 " + words(90, 40)]
    near = texts[5].split()
    texts += [" ".join([*near[:40], "other", *near[41:]]), words(91, 30) + " call (603) 555-8791 or write joe (at) example (dot) org " + words(92, 30), words(93, 6000)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 40 or i >= 60), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return texts


def _one_of_each(texts):
    """The ids that near-duplicate removal keeps: links by the Jaccard similarity of five-word shingles, all pairs compared."""
    sets, root = {}, {d: d for d in texts}
    for d, t in texts.items():
        w = (t or "").lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(texts), 2):
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d for d in texts if find(d) == d}


def _redacted(text, spans):
    out, at = "", 0
    for start, kind, end in spans:
        if start >= at:
            out += text[at:start] + f"[{pii.KINDS[kind].upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Each stage, over what the one before kept, against a plain computation; then the whole run."""
    _corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, held = docs.columns, lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    before, names = held(docs), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "repeats", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "quality":
            model = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
            want = {d: t for d, t in before.items() if model.scores([t])[0] >= 0.5}
            assert set(range(40)) <= set(want) and len(set(want) & set(range(40, 60))) <= 2
        elif name == "near_dedup":
            want = {d: before[d] for d in _one_of_each(before)}
            assert not {60, 64} & set(want) and {0, 5} <= set(want)
        elif name == "repeats":
            want = {d: kept.decode("utf-8", "ignore") for d, (_, _, _, kept) in zip(sorted(before), brute_repeats([before[d] for d in sorted(before)], 200))}
            assert all(len(want[d]) < len(before[d]) for d in (61, 62)) and want[66] == before[66]
        else:
            spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find(docs, pii.fit(docs)).collect()}
            want = {d: _redacted(t, spans[d]) for d, t in before.items()}
            assert "[EMAIL]" in want[63] and "[IP]" in want[63] and "me@host" not in want[63] and "[PHONE]" in want[65] and "[EMAIL]" in want[65]
        docs = storage.stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        before = held(docs)
        assert before == want, name
    library, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for d in sorted(before):
        ids = library.encode(before[d], add_special_tokens=False).ids + [1]
        want += [(d, i, 4096 * i, len(part := ids[4096 * i : 4096 * (i + 1)]), zlib.crc32(np.array(part, "<u4").tobytes())) for i in range(-(-len(ids) // 4096))]
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in final) == want
    sequences = {}
    for r in final:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 4096


def test_stages_take_hard_rows(spark, tmp_path):
    _corpus(spark, tmp_path)
    rows = [(i, t, None, None, None) for i, t in enumerate(hard_texts())] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() > 0
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session())


def test_no_local_checkpoints():
    import inspect

    for module in (quality, simhash, storage):
        assert "localCheckpoint" not in inspect.getsource(module)
