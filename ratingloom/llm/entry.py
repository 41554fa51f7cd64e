"""The queries of this subpackage, by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, delta_lloyd, host_rules, iso_media, packing, pii, quality, simhash, source_audit, suffix_dedup, token_files, va_file, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_va_file_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", va_file.scaled(F.col("embedding"), 64).alias("vector"))
    found = va_file.top_k(vectors, F.col("vec_id") % 20 == 0, k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, distance=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_elias_fano_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read(spark, manifest, digest_only=True)


def op4_pii_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")  # noqa: E731
    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op5_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 3 == 1, F.lit(False))  # noqa: E731
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), learn=~held_out("__id"))
    return quality.score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.digests(byte_bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)


def op7_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iso_media.digests(iso_media.probe(iso_media.store(_table(spark, sf_dir, "documents"))))


def op8_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)
    return packing.pack(cut, capacity=4096)


def op9_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(_table(spark, sf_dir, "pages"), least=1000)
    return warc.index(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_suffix_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeats(_table(spark, sf_dir, "documents"), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_systolic_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(_table(spark, sf_dir, "documents"), min_docs=10, top=10)


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", va_file.scaled(F.col("embedding"), 1024).alias("vector"))
    first = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    return delta_lloyd.described(delta_lloyd.cluster(vectors, k=8, rounds=10, first=first, dim=64))


def op13_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = host_rules.judge(_table(spark, sf_dir, "documents"), F.col("source"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {
    "op1_va_file_top_k": op1_va_file_top_k,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_elias_fano_token_files": op3_elias_fano_token_files,
    "op4_pii_candidates": op4_pii_candidates,
    "op5_compression_quality": op5_compression_quality,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_iso_media": op7_iso_media,
    "op8_best_two_fit_packing": op8_best_two_fit_packing,
    "op9_warc_capture_index": op9_warc_capture_index,
    "op10_suffix_merge_dedup": op10_suffix_merge_dedup,
    "op11_systolic_source_audit": op11_systolic_source_audit,
    "op12_delta_lloyd": op12_delta_lloyd,
    "op13_host_rules": op13_host_rules,
}

_OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p
), m AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS kept FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN kept END AS refers_to
FROM m
"""

#: Windows are compared by their MD5; s to g join the places of repeated windows to runs, gaps are what stays between these.
_OP10_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), w AS MATERIALIZED (
  SELECT r, p, md5(b[p:p + 199]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS p FROM d WHERE octet_length(b) >= 200)
), hit AS (
  SELECT r, p FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)
), s AS (
  SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM hit
), g AS (
  SELECT r, min(p) AS a, max(p) + 199 AS z FROM (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS n FROM s) GROUP BY r, n
), gaps AS (
  SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) + 1 AS a, a - 1 AS z FROM g
  UNION ALL SELECT d.r, coalesce(max(z), 0) + 1, any_value(octet_length(b)) FROM d LEFT JOIN g ON g.r = d.r GROUP BY d.r
), kept AS (
  SELECT gaps.r, coalesce(string_agg(hex(b[gaps.a:gaps.z]), '' ORDER BY gaps.a) FILTER (WHERE gaps.z >= gaps.a), '') AS k FROM gaps JOIN d ON d.r = gaps.r GROUP BY gaps.r
), n AS (
  SELECT r, CAST(sum(z - a + 1) AS BIGINT) AS removed, count(*) AS spans FROM g GROUP BY r
)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept ON kept.r = d.r LEFT JOIN n ON n.r = d.r
"""

_OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS MATERIALIZED (
  SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), langs AS MATERIALIZED (
  SELECT lang, count(term) AS v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang
), own AS (
  SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), g AS MATERIALIZED (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN own USING (lang, source) GROUP BY lang, source
), p AS MATERIALIZED (
  SELECT g.lang, g.source, kept.term, coalesce(own.n, 0) AS n,
         CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(own.n, 0) + 2)) // (g.total + 2 * langs.v) AS BIGINT) AS p,
         CAST(1 + (CAST(1000000000 AS HUGEINT) * (kept.n + 2)) // (langs.total + 2 * langs.v) AS BIGINT) AS q
  FROM g JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = kept.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source
  ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT * FROM (
    SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value, row_number() OVER (PARTITION BY lang, source ORDER BY ((p - q) * (p - q)) // (p + q) DESC, term) AS rank
    FROM p WHERE n > 0 AND p > q
  ) WHERE rank <= 10
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
"""


def _lloyd_sql(k: int, rounds: int, dim: int, factor: int, salt: str) -> str:
    """SQL of op12: a centroid is a row for each component; each round is two steps."""
    steps = [f"""
WITH x AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({factor} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), e AS MATERIALIZED (
  SELECT r, unnest(v) AS x, unnest(range({dim})) AS i FROM x
), c0 AS MATERIALIZED (
  SELECT c, unnest(v) AS y, unnest(range({dim})) AS i FROM (SELECT CAST(row_number() OVER (ORDER BY sha256('{salt}' || vec_id) NULLS LAST, v) - 1 AS INTEGER) AS c, v FROM x) WHERE c < {k}
)"""]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT r, min_by(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM e JOIN c{n} USING (i) GROUP BY r, c) GROUP BY r
)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT c{n}.c, i, CASE WHEN m.n IS NULL THEN y ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS y
  FROM c{n} LEFT JOIN (SELECT c, i, sum(x) AS s, count(*) AS n FROM e JOIN a{n} USING (r) GROUP BY c, i) m ON m.c = c{n}.c AND m.i = c{n}.i
)""".replace("SELECT c" + str(n) + ".c, i,", "SELECT c" + str(n) + ".c, c" + str(n) + ".i,"))
    return ", ".join(steps) + f""", h AS (
  SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c
)
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN x USING (r) JOIN h USING (c)
"""


_OP13_RULES = " ".join(
    f"""
, CAST(100 * CAST({r.part} AS HUGEINT) {"<" if r.low else ">"} {r.strict} * {r.whole} AS INTEGER) AS {r.name}_f, 100 * CAST({r.part} AS HUGEINT) {"<" if r.low else ">"} {r.severe} * {r.whole} AS {r.name}_s"""
    for r in host_rules.RULES
)
_OP13_PRIORS = ", ".join(
    f"""sum({r.name}_f) AS {r.name}_f, sum(CAST({r.name}_f AS DOUBLE) * {r.name}_f / n) - CAST(sum({r.name}_f) AS DOUBLE) * sum({r.name}_f) / sum(n) AS {r.name}_v"""
    for r in host_rules.RULES
)
_OP13_BAD = " OR ".join(
    f"""(x.{r.name}_f = 1 AND (h.{r.name}_h + p.{r.name}_f / p.n * p.{r.name}_k) / (h.n + p.{r.name}_k) > 0.3)"""
    for r in host_rules.RULES
)
_OP13_STRENGTH = ", ".join(
    f"""1 / least(greatest(CASE WHEN {r.name}_f > 0 AND {r.name}_f < n AND room > 0 THEN ({r.name}_v / ({r.name}_f / n * (1 - {r.name}_f / n)) - (hosts - 1)) / room ELSE 0 END, 0.001), 0.5) - 1 AS {r.name}_k"""
    for r in host_rules.RULES
)
_OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), m AS MATERIALIZED (
  SELECT r, doc_id, host, text, regexp_extract_all(text, '[^ 	-]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) AS lines FROM d
), w AS (
  SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM m
), g AS (
  SELECT r, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY i)
), again AS (
  SELECT r, i FROM g WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM again, range(3) t(k) GROUP BY r
), f AS (
  SELECT m.r, doc_id, host, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(len(list_filter(words, lambda x: ends_with(x, '!!'))) AS BIGINT) AS n_loud
  FROM m LEFT JOIN covered ON covered.r = m.r
), x AS MATERIALIZED (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed {_OP13_RULES} FROM f
), hosts AS (
  SELECT host, count(*) AS n, {", ".join(f"sum({r.name}_f) AS {r.name}_f" for r in host_rules.RULES)} FROM x GROUP BY host
), every AS (
  SELECT CAST(sum(n) AS DOUBLE) AS n, count(*) AS hosts, sum(n) - sum(CAST(n AS DOUBLE) * n) / sum(n) - (count(*) - 1) AS room, {_OP13_PRIORS} FROM hosts
), p AS (
  SELECT *, {_OP13_STRENGTH} FROM every
), h AS (
  SELECT host, n, {", ".join(f"{r.name}_f AS {r.name}_h" for r in host_rules.RULES)} FROM hosts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR {" OR ".join(f"{r.name}_s" for r in host_rules.RULES)} OR {_OP13_BAD}) AS kept
FROM x JOIN h ON h.host = x.host CROSS JOIN p
"""

ORACLES: dict[str, str] = {
    "op1_va_file_top_k": _OP1_SQL,
    "op9_warc_capture_index": _OP9_SQL,
    "op10_suffix_merge_dedup": _OP10_SQL,
    "op11_systolic_source_audit": _OP11_SQL,
    "op12_delta_lloyd": _lloyd_sql(8, 10, 64, 1024, "3:"),
    "op13_host_rules": _OP13_SQL,
}
