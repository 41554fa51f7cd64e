"""Quality rules judged with the help of a document's host.

Each document is measured once, whole, and fails a rule strictly or severely. Strict failures are added up by
host, and a host's failing rate is shrunk towards the rate of all hosts by a beta prior whose mean and strength
come from the hosts themselves, so that a host of few documents isn't judged by chance. A host whose shrunk rate
passes a limit is held to the strict limit of that rule; elsewhere only a severe failure counts. A document that
passes the strict limits is kept whatever its host.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import slices, stored

WORDS = re.compile("[^\x20\x09-\x0d]+")
SYMBOLS = "#*$%&|<>"
#: What measure() tells of a text, all of them longs.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_loud")
#: Bytes of verdicts that may be sent to all tasks; more of them are joined by a shuffle.
SENT = 8 << 20


@dataclasses.dataclass(frozen=True)
class Rule:
    """A share of two measures, in hundredths, that a document should stay at or below (or, with ``low``, at or above)."""

    name: str
    part: str
    whole: str
    strict: int
    severe: int
    low: bool = False

    def failed(self, limit: int) -> Column:
        part, whole = 100 * F.col(self.part), limit * F.col(self.whole)
        return part < whole if self.low else part > whole


RULES = (
    Rule("symbols", "n_symbols", "n_words", 10, 20),
    Rule("dup_lines", "n_dup_lines", "n_lines", 30, 70),
    Rule("repeats", "n_repeat_words", "n_words", 20, 50),
    Rule("long_words", "word_chars", "n_words", 1000, 1500),
    Rule("short_words", "word_chars", "n_words", 300, 200, low=True),
    Rule("loud", "n_loud", "n_words", 10, 50),
)


def _in_repeats(words: list[str]) -> int:
    """Words in windows of three that are found twice or more, the first one included."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    _, place, count = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    again = count[place] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def measures(text: str | None) -> tuple[int, ...]:
    """MEASURES of a text: words and their code points, symbols, lines with a word and those equal to an earlier one, words in repeated windows, words that end in two exclamation marks."""
    if not text:
        return (0,) * len(MEASURES)
    words = WORDS.findall(text)
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), _in_repeats(words), len(lines), sum(w.endswith("!!") for w in words))


def measure(docs: DataFrame, host: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, host, MEASURES, base_failed), one row for each row of docs; a null text has no words, a null host is ''.

    base_failed: fewer than 50 words, or more than half of them in repeated windows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([measures(t.as_py()) for t in batch.column(2)], np.int64).reshape(batch.num_rows, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, found.T)], ["doc_id", "host", *MEASURES])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(run, f"doc_id {kind}, host string, " + ", ".join(f"{m} bigint" for m in MEASURES))
    return found.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def host_counts(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(host, n, one count of strict failures for each rule); added up in each task first, so that a host of very many documents is one row a task."""
    return measured.groupBy("host").agg(F.count("*").alias("n"), *(F.count(F.when(r.failed(r.strict), 1)).alias(r.name) for r in rules))


def prior(mean: float, spread: float, hosts: int, n: float, squares: float) -> tuple[float, float]:
    """(a, b) of a beta prior by moments: ``spread`` is the sum of n (rate - mean)^2 over hosts, ``squares`` of n^2.

    The share of the variance that lies between hosts, beyond what chance alone gives, sets its strength: from 1
    (hosts tell all) to 999 documents (hosts are alike, or there is one only).
    """
    between, room = 0.0, n - squares / n - (hosts - 1) if n else 0.0
    if 0 < mean < 1 and room > 0:
        between = (spread / (mean * (1 - mean)) - (hosts - 1)) / room
    strength = 1 / min(max(between, 1e-3), 0.5) - 1
    return mean * strength, (1 - mean) * strength


def host_verdicts(counts: DataFrame, limit: float = 0.3, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(host, n, and for each rule its shrunk rate <rule>_rate and whether it passes the limit, <rule>_bad) of host_counts()."""
    moments = [x for r in rules for x in (F.sum(r.name).alias(r.name), F.sum(F.col(r.name) * F.col(r.name) / F.col("n")).alias(f"{r.name}_2"))]
    all_hosts = counts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), *moments).first()
    out, total = counts.select("host", "n", *(r.name for r in rules)), float(all_hosts["n"] or 0)
    for r in rules:
        failed = float(all_hosts[r.name] or 0)
        a, b = prior(failed / total, all_hosts[f"{r.name}_2"] - failed * failed / total, all_hosts["hosts"], total, all_hosts["squares"]) if total else (0.0, 1.0)
        rate = (F.col(r.name) + F.lit(a)) / (F.col("n") + F.lit(a + b))
        out = out.withColumn(f"{r.name}_rate", rate).withColumn(f"{r.name}_bad", F.col(f"{r.name}_rate") > limit)
    return out


def judge(docs: DataFrame, host: Column, limit: float = 0.3, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measure()'s rows with ``kept``: not base_failed, no severe failure, and no strict failure of a rule that the host is bad at.

    One row for each row of docs, in whatever number an id repeats; of the other columns only those of ``host``
    are read, so that none can clash. Null and empty texts fail the base rules. An empty table has no rows.
    Measures are kept on shared storage, as they are needed twice: for the hosts, then for the documents. Only
    hosts that are bad at something are joined back; they are sent to all tasks where their number and names are
    counted to be small, and joined by a shuffle, whose skewed keys Spark splits, where they aren't.
    """
    measured = stored(measure(docs, host, id_col, text_col), "rules")
    verdicts = host_verdicts(host_counts(measured, rules), limit, rules)
    bad = stored(verdicts.where(" or ".join(f"{r.name}_bad" for r in rules)).select("host", *(f"{r.name}_bad" for r in rules)), "hosts")
    size = bad.agg(F.coalesce(F.sum(F.octet_length("host") + 64), F.lit(0))).first()[0]
    joined = measured.join(F.broadcast(bad) if size <= SENT else bad, "host", "left")
    severe, strict = F.lit(False), F.lit(False)
    for r in rules:
        severe = severe | r.failed(r.severe)
        strict = strict | (r.failed(r.strict) & F.coalesce(F.col(f"{r.name}_bad"), F.lit(False)))
    return joined.withColumn("kept", ~F.col("base_failed") & ~severe & ~strict).select("doc_id", "host", *MEASURES, "base_failed", "kept")
