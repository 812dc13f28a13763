"""Quality rules with verdicts by host.

Each document gets base counts and a base verdict. Failures are then counted by host (`source`),
each host's failure rate is shrunk by a beta prior fitted to all hosts by the method of moments,
and a host whose shrunk rate exceeds `max_rate` has all its documents rejected.

Edge cases: a null or empty text has no words and fails the base rules; a document without a
source belongs to no host and keeps its own verdict; repeated rows count as often as they occur;
hosts that all have one rate, or a single host, leave the prior as weak as one document; an
empty table gives no rows. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textkit import chunks, span_hashes, window_hashes, window_rows, words

MAX_RATE = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BASE = ("doc_id long, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return np.diff(total[bounds])


def _duplicates(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a later one of equal (row, hash), one of several) for each entry; entries are in order."""
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    same = np.r_[False, (r[1:] == r[:-1]) & (x[1:] == x[:-1])] if len(r) else np.zeros(0, bool)
    later, several = np.empty(len(r), bool), np.empty(len(r), bool)
    later[order] = same
    several[order] = same | np.r_[same[1:], False] if len(r) else same
    return later, several


def counts(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text of a chunk."""
    starts, ends, first = words(data, bounds)
    n_words = np.diff(first)
    lead = (data & 0xC0) != 0x80
    space = (data == 0x20) | ((data >= 9) & (data <= 13))
    word_chars = _sums(lead & ~space, bounds)
    n_symbols = _sums(_SYMBOL[data], bounds)
    # Lines: of each text, the spans between its bounds and its newlines; those with a word.
    rows = np.arange(len(bounds) - 1)
    breaks = np.flatnonzero(data == 0x0A)
    row_of = np.searchsorted(bounds, breaks, "right") - 1
    line_start = np.r_[bounds[:-1], breaks + 1]
    line_row = np.r_[rows, row_of]
    order = np.lexsort((np.r_[np.full(len(rows), -1), breaks], line_row))
    line_start, line_row = line_start[order], line_row[order]
    closing = np.r_[line_row[1:] != line_row[:-1], True] if len(line_row) else np.zeros(0, bool)
    line_end = np.where(closing, bounds[line_row + 1], np.r_[line_start[1:] - 1, 0])
    full = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_row = line_start[full], line_end[full], line_row[full]
    later, _ = _duplicates(line_row, span_hashes(data, line_start, line_end))
    n_dup_lines = np.bincount(line_row[later], minlength=len(rows))
    # Words covered by windows that occur twice or more.
    h = window_hashes(span_hashes(data, starts, ends), WINDOW)
    covered = np.zeros(len(starts), bool)
    if len(h):
        ok = np.flatnonzero(window_rows(first, WINDOW, len(h)))
        word_row = np.repeat(rows, n_words)
        _, several = _duplicates(word_row[ok], h[ok])
        for j in range(WINDOW):
            covered[ok[several] + j] = True
    n_repeat = _sums(covered, first)
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat]


def base(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _BASE.split(", ")]
        for b in batches:
            parts = [counts(data, bounds) for _, _, data, bounds in chunks(b.column(2))]
            cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in cols)], names)

    out = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text").mapInArrow(run, _BASE)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def hosts(judged: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """source, host_docs, host_rate (shrunk), host_kept for each source that isn't null."""
    by = judged.where("source is not null").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("k")
    )
    # Moments over hosts: m is the pooled rate, v the variance of rates beyond binomial noise.
    t = by.agg(
        F.sum("k").alias("k"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"),
        F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"), F.sum(F.col("n") * F.col("n")).alias("nn"),
    ).first()
    n = t["n"] or 0
    m = (t["k"] or 0) / n if n else 0.0
    strength = 1.0
    if n and t["hosts"] > 1 and 0 < m < 1:
        between = (t["kk"] - n * m * m) - (t["hosts"] - 1) * m * (1 - m)
        v = between / max(n - t["nn"] / n, 1e-9)
        strength = min(max(m * (1 - m) / v - 1, 1.0), 1e6) if v > 0 else 1e6
    rate = (F.col("k") + m * strength) / (F.col("n") + strength)
    return by.select("source", F.col("n").alias("host_docs"), rate.alias("host_rate"), (rate <= max_rate).alias("host_kept"))


def judge(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    held = materialize(base(docs))
    verdict = hosts(held, max_rate)
    joined = held.join(verdict.withColumnRenamed("source", "__host"), F.col("source") == F.col("__host"), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"), "host_rate",
    )
