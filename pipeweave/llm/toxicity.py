"""Toxicity by a factorization machine over hashed terms.

Terms are words in A-Z lower case without ASCII punctuation at their ends, as 64-bit hashes. From
a bounded sample of labelled rows those terms are chosen that tell the classes apart, alone
(chi-square) or as a pair: two of the PAIR_TERMS most frequent terms whose four cases, both, one,
the other and neither, differ from what the two tell alone, even where each alone tells nothing.
A second-order factorization machine is fitted to their presence: a weight a term and a vector of
FACTORS numbers a term whose inner products are the weights of pairs, so an insult beside the
mention of a group can count for more, or less, than both alone.

The sample holds at most about SAMPLE labelled rows of each class (chosen by a hash of the id) and
at most TERMS terms of single and 2 * PAIR_TERMS of joint effect, so what is collected for fitting
is bounded; scoring reads every whole text.
Where the classes are sampled at different rates, the log of their ratio is taken from the fitted
log odds, so scores are at the classes' own shares, however many labels there are.

Edge cases: a null, empty or wordless text scores as one without any chosen term; without labelled
rows, or with one class only, every score is the share of that class (0 without rows); several
labels of one id count as toxic if one is; repeated rows score alike; an empty table gives no rows.
A very long text is scored whole; a term counts once. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, materialize_texts
from .textkit import chunks, lowered, span_hashes, words

SAMPLE = 12_000
TERMS, MIN_DOCS, MIN_CHI2 = 4096, 4, 15.0
PAIR_TERMS, MIN_GAIN = 512, 30.0
FACTORS, EPOCHS, MIN_STEPS, BATCH, RATE, DECAY = 8, 20, 800, 256, 0.1, 1e-4
THRESHOLD = 0.7
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def terms(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term hashes, row of each) of a chunk, words in order; words of punctuation only fall out."""
    data = lowered(data)
    starts, ends, first = words(data, bounds)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    if not len(starts):
        return np.zeros(0, np.uint64), row
    # The next byte at or after each one, and the last at or before it, that isn't punctuation.
    fine = np.flatnonzero(~_PUNCTUATION[data])
    a = np.searchsorted(fine, starts)
    b = np.searchsorted(fine, ends) - 1
    some = b >= a
    a, b = a[some], b[some]
    return span_hashes(data, fine[a], fine[b] + 1), row[some]


def distinct_terms(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
    return h[new], row[new]


class Machine:
    """p(toxic) = sigmoid(w0 + sum w_i + sum of pairs <v_i, v_j>) over the chosen terms of a text."""

    def __init__(self, keys: np.ndarray, base: float):
        self.keys = np.sort(keys.astype(np.uint64))
        self.w0, self.w = base, np.zeros(len(keys))
        self.v = np.random.default_rng(5).normal(0, 0.01, (len(keys), FACTORS))

    def chosen(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(term index, row) of the distinct chosen terms among h."""
        if not len(self.keys) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = self.keys[at] == h
        pair = np.unique(row[hit] * np.int64(len(self.keys)) + at[hit])
        return pair % len(self.keys), pair // len(self.keys)

    def logits(self, at: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(log odds, sums of factors) of n texts."""
        linear = np.bincount(row, self.w[at], n)
        sums = np.stack([np.bincount(row, self.v[at, f], n) for f in range(FACTORS)], axis=1)
        squares = np.bincount(row, (self.v[at] ** 2).sum(axis=1), n)
        return self.w0 + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def score(self, h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*self.chosen(h, row), n)[0], -40, 40)))

    def fit(self, texts: list[np.ndarray], y: np.ndarray) -> None:
        """Adagrad over texts given as arrays of term indices; the classes weigh as they occur in texts."""
        rng = np.random.default_rng(11)
        g0, gw, gv = 1e-8, np.full(len(self.w), 1e-8), np.full(self.v.shape, 1e-8)
        for _ in range(max(EPOCHS, -(-MIN_STEPS * BATCH // max(len(texts), 1)))):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), BATCH):
                pick = order[lo : lo + BATCH]
                at = np.concatenate([texts[i] for i in pick]).astype(np.int64)
                row = np.repeat(np.arange(len(pick)), [len(texts[i]) for i in pick])
                z, sums = self.logits(at, row, len(pick))
                err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[pick]) / len(pick) * 16
                d0 = err.sum()
                dw = np.bincount(at, err[row], len(self.w)) + DECAY * self.w
                dv = np.stack([
                    np.bincount(at, err[row] * (sums[row, f] - self.v[at, f]), len(self.w)) for f in range(FACTORS)
                ], axis=1) + DECAY * self.v
                g0, gw, gv = g0 + d0 * d0, gw + dw * dw, gv + dv * dv
                self.w0 -= RATE * d0 / np.sqrt(g0)
                self.w -= RATE * dw / np.sqrt(gw)
                self.v -= RATE * dv / np.sqrt(gv)


def sample(labels: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, toxic) of at most about SAMPLE rows of each class, by a hash of the id, and each class's rate."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")
    ).where("toxic in (0, 1)")
    n = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    keep, rates = F.lit(False), {}
    for c, k in n.items():
        part = max(1, int(min(1.0, SAMPLE / k) * (1 << 20)))
        rates[c] = part / (1 << 20)
        keep = keep | ((F.col("toxic") == c) & (F.pmod(F.xxhash64("doc_id"), 1 << 20) < part))
    return one.where(keep), rates


def _indexed(rows: DataFrame, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(classes, places among the sorted keys of each row's terms) of the sampled rows."""
    held = rows.sparkSession.sparkContext.broadcast(keys)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = held.value
        for b in batches:
            out = []
            for x in b.column(1):
                h = x.values.to_numpy().view(np.uint64)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1) if len(keys) else h[:0].astype(np.int64)
                out.append(at[keys[at] == h].astype(np.int32) if len(keys) else at)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], ["toxic", "at"])

    got = rows.mapInArrow(index, "toxic int, at array<int>").toArrow()
    return got.column("toxic").to_numpy().astype(float), [x.values.to_numpy() for x in got.column("at").combine_chunks()]


def joint(texts: list[np.ndarray], y: np.ndarray, width: int) -> np.ndarray:
    """Places of terms in pairs whose four cases tell the classes apart by MIN_GAIN more than the two terms alone."""
    both, toxic = np.zeros((width, width)), np.zeros((width, width))
    for lo in range(0, len(texts), 1024):
        part = texts[lo : lo + 1024]
        x = np.zeros((len(part), width), np.float32)
        x[np.repeat(np.arange(len(part)), list(map(len, part))), np.concatenate(part).astype(np.int64)] = 1
        both += x.T @ x
        bad = x[y[lo : lo + 1024] == 1]
        toxic += bad.T @ bad
    total, share = len(texts), float(y.mean())
    spread = lambda k, n: (k - n * share) ** 2 / (n * share * (1 - share) + 0.5)
    n, k = np.diag(both), np.diag(toxic)
    one = spread(k, n) + spread(y.sum() - k, total - n)
    cases = spread(toxic, both) + spread(k[:, None] - toxic, n[:, None] - both) + spread(k[None] - toxic, n[None] - both)
    cases += spread(y.sum() - k[:, None] - k[None] + toxic, total - n[:, None] - n[None] + both)
    gain = cases - one[:, None] - one[None]
    np.fill_diagonal(gain, 0)
    return np.flatnonzero((gain >= MIN_GAIN).any(axis=1))


def fit(docs: DataFrame, labels: DataFrame) -> Machine:
    """A machine fitted to docs(doc_id, text) with labels(doc_id, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, bounds in chunks(b.column(1)):
                h, row = distinct_terms(*terms(data, bounds))
                at = np.r_[0, np.cumsum(np.bincount(row, minlength=hi - lo))].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))], ["toxic", "terms"])

    # The sample's size is bounded by SAMPLE, whatever the size of labels.
    chosen, rates = sample(labels)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = materialize_texts(picked.select("toxic", "text").mapInArrow(lean(run), "toxic int, terms array<long>"))
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    total, bad = sum(n.values()), n.get(1, 0)
    if not bad or bad == total:
        machine = Machine(np.zeros(0, np.uint64), 0.0)
        machine.w0 = -40.0 if not bad else 40.0
        return machine
    t = materialize(
        rows.select(F.explode("terms").alias("term"), "toxic").groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k")).where(F.col("n") >= MIN_DOCS)
    )
    n_, k_ = F.col("n").cast("double"), F.col("k").cast("double")
    gap = k_ * total - n_ * bad
    chi2 = gap * gap * total / (n_ * (total - n_ + 0.5) * float(bad) * float(total - bad))
    alone = t.select("term", chi2.alias("chi2")).where(F.col("chi2") >= MIN_CHI2).orderBy(F.col("chi2").desc(), "term").limit(TERMS)
    often = t.where(F.col("n") < total).orderBy(F.col("n").desc(), "term").limit(PAIR_TERMS)
    number = lambda found: np.sort(np.asarray([r["term"] for r in found.collect()], np.int64).view(np.uint64))
    frequent = number(often)
    y, at = _indexed(rows, frequent)
    keys = np.union1d(number(alone), frequent[joint(at, y, len(frequent))])
    machine = Machine(keys, float(np.log(bad / (total - bad))))
    y, at = _indexed(rows, machine.keys)
    # In the order of the rows' own contents, so that a rerun fits the same machine.
    order = sorted(range(len(at)), key=lambda i: (y[i], at[i].tobytes()))
    machine.fit([at[i] for i in order], y[order])
    machine.w0 -= float(np.log(rates[1] / rates[0]))
    return machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score, predicted of every row of docs(doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, bounds in chunks(b.column(1)):
                s = held.value.score(*terms(data, bounds), hi - lo)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, score double, predicted int")
