"""Language identification by interpolated Kneser-Ney character models.

Every labelled training text is counted in character n-grams of ORDER letters (lower-cased, each
run of other characters one space). From the counts of the highest order follow the continuation
counts of all lower ones, and from those the interpolated probabilities, kept for each language and
order in a sorted array of n-gram hashes with their log probabilities; a second sorted array has
the back-off weights of contexts. A text gets the language of lowest mean
cross-entropy a character; one whose cross-entropy lies beyond what calibration texts of that
language show, for its length, is rejected.

The counts cover all training rows and the model keeps every n-gram, so it grows with the distinct
n-grams of the languages, at some 20 bytes for each n-gram of a language: the driver builds it, a
language at a time, and every executor holds it. Calibration uses all training rows too: the texts
are halved by hash, and each half is scored by a model of the other's counts, since a model knows
the texts it has counted better than others. A language with fewer than CALIBRATION_ROWS texts that
such a model gives its own name has no limit, as so few don't show how its texts vary.

Edge cases: a null text, and one without a letter, is `und` with score 0 and rejected; with no
labelled row every text is `und`; rows with a null lang or text teach nothing; ties go to the
first language in code point order; repeated rows are scored alike; an empty table gives no rows.
A very long text is scored whole. Other columns may have any names; `accepted` returns them all.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, map_rows, materialize, materialize_texts
from .textkit import U64, mix

ORDER = 4
DISCOUNT = 0.75
CALIBRATION_ROWS = 5  # that a language needs for a limit
MERGE_ROWS = 1 << 16  # counted n-grams a language that a task holds before it merges equal ones
QUANTILE, SLACK = 0.999, 1.5
STEADY = 400  # characters beyond which cross-entropy varies with the text and no more with its length
ALPHABET = 1 << 12  # characters that share the last, uniform probability mass
_SPACE = 32
_classes: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _classes:
        _classes.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _classes[0]


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, bounds, letters a text): letters in lower case, other runs as one space, a space round each."""
    letter = _letter_table()
    raw = np.frombuffer("".join([f"{t or ''} " for t in texts]).lower().encode("utf-32-le"), np.uint32)
    # Lower-casing can change a text's length, so lengths are taken after it.
    n = np.fromiter((len((t or "").lower()) for t in texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts)), n + 1)
    is_letter = letter[raw]
    out = np.where(is_letter, raw, np.uint32(_SPACE))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the space that ends a run of letters stands for all that follows it
    out, row = out[keep], row[keep]
    letters = np.bincount(row[out != _SPACE], minlength=len(texts))
    return out, row, letters


def windows(out: np.ndarray, row: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """All windows of `order` characters inside a text, each text led by order-1 spaces: (matrix by column, row)."""
    if not len(out):
        return np.zeros((order, 0), np.uint32), row
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    pad = order - 1
    at = np.repeat(first, pad)
    out, row = np.insert(out, at, np.uint32(_SPACE)), np.insert(row, at, np.repeat(row[first], pad))
    n = len(out) - pad
    w = np.stack([out[j : j + n] for j in range(order)])
    same = row[:n] == row[pad:]
    return w[:, same], row[pad:][same]


def ngram_hash(w: np.ndarray) -> np.ndarray:
    """Hash of each column of characters; columns of different heights never meet in one array."""
    h = np.zeros(w.shape[1], U64)
    for line in w:
        h = h * U64(0x5851F42D4C957F2D) + line
    return mix(h)


def _batches(column: pa.Array, limit: int = 1 << 17) -> Iterator[tuple[int, list]]:
    lo, held, size = 0, [], 0
    for i, x in enumerate(column):
        t = x.as_py()
        held.append(t)
        size += len(t or "")
        if size > limit:
            yield lo, held
            lo, held, size = i + 1, [], 0
    if held:
        yield lo, held


def count(rows: DataFrame) -> DataFrame:
    """lang, hi, lo, n: counts of n-grams of rows(lang, text), packed as two characters a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list] = {}
        held: dict[str, int] = {}  # rows in a language's parts
        room: dict[str, int] = {}  # rows at which they are merged: twice what the last merge left

        def merged(parts: list) -> tuple:
            k = np.concatenate([p[0] for p in parts])
            n = np.concatenate([p[1] for p in parts])
            order = np.lexsort((k[:, 1], k[:, 0]))
            k, n = k[order], n[order]
            new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)])
            return k[new], np.add.reduceat(n, new)

        for b in batches:
            lang = np.asarray(b.column(0).to_pylist(), object)
            for lo, texts in _batches(b.column(1)):
                here = lang[lo : lo + len(texts)]
                for name in set(here):
                    out, row, _ = codes([t for t, g in zip(texts, here) if g == name])
                    w, _ = windows(out, row)
                    if w.shape[1]:
                        h = ngram_hash(w)
                        _, at, n = np.unique(h, return_index=True, return_counts=True)
                        u = w[:, at].astype(np.int64)
                        parts = total.setdefault(name, [])
                        parts.append((np.stack([u[0] << 32 | u[1], u[2] << 32 | u[3]], axis=1), n))
                        held[name] = held.get(name, 0) + len(n)
                        if held[name] > room.get(name, MERGE_ROWS):
                            total[name] = [merged(parts)]
                            held[name] = len(total[name][0][1])
                            room[name] = max(MERGE_ROWS, 2 * held[name])
        for name, parts in total.items():
            k, n = merged(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(n)), pa.array(np.ascontiguousarray(k[:, 0])), pa.array(np.ascontiguousarray(k[:, 1])), pa.array(n.astype(np.int64))], ["lang", "hi", "lo", "n"])

    return rows.select("lang", "text").mapInArrow(lean(run), "lang string, hi long, lo long, n long")


class LanguageModel:
    """One language's sorted arrays: probs[k] (hashes, log p) of n-grams of k+1 characters, weights[k] (hashes, log
    back-off weight) of contexts of k."""

    def __init__(self, w: np.ndarray, n: np.ndarray):
        # Windows of each height, each packed in a long; raw counts at the top, numbers of distinct left neighbours below.
        levels = [(w, n.astype(float))]
        for _ in range(ORDER - 1):
            w, n = _distinct(w[1:])
            levels.append((w, n.astype(float)))
        self.probs: list[tuple[np.ndarray, np.ndarray]] = []
        self.weights: list[tuple[np.ndarray, np.ndarray]] = []
        for w, n in reversed(levels):
            ctxs, at, kinds = np.unique(_context(w), return_inverse=True, return_counts=True)
            total = np.bincount(at, n, len(ctxs))
            weight = np.log(DISCOUNT * kinds / total)
            lower = self.log_p(w[1:])
            p = np.logaddexp(np.log((n - DISCOUNT) / total[at]), weight[at] + lower)
            h = ngram_hash(w)
            order = np.argsort(h)
            self.weights.append((ctxs, weight.astype(np.float32)))
            self.probs.append((h[order], p[order].astype(np.float32)))

    def log_p(self, w: np.ndarray) -> np.ndarray:
        """Log probability of the last character of each window, a column, after those before it."""
        k = len(w) - 1
        if k < 0:
            return np.full(w.shape[1], np.log(1 / ALPHABET), np.float32)
        at, found = _look_up(self.probs[k][0], ngram_hash(w))
        out = self.probs[k][1][at]
        miss = np.flatnonzero(~found)
        if len(miss):
            lost = w[:, miss]
            at, found = _look_up(self.weights[k][0], _context(lost))
            out[miss] = np.where(found, self.weights[k][1][at], np.float32(0)) + self.log_p(lost[1:])
        return out


def _distinct(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns of at most three code points each, and how often each stands there."""
    key = np.zeros(w.shape[1], np.int64)
    for line in w:
        key = key << 21 | line
    key, n = np.unique(key, return_counts=True)
    height = len(w)
    return np.stack([key >> 21 * (height - 1 - j) & 0x1FFFFF for j in range(height)]).astype(np.uint32), n


def _context(w: np.ndarray) -> np.ndarray:
    return ngram_hash(w[:-1]) if len(w) > 1 else np.zeros(w.shape[1], U64)


def _look_up(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, whether found) of h in the sorted keys."""
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


class Model:
    """A LanguageModel for each of langs, and limits of rejection: (mean, sd, largest standardised deviation)."""

    def __init__(self, langs: list[str], parts: list[LanguageModel]):
        self.langs, self.parts = langs, parts
        self.limits = [(0.0, 1.0, np.inf)] * len(langs)

    def log_p(self, w: np.ndarray) -> np.ndarray:
        """Log probability of the last character of each window, a row a window and a column a language."""
        return np.stack([part.log_p(w) for part in self.parts], axis=1)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy by language, characters scored) of each text; zero characters without a letter."""
        out, row, letters = codes(texts)
        w, row = windows(out, row)
        n = np.bincount(row, minlength=len(texts)) * (letters > 0)
        total = np.zeros((len(texts), len(self.langs)))
        if len(row):
            _, first, at = np.unique(ngram_hash(w), return_index=True, return_inverse=True)
            p = self.log_p(w[:, first])[at]  # each distinct window is looked up once
            new = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            total[row[new]] = -np.add.reduceat(p, new, axis=0, dtype=np.float64)
        return total / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lang, score, cross-entropy, rejected, characters scored) of each text."""
        if not self.langs:
            z = np.zeros(len(texts))
            return ["und"] * len(texts), z, z, np.ones(len(texts), bool), z.astype(np.int64)
        h, n = self.entropies(texts)
        best = h.argmin(axis=1)
        low = h[np.arange(len(texts)), best]
        # Odds of a text of at most 50 characters' evidence: longer ones aren't more certain without end.
        odds = np.exp(-(h - low[:, None]) * np.minimum(n, 50)[:, None]).sum(axis=1)
        score = np.where(n > 0, 1 / odds, 0.0)
        mean, sd, limit = (np.array(x)[best] for x in zip(*self.limits))
        rejected = (n == 0) | ((low - mean) * np.sqrt(n / (1 + n / STEADY)) / sd > limit)
        return [self.langs[b] if k else "und" for b, k in zip(best.tolist(), n.tolist())], score, low, rejected, n


def fit(training: DataFrame | None, calibration: DataFrame | None = None) -> Model:
    """A model of all rows of training(lang, text) and calibration(lang, text); limits of rejection from all of calibration.

    The rows of calibration are halved by their texts; each half is scored by a model of all the other rows.
    """
    training, known = (None if d is None else d.select("lang", "text").where("lang is not null and text is not null") for d in (training, calibration))
    if known is None:
        counts = materialize(count(training).groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n")))
        model = _model(counts)
        discard(counts)
        return model
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    keyed = known.select(F.concat(half.cast("string"), "lang").alias("lang"), "text")
    if training is not None:
        keyed = keyed.union(training.select(F.concat(F.lit("2"), "lang"), "text"))
    counts = materialize(count(keyed).groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n")))
    halves = counts.select(F.substring("lang", 1, 1).cast("int").alias("half"), F.expr("substring(lang, 2)").alias("lang"), "hi", "lo", "n")
    scored = []
    for k in (0, 1, None):
        some = materialize((halves if k is None else halves.where(F.col("half") != k)).groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n")))
        model = _model(some)
        discard(some)
        if k is not None and model.langs:
            z = _scored(known.where(half == k), model, "lang").where("lang = lang_pred and n_scored > 0")
            scored.append(materialize_texts(z.select("lang", "entropy", "n_scored")))
    discard(counts)
    if scored:
        _limit(model, functools.reduce(DataFrame.union, scored))
        discard(*scored)
    return model


def _model(counts: DataFrame) -> Model:
    """The model of counts(lang, hi, lo, n) of each n-gram; the driver holds the counts of one language at a time."""
    langs = sorted((r["lang"] for r in counts.select("lang").distinct().collect()), key=lambda s: s.encode())
    return Model(langs, [LanguageModel(*_unpacked(counts.where(F.col("lang") == lang))) for lang in langs])


def _limit(model: Model, z: DataFrame) -> None:
    """Set the model's limits from the cross-entropies z(lang, entropy, n_scored) of calibration texts."""
    stats = z.groupBy("lang").agg(F.avg("entropy").alias("mean"))
    joined = z.join(F.broadcast(stats), "lang")  # a row a language; z stays where it is, as one language may hold most rows
    dev = (F.col("entropy") - F.col("mean")) * F.sqrt(F.col("n_scored") / (1 + F.col("n_scored") / STEADY))
    fitted = joined.groupBy("lang").agg(
        F.first("mean").alias("mean"), F.sqrt(F.avg(dev * dev)).alias("sd"), F.percentile_approx(dev, QUANTILE, 10_000).alias("top"), F.max(dev).alias("most"), F.count(F.lit(1)).alias("n")
    ).collect()
    for r in fitted:
        if r["n"] < CALIBRATION_ROWS:
            continue
        sd = max(r["sd"], 1e-6)
        model.limits[model.langs.index(r["lang"])] = (r["mean"], sd, max(SLACK * r["top"] / sd, SLACK * 4.0, r["most"] / sd))


def _unpacked(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(windows by column, counts) of counts(hi, lo, n)."""
    hi, lo, n = (c.to_numpy() for c in counts.select("hi", "lo", "n").toArrow().columns)
    mask = (1 << 32) - 1
    return np.stack([hi >> 32, hi & mask, lo >> 32, lo & mask]).astype(np.uint32), n


def _scored(rows: DataFrame, model: Model, key: str) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "lang_pred", "score", "entropy", "n_scored", "rejected"]
        for b in batches:
            for lo, texts in _batches(b.column(1)):
                lang, score, low, rejected, n = held.value.predict(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, len(texts)), pa.array(lang, pa.string()), pa.array(score.astype(float)), pa.array(low.astype(float)), pa.array(n.astype(np.int64)), pa.array(rejected)], names)

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"`{key}` {kind}, lang_pred string, score double, entropy double, n_scored long, rejected boolean")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, entropy, n_scored, rejected of every row of docs(doc_id, text)."""
    return _scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, "doc_id")


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id's digits, mod n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def fit_documents(docs: DataFrame) -> Model:
    """Fitted to, and calibrated on, all documents whose crc32(doc_id) mod 4 is not 2."""
    fold = F.coalesce(bucket(F.col("doc_id"), 4), F.lit(0))
    return fit(None, docs.select("lang", "text", fold.alias("fold")).where("fold <> 2"))


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs that the model doesn't reject, with their columns.

    Without a model it is that of fit_documents, which leaves a fold unlearnt to test on; fit(None, docs) learns from all.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_documents(docs) if model is None else model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, texts in _batches(b.column(at)):
                yield b.slice(lo, len(texts)).filter(pa.array(~model.value.predict(texts)[3]))

    return map_rows(docs, run, docs.schema.fields)
