"""Approximate nearest neighbours by cross-polytope hashing.

In each of TABLES tables a vector is turned twice by a pseudo-rotation (three rounds of random
signs and a fast Hadamard transform) and hashed to the pair of signed axes it is nearest to, one a
turn. Every vector is indexed under its one bucket a table; a query probes the PROBES buckets whose
axes it is nearest to, taken together. Vectors are shuffled by table and first axis, a query once
for each first axis it probes, with the second axes it probes there. Queries meet the vectors of
their buckets in blocks of at most BLOCK vectors, which a first axis of any size is dealt into, and
each block sends on a query's best few, scored exactly in double precision. A query that met fewer
than k vectors is compared with all, in blocks. Repeated rows are indexed once, and rows of one id
with different vectors are dealt over the blocks like those of different ids.

Edge cases: vectors that are null, zero, hold null or non-finite components, have a null id, or
whose length isn't the table's commonest, take no part; a vector is no neighbour of rows of its
own id, and an id of several vectors counts once, by its best; equal scores go to the smaller
vec_id (scores are summed component by component, so equal vectors score alike everywhere; vectors
are scaled by powers of two first, so components of any size neither overflow nor vanish); with
fewer than k others all are returned; an empty table gives no rows. Columns other than vec_id and
embedding take no part and may have any names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize

TABLES, PROBES = 16, 200
BLOCK = 4096
K = 5


def signs(table: int, width: int) -> np.ndarray:
    return np.random.default_rng(1000 + table).choice((-1.0, 1.0), (3, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the width is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    width = 1 << max(0, int(x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    for s in signs(table, width):
        y = hadamard(y * s)
    return y


def turned(x: np.ndarray, table: int) -> list[np.ndarray]:
    """Nearness of each row to all signed axes (those of positive sign first) after each of the table's two turns."""
    out = []
    for turn in (table, TABLES + table):
        y = rotated(x, turn)
        out.append(np.concatenate([y, -y], axis=1))
    return out


def buckets(x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    """(first axis, second axis) of the bucket of each row."""
    a, b = turned(x, table)
    return a.argmax(axis=1), b.argmax(axis=1)


def probed(x: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The `probes` buckets that each row is nearest to, as first axis * axes + second axis.

    Farness is the sum of squares of what an axis lacks to the nearest one of its turn.
    """
    a, b = ((y.max(axis=1, keepdims=True) - y) ** 2 for y in turned(x, table))
    far = (a[:, :, None] + b[:, None, :]).reshape(len(x), -1)
    n = min(probes, far.shape[1])
    return np.argpartition(far, n - 1, axis=1)[:, :n]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows by powers of two, so that the largest component of each is from 0.5 to 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of the rows of q with those of c, one by one, each summed in the order of components."""
    q, c = scaled(q), scaled(c)
    dot, qq, cc = np.zeros(len(q)), np.zeros(len(q)), np.zeros(len(q))
    for j in range(q.shape[1]):
        dot += q[:, j] * c[:, j]
        qq += q[:, j] * q[:, j]
        cc += c[:, j] * c[:, j]
    return dot / (np.sqrt(qq) * np.sqrt(cc))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of the rows that take part, each once."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    x = x.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    common = x.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    return x.where(F.size("v") == (common["d"] if common else 0)).distinct()


def _best(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best distinct vec_ids of each query in a block.

    rows: vec_id, v, probe (a query's row), axes: the second axis of a vector, or those a query
    probes. Scores by matrix products choose, those of ordered sums decide.
    """
    probe = rows["probe"].to_numpy()
    q, c = rows[probe], rows[~probe]
    if not len(q) or not len(c):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
    axis = np.concatenate(c["axes"].to_numpy())
    by = np.argsort(axis, kind="stable")
    axis, cid, cv = axis[by], c["vec_id"].to_numpy()[by], np.stack(c["v"].to_numpy())[by]
    unit = scaled(cv)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    there, start = np.unique(axis, return_index=True)
    end = np.r_[start[1:], len(axis)]
    by_id = np.argsort(cid, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(cid[by_id]) != 0])
    out = []
    for lo in range(0, len(q), 128):
        part = q.iloc[lo : lo + 128]
        qid, qv = part["vec_id"].to_numpy(), np.stack(part["v"].to_numpy())
        uq = scaled(qv)
        uq /= np.linalg.norm(uq, axis=1, keepdims=True)
        asked = part["axes"].to_numpy()
        row = np.repeat(np.arange(len(part)), list(map(len, asked)))
        asked = np.concatenate(asked)
        by = np.argsort(asked, kind="stable")
        asked, row = asked[by], row[by]
        s = np.full((len(part), len(cid)), -np.inf)
        lows, highs = np.searchsorted(asked, there, "left").tolist(), np.searchsorted(asked, there, "right").tolist()
        for m, n, x, y in zip(lows, highs, start.tolist(), end.tolist()):
            if n > m:
                s[row[m:n], x:y] = uq[row[m:n]] @ unit[x:y].T
        s[qid[:, None] == cid[None, :]] = -np.inf
        best = s if len(first) == len(cid) else np.maximum.reduceat(s[:, by_id], first, axis=1)  # an id's best of its vectors
        least = np.partition(best, -k, axis=1)[:, -k] if best.shape[1] > k else np.full(len(part), -np.inf)
        i, j = np.nonzero((s >= least[:, None] - 1e-9) & (s > -np.inf))
        exact = cosines(qv[i], cv[j])
        order = np.lexsort((-exact, cid[j], i))  # once each id
        i, j, exact = i[order], j[order], exact[order]
        one = np.r_[True, (np.diff(i) != 0) | (np.diff(cid[j]) != 0)] if len(i) else np.zeros(0, bool)
        i, j, exact = i[one], j[one], exact[one]
        order = np.lexsort((cid[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i, "left")
        top = rank < k
        out.append(pd.DataFrame({"query_id": qid[i[top]], "vec_id": cid[j[top]], "score": exact[top]}))
    return pd.concat(out)


_FOUND = "query_id long, vec_id long, score double"


def _search(index: DataFrame, probes: DataFrame, keys: list[str], k: int) -> DataFrame:
    rows = index.select(*keys, "vec_id", "v", "axes", F.lit(False).alias("probe")).union(probes.select(*keys, "vec_id", "v", "axes", F.lit(True).alias("probe")))
    return rows.groupBy(*keys).applyInPandas(lambda g: _best(g, k), _FOUND)


def _hashed(x: DataFrame, probes: int = 0) -> DataFrame:
    """x with a row for each table and first axis, and the second axes there: of its bucket, or of those it probes."""

    def run(batches):
        for g in batches:
            for lo in range(0, len(g), 256):
                b = g.iloc[lo : lo + 256]
                v = scaled(np.stack(b["v"].to_numpy()))
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                for t in range(TABLES):
                    if probes:
                        keys = np.sort(probed(v, t, probes), axis=1)
                        axes = 2 * (1 << max(0, int(v.shape[1] - 1).bit_length()))
                        row, first = np.repeat(np.arange(len(b)), keys.shape[1]), keys.ravel() // axes
                        new = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(first) != 0)])
                        out = b.iloc[row[new]].copy()
                        out["table"], out["axis"] = np.int32(t), first[new].astype(np.int32)
                        out["axes"] = np.split((keys.ravel() % axes).astype(np.int32), new[1:])
                    else:
                        a, c = buckets(v, t)
                        out = b.copy()
                        out["table"], out["axis"] = np.int32(t), a.astype(np.int32)
                        out["axes"] = list(c.astype(np.int32)[:, None])
                    yield out

    return x.mapInPandas(lean(run), "vec_id long, v array<double>, table int, axis int, axes array<int>")


def top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, is_query: Column, k: int = K, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row of vectors where is_query holds."""
    x = materialize(usable(vectors))
    index = materialize(_hashed(x))
    queries = x.where(is_query)
    # A row for each of at most TABLES * 2 * width buckets, so its size has a bound.
    blocks = index.groupBy("table", "axis").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    sized = F.broadcast(materialize(blocks))
    dealt = index.join(sized, ["table", "axis"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int"))
    asked = _hashed(queries, probes).join(sized, ["table", "axis"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = materialize(top(_search(dealt, asked, ["table", "axis", "block"], k), k))
    some = x.select("vec_id").distinct().limit(k + 1).count()  # all there is, if fewer than k others
    met = found.groupBy("query_id").count().where(F.col("count") >= min(k, some - 1))
    short = materialize(queries.join(met, F.col("vec_id") == F.col("query_id"), "left_anti"))
    if short.isEmpty():
        return found
    n = max(1, -(-x.count() // BLOCK))
    alike = F.array(F.lit(0))  # one second axis for all
    every = x.withColumn("axes", alike).withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int"))
    again = short.withColumn("axes", alike).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    whole = top(_search(every, again, ["block"], k), k)
    return found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(whole)
