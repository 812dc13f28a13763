"""Mixing sources to target weights by hash-threshold histograms.

Targets are water-filled over one row per source. A source whose target is e whole copies and a
remainder takes every document e times and a further share of documents chosen by a hash of
doc_id: words are summed by (source, leading hash bits), the threshold bucket is found, and only
that boundary bucket is refined by the next bits, until the remainder ends inside one hash value.
Documents of that one value give words in proportion, so a source meets its target to within the
number of such documents. Nothing is sorted and no document list leaves the executors.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; repeated
doc_ids share a hash and are each counted; null doc_ids share one hash; a source without words has
target 0; an empty table gives no rows. A very long text is read whole and may be taken in part.
Other columns may have any names; `mixed` returns them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_rows, materialize, materialize_texts, own
from .textkit import chunks, words

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BROADCAST_SOURCES = 100_000
BITS, LEVELS = 13, 4  # 52 bits of hash in four refinements


def sized(docs: DataFrame, name: str = "size") -> DataFrame:
    """docs with its number of words under that name."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [np.zeros(0, np.int64)]
            for _, _, data, bounds in chunks(b.column(at)):
                n.append(np.diff(words(data, bounds)[2]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(n))], [*b.schema.names, "n"])

    return map_rows(docs, run, [*docs.schema.fields, T.StructField(name, T.LongType())])


def doc_hash(doc_id: Column) -> Column:
    """52 bits of the md5 of the id's digits (empty for null)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long")


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size, target from (source, source_size): one row per source in, one out.

    Sharing the excess again by weight until no source is above its ceiling ends at the level L
    where min(ceiling, weight * L) sums to the total; L follows from one pass over the sources in
    the order of ceiling / weight. These windows see a row per source, not per document.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (place % len(weights) + 1).cast("int")).cast("long")
    x = per_source.select("source", "source_size", w.alias("w")).withColumn("cap", F.col("source_size") * max_repeat)
    ratio = F.col("cap") / F.col("w").cast("double")
    whole = Window.partitionBy()
    order = Window.orderBy(ratio, "cap", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    x = x.select(
        "*", ratio.alias("ratio"),
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("rest"),
        (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("w_rest"),
    )
    # The first source, in that order, which the level doesn't fill sets the level for all after it.
    wide = "decimal(38,0)"
    open_ = F.col("rest").cast(wide) * F.col("w") <= F.col("cap").cast(wide) * F.col("w_rest")
    x = x.select(
        "*", F.min(F.when(open_, F.struct("ratio", "cap", "source", "rest", "w_rest"))).over(whole).alias("at")
    )
    share = (F.col("w") * F.col("at.rest")).cast("double") / F.col("at.w_rest").cast("double")
    target = F.when(F.col("at").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), share))
    return x.select("source", "source_size", target.alias("target"))


def thresholds(held: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """For each source of held(source, size, h): source_size, target, copies, and where the remainder ends."""
    per_source = held.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(per_source, weights, max_repeat)
    want, some = F.round("target").cast("long"), F.col("source_size") > 0
    state = materialize(goal.select(
        "source", "source_size", "target",
        F.when(some, F.floor(want / F.col("source_size"))).otherwise(0).cast("long").alias("copies"),
        F.when(some, want % F.col("source_size")).otherwise(0).cast("long").alias("left"),
        F.lit(0).cast("long").alias("prefix"),
    ))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - level)
        inside = held if level == 0 else held.join(
            state.select(F.col("source").alias("s"), "prefix"),
            F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift) == F.col("prefix")),
        )
        hist = inside.groupBy("source", F.shiftright("h", shift - BITS).alias("bucket")).agg(F.sum("size").alias("n"))
        upto = hist.select(
            F.col("source").alias("s"), "bucket", "n",
            F.sum("n").over(Window.partitionBy("source").orderBy("bucket")).alias("upto"),
        )
        first = state.join(upto, F.col("source").eqNullSafe(F.col("s")) & (F.col("upto") > F.col("left")), "left").groupBy(
            "source", "source_size", "target", "copies", "left"
        ).agg(F.min(F.struct("bucket", "n", "upto")).alias("b"))
        state = materialize(first.select(
            "source", "source_size", "target", "copies",
            (F.col("left") - F.coalesce(F.col("b.upto") - F.col("b.n"), F.lit(0))).alias("left"),
            F.coalesce("b.bucket", F.lit(0)).alias("prefix"), F.coalesce("b.n", F.lit(0)).alias("tie"),
        ))
    return state


def _taken(size: Column, h: Column) -> Column:
    """Words taken of a document of that size and hash, beside its source's state as the struct `state`."""
    at = lambda c: F.col("state")[c]
    extra = (
        F.when(h < at("prefix"), size)
        .when((h == at("prefix")) & (at("tie") > 0), F.floor(size * at("left") / at("tie")))
        .otherwise(0).cast("long")
    )
    return at("copies") * size + extra


def _with_state(rows: DataFrame, state: DataFrame) -> DataFrame:
    """rows(source, ...) beside its source's state; broadcast only if no more than BROADCAST_SOURCES rows."""
    side = state.select(F.col("source").alias("s"), F.struct(*[c for c in state.columns if c != "source"]).alias("state"))
    side = F.broadcast(side) if side.count() <= BROADCAST_SOURCES else side
    return rows.join(side, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def _hold(docs: DataFrame) -> DataFrame:
    x = sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text"))
    return materialize_texts(x.select("doc_id", "source", "size", doc_hash(F.col("doc_id")).alias("h")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs(doc_id, source, text)."""
    held = _hold(docs)
    x = _with_state(held, thresholds(held, weights, max_repeat))
    return x.select("doc_id", "source", "size", "state.source_size", "state.target", _taken(F.col("size"), F.col("h")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mix itself: each row of docs, with all its columns, as often as it is taken.

    The last copy of a row that is taken in part ends after that many words. Rows of which no word
    is taken, those without words among them, are left out.
    """
    state = thresholds(_hold(docs), weights, max_repeat)
    n = free_name("size", docs)
    # The row goes along as one struct, so none of its names can be taken for another.
    x = sized(docs, n).select(
        F.struct(*own(docs)).alias("row"), F.col(n).alias("size"), F.col("source").cast("string").alias("source"), doc_hash(F.col("doc_id").cast("long")).alias("h")
    )
    x = _with_state(x, state)
    size, taken = free_name("size", docs), free_name("taken", docs)
    x = x.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("size").alias(size), _taken(F.col("size"), F.col("h")).alias(taken))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, taken = (b.column(i).to_numpy(zero_copy_only=False) for i in (b.num_columns - 2, b.num_columns - 1))
            whole, part = taken // np.maximum(size, 1), taken % np.maximum(size, 1)
            b = b.select(range(b.num_columns - 2))
            for lo in range(0, b.num_rows, 256):
                w, p = whole[lo : lo + 256], part[lo : lo + 256]
                yield b.slice(lo, 256).take(pa.array(np.repeat(np.arange(len(w)), w)))
                if some := np.flatnonzero(p).tolist():
                    cut = b.slice(lo, 256).take(pa.array(some))
                    heads = [_head(t, int(p[i])) for t, i in zip(cut.column(at).to_pylist(), some)]
                    yield cut.set_column(at, b.schema.field(at), pa.array(heads, b.schema.field(at).type))

    return map_rows(x, run, docs.schema.fields)


def _head(text: str, n: int) -> str:
    """text up to the end of its n-th word."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return raw[: words(raw, np.array([0, len(raw)]))[1][n - 1]].tobytes().decode()
