"""Best-fit packing by minimum bin slack over the histogram of lengths.

Pieces of at most `capacity` tokens are packed into sequences. Only the number of pieces of each
length matters to the plan, so one row per length (at most `capacity` rows) reaches the driver.
There, for each bin, the longest remaining length is fixed and a bitset subset-sum over the
remaining lengths finds the fullest feasible combination; that pattern is used as often as the
stock allows and removed. Executors then map the rank of a piece within its length to its place.

Edge cases: a null text is empty, so its only token is the end id; repeated rows and repeated or
null doc_ids are packed as rows of their own; an empty table gives no sequence. A very long text is
encoded whole and cut. Extra columns of the input take no part and can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, materialize_texts
from .tokens import default_tokenizer, encoder

CAPACITY = 1024
END_ID = 2
_PIECES = "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long, part int"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones last, so only the first may be shorter."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise every row of docs(doc_id, text) into digests of pieces; ids themselves are not moved."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, key, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        enc.clear()
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py() or "") + end
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    out.append((doc, (part << 40) + key, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), part))
                key += 1
            cols = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            names = [f.split()[0] for f in _PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)
        enc.clear()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), _PIECES)


def fullest(stock: np.ndarray, capacity: int) -> list[int]:
    """The longest length in stock and those that with it come nearest to capacity, longest first."""
    lead = int(np.flatnonzero(stock)[-1])
    room = capacity - lead
    stock = stock.copy()
    stock[lead] -= 1
    if not room:
        return [lead]
    bits, mask = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int]] = []
    for n in map(int, np.flatnonzero(stock[: room + 1])[::-1]):
        for _ in range(min(int(stock[n]), room // n)):
            grown = (bits | bits << n) & mask
            if grown == bits:
                break
            steps.append((n, bits))
            bits = grown
        if bits >> room & 1:
            break
    out, at = [lead], bits.bit_length() - 1
    for n, before in reversed(steps):
        if not before >> at & 1:
            out.append(n)
            at -= n
    return sorted(out, reverse=True)


def plan(stock: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, end rank, first bin, copies in a bin, offset), by length and rank."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in stock.items():
        left[n] = c
    used, bins, rows = np.zeros(capacity + 1, np.int64), 0, []
    while left.any():
        lengths, copies = np.unique(fullest(left, capacity), return_counts=True)
        times, offset = int((left[lengths] // copies).min()), 0
        for n, c in zip(map(int, lengths[::-1]), map(int, copies[::-1])):
            rows.append((n, used[n], used[n] + times * c, bins, c, offset))
            used[n] += times * c
            left[n] -= times * c
            offset += n * c
        bins += times
    return np.asarray(sorted(rows), np.int64).reshape(-1, 6)


def place(table: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence_id, offset) of the pieces of these lengths and ranks."""
    lo = np.searchsorted(table[:, 0], length, "left")
    ends, key = table[:, 0] * (1 << 44) + table[:, 1], length * (1 << 44) + rank
    row = table[np.maximum(np.searchsorted(ends, key, "right") - 1, lo)]
    k = rank - row[:, 1]
    return row[:, 3] + k // row[:, 4], row[:, 5] + k % row[:, 4] * length


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs.

    Ranks within a length come from counts by (part, length), where a part is a task of the
    tokenising pass, so no length, however common, is gathered in one task.
    """
    held = materialize_texts(pieces(docs, tokenizer or default_tokenizer(), capacity, end_id))
    # One row for each pair of a tokenising task and a length in it; the running sum over tasks is
    # taken for each length apart.
    counts = held.groupBy("length", "part").count()
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    table = plan(totals, capacity)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        first = dict(zip(right["length"].to_pylist(), right["first"].to_pylist()))
        n = left["length"].to_numpy()
        order = np.lexsort((left["piece"].to_numpy(), left["row_key"].to_numpy(), n))
        rank = np.empty(len(n), np.int64)
        ordered = n[order]
        new = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(n) else np.zeros(0, np.int64)
        rank[order] = np.arange(len(n)) - np.repeat(new, np.diff(np.r_[new, len(n)]))
        rank += np.asarray([first[x] for x in n.tolist()], np.int64)
        seq, off = place(table, n, rank) if len(n) else (rank, rank)
        out = left.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return out.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    from pyspark.sql import Window

    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Written, as both sides of the co-group must not descend from one scan: the optimizer would prune
    # the columns of both by what is read of one.
    firsts = materialize(counts.select("length", "part", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("first")))
    return held.groupBy("part").cogroup(firsts.groupBy("part")).applyInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
