"""MinHash near-duplicates, candidates checked with odd sketches, links confirmed on full sets.

1. One pass over the texts gives each document its set of 5-word shingles in digest: its size, a
   128-bit fingerprint, band keys of ROWS MinHash values each (BANDS at PERCENT, more below), and an odd sketch: the
   parity, in SKETCH_BITS bits, of how often a bit is hit by the document's MinHash samples.
2. Documents of equal sets are one class; only its smallest doc_id goes on.
3. Within a bucket (an equal band key) each member meets the bucket's smallest doc_id. The XOR
   population count of two odd sketches estimates their similarity; pairs far below the threshold
   fall out, each member's best pair is confirmed on full sets, and links give first components.
4. Buckets that still hold several components are searched whole, in pairs of blocks of at most
   BLOCK members. Members of a bucket's largest component need not meet each other, so a bucket
   that is nearly all one component costs its size and not its square. A first pass compares odd
   sketches and keeps the members that have a near one in another component, each pair counting
   only in the first band it shares. Only their full sets are fetched, in blocks of at most
   BLOCK_SHINGLES, where a task reports a spanning set of confirmed links, never all pairs.

A pair at the threshold shares a bucket but for one chance in about a million, and the sketch lets
through pairs whose estimate is MARGIN below the threshold (over five standard deviations).

Edge cases: texts are lower-cased in A-Z only; a text with fewer than five words is one shingle; a
null or wordless text has an empty set and no links; rows that share a doc_id are one node, whose
set is that of smallest fingerprint, and each come back; a null doc_id links with nothing and is
kept; an empty table gives no rows. A very long text is one set, in one row, of 8 bytes a distinct
shingle. Columns other than doc_id and text take no part and may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, free_name, lean, materialize, materialize_texts, own, quoted
from .textkit import U64, chunks, lowered, mix, short_hash, span_hashes, window_hashes, window_rows, words

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 24, 5
SKETCH_BITS = 1024
MARGIN = 0.2
BLOCK = 2048
BLOCK_SHINGLES = 1 << 20
PAIRS = 1 << 18  # pairs of sketches compared at once
_rng = np.random.default_rng(77)
_A = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_C = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.int64).astype(np.uint32)


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the first n MinHash functions; those of BANDS bands are the same for any n."""
    if n <= len(_A):
        return _A[:n], _C[:n]
    more = np.random.default_rng(78).integers(0, 1 << 31, (n - len(_A), 2), dtype=np.int64).astype(np.uint32)
    return np.r_[_A, more[:, 0] * np.uint32(2) + np.uint32(1)], np.r_[_C, more[:, 1]]


def bands_for(percent: int) -> int:
    """Bands by which a pair at a threshold is missed no more often than one at PERCENT by BANDS."""
    if percent >= PERCENT:
        return BANDS
    missed = lambda p: math.log1p(-((p / 100) ** ROWS))
    return math.ceil(BANDS * missed(PERCENT) / missed(max(percent, 1)))


_SIGN = "doc_id long, n_shingles long, fp_a long, fp_b long, bands array<long>, sketch array<long>"
_SETS = "doc_id long, n_shingles long, fp_a long, members array<long>"


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a chunk."""
    data = lowered(data)
    starts, ends, first = words(data, bounds)
    h = span_hashes(data, starts, ends)
    s = window_hashes(h, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(s[a : b - k + 1]))
        else:
            out.append(short_hash(h[a:b]) if b > a else s[:0])
    return out


def signatures(sets: list[np.ndarray], n_bands: int = BANDS) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, odd sketches as 64-bit words) of non-empty sets; a sketch is of BANDS bands for any number."""
    mul, add = multipliers(n_bands * ROWS)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    at = np.r_[0, np.cumsum(size)[:-1]]
    x = (np.concatenate(sets) >> U64(32)).astype(np.uint32)
    low = np.empty((len(sets), n_bands * ROWS), np.uint32)
    for i in range(n_bands * ROWS):
        y = x * mul[i]
        y ^= y >> np.uint32(15)
        low[:, i] = np.minimum.reduceat(y * (add[i] | np.uint32(1)), at)
    sample = mix(low.astype(U64) | np.arange(n_bands * ROWS, dtype=U64) << U64(32))
    bands = np.full((len(sets), n_bands), 0, U64)
    for r in range(ROWS):
        bands = mix(bands * U64(31) + sample[:, r::ROWS])
    sample = sample[:, : BANDS * ROWS]
    bit = (sample >> U64(20)) % U64(SKETCH_BITS)
    flat = np.arange(len(sets), dtype=np.int64)[:, None] * SKETCH_BITS + bit.astype(np.int64)
    odd = np.bincount(flat.ravel(), minlength=len(sets) * SKETCH_BITS).astype(np.uint8) & 1
    return bands, np.packbits(odd.reshape(len(sets), -1), axis=1, bitorder="little").view("<u8")


def sketch_similarity(differing):
    """Jaccard similarity estimated from the XOR population count of two odd sketches."""
    k, n = BANDS * ROWS, SKETCH_BITS
    inner = np.maximum(1 - 2 * np.asarray(differing, float) / n, 1e-9)
    return 1 + n / (4 * k) * np.log(inner)


def widest(percent: int) -> int:
    """The largest XOR population count at which a pair is still checked in full."""
    d = np.arange(SKETCH_BITS)
    return int(d[sketch_similarity(d) >= percent / 100 - MARGIN].max())


def _list(values: np.ndarray) -> pa.Array:
    flat = pa.array(values.reshape(-1).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), flat)


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)


def sign(docs: DataFrame, n_bands: int = BANDS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_shingles", "fp_a", "fp_b", "bands", "sketch"]
        for b in batches:
            for lo, hi, data, bounds in chunks(b.column(1)):
                sets = shingle_sets(data, bounds)
                some = np.flatnonzero([len(s) > 0 for s in sets])
                ids = b.column(0).slice(lo, hi - lo)
                none = pa.array(np.flatnonzero([len(s) == 0 for s in sets]))
                if len(some):
                    full = [sets[i] for i in some]
                    bands, sketch = signatures(full, n_bands)
                    fp = fingerprints(full)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(some)), pa.array(list(map(len, full)), pa.int64()), pa.array(np.ascontiguousarray(fp[:, 0])), pa.array(np.ascontiguousarray(fp[:, 1])), _list(bands), _list(sketch)], names)
                if len(none):
                    empty = [pa.nulls(len(none), t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([ids.take(none), pa.array([0] * len(none), pa.int64()), *empty], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), _SIGN)


def full_sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, bounds in chunks(b.column(1)):
                sets = shingle_sets(data, bounds)
                at = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
                flat = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(np.diff(at).astype(np.int64)), pa.array(fingerprints(sets)[:, 0]), pa.ListArray.from_arrays(pa.array(at), flat)],
                    ["doc_id", "n_shingles", "fp_a", "members"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), _SETS)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) that meet the threshold on full sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("members").alias("m_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("members").alias("m_b"))
    both = F.size(F.array_intersect("m_a", "m_b"))
    return (
        pairs.join(left, "a").join(right, "b")
        .where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))
        .where(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both))
        .select("a", "b")
    )


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups: rows that agree in the first `keys` columns, which stand together."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        cut = int(starts_of(t, keys)[-1]) if t.num_rows else 0
        if cut:
            yield t.slice(0, cut).combine_chunks()
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def starts_of(t: pa.Table, keys: int) -> np.ndarray:
    """Where the groups of a table begin."""
    new = np.ones(t.num_rows, bool)
    new[1:] = False
    for i in range(keys):
        k = t.column(i).to_numpy()
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    """An array column of equal lengths as a matrix of unsigned words."""
    flat = t.column(name).combine_chunks().flatten().to_numpy().view(np.uint64)
    return flat.reshape(t.num_rows, -1)


def _pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within each group, some PAIRS at a time."""
    for m in np.unique(sizes[sizes > 1]).tolist():
        lo = starts[sizes == m]
        if m <= 64:
            i, j = np.triu_indices(m, 1)
            step = max(1, PAIRS // len(i))
            for k in range(0, len(lo), step):
                at = lo[k : k + step, None]
                yield (at + i).ravel(), (at + j).ravel()
        else:
            for at in lo.tolist():
                step = max(1, PAIRS // m)
                for k in range(0, m, step):
                    i, j = np.divmod(np.arange(k * m, min(k + step, m) * m), m)
                    later = j > i
                    yield at + i[later], at + j[later]


def near_members(t: pa.Table, percent: int) -> np.ndarray:
    """Rows of whole blocks with a near sketch in another component; key, kind, lo, hi, doc_id, comp, n_shingles, side, bands, sketch."""
    key, kind, lo, hi, comp, size, side = (t.column(c).to_numpy() for c in ("key", "kind", "lo", "hi", "comp", "n_shingles", "side"))
    bands, sketch = _matrix(t, "bands"), _matrix(t, "sketch")
    starts = starts_of(t, 4)
    within = (kind == 1) & (lo == hi)
    most, hit = widest(percent), np.zeros(t.num_rows, bool)
    for i, j in _pairs(starts, np.diff(np.r_[starts, t.num_rows])):
        may = (comp[i] != comp[j]) & (within[i] | (side[i] != side[j]))
        may &= 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
        i, j = i[may], j[may]
        near = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1) <= most
        i, j = i[near], j[near]
        first = (bands[i] == bands[j]).argmax(axis=1)
        mine = bands[i, first].view(np.int64) == key[i]
        hit[i[mine]] = hit[j[mine]] = True
    return np.flatnonzero(hit)


def link_block(ids: np.ndarray, comp: np.ndarray, side: np.ndarray, sketch: np.ndarray, members: list[np.ndarray], percent: int, within: bool) -> list[tuple[int, int]]:
    """Links that join components of a block's members, confirmed on full sets."""
    size = np.fromiter(map(len, members), np.int64, len(members))
    comp, most, out = comp.copy(), widest(percent), []
    for i in range(len(ids)):
        may = (comp != comp[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
        may[: i + 1] = False
        if not within:
            may &= side != side[i]
        near = np.flatnonzero(may)
        apart = np.bitwise_count(sketch[near] ^ sketch[i]).sum(axis=1)
        near = near[apart <= most][np.argsort(apart[apart <= most], kind="stable")]
        for j in near.tolist():
            if comp[i] == comp[j]:
                continue
            n = len(np.intersect1d(members[i], members[j], assume_unique=True))
            if 100 * n >= percent * (size[i] + size[j] - n):
                comp[comp == comp[j]] = comp[i]
                out.append((int(ids[i]), int(ids[j])))
    return out


def _dealt(placed: DataFrame) -> DataFrame:
    """placed(key, doc_id, comp) of open buckets in pairs of blocks: key, kind, lo, hi, doc_id, comp, side.

    kind 0 is a block of the largest component (side 0) with one of the others (side 1); kind 1 a
    pair of blocks of the others, or one such block with itself.
    """
    by = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
        F.max_by("comp", "n").alias("largest"), F.max("n").alias("n"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("comps")
    )
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    open_ = materialize(by.where("comps > 1").select("key", "largest", blocks(F.col("n")).alias("a"), blocks(F.col("all") - F.col("n")).alias("b")))
    x = placed.join(open_, "key")
    h, spot = F.xxhash64("doc_id"), lambda *c: F.struct(*[F.lit(v).cast("int").alias(n) if isinstance(v, int) else v.alias(n) for n, v in zip(("kind", "lo", "hi", "side"), c)])
    a, b = F.sequence(F.lit(0), F.col("a") - 1), F.sequence(F.lit(0), F.col("b") - 1)
    i, j = F.pmod(h, F.col("a")).cast("int"), F.pmod(h, F.col("b")).cast("int")
    spots = F.when(F.col("comp") == F.col("largest"), F.transform(b, lambda y: spot(0, i, y, 0))).otherwise(
        F.concat(F.transform(a, lambda z: spot(0, z, j, 1)), F.transform(b, lambda y: spot(1, F.least(j, y), F.greatest(j, y), j)))
    )
    x = x.select("key", "doc_id", "comp", F.explode(spots).alias("s"))
    return x.select("key", "s.kind", "s.lo", "s.hi", "doc_id", "comp", "s.side")


def _together(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def _more_links(placed: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links(a, b) between components that share a bucket of placed(key, doc_id, comp)."""
    block = ["key", "kind", "lo", "hi"]
    kinds = "key long, kind int, lo int, hi int, doc_id long, comp long, n_shingles long, side int"

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 4):
            if len(hit := near_members(t, percent)):
                yield from t.select(range(8)).take(pa.array(hit)).combine_chunks().to_batches()

    dealt = _dealt(placed).join(sketches.select("doc_id", "n_shingles", "bands", "sketch"), "doc_id")
    dealt = dealt.select(*block, "doc_id", "comp", "n_shingles", "side", "bands", "sketch")
    some = materialize_texts(_together(dealt, *block).mapInArrow(lean(near), kinds))
    parts = some.groupBy(*block).agg(F.ceil(F.sum("n_shingles") / F.lit(BLOCK_SHINGLES)).cast("int").alias("parts"))
    x = some.join(parts, block).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("parts")).cast("int"))
    x = x.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x = x.select(*block, F.least("part", "with").alias("p"), F.greatest("part", "with").alias("q"), "part", "doc_id", "comp", "side")
    x = x.join(sketches.select("doc_id", "sketch"), "doc_id").join(sets.select("doc_id", "members"), "doc_id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 6):
            cols = [t.column(c).to_numpy() for c in ("doc_id", "comp", "side", "part", "kind", "lo", "hi", "p", "q")]
            sketch, members = _matrix(t, "sketch"), t.column("members").combine_chunks()
            at, flat = members.offsets.to_numpy(), members.values.to_numpy()
            out = []
            ends = starts_of(t, 6).tolist() + [t.num_rows]
            for lo, hi in zip(ends, ends[1:]):
                ids, comp, side, part, kind, x, y, p, q = (c[lo:hi] for c in cols)
                own_block, one_part = kind[0] == 1 and x[0] == y[0], p[0] == q[0]
                # Pairs across sides, or of any two in a block that meets itself; of different parts where there are two.
                sides = np.zeros(hi - lo, np.int64) if own_block else side
                sides = sides if one_part else part if own_block else sides * 2 + part
                links = link_block(ids, comp, sides, sketch[lo:hi], [flat[at[k] : at[k + 1]] for k in range(lo, hi)], percent, own_block and one_part)
                out += links
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    ready = _together(x.select(*block, "p", "q", "doc_id", "comp", "side", "part", "sketch", "members"), *block, "p", "q")
    links = materialize_texts(ready.mapInArrow(lean(search), "a long, b long"))
    discard(some)
    return links


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text)."""
    signed = materialize_texts(sign(docs, bands_for(percent)))
    named = signed.where("fp_a is not null and doc_id is not null")
    classes = materialize(named.groupBy("fp_a", "fp_b").agg(F.min("doc_id").alias("rep")))
    nodes = classes.groupBy(F.col("rep").alias("doc_id")).agg(F.min("fp_a").alias("fp_a"))
    reps = materialize(named.join(nodes, ["doc_id", "fp_a"], "left_semi").dropDuplicates(["doc_id"]))
    named_rows = materialize(signed.select("doc_id", "n_shingles", "fp_a", "fp_b"))
    discard(signed)
    bands = reps.select(F.explode("bands").alias("key"), "doc_id")
    hubs = materialize(
        bands.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub <> last").drop("last")
    )
    buckets = materialize(bands.join(hubs, "key"))
    busy = buckets.select("doc_id").distinct()
    sketches = materialize(reps.join(busy, "doc_id", "left_semi").select("doc_id", "fp_a", "n_shingles", "bands", "sketch"))
    discard(reps, hubs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    some = full_sets(texts.join(sketches.select("doc_id"), "doc_id", "left_semi"))
    held = materialize_texts(some.join(sketches.select("doc_id", "fp_a"), ["doc_id", "fp_a"], "left_semi"))
    sets = held.dropDuplicates(["doc_id"])
    apart = F.expr("aggregate(zip_with(s_a, s_b, (x, y) -> bit_count(x ^ y)), 0, (t, c) -> t + c)")
    pairs = buckets.where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    best = (
        pairs.join(sketches.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("s_a")), "a")
        .join(sketches.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("s_b")), "b")
        .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        .select("a", "b", apart.alias("apart")).where(F.col("apart") <= widest(percent))
        .groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b"))
    )
    links = materialize(confirmed(best, sets, percent))
    comps = connected_components(links)
    # What is left: buckets whose members are of several components.
    label = comps.select(F.col("id").alias("doc_id"), "comp")
    placed = materialize(buckets.join(label, "doc_id", "left").select("key", "doc_id", F.coalesce("comp", "doc_id").alias("comp")))
    more = _more_links(placed, sketches, sets, percent)
    comps = connected_components(links.union(more)) if not more.isEmpty() else comps
    named_class = classes.join(comps, F.col("rep") == F.col("id"), "left").select(
        F.col("fp_a").alias("x"), F.col("fp_b").alias("y"), F.coalesce("comp", "rep").alias("comp")
    )
    out = named_rows.join(materialize(named_class), (F.col("fp_a") == F.col("x")) & (F.col("fp_b") == F.col("y")) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("comp", "doc_id")
    result = materialize(out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")))
    discard(named_rows, classes, buckets, sketches, held, links, placed, more)
    return result


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group: the one of smallest doc_id, and one row of repeated rows.

    Rows of null doc_id stay. Columns are those of docs, whatever their names.
    """
    lost, n = free_name("lost", docs), free_name("n", docs)
    of = F.col("doc_id").cast("long") == F.col(lost)
    kept = docs.join(components(docs, percent).where("not kept").select(F.col("doc_id").alias(lost)).distinct(), of, "left_anti")
    ids = docs.select(F.col("doc_id").cast("long").alias("id")).where("id is not null")
    repeated = materialize(ids.groupBy("id").count().where("count > 1").select(F.col("id").alias(lost)))
    if repeated.isEmpty():
        return kept
    # The row of smallest text; ties go by a hash of the columns that can be hashed.
    plain = [F.col(quoted(c)) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    first = F.min_by(F.struct(*own(docs)), F.struct("text", F.xxhash64(*plain)))
    once = kept.join(repeated, of, "left_semi").groupBy("doc_id").agg(first.alias(n))
    once = once.select(*[F.col(n)[c].alias(c) for c in docs.columns])
    return kept.join(repeated, of, "left_anti").unionByName(once)
