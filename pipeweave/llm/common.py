"""Session helpers shared by the operators: the shared folder, lineage cuts, connected components."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share; it goes when the driver ends.

    Only where the setting is absent and Spark runs on one machine a temporary folder is chosen and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pipeweave-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    folder = f"{base.rstrip('/')}/pipeweave-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Hold Arrow batches to BATCH_BYTES, or to what the session has if that is less, for what runs inside.

    A batch stands in the JVM's buffers and in the Python worker at once, so operators on whole texts bound it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    size, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", before.strip().lower()).groups()
    spark.conf.set(key, str(min(BATCH_BYTES, int(size) << 10 * " kmgtp".index(unit or " "))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextlib.contextmanager
def no_leftovers(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of each query that runs inside when it ends, not when the driver forgets it.

    For queries whose plan runs once; one that runs again would make its shuffles anew.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def lean(run: Callable) -> Callable:
    """run, a function over batches, with memory given back to the system when its task ends.

    Workers outlive their tasks and would else hold the largest of all of them.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


def _give_back() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lost executors cost no recomputation."""
    folder = shared_dir(df.sparkSession)
    with no_leftovers(df.sparkSession):
        df.write.parquet(f"{folder}/t")
    out = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/t")
    out.written_to = folder
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what materialize wrote for these frames; all that reads them must have been written."""
    for df in frames:
        if folder := getattr(df, "written_to", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def materialize_texts(df: DataFrame) -> DataFrame:
    """materialize for a pass of Python over whole texts, in small batches."""
    with small_batches(df.sparkSession):
        return materialize(df)


def map_rows(df: DataFrame, run: Callable, fields: list[T.StructField]) -> DataFrame:
    """df through run, over Arrow batches whose columns it takes and gives by place, so names may be any."""
    given = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    made = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])

    def named(batches):
        import pyarrow as pa

        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, made.names)

    return given.mapInArrow(lean(named), made).toDF(*[f.name for f in fields])


def free_name(name: str, *frames: DataFrame) -> str:
    """name, led by as many underscores as make it none of the frames' columns in any case of letters."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    """A column's name as an expression, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def own(df: DataFrame) -> list:
    """All columns of df, by quoted name."""
    return [F.col(quoted(c)) for c in df.columns]


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Smallest node id reachable from every node of edges(a, b): returns (id, comp).

    Each round takes the smallest label among a node's neighbours, then jumps to the label of
    that label, so chains shorten geometrically. Labels stay distributed; the driver sees a count.
    """
    both = materialize(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    before = labels
    for _ in range(max_rounds):
        near = (
            both.join(labels, F.col("b") == F.col("id"))
            .groupBy("a").agg(F.min("comp").alias("near"))
        )
        hooked = labels.join(near, F.col("id") == F.col("a"), "left").select(
            "id", F.col("comp").alias("old"), F.least("comp", F.coalesce("near", "comp")).alias("comp")
        )
        up = labels.select(F.col("id").alias("via"), F.col("comp").alias("top"))
        jumped = materialize(
            hooked.join(up, F.col("comp") == F.col("via"), "left").select(
                "id", "old", F.least("comp", F.coalesce("top", "comp")).alias("comp")
            )
        )
        discard(before)
        before, labels = jumped, jumped.select("id", "comp")
        if jumped.where("comp <> old").isEmpty():
            discard(both)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
