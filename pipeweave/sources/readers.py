"""Readers: every format to a relation with classes and row order."""

from __future__ import annotations

import csv
import io
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import MIXED, NUMBER, Value, class_of, parse_number, tagged
from ..lang.diagnostics import Span, fail
from ..plans.rel import Col, Order, Rel, fresh
from . import geo
from .formats import by_ending, named, sniffed


def head_of(path: str, n: int = 4096) -> bytes:
    from pyarrow import fs

    store, local = _store(path)
    if store.get_file_info(local).type == fs.FileType.Directory:
        return b""
    with store.open_input_stream(local) as f:
        return f.read(n)


def _store(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def bytes_of(path: str) -> bytes:
    store, local = _store(path)
    with store.open_input_stream(local) as f:
        return f.read()


def resolve(path: str, folder: str) -> str:
    """Inputs are relative to the folder of the program."""
    return path if "://" in path or path.startswith(("file:", "/")) else os.path.join(folder, path)


def format_of(path: str, clause: str | None, span: Span = Span()) -> str:
    if clause:
        return named(clause, span)
    if found := by_ending(path):
        return found
    head = head_of(path)
    return sniffed(head, span) if head else "parquet" if os.path.isdir(path) else "csv"


def read(spark: SparkSession, path: str, kind: str, span: Span = Span()) -> Rel:
    try:
        return READERS[kind](spark, path)
    except FileNotFoundError as e:
        fail("E1801", f"can't read `{path}`: {e}", span)
    except PySparkException as e:
        if "PATH_NOT_FOUND" in str(e):
            fail("E1801", f"can't read `{path}`", span)
        raise


def read_bytes(spark: SparkSession, data: bytes, kind: str | None, span: Span = Span()) -> Rel:
    """A source that is in the driver's hands, such as standard input."""
    kind = kind or sniffed(data[:4096], span)
    if kind == "arrow-stream":
        return from_arrow(spark, pa.ipc.open_stream(data).read_all())
    if kind == "arrow-file":
        return from_arrow(spark, pa.ipc.open_file(pa.BufferReader(data)).read_all())
    if kind == "geojson":
        return from_rows(spark, *geo.read_geojson(data))
    if kind == "topojson":
        return from_rows(spark, *geo.read_topojson(data))
    if kind == "parquet":
        import pyarrow.parquet as pq

        return from_arrow(spark, pq.read_table(pa.BufferReader(data)))
    if kind in ("csv", "jsonl"):
        lines = _text_frame(spark, data, kind)
        return classify(lines) if kind == "csv" else from_json_lines(lines)
    fail("E1215", f"`{kind}` can't be read from a stream", span)


def _text_frame(spark: SparkSession, data: bytes, kind: str):
    """Bytes in the driver's hands as a frame of text, without a file that executors would have to see."""
    text = data.decode("utf-8-sig")
    if kind == "jsonl":
        lines = pa.table({"value": pa.array(text.split("\n"), pa.string()), "i": pa.array(range(text.count("\n") + 1), pa.int64())})
        return spark.createDataFrame(lines)
    rows = list(csv.reader(io.StringIO(text), strict=True))
    rows = [r for r in rows if r]
    if not rows:
        fail("E1804", "a CSV source needs a header")
    header, body = rows[0], rows[1:]
    if bad := next((i for i, r in enumerate(body) if len(r) != len(header)), None):
        fail("E1804", f"row {bad + 1} has {len(body[bad])} fields, not {len(header)}")
    if body and len(body[0]) != len(header):
        fail("E1804", f"row 1 has {len(body[0])} fields, not {len(header)}")
    cols, order = [fresh() for _ in header], fresh("o")
    arrays = [pa.array([r[i] for r in body], pa.string()) for i in range(len(header))]
    table = pa.table([*arrays, pa.array(range(len(body)), pa.int64())], names=[*cols, order])
    return Rel(spark.createDataFrame(table), tuple(Col(n, c, "str") for n, c in zip(header, cols)), (Order(order),))


def read_csv(spark: SparkSession, path: str) -> Rel:
    options = dict(sep=",", quote='"', escape='"', multiLine=True, mode="FAILFAST", enforceSchema=True, encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    header = header_of(path)
    if header is None:
        fail("E1804", "a CSV source needs a header")
    if len(set(header)) < len(header):
        fail("E1008", "a column name occurs twice in the header")
    # Quoted line ends can't be split on, so only tables without any are read in splits.
    options["multiLine"] = _quotes_line_ends(spark, path)
    phys = [fresh() for _ in header]
    schema = ", ".join(f"{p} string" for p in phys)
    raw = spark.read.schema(schema).options(header=True, nullValue="", emptyValue="", **options).csv(path)
    order = [fresh("o") for _ in range(3)]
    df = raw.select(
        *phys, F.col("_metadata.file_path").alias(order[0]), F.col("_metadata.file_block_start").alias(order[1]),
        F.monotonically_increasing_id().alias(order[2]),
    )
    return classify(Rel(df, tuple(Col(n, p, "str") for n, p in zip(header, phys)), tuple(map(Order, order))))


def header_of(path: str) -> list[str] | None:
    from pyarrow import fs

    store, local = _store(path)
    if store.get_file_info(local).type == fs.FileType.Directory:
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(local)) if f.is_file and not f.base_name.startswith(("_", ".")))
        if not files:
            return None
        local = files[0]
    if not store.get_file_info(local).is_file:
        raise FileNotFoundError(path)
    with store.open_input_stream(local) as f:
        head = io.TextIOWrapper(f, encoding="utf-8-sig", newline="")
        return next(csv.reader(head), None)


def _quotes_line_ends(spark: SparkSession, path: str) -> bool:
    """Whether a cell goes on in the next line: the line it begins in then has an odd number of quotes. Reads all lines, in splits."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).limit(1).isEmpty()


def classify(rel: Rel) -> Rel:
    """Text columns as the class of their cells: boolean, number or string, else mixed; empty cells are null.

    One aggregate over the source counts the classes of every column.
    """
    if not rel.cols:
        return rel
    aggs = []
    for c in rel.cols:
        x = F.col(c.phys)
        some = x.isNotNull() & (x != "")
        flag = x.isin("true", "false")
        num = x.rlike(NUMBER)
        aggs += [
            F.coalesce(F.bool_or(some & flag), F.lit(False)), F.coalesce(F.bool_or(some & ~flag & num), F.lit(False)),
            F.coalesce(F.bool_or(some & ~flag & ~num), F.lit(False)),
        ]
    try:
        seen = rel.df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
    except Exception as e:
        if "MALFORMED" in str(e) or "malformed" in str(e):
            fail("E1804", "a row has another number of fields than the header")
        raise
    cols = []
    for i, c in enumerate(rel.cols):
        has = {k for k, on in zip(("bool", "num", "str"), seen[3 * i : 3 * i + 3]) if on}
        x = F.when(F.col(c.phys) != "", F.col(c.phys))
        flag = F.when(x == "true", True).when(x == "false", False)
        if not has:
            v = Value(x, "null")
        elif has == {"bool"}:
            v = Value(flag, "bool")
        elif has == {"num"}:
            v = Value(parse_number(x), "num")
        elif has == {"str"}:
            v = Value(x, "str")
        else:
            v = Value(
                F.when(flag.isNotNull(), tagged(Value(flag, "bool"))).when(x.rlike(NUMBER), tagged(Value(parse_number(x), "num")))
                .when(x.isNotNull(), tagged(Value(x, "str"))).cast(MIXED), "mixed",
            )
        cols.append((c.name, v))
    return rel.with_cols(cols)


def read_json_lines(spark: SparkSession, path: str) -> Rel:
    order = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    return from_json_lines(spark.read.text(path).select("value", *[o.alias(f"i{k}") for k, o in enumerate(order)]))


def from_json_lines(lines: DataFrame) -> Rel:
    # The last of a line's equal keys holds.
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    order = [c for c in lines.columns if c != "value"]
    rows = lines.where(~F.col("value").rlike(r"^\s*$"))
    parsed = rows.withColumn("v", F.try_parse_json("value")).withColumn("keys", F.json_object_keys("value"))
    bad = parsed.where(F.col("v").isNull() | F.col("keys").isNull()).limit(1)
    if not bad.isEmpty():
        fail("E1804", "a line isn't a JSON object")
    # A row for each column name there is: its first place over all lines.
    at = parsed.select(F.posexplode("keys").alias("p", "key"), F.struct(*order).alias("o"))
    keys = [r["key"] for r in at.groupBy("key").agg(F.min(F.struct("o", "p")).alias("first")).orderBy("first").collect()]
    field = {k: F.try_variant_get("v", "$[" + _quoted(k) + "]", "variant") for k in keys}
    kinds = []
    if keys:
        kind = {k: F.split_part(F.split_part(F.schema_of_variant(v), F.lit("<"), F.lit(1)), F.lit("("), F.lit(1)) for k, v in field.items()}
        seen = parsed.agg(*[F.collect_set(c).alias(f"k{i}") for i, c in enumerate(kind.values())]).first()  # of a handful of type names
        kinds = [{_JSON.get(x, "str") for x in s if x != "VOID"} for s in seen]
    physical = [fresh("o") for _ in order]
    cols, made = [], []
    for k, has in zip(keys, kinds):
        v = field[k]
        path = "$[" + _quoted(k) + "]"
        b, n = F.try_variant_get("v", path, "boolean"), F.try_variant_get("v", path, "double")
        s = F.when(kind[k].isin("OBJECT", "ARRAY"), F.to_json(v)).when(kind[k] == "STRING", F.try_variant_get("v", path, "string"))
        if not has:
            x = Value(F.lit(None).cast("string"), "null")
        elif has == {"bool"}:
            x = Value(b, "bool")
        elif has == {"num"}:
            x = Value(n, "num")
        elif has == {"str"}:
            x = Value(s, "str")
        else:
            is_ = lambda t: kind[k].isin(*[a for a, c in _JSON.items() if c == t])
            x = Value(F.when(is_("bool"), tagged(Value(b, "bool"))).when(is_("num"), tagged(Value(n, "num"))).otherwise(tagged(Value(s, "str"))).cast(MIXED), "mixed")
        c = Col(k, fresh(), x.cls)
        made.append(c)
        cols.append(x.col.alias(c.phys))
    df = parsed.select(*cols, *[F.col(o).alias(p) for o, p in zip(order, physical)])
    return Rel(df, tuple(made), tuple(map(Order, physical)))


#: Variant type names by class.
_JSON = {
    "BOOLEAN": "bool", "BIGINT": "num", "DOUBLE": "num", "DECIMAL": "num", "FLOAT": "num", "STRING": "str", "OBJECT": "str", "ARRAY": "str",
}


def _quoted(key: str) -> str:
    return '"' + key.replace("\\", "\\\\").replace('"', '\\"') + '"' if "'" in key else f"'{key}'"


def typed(df: DataFrame, order: list) -> Rel:
    """A relation over a typed source: columns keep their types, and classes follow from them."""
    cols = []
    for f in df.schema.fields:
        cls, integral = class_of(f.dataType)
        if (f.metadata or {}).get("pipeweave.class") == "geometry":
            cls = "geom"
        cols.append(Col(f.name, fresh(), cls, integral, f.dataType.simpleString() if cls == "time" else ""))
    keys = [fresh("o") for _ in order]
    # By position, as names that differ in case only can't be told apart by name.
    hidden = [o.alias(k) for o, k in zip(order, keys)]
    names = [fresh("x") for _ in cols]
    renamed = df.select("*", *hidden) if hidden else df
    renamed = renamed.toDF(*names, *keys)
    out = renamed.select(*[F.col(n).alias(c.phys) for n, c in zip(names, cols)], *keys)
    return Rel(out, tuple(cols), tuple(map(Order, keys)))


def read_parquet(spark: SparkSession, path: str) -> Rel:
    return typed(spark.read.parquet(path), [F.col("_metadata.file_path"), F.col("_metadata.row_index")])


def from_arrow(spark: SparkSession, table: pa.Table) -> Rel:
    table = pa.table([c.cast(c.type.value_type) if pa.types.is_dictionary(c.type) else c for c in table.columns], schema=pa.schema([
        f.with_type(f.type.value_type) if pa.types.is_dictionary(f.type) else f for f in table.schema
    ]))
    n = pa.array(range(table.num_rows), pa.int64())
    name = fresh("row")
    df = spark.createDataFrame(table.append_column(name, n))
    rel = typed(df.drop(name), [])
    key = fresh("o")
    renamed = df.toDF(*[c.phys for c in rel.cols], key)
    return Rel(renamed, rel.cols, (Order(key),))


def read_arrow_file(spark: SparkSession, path: str) -> Rel:
    """Record batches are read by executors, each by its number, so a large file is read in parallel."""
    store, local = _store(path)
    if not store.get_file_info(local).is_file:
        raise FileNotFoundError(path)
    with store.open_input_file(local) as f, pa.ipc.open_file(f) as r:
        n, schema = r.num_record_batches, r.schema
        if n <= 1 or any(pa.types.is_dictionary(x.type) for x in schema):
            return from_arrow(spark, r.read_all())
        shape = spark.createDataFrame(schema.empty_table()).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, local = _store(path)
        with store.open_input_file(local) as f, pa.ipc.open_file(f) as r:
            for b in batches:
                for i in b.column(0).to_pylist():
                    got = r.get_batch(i)
                    at = pa.array([(i << 32) + k for k in range(got.num_rows)], pa.int64())
                    yield pa.RecordBatch.from_arrays([*got.columns, at], [*got.schema.names, "__at"])

    from pyspark.sql import types as T

    df = spark.range(0, n, 1, n).mapInArrow(run, T.StructType([*shape.fields, T.StructField("__at", T.LongType())]))
    key = fresh("o")
    rel = typed(df.drop("__at"), [])
    return Rel(df.toDF(*[c.phys for c in rel.cols], key), rel.cols, (Order(key),))


def read_arrow_stream(spark: SparkSession, path: str) -> Rel:
    return read_bytes(spark, bytes_of(path), "arrow-stream")


def from_rows(spark: SparkSession, names: list[str], rows: list[dict]) -> Rel:
    """Property rows beside a geometry. Text properties are classified as CSV cells are."""
    order, cols, arrays = fresh("o"), [], []
    for n in names:
        cells = [_cell(r.get(n)) for r in rows]
        kinds = {_kind(c) for c in cells if c is not None}
        phys = fresh()
        if len(kinds) > 1:
            arrays.append(pa.array([None if c is None else {"t": {"bool": 1, "num": 2, "str": 3}[_kind(c)], "b": c if _kind(c) == "bool" else None, "n": c if _kind(c) == "num" else None, "s": c if _kind(c) == "str" else None} for c in cells], pa.struct([("t", pa.int8()), ("b", pa.bool_()), ("n", pa.float64()), ("s", pa.string())])))
            cols.append(Col(n, phys, "mixed"))
        else:
            cls = kinds.pop() if kinds else "null"
            arrays.append(pa.array(cells, {"bool": pa.bool_(), "num": pa.float64()}.get(cls, pa.string())))
            cols.append(Col(n, phys, cls))
    cols.append(Col("geom", fresh(), "geom"))
    arrays.append(pa.array([r["geom"] for r in rows], pa.string()))
    arrays.append(pa.array(range(len(rows)), pa.int64()))
    table = pa.table(arrays, names=[*[c.phys for c in cols], order])
    return Rel(spark.createDataFrame(table), tuple(cols), (Order(order),))


def _kind(v) -> str:
    return "bool" if isinstance(v, bool) else "num" if isinstance(v, float) else "str"


def _cell(v):
    import re

    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return float(v)
    if not isinstance(v, str):
        return v
    if v == "":
        return None
    if v in ("true", "false"):
        return v == "true"
    return float(v) if re.match(NUMBER, v) else v


def read_geojson(spark: SparkSession, path: str) -> Rel:
    return from_rows(spark, *geo.read_geojson(bytes_of(path)))


def read_topojson(spark: SparkSession, path: str) -> Rel:
    return from_rows(spark, *geo.read_topojson(bytes_of(path)))


def read_shapefile(spark: SparkSession, path: str) -> Rel:
    table = str(Path(path).with_suffix(".dbf")) if "://" not in path else path[:-4] + ".dbf"
    try:
        dbf = bytes_of(table)
    except FileNotFoundError:
        fail("E1820", f"`{table}` is missing")
    return from_rows(spark, *geo.read_shapefile(bytes_of(path), dbf))


READERS = {
    "csv": read_csv, "jsonl": read_json_lines, "parquet": read_parquet, "arrow-file": read_arrow_file,
    "arrow-stream": read_arrow_stream, "geojson": read_geojson, "topojson": read_topojson, "shapefile": read_shapefile,
}
