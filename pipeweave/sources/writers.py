"""Writers: a relation in its order, to one file or stream, or for Parquet to a folder written by executors."""

from __future__ import annotations

import io
import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame


from ..functions.values import as_text, render, time_text
from ..lang.diagnostics import Span, fail
from ..plans.rel import Rel
from .geo import json_value, write_geojson


def check(rel: Rel, kind: str, span: Span = Span()) -> None:
    geometries = [c.name for c in rel.cols if c.cls == "geom"]
    if kind in ("shapefile", "topojson"):
        fail("E1705", f"`{kind}` can't be written", span)
    if kind == "geojson" and len(geometries) != 1:
        fail("E1712", f"GeoJSON needs one geometry column, not {len(geometries)}", span)
    if kind != "geojson" and geometries:
        fail("E1711", f"`{geometries[0]}` is a geometry, which only GeoJSON holds", span)


def typed(rel: Rel) -> DataFrame:
    """Booleans, doubles and text, as binary formats hold them; mixed columns become text."""
    out = []
    for c in rel.cols:
        v = as_text(c.value)
        kind = {"bool": v.col, "num": v.col.cast("double"), "mixed": render(v)}.get(v.cls, v.col if v.cls == "other" else v.col.cast("string"))
        out.append(kind.alias(c.name))
    return rel.sorted().select(*out)


def _csv_cell(x: str | None) -> str:
    if x is None:
        return ""
    return '"' + x.replace('"', '""') + '"' if any(ch in x for ch in ',"\n\r') else x


def write_csv(rel: Rel, out: io.TextIOBase) -> None:
    """Rows come to the driver a partition at a time, and are not held."""
    out.write(",".join(map(_csv_cell, rel.names)) + "\n")
    cells = rel.sorted().select(*[render(c.value).alias(f"x{i}") for i, c in enumerate(rel.cols)])
    for r in cells.toLocalIterator(prefetchPartitions=True):
        line = ",".join(map(_csv_cell, r))
        out.write((line or '""') + "\n" if len(rel.cols) == 1 else line + "\n")


def _plain(rel: Rel) -> DataFrame:
    """Cells as JSON writes them: structs of mixed columns stay structs."""
    out = []
    for i, c in enumerate(rel.cols):
        v = c.value
        col = time_text(v) if v.cls == "time" else v.col.cast("double") if v.cls == "num" else v.col
        out.append(col.alias(f"x{i}"))
    return rel.sorted().select(*out)


def _rows(rel: Rel):
    mixed = {i for i, c in enumerate(rel.cols) if c.cls == "mixed"}
    for r in _plain(rel).toLocalIterator(prefetchPartitions=True):
        cells = [(None if x is None else (x["b"], x["n"], x["s"])[x["t"] - 1]) if i in mixed else x for i, x in enumerate(r)]
        yield dict(zip(rel.names, cells))


def write_jsonl(rel: Rel, out: io.TextIOBase) -> None:
    import json

    keys = [json.dumps(n, ensure_ascii=False) for n in rel.names]
    for r in _rows(rel):
        out.write("{" + ",".join(f"{k}:{json_value(v)}" for k, v in zip(keys, r.values())) + "}\n")


def write_features(rel: Rel, out: io.TextIOBase) -> None:
    geometry = next(c.name for c in rel.cols if c.cls == "geom")
    write_geojson(rel.names, geometry, _rows(rel), out)


_TEXT = {"csv": write_csv, "jsonl": write_jsonl, "geojson": write_features}


def to_bytes(rel: Rel, kind: str, span: Span = Span()) -> bytes:
    check(rel, kind, span)
    if kind in _TEXT:
        out = io.StringIO()
        _TEXT[kind](rel, out)
        return out.getvalue().encode()
    table, out = _table(rel), io.BytesIO()
    if kind == "parquet":
        import pyarrow.parquet as pq

        pq.write_table(table, out)
    else:
        new = pa.ipc.new_file if kind == "arrow-file" else pa.ipc.new_stream
        with new(out, table.schema) as w:
            w.write_table(table)
    return out.getvalue()


def _table(rel: Rel) -> pa.Table:
    return typed(rel).toArrow()


def save(rel: Rel, path: str, kind: str, span: Span = Span(), folder: bool = False) -> None:
    """One file at path; with folder, Parquet, CSV and JSON Lines as a folder of parts in order."""
    check(rel, kind, span)
    if folder:
        df = typed(rel)
        if kind == "parquet":
            df.write.mode("overwrite").parquet(path)
        elif kind == "csv":
            cells = rel.sorted().select(*[render(c.value).alias(c.name) for c in rel.cols])
            cells.write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)
        elif kind == "jsonl":
            df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
        else:
            fail("E1702", f"`{kind}` is written as one file", span)
        return
    where = os.path.dirname(os.path.abspath(path))
    if not os.path.isdir(where):
        fail("E1701", f"no folder `{where}`", span)
    if kind not in _TEXT:
        _append_parts(typed(rel), path, kind)
        return
    with open(path, "w", encoding="utf-8", newline="") as f:
        _TEXT[kind](rel, f)


def _append_parts(df: DataFrame, path: str, kind: str) -> None:
    """One binary file from parts that executors write in order; the driver holds a batch of rows at a time."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = f"{(shared or f'file://{os.path.dirname(os.path.abspath(path))}').rstrip('/')}/.parts-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    store, at = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    try:
        parts = sorted(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.base_name.startswith("part-"))
        schema = pq.read_schema(store.open_input_file(parts[0]))
        schema = pa.schema([pa.field(f.name, f.type) for f in schema])  # without the writer's own notes
        with open(path, "wb") as f:
            new = {"parquet": pq.ParquetWriter, "arrow-file": pa.ipc.new_file}.get(kind, pa.ipc.new_stream)
            with new(f, schema) as w:
                for part in parts:
                    with store.open_input_file(part) as g:
                        for b in pq.ParquetFile(g).iter_batches():
                            w.write_batch(pa.RecordBatch.from_arrays(b.columns, schema=schema))
    finally:
        store.delete_dir(at)
