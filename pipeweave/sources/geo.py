"""Spatial files: GeoJSON in and out, TopoJSON and shapefiles in. A geometry is kept as GeoJSON text."""

from __future__ import annotations

import json
import struct

from ..lang.diagnostics import fail

GEOMETRIES = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection")
Rows = tuple[list[str], list[dict]]  # property names in order of appearance, and rows; geometry under "geom"


def _text(g) -> str | None:
    if g is None:
        return None
    if not isinstance(g, dict) or g.get("type") not in GEOMETRIES:
        fail("E1822", "not a geometry")
    return json.dumps(g, separators=(",", ":"), ensure_ascii=False)


def _table(pairs: list[tuple[dict, str | None]]) -> Rows:
    names: dict[str, None] = {}
    rows = []
    for props, geom in pairs:
        row = {k: json.dumps(v, separators=(",", ":"), ensure_ascii=False) if isinstance(v, (dict, list)) else v for k, v in (props or {}).items()}
        names.update(dict.fromkeys(row))
        rows.append(row | {"geom": geom})
    names.pop("geom", None)
    return [*names], rows


def read_geojson(data: bytes) -> Rows:
    try:
        doc = json.loads(data)
    except ValueError as e:
        fail("E1804", f"not JSON: {e}")
    kind = doc.get("type") if isinstance(doc, dict) else None
    if kind not in ("FeatureCollection", "Feature"):
        fail("E1822", "expected a FeatureCollection or a Feature")
    features = doc.get("features", []) if kind == "FeatureCollection" else [doc]
    return _table([(f.get("properties") or {}, _text(f.get("geometry"))) for f in features])


def read_topojson(data: bytes) -> Rows:
    try:
        doc = json.loads(data)
    except ValueError as e:
        fail("E1804", f"not JSON: {e}")
    objects = doc.get("objects") or {}
    if doc.get("type") != "Topology" or len(objects) != 1:
        fail("E1821", "expected a topology of exactly one object")
    move = doc.get("transform")
    scale, shift = (move["scale"], move["translate"]) if move else ((1, 1), (0, 0))

    def point(p):
        return [p[0] * scale[0] + shift[0], p[1] * scale[1] + shift[1]] if move else list(p)

    arcs = []
    for arc in doc.get("arcs", []):
        if move:  # delta-encoded
            x = y = 0
            line = []
            for dx, dy, *_ in arc:
                x, y = x + dx, y + dy
                line.append(point((x, y)))
            arcs.append(line)
        else:
            arcs.append([list(p) for p in arc])

    def line(indexes):
        out: list = []
        for i in indexes:
            part = arcs[i] if i >= 0 else arcs[~i][::-1]
            out += part[1:] if out else part
        return out

    def geometry(g):
        kind = g.get("type")
        if kind is None:
            return None
        if kind == "GeometryCollection":
            return {"type": kind, "geometries": [geometry(x) for x in g["geometries"]]}
        if kind == "Point":
            return {"type": kind, "coordinates": point(g["coordinates"])}
        if kind == "MultiPoint":
            return {"type": kind, "coordinates": [point(p) for p in g["coordinates"]]}
        depth = {"LineString": 0, "MultiLineString": 1, "Polygon": 1, "MultiPolygon": 2}.get(kind)
        if depth is None:
            fail("E1822", f"unknown geometry `{kind}`")

        def walk(x, d):
            return line(x) if d == 0 else [walk(y, d - 1) for y in x]

        return {"type": kind, "coordinates": walk(g["arcs"], depth)}

    (top,) = objects.values()
    parts = top["geometries"] if top.get("type") == "GeometryCollection" else [top]
    return _table([(p.get("properties") or {}, _text(geometry(p))) for p in parts])


def _area(ring: list) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def _inside(p, ring) -> bool:
    x, y, hit = p[0], p[1], False
    for a, b in zip(ring, ring[1:]):
        if (a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0]:
            hit = not hit
    return hit


def _shape(body: bytes) -> dict | None:
    (kind,) = struct.unpack_from("<i", body)
    base = kind % 10
    if kind == 0:
        return None
    if base == 1:
        return {"type": "Point", "coordinates": list(struct.unpack_from("<2d", body, 4))}
    if base == 8:
        (n,) = struct.unpack_from("<i", body, 36)
        flat = struct.unpack_from(f"<{2 * n}d", body, 40)
        return {"type": "MultiPoint", "coordinates": [list(flat[i : i + 2]) for i in range(0, 2 * n, 2)]}
    if base not in (3, 5):
        fail("E1804", f"unknown shape type {kind}")
    n_parts, n = struct.unpack_from("<2i", body, 36)
    starts = [*struct.unpack_from(f"<{n_parts}i", body, 44), n]
    flat = struct.unpack_from(f"<{2 * n}d", body, 44 + 4 * n_parts)
    points = [list(flat[i : i + 2]) for i in range(0, 2 * n, 2)]
    parts = [points[a:b] for a, b in zip(starts, starts[1:])]
    if base == 3:
        return {"type": "LineString", "coordinates": parts[0]} if len(parts) == 1 else {"type": "MultiLineString", "coordinates": parts}
    # Outer rings turn clockwise; each hole goes to the outer ring round it.
    outer = [[r] for r in parts if _area(r) <= 0] or [[r] for r in parts]
    holes = [r for r in parts if _area(r) > 0] if any(_area(r) <= 0 for r in parts) else []
    for h in holes:
        next((o for o in outer if _inside(h[0], o[0])), outer[0]).append(h)
    return {"type": "Polygon", "coordinates": outer[0]} if len(outer) == 1 else {"type": "MultiPolygon", "coordinates": outer}


def _dbf(data: bytes) -> Rows:
    count, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode("latin-1")
        fields.append((name, chr(data[at + 11]), data[at + 16]))
        at += 32
    rows = []
    for i in range(count):
        record = data[head + i * size : head + (i + 1) * size]
        row, k = {}, 1
        for name, kind, width in fields:
            raw = record[k : k + width]
            k += width
            text = (raw.decode("utf-8", "replace")).strip(" \0")
            if kind in "NF":
                try:
                    row[name] = float(text)
                except ValueError:
                    row[name] = None
            elif kind == "L":
                row[name] = {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
            elif kind == "D" and len(text) == 8:
                row[name] = f"{text[:4]}-{text[4:6]}-{text[6:]}"
            else:
                row[name] = text or None
        rows.append(row | {"__deleted": record[:1] == b"*"})
    return [f[0] for f in fields], rows


def read_shapefile(shp: bytes, dbf: bytes) -> Rows:
    names, attributes = _dbf(dbf)
    at, rows = 100, []
    if len(shp) < 100 or struct.unpack_from(">i", shp)[0] != 9994:
        fail("E1804", "not a shapefile")
    while at + 8 <= len(shp):
        (length,) = struct.unpack_from(">i", shp, at + 4)
        i = len(rows)
        row = dict(attributes[i]) if i < len(attributes) else {}
        shape = _shape(shp[at + 8 : at + 8 + 2 * length])
        rows.append(row | {"geom": _text(shape)})
        at += 8 + 2 * length
    rows = [{k: v for k, v in r.items() if k != "__deleted"} for r in rows if not r.get("__deleted")]
    return names, rows


def write_geojson(names: list[str], geometry: str, rows, out) -> None:
    """Stream a FeatureCollection of rows (dicts of plain values; the geometry as text) to out."""
    out.write('{"type":"FeatureCollection","features":[')
    for i, r in enumerate(rows):
        props = ",".join(f"{json.dumps(n, ensure_ascii=False)}:{json_value(r[n])}" for n in names if n != geometry)
        out.write(f'{"," if i else ""}{{"type":"Feature","properties":{{{props}}},"geometry":{r[geometry] or "null"}}}')
    out.write("]}\n")


def json_value(v) -> str:
    """JSON of a cell: whole numbers without a point; a number that isn't finite can't be written."""
    if isinstance(v, float):
        if v != v or v in (float("inf"), float("-inf")):
            fail("E1704", "JSON has no number for NaN or infinity")
        if v == int(v) and abs(v) < 2**63:
            return str(int(v))
    return json.dumps(v, ensure_ascii=False)
