"""Format names, and how the format of a source or sink is found."""

from __future__ import annotations

from pathlib import PurePosixPath

from ..lang.diagnostics import Span, fail

#: Spellings of each format and file name endings that imply one (fixed by the language).
NAMES = {
    "csv": "csv", "parquet": "parquet", "arrow-file": "arrow-file", "ipc": "arrow-file", "arrow-stream": "arrow-stream",
    "arrow": "arrow-stream", "jsonl": "jsonl", "ndjson": "jsonl", "geojson": "geojson", "shapefile": "shapefile",
    "shp": "shapefile", "topojson": "topojson",
}
ENDINGS = {
    "csv": "csv", "parquet": "parquet", "pq": "parquet", "arrow": "arrow-file", "feather": "arrow-file", "jsonl": "jsonl",
    "ndjson": "jsonl", "geojson": "geojson", "shp": "shapefile", "topojson": "topojson",
}


def named(name: str, span: Span = Span()) -> str:
    if name not in NAMES:
        fail("E1215", f"unknown format `{name}`", span)
    return NAMES[name]


def by_ending(path: str) -> str | None:
    return ENDINGS.get(PurePosixPath(path).suffix[1:].lower())


def sniffed(head: bytes, span: Span = Span()) -> str:
    """The format that the first bytes of a source show."""
    if head.startswith(b"PAR1"):
        return "parquet"
    if head.startswith(b"ARROW1"):
        return "arrow-file"
    if head.startswith(b"\xff\xff\xff\xff"):
        return "arrow-stream"
    try:
        text = head.decode()
    except UnicodeDecodeError as e:
        if e.start < len(head) - 4:
            fail("E1216", "the format can't be told from the content", span)
        text = head[: e.start].decode()
    return "jsonl" if text.lstrip()[:1] in ("{", "[") else "csv"
