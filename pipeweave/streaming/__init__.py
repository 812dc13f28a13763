"""Row-local pipelines over unbounded sources.

Stages that look at one row at a time mean the same on a stream, so a program of those alone runs
unchanged on a streaming DataFrame, as a Structured Streaming query without state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..lang.diagnostics import fail
from ..lang.parser import parse
from ..operators.stages import STAGES
from ..sources.readers import typed

ROW_LOCAL = ("filter", "select", "drop", "rename", "mutate", "pivot_longer")


def lift(stream: DataFrame, source: str, context: dict | None = None) -> DataFrame:
    """The main pipeline of a program over stream, in place of what the program loads."""
    program = parse(source)
    values = {("$" if c.kind == "param" else "@", c.name): (context or {}).get(c.name, c.default) for c in program.contexts}
    rel = typed(stream, [])
    for s in program.main.stages:
        if s.kind not in ROW_LOCAL or "Window(" in repr(s.args):
            fail("E1211", f"`{s.kind}` looks at more than one row and can't run on a stream", s.span)
        rel = STAGES[s.kind](rel, s, values)
    return rel.frame()
