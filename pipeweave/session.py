"""Programs: prepared, planned and run on a Spark session."""

from __future__ import annotations

import os

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from .functions import controls
from .functions.values import render
from .lang.ast import Context, Pipeline, Program, Stage
from .lang.diagnostics import Diagnostic, ProgramError, Span, fail
from .lang.parser import parse
from .operators.stages import JOINED, STAGES
from .plans.rel import Rel
from .sources import readers, writers
from .sources.formats import by_ending, named

#: Stages after which rows must be gathered or dealt anew.
BLOCKING = ("agg", "sort", "distinct", "join", "union", "pivot_longer", "complete")


@dataclass
class Result:
    """stdout: bytes written there; table: the main pipeline's relation; outputs: those of named outputs."""

    table: Rel | None = None
    outputs: dict[str, Rel] = field(default_factory=dict)
    stdout: bytes = b""
    warnings: list[Diagnostic] = field(default_factory=list)

    def frame(self, name: str | None = None, ordered: bool = False) -> DataFrame:
        return (self.outputs[name] if name else self.table).frame(ordered)


class Engine:
    """Runs one program.

    tables: DataFrames by the path a program loads them under, in place of files.
    folder: where relative inputs are found; outputs are relative to the working folder.
    """

    def __init__(
        self, spark: SparkSession, source: str | Program, folder: str = ".", context: dict | None = None, stdin: bytes | None = None,
        stdin_format: str | None = None, stdout_format: str | None = None, tables: dict[str, DataFrame] | None = None, dry_run: bool = False,
        sink_folders: bool = False,
    ):
        self.spark, self.folder, self.stdin, self.tables = spark, folder, stdin, tables or {}
        self.stdin_format, self.stdout_format = stdin_format, stdout_format
        self.dry_run, self.sink_folders = dry_run, sink_folders
        self.program = parse(source) if isinstance(source, str) else source
        self.done: dict[str, Rel] = {}
        self.busy: list[str] = []
        self.loaded: dict[tuple, Rel] = {}
        self.warnings: list[Diagnostic] = []
        self.stdout: list[bytes] = []
        self.bindings = dict(self.program.bindings)
        self._declared()
        self.context = self._context(context or {})

    # Declarations

    def _declared(self) -> None:
        p, seen = self.program, set()
        for name, pipe in (*p.bindings, *p.outputs):
            if name in seen:
                fail("E1001", f"`{name}` is declared twice", pipe.span)
            seen.add(name)
        if p.outputs and p.main:
            fail("E1503", "outputs and a main pipeline can't stand together", p.main.span)
        names = set()
        for c in p.contexts:
            if (c.kind, c.name) in names:
                fail("E2001", f"`{c.name}` is declared twice", c.span)
            names.add((c.kind, c.name))
            if c.control:
                controls.check(c)
                source = c.control["fields"].get("choicesFrom")
                if source and source[0] not in self.bindings:
                    fail("E1007", f"unknown binding `{source[0]}`", c.span)
        for pipe in [*(x for _, x in p.bindings), *(x for _, x in p.outputs), *([p.main] if p.main else [])]:
            for n in self._references(pipe):
                if n not in self.bindings:
                    fail("E1007", f"unknown binding `{n}`", pipe.span)

    @staticmethod
    def _references(pipe: Pipeline) -> list[str]:
        return [*([pipe.start] if isinstance(pipe.start, str) else []), *(s.args["binding"] for s in pipe.stages if s.kind in JOINED)]

    def _context(self, given: dict) -> dict:
        sigil = {"param": "$", "state": "@"}
        out = {(sigil[c.kind], c.name): c.default for c in self.program.contexts}
        for name, v in given.items():
            found = [c for c in self.program.contexts if c.name == name]
            if not found:
                fail("E2002", f"unknown context value `{name}`")
            v = float(v) if isinstance(v, int) and not isinstance(v, bool) else v
            for c in found:
                if c.default is not None and v is not None and controls.kind_of(c.default) != controls.kind_of(v):
                    fail("E2005", f"`{name}` is a {controls.kind_of(c.default)}, not a {controls.kind_of(v)}", c.span)
                out[sigil[c.kind], c.name] = v
        return out

    # Evaluation

    def binding(self, name: str, span: Span) -> Rel:
        if name in self.busy:
            fail("E1501", f"binding `{name}` depends on itself", span)
        if name not in self.done:
            self.busy.append(name)
            self.done[name] = replace(self.pipeline(self.bindings[name]), groups=())
            self.busy.pop()
        return self.done[name]

    def load(self, s: Stage) -> Rel:
        source, clause = s.args["source"], s.args["format"]
        key = (source, clause)
        if key in self.loaded:
            return self.loaded[key]
        if source == "-":
            kind = named(clause, s.span) if clause else None
            given = named(self.stdin_format, s.span) if self.stdin_format else None
            if kind and given and kind != given:
                fail("E1217", f"the program says {kind}, the caller {given}", s.span)
            if self.stdin is None:
                fail("E1802", "no standard input is given", s.span)
            rel = readers.read_bytes(self.spark, self.stdin, kind or given, s.span)
        elif source in self.tables:
            rel = readers.typed(self.tables[source], [])
        else:
            path = readers.resolve(source, self.folder)
            rel = readers.read(self.spark, path, readers.format_of(path, clause, s.span), s.span)
        self.loaded[key] = rel
        return rel

    def pipeline(self, pipe: Pipeline) -> Rel:
        rel = self.load(pipe.start) if isinstance(pipe.start, Stage) else self.binding(pipe.start, pipe.span)
        for i, s in enumerate(pipe.stages):
            if s.kind == "save" and i + 1 < len(pipe.stages) and not self.dry_run:
                rel = replace(rel, df=rel.df.persist())  # what follows a sink doesn't run the plan before it again
            try:
                rel = self.stage(rel, s)
            except ProgramError as e:
                # The place of an error that a value's own tree doesn't know is its stage.
                raise ProgramError(*[replace(d, span=s.span) if d.span in (None, Span()) else d for d in e.diagnostics]) from None
            if s.kind == "group_by" and not any(t.kind == "agg" for t in pipe.stages[i + 1 :]):
                self.warnings.append(Diagnostic("W2001", "group_by without an agg after it has no effect", s.span))
        return rel

    def stage(self, rel: Rel, s: Stage) -> Rel:
        if s.kind in JOINED:
            return JOINED[s.kind](rel, self.binding(s.args["binding"], s.span), s, self.context)
        if s.kind == "save":
            self.save(rel, s)
            return rel
        if s.kind == "filter" and rel.groups:
            self.warnings.append(Diagnostic("W2001", "filter ends the grouping before it", s.span))
        return STAGES[s.kind](rel, s, self.context)

    def save(self, rel: Rel, s: Stage) -> None:
        sink, clause = s.args["sink"], s.args["format"]
        if sink == "-":
            kind = named(clause, s.span) if clause else named(self.stdout_format) if self.stdout_format else "csv"
        else:
            kind = named(clause, s.span) if clause else by_ending(sink) or "csv"
        writers.check(rel, kind, s.span)
        if self.dry_run:
            return
        if sink == "-":
            if len(self.program.outputs) > 1:
                fail("E1607", "several outputs can't share standard output", s.span)
            self.stdout.append(writers.to_bytes(rel, kind, s.span))
        else:
            writers.save(rel, sink, kind, s.span, self.sink_folders)

    def run(self) -> Result:
        out = Result()
        if self.program.main:
            out.table = self.pipeline(self.program.main)
        for name, pipe in self.program.outputs:
            out.outputs[name] = self.pipeline(pipe)
        if self.stdout_format and not self.dry_run:
            if len(out.outputs) > 1:
                fail("E1607", "several outputs can't share standard output")
            last = out.table or next(iter(out.outputs.values()), None)
            if last is not None and not self.stdout:
                self.stdout.append(writers.to_bytes(last, named(self.stdout_format)))
        out.stdout, out.warnings = b"".join(self.stdout), self.warnings
        return out

    # Reports

    def schema(self) -> dict:
        pipes = {"main": self.program.main} if self.program.main else dict(self.program.outputs)
        dry, self.dry_run = self.dry_run, True
        try:
            return {n: [{"name": c.name, "class": c.cls} for c in self.pipeline(p).cols] for n, p in pipes.items()}
        finally:
            self.dry_run = dry

    def explain(self) -> dict:
        """Steps of each pipeline with what each waits for, and Spark's own plan of the result."""
        dry, self.dry_run = self.dry_run, True
        out = {}
        pipes = {"main": self.program.main} if self.program.main else dict(self.program.outputs)
        for n, p in pipes.items():
            rel = self.pipeline(p)
            has_window = lambda s: s.kind == "mutate" and "Window(" in repr(s.args)
            steps = [{"stage": s.kind, "blocking": s.kind in BLOCKING or has_window(s)} for s in p.stages]
            head = {"stage": "load", "source": p.start.args["source"]} if isinstance(p.start, Stage) else {"stage": "binding", "name": p.start}
            plan = rel.frame()._jdf.queryExecution().toString()
            out[n] = {"steps": [head, *steps], "columns": rel.names, "ordered": len(rel.order), "spark": plan}
        self.dry_run = dry
        return out

    def manifest(self) -> dict:
        """Inputs and sinks of the whole program, without reading any."""
        p = self.program
        pipes = [x for _, x in (*p.bindings, *p.outputs)] + ([p.main] if p.main else [])
        return {
            "inputs": [x.start.args for x in pipes if isinstance(x.start, Stage)],
            "sinks": [s.args for x in pipes for s in x.stages if s.kind == "save"],
            "bindings": [n for n, _ in p.bindings], "outputs": [n for n, _ in p.outputs],
            "contexts": [{"kind": c.kind, "name": c.name, "default": c.default} for c in p.contexts],
        }

    def choices(self, c: Context) -> list:
        """Distinct values, as first seen, of the binding column a control takes its choices from."""
        binding, column = c.control["fields"]["choicesFrom"]
        rel = self.binding(binding, c.span)
        found = rel.find(column)
        if found is None:
            fail("E2012", f"`{binding}` has no column `{column}`", c.span)
        stage = Stage("distinct", {"columns": ()}, c.span)
        one = STAGES["distinct"](rel.keep([found]), stage, self.context)
        text = one.sorted().select(render(found.value).alias("v")).where("v is not null")
        out = []
        for r in text.toLocalIterator():
            v = controls.coerced(r["v"], controls.kind_of(c.default))
            if v not in out:
                out.append(v)
        return out

    def controls(self) -> list[dict]:
        out = []
        for c in self.program.contexts:
            if c.control:
                m = controls.metadata(c) | {"value": self.context["$", c.name]}
                if "choicesFrom" in c.control["fields"]:
                    m["choices"] = [*c.control["fields"].get("choices", []), *self.choices(c)]
                out.append(m)
        return out


def run(spark: SparkSession, source: str, **options) -> Result:
    """Run a program's text; options are those of Engine."""
    return Engine(spark, source, **options).run()


def run_file(spark: SparkSession, path: str, **options) -> Result:
    with open(path, encoding="utf-8") as f:
        return Engine(spark, f.read(), **{"folder": os.path.dirname(os.path.abspath(path))} | options).run()


def frame(spark: SparkSession, source: str, sf_dir: str | None = None, output: str | None = None, **options) -> DataFrame:
    """The rows of a program over the Parquet tables of a folder, in no order: no sort is paid for."""
    return run(spark, source, **({"folder": sf_dir} if sf_dir else {}), **options).frame(output)


