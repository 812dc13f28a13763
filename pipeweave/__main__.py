"""python -m pipeweave COMMAND FILE: run, check, schema, plan, controls, fmt, ast, manifest, version."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .lang.ast import to_json
from .lang.diagnostics import ProgramError
from .lang.format import format_source
from .lang.parser import parse

VERSION = "0.1"


def context_value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pipeweave", description=__doc__)
    p.add_argument("command", choices=["run", "check", "schema", "plan", "controls", "fmt", "ast", "ir", "manifest", "version"])
    p.add_argument("file", nargs="?")
    p.add_argument("--context", action="append", default=[], metavar="NAME=VALUE")
    p.add_argument("--stdin-format")
    p.add_argument("--stdout-format")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--sink-folders", action="store_true", help="write sinks as folders of parts, by executors")
    p.add_argument("--write", action="store_true", help="fmt: change the file")
    a = p.parse_args(argv)
    if a.command == "version":
        print(VERSION)
        return 0
    if not a.file:
        p.error("a program file is needed")
    with open(a.file, encoding="utf-8") as f:
        source = f.read()
    try:
        if a.command == "fmt":
            text = format_source(source)
            if a.write:
                with open(a.file, "w", encoding="utf-8") as f:
                    f.write(text)
            else:
                sys.stdout.write(text)
            return 0
        if a.command in ("ast", "ir"):
            print(json.dumps(to_json(parse(source)), indent=2))
            return 0
        return _with_spark(a, source)
    except ProgramError as e:
        for d in e.diagnostics:
            print(d.render(source, a.file), file=sys.stderr)
        return 1


def _with_spark(a: argparse.Namespace, source: str) -> int:
    from .session import Engine

    given = dict(x.split("=", 1) for x in a.context)
    needs = "stdin" in source or "load -" in source
    options = dict(
        folder=os.path.dirname(os.path.abspath(a.file)), context={k: context_value(v) for k, v in given.items()},
        stdin=sys.stdin.buffer.read() if needs and a.command != "manifest" else None, stdin_format=a.stdin_format,
        stdout_format=a.stdout_format, dry_run=a.dry_run or a.command != "run", sink_folders=a.sink_folders,
    )
    if a.command == "manifest":
        print(json.dumps(Engine(None, source, **options).manifest(), indent=2))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("pipeweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, source, **options)
    if a.command == "schema":
        print(json.dumps(engine.schema(), indent=2))
    elif a.command == "plan":
        print(json.dumps(engine.explain(), indent=2))
    elif a.command == "controls":
        print(json.dumps(engine.controls(), indent=2))
    else:
        result = engine.run()
        for w in result.warnings:
            print(w.render(source, a.file), file=sys.stderr)
        if a.command == "run":
            out = result.stdout
            if not out and result.table is not None and not a.dry_run and not (engine.program.main.stages and engine.program.main.stages[-1].kind == "save"):
                from .sources.writers import to_bytes

                out = to_bytes(result.table, "csv")
            sys.stdout.buffer.write(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
