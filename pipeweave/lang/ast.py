"""Syntax trees. Spans take no part in equality."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from .diagnostics import Span


def _span():
    return field(default=Span(), compare=False, repr=False)


@dataclass(frozen=True)
class Lit:
    value: Any  # str, float, bool or None
    span: Span = _span()


@dataclass(frozen=True)
class Name:
    """A column, or with sigil `$` or `@` a context value."""

    name: str
    sigil: str = ""
    span: Span = _span()


@dataclass(frozen=True)
class Unary:
    op: str
    arg: Any
    span: Span = _span()


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any
    span: Span = _span()


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    span: Span = _span()


@dataclass(frozen=True)
class SortItem:
    column: Name
    desc: bool = False
    nulls: str | None = None  # first, last or unsaid


@dataclass(frozen=True)
class Window:
    call: Call
    partition: tuple[Name, ...] = ()
    order: tuple[SortItem, ...] = ()
    frame: tuple[str, int | None] | None = None
    span: Span = _span()


@dataclass(frozen=True)
class Stage:
    """kind and its own fields, by name."""

    kind: str
    args: dict
    span: Span = _span()


@dataclass(frozen=True)
class Pipeline:
    start: Any  # Stage("load") or the name of a binding
    stages: tuple[Stage, ...]
    span: Span = _span()


@dataclass(frozen=True)
class Context:
    kind: str  # param or state
    name: str
    default: Any
    control: dict | None = None
    span: Span = _span()


@dataclass(frozen=True)
class Program:
    contexts: tuple[Context, ...] = ()
    bindings: tuple[tuple[str, Pipeline], ...] = ()
    outputs: tuple[tuple[str, Pipeline], ...] = ()
    main: Pipeline | None = None


def to_json(node: Any) -> Any:
    """A tree as plain values, for `ast` output."""
    if isinstance(node, Span):
        return [node.start, node.end]
    if hasattr(node, "__dataclass_fields__"):
        return {"node": type(node).__name__} | {k: to_json(getattr(node, k)) for k in node.__dataclass_fields__}
    if isinstance(node, (list, tuple)):
        return [to_json(x) for x in node]
    if isinstance(node, dict):
        return {k: to_json(v) for k, v in node.items()}
    return node
