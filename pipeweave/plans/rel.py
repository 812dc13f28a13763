"""A relation: a DataFrame, its visible columns with their classes, and the order of its rows.

Spark's rows have no order, so order is part of the plan: hidden columns, each with a direction.
A sort puts copies of its keys in front of the order there was, which makes it stable and costs
nothing until a sink, a limit or a window asks for the order; order nobody asks for is pruned.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import Value, render

_count = itertools.count()


def fresh(prefix: str = "c") -> str:
    """A physical column name used nowhere else."""
    return f"{prefix}{next(_count)}"


@dataclass(frozen=True)
class Col:
    name: str
    phys: str
    cls: str
    integral: bool = False
    kind: str = ""

    @property
    def value(self) -> Value:
        return Value(F.col(self.phys), self.cls, self.integral, self.kind)


@dataclass(frozen=True)
class Order:
    phys: str
    desc: bool = False
    nulls_first: bool = False

    @property
    def key(self) -> Column:
        c = F.col(self.phys)
        if self.desc:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()


@dataclass(frozen=True)
class Rel:
    df: DataFrame
    cols: tuple[Col, ...]
    order: tuple[Order, ...] = ()
    groups: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.cols]

    def find(self, name: str) -> Col | None:
        return next((c for c in self.cols if c.name == name), None)

    def with_cols(self, cols: list[tuple[str, Value]], groups: tuple[str, ...] = ()) -> Rel:
        """Columns computed from this relation's; the hidden order columns go along."""
        made = [Col(n, fresh(), v.cls, v.integral, v.kind) for n, v in cols]
        df = self.df.select(*[v.col.alias(c.phys) for c, (_, v) in zip(made, cols)], *[o.phys for o in self.order])
        return Rel(df, tuple(made), self.order, groups)

    def keep(self, cols: list[Col]) -> Rel:
        """Some of the columns, without computing anything."""
        return replace(self, df=self.df.select(*[c.phys for c in cols], *[o.phys for o in self.order]), cols=tuple(cols), groups=())

    def keys(self) -> list[Column]:
        return [o.key for o in self.order]

    def sorted(self) -> DataFrame:
        return self.df.orderBy(*self.keys()) if self.order else self.df

    def frame(self, ordered: bool = False) -> DataFrame:
        """The visible columns under their own names; mixed columns as text."""
        df = self.sorted() if ordered else self.df
        return df.select(*[(render(c.value) if c.cls == "mixed" else F.col(c.phys)).alias(c.name) for c in self.cols])
