"""Sort keys: the language's null placement, and order by class."""

from __future__ import annotations

from pyspark.sql import Column

from ..functions.scalar import Scope
from ..functions.values import Value, as_text, order_key
from ..lang.ast import SortItem
from ..lang.diagnostics import fail


def nulls_first(item: SortItem) -> bool:
    """Nulls come last, unless `asc nulls_first` or, as `desc` turns the whole order round, `desc nulls_last` is said."""
    return item.nulls == ("last" if item.desc else "first")


def sort_value(scope: Scope, item: SortItem):
    v = as_text(scope.get(scope.column(item.column), item.column.span))
    if v.cls == "geom":
        fail("E1234", "a geometry has no order", item.column.span)
    return Value(order_key(v), v.cls, v.integral)


def sort_key(scope: Scope, item: SortItem) -> Column:
    c, first = sort_value(scope, item).col, nulls_first(item)
    if item.desc:
        return c.desc_nulls_first() if first else c.desc_nulls_last()
    return c.asc_nulls_first() if first else c.asc_nulls_last()
