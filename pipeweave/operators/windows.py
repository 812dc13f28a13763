"""Window expressions: ranking, offsets, frame values and frame aggregates."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import AGGREGATES, Scope, aggregate, arity
from ..functions.values import Value, as_text, unify
from ..lang.ast import Call, Lit, Window
from ..lang.diagnostics import fail
from ..plans.rel import Rel, fresh
from .ordering import sort_key

WINDOWED: dict[str, tuple[int, int]] = {
    "row_number": (0, 0), "rank": (0, 0), "dense_rank": (0, 0), "percent_rank": (0, 0), "cume_dist": (0, 0),
    "lag": (1, 3), "lead": (1, 3), "first_value": (1, 1), "last_value": (1, 1),
    **{k: v for k, v in AGGREGATES.items() if k != "count_distinct"},
}
_RANKS = {"rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist}


class Windows:
    """Lowers the windows of one mutate. Windows of one specification share one WindowExec in Spark."""

    def __init__(self, rel: Rel, context: dict):
        self.rel, self.context = rel, context
        self.scope = Scope(rel, context)
        self.df = rel.df  # with the columns that row-dependent offsets add

    def __call__(self, e: Window) -> Value:
        arity(e.call, WINDOWED)
        name = e.call.name
        keys = [sort_key(self.scope, s) for s in e.order]
        parts = []
        for p in e.partition:
            v = as_text(self.scope.get(self.scope.column(p), p.span))
            if v.cls == "geom":
                fail("E1234", "a geometry isn't a scalar", p.span)
            parts.append(v.col)
        # Without partition_by all rows are one partition: it is what the program asks for.
        of = W.partitionBy(*parts)
        if name in _RANKS:
            if not keys:
                fail("E1203", f"`{name}` needs order_by", e.span)
            out = _RANKS[name]().over(of.orderBy(*keys))
            return Value(out.cast("bigint") if name in ("rank", "dense_rank") else out, "num", name in ("rank", "dense_rank"))
        rows = [*keys, *self.rel.keys()] or [F.lit(0)]
        full = of.orderBy(*rows)
        if name == "row_number":
            return Value(F.row_number().over(full).cast("bigint"), "num", True)
        if name in ("lag", "lead"):
            return self.offset(e.call, parts, full)
        frame = self.frame(e, of, full)
        if name in ("first_value", "last_value"):
            v = self.scope.lower(e.call.args[0])
            f = F.first if name == "first_value" else F.last
            return Value(f(v.col).over(frame), v.cls, v.integral)
        v = aggregate(e.call, self.scope)
        return Value(v.col.over(frame), v.cls, v.integral)

    def frame(self, e: Window, of: WindowSpec, full: WindowSpec) -> WindowSpec:
        kind, n = e.frame or ("whole_partition", None)
        if kind == "whole_partition" and e.call.name not in ("first_value", "last_value"):
            return of  # the whole partition in any order: no sort
        before, after = W.unboundedPreceding, W.unboundedFollowing
        bounds = {
            "whole_partition": (before, after), "running": (before, 0), "remaining": (0, after),
            "trailing": (-(n or 0), 0), "leading": (0, n or 0), "centered": (-(n or 0), n or 0),
        }
        return full.rowsBetween(*bounds[kind])

    def offset(self, call: Call, parts: list[Column], full: WindowSpec) -> Value:
        v = self.scope.lower(call.args[0])
        by = call.args[1] if len(call.args) > 1 else Lit(1.0)
        default = self.scope.lower(call.args[2]) if len(call.args) > 2 else None
        sign = -1 if call.name == "lag" else 1
        values = [v] if default is None else [v, default]
        cols, cls, integral = unify(values)
        boxed = F.struct(cols[0].alias("v"))  # tells a null inside the partition from no row
        if isinstance(by, Lit):
            if isinstance(by.value, bool) or not isinstance(by.value, float) or by.value != int(by.value) or by.value < 0:
                fail("E1206", "an offset is a whole number from 0", call.span)
            n = int(by.value)
            got = (F.lag if sign < 0 else F.lead)(boxed, n).over(full)
        else:
            n = self.scope.num(by)
            wrong = F.raise_error(F.lit("E1206: an offset is a whole number from 0")).cast("double")
            n = F.when(n.isNull() | (n < 0) | (n != F.floor(n)), wrong).otherwise(n).cast("bigint")
            got = self.row_at(parts, F.row_number().over(full), sign * n, boxed)
        missing = cols[1] if default is not None else F.lit(None).cast("void") if cls == "null" else None
        out = F.when(got.isNotNull(), got["v"])
        return Value(out.otherwise(missing) if default is not None else out, cls, integral)

    def row_at(self, parts: list[Column], number: Column, step: Column, boxed: Column) -> Column:
        """boxed of the row `step` rows on in its partition, null where there is none.

        Rows meet by partition and number in a join, so the rows of a large partition are dealt out.
        """
        at, there, got = fresh("n"), fresh("n"), fresh("g")
        mine, theirs = [fresh("p") for _ in parts], [fresh("p") for _ in parts]
        left = self.df.select("*", *[p.alias(k) for p, k in zip(parts, mine)], (number + step).alias(at))
        right = self.rel.df.select(*[p.alias(k) for p, k in zip(parts, theirs)], number.cast("bigint").alias(there), boxed.alias(got))
        on = F.col(at) == F.col(there)
        for a, b in zip(mine, theirs):
            on = on & F.col(a).eqNullSafe(F.col(b))
        self.df = left.join(right, on, "left").drop(*mine, *theirs, at, there)
        return F.col(got)
