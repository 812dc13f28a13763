"""Expressions lowered to Spark columns, with classes checked when the plan is built."""

from __future__ import annotations

import datetime
import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.ast import Binary, Call, Lit, Name, Unary, Window
from ..lang.diagnostics import fail
from . import temporal
from .values import Value, as_text, boolean, literal, null, number, order_key, parse_number, render, unify

_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
#: Scalar functions and how many arguments they take (fixed by the language).
SCALARS: dict[str, tuple[int, int | None]] = {
    "is_null": (1, 1), "not_null": (1, 1), "coalesce": (1, None), "concat": (1, None), "lower": (1, 1), "upper": (1, 1),
    "trim": (1, 1), "contains": (2, 2), "starts_with": (2, 2), "replace": (3, 3), "to_string": (1, 1), "to_number": (1, 1),
    "to_boolean": (1, 1), "abs": (1, 1), "round": (1, 2), "if_else": (3, 3), "date": (1, 1), "datetime": (1, 1),
    "year": (1, 1), "month": (1, 1), "day": (1, 1), "date_floor": (2, 2), "date_format": (2, 2), "col": (1, 1),
}
AGGREGATES: dict[str, tuple[int, int]] = {
    "count": (0, 1), "sum": (1, 1), "mean": (1, 1), "min": (1, 1), "max": (1, 1), "count_distinct": (1, 1),
}


def arity(call: Call, table: dict) -> None:
    if call.name not in table:
        fail("E1401", f"unknown function `{call.name}`", call.span)
    least, most = table[call.name]
    if len(call.args) < least or most is not None and len(call.args) > most:
        fail("E1402", f"`{call.name}` takes {least if least == most else f'{least} or more' if most is None else f'{least} to {most}'} arguments", call.span)


class Scope:
    """What names mean in an expression: columns of a relation, context values, windows if allowed."""

    def __init__(self, rel, context: dict, window: Callable[[Window], Value] | None = None):
        self.rel, self.context, self.window = rel, context, window

    def column(self, name: Name) -> str:
        """The column that stands in a column position, a context value standing for its text."""
        if not name.sigil:
            return name.name
        v = self.context_value(name)
        if not isinstance(v, str):
            fail("E2004", f"`{name.sigil}{name.name}` isn't the name of a column", name.span)
        return v

    def context_value(self, name: Name):
        if (name.sigil, name.name) not in self.context:
            fail("E2002", f"unknown context value `{name.sigil}{name.name}`", name.span)
        return self.context[name.sigil, name.name]

    def get(self, name: str, span) -> Value:
        c = self.rel.find(name)
        if c is None:
            fail("E1005", f"unknown column `{name}`", span)
        return c.value

    # Lowering

    def lower(self, e) -> Value:
        if isinstance(e, Lit):
            return literal(e.value)
        if isinstance(e, Name):
            return literal(self.context_value(e)) if e.sigil else self.get(e.name, e.span)
        if isinstance(e, Unary):
            return self.unary(e)
        if isinstance(e, Binary):
            return self.logic(e) if e.op in ("and", "or") else self.compare(e) if e.op in ("==", "!=", "<", "<=", ">", ">=") else self.arithmetic(e)
        if isinstance(e, Window):
            if self.window is None:
                fail("E1226", "a window stands only in mutate, and not in another window", e.span)
            return self.window(e)
        if isinstance(e, Call):
            if e.name in AGGREGATES and e.name not in SCALARS:
                fail("E1213", f"`{e.name}` stands only in agg or over a window", e.span)
            arity(e, SCALARS)
            return getattr(self, f"fn_{e.name}")(e)
        raise TypeError(type(e))

    def scalar(self, e) -> Value:
        v = as_text(self.lower(e))
        if v.cls == "geom":
            fail("E1234", "a geometry isn't a scalar", getattr(e, "span", None))
        if v.cls == "other":
            fail("E1808", "a value of this type can only be carried", getattr(e, "span", None))
        return v

    def num(self, e) -> Column:
        v = self.scalar(e)
        if v.cls in ("str", "bool"):
            fail("E1302", "expected a number", getattr(e, "span", None))
        if v.cls == "mixed":
            wrong = v.col["t"] != 2
            return F.when(wrong, F.raise_error(F.lit("E1302: expected a number")).cast("double")).otherwise(v.col["n"])
        return number(v)

    def truth(self, e) -> Column:
        v = self.scalar(e)
        if v.cls in ("str", "num"):
            fail("E1302", "expected a boolean", getattr(e, "span", None))
        return boolean(v)

    def unary(self, e: Unary) -> Value:
        return Value(-self.num(e.arg), "num") if e.op == "-" else Value(~self.truth(e.arg), "bool")

    def logic(self, e: Binary) -> Value:
        a, b = self.truth(e.left), self.truth(e.right)
        return Value(a & b if e.op == "and" else a | b, "bool")

    def arithmetic(self, e: Binary) -> Value:
        a, b = self.num(e.left), self.num(e.right)
        if e.op in "+-*":
            return Value({"+": a + b, "-": a - b, "*": a * b}[e.op], "num")
        zero = b == 0
        if e.op == "%":
            return Value(F.when(~zero, a % b).when(a.isNotNull() & zero, F.lit(float("nan"))), "num")
        by_zero = F.when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))
        return Value(F.when(~zero, a / b).when(zero, by_zero), "num")

    def compare(self, e: Binary) -> Value:
        if (typed := self.compare_time(e)) is not None:
            return Value(typed, "bool")
        a, b = self.scalar(e.left), self.scalar(e.right)
        for one, other in ((e.left, b), (e.right, a)):
            if isinstance(one, Lit) and one.value is None and e.op in ("==", "!="):
                return Value(other.col.isNull() if e.op == "==" else other.col.isNotNull(), "bool")
        if "null" in (a.cls, b.cls):
            return Value(F.lit(None).cast("boolean"), "bool")
        pair = {a.cls, b.cls}
        if pair == {"num"}:
            # A whole number beside a whole-number column stays whole, so the filter reaches the scan.
            a, b = (_whole(e.left, a, b), _whole(e.right, b, a))
            x, y = (a.col, b.col) if a.integral and b.integral else (number(a), number(b))
        elif pair == {"num", "str"}:
            x, y = (number(v) if v.cls == "num" else parse_number(v.col) for v in (a, b))
        elif pair == {"bool"} or pair == {"str"}:
            x, y = a.col, b.col
        elif "mixed" in pair:
            return Value(self.compare_mixed(e.op, a, b), "bool")
        else:
            x, y = render(a), render(b)
        return Value(_compared(e.op, x, y), "bool")

    def compare_time(self, e: Binary) -> Column | None:
        """A typed time beside the text of a date or second, compared as a time so that it reaches the scan; None for other operands.

        It agrees with the order of texts: a date alone comes before all times of its day, and a
        fraction of a second, as `.` comes before `Z`, before its whole second.
        """
        flipped = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}
        for one, other, op in ((e.left, e.right, e.op), (e.right, e.left, flipped[e.op])):
            v = self.get(one.name, one.span) if isinstance(one, Name) and not one.sigil else None
            text = other.value if isinstance(other, Lit) else self.context_value(other) if isinstance(other, Name) and other.sigil else None
            if v is None or v.cls != "time" or not v.kind or not isinstance(text, str):
                continue
            m = re.fullmatch(r"(\d{4}-\d{2}-\d{2})(?:T(\d{2}:\d{2}:\d{2})Z)?", text, re.ASCII)
            try:
                at = datetime.datetime.fromisoformat(f"{m[1]} {m[2] or '00:00:00'}") if m else None
                after = at + datetime.timedelta(seconds=1) if at else None
            except (ValueError, OverflowError):
                at = None
            if at is None or at.year == 0:
                continue
            if v.kind == "date":
                if m[2]:
                    continue
                return _compared(op, v.col, F.lit(at.date()))
            kind = "TIMESTAMP_NTZ" if v.kind == "timestamp_ntz" else "TIMESTAMP"
            first, second = (F.expr(f"{kind}'{t:%Y-%m-%d %H:%M:%S}'".replace(f"{t:%Y}", f"{t.year:04d}", 1)) for t in (at, after))
            if not m[2]:
                if op in ("==", "!="):
                    return F.when(v.col.isNotNull(), op == "!=")
                return v.col >= first if op in (">", ">=") else v.col < first
            return {
                "==": v.col == first, "!=": v.col != first, "<": (v.col < second) & (v.col != first), "<=": v.col < second,
                ">": v.col >= second, ">=": (v.col >= second) | (v.col == first),
            }[op]
        return None

    def compare_mixed(self, op: str, a: Value, b: Value) -> Column:
        is_num = lambda v: v.col["t"] == 2 if v.cls == "mixed" else F.lit(v.cls == "num")
        is_str = lambda v: v.col["t"] == 3 if v.cls == "mixed" else F.lit(v.cls == "str")
        as_num = lambda v: F.coalesce(number(v), parse_number(render(v)))
        by_number = (is_num(a) & (is_num(b) | is_str(b))) | (is_str(a) & is_num(b))
        return F.when(by_number, _compared(op, as_num(a), as_num(b))).otherwise(_compared(op, render(a), render(b)))

    # Functions

    def moment(self, e) -> temporal.Moment:
        v = self.lower(e)
        return temporal.moment_of(v.col, v.kind) if v.cls == "time" and v.kind else temporal.moment(self.text(e))

    def text(self, e) -> Column:
        return render(self.scalar(e))

    def fn_is_null(self, e):
        return Value(self.lower(e.args[0]).col.isNull(), "bool")

    def fn_not_null(self, e):
        return Value(self.lower(e.args[0]).col.isNotNull(), "bool")

    def fn_coalesce(self, e):
        cols, cls, integral = unify([self.lower(a) for a in e.args])
        return Value(F.coalesce(*cols), cls, integral)

    def fn_concat(self, e):
        return Value(F.concat_ws("", *[self.text(a) for a in e.args]), "str")

    def fn_lower(self, e):
        return Value(F.lower(self.text(e.args[0])), "str")

    def fn_upper(self, e):
        return Value(F.upper(self.text(e.args[0])), "str")

    def fn_trim(self, e):
        return Value(F.regexp_replace(self.text(e.args[0]), _SPACE, ""), "str")

    def fn_contains(self, e):
        return Value(F.contains(self.text(e.args[0]), self.text(e.args[1])), "bool")

    def fn_starts_with(self, e):
        return Value(F.startswith(self.text(e.args[0]), self.text(e.args[1])), "bool")

    def fn_replace(self, e):
        v, p, r = (self.text(a) for a in e.args)
        between = F.concat(r, F.array_join(F.transform(F.split(v, ""), lambda c: F.concat(c, r)), ""))
        between = F.when(v == "", r).otherwise(between)
        return Value(F.when(p == "", between).otherwise(F.replace(v, p, r)), "str")

    def fn_to_string(self, e):
        return Value(self.text(e.args[0]), "str")

    def fn_to_number(self, e):
        v = self.scalar(e.args[0])
        if v.cls == "num":
            return v
        parsed = parse_number(F.regexp_replace(render(v), _SPACE, ""))
        return Value(F.coalesce(v.col["n"], parsed) if v.cls == "mixed" else parsed, "num")

    def fn_to_boolean(self, e):
        v = self.scalar(e.args[0])
        if v.cls == "bool":
            return v
        t = F.regexp_replace(render(v), _SPACE, "")
        return Value(F.when(t == "true", True).when(t == "false", False), "bool")

    def fn_abs(self, e):
        return Value(F.abs(self.num(e.args[0])), "num")

    def fn_round(self, e):
        digits = 0
        if len(e.args) == 2:
            d = e.args[1]
            if not isinstance(d, Lit) or isinstance(d.value, bool) or not isinstance(d.value, float) or d.value != int(d.value) or not 0 <= d.value <= 12:
                fail("E1206", "digits are a whole number from 0 to 12", getattr(d, "span", e.span))
            digits = int(d.value)
        x, scale = self.num(e.args[0]), float(10**digits)
        y = x * scale
        # Half away from zero, on the binary value; numbers of 2^52 and more are whole already.
        near = F.when(F.abs(y) < 2.0**52, F.signum(y) * F.floor(F.abs(y)) + F.when(F.abs(y) - F.floor(F.abs(y)) >= 0.5, F.signum(y)).otherwise(0.0)).otherwise(y)
        out = near / scale
        return Value(F.when(out == 0, 0.0).otherwise(out), "num")

    def fn_if_else(self, e):
        cond = self.truth(e.args[0])
        (t, f), cls, integral = unify([self.lower(a) for a in e.args[1:]])
        return Value(F.when(cond, t).when(~cond, f), cls, integral)

    def fn_date(self, e):
        return Value(temporal.date(self.moment(e.args[0])), "str")

    def fn_datetime(self, e):
        return Value(temporal.datetime(self.moment(e.args[0])), "str")

    def fn_year(self, e):
        return Value(temporal.year(self.moment(e.args[0])), "num")

    def fn_month(self, e):
        return Value(temporal.month(self.moment(e.args[0])), "num")

    def fn_day(self, e):
        return Value(temporal.day(self.moment(e.args[0])), "num")

    def fixed_text(self, e) -> str | None:
        """The value of a literal or context argument, None for one that depends on the row."""
        v = e.value if isinstance(e, Lit) else self.context_value(e) if isinstance(e, Name) and e.sigil else None
        if v is not None and not isinstance(v, str):
            fail("E1403", "expected a string", e.span)
        return v

    def fn_date_floor(self, e):
        m, unit = self.moment(e.args[0]), self.fixed_text(e.args[1])
        if unit is not None:
            if unit not in temporal.UNITS:
                fail("E1406", f"unknown unit `{unit}`", e.span)
            return Value(temporal.date_floor(m, unit), "str")
        u = self.scalar(e.args[1])
        if u.cls not in ("str", "null"):
            fail("E1403", "expected a string", e.span)
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for name in temporal.UNITS:
            out = out.when(u.col == name, temporal.date_floor(m, name))
        wrong = F.raise_error(F.concat(F.lit("E1406: unknown unit "), u.col)).cast("string")
        return Value(out.when(u.col.isNotNull(), wrong), "str")

    def fn_date_format(self, e):
        m, pattern = self.moment(e.args[0]), self.fixed_text(e.args[1])
        if pattern is None:
            if isinstance(e.args[1], Lit):
                return null()
            fail("E1403", "a pattern is a literal or a context value", e.span)
        pieces = temporal.split_pattern(pattern)
        if pieces is None:
            fail("E1406", f"unsupported pattern `{pattern}`", e.span)
        return Value(temporal.date_format(m, pieces), "str")

    def fn_col(self, e):
        arg = e.args[0]
        if isinstance(arg, Lit) or isinstance(arg, Name) and arg.sigil:
            v = arg.value if isinstance(arg, Lit) else self.context_value(arg)
            if not isinstance(v, str):
                fail("E2004", "col() needs the name of a column", e.span)
            return self.get(v, e.span)
        key = self.scalar(arg)
        if key.cls not in ("str", "null"):
            fail("E2004", "col() needs the name of a column", e.span)
        values = [c.value for c in self.rel.cols if c.cls not in ("geom", "other")]
        cols, cls, integral = unify(values)
        out = F.when(F.lit(False), cols[0])
        for name, c in zip([c.name for c in self.rel.cols if c.cls not in ("geom", "other")], cols):
            out = out.when(key.col == name, c)
        wrong = F.raise_error(F.concat(F.lit("E1005: unknown column "), F.coalesce(key.col, F.lit("null"))))
        return Value(out.otherwise(F.when(F.isnotnull(wrong), cols[0])), cls, integral)


def _whole(tree, v: Value, other: Value) -> Value:
    fits = isinstance(tree, Lit) and other.integral and math.isfinite(tree.value) and tree.value == int(tree.value) and abs(tree.value) < 2**53
    return Value(F.lit(int(tree.value)).cast("bigint"), "num", True) if fits else v


def _compared(op: str, x: Column, y: Column) -> Column:
    return {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def aggregate(call: Call, scope: Scope) -> Value:
    """An aggregate call over the rows of a group."""
    arity(call, AGGREGATES)
    for a in call.args:
        if isinstance(a, Call) and a.name in AGGREGATES and a.name not in SCALARS:
            fail("E1213", "aggregates don't nest", a.span)
    if call.name == "count" and not call.args:
        return Value(F.count(F.lit(1)), "num", True)
    v = scope.lower(call.args[0])
    if v.cls == "geom" and call.name not in ("count",):
        fail("E1234", "a geometry isn't a scalar", call.span)
    if call.name == "count":
        return Value(F.count(v.col), "num", True)
    v = as_text(v)
    if call.name == "count_distinct":
        return Value(F.count_distinct(v.col if v.cls in ("num", "str", "bool") else render(v)), "num", True)
    if call.name in ("sum", "mean"):
        f = F.sum if call.name == "sum" else F.avg
        return Value(f(number(v)), "num")
    if v.cls == "mixed":
        return Value((F.min_by if call.name == "min" else F.max_by)(v.col, order_key(v)), v.cls)
    f = F.min if call.name == "min" else F.max
    return Value(f(v.col), v.cls, v.integral)
