"""Each stage of a pipeline, from relation to relation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import Scope, aggregate
from ..functions.values import Value, as_text, number, render, unify
from ..lang.ast import Stage
from ..lang.diagnostics import fail
from ..plans.rel import Col, Order, Rel, fresh
from .ordering import nulls_first, sort_value
from .windows import Windows


def columns(rel: Rel, scope: Scope, names) -> list[Col]:
    out = []
    for n in names:
        c = rel.find(scope.column(n))
        if c is None:
            fail("E1005", f"unknown column `{scope.column(n)}`", n.span)
        out.append(c)
    return out


def _unique(names: list[str], span, code: str = "E1207") -> None:
    seen = set()
    for n in names:
        if n in seen:
            fail(code, f"column `{n}` occurs twice", span)
        seen.add(n)


def filter_(rel: Rel, s: Stage, context: dict) -> Rel:
    v = Scope(rel, context).scalar(s.args["predicate"])
    # A predicate that can't be true keeps nothing; null keeps nothing either.
    keep = v.col if v.cls == "bool" else F.coalesce(v.col["b"], F.lit(False)) if v.cls == "mixed" else F.lit(False)
    return replace(rel, df=rel.df.filter(keep), groups=())


def select(rel: Rel, s: Stage, context: dict) -> Rel:
    scope = Scope(rel, context)
    cols = columns(rel, scope, [c for _, c in s.args["items"]])
    names = [n or c.name for (n, _), c in zip(s.args["items"], cols)]
    _unique(names, s.span)
    if len({c.phys for c in cols}) < len(cols):  # one column under two names
        return rel.with_cols([(n, c.value) for n, c in zip(names, cols)])
    return rel.keep([replace(c, name=n) for n, c in zip(names, cols)])


def drop(rel: Rel, s: Stage, context: dict) -> Rel:
    gone = {c.phys for c in columns(rel, Scope(rel, context), s.args["columns"])}
    return rel.keep([c for c in rel.cols if c.phys not in gone])


def rename(rel: Rel, s: Stage, context: dict) -> Rel:
    old = columns(rel, Scope(rel, context), [c for _, c in s.args["items"]])
    new = {c.phys: n.name for (n, _), c in zip(s.args["items"], old)}
    cols = [replace(c, name=new.get(c.phys, c.name)) for c in rel.cols]
    _unique([c.name for c in cols], s.span)
    return replace(rel, cols=tuple(cols), groups=())


def mutate(rel: Rel, s: Stage, context: dict) -> Rel:
    windows = Windows(rel, context)
    scope = Scope(rel, context, windows)
    made = {}
    for n, e in s.args["items"]:
        if n.name in made:
            fail("E1205", f"`{n.name}` is assigned twice", n.span)
        made[n.name] = scope.lower(e)
    cols = [(c.name, made.pop(c.name, c.value)) for c in rel.cols]
    return replace(rel, df=windows.df).with_cols(cols + list(made.items()))


def group_by(rel: Rel, s: Stage, context: dict) -> Rel:
    cols = columns(rel, Scope(rel, context), s.args["columns"])
    for c in cols:
        if c.cls == "geom":
            fail("E1234", "a geometry isn't a scalar", s.span)
    return replace(rel, groups=tuple(c.name for c in cols))


def agg(rel: Rel, s: Stage, context: dict) -> Rel:
    """Group keys become text and order the result, nulls last."""
    scope = Scope(rel, context)
    keys = [rel.find(g) for g in rel.groups]
    names = [k.name for k in keys] + [n.name for n, _ in s.args["items"]]
    _unique(names, s.span)
    values = [aggregate(c, scope) for _, c in s.args["items"]]
    cols = [Col(k.name, fresh(), "str") for k in keys] + [Col(n.name, fresh(), v.cls, v.integral) for (n, _), v in zip(s.args["items"], values)]
    # Grouped by the value where equal values have equal text, so keys stay as narrow as they are.
    plain = [k.value.col if k.cls in ("str", "bool") or k.integral else render(k.value) for k in keys]
    by = [c.alias(fresh("k")) for c in plain]
    aggs = [v.col.alias(c.phys) for v, c in zip(values, cols[len(keys) :])]
    if not keys:
        return Rel(rel.df.agg(*aggs), tuple(cols))
    df = rel.df.groupBy(*by).agg(*aggs)
    named = df.columns[: len(keys)]
    df = df.select(
        *[(F.col(n).cast("string")).alias(c.phys) for n, c in zip(named, cols)], *[c.phys for c in cols[len(keys) :]]
    )
    return Rel(df, tuple(cols), tuple(Order(c.phys) for c in cols[: len(keys)]))


def sort(rel: Rel, s: Stage, context: dict) -> Rel:
    scope = Scope(rel, context)
    keys = [(sort_value(scope, i), Order(fresh("o"), i.desc, nulls_first(i))) for i in s.args["items"]]
    df = rel.df.select("*", *[v.col.alias(o.phys) for v, o in keys])
    return replace(rel, df=df, order=(*[o for _, o in keys], *rel.order))


def limit(rel: Rel, s: Stage, context: dict) -> Rel:
    # orderBy and limit become one TakeOrderedAndProject.
    return replace(rel, df=rel.sorted().limit(s.args["n"]))


def _join_key(a: Col, b: Col, span):
    """Equality of cells by their text; null equals nothing."""
    for c in (a, b):
        if c.cls == "geom":
            fail("E1233", f"geometry `{c.name}` can't be a join key", span)
    x, y = as_text(a.value), as_text(b.value)
    if "null" not in (x.cls, y.cls) and x.cls != y.cls:
        fail("E1208", f"keys `{a.name}` and `{b.name}` are of different classes", span)
    if x.cls == y.cls == "num":
        return (x.col == y.col) if a.integral and b.integral else (number(x) == number(y))
    if x.cls == y.cls and x.cls in ("str", "bool"):
        return x.col == y.col
    return render(x) == render(y)


def join(rel: Rel, right: Rel, s: Stage, context: dict) -> Rel:
    how = s.args["how"]
    right = _fresh_names(right)
    left_scope, right_scope = Scope(rel, context), Scope(right, context)
    pairs = [
        (columns(rel, left_scope, [a])[0], columns(right, right_scope, [b])[0]) for a, b in s.args["keys"]
    ]
    on = None
    for a, b in pairs:
        one = _join_key(a, b, s.span)
        on = one if on is None else on & one
    if how in ("semi", "anti"):
        return replace(rel, df=rel.df.join(right.df, on, f"left_{how}"), groups=())
    taken = {b.phys for _, b in pairs}
    extra = [c for c in right.cols if c.phys not in taken]
    names = rel.names
    renamed = []
    for c in extra:
        n = c.name if c.name not in names else f"{c.name}_right"
        if n in names:
            fail("E1207", f"column `{n}` occurs twice after the join", s.span)
        names.append(n)
        renamed.append(replace(c, name=n))
    left, other = rel.df, right.df
    if how == "full":
        mark = fresh("m")
        left = left.select("*", F.lit(True).alias(mark))
    df = left.join(other, on, {"inner": "inner", "left": "left", "right": "right", "full": "full"}[how])
    cols = list(rel.cols)
    if how in ("right", "full"):
        # A right row without partner brings its keys into the left key columns.
        values = []
        for c in cols:
            pair = next((b for a, b in pairs if a.phys == c.phys), None)
            if pair is None:
                values.append((c.name, c.value))
            else:
                (x, y), cls, integral = unify([c.value, pair.value])
                values.append((c.name, Value(F.coalesce(x, y), cls, integral)))
    order: tuple[Order, ...]
    made_order = []
    if how == "full":
        tail = [(F.col(mark).isNull(), Order(fresh("o")))]
        tail += [(F.col(o.phys), replace(o, phys=fresh("o"))) for o in rel.order]
        tail += [(F.when(F.col(mark).isNull(), render(as_text(b.value))), Order(fresh("o"))) for _, b in pairs]
        tail += [(F.col(o.phys), replace(o, phys=fresh("o"))) for o in right.order]
        made_order, order = tail, tuple(o for _, o in tail)
    else:
        order = (*right.order, *rel.order) if how == "right" else (*rel.order, *right.order)
    if how in ("right", "full"):
        made = [Col(n, fresh(), v.cls, v.integral) for n, v in values]
        hidden = [c.alias(o.phys) for c, o in made_order] or [F.col(o.phys) for o in order]
        df = df.select(*[v.col.alias(c.phys) for c, (_, v) in zip(made, values)], *[c.phys for c in renamed], *hidden)
        cols = made
    else:
        df = df.select(*[c.phys for c in cols], *[c.phys for c in renamed], *[o.phys for o in order])
    return Rel(df, (*cols, *renamed), order)


def _fresh_names(rel: Rel) -> Rel:
    """The same relation under new physical names, so it can be joined with itself."""
    cols = [replace(c, phys=fresh()) for c in rel.cols]
    order = [replace(o, phys=fresh("o")) for o in rel.order]
    names = [F.col(a.phys).alias(b.phys) for a, b in zip((*rel.cols, *rel.order), (*cols, *order))]
    return Rel(rel.df.select(*names), tuple(cols), tuple(order))


def union(rel: Rel, right: Rel, s: Stage, context: dict) -> Rel:
    pairs: list[tuple[str, Col | None, Col | None]] = []
    if s.args["by_name"]:
        pairs = [(c.name, c, right.find(c.name)) for c in rel.cols]
        pairs += [(c.name, None, c) for c in right.cols if rel.find(c.name) is None]
    else:
        for i in range(max(len(rel.cols), len(right.cols))):
            a = rel.cols[i] if i < len(rel.cols) else None
            b = right.cols[i] if i < len(right.cols) else None
            name = a.name if a else b.name
            if a is None and any(name == n for n, _, _ in pairs):
                name = f"column_{i + 1}"
            pairs.append((name, a, b))
    _unique([n for n, _, _ in pairs], s.span)
    nothing = Value(F.lit(None).cast("string"), "null")
    made, lefts, rights = [], [], []
    for name, a, b in pairs:
        if a and b and "null" not in (a.cls, b.cls) and as_text(a.value).cls != as_text(b.value).cls:
            fail("E1209", f"column `{name}` is of class {a.cls} on one side and {b.cls} on the other", s.span)
        (x, y), cls, integral = unify([a.value if a else nothing, b.value if b else nothing])
        phys = fresh()
        lefts.append(x.alias(phys))
        rights.append(y.alias(phys))
        made.append(Col(name, phys, cls, integral))
    side = fresh("o")
    order = [Order(side)]
    lefts.append(F.lit(0).alias(side))
    rights.append(F.lit(1).alias(side))
    for mine, own in ((rel, lefts), (right, rights)):
        others = rights if own is lefts else lefts
        for o in mine.order:
            phys = fresh("o")
            own.append(F.col(o.phys).alias(phys))
            others.append(F.lit(None).cast(mine.df.schema[o.phys].dataType).alias(phys))
            order.append(replace(o, phys=phys))
    a, b = rel.df.select(*lefts), right.df.select(*rights)
    out = Rel(a.unionByName(b), tuple(made), tuple(order))
    return _first_rows(out, list(out.cols)) if s.args["distinct"] else out


def _first_rows(rel: Rel, keys: list[Col]) -> Rel:
    """The first row, in order, of each combination of the keys' texts; nulls are equal."""
    parts = [as_text(k.value).col if k.cls != "other" else k.value.col.cast("string") for k in keys]
    n = fresh("n")
    if not rel.order:
        return replace(rel, df=rel.df.dropDuplicates([k.phys for k in keys]), groups=())
    w = W.partitionBy(*parts).orderBy(*rel.keys())
    df = rel.df.select("*", F.row_number().over(w).alias(n)).where(F.col(n) == 1).drop(n)
    return replace(rel, df=df, groups=())


def distinct(rel: Rel, s: Stage, context: dict) -> Rel:
    keys = columns(rel, Scope(rel, context), s.args["columns"]) or list(rel.cols)
    return _first_rows(rel, keys)


def pivot_longer(rel: Rel, s: Stage, context: dict) -> Rel:
    cols = columns(rel, Scope(rel, context), s.args["columns"])
    _unique([c.name for c in cols], s.span, "E1205")
    gone = {c.phys for c in cols}
    kept = [c for c in rel.cols if c.phys not in gone]
    names = [c.name for c in kept] + [s.args["names_to"], s.args["values_to"]]
    _unique(names, s.span)
    if any(c.cls in ("geom", "other") for c in cols):
        fail("E1234", "only scalars can be pivoted", s.span)
    values, cls, integral = unify([c.value for c in cols])
    at, name, value = fresh("o"), fresh(), fresh()
    cells = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(c.name).alias("n"), v.alias("v")) for i, (c, v) in enumerate(zip(cols, values))
    ])
    e = fresh("e")
    df = rel.df.select(*[c.phys for c in kept], *[o.phys for o in rel.order], F.explode(cells).alias(e))
    df = df.select(
        *[c.phys for c in kept], *[o.phys for o in rel.order],
        F.col(e)["n"].alias(name), F.col(e)["v"].alias(value), F.col(e)["i"].alias(at),
    )
    made = (*kept, Col(s.args["names_to"], name, "str"), Col(s.args["values_to"], value, cls, integral))
    return Rel(df, made, (*rel.order, Order(at)))


def complete(rel: Rel, s: Stage, context: dict) -> Rel:
    """Every combination of the keys' values, in the order in which each value first occurs.

    The result has a row for each combination: the product of domains is what the stage is for.
    """
    scope = Scope(rel, context)
    keys = columns(rel, scope, s.args["columns"])
    _unique([k.name for k in keys], s.span, "E1205")
    df, marked = rel.df, fresh("m")
    again = df.groupBy(*[k.phys for k in keys]).count().where("count > 1").limit(1)
    if not again.isEmpty():
        fail("E1208", "a combination of keys occurs twice", s.span)
    grid, ranks = None, []
    for k in keys:
        value, rank = fresh("g"), fresh("o")
        first = F.min(F.struct(*[_ascending(o, rel) for o in rel.order])) if rel.order else F.min(F.col(k.phys))
        domain = df.groupBy(F.col(k.phys).alias(value)).agg(first.alias(rank))
        grid = domain if grid is None else grid.crossJoin(domain)
        ranks.append((k, value, rank))
    on = None
    for k, value, _ in ranks:
        one = F.col(value).eqNullSafe(F.col(k.phys))
        on = one if on is None else on & one
    joined = grid.join(df.select("*", F.lit(True).alias(marked)), on, "left")
    base = Rel(joined, tuple(replace(c, phys=next((v for k, v, _ in ranks if k.phys == c.phys), c.phys)) for c in rel.cols))
    fills = {}
    for n, e in s.args["fill"]:
        c = base.find(n.name)
        if c is None:
            fail("E1005", f"unknown column `{n.name}`", n.span)
        if n.name in [k.name for k in keys]:
            fail("E1207", f"key `{n.name}` can't be filled", n.span)
        fills[n.name] = Scope(base, context).lower(e)
    cols = []
    for c in base.cols:
        v = c.value
        if c.name in fills:
            (x, y), cls, integral = unify([v, fills[c.name]])
            v = Value(F.when(F.col(marked).isNull(), y).otherwise(x), cls, integral)
        cols.append((c.name, v))
    made = [Col(n, fresh(), v.cls, v.integral) for n, v in cols]
    out = joined.select(*[v.col.alias(c.phys) for c, (_, v) in zip(made, cols)], *[r for _, _, r in ranks])
    return Rel(out, tuple(made), tuple(Order(r) for _, _, r in ranks))


def _ascending(o: Order, rel: Rel):
    """An order column whose ascending order, nulls first as in structs, is the order's own."""
    c = F.col(o.phys)
    kind = rel.df.schema[o.phys].dataType.simpleString()
    if not o.desc:
        return F.struct((c.isNull() if not o.nulls_first else c.isNotNull()).alias("n"), c.alias("v")).alias(o.phys)
    null = c.isNull() if not o.nulls_first else c.isNotNull()
    if kind.startswith("struct<"):  # of a mixed column
        down = F.struct((~c["t"]).alias("t"), (-c["n"]).alias("n"), _downwards(c["s"]).alias("s"))
        return F.struct(null.alias("n"), F.when(c.isNotNull(), down).alias("v")).alias(o.phys)
    if kind in ("double", "float", "bigint", "int", "smallint", "tinyint") or kind.startswith("decimal"):
        return F.struct(null.alias("n"), (-c).alias("v")).alias(o.phys)
    if kind == "boolean":
        return F.struct(null.alias("n"), (~c).alias("v")).alias(o.phys)
    return F.struct(null.alias("n"), _downwards(c).alias("v")).alias(o.phys)


def _downwards(text):
    """Orders texts downwards: the complements of code points, the longer first where one begins the other."""
    points = F.transform(F.split(text, ""), lambda x: -F.ascii(x))
    return F.array_append(points, F.lit(1))


STAGES = {
    "filter": filter_, "select": select, "drop": drop, "rename": rename, "mutate": mutate, "group_by": group_by, "agg": agg,
    "sort": sort, "limit": limit, "distinct": distinct, "pivot_longer": pivot_longer, "complete": complete,
}
JOINED = {"join": join, "union": union}
