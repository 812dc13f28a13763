"""Values: a Spark column with its class, and the text, number and order of values of any class.

Classes: num, str, bool, geom (GeoJSON text), time (a timestamp or date carried from a typed file,
read as ISO text), null (no value seen), mixed (a struct tagged with the class of each cell) and
other (carried, never computed with).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIXED = "struct<t:tinyint,b:boolean,n:double,s:string>"
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
_TAGS = {"bool": 1, "num": 2, "str": 3}


@dataclass(frozen=True)
class Value:
    col: Column
    cls: str
    integral: bool = False  # a num that Spark holds as a whole number
    kind: str = ""  # of class time: the Spark type a typed source gave it, empty if not known


def null() -> Value:
    return Value(F.lit(None).cast("string"), "null")


def literal(v) -> Value:
    if v is None:
        return null()
    if isinstance(v, bool):
        return Value(F.lit(v), "bool")
    if isinstance(v, (int, float)):
        return Value(F.lit(float(v)), "num")
    return Value(F.lit(str(v)), "str")


def class_of(kind: T.DataType) -> tuple[str, bool]:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "num", True
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "num", False
    if isinstance(kind, T.BooleanType):
        return "bool", False
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "str", False
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time", False
    if isinstance(kind, T.NullType):
        return "null", False
    return "other", False


def parse_number(text: Column) -> Column:
    """A double from text that is wholly a number; null from any other."""
    word = F.lower(text)
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    special = F.when(word.contains("nan"), F.lit(float("nan"))).when(word.contains("inf"), sign * F.lit(float("inf")))
    return F.when(text.rlike(NUMBER), F.coalesce(special, text.try_cast("double")))


def format_number(x: Column) -> Column:
    """Whole numbers without a point, others in the shortest digits that read back, never with an exponent."""
    short = x.cast("string")
    mantissa, exponent = F.split_part(short, F.lit("E"), F.lit(1)), F.split_part(short, F.lit("E"), F.lit(2)).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(mantissa, "-", ""), r"\.", "")
    digits = F.regexp_replace(digits, "0+$", "")
    sign = F.when(short.startswith("-"), "-").otherwise("")
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    # 1.23456785E7: the point moves right by the exponent.
    large = F.concat(sign, F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substr(digits, exponent + 2))
    expanded = F.when(exponent < 0, small).otherwise(large)
    whole = F.when(F.abs(x) < 1e15, x.try_cast("bigint").cast("string")).otherwise(
        F.coalesce(x.try_cast("decimal(38,0)").cast("string"), F.concat(sign, F.rpad(digits, exponent + 1, "0")))
    )
    whole = F.when((x == 0) & short.startswith("-"), "-0").otherwise(whole)
    return (
        F.when(F.isnan(x), "NaN").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
        .when(F.rint(x) == x, whole).when(short.contains("E"), expanded).otherwise(short)
    )


def time_text(v: Value) -> Column:
    text = v.col.cast("string")
    return F.when(text.contains(":"), F.concat(F.replace(text, F.lit(" "), F.lit("T")), F.lit("Z"))).otherwise(text)


def render(v: Value) -> Column:
    """The text of a cell: its CSV form, null for null."""
    if v.cls == "num":
        return v.col.cast("string") if v.integral else format_number(v.col.cast("double"))
    if v.cls == "bool":
        return v.col.cast("string")
    if v.cls == "mixed":
        return (
            F.when(v.col["t"] == 1, v.col["b"].cast("string")).when(v.col["t"] == 2, format_number(v.col["n"])).otherwise(v.col["s"])
        )
    if v.cls == "time":
        return time_text(v)
    if v.cls == "geom":
        return F.lit(None).cast("string")
    return v.col.cast("string")


def as_text(v: Value) -> Value:
    """Timestamps as the text they stand for; other values as they are."""
    return Value(time_text(v), "str") if v.cls == "time" else v


def order_key(v: Value) -> Column:
    """What values are ordered by: cells of mixed columns by value, numbers and text that is a number first, others by text."""
    if v.cls != "mixed":
        return v.col
    n = F.when(v.col["t"] == 2, v.col["n"]).when(v.col["t"] == 3, parse_number(v.col["s"]))
    return F.when(v.col.isNotNull(), F.struct(n.isNull().alias("t"), n.alias("n"), F.when(n.isNull(), render(v)).alias("s")))


def number(v: Value) -> Column:
    """Values of class num as doubles, null for other classes."""
    if v.cls == "num":
        return v.col.cast("double")
    return v.col["n"] if v.cls == "mixed" else F.lit(None).cast("double")


def boolean(v: Value) -> Column:
    if v.cls == "bool":
        return v.col
    return v.col["b"] if v.cls == "mixed" else F.lit(None).cast("boolean")


def tagged(v: Value) -> Column:
    """Any value as the struct of a mixed column; null stays null."""
    v = as_text(v)
    if v.cls == "mixed":
        return v.col
    none = F.lit(None)
    if v.cls == "null":
        return none.cast(MIXED)
    parts = {"b": none.cast("boolean"), "n": none.cast("double"), "s": none.cast("string")}
    key = {"bool": "b", "num": "n"}.get(v.cls, "s")
    parts[key] = v.col.cast("double") if key == "n" else v.col
    made = F.struct(F.lit(_TAGS.get(v.cls, 3)).cast("tinyint").alias("t"), *[c.alias(k) for k, c in parts.items()])
    return F.when(v.col.isNotNull(), made).cast(MIXED)


def unify(values: list[Value]) -> tuple[list[Column], str, bool]:
    """Columns of one class for values of several: (columns, class, whether all integral)."""
    values = [as_text(v) if any(w.cls != v.cls for w in values if w.cls != "null") else v for v in values]
    classes = {v.cls for v in values if v.cls != "null"}
    if not classes:
        return [v.col for v in values], "null", False
    if len(classes) > 1:
        return [tagged(v) for v in values], "mixed", False
    cls = classes.pop()
    if cls == "num":
        integral = all(v.integral for v in values if v.cls != "null")
        kind = "bigint" if integral else "double"
        return [v.col.cast(kind) for v in values], cls, integral
    kinds = {"bool": "boolean", "str": "string", "geom": "string", "mixed": MIXED}
    cast = kinds.get(cls)
    return [v.col.cast(cast) if cast else (v.col if v.cls != "null" else F.lit(None)) for v in values], cls, False
