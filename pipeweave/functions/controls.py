"""Control metadata of params: which fields a control has, and what they may hold."""

from __future__ import annotations

import re

from ..lang.ast import Context
from ..lang.diagnostics import Span, fail

#: Controls: class of the value, required fields, optional fields (fixed by the language).
CONTROLS: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {
    "input_text": ("text", ("label", "default"), ("placeholder",)),
    "input_textarea": ("text", ("label", "default"), ("placeholder", "rows")),
    "input_number": ("number", ("label", "default"), ("min", "max", "step")),
    "input_range": ("number", ("label", "min", "max", "default"), ("step",)),
    "input_checkbox": ("boolean", ("label", "default"), ()),
    "input_select": ("choice", ("label", "default"), ("choices", "choicesFrom")),
    "input_radio": ("choice", ("label", "default"), ("choices", "choicesFrom")),
    "input_date": ("date", ("label", "default"), ("min", "max")),
    "input_time": ("time", ("label", "default"), ("min", "max", "step")),
    "input_datetime": ("datetime", ("label", "default"), ("min", "max", "step")),
    "input_color": ("color", ("label", "default"), ()),
}
_DAY = r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])"
_CLOCK = r"([01]\d|2[0-3]):[0-5]\d(:[0-5]\d)?"
_SHAPES = {"date": _DAY, "time": _CLOCK, "datetime": f"{_DAY}T{_CLOCK}", "color": r"#[0-9A-Fa-f]{6}"}


def kind_of(v) -> str:
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "null" if v is None else "string"


def check(c: Context) -> None:
    """Raises what is wrong with the control of a param."""
    kind, fields, span = c.control["kind"], c.control["fields"], Span(*c.control["span"])
    if kind not in CONTROLS:
        fail("E2007", f"unknown control `{kind}`", span)
    holds, required, optional = CONTROLS[kind]
    for f in fields:
        if f not in required + optional:
            fail("E2009", f"`{kind}` has no field `{f}`", span)
    for f in required:
        if f not in fields:
            fail("E2008", f"`{kind}` needs the field `{f}`", span)
    bad = lambda what: fail("E2011", what, span)
    default = fields["default"]
    if kind_of(fields["label"]) != "string":
        bad("a label is a string")
    if "placeholder" in fields and kind_of(fields["placeholder"]) != "string":
        bad("a placeholder is a string")
    if "rows" in fields and (kind_of(fields["rows"]) != "number" or fields["rows"] != int(fields["rows"]) or fields["rows"] < 1):
        bad("rows is a whole number from 1")
    if "step" in fields and (kind_of(fields["step"]) != "number" or fields["step"] <= 0):
        bad("a step is a number above 0")
    if holds == "number":
        for f in ("default", "min", "max"):
            if f in fields and kind_of(fields[f]) != "number":
                bad(f"{f} is a number")
        least, most = fields.get("min", float("-inf")), fields.get("max", float("inf"))
        if least > most or not least <= default <= most:
            bad("min <= default <= max must hold")
    elif holds == "boolean" and kind_of(default) != "boolean":
        bad("default is true or false")
    elif holds == "text" and kind_of(default) != "string":
        bad("default is a string")
    elif holds in _SHAPES:
        for f in ("default", "min", "max"):
            if f in fields and (kind_of(fields[f]) != "string" or fields[f] and not re.fullmatch(_SHAPES[holds], fields[f])):
                bad(f"{f} isn't a {holds}")
    elif holds == "choice":
        if ("choices" in fields) == ("choicesFrom" in fields) and "choices" not in fields:
            fail("E2008", f"`{kind}` needs choices or choicesFrom", span)
        choices = fields.get("choices")
        if choices is not None:
            if not choices or len({(kind_of(x), x) for x in choices}) < len(choices) or any(kind_of(x) != kind_of(default) for x in choices):
                bad("choices are distinct values of the default's class")
            if "choicesFrom" not in fields and default not in choices:
                bad("default is one of the choices")


def metadata(c: Context) -> dict:
    fields = {k: ".".join(v) if isinstance(v, tuple) else v for k, v in c.control["fields"].items()}
    return {"name": c.name, "control": c.control["kind"]} | fields


def coerced(text: str, kind: str):
    """A choice's text as a value of the param's class; E2013 if it isn't one."""
    if kind == "string":
        return text
    if kind == "boolean" and text in ("true", "false"):
        return text == "true"
    if kind == "number":
        try:
            return float(text)
        except ValueError:
            pass
    fail("E2013", f"choice `{text}` isn't a {kind}")
