"""Diagnostics: a code, a message and a place in the program."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Span:
    start: int = 0
    end: int = 0


@dataclass(frozen=True)
class Diagnostic:
    code: str
    message: str
    span: Span = Span()
    help: str | None = None

    @property
    def severity(self) -> str:
        return {"W": "warning", "H": "hint"}.get(self.code[0], "error")

    def render(self, source: str = "", name: str = "<program>") -> str:
        line = source.count("\n", 0, self.span.start) + 1
        column = self.span.start - (source.rfind("\n", 0, self.span.start) + 1) + 1
        out = f"{name}:{line}:{column}: {self.severity}[{self.code}]: {self.message}"
        text = source.split("\n")[line - 1] if source else ""
        if text:
            width = max(1, min(self.span.end, self.span.start + len(text) - column + 1) - self.span.start)
            out += f"\n  {text}\n  {' ' * (column - 1)}{'^' * width}"
        return out + (f"\n  help: {self.help}" if self.help else "")

    def to_json(self) -> dict:
        return {
            "code": self.code, "severity": self.severity, "message": self.message,
            "span": {"start": self.span.start, "end": self.span.end},
        }


class ProgramError(Exception):
    """A program can't be parsed, analysed or run; carries its diagnostics."""

    def __init__(self, *diagnostics: Diagnostic):
        super().__init__("; ".join(f"{d.code}: {d.message}" for d in diagnostics))
        self.diagnostics = list(diagnostics)

    @property
    def code(self) -> str:
        return self.diagnostics[0].code


def fail(code: str, message: str, span: Span = Span(), help: str | None = None):
    raise ProgramError(Diagnostic(code, message, span, help))
