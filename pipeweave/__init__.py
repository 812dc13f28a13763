"""A pipeline language over tables, lowered to Spark DataFrames."""

from .lang.diagnostics import Diagnostic, ProgramError
from .lang.parser import parse

__all__ = ["Diagnostic", "ProgramError", "parse"]
