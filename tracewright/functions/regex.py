"""Patterns in Python's syntax for Spark's Java engine."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_UNSUPPORTED = re.compile(r"\(\?\(|\(\?[LA]|\\N\{|\(\?P>|(?<!\\)\[\^?\[")


def to_java(pattern: str) -> str | None:
    """The pattern with Python's meaning of classes and ends; None where only Python's engine will do.

    (?U) makes classes and case folding Unicode-aware and (?d) lets only a newline end a line, as in Python.
    """
    re.compile(pattern)
    if _UNSUPPORTED.search(pattern):
        return None
    out = pattern.replace("(?P<", "(?<").replace("\\Z", "\\z")
    out = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", out)
    if re.search(r"(?<!\\)&&", out):
        return None
    return "(?Ud)" + out


def matches(column: Column, pattern: str) -> Column:
    """Whether the pattern is found anywhere: in the JVM if it can be, else by an Arrow function."""
    java = to_java(pattern)
    if java is not None:
        return F.coalesce(column.rlike(java), F.lit(False))
    compiled = re.compile(pattern)

    @F.pandas_udf("boolean")
    def found(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x is not None and compiled.search(x) is not None)

    return found(column)
