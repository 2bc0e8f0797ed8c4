"""Names of columns that don't meet those of the caller's table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many underscores behind it as set it apart from ``taken``."""
    others = {t.lower() for t in taken}
    while name.lower() in others:
        name += "_"
    return name


def numbered(columns: list[str]) -> list[Column]:
    """The columns under the names c0, c1, ..."""
    return [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)]


def named(columns: list[str], taken: Iterable[str] = ()) -> list[Column]:
    """What numbered() gave under its own names, or fresh ones beside ``taken``."""
    return [F.col(f"c{k}").alias(fresh(c, taken)) for k, c in enumerate(columns)]


def renamed(df: DataFrame, but: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with all columns but those in ``but`` under plain numbered names, and its own names."""
    kept = set(but)
    return df.toDF(*[c if c in kept else f"extra_{k}" for k, c in enumerate(df.columns)]), df.columns
