"""Row filters as pushed-down predicates."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame

from ..functions.columns import col, is_numeric, parse_number


def numeric_range(df: DataFrame, name: str, bounds: Sequence[float]) -> Column | None:
    """Inclusive range; None when `bounds` is not a pair."""
    if not isinstance(bounds, (list, tuple)) or len(bounds) != 2:
        return None
    value = col(name) if is_numeric(df.schema[name]) else parse_number(col(name).cast("string"))
    return value.between(bounds[0], bounds[1])


def category_in(name: str, values: Sequence[Any]) -> Column | None:
    """Membership in a list of any length, compared as the column's type; an empty list filters nothing."""
    wanted = list(values) if isinstance(values, (list, tuple, set)) else [values]
    return col(name).isin(wanted) if wanted else None


def apply_filters(df: DataFrame, filters: Sequence[Mapping[str, Any]]) -> DataFrame:
    """All filters together; unknown columns and null values are skipped."""
    preds: list[Column] = []
    for f in filters:
        name, value = f.get("column"), f.get("value")
        if name not in df.columns or value is None:
            continue
        if f.get("type") == "numeric":
            pred = numeric_range(df, name, value)
        else:
            pred = category_in(name, value)
        if pred is not None:
            preds.append(pred)
    return df.filter(functools.reduce(operator.and_, preds)) if preds else df


def selection_filter(df: DataFrame, picks: Sequence[tuple[str, Any]]) -> DataFrame:
    """Filters from clicks on chart parts; the newest pick per column wins.

    A bin label "lo - hi" is a range, a number v means v +- 5 % (+- 1 at zero),
    anything else equality.
    """
    newest: dict[str, Any] = {}
    for name, value in picks:
        newest[name] = value
    preds = []
    for name, value in newest.items():
        if name not in df.columns:
            continue
        span = re.fullmatch(r"\s*(-?[\d.]+)\s+-\s+(-?[\d.]+)\s*", value) if isinstance(value, str) else None
        if span:
            preds.append(col(name).between(float(span[1]), float(span[2])))
        elif isinstance(value, (int, float)) and not isinstance(value, bool):
            tol = abs(value) * 0.05 if value else 1.0
            preds.append(col(name).between(value - tol, value + tol))
        else:
            preds.append(col(name) == value)
    return df.filter(functools.reduce(operator.and_, preds)) if preds else df


def drop_features(df: DataFrame, excluded: Sequence[str]) -> DataFrame:
    return df.drop(*excluded)


def with_target(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is known."""
    return df.dropna(subset=[target])


def complete_pairs(df: DataFrame, *names: str) -> DataFrame:
    """The named columns of the rows in which none of them is null."""
    return df.select(*[col(n) for n in names]).dropna()
