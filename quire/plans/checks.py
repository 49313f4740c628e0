"""What a physical plan does: shuffles, Python nodes, joins by kind, columns and filters that reach the scan."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def nodes(df: DataFrame) -> Counter:
    """Operators of the plan by name, as planned before adaptive changes."""
    return Counter(re.findall(r"^[\s:+|*()\d-]*([A-Z]\w+)", physical(df), re.M))


def shuffles(df: DataFrame) -> int:
    return nodes(df)["Exchange"]


def scanned_columns(df: DataFrame) -> list[set[str]]:
    """Columns that each file scan reads."""
    return [set(re.findall(r"(\w+):", x)) for x in re.findall(r"ReadSchema: struct<([^\n]*)>", physical(df))]


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", physical(df))
