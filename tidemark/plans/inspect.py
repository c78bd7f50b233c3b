"""What a plan does, as text to assert on."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame


def nodes(df: DataFrame) -> Counter:
    """How often each physical operator stands in the plan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return Counter(re.findall(r"(?:^|[-+: *(\d)]+)([A-Z][A-Za-z]+)(?= |\(|\[|$)", text, re.M))


def read_columns(df: DataFrame) -> set[str]:
    """Columns that the scans read."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return {c.split(":")[0] for m in re.findall(r"ReadSchema: struct<([^>]*)", text) for c in m.split(",") if c}
