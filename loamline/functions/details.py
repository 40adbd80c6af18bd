"""Texts of ``key=value`` tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token(text: Column, key: str) -> Column:
    """Value of a key, all after the first ``=``; the last token of a key wins; null without one."""
    own = F.filter(F.split(text, r"\s+"), lambda x: x.startswith(f"{key}="))
    return F.substring(F.try_element_at(own, F.lit(-1)), len(key) + 2, 1 << 30)
