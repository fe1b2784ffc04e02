"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 31


def by_hash(df: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """About ``size`` rows, never more than twice as many: those whose key hashes low enough.

    No task sends more than its part of the sample, whatever the number of tasks.
    """
    share = min(1.0, size / max(1, df.count()))
    return df.where(F.pmod(F.xxhash64(key), F.lit(_RANGE)) < int(share * _RANGE)).limit(2 * size)
