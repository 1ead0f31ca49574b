"""Give each row its group's values without ever putting a large group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most this many groups are broadcast.
HOT_GROUPS = 1000
HOT_ROWS = 10_000


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """Left join of rows with groups of at least two rows each.

    Groups of over n_rows / HOT_GROUPS rows number less than HOT_GROUPS, whatever the data: those are
    broadcast. The rest are joined by shuffle, where no key then has more rows than that.
    """
    limit = max(HOT_ROWS, n_rows // HOT_GROUPS)
    hot, cold = groups.where(F.col(size) > limit), groups.where(F.col(size) <= limit)
    values = [c for c in groups.columns if c != key]
    near = rows.join(F.broadcast(hot), key, "left")
    rest = near.where(F.col(size).isNull()).drop(*values).join(cold, key, "left")
    return near.where(F.col(size).isNotNull()).unionByName(rest)
