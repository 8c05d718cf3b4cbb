"""Join sides whose size is checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A million keys of two numbers are some 50 MB in a hash relation.
MAX_KEY_ROWS = 1_000_000
# Rows that carry texts as well.
MAX_WIDE_ROWS = 100_000


def broadcast_if_small(side: DataFrame, max_rows: int = MAX_KEY_ROWS, at_most: int | None = None) -> DataFrame:
    """Broadcast a side that is counted and found small; otherwise leave the join to Spark.

    Adaptive execution would find out too, but only after it has shuffled the large side. A
    known bound ``at_most`` saves the count where it is small itself. Use this on sides that
    are cached, written, or cheap to count.
    """
    bounded = at_most is not None and at_most <= max_rows
    return F.broadcast(side) if bounded or side.count() <= max_rows else side
