"""Joins with one row for each key, when a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one row in HEAVY is dealt over several tasks; there can't be more than HEAVY such keys.
HEAVY = 1024


def join_counted(rows: DataFrame, counted: DataFrame, key: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with counted, which has one row for each key and in n how many rows have it at most; n adds up to
    total at most.

    Rows of a heavy key are dealt by a hash of what else they hold, and the key's row goes to each of its tasks. rows is
    evaluated once, counted twice: it should be a table.
    """
    pieces = F.greatest(F.ceil(F.col(n) * F.lit(HEAVY) / F.lit(max(total, 1))), F.lit(1)).cast("int")
    heavy = counted.select(*key, pieces.alias("_pieces")).where("_pieces > 1")  # at most HEAVY keys: broadcast
    rest = [c for c in rows.columns if c not in key]
    dealt = rows.join(F.broadcast(heavy), key, "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64(*rest), F.col("_pieces")), F.lit(0)).cast("int")).drop("_pieces")
    each = counted.withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return dealt.join(each, [*key, "_piece"], how).drop("_piece")
