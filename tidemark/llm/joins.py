"""A join of many rows with a table of one row a key, whatever the table's size and hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are broadcast at most; parts that a key is dealt to in a larger table.
BROADCAST_ROWS, SALTS = 100_000, 32


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], spread: str, how: str = "inner", most: int | None = None) -> DataFrame:
    """Join on ``keys``, unique in ``table``: broadcast if its counted rows are ``most`` or fewer, else salted.

    ``spread`` is a column of ``rows`` that differs within a key; its hash deals a key's rows,
    and those of a null key in a left join, to the copies of the key's row in the table.
    """
    if table.count() <= (BROADCAST_ROWS if most is None else most):
        return rows.join(F.broadcast(table), keys, how)
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], how).drop("salt")
