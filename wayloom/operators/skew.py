"""Equi-joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(
    big: DataFrame,
    other: DataFrame,
    keys: list[str],
    spread_by: list[str],
    how: str = "inner",
    rows_per_task: int = 1_000_000,
    max_salts: int = 4096,
    condition=None,
) -> DataFrame:
    """Join where a key of ``big`` may hold a large part of its rows.

    Keys above ``rows_per_task`` rows are spread over several salts (chosen by hashing
    ``spread_by``, so a retried task gets the same rows) and the matching rows of ``other`` are
    repeated once per salt. The table of hot keys has at most rows / rows_per_task rows, so it
    is broadcast and finding the salts shuffles neither side. Keys below the mark are joined as usual. ``how`` may be inner, left, left_semi or
    left_anti, which never emit a row of ``big`` for a salt it is not in.
    """
    hot = (
        big.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > rows_per_task)
        .select(
            *[F.col(k).alias(f"_hot_{k}") for k in keys],
            F.least(F.ceil(F.col("_n") / rows_per_task), F.lit(max_salts)).cast("int").alias("_salts"),
        )
    )

    def with_salts(df: DataFrame) -> DataFrame:
        same = None
        for k in keys:
            c = df[k] == hot[f"_hot_{k}"]
            same = c if same is None else same & c
        return df.join(F.broadcast(hot), same, "left").drop(*[f"_hot_{k}" for k in keys])

    left = with_salts(big).withColumn(
        "_salt",
        F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*spread_by), F.col("_salts")).cast("int")
        ),
    ).drop("_salts")
    right = with_salts(other).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0))))
    ).drop("_salts")
    if condition is None:
        return left.join(right, [*keys, "_salt"], how).drop("_salt")
    l, r = left.alias("l"), right.alias("r")
    on = F.col("l._salt") == F.col("r._salt")
    for k in keys:
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return l.join(r, on & condition, how).drop("_salt")
