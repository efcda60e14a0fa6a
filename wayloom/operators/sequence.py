"""Ordered operators over long per-key histories.

A plain ``Window.partitionBy(user)`` puts a whole user into one task. These operators cut each
history into time slices: rows are shuffled and sorted by (key, slice), each slice is reduced to
one summary row, only the summaries are ordered per key (their number is bounded by time span /
slice width), slices of crowded keys are narrowed, and what a slice must know about its past is joined back on (key, slice).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"

# A key with more rows than this in one slice gets narrower slices.
ROWS_PER_SLICE = 4_000_000


def _sliced(df: DataFrame, key: str, time_col: str, slice_seconds: int) -> DataFrame:
    """Adds the time slice of each row. Slices are ``slice_seconds`` wide; keys crowding a
    slice get slices narrowed by the excess, down to a second.

    Rows without key or time are left out. The table of crowded keys holds at most rows / ROWS_PER_SLICE keys, so it is broadcast and
    the rows themselves are not shuffled for it.
    """
    t = F.col(time_col)
    # Stated here, the filters are the same for rows and summaries, which then share one shuffle.
    df = df.filter(F.col(key).isNotNull() & t.isNotNull())
    crowded = (
        df.groupBy(F.col(key).alias("_key"), F.floor(t / slice_seconds).alias("_s"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > ROWS_PER_SLICE)
        .groupBy("_key")
        .agg(F.greatest(F.floor(F.lit(float(slice_seconds) * ROWS_PER_SLICE) / F.max("_n")), F.lit(1)).alias("_width"))
    )
    return (
        df.join(F.broadcast(crowded), F.col(key) == F.col("_key"), "left")
        .withColumn(SLICE, F.floor(t / F.coalesce("_width", F.lit(slice_seconds))).cast("long"))
        .filter(F.col(SLICE).isNotNull())
        .drop("_key", "_width")
    )


def _as_struct(names: list[str]) -> Column:
    return F.struct(*[F.col(n) for n in names])


def assign_sessions(
    df: DataFrame,
    key: str,
    time_col: str,
    order: list[str],
    carry: list[str],
    is_break: Callable[[Column, Column], Column],
    slice_seconds: int,
) -> DataFrame:
    """Cut each key's ordered rows wherever ``is_break(previous, current)`` holds.

    ``carry`` names the columns visible in the two structs. ``time_col`` must be the first of
    ``order``, or constant within equal first values, so slices follow the order. Adds ``prev``
    (struct of the previous row, NULL at the first row of a key), ``is_start`` and
    ``session_start`` (the ``order`` struct of the row that opened the session).
    """
    # Carried columns travel once, inside the struct. With nothing besides, rows and summaries
    # read the same columns and Spark shuffles them once for both.
    others = [c for c in df.columns if c not in carry and c != key]
    ordering = [F.col(f"_cur.{c}").alias(c) if c in carry else F.col(c) for c in order]
    in_slice = Window.partitionBy(key, SLICE).orderBy(*ordering)
    rows = (
        _sliced(df, key, time_col, slice_seconds)
        .select(key, SLICE, *others, _as_struct(carry).alias("_cur"))
        .withColumn("_lag", F.lag("_cur").over(in_slice))
        .withColumn("_ord", F.struct(*ordering))
        .withColumn(
            "_local_break",
            F.col("_lag").isNotNull() & F.coalesce(is_break(F.col("_lag"), F.col("_cur")), F.lit(False)),
        )
    )
    summary = rows.groupBy(key, SLICE).agg(
        F.min_by("_cur", "_ord").alias("first_row"),
        F.min("_ord").alias("first_ord"),
        F.max_by("_cur", "_ord").alias("last_row"),
        F.max(F.when(F.col("_local_break"), F.col("_ord"))).alias("last_break"),
    )
    by_key = Window.partitionBy(key).orderBy(SLICE)
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.col("before_row").isNull() | F.coalesce(
        is_break(F.col("before_row"), F.col("first_row")), F.lit(False)
    )
    carried = (
        summary.withColumn("before_row", F.lag("last_row").over(by_key))
        .withColumn("slice_opens", opens)
        .withColumn(
            "slice_break",
            F.coalesce(F.col("last_break"), F.when(F.col("slice_opens"), F.col("first_ord"))),
        )
        .withColumn("before_break", F.last("slice_break", ignorenulls=True).over(before))
        .select(key, SLICE, "before_row", "slice_opens", "before_break", "first_ord")
    )
    up_to_here = in_slice.rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(carried, [key, SLICE])
        .withColumn("prev", F.coalesce(F.col("_lag"), F.col("before_row")))
        .withColumn("is_start", F.when(F.col("_lag").isNull(), F.col("slice_opens")).otherwise(F.col("_local_break")))
        .withColumn(
            "session_start",
            F.coalesce(
                F.max(F.when(F.col("_local_break"), F.col("_ord"))).over(up_to_here),
                F.when(F.col("slice_opens"), F.col("first_ord")),
                F.col("before_break"),
            ),
        )
        .select(key, *others, *[F.col(f"_cur.{c}").alias(c) for c in carry], "prev", "is_start", "session_start")
    )


def with_previous(
    df: DataFrame, key: str, time_col: str, order: list[str], carry: list[str], slice_seconds: int
) -> DataFrame:
    """Adds ``prev``, the struct of the key's previous row."""
    slices = _sliced(df, key, time_col, slice_seconds)
    in_slice = Window.partitionBy(key, SLICE).orderBy(*order)
    rows = slices.withColumn("_lag", F.lag(_as_struct(carry)).over(in_slice))
    tails = (
        slices.groupBy(key, SLICE)
        .agg(F.max_by(_as_struct(carry), _as_struct(order)).alias("_tail"))
        .withColumn("_before", F.lag("_tail").over(Window.partitionBy(key).orderBy(SLICE)))
        .select(key, SLICE, "_before")
    )
    return (
        rows.join(tails, [key, SLICE])
        .withColumn("prev", F.coalesce(F.col("_lag"), F.col("_before")))
        .drop("_lag", "_before", SLICE)
    )


def running_total(
    df: DataFrame, key: str, time_col: str, order: list[str], values: dict[str, Column], slice_seconds: int
) -> DataFrame:
    """Adds, per entry of ``values``, the sum of the expression over the key's rows up to and
    including the current one in ``order``."""
    slices = _sliced(df, key, time_col, slice_seconds)
    up_to_here = (
        Window.partitionBy(key, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = slices
    for name, value in values.items():
        rows = rows.withColumn(f"_in_{name}", F.sum(value).over(up_to_here))
    totals = slices.groupBy(key, SLICE).agg(
        *[F.sum(value).alias(f"_tot_{name}") for name, value in values.items()]
    )
    before = Window.partitionBy(key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    for name in values:
        totals = totals.withColumn(
            f"_before_{name}", F.coalesce(F.sum(f"_tot_{name}").over(before), F.lit(0))
        ).drop(f"_tot_{name}")
    out = rows.join(totals, [key, SLICE])
    for name in values:
        out = out.withColumn(name, F.col(f"_before_{name}") + F.col(f"_in_{name}")).drop(
            f"_before_{name}", f"_in_{name}"
        )
    return out.drop(SLICE)


def dense_ids(df: DataFrame, id_col: str, out_col: str, bucket_width: int = 65536) -> DataFrame:
    """Dense numbers 1..n in the order of a unique whole-number key, without one global window.

    Rows are numbered inside key ranges; only the per-range counts (at most key span /
    bucket_width rows) pass through a single ordered window.
    """
    ranged = df.withColumn("_range", F.floor(F.col(id_col) / bucket_width).cast("long"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    local = F.row_number().over(Window.partitionBy("_range").orderBy(id_col))
    return (
        ranged.withColumn("_local", local)
        .join(offsets, "_range")
        .withColumn(out_col, (F.col("_offset") + F.col("_local")).cast("long"))
        .drop("_range", "_local", "_offset")
    )
