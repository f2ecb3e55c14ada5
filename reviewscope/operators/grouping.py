"""Per-group building blocks that stay bounded when one group holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A side is broadcast only when it was measured to fit both limits.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
# Largest n for which Spark cuts every task's rows per group before the shuffle
# (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000


def same_row(left: str, right: str, keys: Sequence[str]) -> Column:
    """Null-safe equality of all keys of two aliased sides."""
    cond = F.lit(True)
    for key in keys:
        cond = cond & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return cond


def fetched(small: DataFrame) -> pa.Table | None:
    """The rows of `small` if it proves small. At most BROADCAST_ROWS + 1 rows reach the driver."""
    table = small.limit(BROADCAST_ROWS + 1).toArrow()
    return None if table.num_rows > BROADCAST_ROWS or table.nbytes > BROADCAST_BYTES else table


def measured(small: DataFrame) -> tuple[DataFrame, bool]:
    """`small` as local data with a broadcast hint if it proves small, else unchanged."""
    table = fetched(small)
    if table is None:
        return small, False
    local = small.sparkSession.createDataFrame(table, small.schema)
    return F.broadcast(local), True


def join_small(df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per-group facts onto rows without shuffling the rows, if the facts prove small.

    Beyond the limits it is an ordinary shuffled join, which AQE splits where a key is hot.
    """
    side, _ = measured(small)
    return df.join(side, list(on), how)


def first_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """The first n rows per group in a total order, numbered from 1 in `rank`.

    Up to GROUP_LIMIT Spark keeps n rows per group and task before it shuffles.  For a larger n
    the group is first cut to n rows in each of many hash slices, then in fewer: the first n of the
    whole are always among the first n of their slice, so the result is exact.
    """
    keys = list(keys)
    if n > GROUP_LIMIT:
        columns = df.columns
        for slices in (4096, 64):
            df = df.withColumn("__slice", F.pmod(F.xxhash64(*columns), F.lit(slices)))
            w = Window.partitionBy(*keys, "__slice").orderBy(*order)
            df = df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
            df = df.drop("__slice", rank)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def group_mode(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Most frequent value per group, the smallest on ties."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return counts.groupBy(*keys).agg(
        F.max_by(value, F.struct(F.col("__n"), -F.col(value))).alias(out)
    )


CELLS = 256  # per octave of the values
FINE = 1 << 16  # per cell


def _order_cells(v: Column) -> tuple[Column, Column]:
    """(cell, fine): whole numbers that order values as the values are ordered, from the value alone.

    Cells are even steps of its logarithm, so data over any number of magnitudes spread over them; the fine number
    tells apart values that agree in about five digits.
    """
    place = F.log2(F.abs(v)) * CELLS
    step = F.floor(place)
    within = F.least(F.floor((place - step) * FINE), F.lit(FINE - 1))
    positive = step + 2048 * CELLS
    return (
        F.when(v == 0, F.lit(0)).when(v > 0, positive).otherwise(-positive).cast("long"),
        F.when(v == 0, F.lit(0)).when(v > 0, within).otherwise(FINE - 1 - within).cast("long"),
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles per group, one column per entry of `probs`.

    No task ever holds a group, and building the plan runs nothing: values are counted, the counts are summed up by
    cells, then by the fine numbers of the wanted cells only, and only the values of one fine slice are sorted.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    counts = df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("v")).agg(F.count("*").alias("c"))
    cell, fine = _order_cells(F.col("v"))
    counts = counts.withColumns({"cell": cell, "fine": fine})

    def ranks(n: Column) -> dict[str, tuple[Column, Column]]:
        return {name: (F.floor(F.lit(p) * (n - 1)), F.ceil(F.lit(p) * (n - 1))) for name, p in probs.items()}

    group = Window.partitionBy(*keys)
    cells = counts.groupBy(*keys, "cell").agg(F.sum("c").alias("c"))
    cells = cells.withColumns({"n": F.sum("c").over(group), "upto": F.sum("c").over(group.orderBy("cell"))})
    wanted = F.array_distinct(F.array(*[r for pair in ranks(F.col("n")).values() for r in pair]))
    here = F.filter(wanted, lambda r: (F.col("upto") - F.col("c") <= r) & (r < F.col("upto")))
    asked = cells.select(*keys, "cell", "n", (F.col("upto") - F.col("c")).alias("below"), F.explode(here).alias("rank"))

    def narrowed(asked: DataFrame, on: list[str], order: str, *keep: str) -> DataFrame:
        """The slices (or values) along `order` that hold each rank."""
        slot = [*keys, "rank", "n"]
        sums = counts.join(asked, [*keys, *on]).groupBy(*slot, "below", *on, order).agg(F.sum("c").alias("c"))
        upto = F.col("below") + F.sum("c").over(Window.partitionBy(*slot).orderBy(order))
        found = sums.withColumn("upto", upto).filter((F.col("upto") - F.col("c") <= F.col("rank")) & (F.col("rank") < F.col("upto")))
        return found.select(*slot, *keep, (F.col("upto") - F.col("c")).alias("below"))

    slices = narrowed(asked, ["cell"], "fine", "cell", "fine")
    found = narrowed(slices, ["cell", "fine"], "v", "v")
    at = ranks(F.col("n"))
    parts = found.groupBy(*keys, "n").agg(
        *[F.max(F.when(F.col("rank") == at[name][side], F.col("v"))).alias(f"__{name}_{side}") for name in probs for side in (0, 1)]
    )
    out = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("n") - 1)
        low, high = F.col(f"__{name}_0"), F.col(f"__{name}_1")
        out.append((low + (high - low) * (pos - F.floor(pos))).alias(name))
    return parts.select(*keys, *out)


def histogram(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    bins: int,
    low: float | None = None,
    high: float | None = None,
) -> DataFrame:
    """Equal-width counts per group, every bin present, last bin closed.

    The range is the group's own [min, max] unless `low` and `high` fix it; a group with a
    single value gets a range of width one around it.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    if low is None:
        lo, hi = F.min("v"), F.max("v")
    else:
        lo, hi = F.min(F.lit(float(low))), F.max(F.lit(float(high)))
        rows = rows.filter(F.col("v").between(low, high))
    ranges = rows.groupBy(*keys).agg(lo.alias("lo"), hi.alias("hi"))
    flat = F.col("lo") == F.col("hi")
    ranges = ranges.select(
        *keys,
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    ranges, _ = measured(ranges)
    slot = F.least(
        F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)
    )
    counts = (
        rows.join(ranges, keys)
        .groupBy(*keys, slot.cast("long").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    frame = ranges.withColumn("bin", F.explode(F.expr(f"sequence(0L, {bins - 1}L)")))
    step = (F.col("hi") - F.col("lo")) / bins
    return frame.join(counts, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("lo") + step * F.col("bin")).alias("bin_lo"),
        (F.col("lo") + step * (F.col("bin") + 1)).alias("bin_hi"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )
