"""Operators on ordered rows that don't need one task per sequence.

A sequence is cut into blocks of its ordering column.  Within a block an ordinary window does the work; what
crosses blocks (the next block's first row, the sum of all blocks before) comes from a table with one row per
block, which is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _blocks(df: DataFrame, order: str, block: float) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / block).cast("long"))


def first_of_each(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group."""
    rest = [c for c in df.columns if c not in by]
    first = df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select(*by, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*df.columns)


def next_row(df: DataFrame, order: str, values: list[str], block: float, keys: list[str] = (), suffix: str = "_next") -> DataFrame:
    """Adds the ordering column and values of the next row of the sequence, null for its last row.

    Rows must be unique in (keys, order)."""
    keys = list(keys)
    rows = _blocks(df, order, block)
    cols = [order, *values]
    within = Window.partitionBy(*keys, "_block").orderBy(order)
    rows = rows.withColumn("_n", F.lead(F.struct(*cols)).over(within))
    heads = rows.groupBy(*keys, "_block").agg(F.min_by(F.struct(*cols), order).alias("_h"))
    heads = heads.withColumn("_h", F.lead("_h").over(Window.partitionBy(*keys).orderBy("_block")))
    rows = rows.join(heads, [*keys, "_block"])
    n = F.coalesce("_n", "_h")
    return rows.select(*df.columns, *(n[c].alias(c + suffix) for c in cols))


def running_sum(df: DataFrame, order: str, value: str, out: str, block: float, keys: list[str] = ()) -> DataFrame:
    """Adds the sum of a value over all rows up to and with each one."""
    keys = list(keys)
    rows = _blocks(df, order, block)
    within = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_s", F.sum(value).over(within))
    sums = rows.groupBy(*keys, "_block").agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_block", F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_b"))
    return rows.join(sums, [*keys, "_block"]).select(*df.columns, (F.col("_s") + F.col("_b")).alias(out))


def path_length(df: DataFrame, order: str, xy: tuple[str, str], block: float, keys: list[str] = (), out: str = "s") -> DataFrame:
    """Adds the curvilinear distance from the first row of each sequence."""
    keys = list(keys)
    ahead = next_row(df, order, list(xy), block, keys)
    step = F.sqrt(F.pow(F.col(f"{xy[0]}_next") - F.col(xy[0]), 2) + F.pow(F.col(f"{xy[1]}_next") - F.col(xy[1]), 2))
    ahead = ahead.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    summed = running_sum(ahead.select(*df.columns, "_step"), order, "_step", "_sum", block, keys)
    return summed.select(*df.columns, (F.col("_sum") - F.col("_step")).alias(out))


def numbered(df: DataFrame, keys: list[str], order: list[str], block: float | None, number: str = "_rn", total: str = "_total") -> DataFrame:
    """Adds each row's place in its sequence, from 0, and the sequence's length.  Blocks are of the first ordering column;
    without a block size a sequence is one block."""
    keys = list(keys)
    rows = _blocks(df, order[0], block) if block else df.withColumn("_block", F.lit(0).cast("long"))
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order)) - 1)
    sizes, by = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n")), Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(by.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_block").alias("_b"), before.alias("_before"), F.sum("_n").over(by).alias(total))
    same = rows["_block"] == sizes["_b"]
    for i, k in enumerate(keys):
        same &= rows[k].eqNullSafe(sizes[f"_k{i}"])
    return rows.join(sizes, same).select(*(rows[c] for c in df.columns), (F.col("_before") + F.col("_in")).alias(number), total)


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, width: int, out: str, block: float | None = None, bucket: int = 1 << 16) -> DataFrame:
    """Centred moving average with zeros beyond the ends; for an even width the extra row lies before.

    Rows are numbered by blocks of the first ordering column, and averaged in buckets of consecutive numbers that also
    hold the rows within a width of them.  Sequences shorter than the width, and widths up to 1, are returned unchanged."""
    if width <= 1:
        return df.withColumn(out, F.col(value))
    keys, size, before = list(keys), max(bucket, 2 * width), width // 2
    rows = numbered(df, keys, order, block)
    own, place = F.floor(F.col("_rn") / size), F.col("_rn") % size
    near = F.array_compact(F.array(own, F.when(place < width, own - 1), F.when(place >= size - width, own + 1)))
    rows = rows.withColumn("_own", own).withColumn("_put", F.explode(near))
    w = Window.partitionBy(*keys, "_put").orderBy("_rn").rowsBetween(-before, width - 1 - before)
    rows = rows.withColumn("_mean", F.sum(value).over(w) / width).where("_put = _own")
    names = [c for c in df.columns if c != out]
    return rows.select(*names, F.when(F.col("_total") >= width, F.col("_mean")).otherwise(F.col(value)).alias(out))


def every_nth(df: DataFrame, n: int, index: str, keys: list[str] = ()) -> DataFrame:
    """One row of n by its index within each group, the group's first row included."""
    if not keys:
        return df.where(F.col(index) % n == 0)
    first = df.groupBy(*keys).agg(F.min(index).alias("_first"))
    return df.join(first, list(keys)).where((F.col(index) - F.col("_first")) % n == 0).select(*df.columns)


def islands(df: DataFrame, order: str, same: str, out: str, keys: list[str] = (), block: float | None = None) -> DataFrame:
    """Numbers runs of consecutive rows with an equal value, from 1, in row order.

    Runs are numbered within blocks of the ordering column; whether a run goes on from the block before, and how many
    there are before, comes from the blocks' ends.  Without a block size a sequence is one block."""
    keys = list(keys)
    rows = _blocks(df, order, block) if block else df.withColumn("_block", F.lit(0).cast("long"))
    w = Window.partitionBy(*keys, "_block").orderBy(order)
    first = F.row_number().over(w) == 1
    rows = rows.withColumn("_new", F.when(first | F.col(same).eqNullSafe(F.lag(same).over(w)), 0).otherwise(1))
    rows = rows.withColumn("_in", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    value = F.struct(F.col(same).alias("v"))  # the minimum skips null values, but not a struct that holds one
    ends = rows.groupBy(*keys, "_block").agg(F.sum("_new").alias("_more"), F.min_by(value, order).alias("_f"), F.max_by(value, order).alias("_l"))
    by = Window.partitionBy(*keys).orderBy("_block")
    begins = F.when(F.lag("_l").over(by).isNotNull() & F.col("_f.v").eqNullSafe(F.lag("_l").over(by)["v"]), 0).otherwise(1)
    ends = ends.withColumn("_begins", begins)
    before = F.coalesce(F.sum(F.col("_begins") + F.col("_more")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_block").alias("_b"), (before + F.col("_begins")).alias("_base"))
    met = rows["_block"] == ends["_b"]
    for i, k in enumerate(keys):
        met &= rows[k].eqNullSafe(ends[f"_k{i}"])
    return rows.join(ends, met).select(*(rows[c] for c in df.columns if c != out), (F.col("_base") + F.col("_in")).alias(out))
