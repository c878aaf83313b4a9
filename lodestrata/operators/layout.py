"""Order-dependent placement: prefix sums, extents over splits, pairs within a window, keep-first journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_offsets(rows: DataFrame, size: str, order: list[str], group: list[str], out: str = "offset", chunk: int = 1 << 20) -> DataFrame:
    """Each row's offset: the sum of the sizes before it in its group.

    Where the first order column is a whole number, sums go in two levels: inside
    ranges of `chunk` of its values, then over the ranges' totals, so a group of
    any size is dealt to many tasks.
    """
    if rows.schema[order[0]].dataType.typeName() not in ("integer", "long", "short", "byte"):
        before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(out, F.coalesce(F.sum(size).over(before), F.lit(0)).cast("bigint"))
    ranged = rows.withColumn("_range", F.floor(F.col(order[0]) / chunk))
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*[f"_g{k}" for k in range(len(group))]).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], F.col("_range").alias("_r")).agg(F.sum(size).alias("_total"))
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(above), F.lit(0)))
    same = [F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(group)] + [F.col("_range").eqNullSafe(F.col("_r"))]
    made = ranged.withColumn("_own", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(totals, same)
    return made.select(*rows.columns, (F.col("_before") + F.col("_own")).cast("bigint").alias(out))


def sizes_from_offsets(rows: DataFrame, offset: str, end, order: list[str], group: list[str], out: str = "size") -> DataFrame:
    """Each row's size: the next offset (or the end) less its own."""
    after = Window.partitionBy(*group).orderBy(offset, *order)
    return rows.withColumn(out, F.coalesce(F.lead(offset).over(after), end) - F.col(offset))


def split_pieces(extents: DataFrame, split_size: int, offset: str = "offset", size: str = "size") -> DataFrame:
    """The pieces of extents over equal splits: (.., split, piece, piece_start, piece_size).

    The splits that an extent meets are computed from its ends and exploded, so
    the overlap join needs no comparison of extents with splits.
    """
    first, last = F.floor(F.col(offset) / split_size), F.floor((F.col(offset) + F.col(size) - 1) / split_size)
    out = extents.where(F.col(size) > 0).select("*", F.posexplode(F.sequence(first, last)).alias("piece", "split"))
    start = F.greatest(F.col(offset), F.col("split") * split_size)
    end = F.least(F.col(offset) + F.col(size), (F.col("split") + 1) * split_size)
    return out.withColumn("piece_start", start - F.col("split") * split_size).withColumn("piece_size", end - start)


def locate(points: DataFrame, splits: DataFrame, point: str) -> DataFrame:
    """Points with the split (name, start, size) that holds them, by a range join with the few splits."""
    few = F.broadcast(splits)  # one row a split file; an index holds at most some dozens
    return points.join(few, (F.col(point) >= F.col("start")) & (F.col(point) < F.col("start") + F.col("size")))


def follows_within(rows: DataFrame, kind: str, first: str, then: str, order: str, group: list[str], reach: int) -> DataFrame:
    """Rows of kind `first` with the next `then` at most `reach` rows on and no `first` between: one sort a group, and frames of `reach` rows."""
    own = Window.partitionBy(*group).orderBy(order)
    ahead = own.rowsBetween(1, reach)
    out = rows.withColumn("_row", F.row_number().over(own))
    out = out.withColumn("_then", F.first(F.when(F.col(kind) == then, F.struct("_row", order)), ignorenulls=True).over(ahead))
    out = out.withColumn("_again", F.first(F.when(F.col(kind) == first, F.col("_row")), ignorenulls=True).over(ahead))
    near = (F.col("_then._row") - F.col("_row") <= reach) & (F.col("_again").isNull() | (F.col("_again") > F.col("_then._row")))
    return out.where((F.col(kind) == first) & near).select(*rows.columns, F.col(f"_then.{order}").alias("then"), (F.col("_then._row") - F.col("_row")).alias("distance"))


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first writer of each key, by a map-side combined aggregation."""
    own = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_x")
    return rows.groupBy(*key).agg(own).select("_x.*")
