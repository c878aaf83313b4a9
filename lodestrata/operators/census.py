"""Censuses: histograms, examples, top-k reports and ratios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(rows: DataFrame, label: Column, index: str, limit: int | None = None) -> DataFrame:
    """(label, n, first): counts, most frequent first, ties in order of first appearance."""
    out = rows.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.min(index).alias("first")).orderBy(F.desc("n"), "first")
    return out.limit(limit) if limit else out


def extremes(rows: DataFrame, by: str, index: str, k: int, largest: bool = True) -> DataFrame:
    """The k largest or smallest rows, stable by index; one pass, k rows a task."""
    return rows.orderBy(F.desc(by) if largest else F.asc(by), index).limit(k)


def first_example(rows: DataFrame, group: str, index: str, *columns: str) -> DataFrame:
    """The row of smallest index of each group, by one map-side combined aggregation."""
    own = F.min_by(F.struct(index, *columns), index).alias("_x")
    return rows.groupBy(group).agg(own).select(group, f"_x.{index}", *[f"_x.{c}" for c in columns])


def systematic_sample(rows: DataFrame, index: str, step: int = 40) -> DataFrame:
    """Every `step`-th row by index."""
    return rows.where(F.col(index) % step == 0)


def seeded_sample(rows: DataFrame, index: str, n: int, seed: int = 1) -> DataFrame:
    """n rows in a seeded random order (a hash of the index, so any cluster draws the same)."""
    return rows.orderBy(F.xxhash64(F.lit(seed), index), index).limit(n)


def nested_top(rows: DataFrame, outer: str, inner: str, k: int, m: int) -> DataFrame:
    """The k most frequent outer values and, in each, the m most frequent inner ones."""
    pairs = rows.groupBy(outer, inner).agg(F.count("*").alias("n"))
    top = pairs.groupBy(outer).agg(F.sum("n").alias("total")).orderBy(F.desc("total"), outer).limit(k)
    rank = F.row_number().over(Window.partitionBy(outer).orderBy(F.desc("n"), inner))
    return pairs.join(F.broadcast(top), outer).withColumn("rank", rank).where(F.col("rank") <= m)


def compression_ratios(blocks: DataFrame, plain: str, packed: str) -> DataFrame:
    """One row: the mean of ratios, the extremes, and the ratio of sums (a different statistic)."""
    ratio = F.col(plain) / F.col(packed)
    return blocks.agg(
        F.count("*").alias("blocks"),
        F.count_if(F.col(packed) >= F.col(plain)).alias("stored"),
        F.avg(ratio).alias("mean_ratio"),
        F.min(ratio).alias("min_ratio"),
        F.max(ratio).alias("max_ratio"),
        (F.sum(plain) / F.sum(packed)).alias("ratio_of_sums"),
    )


def coverage(rows: DataFrame, found: Column) -> DataFrame:
    """One row: how many, how many found, and the percentage (0 of nothing)."""
    return rows.agg(F.count("*").alias("n"), F.count_if(found).alias("found")).withColumn("percent", 100.0 * F.col("found") / F.greatest(F.lit(1), F.col("n")))


def byte_histogram(rows: DataFrame, data: Column) -> DataFrame:
    """(byte, n) over all bytes: 256 counts a partition by numpy, then summed."""

    def run(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(x for x in batch.column(0).to_pylist() if x), np.uint8), minlength=256)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["byte", "n"])

    return rows.select(data.cast("binary").alias("b")).mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))


def marker_count(text: Column, marker: str) -> Column:
    """Non-overlapping occurrences of a marker."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(marker)))) / len(marker)).cast("bigint")
