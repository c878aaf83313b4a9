"""A two-pass external shuffle into shards, by DataFrame functions alone.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash of
the whole record and of the input partition it comes from, so neither a hot key
nor a record that stands many times makes a large bucket. A bucket is a task:
pass two gathers it, puts it in canonical order, Fisher-Yates shuffles it
(Spark's shuffle() draws its swaps from a seeded generator) and writes it. The
buckets one after another are a uniform random order of all records; the shards
are equal consecutive ranges of that order, so their row counts differ by one at
most (the law `rows`). A bucket's place needs only the counts of the buckets
before it, which are summed in two levels. Buckets are sized by the bytes of the
decoded texts, not by those that are stored.

Defined results: null texts and null keys are ordinary values. Repeated rows each
get a place; rows that are equal in every column are interchangeable. A very long
text makes its bucket larger by itself. An empty table makes empty shards. All
columns of the input, whatever their names, are in the shards. The input must
give the same rows in the same partitions when it is read again, as a table does;
if it did not, the counts would not fit and an error is raised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm import store


def exclusive_sums(counts: DataFrame, key: str, count: str, out: str, group: int = 4096) -> DataFrame:
    """`counts` with the sum of `count` over smaller keys as `out`: within groups of keys, then over the groups' totals."""
    level = counts.withColumn("_group", F.floor(F.col(key) / group))
    inner = Window.partitionBy("_group").orderBy(key)
    outer = Window.orderBy("_group")  # one row for each `group` keys
    totals = level.groupBy("_group").agg(F.sum(count).alias("_total"))
    totals = totals.select("_group", (F.sum("_total").over(outer) - F.col("_total")).alias("_before"))
    return (
        level.withColumn("_own", F.sum(count).over(inner) - F.col(count))
        .join(totals, "_group")
        .select(*counts.columns, (F.col("_before") + F.col("_own")).alias(out))
    )


def shuffle_into_shards(docs: DataFrame, out: str, shards: int = 24, seed: int = 17, key: str = "doc_id", text: str = "text", bucket_mb: float = 32) -> DataFrame:
    """Write `docs` to `out`, a folder a shard, in shuffled order; the written rows as (shard, slot, record struct)."""
    spark = docs.sparkSession
    total, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) + 64 * F.count("*")).first()
    buckets = max(1, -(-size // int(bucket_mb * 1e6)))
    whole = [F.col(f"`{c}`") for c in docs.columns]
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.spark_partition_id(), *whole), F.lit(buckets)).cast("int")

    counts = docs.select(bucket.alias("_bucket")).groupBy("_bucket").agg(F.count("*").alias("_n"))
    counts = store.kept(counts, "shard-counts")  # a row a bucket
    places = exclusive_sums(counts, "_bucket", "_n", "_first").select("_bucket", "_first")

    gathered = (
        docs.select(bucket.alias("_bucket"), F.struct(*whole).alias("_record"))
        .repartitionById(buckets, F.col("_bucket"))
        .sortWithinPartitions("_bucket", f"_record.`{key}`", f"_record.`{text}`")
        .groupBy("_bucket")
        .agg(F.collect_list("_record").alias("_records"))
        .select("_bucket", F.shuffle("_records", seed).alias("_records"))
    )
    small, more = divmod(total, shards)  # the first `more` shards hold one row more
    edge = more * (small + 1)
    place = F.col("_first") + F.col("_at")
    shard = F.when(place < edge, F.floor(place / (small + 1))).otherwise(more + F.floor((place - edge) / max(small, 1)))
    start = F.when(F.col("shard") <= more, F.col("shard") * (small + 1)).otherwise(edge + (F.col("shard") - more) * small)
    placed = (
        gathered.join(F.broadcast(places) if buckets <= 100_000 else places, "_bucket")
        .select("_first", F.posexplode("_records").alias("_at", "_record"))
        .select(place.alias("_place"), shard.cast("int").alias("shard"), F.col("_record").alias("record"))
        .select("shard", (F.col("_place") - start).cast("long").alias("slot"), "record")
    )
    schema = placed.schema
    placed.write.partitionBy("shard").parquet(out)
    rows = spark.read.schema(schema).parquet(out).select("shard", "slot", "record")
    found = rows.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last")).collect()  # a row a shard
    if sum(r["n"] for r in found) != total or any(r["n"] != r["last"] + 1 for r in found):
        raise RuntimeError("the input gave other rows, or other partitions, when it was read again")
    return rows
