"""Names and parameters searched for: strings in raw bytes, candidate hashes, hash functions, code constants."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import fields

# Bounds of what is taken for a hash.
LEAST_HASH, MOST_HASH = 0x01000000, 0xFFFFFFFE


def ascii_strings(rows: DataFrame, data: str = "data", least: int = 5) -> DataFrame:
    """(rows' other columns, text): printable ASCII runs of at least `least` bytes."""
    found = F.regexp_extract_all(fields.latin1(F.col(data)), F.lit(rf"[\x20-\x7e]{{{least},}}"), F.lit(0))
    return rows.select(*[c for c in rows.columns if c != data], F.explode(found).alias("text"))


def utf16_strings(rows: DataFrame, data: str = "data", least: int = 4) -> DataFrame:
    """Printable runs of big-endian UTF-16 of at least `least` characters, at any byte offset."""
    found = F.regexp_extract_all(fields.latin1(F.col(data)), F.lit(rf"(?:\x00[\x20-\x7e]){{{least},}}"), F.lit(0))
    text = F.transform(found, lambda x: F.replace(x, F.decode(F.unhex(F.lit("00")), "ISO-8859-1")))
    return rows.select(*[c for c in rows.columns if c != data], F.explode(text).alias("text"))


def keyword_report(strings: DataFrame, patterns: list[tuple[str, str]], shown: int = 15) -> DataFrame:
    """(pattern, n, examples): each string belongs to the first pattern that it matches; the first `shown` by name."""
    owner = F.lit(None).cast("string")
    for name, pattern in reversed(patterns):
        owner = F.when(F.col("text").rlike(pattern), name).otherwise(owner)
    own = strings.select(owner.alias("pattern"), "text").where(F.col("pattern").isNotNull()).groupBy("pattern", "text").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("pattern").orderBy("text"))
    totals = own.groupBy("pattern").agg(F.sum("n").alias("n"))
    some = own.withColumn("r", rank).where(F.col("r") <= shown).groupBy("pattern").agg(F.array_sort(F.collect_list("text")).alias("examples"))
    return totals.join(some, "pattern")


def candidate_hashes(rows: DataFrame, data: str = "data") -> DataFrame:
    """(hash): the distinct plausible big-endian 32-bit values at every byte offset."""

    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                x = np.frombuffer(raw or b"", np.uint8).astype(np.int64)
                if len(x) >= 4:
                    v = np.unique(x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:])
                    yield pa.RecordBatch.from_pydict({"hash": v[(v >= LEAST_HASH) & (v <= MOST_HASH)]})

    return rows.select(data).mapInArrow(run, "hash long").distinct()


def identify_hash(names: DataFrame, pool: DataFrame) -> DataFrame:
    """(function, form, hits): which hash of which written form of the names (name) is in the pool (hash) often enough."""
    n = names.count()
    forms = F.array(*[F.struct(F.lit(k).alias("form"), fields.normalised(F.col("name"), k).alias("b")) for k in fields.NORMALISERS])
    rows = names.select("name", F.explode(forms).alias("x")).select("name", "x.form", "x.b")
    hashes = F.array(*[F.struct(F.lit(k).alias("function"), fields.legacy_hash(F.col("b"), k).alias("hash")) for k in fields.LEGACY])
    rows = rows.select("name", "form", F.explode(hashes).alias("x")).select("name", "form", "x.function", "x.hash")
    hits = rows.join(pool.select("hash").distinct(), "hash", "left_semi").groupBy("function", "form").agg(F.count("*").alias("hits"))
    return hits.where(F.col("hits") >= max(2, n // 2))


def loaded_constants(words: DataFrame, reach: int = 9, va: str = "va", word: str = "w") -> DataFrame:
    """(va, register, value): a high half loaded and the next low half added to the same register within `reach` words, unless loaded anew.

    Words are dealt to blocks with their followers repeated into the block before, so a pair never spans two groups.
    """
    size = 4096
    index = (F.col(va) / 4).cast("long")
    op, reg = F.shiftright(word, 26), fields.bits(F.col(word), 21, 5)
    base = words.select(index.alias("k"), F.col(word).alias("w"), op.alias("op"), reg.alias("d"), fields.bits(F.col(word), 16, 5).alias("a"))
    base = base.where(F.col("op").isin(14, 15, 24))  # add immediate, add shifted, or immediate
    high = base.where((F.col("op") == 15) & (F.col("a") == 0)).select("k", F.col("d").alias("r"), (F.col("w") % 65536).alias("hi"), F.floor(F.col("k") / size).alias("g"))
    source = F.when(F.col("op") == 24, F.col("d")).otherwise(F.col("a"))
    other = base.where((F.col("op") != 15) | (F.col("a") == 0)).select(F.col("k").alias("k2"), "op", (F.col("w") % 65536).alias("lo"), F.when(F.col("op") == 15, F.col("d")).otherwise(source).alias("r"))
    other = other.withColumn("g", F.explode(F.array_distinct(F.array(F.floor(F.col("k2") / size), F.floor((F.col("k2") - reach) / size)))))
    near = high.join(other, ["g", "r"]).where((F.col("k2") > F.col("k")) & (F.col("k2") <= F.col("k") + reach))
    first = near.groupBy("k", "r", "hi").agg(F.min_by(F.struct("op", "lo"), "k2").alias("x")).where(F.col("x.op") != 15)
    low = F.when((F.col("x.op") == 14) & (F.col("x.lo") >= 32768), F.col("x.lo") - 65536).otherwise(F.col("x.lo"))
    return first.select((F.col("k") * 4).alias("va"), F.col("r").alias("register"), (F.col("hi") * 65536 + low).alias("value"))
