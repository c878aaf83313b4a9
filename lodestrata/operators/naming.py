"""Names of hashed assets: generated catalogues, resolution, discovery, categories, manifest differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import fields

# Team codes, templates with a code, and names without one.
CODES = "ana atl bos buf car cbj cgy chi col dal det edm fla lak min mtl njd nsh nyi nyr ott phi pho pit sjs stl tbl tor van wsh int als pnd".split()
TEMPLATES = [
    "logo_{c}.iff", "uniform_{c}_home.iff", "uniform_{c}_away.iff", "uniform_{c}_alt.iff",
    "uniform_base_{c}_home.iff", "uniform_base_{c}_away.iff", "uniform_base_{c}_alt.iff",
    "rink_{c}.iff", "ice_{c}_playoffs.iff", "ice_{c}_finals.iff", "led_{c}.iff", "zamboni_{c}.iff", "zamboni_team_{c}.iff", "arena_{c}.iff",
]
GLOBALS = [
    "global.iff", "overlay_static.iff", "frontend.iff", "default.xex", "english.iff", "french.iff", "german.iff", "swedish.iff", "finnish.iff",
    "englishbootup.iff", "frenchbootup.iff", "germanbootup.iff", "swedishbootup.iff", "finnishbootup.iff",
]
# Prefix -> folder, the first match counts.
CATEGORIES = [
    ("uniform_base_", "jerseys/base"), ("uniform_", "jerseys/overlay"), ("logo_", "logos"), ("rink_", "rinks"), ("ice_", "rinks/postseason"),
    ("arena_", "arenas"), ("led_", "arenas/led"), ("zamboni_team_", "zamboni"), ("zamboni_", "zamboni"),
]


def catalogue(spark, codes=None, templates=None, extra=None) -> DataFrame:
    """(hash, name): every name the templates make (codes x templates, both short lists), the last of equal hashes."""
    names = [*(GLOBALS if extra is None else extra), *(t.format(c=c) for c in (codes or CODES) for t in (templates or TEMPLATES))]
    rows = spark.createDataFrame(list(enumerate(names)), "seq long, name string").withColumn("hash", fields.name_hash(F.col("name")))
    return rows.groupBy("hash").agg(F.max_by("name", "seq").alias("name"))


def resolve(entries: DataFrame, catalog: DataFrame, key: str = "crc") -> DataFrame:
    """Entries with their names, '' where unknown. A catalogue has hundreds of names; larger ones join by a shuffle on their own."""
    return entries.join(catalog.withColumnRenamed("hash", key), key, "left").withColumn("name", F.coalesce("name", F.lit("")))


def existing(candidates: DataFrame, entries: DataFrame, key: str = "hash", other: str = "crc") -> DataFrame:
    """The candidates whose hash some entry has."""
    return candidates.join(entries.select(F.col(other).alias(key)).distinct(), key, "left_semi")


def first_entry(entries: DataFrame, names: DataFrame) -> DataFrame:
    """Names with the smallest entry index of their hash."""
    index = entries.groupBy(F.col("crc").alias("hash")).agg(F.min("index").alias("index"))
    return names.withColumn("hash", fields.name_hash(F.col("name"))).join(index, "hash", "left")


def discover(codes: DataFrame, templates: DataFrame, entries: DataFrame, min_hits: int = 4) -> DataFrame:
    """(code, hits): the codes whose templates resolve at least `min_hits` times. Codes x a short list of templates."""
    made = codes.select("code", F.explode(F.array(*[F.lit(r[0]) for r in templates.collect()])).alias("template"))
    made = made.withColumn("hash", fields.name_hash(F.replace("template", F.lit("{c}"), F.col("code"))))
    hits = existing(made, entries).groupBy("code").agg(F.count("*").alias("hits"))
    return hits.where(F.col("hits") >= min_hits)


def category(name: Column, rules=None) -> Column:
    """The folder of a name by its prefix: 'unnamed' for none, 'other' without a match; case counts."""
    out = F.when(F.coalesce(name, F.lit("")) == "", "unnamed")
    for prefix, folder in CATEGORIES if rules is None else rules:
        out = out.when(F.startswith(name, F.lit(prefix)), folder)
    return out.otherwise("other")


def output_path(root: str, index: Column, name: Column) -> Column:
    """root/category/stem, or the five-digit index where there is no name."""
    stem = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)\.iff$", "")
    return F.concat_ws("/", F.lit(root), category(name), F.when(stem == "", F.lpad(index.cast("string"), 5, "0")).otherwise(stem))


def manifest_diff(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """One row: same, differing and missing rows of the old manifest, and extra ones of the new, which count for nothing else."""
    a, b = old.select(*key, F.col(value).alias("_a")), new.select(*key, F.col(value).alias("_b"), F.lit(1).alias("_new"))
    joined = a.withColumn("_old", F.lit(1)).join(b, key, "full")
    return joined.agg(
        F.count_if(F.col("_old").isNotNull() & F.col("_new").isNotNull() & F.col("_a").eqNullSafe(F.col("_b"))).alias("same"),
        F.count_if(F.col("_old").isNotNull() & F.col("_new").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("differing"),
        F.count_if(F.col("_new").isNull()).alias("missing"),
        F.count_if(F.col("_old").isNull()).alias("extra"),
    )
