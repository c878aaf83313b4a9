"""Names and manifests over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import fields
from lodestrata.operators import naming
from lodestrata.plans.registry import query, table

_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({s}) + 1), lambda i: ascii(substr({s}, i, 1))::BIGINT)),
 lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)), 4294967295::BIGINT)"""


@query(f"SELECT p_partkey, {_CRC.format(s='upper(p_name)')} AS hash FROM part")
def name_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", fields.name_hash(F.col("p_name")).alias("hash"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END AS name FROM customer"""
)
def catalog_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's hashed name against a catalogue of a third of them, through the hash alone."""
    entries = table(spark, sf_dir, "customer").select("c_custkey", fields.name_hash(F.col("c_name")).alias("crc"))
    known = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 3 == 0)
    catalog = known.select(fields.name_hash(F.col("c_name")).alias("hash"), F.col("c_name").alias("name")).groupBy("hash").agg(F.max("name").alias("name"))
    return naming.resolve(entries, catalog).select("c_custkey", "name")


@query(
    """WITH w AS (SELECT DISTINCT p_brand AS code FROM part), t AS (SELECT DISTINCT p_type AS kind FROM part),
    made AS (SELECT code, code || '/' || kind AS name FROM w, t), have AS (SELECT DISTINCT p_brand || '/' || p_type AS name FROM part WHERE p_size <= 10)
    SELECT code, count(*) AS hits FROM made JOIN have USING (name) GROUP BY code HAVING count(*) >= 4"""
)
def discover_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    entries = part.where(F.col("p_size") <= 10).select(fields.name_hash(F.concat_ws("/", "p_brand", "p_type")).alias("crc"))
    templates = part.select(F.concat(F.lit("{c}/"), F.col("p_type")).alias("template")).distinct()  # a handful of types
    return naming.discover(part.select(F.col("p_brand").alias("code")).distinct(), templates, entries)


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def bank_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("crc"))
    return naming.existing(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey")


@query(
    """SELECT p_partkey, CASE WHEN p_type = '' THEN 'unnamed' WHEN starts_with(p_type, 'S') THEN 'plain' WHEN starts_with(p_type, 'PROMO') THEN 'promo' WHEN starts_with(p_type, 'P') THEN 'p'
    WHEN starts_with(p_type, 'E') THEN 'economy' ELSE 'other' END AS category FROM part"""
)
def category_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("S", "plain"), ("PROMO", "promo"), ("P", "p"), ("E", "economy")]
    return table(spark, sf_dir, "part").select("p_partkey", naming.category(F.col("p_type"), rules).alias("category"))


@query(
    """SELECT page_id, CASE WHEN x <> '' THEN x::BIGINT END AS "index" FROM (SELECT page_id, regexp_extract(replace(regexp_extract(url, '([0-9]+)[^0-9/]*$', 0), '?', '_'), '^(\\d+)_', 1) AS x FROM pages)"""
)
def leading_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.replace(F.regexp_extract("url", "([0-9]+)[^0-9/]*$", 0), F.lit("?"), F.lit("_"))
    return table(spark, sf_dir, "pages").select("page_id", fields.leading_index(last).alias("index"))


@query(
    """SELECT count(*) FILTER (o AND n AND a = b) AS same, count(*) FILTER (o AND n AND a <> b) AS differing, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (o IS NULL) AS extra FROM
    (SELECT doc_id, md5(text) AS a, true AS o FROM documents WHERE doc_id % 10 <> 3) FULL JOIN
    (SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS b, true AS n FROM documents WHERE doc_id % 11 <> 5) USING (doc_id)"""
)
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = docs.where(F.col("doc_id") % 10 != 3).select("doc_id", F.md5("text").alias("digest"))
    new = docs.where(F.col("doc_id") % 11 != 5).select("doc_id", F.md5(changed).alias("digest"))
    return naming.manifest_diff(old, new, ["doc_id"], "digest")


@query("SELECT doc_id FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1)")
def dup_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"))
    twice = digests.groupBy(F.col("hash").alias("crc")).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return naming.existing(digests, twice).select("doc_id")
