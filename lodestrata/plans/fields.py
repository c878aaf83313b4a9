"""Scalar functions, hashes and names over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import fields, pixels
from lodestrata.operators import layout, mining, naming
from lodestrata.plans.naming import _CRC
from lodestrata.plans.registry import query, spread, table

_SIZES = ", ".join(f"({code}, '{kind}', {size}, {edge})" for code, (kind, size, edge) in fields.GPU_FORMATS.items())


@query(
    f"""WITH f AS (SELECT * FROM (VALUES {_SIZES}) AS t(code, kind, bytes, edge)), p AS (SELECT p_partkey, p_size * 7 + 1 AS w, p_size * 3 + 2 AS h, p_partkey % 11 AS slot FROM part),
    g AS (SELECT *, row_number() OVER (ORDER BY code) - 1 AS slot FROM f), x AS (SELECT p_partkey, kind, bytes, edge, w, h, greatest(1, w // edge) AS bw, greatest(1, h // edge) AS bh FROM p JOIN g USING (slot))
    SELECT p_partkey, kind, (bw * bh * bytes)::BIGINT AS size, ((bw + 31) // 32 * 32 * edge)::BIGINT AS padded_w, ((bh + 31) // 32 * 32 * edge)::BIGINT AS padded_h,
    greatest(4096, ((bw + 31) // 32 * 32) * ((bh + 31) // 32 * 32) * bytes)::BIGINT AS padded_size FROM x"""
)
def texture_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level sizes of every format of the lookup, in whole blocks and macro tiles."""
    known = [(code, kind, size, edge, slot) for slot, (code, (kind, size, edge)) in enumerate(sorted(fields.GPU_FORMATS.items()))]
    formats = F.broadcast(spark.createDataFrame(known, "code int, kind string, bytes int, edge int, slot long"))
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 7 + 1).alias("w"), (F.col("p_size") * 3 + 2).alias("h"), (F.col("p_partkey") % 11).alias("slot"))
    args = F.col("w"), F.col("h"), F.col("bytes"), F.col("edge")
    made = {"size": fields.tex_size(*args), "padded_w": fields.padded(F.col("w"), F.col("edge")), "padded_h": fields.padded(F.col("h"), F.col("edge")), "padded_size": fields.padded_size(*args)}
    return parts.join(formats, "slot").select("p_partkey", "kind", *[c.cast("long").alias(n) for n, c in made.items()])


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 0.0 ELSE (o_orderkey % 100000) / ((o_custkey % 5) * 8000.0)::DOUBLE END::DOUBLE AS seconds FROM orders")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", fields.seconds((F.col("o_orderkey") % 100000).cast("double"), (F.col("o_custkey") % 5 * 8000).cast("double")).cast("double").alias("seconds"))


@query("SELECT doc_id, CASE WHEN substr(hex(encode(text)), 15, 2) = '03' THEN 1 ELSE 2 END AS spaced, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS marked FROM documents WHERE octet_length(encode(text)) >= 8")
def stream_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels by the eighth byte: of texts as they are, and with a byte 3 put there in a third of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b")).where(F.octet_length("b") >= 8)
    third = F.overlay("b", F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("03"))).otherwise(F.unhex(F.lit("04"))), F.lit(8))
    return docs.select("doc_id", fields.stream_channels(F.col("b")).alias("spaced"), fields.stream_channels(third).alias("marked"))


@query(f"SELECT p_partkey, {_CRC.format(s='lower(p_name)')} AS stem, {_CRC.format(s='p_name')} AS raw FROM part")
def manifest_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest's hash of a name with an extension, and the hash without case folding."""
    return table(spark, sf_dir, "part").select("p_partkey", fields.stem_hash(F.concat("p_name", F.lit(".iff"))).alias("stem"), fields.raw_hash(F.col("p_name")).alias("raw"))


_ORDS = "list_transform(range(1, length(c_name) + 1), lambda i: ascii(substr(c_name, i, 1))::BIGINT)"
_FOLD = "list_reduce(list_prepend({start}::BIGINT, " + _ORDS + "), lambda a, b: {step})"


@query(
    "SELECT c_custkey, "
    + ", ".join(
        f"{_FOLD.format(start=start, step=step)} AS {name}"
        for name, start, step in (
            ("fnv1", 2166136261, "xor((a * 16777619) & 4294967295, b)"),
            ("fnv1a", 2166136261, "(xor(a, b) * 16777619) & 4294967295"),
            ("djb2", 5381, "(a * 33 + b) & 4294967295"),
            ("djb2_xor", 5381, "xor((a * 33) & 4294967295, b)"),
            ("sdbm", 0, "(b + a * 65599) & 4294967295"),
        )
    )
    + f", {_CRC.format(s='c_name')} AS crc32, 4294967295 - ({_CRC.format(s='c_name')}) AS not_crc32 FROM customer"
)
def legacy_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer")
    data = fields.normalised(F.col("c_name"), "asis")
    return names.select("c_custkey", *[fields.legacy_hash(data, k).alias(k) for k in ("fnv1", "fnv1a", "djb2", "djb2_xor", "sdbm", "crc32", "not_crc32")])


@query(
    """SELECT c_custkey, hex(encode(c_name)) AS asis, hex(encode(lower(c_name))) AS lower, hex(encode(upper(c_name))) AS upper, hex(encode(replace('a/' || c_name, '/', chr(92)))) AS backslash,
    regexp_replace(hex(encode(c_name)), '(..)', '\\1' || '00', 'g') AS utf16le, regexp_replace(hex(encode(c_name)), '(..)', '00' || '\\1', 'g') AS utf16be, hex(encode(lower(c_name))) AS stem FROM customer"""
)
def normalised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written forms under which a name may have been hashed, as bytes."""
    names = table(spark, sf_dir, "customer")
    given = {"backslash": F.concat(F.lit("a/"), F.col("c_name")), "stem": F.concat(F.col("c_name"), F.lit(".iff"))}
    return names.select("c_custkey", *[F.hex(fields.normalised(given.get(k, F.col("c_name")), k)).alias(k) for k in fields.NORMALISERS])


@query("SELECT doc_id, unnest(regexp_extract_all(text, '[ -~]{5,}')) AS text FROM documents")
def ascii_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printable runs of every whole text's bytes."""
    return mining.ascii_strings(table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data")))


@query("SELECT c_custkey, unnest(regexp_extract_all(c_name, '[ -~]{4,}')) AS text FROM customer")
def utf16_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names found again in big-endian UTF-16 between other bytes."""
    data = F.concat(F.unhex(F.lit("0102FF")), F.encode("c_name", "UTF-16BE"), F.unhex(F.lit("FFFF")))
    return mining.utf16_strings(table(spark, sf_dir, "customer").select("c_custkey", data.alias("data")))


@query("SELECT p_partkey, 'out/' || CASE WHEN p_partkey % 4 = 0 THEN 'unnamed/' || lpad(p_partkey::VARCHAR, 5, '0') WHEN p_partkey % 4 = 1 THEN 'other/' || p_name WHEN p_partkey % 4 = 2 THEN 'logos/logo_' || p_partkey ELSE 'jerseys/overlay/uniform_' || p_partkey END AS path FROM part WHERE p_partkey < 100000")
def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of exported names; the extension goes whatever its case, and an entry without name goes by its index."""
    part = table(spark, sf_dir, "part").where("p_partkey < 100000")  # the index has five digits
    key = F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 4
    name = F.when(kind == 0, F.lit("")).when(kind == 1, F.concat("p_name", F.lit(".IFF"))).when(kind == 2, F.concat(F.lit("logo_"), key, F.lit(".iff"))).otherwise(F.concat(F.lit("uniform_"), key))
    return part.select("p_partkey", naming.output_path("out", F.col("p_partkey"), name).alias("path"))


@query("SELECT n_name, min(c_custkey) AS \"index\" FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def first_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entry of each name, found by the name's hash."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    entries = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    entries = entries.select(F.col("c_custkey").alias("index"), fields.name_hash(F.col("n_name")).alias("crc"))
    return naming.first_entry(entries, nation.select(F.col("n_name").alias("name"))).select(F.col("name").alias("n_name"), "index")


@query(
    f"""WITH c AS (SELECT unnest({list(naming.CODES)}) AS code), t AS (SELECT unnest({list(naming.TEMPLATES)}) AS form), g AS (SELECT unnest({list(naming.GLOBALS)}) AS name)
    SELECT DISTINCT replace(replace(form, '{{c}}', code), '{{}}', code) AS name FROM c, t UNION SELECT name FROM g"""
)
def catalogue_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidate names: codes by templates, and the names that belong to no code."""
    return naming.catalogue(spark).select("name")


@query(
    """WITH o AS (SELECT source, doc_id, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM documents)
    SELECT source, doc_id, name, ("offset" - start)::BIGINT AS inside FROM o JOIN (SELECT unnest(['0A', '0B', '1A', '1B']) AS name, unnest([0, 16384, 65536, 98304]) AS start, unnest([16384, 49152, 32768, 1000000000000]) AS size) ON "offset" >= start AND "offset" < start + size"""
)
def locate_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of four unequal split files holds each offset of the stream, and where in it."""
    splits = spark.createDataFrame([("0A", 0, 16384), ("0B", 16384, 49152), ("1A", 65536, 32768), ("1B", 98304, 10**12)], "name string, start long, size long")
    rows = layout.prefix_offsets(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "n_chars", ["doc_id"], ["source"])
    return layout.locate(rows, splits, "offset").select("source", "doc_id", "name", (F.col("offset") - F.col("start")).alias("inside"))


@query("SELECT doc_id, md5(text) AS digest, regexp_replace(substr(hex(encode(text)), 1, 8), '(..)(..)(..)(..)', '\\4\\3\\2\\1') AS head FROM documents WHERE octet_length(encode(text)) >= 4")
def swap_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-byte words reversed, a shorter tail left as it is; twice is nothing."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.encode("text", "UTF-8").alias("b")).where(F.octet_length("b") >= 4)
    once = docs.withColumn("s", pixels.swap_udf("b", F.lit(4)))
    return once.select("doc_id", F.md5(pixels.swap_udf("s", F.lit(4))).alias("digest"), F.hex(F.substring("s", 1, 4)).alias("head"))
