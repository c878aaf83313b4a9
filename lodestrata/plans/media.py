"""Textures, sound banks, packets and saves packed from the driver's tables and read back by the library."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import audio, lzss, pixels
from lodestrata.operators import archives, roster, textures
from lodestrata.plans.registry import query, spread, table
from lodestrata.sources import writer

#: The textures of each package: width, height, format code, kind, bytes of its linear data.
_TEXTURES = ((64, 64, 0x06, "ARGB", 16384), (64, 64, 0x12, "DXT1", 2048), (128, 64, 0x14, "DXT5", 8192), (128, 128, 0x06, "ARGB", 65536))


def _texture_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, data): a package an item, its textures' linear data being digests of its text, over and over."""

    def run(batches):
        for batch in batches:
            made = []
            for t in batch.column(1).to_pylist():
                made.append(writer.package([(w, h, fmt, (t.encode() * (size // 32))) for w, h, fmt, _, size in _TEXTURES]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["idx", "data"])

    items = spread(table(spark, sf_dir, "benchmark")).select(F.col("item_id").alias("idx"), F.md5(F.encode("text", "UTF-8")).alias("d"))
    return items.mapInArrow(run, "idx long, data binary")


def _expected(digest: str) -> str:
    each = " UNION ALL ".join(f"SELECT item_id AS idx, {k} AS slot, {w} AS w, {h} AS h, '{kind}' AS kind, {size} AS bytes, {digest if k == 0 else 'md5(text)'} AS d FROM benchmark" for k, (w, h, _, kind, size) in enumerate(_TEXTURES))
    return f"SELECT idx, w::INT AS w, h::INT AS h, kind, bytes::BIGINT AS bytes, md5(repeat(d, bytes // 32)) AS digest FROM ({each})"


def _described(rows: DataFrame) -> DataFrame:
    size = F.octet_length("data") - 128
    return rows.select("idx", "w", "h", "kind", size.cast("long").alias("bytes"), F.md5(F.substring("data", F.lit(129), size)).alias("digest"))


@query(_expected("md5(text)"))
def texture_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptor tables found, placed, read, untiled, cropped and given headers, for every package."""
    return _described(textures.texture_files(_texture_packages(spark, sf_dir)))


@query(_expected("md5(reverse(md5(text)))"))
def texture_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first texture of every package replaced, the entry rebuilt around it, and all textures extracted again."""

    def run(batches):
        for batch in batches:
            made = []
            for raw, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                linear = np.frombuffer(d.encode() * (_TEXTURES[0][4] // 32), np.uint8).reshape(64, 64, 4)
                made.append(textures.replace(raw, {0: linear[..., [2, 1, 0, 3]]}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["idx", "data"])

    new = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("idx"), F.md5(F.encode(F.reverse(F.md5(F.encode("text", "UTF-8"))), "UTF-8")).alias("d"))
    rows = _texture_packages(spark, sf_dir).join(new, "idx").select("idx", "data", "d")
    return _described(textures.texture_files(rows.mapInArrow(run, "idx long, data binary")))


@query("SELECT item_id, n::INT AS level, ('0x' || substr(md5(text), 1 + 2 * n, 2))::INT AS grey FROM (SELECT item_id, text, unnest(range(0, 16)) AS n FROM benchmark)")
def grey_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen grey texels of each item, written as single-channel blocks by palette and read back exactly where the ends allow: flat blocks of one value each."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(bytes.fromhex(d), np.uint8)
                image = np.repeat(np.repeat(values.reshape(4, 4), 4, 0), 4, 1)
                rgba = np.stack([image] * 3 + [np.full_like(image, 255)], -1)
                back = pixels.decode(pixels.encode(rgba, "DXT5A"), 16, 16, "DXT5A")
                rows += [{"item_id": key, "level": k, "grey": int(back[4 * (k // 4), 4 * (k % 4), 0])} for k in range(16)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("item_id", pa.int64()), ("level", pa.int32()), ("grey", pa.int32())]))

    items = table(spark, sf_dir, "benchmark").select("item_id", F.md5(F.encode("text", "UTF-8")).alias("d"))
    return items.mapInArrow(run, "item_id long, level int, grey int")


# ---- audio ---------------------------------------------------------------------------------------


@query(
    """SELECT doc_id, k::INT AS packet, ((u >> 26) & 63)::BIGINT AS frames, ((u >> 11) & 32767)::BIGINT AS skip, ((u >> 8) & 7)::BIGINT AS meta, (u & 255)::BIGINT AS packets FROM
    (SELECT doc_id, k, ('0x' || substr(h, 4096 * k + 1, 8))::BIGINT AS u FROM (SELECT doc_id, hex(encode(text)) AS h, unnest(range(0, octet_length(encode(text)) // 2048)) AS k FROM documents))"""
)
def packet_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bit fields at every 2,048 bytes of every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    rows = docs.select("doc_id", F.posexplode(audio.packet_headers(F.col("b"))).alias("packet", "x"))
    return rows.select("doc_id", "packet", *[F.col(f"x.{c}").cast("long").alias(c) for c in ("frames", "skip", "meta", "packets")])


@query("SELECT doc_id, md5(text) AS digest, md5(text) AS plain FROM documents")
def riff_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as packets in a WAVE file, found again by its chunks; bytes that are no such file come back as they are."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.encode("text", "UTF-8").alias("b"))
    made = docs.withColumn("r", audio.riff_udf("b", F.lit(2), F.lit(48000)))
    return made.select("doc_id", F.md5(audio.packets_udf("r")).alias("digest"), F.md5(audio.packets_udf("b")).alias("plain"))


_BANK = "doc_id % (SELECT count(*) // 256 + 1 FROM documents)"


@query(
    f"""SELECT bank::VARCHAR AS bank, (row_number() OVER w - 1)::BIGINT AS "index", 48000::BIGINT AS rate, size::BIGINT AS size, coalesce(sum(size) OVER (PARTITION BY bank ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
    (2 * n_chars)::BIGINT AS samples, (2 * n_chars / 48000.0)::DOUBLE AS seconds, md5(text) AS digest FROM (SELECT *, {_BANK} AS bank, octet_length(encode(text)) AS size FROM documents) WINDOW w AS (PARTITION BY bank ORDER BY doc_id)"""
)
def sound_banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banks of some 256 sounds each (a compressed table of records, then the payloads), parsed and sliced."""

    def make(key, group):
        group = group.sort_by("doc_id")
        data = [d or b"" for d in group.column("b").to_pylist()]
        table_ = b"".join(struct.pack(">11I", 0, 0, 0, n, 48000, 0, len(d), 0, 0, 0, 0) for d, n in zip(data, group.column("samples").to_pylist()))
        return pa.table({"bank": [str(key[0].as_py())], "data": pa.array([lzss.block(table_) + b"".join(data)], pa.binary())})

    docs = table(spark, sf_dir, "documents")
    rows = docs.select((F.col("doc_id") % (docs.count() // 256 + 1)).alias("bank"), "doc_id", F.encode("text", "UTF-8").alias("b"), (2 * F.col("n_chars")).alias("samples"))
    banks = rows.groupBy("bank").applyInArrow(make, "bank string, data binary")
    return archives.sounds(banks, "bank").select("bank", "index", "rate", "size", "offset", "samples", "seconds", F.md5("data").alias("digest"))


# ---- saves ---------------------------------------------------------------------------------------

_TEAMS = ", ".join(f"'{t}'" for t in roster.TEAMS)


def _colours(spark: SparkSession, sf_dir: str, edit: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            for key, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                save = roster.blank([(name[k : k + 6], name[k + 1 : k + 7]) for k in range(25)] + [(name[:6], name[-6:])] * 35)
                if edit:
                    save = roster.with_colour(save, "BOS", primary="abcdef")
                rows += [{"s_suppkey": key, **x} for x in roster.team_colours(save)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("s_suppkey", pa.int64()), ("team", pa.string()), ("primary", pa.string()), ("secondary", pa.string())]))

    rows = spread(table(spark, sf_dir, "supplier")).select("s_suppkey", F.md5(F.encode("s_name", "UTF-8")).alias("d"))
    return rows.mapInArrow(run, "s_suppkey long, team string, primary string, secondary string")


_ROSTER = f"""SELECT s_suppkey, team, {{primary}} AS "primary", CASE WHEN k <= 25 THEN substr(d, k + 1, 6) ELSE substr(d, 27, 6) END AS secondary
    FROM (SELECT s_suppkey, md5(s_name) AS d, unnest([{_TEAMS}]) AS team, unnest(range(1, 31)) AS k FROM supplier)"""
_PRIMARY = "CASE WHEN k <= 25 THEN substr(d, k, 6) ELSE substr(d, 1, 6) END"


@query(_ROSTER.format(primary=_PRIMARY))
def roster_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk directory, the colour table and the thirty teams' colours of a save a supplier."""
    return _colours(spark, sf_dir, edit=False)


@query(_ROSTER.format(primary=f"CASE WHEN team = 'BOS' THEN 'abcdef' ELSE {_PRIMARY} END"))
def roster_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _colours(spark, sf_dir, edit=True)
