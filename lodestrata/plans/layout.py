"""Placement and order over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import fields
from lodestrata.operators import layout
from lodestrata.plans.registry import query, table

SPLIT = 65536
_OFFSETS = "SELECT source, doc_id, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM documents"


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return layout.prefix_offsets(docs, "n_chars", ["doc_id"], ["source"])


@query(_OFFSETS)
def prefix_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offsets(spark, sf_dir)


@query(
    f"""WITH o AS ({_OFFSETS}) SELECT source, doc_id, "offset", coalesce(lead("offset") OVER (PARTITION BY source ORDER BY "offset", doc_id), "end") - "offset" AS size
    FROM o JOIN (SELECT source, sum(n_chars)::BIGINT AS "end" FROM documents GROUP BY source) USING (source)"""
)
def lead_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _offsets(spark, sf_dir)
    ends = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("end"))
    sized = layout.sizes_from_offsets(rows.join(ends, "source"), "offset", F.col("end"), ["doc_id"], ["source"])
    return sized.select("source", "doc_id", "offset", "size")


@query(
    f"""WITH o AS ({_OFFSETS}), s AS (SELECT source, unnest(range(0, (max("offset") // {SPLIT}) + 1)) AS split FROM o GROUP BY source)
    SELECT o.source, doc_id, "offset", split::BIGINT AS split, ("offset" - split * {SPLIT})::BIGINT AS inside FROM o JOIN s ON o.source = s.source AND "offset" >= split * {SPLIT} AND "offset" < (split + 1) * {SPLIT}"""
)
def split_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _offsets(spark, sf_dir)
    split = F.floor(F.col("offset") / SPLIT)  # equal splits: the range lookup is arithmetic
    return rows.select("source", "doc_id", "offset", split.alias("split"), (F.col("offset") - split * SPLIT).alias("inside"))


@query(
    f"""WITH o AS ({_OFFSETS}), s AS (SELECT source, unnest(range(0, max("offset" + n_chars) // {SPLIT} + 1)) AS split FROM o GROUP BY source)
    SELECT o.source, doc_id, split::BIGINT AS split, (greatest("offset", split * {SPLIT}) - split * {SPLIT})::BIGINT AS piece_start,
    (least("offset" + n_chars, (split + 1) * {SPLIT}) - greatest("offset", split * {SPLIT}))::BIGINT AS piece_size
    FROM o JOIN s ON o.source = s.source AND "offset" < (split + 1) * {SPLIT} AND "offset" + n_chars > split * {SPLIT}"""
)
def split_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = layout.split_pieces(_offsets(spark, sf_dir), SPLIT, "offset", "n_chars")
    return pieces.select("source", "doc_id", "split", "piece_start", "piece_size")


@query(
    """WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
    p AS (SELECT a.user_id, a.event_id, a.rn, min(b.rn) AS bn FROM r a JOIN r b ON a.user_id = b.user_id AND b.rn > a.rn AND b.rn <= a.rn + 8 AND b.event_type = 'purchase'
      WHERE a.event_type = 'view' GROUP BY ALL)
    SELECT p.user_id, p.event_id, c.event_id AS "then", (bn - p.rn)::INT AS distance FROM p JOIN r c ON c.user_id = p.user_id AND c.rn = bn
    WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.user_id = p.user_id AND x.event_type = 'view' AND x.rn > p.rn AND x.rn < bn)"""
)
def pair_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    found = layout.follows_within(events, "event_type", "view", "purchase", "event_id", ["user_id"], 8)
    return found.select("user_id", "event_id", "then", "distance")


@query(
    """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1"""
)
def journal_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return layout.keep_first(events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


_U32 = "('0x' || substr(hex(encode(text)), 1, 8))::BIGINT"
_LE32 = "('0x' || substr(hex(encode(text)), 7, 2) || substr(hex(encode(text)), 5, 2) || substr(hex(encode(text)), 3, 2) || substr(hex(encode(text)), 1, 2))::BIGINT"


@query(f"SELECT doc_id, CASE WHEN octet_length(encode(text)) >= 4 THEN {_U32} END AS be, CASE WHEN octet_length(encode(text)) >= 4 THEN {_LE32} END AS le FROM documents")
def be32_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.left("text", F.lit(4)), "UTF-8").alias("b"))
    return rows.select("doc_id", fields.be32(F.col("b"), 0).alias("be"), fields.le32(F.col("b"), 0).alias("le"))


@query(
    f"""SELECT doc_id, (u >> 26) & 63 AS frames, (u >> 11) & 32767 AS skip, (u >> 8) & 7 AS meta, u & 255 AS packets
    FROM (SELECT doc_id, {_U32} AS u FROM documents WHERE octet_length(encode(text)) >= 4)"""
)
def packet_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.left("text", F.lit(4)), "UTF-8").alias("b"))
    rows = rows.select("doc_id", fields.be32(F.col("b"), 0).alias("u")).where(F.col("u").isNotNull())
    parts = (("frames", 26, 6), ("skip", 11, 15), ("meta", 8, 3), ("packets", 0, 8))
    return rows.select("doc_id", *[fields.bits(F.col("u"), low, size).alias(c) for c, low, size in parts])
