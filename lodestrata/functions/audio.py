"""Audio containers: packet headers, RIFF chunks, sound banks."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions import fields, lzss

# Bytes a packet, samples a packet, bytes a bank record, format tags of the codec.
PACKET, SAMPLES, RECORD = 2048, 512, 44
TAGS = (0x0166, 0x0165)


def riff(data: bytes, channels: int, rate: int, streams: int = 1, block: int = 65536) -> bytes:
    """A WAVE file around packets: a 52-byte format chunk and the data."""
    n = len(data)
    samples = n // PACKET * SAMPLES
    form = struct.pack("<HHIIHHH", TAGS[0], channels, rate, rate * channels * 2, PACKET, 16, 34)
    form += struct.pack("<HIIIIIIIBBH", streams, 0, samples, block, 0, samples, 0, 0, 0, 4, max(1, -(-n // block)))
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", n) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def riff_chunks(raw: bytes) -> list[tuple[bytes, bytes]]:
    """(name, body) of a file's chunks, even-padded."""
    out, at = [], 12
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        out.append((name, raw[at + 8 : at + 8 + size]))
        at += 8 + size + size % 2
    return out


def packets_of(raw: bytes) -> bytes:
    """The packets in a WAVE file (the last chunk of a name counts); other bytes as they are."""
    if raw[:4] != b"RIFF":
        return raw
    chunks = dict(riff_chunks(raw))
    form, data = chunks.get(b"fmt "), chunks.get(b"data")
    if form is None or data is None or struct.unpack_from("<H", form)[0] not in TAGS:
        raise ValueError("not a file of this codec")
    return data


def packet_headers(data: Column) -> Column:
    """An array of (frames, skip, meta, packets) of each packet, for explode."""
    count = F.floor(F.octet_length(data) / PACKET)
    heads = F.transform(F.sequence(F.lit(0), count - 1), lambda k: fields.be32(data, (k * PACKET).cast("int")))
    made = F.transform(heads, lambda u: F.struct(fields.bits(u, 26, 6).alias("frames"), fields.bits(u, 11, 15).alias("skip"), fields.bits(u, 8, 3).alias("meta"), fields.bits(u, 0, 8).alias("packets")))
    return F.when(count > 0, made).otherwise(F.slice(made, 1, 0))


def parse_bank(raw: bytes) -> tuple[list[dict], int]:
    """(sounds, where the packets begin) of a bank entry; a sound's offset is the sum of the sizes before it."""
    blocks = lzss.find_blocks(raw)
    if not blocks:
        raise ValueError("no record table")
    table, _ = lzss.unpack_entry(raw)
    if len(table) % RECORD:
        raise ValueError(f"a table of {len(table)} bytes")
    out, offset = [], 0
    for k in range(len(table) // RECORD):
        f = struct.unpack_from(">11I", table, RECORD * k)
        out.append({"index": k, "channels": 0, "rate": f[4], "size": f[6], "offset": offset, "samples": f[3], "flags": f[8], "seconds": f[3] / f[4] if f[4] else 0.0})
        offset += f[6]
    return out, blocks[-1][0] + blocks[-1][2]


def read_sound(raw: bytes, sound: dict, payload: int) -> bytes:
    at = payload + sound["offset"]
    return raw[at : at + sound["size"]]


@F.pandas_udf(T.BinaryType())
def riff_udf(data: pd.Series, channels: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else riff(bytes(d), int(c), int(r)) for d, c, r in zip(data, channels, rate)], dtype=object)


@F.pandas_udf(T.BinaryType())
def packets_udf(data: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else packets_of(bytes(d)) for d in data], dtype=object)
