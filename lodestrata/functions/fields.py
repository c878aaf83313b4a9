"""Fixed-layout field decoding, hashes and small scalar functions, all as Catalyst expressions.

Offsets count bytes from 0. A field that reaches past the end of its record is
null, never a short read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hex(data: Column, offset, size: int) -> Column:
    offset = offset if isinstance(offset, Column) else F.lit(offset)
    part = F.hex(F.substring(data, offset + 1, F.lit(size)))
    return F.when((F.octet_length(data) >= offset + size) & (offset >= 0), part)


def _swapped(digits: Column, size: int) -> Column:
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])


def be(data: Column, offset, size: int) -> Column:
    """The big-endian unsigned integer of `size` bytes (at most 7) at an offset, as BIGINT."""
    return F.conv(_hex(data, offset, size), 16, 10).cast("bigint")


def le(data: Column, offset, size: int) -> Column:
    """The little-endian unsigned integer. The pairs of hex digits are put in order; reverse() would take characters."""
    return F.conv(_swapped(_hex(data, offset, size), size), 16, 10).cast("bigint")


def be16(data: Column, offset) -> Column:
    return be(data, offset, 2)


def be32(data: Column, offset) -> Column:
    return be(data, offset, 4)


def le32(data: Column, offset) -> Column:
    return le(data, offset, 4)


def bits(value: Column, low: int, size: int) -> Column:
    """`size` bits of an integer from bit `low` up."""
    return F.shiftright(value, low).bitwiseAND(F.lit((1 << size) - 1))


def utf16be(data: Column) -> Column:
    return F.decode(data, "UTF-16BE")


def latin1(data: Column) -> Column:
    """One character a byte: the form on which byte positions can be searched."""
    return F.decode(data, "ISO-8859-1")


# ---- hashes --------------------------------------------------------------------------------------


def name_hash(name: Column) -> Column:
    """The archive key of a name: CRC-32 of its upper case, extension included."""
    return F.crc32(F.encode(F.upper(name), "UTF-8"))


def stem_hash(name: Column) -> Column:
    """The manifest key: CRC-32 of the lower-case name without its extension."""
    return F.crc32(F.encode(F.lower(F.regexp_replace(name, r"\.[^.]*$", "")), "UTF-8"))


def raw_hash(name: Column) -> Column:
    """CRC-32 without case folding."""
    return F.crc32(F.encode(name, "UTF-8"))


def byte_values(data: Column) -> Column:
    """The bytes as an array of integers."""
    return F.transform(F.filter(F.split(F.hex(data), "(?<=\\G..)"), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("bigint"))


_WORD = (1 << 32) - 1


def _times(acc: Column, factor: int) -> Column:
    """acc * factor mod 2^32 without overflow of BIGINT (both below 2^32)."""
    high = (F.shiftright(acc, 16) * factor).bitwiseAND(F.lit(0xFFFF))
    return (F.shiftleft(high, 16) + acc.bitwiseAND(F.lit(0xFFFF)) * factor).bitwiseAND(F.lit(_WORD))


def legacy_hash(data: Column, kind: str) -> Column:
    """One of the 32-bit string hashes that archives of the time use, over bytes."""
    start, step = {
        "fnv1": (0x811C9DC5, lambda a, b: _times(a, 0x01000193).bitwiseXOR(b)),
        "fnv1a": (0x811C9DC5, lambda a, b: _times(a.bitwiseXOR(b), 0x01000193)),
        "djb2": (5381, lambda a, b: (a * 33 + b).bitwiseAND(F.lit(_WORD))),
        "djb2_xor": (5381, lambda a, b: (a * 33).bitwiseXOR(b).bitwiseAND(F.lit(_WORD))),
        "sdbm": (0, lambda a, b: (b + a * 65599).bitwiseAND(F.lit(_WORD))),
    }.get(kind, (None, None))
    if step:
        return F.aggregate(byte_values(data), F.lit(start).cast("bigint"), step)
    if kind == "crc32":
        return F.crc32(data)
    if kind == "not_crc32":
        return F.crc32(data).bitwiseXOR(F.lit(_WORD))
    if kind == "adler32":
        pair = F.struct(F.lit(1).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
        step = lambda s, x: F.struct(((s["a"] + x) % 65521).alias("a"), ((s["b"] + s["a"] + x) % 65521).alias("b"))
        return F.aggregate(byte_values(data), pair, step, lambda s: s["b"] * 65536 + s["a"])
    raise ValueError(kind)


LEGACY = ("fnv1", "fnv1a", "djb2", "djb2_xor", "sdbm", "crc32", "not_crc32", "adler32")


def normalised(name: Column, kind: str) -> Column:
    """A written form of a name, as bytes, under which it may have been hashed."""
    made = {
        "asis": lambda: F.encode(name, "UTF-8"),
        "lower": lambda: F.encode(F.lower(name), "UTF-8"),
        "upper": lambda: F.encode(F.upper(name), "UTF-8"),
        "backslash": lambda: F.encode(F.replace(name, F.lit("/"), F.lit("\\")), "UTF-8"),
        "utf16le": lambda: F.encode(name, "UTF-16LE"),
        "utf16be": lambda: F.encode(name, "UTF-16BE"),
        "stem": lambda: F.encode(F.lower(F.regexp_replace(name, r"\.[^.]*$", "")), "UTF-8"),
    }
    return made[kind]()


NORMALISERS = ("asis", "lower", "upper", "backslash", "utf16le", "utf16be", "stem")

# ---- classification ------------------------------------------------------------------------------

# Magic numbers and their labels, in the order of precedence.
MAGICS = (
    ("FF3BEF94", "package"),
    ("0E4837C3", "block"),
    ("E4791207", "manifest"),
    ("08000000", "audio"),
    ("02000100", "scene"),
    ("F0985030", "table"),
)


# The wide signatures in the order of precedence, as (prefixes, label); "=" stands before a whole head.
SIGNATURES = (
    (("AA00B3BF",), "AA00B3BF-arc"),
    (("58455832",), "XEX2-executable"),
    (("50495253", "4C495645", "434F4E20"), "STFS-package"),
    (("44445320",), "DDS-texture"),
    (("52494646",), "RIFF"),
    (("58574200", "5742"), "XWB-wavebank"),
    (("584D41",), "XMA-audio"),
    (("4F676753",), "OGG-audio"),
    (("42494B69", "=42494B"), "BINK-video"),
    (("89504E47",), "PNG"),
    (("424D",), "BMP?"),
    (("62686400", "626E6B00"), "bank"),
    (("504B",), "ZIP"),
    (("1F8B",), "GZIP"),
    (("789C", "7801", "78DA"), "ZLIB"),
    (("46534234", "46534235"), "FMOD-FSB"),
    (("0000000C6A502020",), "JP2"),
    (("52534600",), "RSF"),
    (("4E555031", "4E555333"), "NUS3"),
)


def classify(head: Column) -> Column:
    """The label of a record by its first twelve bytes: the magics, the wide signatures, else a printable tag of four bytes; an empty head is the empty tag.

    RIFF names its form, the bytes from 8 on; a head that ends with the four letters has none and is a tag.
    """
    digits = F.hex(F.substring(head, 1, 12))
    out = F.when(F.octet_length(head) == 0, F.lit("tag:"))
    for magic, label in MAGICS:
        out = out.when(F.startswith(digits, F.lit(magic)), F.lit(label))
    for heads, label in SIGNATURES:
        for h in heads:
            if label == "RIFF":
                out = out.when(F.startswith(digits, F.lit(h)) & (F.octet_length(head) > 4), F.concat(F.lit("RIFF("), latin1(F.substring(head, 9, 4)), F.lit(")")))
            else:
                out = out.when(digits == h[1:] if h.startswith("=") else F.startswith(digits, F.lit(h)), F.lit(label))
    tag = latin1(F.substring(head, 1, 4))
    return out.when(tag.rlike(r"\A[\x20-\x7e]+\z"), F.concat(F.lit("tag:"), tag)).otherwise(F.lit("UNKNOWN"))


def seconds(samples: Column, rate: Column) -> Column:
    return F.when(rate == 0, F.lit(0.0)).otherwise(samples / rate)


def stream_channels(packet: Column) -> Column:
    """1 where the eighth byte of the stream is 3, else 2."""
    return F.when(F.hex(F.substring(packet, 8, 1)) == "03", 1).otherwise(2)


def leading_index(name: Column) -> Column:
    """The number before the first underscore, else null."""
    found = F.regexp_extract(name, r"^(\d+)_", 1)
    return F.when(found != "", found.cast("bigint"))


# ---- texture sizes -------------------------------------------------------------------------------

# GPU format code -> (kind, bytes a block, block edge).
GPU_FORMATS = {
    0x12: ("DXT1", 8, 4),
    0x13: ("DXT3", 16, 4),
    0x14: ("DXT5", 16, 4),
    0x06: ("ARGB", 4, 1),
    0x04: ("RGB565", 2, 1),
    0x0F: ("ARGB4444", 2, 1),
    0x02: ("L8", 1, 1),
    0x31: ("ATI2", 16, 4),
    0x0A: ("RG8", 2, 1),
    0x3A: ("DXT3A", 8, 4),
    0x3B: ("DXT5A", 8, 4),
}


def tex_size(width: Column, height: Column, block_bytes: Column, edge: Column) -> Column:
    """Bytes of a level: whole blocks rounded down, one at least each way."""
    return F.greatest(F.lit(1), F.floor(width / edge)) * F.greatest(F.lit(1), F.floor(height / edge)) * block_bytes


def padded(side: Column, edge: Column) -> Column:
    """A side padded to whole macro tiles of 32 blocks, in texels."""
    return F.ceil(F.greatest(F.lit(1), F.floor(side / edge)) / 32) * 32 * edge


def padded_size(width: Column, height: Column, block_bytes: Column, edge: Column) -> Column:
    return F.greatest(F.lit(0x1000), tex_size(padded(width, edge), padded(height, edge), block_bytes, edge))
