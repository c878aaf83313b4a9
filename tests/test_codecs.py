"""Golden vectors from the written formats, round trips and hashes."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import audio, fields, lzss, pixels
from tests.fixtures import picture


@pytest.mark.parametrize(
    "tokens, size, want",
    [("02415001", 9, b"AAAAAAAAA"), ("086162631003", 7, b"abcabca"), ("086162630003", 6, b"abcabc"), ("00" + b"ABCDEFGH".hex(), 8, b"ABCDEFGH"), ("00" + b"ABCDEFGH".hex(), 5, b"ABCDEFGH")],
)
def test_golden_tokens(tokens, size, want):
    assert lzss.decode(bytes.fromhex(tokens), size, 12) == want


def test_golden_block_and_corrupt():
    raw = bytes.fromhex("0E4837C300000009000000180000000 70000000C02415001".replace(" ", ""))
    assert lzss.decode_block(raw) == b"AAAAAAAAA"
    with pytest.raises(lzss.CorruptBlock):
        lzss.decode(bytes.fromhex("010000"), 4, 12)
    with pytest.raises(lzss.CorruptBlock):
        lzss.decode(b"", 4, 12)
    long = b"\0" + b"ABCDEFGH"
    with pytest.raises(lzss.CorruptBlock):
        lzss.unpack_entry(struct.pack(">5I", lzss.BLOCK_MAGIC, 5, len(long) + 20, 0, 12) + long)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400) | st.text(alphabet="abc", max_size=600).map(str.encode), st.integers(6, 15))
def test_every_encoder_decodes(data, offbits):
    for encode in (lzss.encode_lazy, lzss.encode_optimal, lzss.encode_stored, lzss.encode_verified):
        tokens = encode(data, offbits)
        assert lzss.decode(tokens, len(data), offbits)[: len(data)] == data


def test_optimal_is_least_and_compresses():
    data = b"the quick brown fox jumps over the lazy dog, the quick brown fox " * 20
    assert len(lzss.encode_optimal(data)) <= len(lzss.encode_lazy(data)) < len(data) // 3 < len(lzss.encode_stored(data))


def test_prefix_reuse():
    old = bytes(range(256)) * 8
    new = old[:1500] + b"changed" + old[1507:]
    tokens = lzss.encode_lazy(old)
    at, made = lzss.reusable_prefix(tokens, old, new, 12)
    assert 0 < made <= 1500
    again = lzss.encode_verified(new, 12, (tokens, old))
    assert again[:at] == tokens[:at] and lzss.decode(again, len(new), 12)[: len(new)] == new


def longest_matches(data, offbits):
    n, most = len(data), (1 << (16 - offbits)) + 2
    out = []
    for at in range(n):
        best = 0
        for back in range(1, min(at, (1 << offbits) - 1) + 1):
            k = 0
            while k < most and at + k < n and data[at + k] == data[at - back + k]:
                k += 1
            best = max(best, k)
        out.append(best if best >= 3 else 0)
    return out


@pytest.mark.parametrize("offbits", [6, 9, 12])
def test_no_match_in_the_window_is_missed(offbits):
    r = np.random.default_rng(offbits)
    data = b"".join(b"abc" + r.integers(97, 100, 3, dtype=np.uint8).tobytes() + r.integers(0, 256, 2, dtype=np.uint8).tobytes() for _ in range(200)) + b"z" * 90
    best, where = lzss.matches(data, offbits)
    assert best.tolist() == longest_matches(data, offbits)
    assert all(data[k : k + 1] == data[k - b : k - b + 1] and b < 1 << offbits for k, b in enumerate(where.tolist()) if b)


def test_reuse_is_parsed_at_least_cost():
    r = np.random.default_rng(3)
    words = [r.integers(97, 123, k % 7 + 2, dtype=np.uint8).tobytes() for k in range(60)]
    old = b" ".join(words[k] for k in r.integers(0, 60, 1500))
    new = old[:40] + b"#" + old[41:]
    tokens = lzss.encode_optimal(old)
    again = lzss.encode_verified(new, 12, (tokens, old))
    assert lzss.decode(again, len(new), 12)[: len(new)] == new
    assert len(again) <= len(lzss.encode_optimal(new)) + 16 and len(again) < len(lzss.encode_lazy(new))


def test_block_scans_differ():
    a, b = lzss.block(b"hello hello hello"), lzss.block(b"x" * 50, 5 + 1)
    odd = struct.pack(">5I", lzss.BLOCK_MAGIC, 4, 30, 0, 40) + b"junk"
    raw = b"??" + a + odd + b
    assert [x[0] for x in lzss.find_blocks(raw)] == [2, 2 + len(a) + len(odd)]
    assert [x[0] for x in lzss.find_blocks(raw, strict=False)] == [2, 2 + len(a), 2 + len(a) + len(odd)]


@pytest.mark.parametrize("size", [(32, 32), (64, 64), (96, 32), (128, 64)])
@pytest.mark.parametrize("block", [4, 8, 16])
def test_tiling_is_a_permutation(size, block):
    order = pixels.tile_order(*size, block)
    assert sorted(order.tolist()) == list(range(size[0] * size[1]))
    data = np.random.default_rng(1).integers(0, 256, size[0] * size[1] * block, dtype=np.uint8).tobytes()
    assert pixels.tiled(pixels.tiled(data, *size, block), *size, block, inverse=True) == data != pixels.tiled(data, *size, block)


def test_published_palettes():
    assert pixels.palette8(np.array([210]), np.array([140]))[0].tolist() == [210, 140, 200, 190, 180, 170, 160, 150]
    assert pixels.palette8(np.array([0]), np.array([100]))[0].tolist() == [0, 100, 20, 40, 60, 80, 0, 255]


def psnr(a, b):
    return 10 * np.log10(255**2 / max(1e-9, ((a.astype(float) - b.astype(float)) ** 2).mean()))


@pytest.mark.parametrize("kind, channels, least", [("DXT1", 3, 30), ("DXT3", 4, 30), ("DXT5", 4, 30), ("ATI2", 2, 36), ("DXT5A", 1, 36), ("DXT3A", 1, 26), ("ARGB", 4, 90), ("RGB565", 3, 30), ("ARGB4444", 4, 22), ("L8", 1, 90), ("RG8", 2, 90)])
def test_pixels_come_back(kind, channels, least):
    img = picture(256, 128)
    back = pixels.decode(pixels.encode(img, kind), 256, 128, kind)
    assert back.shape == img.shape and psnr(img[..., :channels], back[..., :channels]) > least


def test_narrow_mode_and_nibbles():
    block = struct.pack("<HHI", 0x0000, 0xFFFF, 0b11_10_01_00)
    texels = pixels.decode(block, 4, 4, "DXT1")
    assert texels[0, 0].tolist() == [0, 0, 0, 255] and texels[0, 1].tolist() == [255, 255, 255, 255] and texels[0, 3].tolist() == [0, 0, 0, 0]
    assert texels[0, 2].tolist() == [127, 127, 127, 255]


@pytest.mark.parametrize("fmt", [0x12, 0x14, 0x06, 0x31, 0x04])
def test_stored_form(fmt):
    from lodestrata.functions.fields import GPU_FORMATS

    kind, _, _ = GPU_FORMATS[fmt]
    linear = pixels.encode(picture(512, 64), kind)
    stored = pixels.to_stored(linear, 512, 64, fmt)
    assert pixels.to_linear(stored, 512, 64, fmt) == linear
    assert pixels.padded_size(512, 64, 8, 4) == 32768


def test_headers_have_128_bytes():
    for kind in [*pixels.MASKS, *pixels.FOURCC]:
        h = pixels.dds_header(64, 32, kind)
        assert len(h) == 128 and struct.unpack_from("<II", h, 12) == (32, 64)
    assert pixels.dds_header(8, 8, "DXT5A")[84:88] == b"ATI1"
    with pytest.raises(ValueError):
        pixels.swap16(b"abc")
    assert pixels.swap(b"abcdefg", 3) == b"cbafedg"


def test_riff():
    data = bytes(range(256)) * 16
    raw = audio.riff(data, 1, 44100)
    assert audio.packets_of(raw) == data and audio.packets_of(data) == data
    chunks = audio.riff_chunks(raw)
    assert [n for n, _ in chunks] == [b"fmt ", b"data"] and len(chunks[0][1]) == 52
    assert struct.unpack_from("<HHI", chunks[0][1]) == (0x0166, 1, 44100) and struct.unpack_from("<I", chunks[0][1], 24)[0] == 2 * 512
    with pytest.raises(ValueError):
        audio.packets_of(raw.replace(struct.pack("<HH", 0x0166, 1), struct.pack("<HH", 1, 1), 1))


def test_sound_bank():
    rows = [(1, 5, 2, 31856, 48000, 0, 4096, 0, 32, 9, 0), (1, 5, 2, 100, 0, 0, 2048, 0, 32, 9, 0)]
    table = b"".join(struct.pack(">11I", *r) for r in rows)
    raw = b"head" + lzss.block(table) + bytes([7]) * 4096 + bytes([8]) * 2048
    sounds, payload = audio.parse_bank(raw)
    assert [(s["rate"], s["offset"], round(s["seconds"], 3)) for s in sounds] == [(48000, 0, 0.664), (0, 4096, 0.0)]
    assert audio.read_sound(raw, sounds[1], payload) == bytes([8]) * 2048
    with pytest.raises(ValueError):
        audio.parse_bank(lzss.block(b"x" * 45))


def test_hashes(spark):
    rows = spark.createDataFrame([("LED_PIT.IFF", "swedishbootup.iff")], "a string, b string")
    got = rows.select(fields.name_hash(F.lower("a")), fields.stem_hash(F.col("b")), fields.raw_hash(F.lit("a")), fields.raw_hash(F.lit("A"))).first()
    assert got[0] == 0x0015FC3D and got[1] == 0xA7FF9656 and got[2] != got[3]
    names = ["logo_bos.iff", "uniform_cgy_home.iff", "global.iff"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(fields.name_hash(F.col("n"))).collect()]
    assert got == [0xAE54EBC4, 0xF36A9B8D, 0xDB5E3E48]


def test_legacy_hashes(spark):
    data = [b"", b"abc", "é".encode(), bytes(range(200))]
    df = spark.createDataFrame([(d,) for d in data], "b binary")
    got = {k: [r[0] for r in df.select(fields.legacy_hash(F.col("b"), k)).collect()] for k in fields.LEGACY}
    m = (1 << 32) - 1

    def run(start, step):
        out = []
        for d in data:
            a = start
            for x in d:
                a = step(a, x) & m
            out.append(a)
        return out

    assert got["fnv1"] == run(0x811C9DC5, lambda a, x: (a * 0x01000193 & m) ^ x) and got["fnv1a"] == run(0x811C9DC5, lambda a, x: (a ^ x) * 0x01000193)
    assert got["djb2"] == run(5381, lambda a, x: a * 33 + x) and got["djb2_xor"] == run(5381, lambda a, x: a * 33 ^ x) and got["sdbm"] == run(0, lambda a, x: x + a * 65599)
    assert got["crc32"] == [zlib.crc32(d) for d in data] and got["not_crc32"] == [zlib.crc32(d) ^ m for d in data] and got["adler32"] == [zlib.adler32(d) for d in data]


def test_fields(spark):
    df = spark.createDataFrame([(bytes.fromhex("C3A9FF80"),), (b"ab",), (b"",)], "b binary")
    b = F.col("b")
    assert [tuple(r) for r in df.select(fields.le32(b, 0), fields.be32(b, 0), fields.be16(b, 1), fields.be16(b, 0)).collect()] == [(2164238787, 0xC3A9FF80, 0xA9FF, 0xC3A9), (None, None, None, 0x6162), (None,) * 4]
    heads = spark.createDataFrame([(x,) for x in (b"\xff\x3b\xef\x94x", b"RIFF", b"", b"\x01\x02\x03\x04", b"ab\n")], "b binary")
    assert [r[0] for r in heads.select(fields.classify(b)).collect()] == ["package", "tag:RIFF", "tag:", "UNKNOWN", "UNKNOWN"]
    sizes = spark.createDataFrame([(512, 64, 8, 4), (1, 1, 1, 1)], "w int, h int, b int, e int")
    assert [r[0] for r in sizes.select(fields.padded_size(*map(F.col, "whbe"))).collect()] == [32768, 4096]
    assert spark.createDataFrame([("07_a",), ("x_1",)], "s string").select(fields.leading_index(F.col("s"))).collect()[0][0] == 7


def test_wide_signatures(spark):
    want = [
        (b"\xaa\x00\xb3\xbf", "AA00B3BF-arc"), (b"XEX2....", "XEX2-executable"), (b"PIRS", "STFS-package"), (b"LIVE", "STFS-package"), (b"CON x", "STFS-package"), (b"CONx", "tag:CONx"),
        (b"DDS |", "DDS-texture"), (b"RIFF\x01\0\0\0WAVEfmt ", "RIFF(WAVE)"), (b"RIFF\x01\0", "RIFF()"), (b"XWB\0", "XWB-wavebank"), (b"WBND", "XWB-wavebank"), (b"XMA2", "XMA-audio"), (b"XMAx", "XMA-audio"),
        (b"OggS", "OGG-audio"), (b"BIKi", "BINK-video"), (b"BIK", "BINK-video"), (b"BIKb", "tag:BIKb"), (b"\x89PNG\r\n", "PNG"), (b"BM", "BMP?"), (b"bhd\0", "bank"), (b"bnk\0", "bank"), (b"PK\3\4", "ZIP"),
        (b"\x1f\x8b\x08", "GZIP"), (b"\x78\x9c", "ZLIB"), (b"x\x01", "ZLIB"), (b"\x78\xda", "ZLIB"), (b"FSB4", "FMOD-FSB"), (b"FSB5", "FMOD-FSB"), (b"\0\0\0\x0cjP  ", "JP2"), (b"\0\0\0\x0cjPxx", "UNKNOWN"),
        (b"RSF\0", "RSF"), (b"NUP1", "NUS3"), (b"NUS3", "NUS3"), (b"abcdefgh", "tag:abcd"), (b"\x0e\x48\x37\xc3PK", "block"),
    ]
    df = spark.createDataFrame([(x,) for x, _ in want], "b binary")
    assert [r[0] for r in df.select(fields.classify(F.col("b"))).collect()] == [y for _, y in want]


def test_packets(spark):
    word = (5 << 26) | (300 << 11) | (1 << 8) | 9
    data = (struct.pack(">I", word) + b"\0" * 2044) * 2 + b"tail"
    df = spark.createDataFrame([(data,), (b"",)], "b binary").select(audio.packet_headers(F.col("b")).alias("p"))
    rows = [r.p for r in df.collect()]
    assert [tuple(x) for x in rows[0]] == [(5, 300, 1, 9)] * 2 and rows[1] == []
