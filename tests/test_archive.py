"""Disc images, archives, textures, rosters and the journal, on synthetic images."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import fields, lzss
from lodestrata.operators import journal, naming, roster, textures
from lodestrata.sources import disc
from tests.fixtures import archive, image, package, picture


@pytest.fixture
def disc_path(tmp_path):
    rng = np.random.default_rng(0)
    entries = [(5, b"\xff\x3b\xef\x94" + bytes(5000)), (7, b""), (7, b"dup"), (9, rng.integers(0, 256, 9000, dtype=np.uint8).tobytes()), (11, b"\x08\0\0\0" + bytes(3000))]
    files = archive(entries, [4, 3]) | {"readme.txt": b"hi", "dir/x/deep.bin": b"deep", "dir/a": b"a", **{f"f{k:02d}": bytes([k]) for k in range(9)}}
    path = tmp_path / "disc.iso"
    path.write_bytes(image(files, base=0xFD90))
    return str(path), entries, files


def test_directory_order_and_bytes(spark, disc_path):
    path, _, files = disc_path
    disc.register(spark)
    rows = spark.read.format("disc_image").option("path", path).load().collect()
    got = [r.path for r in rows]
    top = sorted({p.split("/")[0] for p in files})
    assert got == [*top, "dir/a", "dir/x", "dir/x/deep.bin"]
    for r in rows:
        if not r.is_dir:
            assert disc.read_disc_file(path, r.asDict()) == files[r.path]
    assert disc.read_disc_file(path, rows[-1].asDict(), 2, 1) == b"ee"


def test_archive_entries_and_stitching(spark, disc_path):
    path, entries, _ = disc_path
    disc.register(spark)
    df = spark.read.format("archive_entries").option("path", path).option("head_bytes", 4).option("rows_per_partition", 2).load()
    rows = df.orderBy("idx").collect()
    assert [(r.size, r.crc, bytes(r["head"])) for r in rows] == [(len(d), c, d[:4]) for c, d in entries]
    whole = {}
    for r in disc.contents(df, path, piece=4096).orderBy("idx", "piece").collect():
        whole[r.idx] = whole.get(r.idx, b"") + bytes(r.data)
    assert [whole[k] for k in range(len(entries))] == [d for _, d in entries]
    part = disc.contents(df.where("idx = 3"), path, first=100, length=50).first()
    assert bytes(part.data) == entries[3][1][100:150]
    labels = {r.label: r.n for r in df.groupBy(fields.classify(F.col("head")).alias("label")).agg(F.count("*").alias("n")).collect()}
    assert labels["package"] == 1 and labels["audio"] == 1 and labels["tag:"] == 1
    with pytest.raises(ValueError):
        disc.Archive.open(path).pieces(10**9, 5)


def test_no_image(tmp_path):
    (tmp_path / "x").write_bytes(bytes(100_000))
    with pytest.raises(disc.NotAnImage):
        disc.partition_base(disc.open_path(str(tmp_path / "x")))
    odd = image({"a": b"1"}, base=6 * disc.SECTOR)
    (tmp_path / "y").write_bytes(odd)
    assert disc.partition_base(disc.open_path(str(tmp_path / "y"))) == 6 * disc.SECTOR


def test_textures_out_and_in(spark):
    images = [(picture(64, 64, 1), 0x12), (picture(128, 64, 2), 0x06), (picture(64, 128, 3), 0x14)]
    raw, region = package(images)
    data, bounds = lzss.unpack_entry(raw)
    assert data[bounds[-1][0] :] == region
    found = textures.extract(data, bounds)
    assert [(d["w"], d["h"], d["kind"]) for d, _ in found] == [(64, 64, "DXT1"), (128, 64, "ARGB"), (64, 128, "DXT5")]
    assert found[1][1][128:] == images[1][0][..., [2, 1, 0, 3]].tobytes()
    new = picture(128, 64, 9)
    edited = textures.replace(raw, {1: new})
    again = textures.extract(*lzss.unpack_entry(edited))
    assert again[1][1][128:] == new[..., [2, 1, 0, 3]].tobytes() and again[0][1] == found[0][1] and again[2][1] == found[2][1]
    first = lzss.find_blocks(raw)[0]
    assert edited[: first[0] + first[2]] == raw[: first[0] + first[2]]  # the unchanged block stays as it is
    assert textures.rebuild(raw, data, data) == raw
    with pytest.raises(ValueError):
        textures.replace(raw, {1: picture(64, 64)})
    with pytest.raises(IndexError):
        textures.replace(raw, {7: new})
    rows = textures.texture_files(spark.createDataFrame([(3, raw), (4, b"other"), (5, None)], "idx long, data binary")).collect()
    assert [(r.idx, r.kind) for r in rows] == [(3, "DXT1"), (3, "ARGB"), (3, "DXT5")] and rows[1].name.endswith("_128x64_ARGB.dds")


def test_order_is_confirmed_by_levels():
    images = [(picture(64, 64, 1), 0x06), (picture(128, 64, 2), 0x06), (picture(64, 128, 5), 0x06)]
    raw, _ = package(images, order=[2, 0, 1], sentinel=True)
    found = textures.extract(*lzss.unpack_entry(raw))
    by = {(d["w"], d["h"]): x[128:] for d, x in found}
    for img, _ in images:
        assert by[img.shape[1], img.shape[0]] == img[..., [2, 1, 0, 3]].tobytes()


def test_score_null_is_not_zero():
    from lodestrata.functions import pixels

    assert pixels.mip_consistency(bytes(10), 0, 64, 64, 0x06) is None and pixels.mip_consistency(bytes(1 << 16), 0, 64, 64, 0x06) is None
    assert pixels.mip_consistency(bytes(1 << 16), 0, 4, 4, 0x06) is None and pixels.mip_consistency(bytes(10), 0, 64, 64, 0x99) is None


def save(shift=0):
    n, stride = 70, roster.COLOUR_STRIDE
    body = bytearray(stride * n)
    for k in range(60):
        at = k * stride
        body[at + roster.INDEX_AT] = k
        body[at + roster.TEAM_AT] = k % 30
        body[at + roster.PRIMARY_AT : at + roster.PRIMARY_AT + 6] = bytes([k, 1, 2, k, 4, 5])
    head = bytearray(roster.DATA_BASE)
    struct.pack_into(">I", head, 8, 2)
    struct.pack_into(">3I", head, 0x0C, 1, 1, stride * n)
    struct.pack_into(">3I", head, 0x18, roster.COLOUR_CHUNK, n - shift, shift * stride)
    return bytes(head + body + bytes(64))


@pytest.mark.parametrize("shift", [0, 3])
def test_roster(shift):
    data = save(shift)
    rows = roster.chunks(data)
    assert rows[1]["size"] == (70 - shift) * roster.COLOUR_STRIDE and rows[0]["size"] == 64
    assert roster.team_colours(data)[2] == {"team": "BOS", "primary": "020102", "secondary": "020405"} and roster.team_colours(data, led=True)[0]["primary"] == "1e0102"
    new = roster.with_colour(data, "bos", primary="aabbcc")
    assert len(new) == len(data) and roster.team_colours(new)[2]["primary"] == "aabbcc" and sum(a != b for a, b in zip(new, data)) == 3
    with pytest.raises(roster.NotARoster):
        roster.team_colours(bytes(200))


def test_journal_reverts_overlaps(spark, tmp_path):
    path, before = tmp_path / "image", bytes(range(200))
    path.write_bytes(before)
    p = journal.Patcher(str(path))
    p.write(10, b"AAAA", "one")
    p.write(8, b"BBBBBBBB", "two")
    p.write(10, b"CCCCCCCCCCCC")
    assert path.read_bytes()[8:22] == b"BB" + b"C" * 12
    rows = journal.journal_table(spark, p.path).collect()
    assert sum(r.len for r in rows) == 14 and all(bytes(r.original) == before[r.offset : r.offset + r.len] for r in rows)
    with pytest.raises(ValueError):
        p.write(198, b"long")
    dry = journal.Patcher(str(path), dry_run=True)
    now = path.read_bytes()
    dry.write(50, b"zz")
    assert path.read_bytes() == now and dry.pending() == p.pending() + 1
    assert journal.Patcher(str(path)).revert() == len(rows) and path.read_bytes() == before and journal.Patcher(str(path)).pending() == 0


def test_names(spark):
    cat = naming.catalogue(spark)
    assert cat.count() == len(naming.CODES) * len(naming.TEMPLATES) + len(naming.GLOBALS)
    entries = spark.createDataFrame([(0, 0xAE54EBC4), (1, 5), (2, 0xAE54EBC4)], "index long, crc long")
    assert [r.name for r in naming.resolve(entries, cat).orderBy("index").collect()] == ["logo_bos.iff", "", "logo_bos.iff"]
    assert naming.first_entry(entries, cat.select("name").where("name like 'logo_bos%'")).first()["index"] == 0
    assert naming.existing(cat, entries).count() == 1
    made = spark.createDataFrame([("uniform_base_x",), ("uniform_x",), ("UNIFORM_x",), ("",), (None,)], "n string")
    assert [r[0] for r in made.select(naming.category(F.col("n"))).collect()] == ["jerseys/base", "jerseys/overlay", "other", "unnamed", "unnamed"]
    paths = spark.createDataFrame([(7, "logo_bos.IFF"), (7, "")], "i int, n string")
    assert [r[0] for r in paths.select(naming.output_path("t", F.col("i"), F.col("n"))).collect()] == ["t/logos/logo_bos", "t/unnamed/00007"]
