"""Export, manifests, write-back and mining on a synthetic image."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from lodestrata import cli
from lodestrata.functions import lzss
from lodestrata.operators import bulk, journal, mining, roster, textures
from tests.fixtures import archive, image, package, picture


@pytest.fixture
def disc_image(tmp_path):
    raw, _ = package([(picture(64, 64, 1), 0x06), (picture(64, 64, 2), 0x12)])
    sound = b"\x08\0\0\0" + bytes(4092)
    entries = [(0xAE54EBC4, raw + bytes(9000)), (5, sound), (6, b"\xff\x3b\xef\x94" + lzss.block(b"meta")[:-1])]
    path = tmp_path / "disc.iso"
    path.write_bytes(image(archive(entries, [2])))
    return str(path), raw, sound


def test_export_and_manifest(spark, disc_image, tmp_path):
    path, raw, _ = disc_image
    got = {r.idx: (r.files, r.error) for r in bulk.export_textures(spark, path, str(tmp_path / "out")).collect()}
    assert got[0] == (2, None) and got[2][0] == 0
    folder = tmp_path / "out" / "logos" / "logo_bos"
    want = textures.extract(*lzss.unpack_entry(raw))
    assert [(folder / n).read_bytes() for n in sorted(os.listdir(folder))] == [x for _, x in want]
    assert [(a, k) for a, k, _ in bulk.edited_images(str(tmp_path / "out"))] == [("logo_bos", 0), ("logo_bos", 1)]
    rows = bulk.manifest(spark, path)
    assert [(r.tex, r.format, r.bytes) for r in rows.where("error is null").orderBy("tex").collect()] == [(0, "ARGB", 16384), (1, "DXT1", 2048)]
    assert rows.where("mip > 0.9").count() == 2
    assert tuple(bulk.check_manifest(rows, rows.where("tex is null or tex = 0")).first()) == (1, 0, 1, 0)
    assert bulk.confirmed_by(rows.where("tex is not null"), rows.where("tex = 1")).count() == 1


def test_write_back_and_revert(spark, disc_image):
    path, _, sound = disc_image
    before = open(path, "rb").read()
    new = picture(64, 64, 7)
    assert bulk.apply_edits(path, {0: {0: new}, 9: {0: new}}) .keys() == {9}
    bulk.replace_audio(path, 1, sound[:4] + b"\1" * 2044)
    with pytest.raises(ValueError):
        bulk.replace_audio(path, 1, b"short")
    data = bulk.packages(spark, path, F.col("idx") == 0).first().data
    assert textures.extract(*lzss.unpack_entry(bytes(data)))[0][1][128:] == new[..., [2, 1, 0, 3]].tobytes()
    after = open(path, "rb").read()
    assert after != before and len(after) == len(before)
    cli.main([path, "status"])
    cli.main([path, "revert"])
    assert open(path, "rb").read() == before and journal.Patcher(path).pending() == 0


def test_save_and_journal_backups(tmp_path):
    path = tmp_path / "roster"
    path.write_bytes(b"first")
    roster.save(str(path), b"other")
    roster.save(str(path), b"third")
    assert path.read_bytes() == b"third" and (tmp_path / "roster.colorbak").read_bytes() == b"first"
    with pytest.raises(ValueError):
        roster.save(str(path), b"longer than it was")
    patcher = journal.Patcher(str(path))
    assert patcher.backup() is None
    patcher.write(0, b"T")
    assert open(patcher.backup()).read() == open(patcher.path).read()


def test_edited_folders_are_resolved_and_the_rest_reported(spark, disc_image, tmp_path):
    root = tmp_path / "edited"
    for name in ("logos/logo_bos/03_a.dds", "logos/LOGO_BOS/04_b.png", "unnamed/00002/1_x.tga", "logos/logo_bos/plain.dds", "logos/nobody/00_a.dds", "logos/notes.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"")
    plan, unresolved = bulk.scan_folder(spark, disc_image[0], str(root))
    where = lambda x: str(root / x)
    assert plan == {0: {3: where("logos/logo_bos/03_a.dds"), 4: where("logos/LOGO_BOS/04_b.png")}, 2: {1: where("unnamed/00002/1_x.tga")}}
    assert sorted(unresolved) == sorted([where("logos/logo_bos/plain.dds"), where("logos/nobody")])


def test_cli_lists(spark, disc_image, capsys):
    cli.main([disc_image[0], "find", "BOS"])
    assert "logo_bos.iff" in capsys.readouterr().out


def test_mining(spark):
    data = b"\x01\x02hello world\x00" + "name.iff".encode("utf-16-be") + struct.pack(">I", 0xAE54EBC4) + b"\x03tiny"
    df = spark.createDataFrame([(1, data)], "id long, data binary")
    assert [r.text for r in mining.ascii_strings(df).collect()] == ["hello world"]
    assert "name.iff" in [r.text for r in mining.utf16_strings(df).collect()]
    pool = mining.candidate_hashes(df)
    assert pool.where(F.col("hash") == 0xAE54EBC4).count() == 1
    report = mining.keyword_report(mining.ascii_strings(df), [("greeting", "hello"), ("any", ".")]).collect()
    assert [(r["pattern"], r["n"], r["examples"]) for r in report] == [("greeting", 1, ["hello world"])]
    names = spark.createDataFrame([("logo_bos.iff",), ("global.iff",)], "name string")
    both = spark.createDataFrame([(0xAE54EBC4,), (0xDB5E3E48,)], "hash long")
    assert [(r["function"], r["form"]) for r in mining.identify_hash(names, both).collect()] == [("crc32", "upper")]


def test_loaded_constants(spark):
    lis = lambda d, v: 15 << 26 | d << 21 | v
    addi = lambda d, a, v: 14 << 26 | d << 21 | a << 16 | v
    ori = lambda d, a, v: 24 << 26 | a << 21 | d << 16 | v
    nop = 24 << 26
    code = [lis(3, 0x8200), nop, addi(4, 3, 0x10), lis(5, 0x8210), lis(5, 0x8220), ori(5, 5, 0xFFFF), lis(6, 0x8300), *[nop] * 12, addi(6, 6, 1), lis(7, 0x8201), addi(7, 7, 0xFFFC)]
    rows = [(0x82000000 + 4 * k, w) for k, w in enumerate(code)]
    got = sorted((r.va - 0x82000000, r.value) for r in mining.loaded_constants(spark.createDataFrame(rows, "va long, w long")).collect())
    assert got == [(0, 0x82000010), (16, 0x8220FFFF), (80, 0x8200FFFC)]


