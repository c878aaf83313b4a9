"""Whole-archive jobs: export, verification manifests, and writing edits back through the journal."""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import audio, fields, lzss, pixels
from lodestrata.operators import naming, textures
from lodestrata.operators.journal import Patcher
from lodestrata.sources import disc


def open_archive(spark: SparkSession, path: str, head_bytes: int = 16) -> DataFrame:
    """The entries of an image's archive with their names ('' where unknown) and categories."""
    disc.register(spark)
    entries = spark.read.format("archive_entries").option("path", path).option("head_bytes", head_bytes).load()
    return naming.resolve(entries, naming.catalogue(spark)).withColumn("category", naming.category(F.col("name")))


def packages(spark: SparkSession, path: str, where=None) -> DataFrame:
    """(idx, data) of the package entries; the magic and `where` are tested before any content is read."""
    entries = open_archive(spark, path).where(fields.classify(F.col("head")) == "package")
    if where is not None:
        entries = entries.where(where)
    whole = disc.contents(entries, path, piece=1 << 30)  # packages are some megabytes
    return whole.select("idx", "data")


def export_textures(spark: SparkSession, path: str, out: str, where=None) -> DataFrame:
    """Write every texture as a DDS file under `out` by category; (idx, files, error) of each entry, failures reported and not fatal."""
    names = open_archive(spark, path).select("idx", naming.output_path(out, F.col("idx"), F.col("name")).alias("folder"))
    rows = packages(spark, path, where).join(names, "idx")

    def run(batches):
        for batch in batches:
            for idx, raw, folder in zip(*(c.to_pylist() for c in batch.columns)):
                n, error = 0, None
                try:
                    fs, at = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
                    for k, (d, data) in enumerate(textures.extract(*lzss.unpack_entry(raw))):
                        fs.create_dir(at, recursive=True)
                        with fs.open_output_stream(f"{at}/{k:02d}_{d['base'] + d['off']:07X}_{d['w']}x{d['h']}_{d['kind']}.dds") as f:
                            f.write(data)
                        n += 1
                except (ValueError, OSError) as e:
                    error = str(e)
                yield pa.RecordBatch.from_pydict({"idx": [idx], "files": pa.array([n], pa.int32()), "error": pa.array([error], pa.string())})

    return rows.select("idx", "data", "folder").mapInArrow(run, "idx long, files int, error string")


def manifest(spark: SparkSession, path: str, where=None) -> DataFrame:
    """(file, tex, w, h, format, offset, bytes, md5, mip, error): a row a texture, or one with the error of an entry that fails."""

    def run(batches):
        for batch in batches:
            for idx, raw in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    data, bounds = lzss.unpack_entry(raw)
                    rows = [
                        {"file": idx, "tex": k, "w": d["w"], "h": d["h"], "format": d["kind"], "offset": d["base"] + d["off"], "bytes": len(x) - 128, "md5": hashlib.md5(x[128:]).hexdigest(),
                         "mip": pixels.mip_consistency(data, d["base"] + d["off"], d["w"], d["h"], d["fmt"]) if textures.has_mips(d) else None, "error": None}
                        for k, (d, x) in enumerate(textures.extract(data, bounds))
                    ]
                except ValueError as e:
                    rows = [{"file": idx, "tex": None, "w": None, "h": None, "format": None, "offset": None, "bytes": None, "md5": None, "mip": None, "error": str(e)}]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("file", pa.int64()), ("tex", pa.int64()), ("w", pa.int64()), ("h", pa.int64()), ("format", pa.string()), ("offset", pa.int64()), ("bytes", pa.int64()), ("md5", pa.string()), ("mip", pa.float64()), ("error", pa.string())])
    kinds = "file long, tex long, w long, h long, format string, offset long, bytes long, md5 string, mip double, error string"
    return packages(spark, path, where).mapInArrow(run, kinds)


def check_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row (same, differing, missing, extra) by file and texture."""
    return naming.manifest_diff(old.where("error is null"), new.where("error is null"), ["file", "tex"], "md5")


def confirmed_by(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """The manifest rows whose payload some external dump (md5) has."""
    return rows.join(digests.select("md5").distinct(), "md5", "left_semi")


def dump_index(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, xenos_format, width, height, md5) of emulator dumps: the payload of each .dds behind its header (longer with a DX10 part)."""
    stem = F.regexp_extract("path", r"([^/]+)\.[a-z]+$", 1).alias("stem")
    files = spark.read.format("binaryFile").load(f"{folder}/*.dds").select(stem, "content")
    infos = spark.read.schema("xenos_format string, width int, height int").json(f"{folder}/*.json", multiLine=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("stem"), "*")
    skip = F.when(F.substring("content", 85, 4) == F.encode(F.lit("DX10"), "UTF-8"), 148).otherwise(128)
    return files.join(infos, "stem").select("stem", "xenos_format", "width", "height", F.md5(F.substring("content", skip + 1, F.octet_length("content"))).alias("md5"))


def edited_images(folder: str) -> list[tuple[str, int, str]]:
    """(asset folder, texture number, path) of edited images in a tree: files named <number>_..."""
    out = []
    for where, _, names in sorted(os.walk(folder)):
        for name in sorted(names):
            m = re.match(r"^(\d+)_", name)
            if m and name.rpartition(".")[2].lower() in ("dds", "png", "tga", "bmp"):
                out.append((os.path.basename(where), int(m[1]), os.path.join(where, name)))
    return out


def scan_folder(spark: SparkSession, path: str, folder: str) -> tuple[dict[int, dict[int, str]], list[str]]:
    """(entry -> texture number -> path, what can't be resolved) of the edited images in a tree of any depth.

    A folder of digits is an entry's index; any other must be the stem of an entry's
    name. Unresolved are folders without an entry, and images without a leading number.
    """
    known = open_archive(spark, path).where(F.col("name") != "").select("idx", "name").orderBy("idx").collect()  # a catalogue has hundreds of names
    by_stem = {r["name"].rsplit(".", 1)[0].lower(): r["idx"] for r in known}
    plan: dict[int, dict[int, str]] = {}
    unresolved = []
    for where, _, names in sorted(os.walk(folder)):
        images = [x for x in sorted(names) if x.rpartition(".")[2].lower() in ("dds", "png", "tga", "bmp")]
        if not images:
            continue
        leaf = os.path.basename(where.rstrip(os.sep))
        idx = int(leaf) if leaf.isdigit() else by_stem.get(leaf.lower())
        if idx is None:
            unresolved.append(where)
            continue
        for name in images:
            m = re.match(r"^(\d+)_", name)
            if m:
                plan.setdefault(idx, {})[int(m[1])] = os.path.join(where, name)
            else:
                unresolved.append(os.path.join(where, name))
    return plan, unresolved


def apply_edits(path: str, edits: dict[int, dict[int, np.ndarray]], dry_run: bool = False) -> dict[int, str]:
    """Replace textures (entry -> number -> image) in an image, one rebuild an entry, journalled; the error of each entry that failed."""
    archive, patcher, failed = disc.Archive.open(path), Patcher(path, dry_run=dry_run), {}
    with disc.open_path(path) as f:
        records = {r[0]: r for r in archive.records(f, 0, archive.entries)}
        for idx, images in edits.items():
            try:
                _, _, size, _, offset = records[idx]
                made = textures.replace(archive.read(f, offset, size), images)
                _put(patcher, archive, offset, size, made, f"entry {idx}")
            except (KeyError, IndexError, ValueError) as e:
                failed[idx] = str(e)
    return failed


def replace_audio(path: str, idx: int, raw: bytes, dry_run: bool = False) -> None:
    """Replace an audio entry by packets (or a WAVE file of them) that fit its place."""
    data = audio.packets_of(raw)
    if len(data) % audio.PACKET or data[:4] != b"\x08\0\0\0":
        raise ValueError("not whole packets of this codec")
    archive = disc.Archive.open(path)
    with disc.open_path(path) as f:
        _, _, size, _, offset = archive.records(f, idx, idx + 1)[0]
    _put(Patcher(path, dry_run=dry_run), archive, offset, size, data, f"audio {idx}")


def _put(patcher: Patcher, archive: disc.Archive, offset: int, size: int, data: bytes, note: str) -> None:
    if len(data) > size:
        raise ValueError(f"{len(data)} bytes do not fit {size}")
    data, at = data.ljust(size, b"\0"), 0
    for place, n in archive.pieces(offset, size):
        patcher.write(place, data[at : at + n], note)
        at += n
