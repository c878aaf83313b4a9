"""Disc images and the archives in them, as Python data sources.

Indexes are small and read on the driver's side of a scan; bytes are read by
range on the executors, late, and never the whole image. Paths go through
pyarrow's file systems, so an image may be in any store that they reach.

    register(spark)
    spark.read.format("disc_image").option("path", image).load()
    spark.read.format("archive_entries").option("path", image).option("head_bytes", 16).load()
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the disc format: sector, volume magic and its sector, usual partition bases, scan limit, directory bit.
SECTOR = 2048
VOLUME_MAGIC = b"MICROSOFT*XBOX*MEDIA"
VOLUME_SECTOR = 32
BASES = (0x0, 0xFD90, 0x2080000, 0xFD90000, 0xFDA0000, 0x18300000, 0x1FB20000)
SCAN_LIMIT = 512 << 20
DIRECTORY = 0x10
# Fixed values of the archive format: magic, and the disc file that its index begins.
ARCHIVE_MAGIC = 0xAA00B3BF
INDEX_FILE = "0A"


class NotAnImage(ValueError):
    """No volume, or no archive, where one must be."""


def open_path(path: str):
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(at)


def _at(f, offset: int, size: int) -> bytes:
    f.seek(offset)
    return f.read(size)


def partition_base(f) -> int:
    """Where sector 0 is: one of the usual places, else the first sector boundary that fits, near the front."""
    whole = f.size()
    ahead = VOLUME_SECTOR * SECTOR
    fits = lambda base: base + ahead + len(VOLUME_MAGIC) <= whole and _at(f, base + ahead, len(VOLUME_MAGIC)) == VOLUME_MAGIC
    for base in (*BASES, *range(0, min(whole, SCAN_LIMIT + 1), SECTOR)):
        if fits(base):
            return base
    raise NotAnImage("no volume descriptor")


def directory(f, base: int) -> list[dict]:
    """All files and folders: by name in a folder, a folder's own entries after all of its parent's."""
    head = _at(f, base + VOLUME_SECTOR * SECTOR, SECTOR)
    if head[: len(VOLUME_MAGIC)] != VOLUME_MAGIC:
        raise NotAnImage("no volume descriptor")
    out: list[dict] = []

    def folder(sector: int, size: int, prefix: str) -> None:
        table, below = _at(f, base + sector * SECTOR, size), []
        stack, at, seen = [], 0, set()
        node = lambda k: struct.unpack_from("<HHIIBB", table, k) if k + 14 <= len(table) else None
        while True:  # in order, without recursion: left, self, right
            x = node(at) if at is not None and at not in seen else None
            if x and x[0] != 0xFFFF:
                seen.add(at)
                stack.append((at, x))
                at = x[0] * 4 if x[0] else None
                continue
            if not stack:
                break
            k, (_, right, lba, length, attrs, name) = stack.pop()
            path = prefix + table[k + 14 : k + 14 + name].decode("latin-1")
            is_dir = bool(attrs & DIRECTORY)
            out.append({"path": path, "lba": lba, "size": length, "attrs": attrs, "is_dir": is_dir, "offset": base + lba * SECTOR})
            if is_dir and length:
                below.append((lba, length, f"{path}/"))
            at = right * 4 if right else None
        for x in below:
            folder(*x)

    folder(*struct.unpack_from("<II", head, 0x14), "")
    return out


def read_disc_file(path: str, entry: dict, length: int | None = None, seek: int = 0) -> bytes:
    """A byte range of a disc file."""
    with open_path(path) as f:
        left = max(0, entry["size"] - seek)
        return _at(f, entry["offset"] + seek, left if length is None else min(length, left))


@dataclass(frozen=True)
class Split:
    """A part of the archive's stream: a disc file."""

    name: str
    size: int
    start: int
    offset: int


@dataclass(frozen=True)
class Archive:
    """An archive's index: splits and the place of its entry table."""

    path: str
    align: int
    splits: tuple[Split, ...]
    entries: int
    table: int

    @staticmethod
    def open(path: str) -> Archive:
        with open_path(path) as f:
            files = {x["path"]: x for x in directory(f, partition_base(f))}
            at = files[INDEX_FILE]["offset"]
            magic, align, parts, _, entries, _ = struct.unpack(">6I", _at(f, at, 0x18))
            if magic != ARCHIVE_MAGIC:
                raise NotAnImage(f"archive magic {magic:08X}")
            table, splits, start = _at(f, at + 0x18, parts * 16), [], 0
            for k in range(parts):
                name = table[16 * k + 8 : 16 * k + 16].decode("utf-16-be").replace("\0", "").strip()
                size = struct.unpack_from(">I", table, 16 * k)[0] * align
                splits.append(Split(name, size, start, files[name]["offset"]))
                start += size
        return Archive(path, align, tuple(splits), entries, at + 0x18 + parts * 16)

    def records(self, f, first: int, last: int) -> list[tuple[int, int, int, int, int]]:
        """(idx, flag, size, crc, offset) of a range of entries."""
        raw = _at(f, self.table + 16 * first, 16 * (last - first))
        return [(first + k, a, b, c, d * self.align) for k, (a, b, c, d) in enumerate(struct.iter_unpack(">4I", raw))]

    def pieces(self, offset: int, size: int) -> list[tuple[int, int]]:
        """(image offset, size) of a range of the stream, in order; a range beyond the splits is an error."""
        out, end = [], offset + size
        for s in self.splits:
            a, b = max(offset, s.start), min(end, s.start + s.size)
            if a < b:
                out.append((s.offset + a - s.start, b - a))
        if sum(n for _, n in out) != size:
            raise ValueError(f"stream range {offset}+{size} is outside the splits")
        return out

    def read(self, f, offset: int, size: int) -> bytes:
        return b"".join(_at(f, a, n) for a, n in self.pieces(offset, size))


class DiscImage(DataSource):
    """One row a file or folder of a disc image."""

    @classmethod
    def name(cls) -> str:
        return "disc_image"

    def schema(self) -> str:
        return "path string, lba long, size long, attrs int, is_dir boolean, offset long"

    def reader(self, schema) -> DataSourceReader:
        return _DiscReader(self.options["path"])


class _DiscReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def read(self, partition):
        with open_path(self.path) as f:
            for x in directory(f, partition_base(f)):
                yield tuple(x[c] for c in ("path", "lba", "size", "attrs", "is_dir", "offset"))


class ArchiveEntries(DataSource):
    """One row an entry of the archive in a disc image, with its first `head_bytes` bytes if asked for."""

    @classmethod
    def name(cls) -> str:
        return "archive_entries"

    def schema(self) -> str:
        return "idx long, flag long, size long, crc long, offset long, head binary"

    def reader(self, schema) -> DataSourceReader:
        return _EntryReader(self.options["path"], int(self.options.get("head_bytes", 0)), int(self.options.get("rows_per_partition", 4096)))


@dataclass
class _Range(InputPartition):
    first: int
    last: int


class _EntryReader(DataSourceReader):
    def __init__(self, path: str, head: int, rows: int):
        self.archive, self.head, self.rows = Archive.open(path), head, rows

    def partitions(self):
        n = self.archive.entries
        return [_Range(a, min(n, a + self.rows)) for a in range(0, n, self.rows)] or [_Range(0, 0)]

    def read(self, partition):
        with open_path(self.archive.path) as f:
            for x in self.archive.records(f, partition.first, partition.last):
                yield (*x, self.archive.read(f, x[4], min(self.head, x[2])) if self.head else None)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DiscImage)
    spark.dataSource.register(ArchiveEntries)


def contents(entries: DataFrame, path: str, piece: int = 64 << 20, first: int = 0, length: int | None = None) -> DataFrame:
    """(idx, piece, data): the bytes of entries (idx, offset, size) or of a range of each, in pieces of at most `piece` bytes.

    Only indexes travel; each task reads its own ranges. A gigabyte entry comes as rows, not as one value.
    """
    archive = Archive.open(path)

    def run(batches):
        with open_path(path) as f:
            for batch in batches:
                for idx, offset, size in zip(*(c.to_pylist() for c in batch.columns)):
                    size = max(0, size - first)
                    size = size if length is None else min(size, length)
                    for k, at in enumerate(range(0, max(size, 1), piece)):
                        data = archive.read(f, offset + first + at, min(piece, size - at))
                        yield pa.RecordBatch.from_pydict({"idx": [idx], "piece": pa.array([k], pa.int32()), "data": pa.array([data], pa.binary())})

    return entries.select("idx", "offset", "size").mapInArrow(run, "idx long, piece int, data binary")
