"""Disc images and archives written from tables: an image an archive, each by one task."""

from __future__ import annotations

import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import lzss, pixels
from lodestrata.functions.fields import GPU_FORMATS
from lodestrata.sources import disc

#: The split files of an archive, in stream order.
SPLITS = ("0A", "0B", "1A", "1B")


def _sectors(size: int) -> int:
    return -(-size // disc.SECTOR)


class _Image:
    """Sectors of an image in the making."""

    def __init__(self):
        self.parts: dict[int, bytes] = {}
        self.free = disc.VOLUME_SECTOR + 1

    def put(self, data: bytes) -> int:
        at = self.free
        self.parts[at] = data
        self.free += max(1, _sectors(len(data)))
        return at

    def folder(self, entries: dict) -> tuple[int, int]:
        """Write a folder's files, then its table: a balanced search tree of its names; (sector, size)."""
        names = sorted(entries)
        place, at, order = {}, 0, []
        todo = [(0, len(names))]
        links: dict[int, tuple[int | None, int | None]] = {}
        middle = lambda lo, hi: (lo + hi) // 2 if lo < hi else None
        while todo:
            lo, hi = todo.pop(0)
            if lo < hi:
                k = middle(lo, hi)
                order.append(k)
                links[k] = middle(lo, k), middle(k + 1, hi)
                todo += [(lo, k), (k + 1, hi)]
        for k in order:
            place[k] = at
            at += (14 + len(names[k].encode("latin-1")) + 3) // 4 * 4
        table = bytearray(b"\xff" * at)
        for k, name in enumerate(names):
            x = entries[name]
            lba, size = self.folder(x) if isinstance(x, dict) else (self.put(x), len(x))
            left, right = (place[j] // 4 if j is not None else 0 for j in links[k])
            raw = name.encode("latin-1")
            struct.pack_into(f"<HHIIBB{len(raw)}s", table, place[k], left, right, lba, size, disc.DIRECTORY if isinstance(x, dict) else 0x80, len(raw), raw)
        return self.put(bytes(table)), at


def image(files: dict[str, bytes], base: int = 0) -> bytes:
    """A disc image whose sector 0 is at `base`, with files in the root and in folders ('a/b')."""
    tree: dict = {}
    for path, data in files.items():
        *folders, name = path.split("/")
        at = tree
        for f in folders:
            at = at.setdefault(f, {})
        at[name] = data
    made = _Image()
    root, size = made.folder(tree)
    out = bytearray(base + made.free * disc.SECTOR)
    made.parts[disc.VOLUME_SECTOR] = disc.VOLUME_MAGIC + struct.pack("<II", root, size)
    for at, data in made.parts.items():
        out[base + at * disc.SECTOR : base + at * disc.SECTOR + len(data)] = data
    return bytes(out)


def archive(entries: list[tuple[int, bytes]]) -> dict[str, bytes]:
    """The split files of an archive of (hash, data): four of about equal size, entries on whole sectors."""
    head = _sectors(0x18 + 16 * len(SPLITS) + 16 * len(entries))
    at, records, body = head, b"", []
    for crc, data in entries:
        records += struct.pack(">4I", 0, len(data), crc, at)
        body.append(data.ljust(_sectors(len(data)) * disc.SECTOR, b"\0"))
        at += _sectors(len(data))
    each = max(head, at // len(SPLITS))
    sizes = [each] * (len(SPLITS) - 1)
    sizes.append(max(1, at - sum(sizes)))
    table = b"".join(struct.pack(">II8s", s, 0, n.encode("utf-16-be")) for n, s in zip(SPLITS, sizes))
    stream = (struct.pack(">6I", disc.ARCHIVE_MAGIC, disc.SECTOR, len(SPLITS), 0, len(entries), 0) + table + records).ljust(head * disc.SECTOR, b"\0") + b"".join(body)
    stream = stream.ljust(sum(sizes) * disc.SECTOR, b"\0")
    out, at = {}, 0
    for n, s in zip(SPLITS, sizes):
        out[n] = stream[at * disc.SECTOR : (at + s) * disc.SECTOR]
        at += s
    return out


def write_archives(rows: DataFrame, out: str) -> DataFrame:
    """One image for each `archive` of rows (archive, crc, data), entries by crc; (archive, path). An archive is held by one task."""

    def run(key, group):
        group = group.sort_by("crc")
        entries = [(c & 0xFFFFFFFF, d or b"") for c, d in zip(group.column("crc").to_pylist(), group.column("data").to_pylist())]
        number = key[0].as_py()
        fs, folder = pafs.FileSystem.from_uri(out)
        fs.create_dir(folder, recursive=True)
        temp = f"{folder}/_{uuid.uuid4().hex}"
        with fs.open_output_stream(temp) as f:
            f.write(image(archive(entries), disc.BASES[number % 2]))
        fs.move(temp, f"{folder}/{number}.iso")
        return pa.table({"archive": pa.array([number], pa.int64()), "path": [f"{out}/{number}.iso"]})

    own = rows.select(F.col("archive").cast("long").alias("archive"), F.col("crc").cast("long").alias("crc"), "data")
    return own.groupBy("archive").applyInArrow(run, "archive long, path string")


def package(textures: list[tuple[int, int, int, bytes]]) -> bytes:
    """A package entry of one table of textures (width, height, format code, linear data), each without levels."""
    table, region = [], []
    at = 0
    for w, h, fmt, linear in textures:
        _, size, edge = GPU_FORMATS[fmt]
        room = pixels.padded_size(w, h, size, edge)
        record = bytearray(0xE0)
        struct.pack_into(">HH", record, 0x08, w, h)
        struct.pack_into(">II", record, 0x14, at, room)
        struct.pack_into(">II", record, 0x40, fmt, (h - 1) << 13 | (w - 1))
        table.append(bytes(record))
        region.append(pixels.to_stored(linear, w, h, fmt).ljust(room, b"\0"))
        at += room
    meta = bytes(0x58) + b"".join(table)
    return b"\xff\x3b\xef\x94" + bytes(28) + lzss.block(meta) + b"pad!" + lzss.block(b"".join(region))
