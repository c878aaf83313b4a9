"""Synthetic disc images and packages, written from the layouts' descriptions."""

from __future__ import annotations

import struct

import numpy as np

from lodestrata.functions import lzss, pixels
from lodestrata.functions.fields import GPU_FORMATS
from lodestrata.sources import disc


def image(files: dict[str, bytes], base: int = 0) -> bytes:
    """A disc image with files in the root and in folders ('a/b')."""
    tree: dict = {}
    for path, data in files.items():
        *folders, name = path.split("/")
        at = tree
        for f in folders:
            at = at.setdefault(f, {})
        at[name] = data
    sectors: dict[int, bytes] = {}
    free = [disc.VOLUME_SECTOR + 1]

    def put(data: bytes) -> int:
        at = free[0]
        sectors[at] = data
        free[0] += max(1, -(-len(data) // disc.SECTOR))
        return at

    def folder(entries: dict) -> tuple[int, int]:
        names = sorted(entries)
        nodes = []
        for name in names:
            x = entries[name]
            lba, size = folder(x) if isinstance(x, dict) else (put(x), len(x))
            nodes.append([0, 0, lba, size, disc.DIRECTORY if isinstance(x, dict) else 0x80, name])
        offsets, at = {}, 0
        order = []

        def balance(lo, hi):
            if lo >= hi:
                return None
            mid = (lo + hi) // 2
            order.append(mid)
            return mid, balance(lo, mid), balance(mid + 1, hi)

        root = balance(0, len(nodes))
        for k in order:
            offsets[k] = at
            at += -(-(14 + len(nodes[k][5])) // 4) * 4

        def link(t):
            if t:
                k, left, right = t
                nodes[k][0] = offsets[left[0]] // 4 if left else 0
                nodes[k][1] = offsets[right[0]] // 4 if right else 0
                link(left)
                link(right)

        link(root)
        table = bytearray(b"\xff" * at)
        for k, (left, right, lba, size, attrs, name) in enumerate(nodes):
            raw = struct.pack("<HHIIBB", left, right, lba, size, attrs, len(name)) + name.encode("latin-1")
            table[offsets[k] : offsets[k] + len(raw)] = raw
        return put(bytes(table)), len(table)

    root, size = folder(tree)
    volume = disc.VOLUME_MAGIC + struct.pack("<II", root, size)
    out = bytearray(base + free[0] * disc.SECTOR)
    out[base + disc.VOLUME_SECTOR * disc.SECTOR :][: len(volume)] = volume
    out[base + disc.VOLUME_SECTOR * disc.SECTOR : base + disc.VOLUME_SECTOR * disc.SECTOR + len(volume)] = volume
    for at, data in sectors.items():
        out[base + at * disc.SECTOR : base + at * disc.SECTOR + len(data)] = data
    return bytes(out)


def archive(entries: list[tuple[int, bytes]], splits: list[int], align: int = 2048) -> dict[str, bytes]:
    """Split files ('0A', '0B', ...) of an archive of (crc, data); `splits` are sizes in sectors of all but the last."""
    names = ["0A", "0B", "1A", "1B"][: len(splits) + 1]
    head = 0x18 + 16 * len(names) + 16 * len(entries)
    at = -(-head // align)
    body, records = b"", b""
    for crc, data in entries:
        records += struct.pack(">4I", 0, len(data), crc, at)
        size = -(-len(data) // align)
        body += data.ljust(size * align, b"\0")
        at += size
    stream_size = at
    sizes = [*splits, stream_size - sum(splits)]
    table = b"".join(struct.pack(">II", s, 0) + n.encode("utf-16-be").ljust(8, b"\0") for n, s in zip(names, sizes))
    stream = (struct.pack(">6I", disc.ARCHIVE_MAGIC, align, len(names), 0, len(entries), 0) + table + records).ljust(-(-head // align) * align, b"\0") + body
    out, at = {}, 0
    for n, s in zip(names, sizes):
        out[n] = stream[at * align : (at + s) * align]
        at += s
    return out


def picture(w: int, h: int, seed: int = 0) -> np.ndarray:
    """A smooth RGBA image."""
    y, x = np.mgrid[0:h, 0:w]
    r = np.random.default_rng(seed).uniform(0.5, 3, 6)
    rgb = [127 + 120 * np.sin(r[k] * x / w * 6 + r[k + 3] * y / h * 6) for k in range(3)]
    return np.stack([*rgb, np.full((h, w), 255)], -1).astype(np.uint8)


def descriptor(w: int, h: int, off: int, fmt: int, mips: int, tail: int) -> bytes:
    kind, block, edge = GPU_FORMATS[fmt]
    out = bytearray(0xE0)
    struct.pack_into(">HH", out, 8, w, h)
    struct.pack_into(">III", out, 0x14, off, pixels.padded_size(w, h, block, edge), tail)
    struct.pack_into(">II", out, 0x40, fmt, (h - 1) << 13 | (w - 1))
    struct.pack_into(">I", out, 0x4C, (mips - 1) << 6)
    return bytes(out)


def package(textures: list[tuple[np.ndarray, int]], order: list[int] | None = None, sentinel: bool = False) -> tuple[bytes, bytes]:
    """(packed entry, pixel data) with one table of textures (image, format); `order` is the storage order."""
    order = order or list(range(len(textures)))
    region, offs, tails = b"", {}, {}
    for k in order:
        img, fmt = textures[k]
        kind, block, edge = GPU_FORMATS[fmt]
        base = pixels.to_stored(pixels.encode(img, kind), img.shape[1], img.shape[0], fmt).ljust(pixels.padded_size(img.shape[1], img.shape[0], block, edge), b"\0")
        half = img.reshape(img.shape[0] // 2, 2, img.shape[1] // 2, 2, 4).mean((1, 3)).astype(np.uint8)
        mip = pixels.to_stored(pixels.encode(half, kind), half.shape[1], half.shape[0], fmt)
        mip = mip.ljust(-(-len(mip) // 0x1000) * 0x1000, b"\0")
        offs[k], tails[k] = len(region), len(mip)
        region += base + mip
    meta = b"\0" * 0x58 + b"".join(descriptor(t[0].shape[1], t[0].shape[0], 0x1000 if sentinel else offs[k], t[1], 2, tails[k]) for k, t in enumerate(textures))
    raw = b"\xff\x3b\xef\x94" + b"\0" * 0x1C + lzss.block(meta, 12) + b"pad!" + lzss.block(region, 12)
    return raw, region
