"""Many images at once: their directories, archive entries, contents and blocks, read by range on the executors."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestrata.functions import audio, lzss
from lodestrata.sources import disc


@lru_cache(maxsize=64)
def _opened(path: str) -> disc.Archive:
    return disc.Archive.open(path)


def files(images: DataFrame) -> DataFrame:
    """(path, file, lba, size, is_dir, offset) of every file and folder of images (path)."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with disc.open_path(path) as f:
                    rows = disc.directory(f, disc.partition_base(f))
                yield pa.RecordBatch.from_pylist([{"path": path, "file": x["path"], **{c: x[c] for c in ("lba", "size", "is_dir", "offset")}} for x in rows], _FILES)

    return images.select("path").mapInArrow(run, "path string, file string, lba long, size long, is_dir boolean, offset long")


_FILES = pa.schema([("path", pa.string()), ("file", pa.string()), ("lba", pa.int64()), ("size", pa.int64()), ("is_dir", pa.bool_()), ("offset", pa.int64())])


def _with_data(rows: DataFrame) -> T.StructType:
    return T.StructType([*rows.schema.fields, T.StructField("data", T.BinaryType())])


def ranges(rows: DataFrame, first: int = 0, length: int | None = None) -> DataFrame:
    """Disc files (path, file, size, offset, ...) with `data`, a byte range of each."""

    def run(batches):
        for batch in batches:
            data = [disc.read_disc_file(p, {"size": s, "offset": o}, length, first) for p, s, o in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "offset")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=[*batch.schema.names, "data"])

    return rows.mapInArrow(run, _with_data(rows))


def entries(images: DataFrame) -> DataFrame:
    """(archive, path, idx, size, crc, offset, splits) of the archives in images (archive, path); `splits` counts the split files that an entry's bytes lie in."""

    def run(batches):
        for batch in batches:
            for number, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = disc.Archive.open(path)
                with disc.open_path(path) as f:
                    rows = found.records(f, 0, found.entries)
                yield pa.RecordBatch.from_pylist([{"archive": number, "path": path, "idx": i, "size": n, "crc": c, "offset": o, "splits": len(found.pieces(o, n))} for i, _, n, c, o in rows], _ENTRIES)

    return images.select("archive", "path").mapInArrow(run, "archive long, path string, idx long, size long, crc long, offset long, splits long")


_ENTRIES = pa.schema([("archive", pa.int64()), ("path", pa.string()), ("idx", pa.int64()), ("size", pa.int64()), ("crc", pa.int64()), ("offset", pa.int64()), ("splits", pa.int64())])


def spans(rows: DataFrame, first: int = 0, length: int | None = None) -> DataFrame:
    """Entries (path, size, offset, ...) with `data`: all bytes, a head, or a span clipped to the entry."""

    def run(batches):
        for batch in batches:
            data = []
            for path, size, offset in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "offset"))):
                own = _opened(path)
                left = max(0, size - first)
                with disc.open_path(path) as f:
                    data.append(own.read(f, offset + min(first, size), left if length is None else min(length, left)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=[*batch.schema.names, "data"])

    return rows.mapInArrow(run, _with_data(rows))


def blocks(rows: DataFrame, key: str, data: str = "data", strict: bool = True) -> DataFrame:
    """(key, block, position, size, packed, offbits, start) of the blocks of each value; `start` is the sum of the sizes before."""

    def run(batches):
        for batch in batches:
            out = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = 0
                for j, (at, size, packed, offbits) in enumerate(lzss.find_blocks(raw or b"", strict)):
                    out.append((k, j, at, size, packed, offbits, start))
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 7)], names=[key, "block", "position", "size", "packed", "offbits", "start"])

    return rows.select(rows[key].cast("long").alias(key), data).mapInArrow(run, f"{key} long, block long, position long, size long, packed long, offbits long, start long")


def unpacked(rows: DataFrame, key: str, data: str = "data") -> DataFrame:
    """(key, blocks, data, error): the blocks' data of each value, concatenated; a corrupt value has an error and no data."""

    def run(batches):
        for batch in batches:
            out = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    whole, bounds = lzss.unpack_entry(raw or b"")
                    out.append((k, len(bounds), whole, None))
                except ValueError as e:
                    out.append((k, 0, None, str(e)))
            k, n, whole, error = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(whole, pa.binary()), pa.array(error, pa.string())], names=[key, "blocks", "data", "error"])

    return rows.select(rows[key].cast("long").alias(key), data).mapInArrow(run, f"{key} long, blocks long, data binary, error string")


def sounds(rows: DataFrame, key: str, data: str = "data") -> DataFrame:
    """(key, index, rate, size, offset, samples, seconds, data) of every sound of bank entries."""

    def run(batches):
        for batch in batches:
            out = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, payload = audio.parse_bank(raw)
                out += [{key: k, **{c: s[c] for c in ("index", "rate", "size", "offset", "samples", "seconds")}, "data": audio.read_sound(raw, s, payload)} for s in found]
            yield pa.RecordBatch.from_pylist(out, pa.schema([(key, pa.string()), *[(c, pa.int64()) for c in ("index", "rate", "size", "offset", "samples")], ("seconds", pa.float64()), ("data", pa.binary())]))

    return rows.select(rows[key].cast("string").alias(key), data).mapInArrow(run, f"{key} string, index long, rate long, size long, offset long, samples long, seconds double, data binary")
