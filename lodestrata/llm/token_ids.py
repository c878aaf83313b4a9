"""Token ids in files of byte-aligned variable-length numbers, in ascending document order.

Rows are range-partitioned by document id; each range becomes one file of
blocks. A block's ids are numbered by their frequency in it (most frequent
first, ties by smaller id), and these ranks are stored in one to four bytes
each: a separate run of control bytes holds four two-bit lengths a byte, another
run the data bytes. Decoding looks lengths and offsets up in tables by control
byte, in numpy. A block decodes by itself, so reading needs no whole file.

A block has: magic, numbers of documents, distinct ids and ids; the ids by rank
(u32); document ids (i64) with a null mark each (u8); ids a document (u32);
control bytes; data bytes. All little-endian. Files are written under another
name and then moved, so a task that runs twice leaves one whole file. The
manifest is a table with a row a block; starts are summed in two levels.

Defined results: a null or empty text has the end id alone; a text of any length
is one document of one block. Null document ids come first; rows of one id
follow one another in the order of a hash of their texts. An empty table makes
no file. Further columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm import pretoken, store

MAGIC = b"LSVB0001"
#: Files at most, and bytes of text that are encoded together.
FILES, CHUNK = 20_000, 2 << 20
#: Places in a worker's memo, as a power of two (some 60 bytes each, half of them used).
MEMO = 21
_MANIFEST = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("path", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())])

_codes = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
#: By control byte: the four lengths, where each starts, and their sum.
LENGTHS = (_codes + 1).astype(np.int64)
STARTS = np.concatenate((np.zeros((256, 1), np.int64), np.cumsum(LENGTHS, 1)[:, :3]), 1)
TOTALS = LENGTHS.sum(1)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit numbers."""
    v = values.astype("<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The inverse of pack, by table lookup, for the first `n` numbers."""
    out = np.empty(n, np.uint32)
    group = np.concatenate(([0], np.cumsum(TOTALS[control])))
    data = np.concatenate((data, np.zeros(4, np.uint8)))
    step = 1 << 18
    for a in range(0, len(control), step):
        c = control[a : a + step]
        at = (group[a : a + len(c), None] + STARTS[c]).ravel()
        size = LENGTHS[c].ravel()
        v = data[at].astype(np.uint32)
        for j in (1, 2, 3):
            more = np.flatnonzero(size > j)
            if len(more):
                v[more] |= data[at[more] + j].astype(np.uint32) << np.uint32(8 * j)
        out[4 * a : 4 * a + len(v)] = v[: max(0, n - 4 * a)]
    return out


class Encoder:
    """The tokenizers library, given the distinct words of what a worker's memo lacks."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        # the same model for words that are lowered and split already
        self.of_words = Tokenizer(self.tok.model)
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.path = path
        with open(path, encoding="utf-8") as f:
            self.specials = pretoken.Specials(json.load(f)["added_tokens"])
        self.memo = pretoken.Memo(MEMO)

    def encode_words(self, words: list[str]) -> pretoken.Ragged:
        """The ids of each word (none of an empty one)."""
        n = np.zeros(len(words), np.int64)
        full = np.flatnonzero(np.array([bool(w) for w in words], bool))
        ids = []
        for k in range(0, len(full), 20_000):
            own = full[k : k + 20_000]
            found = self.of_words.encode(" ".join([words[j] for j in own.tolist()]), add_special_tokens=False)
            n[own] = np.bincount(found.word_ids, minlength=len(own))
            ids.append(np.array(found.ids, np.int64))
        return np.concatenate(ids) if ids else np.zeros(0, np.int64), np.concatenate(([0], np.cumsum(n)))

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's start, where they end), in the order of the texts."""
        ids, starts, ends = pretoken.encode_many(texts, self.specials, self.path, self.encode_words, self.memo)
        if (starts[1:] == ends[:-1]).all():
            return ids, starts, ends
        rows = [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        after = np.cumsum(ends - starts)
        return np.concatenate(rows), after - (ends - starts), after


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_block(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """One block's bytes."""
    n_of = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    ranked = np.argsort(-n_of, kind="stable")[: int((n_of > 0).sum())].astype("<u4")
    rank = np.zeros(len(n_of), np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    control, data = pack(rank[ids])
    head = np.array([len(doc_ids), len(ranked), len(ids)], "<u8").tobytes()
    keys = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], np.uint8).tobytes()
    return b"".join((MAGIC, head, ranked.tobytes(), keys, np.array(counts, "<u4").tobytes(), control, data))


def decode_block(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, whether null, ids a document, ids)."""
    if blob[:8] != MAGIC:
        raise ValueError("not a token id block")
    docs, distinct, total = (int(x) for x in np.frombuffer(blob, "<u8", 3, 8))
    at = 32
    parts = []
    for kind, n in (("<u4", distinct), ("<i8", docs), ("u1", docs), ("<u4", docs), ("u1", -(-total // 4))):
        parts.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    ranked, keys, null, counts, control = parts
    ranks = unpack(control, np.frombuffer(blob, np.uint8, offset=at), total)
    return keys, null.astype(bool), counts, ranked[ranks] if total else np.zeros(0, np.uint32)


def write(docs: DataFrame, path: str, out: str, end_id: int = 1, text: str = "text", key: str = "doc_id", mb: float = 8, block_mb: float = 12) -> DataFrame:
    """Write all rows' ids under `out`; the manifest table: (part, block, path, offset, size, docs, ids, start), a row a block.

    A file takes some `mb` MB of stored input, more where that would make over
    FILES of them; a task holds one block of `block_mb` MB of text at a time.
    """
    spark = docs.sparkSession

    def run(batches):
        from pyspark import TaskContext

        part, code = TaskContext.get().partitionId(), encoder(path)
        name, temp, file, at, rows = f"{out}/ids-{part:07d}.lsvb", f"_{part:07d}-{uuid.uuid4().hex}", None, 0, []
        fs, folder = pafs.FileSystem.from_uri(out)
        keys: list[int | None] = []
        counts: list[int] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush():
            nonlocal file, at, held
            if file is None:
                fs.create_dir(folder, recursive=True)
                file = fs.open_output_stream(f"{folder}/{temp}")
            blob = encode_block(keys, counts, np.concatenate(ids))
            file.write(blob)
            rows.append({"part": part, "block": len(rows), "path": name, "offset": at, "size": len(blob), "docs": len(keys), "ids": sum(counts)})
            at, held = at + len(blob), 0
            keys.clear(), counts.clear(), ids.clear()

        for batch in batches:
            for a, b in store.chunks(store.utf8(batch.column(1))[1], min(CHUNK, int(block_mb * 1e6))):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                keys += batch.column(0).slice(a, b - a).to_pylist()
                found, starts, ends = code.encode_many(texts)
                found = np.insert(found, ends, end_id)
                counts += (ends - starts + 1).tolist()
                ids.append(found.astype(np.uint16) if len(found) and found.max() < 1 << 16 else found.astype(np.uint32))
                held += sum(map(len, texts))
                if held >= block_mb * 1e6:
                    flush()
        if keys:
            flush()
        if file is not None:
            file.close()
            fs.move(f"{folder}/{temp}", f"{folder}/ids-{part:07d}.lsvb")
            yield pa.RecordBatch.from_pylist(rows, _MANIFEST)

    # equal ids are told apart by a hash of their texts, equal rows by their place in the scan, so no key lands whole in one task
    own = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"), F.monotonically_increasing_id().alias("_at"))
    files = min(FILES, store.parts(docs, mb))
    own = own.repartitionByRange(files, key, "_hash", "_at").sortWithinPartitions(key, "_hash", "_at").select(key, "_text")
    blocks = store.kept(own.mapInArrow(run, "part int, block int, path string, offset long, size long, docs long, ids long"), "token-id-blocks")
    # one row a file, so at most FILES of them, are summed in order; then a file's blocks
    totals = blocks.groupBy("part").agg(F.sum("ids").alias("_n"))
    totals = totals.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    inside = F.sum("ids").over(Window.partitionBy("part").orderBy("block")) - F.col("ids")
    made = blocks.withColumn("_own", inside).join(F.broadcast(totals), "part").withColumn("start", F.col("_before") + F.col("_own"))
    return store.kept(made.select(*blocks.columns, "start"), "token-id-manifest")


def read(manifest: DataFrame, ids: bool = True) -> DataFrame:
    """One row a document from the files: doc_id, start, n_tokens, ids_crc32 and (with `ids`) the ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def run(batches):
        for batch in batches:
            for before, name, offset, size in zip(*(batch.column(k).to_pylist() for k in range(4))):
                fs, at = pafs.FileSystem.from_uri(name)
                with fs.open_input_file(at) as f:
                    f.seek(offset)
                    keys, null, counts, found = decode_block(f.read(size))
                ends = np.cumsum(counts, dtype=np.int64)
                raw = memoryview(found.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                columns = [pa.array(keys, pa.int64(), mask=null), pa.array(before + ends - counts), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    tasks = min(FILES, max(1, manifest.count()))
    return manifest.repartition(tasks, "part", "block").select("start", "path", "offset", "size").mapInArrow(run, schema)
