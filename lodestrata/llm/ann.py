"""Nearest neighbours by largest inner product: robust-pruned directed graphs, one a shard, searched by beams.

Equal vectors become one class. Classes are dealt to shards by a hash; a shard
is one graph of up to SHARD vectors, built and kept as a file in the shared
folder. Vectors are scaled by the largest norm, and one more coordinate,
sqrt(1 - |x|^2), gives all of them the same norm, so inner products and distances
order alike. A point's neighbours are proposed by a greedy search from the
shard's medoid and pruned: the nearest is kept and drops every candidate that it
is nearer to by the factor ALPHA, so diverse edges stay; edges go both ways,
pruned again beyond DEGREE. Queries go in blocks to every shard; a beam search
there gives the best classes, scored in double precision on the original
vectors, and the best of all shards are merged and their members listed.

The shards' number follows memory (SHARD), but there are up to PARALLEL of them
where each keeps LEAST vectors, so that a small table is built by many tasks.

Every row is indexed. Defined results: vectors that are null, zero, or hold null
or non-finite components, and rows without id, take no part. Vectors of unlike
lengths are never compared: each length has its own shards. Repeated rows count
once, as a query and as a candidate. An id with several vectors asks with each
and answers with each; its score is the best of them, and no id is twice in an
answer. A query's own id is never in its answer; other rows with equal vectors
are, smaller ids first. Fewer candidates than asked for give fewer rows; an empty
table gives none. Further columns are ignored.
"""

from __future__ import annotations

import io
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm import store

SHARD, LEAST, PARALLEL = 1 << 18, 8192, 16
DEGREE, BUILD_BEAM, ALPHA = 32, 64, 1.2
SEARCH_BEAM, EXPAND = 160, 8
#: Queries a task, and marks of visited points that a search holds at a time.
BLOCK, SEEN = 512, 1 << 25


def beam_search(points: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int, expand: int = EXPAND):
    """(ids, inner products) of the `beam` best found for each query, best first; -1 where fewer."""
    q, n = len(queries), len(points)
    ids = np.full((q, beam), -1, np.int64)
    near = np.full((q, beam), -np.inf, np.float32)
    done = np.ones((q, beam), bool)
    seen = np.zeros((q, n), bool)
    ids[:, 0], near[:, 0], done[:, 0], seen[:, start] = start, queries @ points[start], False, True
    live = np.arange(q)
    while len(live):
        open_ = ~done[live]
        chosen = open_ & (np.cumsum(open_, 1) <= expand)
        row, col = np.nonzero(chosen)
        done[live[row], col] = True
        to = graph[ids[live[row], col]]
        flat = (live[row][:, None] * n + to)[to >= 0]
        flat = np.unique(flat[~seen.ravel()[flat]])
        seen.ravel()[flat] = True
        who, new = flat // n, flat % n
        if len(flat):
            score = np.einsum("ij,ij->i", queries[who], points[new])
            count = np.bincount(who, minlength=q)
            width = int(count.max())
            place = np.arange(len(who)) - np.repeat((np.cumsum(count) - count)[count > 0], count[count > 0])
            more_ids, more_near = np.full((q, width), -1, np.int64), np.full((q, width), -np.inf, np.float32)
            more_ids[who, place], more_near[who, place] = new, score
            all_near = np.concatenate((near[live], more_near[live]), 1)
            order = np.argsort(-all_near, 1, kind="stable")[:, :beam]
            near[live] = np.take_along_axis(all_near, order, 1)
            ids[live] = np.take_along_axis(np.concatenate((ids[live], more_ids[live]), 1), order, 1)
            ended = np.concatenate((done[live], np.zeros((len(live), width), bool)), 1)
            done[live] = np.take_along_axis(ended, order, 1) | (ids[live] < 0)
        live = live[(~done[live]).any(1)]
    return ids, near


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, norm2: float) -> np.ndarray:
    """(rows x DEGREE) neighbours of the points `own` from rows of candidates (-1: none; no repeats)."""
    rows, width = candidates.shape
    valid = (candidates >= 0) & (candidates != own[:, None])
    x = points[np.where(valid, candidates, 0)]
    far = np.sqrt(np.maximum(2 * (norm2 - np.einsum("bij,bj->bi", x, points[own])), 0))
    far[~valid] = np.inf
    between = np.sqrt(np.maximum(2 * (norm2 - np.matmul(x, x.transpose(0, 2, 1))), 0))
    out = np.full((rows, DEGREE), -1, np.int64)
    left = valid.copy()
    at = np.arange(rows)
    for k in range(DEGREE):
        best = np.where(left, far, np.inf).argmin(1)
        any_ = left[at, best]
        if not any_.any():
            break
        out[any_, k] = candidates[at, best][any_]
        left &= ALPHA * between[at, best] > far
        left[at, best] = False
    return out


def build(points: np.ndarray, norm2: float, seed: int = 3, batch: int = 192) -> tuple[np.ndarray, int]:
    """(neighbours, medoid) of the graph over `points` (all of squared norm norm2)."""
    n = len(points)
    rng = np.random.default_rng(seed)
    medoid = int((points @ points.mean(0)).argmax())
    graph = np.full((n, DEGREE), -1, np.int64)
    if n > 1:
        first = rng.integers(0, n - 1, (n, min(n - 1, DEGREE // 2)))
        graph[:, : first.shape[1]] = first + (first >= np.arange(n)[:, None])
        for k in range(1, first.shape[1]):  # no repeats
            graph[(graph[:, :k] == graph[:, k : k + 1]).any(1), k] = -1
    order = rng.permutation(n)
    beam = min(BUILD_BEAM, max(2, n))
    for a in range(0, n, batch):
        own = order[a : a + batch]
        found, _ = beam_search(points, graph, medoid, points[own], beam, 4)
        joined = np.concatenate((found, graph[own]), 1)
        joined = np.sort(joined, 1)
        joined[:, 1:][joined[:, 1:] == joined[:, :-1]] = -1
        graph[own] = robust_prune(points, own, joined, norm2)
        src = np.repeat(own, DEGREE)
        dst = graph[own].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        new = ~(graph[dst] == src[:, None]).any(1)
        src, dst = src[new], dst[new]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        hit, at, count = np.unique(dst, return_index=True, return_counts=True)
        if len(hit):
            extra = np.full((len(hit), int(count.max())), -1, np.int64)
            row = np.repeat(np.arange(len(hit)), count)
            extra[row, np.arange(len(dst)) - np.repeat(at, count)] = src
            joined = np.concatenate((graph[hit], extra), 1)
            fits = (joined >= 0).sum(1) <= DEGREE
            packed = np.take_along_axis(joined, np.argsort(joined < 0, 1, kind="stable"), 1)
            graph[hit[fits]] = packed[fits][:, :DEGREE]
            over = np.flatnonzero(~fits)
            for b in range(0, len(over), batch):
                some = over[b : b + batch]
                graph[hit[some]] = robust_prune(points, hit[some], joined[some], norm2)
    return graph, medoid


def _save(path: str, **arrays: np.ndarray) -> None:
    fs, at = pafs.FileSystem.from_uri(path)
    folder = at.rpartition("/")[0]
    fs.create_dir(folder, recursive=True)
    blob = io.BytesIO()
    np.savez(blob, **arrays)
    temp = f"{folder}/_{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as f:
        f.write(blob.getbuffer())
    fs.move(temp, at)


@lru_cache(maxsize=2)
def _load(path: str) -> dict:
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(at) as f, np.load(io.BytesIO(f.read())) as found:
        return dict(found)


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def valid_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id long, vector, size) of the rows that take part, each once; floats stay floats, other numbers become doubles."""
    kind = "array<float>" if table.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    return rows.distinct().withColumn("size", F.size("vector"))


def members(vectors: DataFrame, most: int) -> DataFrame:
    """(rep, tag, id, vector, size, place) of the `most` smallest ids of each vector; rep, the smallest, and tag name the class."""
    # a group limit before the shuffle: of a hot vector each task passes on `most` rows
    own = Window.partitionBy("vector")
    ranked = vectors.withColumn("place", F.row_number().over(own.orderBy("id"))).where(F.col("place") <= most)
    return ranked.withColumn("rep", F.min("id").over(own)).withColumn("tag", F.xxhash64("vector")).select("rep", "tag", "id", "vector", "size", "place")


def build_index(classes: DataFrame, out: str, shard_rows: int | None = None) -> DataFrame:
    """Write a graph file a shard of the classes (rep, tag, vector, size) under `out`; the shards: (size, shard, vectors)."""
    norm2 = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, largest = classes.agg(F.count("*"), F.max(norm2)).first()
    shards = max(1, -(-n // (shard_rows or SHARD)), 0 if shard_rows else min(PARALLEL, -(-n // LEAST)))
    unit = float(largest or 1.0) ** 0.5

    def make(key, group):
        x, reps, tags = _matrix(group.column("vector")), group.column("rep").to_numpy(), group.column("tag").to_numpy()
        order = np.lexsort((tags, reps))
        x, reps, tags = x[order], reps[order], tags[order]
        scaled = x.astype(np.float64) / unit
        rest = np.sqrt(np.maximum(1 - (scaled**2).sum(1), 0))
        points = np.concatenate((scaled, rest[:, None]), 1).astype(np.float32)
        graph, medoid = build(points, 1.0)
        size, shard = (k.as_py() for k in key)
        _save(f"{out}/shard-{size}-{shard}.npz", vectors=x, points=points, reps=reps, tags=tags, graph=graph.astype(np.int32), start=np.array(medoid))
        return pa.table({"size": pa.array([size], pa.int32()), "shard": pa.array([shard], pa.int32()), "vectors": [len(x)]})

    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("rep", "tag"), F.lit(shards)).cast("int"))
    return store.kept(dealt.groupBy("size", "shard").applyInArrow(make, "size int, shard int, vectors long"), "ann-shards")


def search(table: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", shard_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row whose id is divisible by `every`."""
    spark = table.sparkSession
    vectors = store.kept(valid_vectors(table, key, vector), "vectors")
    named = store.kept(members(vectors, k + 1), "vector-members")
    out = store.fresh(spark, "ann-index")
    shards = build_index(named.where(F.col("place") == 1), out, shard_rows)
    asked = vectors.where(F.col("id") % every == 0)
    blocks = max(1, -(-asked.count() // BLOCK))
    asked = asked.select("id", "vector", "size", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    # every block of the stated query set goes to every shard of its vectors' length; a row a shard is broadcast
    asked = asked.join(F.broadcast(shards.select("size", "shard")), "size")

    def run(key, group):
        index = _load(f"{out}/shard-{key[0].as_py()}-{key[1].as_py()}.npz")
        q, ids = _matrix(group.column("vector")), group.column("id").to_numpy()
        x, points, graph = index["vectors"], index["points"], index["graph"]
        parts, step = [], max(1, SEEN // len(points))
        for a in range(0, len(q), step):
            own = q[a : a + step].astype(np.float64)
            scaled = own / np.abs(own).max(1, keepdims=True)
            found, _ = beam_search(points, graph, int(index["start"]), np.pad(scaled, ((0, 0), (0, 1))).astype(np.float32), min(SEARCH_BEAM, len(points)))
            found = found[:, : 2 * k + 8]
            score = np.einsum("qij,qj->qi", x[np.maximum(found, 0)].astype(np.float64), own)
            score[found < 0] = -np.inf
            best = np.lexsort((index["reps"][found], -score))[:, : k + 1]
            found, score = np.take_along_axis(found, best, 1), np.take_along_axis(score, best, 1)
            keep = found >= 0
            parts.append(pa.table({"query_id": np.repeat(ids[a : a + step], keep.sum(1)), "rep": index["reps"][found[keep]], "tag": index["tags"][found[keep]], "score": score[keep]}))
        return pa.concat_tables(parts)

    near = asked.groupBy("size", "shard", "block").applyInArrow(run, "query_id long, rep long, tag long, score double")
    near = near.groupBy("query_id", "rep", "tag").agg(F.max("score").alias("score"))
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    near = near.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1).drop("_r")
    rows = near.join(named.select("rep", "tag", "id"), ["rep", "tag"]).where(F.col("id") != F.col("query_id"))
    rows = rows.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    rows = rows.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return rows.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
