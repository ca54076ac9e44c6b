"""Embedding near-dedup by a pivot-permutation index.

Each vector is described by its ordered nearest pivots. Inverted lists by pivot bring vectors together; pairs in a list that share enough
pivots are candidates, and the exact cosine in double precision decides. A product in single precision first leaves out the pairs of a list
whose cosine is below the threshold by more than its error, so that shared pivots are counted only for the few others. A pair counts only in
the list of its first shared pivot. Vectors of each length have an index of their own; where there are few, all pairs are candidates."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wachter.llm.common import block_pairs, components, list_array, lookup, map_arrow, materialise, utf8

THRESHOLD = 0.9
#: Pivots that describe a vector, and how many a pair of candidates shares.
NEAREST, SHARED = 10, 2
#: The index of each length is fitted on a sample of at most so many distinct vectors (2 sqrt(n) of n), those with the smallest hash; every
#: vector is indexed. Lists so grow as the root of the input.
MAX_PIVOTS = 65_536
#: Vectors of a length that need no pivots; vectors in one block of a list, and components at most unless one vector has more. Most lists are
#: one block, since each further block copies all of a list once more.
FEW, BLOCK, BLOCK_NUMBERS = 1024, 8192, 1 << 19
#: Rows and columns of a product, so that it stays in the processor's cache.
STRIP, TILE = 256, 1024


def pack(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, key, packed, dim): the hash of the components' bytes as doubles, and the components as floats where these hold the same numbers, else
    as doubles; null for vectors that link with nothing."""
    src = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("v")
            at, flat, gone = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False), col.is_null().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", under="ignore"):
                short = flat.astype(np.float32)
            bad, wide = (np.concatenate([[0], np.cumsum(x)]) for x in (~np.isfinite(flat), short != flat))
            some = np.concatenate([[0], np.cumsum(flat != 0)])
            lo, hi = at[:-1], at[1:]
            linking = ~gone & (bad[lo] == bad[hi]) & (some[lo] < some[hi])
            key, out, narrow = [], [], wide[lo] == wide[hi]
            for i in range(b.num_rows):
                if not linking[i]:
                    key.append(None)
                    out.append(None)
                    continue
                x = flat[lo[i] : hi[i]].tobytes()
                key.append(hashlib.md5(x, usedforsecurity=False).hexdigest())
                out.append(short[lo[i] : hi[i]].tobytes() if narrow[i] else x)
            dim = pa.array(hi - lo, pa.int32(), mask=~linking)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(key, pa.string()), pa.array(out, pa.binary()), dim], ["id", "key", "packed", "dim"])

    kinds = src.select("id").withColumns({"key": F.lit(""), "packed": F.lit(b""), "dim": F.lit(0)})
    return map_arrow(src, run, kinds.schema.simpleString()[7:-1].replace(":", " "))


def numbers(packed: pa.Array | pa.ChunkedArray, dim: int, before: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The packed components as a matrix of doubles, and of the bytes that stand before them a matrix of int32."""
    raw, at = utf8(packed)
    size, head, x = np.diff(at), np.empty((len(at) - 1, before), np.int32), np.empty((len(at) - 1, dim))
    for kind in (np.float32, np.float64):
        row = 4 * before + dim * np.dtype(kind).itemsize
        rows = np.flatnonzero(size == row)
        if len(rows):
            b = raw.reshape(-1, row) if len(rows) == len(size) else raw[at[rows][:, None] + np.arange(row)]
            head[rows] = np.ascontiguousarray(b[:, : 4 * before]).view(np.int32)
            x[rows] = np.ascontiguousarray(b[:, 4 * before :]).view(kind)
    return x, head


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def choose_pivots(own: DataFrame, dim: int, n: int) -> np.ndarray:
    """At most MAX_PIVOTS unit vectors of this length; their number grows with the square root of n."""
    want = min(MAX_PIVOTS, math.ceil(2 * math.sqrt(n)))
    rows = own.where(F.col("dim") == dim).orderBy("key").limit(2 * want).select("packed").collect()  # at most 2 * MAX_PIVOTS vectors
    x = _unit(numbers(pa.array([bytes(r[0]) for r in rows], pa.binary()), dim)[0])
    kept, k = np.empty((want, dim)), 0
    for i in range(0, len(x), 256):
        part, before = x[i : i + 256], k
        for v in part[(part @ kept[:k].T).max(1) <= 0.7] if k else part:  # pivots that are near copies of each other tell nothing apart
            if k < want and not (k > before and (kept[before:k] @ v).max() > 0.7):
                kept[k], k = v, k + 1
    return kept[:k]


def nearest_pivots(near: np.ndarray, k: int) -> np.ndarray:
    """For each row of cosines the columns of the k largest, largest first; of equal ones the first."""
    if k == near.shape[1]:
        return np.argsort(-near, 1, kind="stable")
    top = np.sort(np.argpartition(near, near.shape[1] - k, 1)[:, -k:], 1)
    value = np.take_along_axis(near, top, 1)
    out = np.take_along_axis(top, np.argsort(-value, 1, kind="stable"), 1)
    tied = np.flatnonzero((near >= value.min(1, keepdims=True)).sum(1) > k)  # more than k reach the last one's cosine
    out[tied] = np.argsort(-near[tied], 1, kind="stable")[:, :k]
    return out


def described(pivots: dict[int, np.ndarray], dim: int, nearest: int) -> int:
    """By how many pivots a vector of this length is described."""
    return min(nearest, len(pivots[dim])) if dim in pivots else 1


def index(own: DataFrame, pivots: dict[int, np.ndarray], nearest: int = NEAREST) -> DataFrame:
    """(cid, n, dim, near, body) of own(cid, n, dim, packed). near: the numbers of the nearest pivots, nearest first; -1 alone for lengths without
    pivots. body: near's bytes and the components."""
    sent = own.sparkSession.sparkContext.broadcast(pivots)  # at most MAX_PIVOTS vectors of each length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows, p = b.filter(pa.array(dims == dim)), sent.value.get(dim)
                k = described(sent.value, dim, nearest)
                step = max(1, min(500, (1 << 22) // max(dim, 1 if p is None else len(p))))
                for i in range(0, rows.num_rows, step):
                    part = rows.slice(i, step)
                    near = np.full((part.num_rows, 1), -1, np.int32)
                    if p is not None:
                        near = nearest_pivots(_unit(numbers(part.column("packed"), dim)[0]) @ p.T, k).astype(np.int32)
                    body = [a.tobytes() + x for a, x in zip(near, part.column("packed").to_pylist(), strict=True)]
                    near = list_array(near.ravel(), np.full(part.num_rows, k), pa.int32())
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("cid", "n", "dim")), near, pa.array(body, pa.binary())], ["cid", "n", "dim", "near", "body"])

    return map_arrow(own, run, "cid long, n long, dim int, near array<int>, body binary")


def shared_by(near: np.ndarray, i: np.ndarray, j: np.ndarray, pivot: int, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (i, j) of members of a pivot's list share enough pivots, and which of these share an earlier one (and meet there). near
    has a column a member."""
    enough, earlier = np.empty(len(i), bool), np.empty(len(i), bool)
    for s in range(0, len(i), 1 << 14):
        a, b = near[:, i[s : s + (1 << 14)]], near[:, j[s : s + (1 << 14)]]
        count, before = np.zeros(a.shape[1], np.uint8), np.zeros(a.shape[1], bool)
        for one in a:
            both = (b == one).any(0)
            count += both
            before |= both & (one < pivot)
        enough[s : s + (1 << 14)] = count >= min(shared, len(near))
        earlier[s : s + (1 << 14)] = before
    return enough, enough & earlier


def shared_pivots(near: np.ndarray, pivot: int, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """shared_by of all pairs of a list's members, as matrices; near has a row a member."""
    i, j = np.nonzero(~np.eye(len(near), dtype=bool))
    out = np.zeros((2, len(near), len(near)), bool)
    out[:, i, j] = shared_by(np.ascontiguousarray(near.T), i, j, pivot, shared)
    return out[0], out[1]


class Cosines:
    """The pairs of rows of a matrix that have at least this cosine."""

    def __init__(self, x: np.ndarray, threshold: float):
        self.x, self.threshold = x / np.abs(x).max(1, keepdims=True), threshold  # so that no square overflows or vanishes
        self.norm = np.sqrt((self.x * self.x).sum(1))
        self.short = (self.x / self.norm[:, None]).astype(np.float32)
        self.error = (x.shape[1] + 8) * 2.0**-23  # more than twice what rounding to floats can make of a cosine

    def pairs(self, a: np.ndarray, b: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of a row in a and one in b, or of two in a, each pair once; by strips."""
        u = self.short[a]
        v = u if b is None else self.short[b]
        low, high = np.float32(self.threshold - self.error), self.threshold + self.error
        for s in range(0, len(a), STRIP):
            found = []
            for t in range(s if b is None else 0, len(v), TILE):
                score = (u[s : s + STRIP] @ v[t : t + TILE].T).ravel()
                hit = np.flatnonzero(score >= low)
                if len(hit):
                    i, j = np.divmod(hit, min(TILE, len(v) - t))
                    found.append((s + i, t + j, score[hit]))
            if not found:
                continue
            i, j, value = (np.concatenate(x) for x in zip(*found, strict=True))
            if b is None:
                once = j > i
                i, j, value = i[once], j[once], value[once]
            i, j, sure = a[i], (a if b is None else b)[j], value >= high
            unsure = np.flatnonzero(~sure)
            for k in range(0, len(unsure), 1 << 14):
                o = unsure[k : k + (1 << 14)]
                sure[o] = np.einsum("ij,ij->i", self.x[i[o]], self.x[j[o]]) / (self.norm[i[o]] * self.norm[j[o]]) >= self.threshold
            if sure.any():
                yield i[sure], j[sure]


def unite(top: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Links rows i with rows j in top, which has for each row the smallest one that links reach."""
    while True:
        a, b = top[i], top[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while (top[top] != top).any():
            top[:] = top[top]


def _verify(threshold: float, shared: int, wide: dict[int, int]):
    """Of a cell (list, lo, hi): counts of links, and edges that join what its links join. In a cell of two blocks only pairs across count, and only
    the blocks' own components get edges, since their inner ones come from the blocks' own cells."""

    def run(cell: pa.Table) -> pa.Table:
        lst, lo, hi = (cell.column(c)[0].as_py() for c in ("list", "lo", "hi"))
        dim = (lst + 1) >> 32
        pivot = lst - (dim << 32)
        cid, home, size = (cell.column(c).to_numpy() for c in ("cid", "home", "n"))
        x, near = numbers(cell.column("body"), dim, wide.get(dim, 1))
        near, cosines = np.ascontiguousarray(near.T), Cosines(x, threshold)
        rows = np.arange(len(cid))
        top, inner, linked = rows.copy(), rows.copy(), np.zeros(len(cid), np.int64)
        blocks = [rows] if lo == hi else [np.flatnonzero(home == lo), np.flatnonzero(home == hi)]
        met = np.zeros(len(cid), bool)
        for i, j in cosines.pairs(*blocks):
            enough, earlier = shared_by(near, i, j, pivot, shared)
            here = enough & ~earlier
            np.add.at(linked, i[here], size[j[here]])
            np.add.at(linked, j[here], size[i[here]])
            unite(top, i[enough], j[enough])
            met[i[enough]] = met[j[enough]] = True
        if lo != hi:
            for block in blocks:
                for i, j in cosines.pairs(block[met[block]]):
                    enough, _ = shared_by(near, i, j, pivot, shared)
                    unite(inner, i[enough], j[enough])
                    unite(top, i[enough], j[enough])
            top = np.where(inner == rows, top, rows)
        some = np.flatnonzero((linked > 0) | (top != rows))
        return pa.table({"a": cid[some], "b": cid[top[some]], "linked": pa.array(linked[some], pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, nearest: int = NEAREST, shared: int = SHARED, few: int = FEW) -> DataFrame:
    """One row a vector: id, n_links, component (smallest id reachable), kept. Equal vectors are one class, searched once; vectors of different
    lengths link with each other never. Null, empty and zero vectors and those with null or non-finite components link with nothing and are
    kept. A row without id links like any other, but gives no id. An empty table gives no rows."""
    rows = materialise(pack(vectors, id_col, vec_col), "embedding-rows")
    own = rows.where("key is not null").groupBy("key", "dim", "packed").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    own = materialise(own.withColumn("cid", F.monotonically_increasing_id()), "embedding-classes")
    many = own.groupBy("dim").count().where(F.col("count") > few).collect()  # a row for each length that needs an index
    pivots = {r["dim"]: choose_pivots(own, r["dim"], r["count"]) for r in many}
    lists = materialise(index(own.select("cid", "n", "dim", "packed"), pivots, nearest), "embedding-index").withColumn("pivot", F.explode("near"))
    lists = lists.withColumn("list", F.shiftleft(F.col("dim").cast("long"), 32) + F.col("pivot"))
    lists = lists.drop("near", "pivot")
    cells = block_pairs(lists, "list", "cid", BLOCK, "dim", BLOCK_NUMBERS).drop("dim").groupBy("list", "lo", "hi")
    wide = {dim: described(pivots, dim, nearest) for dim in pivots}
    links = materialise(cells.applyInArrow(_verify(threshold, shared, wide), "a long, b long, linked long"), "embedding-links")
    comps = components(links.select("a", "b").where("a <> b"), "embedding-components")
    linked = links.groupBy(F.col("a").alias("cid")).agg(F.sum("linked").alias("linked"))
    told = materialise(comps.select(F.col("id").alias("cid"), "component").join(linked, "cid", "left").join(own.select("cid", "key", "low", "n"), "cid"), "embedding-linked")
    low = materialise(told.groupBy("component").agg(F.min("low").alias("lowest")), "embedding-lowest")
    found = told.join(lookup(low), "component").select("key", "n", F.coalesce("linked", F.lit(0).cast("long")).alias("linked"), "lowest")
    alone = own.where("n > 1").join(told.select("cid"), "cid", "left_anti").select("key", "n", F.lit(0).cast("long").alias("linked"), F.col("low").alias("lowest"))
    found = materialise(found.union(alone), "embedding-result").withColumnRenamed("key", "_key")
    out = rows.select("id", "key").join(lookup(found), F.col("key") == F.col("_key"), "left")
    is_linked = F.col("_key").isNotNull()
    out = out.select("id", F.when(is_linked, F.col("n") - 1 + F.col("linked")).otherwise(F.lit(0)).alias("n_links"), F.when(is_linked, F.col("lowest")).otherwise(F.col("id")).alias("component"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.col("n_links") == 0))


def digest(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept; nulls, repeats, ties and empties as in near_duplicates."""
    return near_duplicates(embeddings).select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")
