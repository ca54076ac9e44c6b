"""Shared parts: work folders, vectorised tokenising of Arrow text, ordered prefix sums, components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wachter.work import work_path

#: A token of the contracts: bytes other than space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
M1, M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
GOLD = U64(0x9E3779B97F4A7C15)
#: Bytes that separate tokens: space and 0x09 to 0x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Also everything of ASCII that is neither a letter nor a digit.
NOT_WORD = np.array([not (chr(b).isalnum() or b >= 0x80) for b in range(256)])


# --- work folders -----------------------------------------------------------------------------


#: Spark then deletes a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Cut the lineage: write to the shared work folder and read back, so that a lost executor costs one task, not the plan. The table stands for
    the shuffles that made it, whose files are deleted: disks hold those of one table at a time."""
    spark = df.sparkSession
    path = work_path(spark, name)
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Delete the files of materialised frames that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        for f in {x.rsplit("/", 1)[0].split("/part=")[0] for x in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns the memory that a Python worker's allocators hold back, so that workers between two tasks are small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- text as bytes ----------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> U64(30))
    x = x * M1
    x ^= x >> U64(27)
    x *= M2
    x ^= x >> U64(31)
    return x


def _letters(lower: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=U64) * GOLD)
    if lower:
        table[65:91] = table[97:123]
    return table


_LETTERS = {True: _letters(True), False: _letters(False)}
OTHER_LETTERS = mix(np.arange(1, 257, dtype=U64) * M1)
_POWERS = np.ones(1, U64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 4096), 0xD6E8FEB86659FD93, U64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins in them (and the last ends). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


class Tokens:
    """All tokens of a batch of texts. lens: tokens by text; starts, ends: byte positions; hashes: 64 bits of the token's bytes."""

    def __init__(self, column: pa.Array, white: np.ndarray = WHITE, lower: bool = True, hashes: bool = True):
        self.raw, self.at = utf8(column)
        black = ~white[self.raw]
        # a token begins at a byte that isn't white, after a white one or at a text's first byte
        first = np.zeros(len(black) + 1, bool)
        first[self.at[:-1]] = True
        first = first[:-1]
        begin = black.copy()
        begin[1:] &= first[1:] | ~black[:-1]
        self.starts = np.flatnonzero(begin)
        stop = black.copy()
        stop[:-1] &= begin[1:] | ~black[1:]
        self.ends = np.flatnonzero(stop) + 1
        bounds = np.searchsorted(self.starts, self.at)
        self.first, self.lens = bounds[:-1], np.diff(bounds)
        self.hashes = self._hash(black, lower) if hashes else None

    def _hash(self, black: np.ndarray, lower: bool) -> np.ndarray:
        return hash_runs(self.raw[black], self.ends - self.starts, _LETTERS[lower])


def hash_runs(raw: np.ndarray, size: np.ndarray, letters: np.ndarray = _LETTERS[False]) -> np.ndarray:
    """64 bits of each of the runs of these sizes that the bytes are cut into."""
    if not len(size):
        return np.zeros(0, U64)
    at = np.cumsum(size) - size
    power = _powers(int(size.max()))
    out = np.empty(len(size), U64)
    step, i = 1 << 18, 0
    while i < len(size):  # in pieces that stay in the processor's cache
        j = max(i + 1, int(np.searchsorted(at, at[i] + step)))
        lo, hi = at[i], at[j - 1] + size[j - 1]
        rel = np.arange(hi - lo) - np.repeat(at[i:j] - lo, size[i:j])
        out[i:j] = np.add.reduceat(letters[raw[lo:hi]] * power[rel], at[i:j] - lo)
        i = j
    return mix(out + size.astype(U64) * GOLD)


class Remembered:
    """A process's memory of what it has worked out for byte strings, by 128 bits of their hashes. A table of fixed size, with two places for each
    string; who comes first stays, since what is frequent comes early."""

    def __init__(self, bits: int = 19):
        self.bits = U64(64 - bits)
        self.a, self.b, self.row = np.zeros(1 << bits, U64), np.zeros(1 << bits, U64), np.full(1 << bits, -1, np.int32)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each string's number, -1 for those that aren't known."""
        at = (a >> self.bits).astype(np.int64)
        out = np.where((self.a[at] == a) & (self.b[at] == b), self.row[at], -1).astype(np.int64)
        lost = np.flatnonzero(out < 0)
        at, a, b = (b[lost] >> self.bits).astype(np.int64), a[lost], b[lost]
        out[lost] = np.where((self.a[at] == a) & (self.b[at] == b), self.row[at], -1)
        return out

    def put(self, a: np.ndarray, b: np.ndarray, row: np.ndarray) -> None:
        """New strings, each once."""
        for place in (0, 1):
            at = ((a, b)[place] >> self.bits).astype(np.int64)
            _, first = np.unique(at, return_index=True)
            first = first[self.row[at[first]] < 0]
            at = at[first]
            self.a[at], self.b[at], self.row[at] = a[first], b[first], row[first]
            rest = np.ones(len(a), bool)
            rest[first] = False
            a, b, row = a[rest], b[rest], row[rest]

    def clear(self) -> None:
        self.row[:] = -1


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each distinct pair, the number of each row's pair)."""
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def shingle_hashes(hashes: np.ndarray, lens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-token windows, and their number by text. A text of 1 to n-1 tokens has one window: all of it."""
    first = np.cumsum(lens) - lens
    count = np.where(lens >= n, lens - n + 1, (lens > 0).astype(np.int64))
    total = int(count.sum())
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(total)
    left = np.repeat(np.minimum(lens, n), count)
    out = left.astype(U64) * GOLD
    for k in range(n):
        here = left > k
        part = hashes[np.where(here, at + k, 0)] if len(hashes) else np.zeros(total, U64)
        out = np.where(here, mix(out * M2 + part), out) if not here.all() else mix(out * M2 + part)
    return out, count


def unique_by_text(values: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in ascending order, and their number by text."""
    doc = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return v[keep], np.bincount(d[keep], minlength=len(count))


def list_array(values: np.ndarray, lens: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


#: Bytes of a batch of texts between the JVM and Python, unless one row has more.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lets the session send Arrow batches of bounded bytes, where it still has Spark's bound of 64 MB: a batch's buffers are held twice in the JVM
    and, with all that is computed from them, in Python, by each task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64m").rstrip("b") in {"64m", str(64 << 20)}:
        spark.conf.set(key, str(BATCH_BYTES))


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def regroup(batches: Iterator[pa.RecordBatch], most_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded size, whatever the session's batch size: memory follows the longest text, not the batch."""
    held, size = [], 0
    for b in batches:
        parts = -(-b.nbytes // most_bytes) if b.num_rows else 1
        step = max(1, -(-b.num_rows // max(1, parts)))
        for i in range(0, b.num_rows, step):
            piece = b.slice(i, step)
            n = piece.nbytes
            if held and size + n > most_bytes:
                out = pa.concat_batches(held)
                held, size = [], 0
                yield out
                del out
                give_back()
            held.append(piece)
            size += n
    if held:
        yield pa.concat_batches(held)
        del held
    give_back()


# --- relational helpers ------------------------------------------------------------------------


def text_hash(text: str | Column) -> Column:
    """64 bits of a text; null is empty. Beside an id it tells a document's row without its text."""
    return F.xxhash64(F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit("")))


def lookup(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """The small side of a join: broadcast if it has at most so many rows (which are counted), else one hash table a partition, so that the
    large side is dealt out but never sorted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("shuffle_hash")


def as_rows(df: DataFrame) -> DataFrame:
    """df with all its columns in the one struct row, so that no name of theirs clashes with another."""
    return df.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]).alias("row"))


def without(documents: DataFrame, gone: DataFrame, text_col: str = "text") -> DataFrame:
    """documents without the rows that the written table gone(doc_id, th) names, nulls like values. Texts are read by the JVM alone."""
    rows = as_rows(documents)
    named = F.col("row.doc_id").eqNullSafe(gone["doc_id"]) & (text_hash(f"row.{text_col}") == gone["th"])
    return rows.join(lookup(gone), named, "left_anti").select("row.*")


def prefix_sum(df: DataFrame, order: list[str], value: str, out: str, name: str = "prefix") -> DataFrame:
    """df with out: the sum of value over all rows before this one in the order. One range shuffle; only one row a partition meets in one task."""
    spark = df.sparkSession
    placed = materialise(df.repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), name)
    local = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = parts.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # as many rows as partitions: its size is bounded by the shuffle setting
    return placed.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(local), F.lit(0))).drop("_part", "_before")


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that can be reached, for the ids on edges (a, b). Smallest neighbour and pointer jumping, each round a written table."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    both = materialise(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{name}-edges")
    label = materialise(both.groupBy(F.col("u").alias("id")).agg(F.least(F.col("id"), F.min("v")).alias("component")), f"{name}-0")
    for k in range(rounds):
        near = both.join(label.select(F.col("id").alias("v"), "component"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("near"))
        low = label.join(near, "id").select("id", F.least("component", "near").alias("low"), F.col("component").alias("old"))
        jump = label.select(F.col("id").alias("low"), F.col("component").alias("jump"))
        new = materialise(low.join(jump, "low", "left").select("id", F.least("low", F.coalesce("jump", "low")).alias("component"), "old"), f"{name}-{k + 1}")
        done = not new.where("component <> old").limit(1).count()
        release(label)
        label = new.select("id", "component")
        if done:
            release(both)
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def smallest_reachable(link: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the smallest index that links reach."""
    top = np.arange(len(link))
    reach = link | np.eye(len(link), dtype=bool)
    while True:
        new = np.where(reach, top[None, :], len(link)).min(1)
        new = new[new]
        if (new == top).all():
            return top
        top = new


def forest(link: np.ndarray, home: np.ndarray) -> np.ndarray:
    """For each row of a cell's links (symmetric, boolean) the row that it gets an edge to, itself for none. In a cell of two blocks only
    the blocks' own components get edges, since their inner ones come from the blocks' own cells."""
    top = smallest_reachable(link)
    if (home == home[0]).all():
        return top
    inner = smallest_reachable(link & (home[:, None] == home[None, :]))
    rows = np.arange(len(link))
    return np.where(inner == rows, top, rows)


def block_pairs(members: DataFrame, group: str, key: str, block: int, weight: str | None = None, most: int = 1) -> DataFrame:
    """Members dealt to the cells (group, lo, hi) of pairs of blocks, so that each pair of a group's members meets in one cell and no cell
    holds more than about two blocks, nor (unless one member does) more than about twice the weight most. Column home: this row's block. A
    group of n rows is copied n / block times, not n times."""
    # only the few groups of more than a block are looked up; written first, so that their table's size is known when the join is planned
    blocks = F.ceil(F.count("*") / block) if weight is None else F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(weight) / most))
    sizes = materialise(members.groupBy(group).agg(blocks.cast("int").alias("_n")).where("_n > 1"), "block-sizes")
    dealt = members.join(lookup(sizes), group, "left").withColumn("_n", F.coalesce("_n", F.lit(1))).withColumn("home", F.pmod(F.xxhash64(key), F.col("_n")).cast("int"))
    lo_hi = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda o: F.struct(F.least(F.col("home"), o).alias("lo"), F.greatest(F.col("home"), o).alias("hi")))
    return dealt.withColumn("_c", F.explode(lo_hi)).select("*", "_c.lo", "_c.hi").drop("_c", "_n")
