"""Token-ID / binary output: ORC files of token ids (run-length encoded integers, row indexes, Bloom filters on the document id)."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wachter.llm.common import OTHER_LETTERS, Remembered, hash_runs, map_arrow, materialise, prefix_sum, regroup, tasks, text_hash, utf8
from wachter.work import work_path

END_ID = 2
#: Tokenizers that one process keeps, and pieces that it remembers for each (about 40 MB).
_TOKENIZERS, MOST_PIECES = 2, 400_000


@lru_cache(_TOKENIZERS)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(2)
def byte_lengths(path: str) -> np.ndarray:
    """Bytes of each id of a byte-level BPE, whose vocabulary writes each byte as one character. Ids of one text have spans that tile it."""
    with open(path, encoding="utf8") as f:
        model = json.load(f)
    vocab = model["model"]["vocab"] | {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        out[i] = len(token)
    return out


def _solid(raw: np.ndarray) -> np.ndarray:
    """Bytes that surely end no white space."""
    out = (raw > 0x20) & (raw < 0x7F)
    out[1:] |= (raw[1:] >= 0x80) & (raw[1:] < 0xC0) & (raw[:-1] >= 0xC3) & (raw[:-1] <= 0xDF)
    return out


def cuts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte positions at which texts can be cut without changing a byte-level BPE's ids: before a space or line feed that follows a byte
    which surely ends no white space (printable ASCII, or a two-byte letter from U+00C0 on), and at each text's start. There the
    pre-tokenizer's pattern always begins a new piece, and no part of it looks back."""
    ok = np.zeros(len(raw), bool)
    ok[1:] = ((raw[1:] == 0x20) | (raw[1:] == 0x0A)) & _solid(raw)[:-1]
    begins = at[:-1][at[:-1] < at[1:]]
    ok[begins] = True
    return np.append(np.flatnonzero(ok), len(raw))


class Pieces:
    """Ids of pieces. A process remembers the first of them that it meets, up to a bound, since most texts share them."""

    def __init__(self, path: str, most: int = MOST_PIECES):
        self.path, self.most, self.known = path, most, Remembered(20)
        self.flat, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, their number by word). Words that begin and end like pieces between two cuts are encoded in long rows, since the
        tokenizer cuts there too; the ids' bytes tell the words apart."""
        raw, at = utf8(words)
        size = np.diff(at)
        plain = np.flatnonzero(((raw[at[:-1]] == 0x20) | (raw[at[:-1]] == 0x0A)) & _solid(raw)[at[1:] - 1]) if len(raw) else np.zeros(0, np.int64)
        odd = np.ones(len(words), bool)
        t, sizes, rows, ids = tokenizer(self.path), np.zeros(len(words), np.int64), [], []
        for i in range(0, len(plain), 4000):
            own = plain[i : i + 4000]
            text = b"".join(words.take(pa.array(own)).to_pylist()).decode()
            got = np.array(t.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            ends, want = np.cumsum(byte_lengths(self.path)[got]), np.cumsum(size[own])
            last = np.searchsorted(ends, want)
            if len(ends) and ends[-1] == want[-1] and (ends[np.minimum(last, len(ends) - 1)] == want).all():
                sizes[own], odd[own] = np.diff(last + 1, prepend=0), False
                rows.append(own)
                ids.append(got)
        odd = np.flatnonzero(odd)
        for i in range(0, len(odd), 20_000):
            own = odd[i : i + 20_000]
            got = [e.ids for e in t.encode_batch_fast(words.take(pa.array(own)).cast(pa.large_string()).to_pylist(), add_special_tokens=False)]
            sizes[own] = [len(x) for x in got]
            rows.append(own)
            ids.append(np.fromiter((y for x in got for y in x), np.int32, int(sizes[own].sum())))
        if not rows:
            return np.zeros(0, np.int32), sizes
        # from the order of encoding to that of the words
        order, flat = np.concatenate(rows), np.concatenate(ids)
        n = sizes[order]
        begin = np.empty(len(words), np.int64)
        begin[order] = np.cumsum(n) - n
        return flat[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))], sizes

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's begin, their number) of distinct words, none of them empty."""
        raw, at = utf8(words)
        a, b = hash_runs(raw, np.diff(at)), hash_runs(raw, np.diff(at), OTHER_LETTERS)
        where = self.known.find(a, b)
        lost = np.flatnonzero(where < 0)
        flat, size = self._new(words.take(pa.array(lost)))
        k = len(self.begin)
        where[lost] = k + np.arange(len(lost))
        begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        flat, size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        room = max(0, min(len(lost), self.most - k))
        if room:
            self.known.put(a[lost[:room]], b[lost[:room]], k + np.arange(room))
            end = int(begin[k + room - 1] + size[k + room - 1])
            self.flat, self.begin, self.size = flat[:end].copy(), begin[: k + room].copy(), size[: k + room].copy()
        return flat, begin[where], size[where]


@lru_cache(_TOKENIZERS)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_column(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and their number by text: equal to the tokenizer's own for each whole text, but each distinct
    piece between two cuts is encoded once a batch."""
    raw, at = utf8(column)
    if not len(raw):
        return np.zeros(0, np.int32), np.zeros(len(column), np.int64)
    cut = cuts(raw, at)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
    coded = pieces.dictionary_encode()
    which = coded.indices.to_numpy()
    flat, begin, sizes = _pieces(path).encode(coded.dictionary)
    n = sizes[which]
    out = flat[np.repeat(begin[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    ends = np.concatenate([[0], np.cumsum(n)])
    by_text = np.diff(ends[np.searchsorted(cut, at)])
    return out, by_text


def encode(documents: DataFrame, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents with ids (array of int, the end id last) and n_tokens; the text goes. Null or empty text: the end id alone."""
    path = path or default_tokenizer()
    kept = [c for c in documents.columns if c not in {text_col, "ids", "n_tokens"}]
    src = documents.select(*kept, F.col(text_col).cast("string").alias("_text"))
    schema = src.drop("_text").withColumn("ids", F.array(F.lit(0))).withColumn("n_tokens", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in regroup(batches):
            flat, n = encode_column(b.column("_text"), path)
            full = np.full(len(flat) + len(n), end_id, np.int32)
            stay = np.ones(len(full), bool)
            stay[np.cumsum(n + 1) - 1] = False
            full[stay] = flat
            step, ends = max(1, len(n) // max(1, len(full) // 2_000_000)), np.concatenate([[0], np.cumsum(n + 1)])
            for i in range(0, len(n), step):
                j = min(len(n), i + step)
                ids = pa.ListArray.from_arrays(pa.array((ends[i : j + 1] - ends[i]).astype(np.int32)), pa.array(full[ends[i] : ends[j]]))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in kept), ids, pa.array((n[i:j] + 1).astype(np.int64))], [*kept, "ids", "n_tokens"])

    return map_arrow(src, run, schema)


def write_orc(documents: DataFrame, out: str, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> None:
    """Encode and write in ascending id order (nulls first, ties by text_hash), range by range: each file holds a range of ids, so that stripe and
    row-group statistics and Bloom filters prune look-ups, and stripes are read in parallel. Beside the documents' other columns the files have
    text_hash, ids and n_tokens (columns of these names are replaced). files: their number (that of the shuffle's partitions)."""
    spark = documents.sparkSession
    hashed = documents.withColumn("text_hash", text_hash(text_col))
    by = [F.col(id_col).asc_nulls_first(), "text_hash"]
    # rows of one id are split by their texts, and equal rows by where they come from
    ordered = hashed.repartitionByRange(files or tasks(spark), *by, F.monotonically_increasing_id()).sortWithinPartitions(*by)
    (
        encode(ordered, path, end_id, id_col, text_col).write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", id_col).option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").option("orc.row.index.stride", "1000").option("orc.encoding.strategy", "COMPRESSION")
        .orc(out)
    )


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def crc32_of_ids(df: DataFrame, ids: str = "ids", out: str = "ids_crc32") -> DataFrame:
    """df without ids, with the unsigned crc32 of them as little-endian unsigned 32-bit integers."""
    kept = [c for c in df.columns if c not in {ids, out}]
    schema = df.select(*kept, F.lit(0).cast("long").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(ids)
            at, flat = col.offsets.to_numpy(), col.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(crc, pa.int64())], [*kept, out])

    return map_arrow(df, run, schema)


def digest(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the files that write_orc wrote. A null doc_id comes first; repeated ids: in the
    order of text_hash, in the files as here; an empty table: no rows."""
    spark = documents.sparkSession
    out = work_path(spark, "token-ids")
    write_orc(documents.select("doc_id", "text"), out, path)
    back = materialise(crc32_of_ids(read_orc(spark, out).select("doc_id", "text_hash", "ids", "n_tokens")), "token-digests")
    return prefix_sum(back, ["doc_id", "text_hash"], "n_tokens", "start").select("doc_id", F.col("start").cast("long"), "n_tokens", "ids_crc32")
