"""LM scoring by Katz backoff: Good-Turing discounted n-gram counts with exactly normalised backoff weights.

The model is stored in tables partitioned by context: for each context of order k its statistics and the words that follow it with their
counts, the counts of counts, and the words' numbers. Text is tokenised once into blocks. For each order k every block sends its distinct k-grams, as
numbers of words, to the partition of their context, and gets back counts and the statistics of their contexts; with these it evaluates
P_k recursively for each of its grams: discounted if seen, else the context's backoff weight times P_(k-1). score() learns while it scores:
the partitions add up what the training texts send. score_new() scores other texts from the stored tables alone.

Contexts that are too frequent for one partition are split by the whole gram; their statistics are sums, added up in a small table. Messages
between blocks and partitions are direct while there are few partitions; beyond DIRECT they travel in bundles over one stop in between, so
that their number grows with the root of the partitions for each block, and none is smaller than a few bytes a gram."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructField, StructType
from pyspark.taskcontext import TaskContext

from wachter.llm.common import GOLD, M1, U64, Tokens, map_arrow, materialise, mix, regroup, tasks

ORDER = 2
#: Counts up to this are discounted.
K = 5
#: Tokens of a block at most, unless one text has more, and tokens whose distinct grams one partition takes on average.
BLOCK_TOKENS, PART_TOKENS = 4_500_000, 1_200_000
#: Partitions up to which a block's messages go straight to them, and bytes of a bundle.
DIRECT, BUNDLE_BYTES = 2048, 16 << 20
END = U64(0x454E44)
#: Numbers of words that training has not seen, and of a text's start as a context.
UNKNOWN, BOS, FIRST = 0, 1, 2
#: Statistics of a context: n_1 .. n_K of its words' counts, sum of counts over K, of all counts, of the seen words' lower-order probabilities.
_STATS = K + 3


# --- messages --------------------------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 or of doubles, each in the narrowest type, by significance, compressed unless short."""
    head, planes = [], []
    for x in arrays:
        x = np.ascontiguousarray(x)
        if x.dtype != np.float64:
            x = x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))
        head.append(struct.pack("<BI", x.dtype.itemsize + 16 * (x.dtype == np.float64), len(x)))
        planes.append(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes())
    body = b"".join(planes)
    short = len(body) < 256
    return bytes([len(arrays), short]) + b"".join(head) + (body if short else pa.Codec("zstd", compression_level=1).compress(body, asbytes=True))


def _unpack(raw: bytes) -> list[np.ndarray]:
    n, short = raw[0], raw[1]
    head = [struct.unpack_from("<BI", raw, 2 + 5 * i) for i in range(n)]
    body = raw[2 + 5 * n :]
    if not short:
        body = pa.Codec("zstd").decompress(body, sum((t & 15) * m for t, m in head), asbytes=True)
    out, at = [], 0
    for t, m in head:
        size = t & 15
        planes = np.frombuffer(body, np.uint8, size * m, at).reshape(size, m)
        out.append(np.ascontiguousarray(planes.T).view(np.float64 if t & 16 else f"u{size}").ravel())
        at += size * m
    return out


def _gaps(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Differences of ascending runs; each run begins, at the positions new, with its first value."""
    out = x.copy()
    out[1:] -= x[:-1]
    out[new] = x[new]
    return out


def _from_gaps(d: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The inverse of _gaps."""
    total = np.cumsum(d, dtype=U64)
    before = total[new] - d[new]
    return total - np.repeat(before, np.diff(np.append(new, len(d))))


_MESSAGE = "block long, part int, k int, body binary"
_ZERO = np.zeros(1, np.int64)


def _routed(messages: DataFrame, key: str, n: int) -> DataFrame:
    """messages (block, part, k, body) on their way to the n values of key. Beyond DIRECT of these they are bundled by groups of keys, dealt out by
    group, and bundled again by key, so that no shuffle carries a row for each pair of a sender and a receiver."""
    if n <= DIRECT:
        return messages
    groups, parts = math.ceil(math.sqrt(n)), tasks(messages.sparkSession)
    schema = f"grp {'int' if key == 'part' else 'long'}, salt int, items array<struct<block:bigint,part:int,k:int,body:binary>>"
    item = pa.struct([("block", pa.int64()), ("part", pa.int32()), ("k", pa.int32()), ("body", pa.binary())])

    def bundle(by: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            size, salt = 0, TaskContext.get().partitionId() % 16
            flush = lambda: [pa.RecordBatch.from_pydict({"grp": pa.array([g], item.field(key).type), "salt": pa.array([salt], pa.int32()), "items": pa.array([x], pa.list_(item))}) for g, x in held.items()]
            for b in batches:
                for row in (r for x in b.to_pylist() for r in (x["items"] if "items" in x else [x])):
                    held.setdefault(hash(row[key]) % by if by else row[key], []).append(row)
                    size += len(row["body"])
                    if size > BUNDLE_BYTES:
                        yield from flush()
                        held, size = {}, 0
            yield from flush()

        return run

    first = map_arrow(messages, bundle(groups), schema).repartition(parts, "grp", "salt")
    second = map_arrow(first, bundle(0), schema).repartition(parts, "grp")
    # the rows stay where they are dealt to: grp is the key
    return second.select("grp", F.explode("items").alias("m")).select(*[F.col("grp").alias(c) if c == key else F.col(f"m.{c}").alias(c) for c in ("block", "part", "k", "body")])


# --- blocks ----------------------------------------------------------------------------------------


def blocks(documents: DataFrame, held_out: Column, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows of many texts: their ids, token numbers (with the end) and held-out marks, the block's distinct token hashes and its tokens."""
    src = documents.select(F.col(id_col).alias("id"), held_out.alias("held"), F.col(text_col).cast("string").alias("_text"))
    schema = StructType([StructField("block", LongType()), StructField("ids", ArrayType(src.schema["id"].dataType)), StructField("held", ArrayType(BooleanType())), StructField("lens", ArrayType(LongType())), StructField("vocab", BinaryType()), StructField("seq", BinaryType())])

    def listed(parts: list[pa.Array]) -> pa.Array:
        flat = pa.concat_arrays(parts)
        return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)

    def pack(number: int, ids: list, held: list, lens: list, hashes: list) -> pa.RecordBatch:
        h = np.concatenate(hashes)
        vocab, seq, count = np.unique(h, return_inverse=True, return_counts=True)
        by = np.argsort(-count, kind="stable")  # frequent tokens get small numbers
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        block = (TaskContext.get().partitionId() << 24) + number
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), listed(ids), listed(held), listed(lens), pa.array([vocab[by].tobytes()], pa.binary()), pa.array([_pack(rank[seq])], pa.binary())], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, held_back = 0, 0, ([], [], [], [])
        for b in regroup(batches):
            t = Tokens(b.column("_text"))
            n = t.lens + 1
            h = np.full(int(n.sum()), END, U64)
            stay = np.ones(len(h), bool)
            stay[np.cumsum(n) - 1] = False
            h[stay] = t.hashes
            if size and size + len(h) > BLOCK_TOKENS:
                yield pack(number, *held_back)
                number, size, held_back = number + 1, 0, ([], [], [], [])
            for to, x in zip(held_back, (b.column("id"), b.column("held"), pa.array(n, pa.int64()), h), strict=True):
                to.append(x)
            size += len(h)
        if held_back[0]:
            yield pack(number, *held_back)

    return map_arrow(src, run, schema)


class Block:
    """The grams of a block, order by order."""

    def __init__(self, got: pa.Table):
        row = got.select(["block", "lens", "held", "vocab", "seq"]).to_pylist()[0]
        self.number, self.held, self.ids = row["block"], np.array(row["held"], bool), got.column("ids").combine_chunks().flatten()
        self.lens = np.array(row["lens"], np.int64)
        self.hash = np.frombuffer(row["vocab"], U64)
        self.seq = _unpack(row["seq"])[0].astype(np.int32)
        self.first = np.cumsum(self.lens) - self.lens
        self.train = np.repeat(~self.held, self.lens)
        # of the current order: each token's gram; of each gram its key as a context, context (of the order before; -1: a text's start) and the
        # key of this, word (number in training) and shorter gram
        self.at = self.seq
        self.key = self.context_key = self.word = np.zeros(len(self.hash), U64)
        self.context = self.shorter = np.zeros(len(self.hash), np.int64)

    def number_words(self, numbers: np.ndarray) -> np.ndarray:
        """Order 1 in numbers of words; all unknown words become one. Returns a row of the old order for each."""
        self.key, row, new = np.unique(numbers, return_index=True, return_inverse=True)
        self.words = self.word = self.key
        self.seq = self.at = new.astype(np.int32)[self.seq]
        return row

    def next_order(self) -> None:
        code = np.zeros(len(self.at), np.int64)
        code[1:] = self.at[:-1]
        code[1:] += 1
        code[self.first] = 0  # a text's start
        code *= len(self.words)
        code += self.seq
        grams, one, at = np.unique(code, return_index=True, return_inverse=True)
        del code
        self.context, word = grams // len(self.words) - 1, grams % len(self.words)
        self.word = self.words[word]
        self.context_key = np.where(self.context < 0, U64(BOS), self.key[self.context])
        self.shorter = self.at[one]
        self.key, self.at = mix(self.context_key * M1 + self.word + GOLD), at.astype(np.int32)

    def counts(self) -> np.ndarray:
        return np.bincount(self.at[self.train], minlength=int(self.at.max()) + 1 if len(self.at) else 0)

    def dealt(self, k: int, parts: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the grams' order for sending, the partition of each in this order). hot: grams of contexts that are split."""
        if k == 1:
            part = (mix(self.hash ^ GOLD) % U64(parts)).astype(np.int64)
            order = np.lexsort((self.hash, part))
        else:
            part = (mix(np.where(hot, self.key, self.context_key) ^ GOLD) % U64(parts)).astype(np.int64)
            order = np.lexsort((self.word, self.context_key, part))
        return order, part[order]


def _request(b: Block, k: int, parts: int, hot: np.ndarray, lower: np.ndarray, learn: bool) -> Iterator[tuple[int, bytes]]:
    order, part = b.dealt(k, parts, hot)
    count = b.counts()[order] if learn else np.zeros(len(order), np.int64)
    ends = np.searchsorted(part, np.arange(parts + 1))
    if k == 1:
        sent = b.hash[order]
        for p in np.unique(part):
            i, j = ends[p], ends[p + 1]
            yield p, _pack(_gaps(sent[i:j], _ZERO), count[i:j])
        return
    ctx, word, low, is_hot = b.context_key[order], b.word[order], lower[order], hot[order]
    for p in np.unique(part):
        i, j = ends[p], ends[p + 1]
        new = np.flatnonzero(np.concatenate([[True], ctx[i + 1 : j] != ctx[i : j - 1]]))
        seen = count[i:j] > 0
        levels, level = np.unique(low[i:j][seen], return_inverse=True)
        yield p, _pack(_gaps(ctx[i:j][new], _ZERO), np.diff(np.append(new, j - i)), is_hot[i:j][new], _gaps(word[i:j], new), count[i:j], levels, level)


# --- partitions --------------------------------------------------------------------------------------

#: What a partition gives: replies to blocks; of the model its contexts with the words after them (at order 1 also these words' hashes), and sums.
_ANSWER = "kind string, block long, part int, k int, body binary, context long, hot boolean, stats array<double>, words array<long>, counts array<long>, keys array<long>"


def _rows(kind: str, part: int, k: int, n: int, **columns: pa.Array) -> pa.Table:
    types = {"block": pa.int64(), "body": pa.binary(), "context": pa.int64(), "hot": pa.bool_(), "stats": pa.list_(pa.float64()), "words": pa.list_(pa.int64()), "counts": pa.list_(pa.int64()), "keys": pa.list_(pa.int64())}
    fixed = {"kind": pa.array([kind] * n, pa.string()), "part": pa.array(np.full(n, part), pa.int32()), "k": pa.array(np.full(n, k), pa.int32())}
    every = fixed | {c: columns.get(c, pa.nulls(n, t)) for c, t in types.items()}
    return pa.table({c: every[c] for c in (x.split()[0] for x in _ANSWER.split(", "))})


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(U64).view(np.int64))


def _lists(x: np.ndarray, lens: np.ndarray | int) -> pa.Array:
    """Lists of one after another so many of x."""
    lens = np.full(len(x) // lens, lens) if isinstance(lens, int) else lens
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array(x) if x.dtype == np.float64 else _long(x))


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy() if column.num_chunks else np.zeros(0, np.int64)


def _flat_longs(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().view(U64)


def _sums(part: int, k: int, total: np.ndarray) -> pa.Table:
    """Counts of counts n_1 .. n_(K+1), distinct grams, all of them."""
    row = [*((total == r).sum() for r in range(1, K + 2)), (total > 0).sum(), total.sum()]
    return _rows("sum", part, k, 1, stats=_lists(np.array(row, float), K + 3))


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorting order, where each distinct combination begins in it, number of each row's combination). The first key leads."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in keys:
        s = x[order]
        new[1:] |= s[1:] != s[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), group


def _answer_words(part: int, parts: int, blocks_: list, bodies: list, known: pa.Table | None) -> Iterator[pa.Table]:
    got = [_unpack(x) for x in bodies]
    hashes = [_from_gaps(h.astype(U64), _ZERO) for h, _ in got]
    if known is None:
        order, starts, group = _grouped(np.concatenate(hashes))
        words = np.concatenate(hashes)[order][starts]
        total = np.bincount(group, np.concatenate([c for _, c in got]), len(words)).astype(np.int64)
        seen = np.flatnonzero(total)
        number = np.zeros(len(words), np.int64)
        number[seen[np.argsort(-total[seen], kind="stable")]] = np.arange(len(seen)) * parts + part + FIRST  # frequent words get small numbers
        yield _sums(part, 1, total)
        # the one context of order 1 is split over all partitions
        stats = np.array([*((total == r).sum() for r in range(1, K + 1)), total[total > K].sum(), total.sum(), 0], float)
        yield _rows("context", part, 1, 1, context=pa.array([0], pa.int64()), hot=pa.array([True]), stats=_lists(stats, _STATS), **{c: _lists(x[seen], np.array([len(seen)])) for c, x in (("words", number), ("counts", total), ("keys", words))})
        which = np.split(group, np.cumsum([len(x) for x in hashes])[:-1])
    else:
        words = _flat(known.column("keys")).view(U64)
        by = np.argsort(words)
        words, number, total = words[by], np.append(_flat(known.column("words"))[by], UNKNOWN), np.append(_flat(known.column("counts"))[by], 0)
        # the last place is that of words that the model hasn't
        which = [np.minimum(np.searchsorted(words, h), max(0, len(words) - 1)) for h in hashes]
        which = [np.where(words[w] == h, w, len(words)) if len(words) else np.zeros(len(h), np.int64) for w, h in zip(which, hashes, strict=True)]
    body = [_pack(total[w], number[w]) for w in which]
    yield _rows("reply", part, 1, len(body), block=pa.array(blocks_, pa.int64()), body=pa.array(body, pa.binary()))


def _answer_grams(k: int, part: int, parts: int, blocks_: list, bodies: list, known: pa.Table | None) -> Iterator[pa.Table]:
    ctxs, runs, hots, words, counts, lows, seens = [], [], [], [], [], [], []
    for raw in bodies:
        c, r, h, w, n, levels, level = _unpack(raw)
        ctxs.append(_from_gaps(c.astype(U64), _ZERO))
        runs.append(r.astype(np.int64))
        hots.append(h)
        words.append(_from_gaps(w.astype(U64), np.cumsum(runs[-1]) - runs[-1]))
        counts.append(n)
        lows.append(levels[level])
    sizes, csizes = [len(x) for x in words], [len(x) for x in ctxs]
    all_ctx, which = np.unique(np.concatenate(ctxs), return_inverse=True)
    if known is None:
        ctx, word, count = np.repeat(which, np.concatenate(runs)), np.concatenate(words), np.concatenate(counts)
        _, starts, group = _grouped(ctx, word)
        total = np.bincount(group, count, len(starts)).astype(np.int64)
        low = np.zeros(len(starts))
        low[group[count > 0]] = np.concatenate(lows)
        owner, named = np.empty(len(starts), np.int64), np.empty(len(starts), U64)
        owner[group], named[group] = ctx, word
        stats = np.zeros((len(all_ctx), _STATS))
        for r in range(1, K + 1):
            stats[:, r - 1] = np.bincount(owner[total == r], minlength=len(all_ctx))
        for at, w in ((K, np.where(total > K, total, 0)), (K + 1, total), (K + 2, low)):
            stats[:, at] = np.bincount(owner, w, len(all_ctx))
        hot = np.zeros(len(all_ctx), bool)
        hot[which[np.concatenate(hots) > 0]] = True
        yield _sums(part, k, total)
        seen, some = total > 0, np.flatnonzero(stats[:, K + 1])
        follow = np.bincount(owner[seen], minlength=len(all_ctx))[some]
        yield _rows("context", part, k, len(some), context=_long(all_ctx[some]), hot=pa.array(hot[some]), stats=_lists(stats[some].ravel(), _STATS), words=_lists(named[seen], follow), counts=_lists(total[seen], follow))
        back = np.split(total[group], np.cumsum(sizes)[:-1])
    else:
        cc, cs = _flat_longs(known.column("context")), _flat(known.column("stats")).reshape(-1, _STATS)
        gc, gw, gn = np.repeat(cc, pc.list_value_length(known.column("words")).to_numpy()), _flat(known.column("words")).view(U64), _flat(known.column("counts"))
        stats = np.zeros((len(all_ctx), _STATS))
        at = np.searchsorted(all_ctx, cc)
        asked = (at < len(all_ctx)) & (all_ctx[np.minimum(at, len(all_ctx) - 1)] == cc)
        stats[at[asked]] = cs[asked]  # those of split contexts are not read: their sums are known
        ctx = all_ctx[np.repeat(which, np.concatenate(runs))]
        _, starts, group = _grouped(np.concatenate([gc, ctx]), np.concatenate([gw, np.concatenate(words)]))
        total = np.zeros(len(starts), np.int64)
        total[group[: len(gc)]] = gn
        back = np.split(total[group[len(gc) :]], np.cumsum(sizes)[:-1])
    ends = np.cumsum([0, *csizes])
    body = []
    for n, i, j in zip(back, ends[:-1], ends[1:], strict=True):
        mine = stats[which[i:j]]
        full = mine[:, K + 1] > 0  # contexts that training has
        body.append(_pack(n, full, mine[full, : K + 2].astype(np.int64).ravel(order="F"), mine[full, K + 2]))
    yield _rows("reply", part, k, len(body), block=pa.array(blocks_, pa.int64()), body=pa.array(body, pa.binary()))


def _answers(k: int, parts: int):
    def lookup(got: pa.Table, known: pa.Table | None) -> pa.Table:
        if not got.num_rows:  # contexts that nobody asks for
            return _rows("none", 0, k, 0)
        got = got.sort_by("block")
        own = (got.column("part")[0].as_py(), parts, got.column("block").to_pylist(), got.column("body").to_pylist(), known)
        return pa.concat_tables(_answer_words(*own) if k == 1 else _answer_grams(k, *own))

    def learn(got: pa.Table) -> pa.Table:
        return lookup(got, None)

    return learn, lookup


# --- probabilities -----------------------------------------------------------------------------------


def discounts(coc: list[float]) -> np.ndarray:
    """d_0 .. d_K for counts of counts n_1 .. n_(K+1): Katz's Good-Turing ratios; where these are not within 0 to 1, absolute discounts."""
    n = np.array(coc, float)
    d = np.ones(K + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        a = (K + 1) * n[K] / n[0]
        r = np.arange(1, K + 1)
        d[1:] = ((r + 1) * n[1:] / n[:-1] / r - a) / (1 - a)
        if not (np.isfinite(d).all() and (d[1:] > 0).all() and (d[1:] < 1).all()):
            gap = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
            d[1:] = (r - gap) / r
    return d


def katz(count: np.ndarray, stats: np.ndarray, lower: np.ndarray, d: np.ndarray) -> np.ndarray:
    """P_k of grams: stats are their contexts'. Over all words, one of them the unknown, each context's probabilities sum to 1."""
    r = np.arange(1, K + 1)
    total = stats[:, K + 1]
    mass = stats[:, :K] @ (d[1:] * r) + stats[:, K]
    whole = (total > 0) & (mass >= total * (1 - 1e-12))  # nothing was discounted: one more word makes room
    base = np.where(whole, total + 1, np.maximum(total, 1))
    use = np.where(whole, total, mass)
    seen = np.where(whole, 1.0, d[np.minimum(count, K)] * (count <= K) + (count > K)) * count / base
    rest = np.maximum(1 - stats[:, K + 2], 1e-300)
    alpha = np.where(total > 0, (1 - use / base) / rest, 1.0)
    return np.where(count > 0, seen, alpha * lower)


class Model:
    """The stored tables, and what all blocks need of them: by order the discounts, sums and split contexts' statistics. A context is split only if
    it has more than limit tokens, so these are at most 4 times as many as partitions, and the texts' starts."""

    def __init__(self, spark: SparkSession, parts: int, tokens: int):
        self.parts, self.limit, self.tables = parts, max(1, tokens // (4 * parts)), []
        self.d: list[np.ndarray] = []
        self.sums: list[list[float]] = []
        self.hot: list[tuple[np.ndarray, np.ndarray]] = []

    def learn(self, table: DataFrame) -> None:
        """The next order, from its table."""
        sums = table.where("kind = 'sum'").select(*(F.coalesce(F.sum(F.col("stats")[i]), F.lit(0.0)) for i in range(K + 3))).first()
        rows = table.where("kind = 'context' and hot").groupBy("context").agg(*(F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(_STATS))).collect()
        keys = np.array([r[0] for r in rows], np.int64).view(U64)
        by = np.argsort(keys)
        self.tables.append(table)
        self.sums.append(list(sums))
        self.d.append(discounts(list(sums)[: K + 1]))
        self.hot.append((keys[by], np.array([list(r)[1:] for r in rows], float).reshape(len(rows), _STATS)[by]))

    def light(self) -> Model:
        """Without the tables, as it is sent to tasks."""
        out = object.__new__(Model)
        out.parts, out.limit, out.d, out.sums, out.hot, out.tables = self.parts, self.limit, self.d, self.sums, self.hot, []
        return out

    def probabilities(self, b: Block, k: int, hot: np.ndarray, lower: np.ndarray, replies: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(P_k, count) of the block's grams of order k; at order 1 of its words, which get their numbers."""
        order, part = b.dealt(k, self.parts, hot)
        out, got, number = np.empty(len(order)), np.empty(len(order), np.int64), np.zeros(len(order), U64)
        ends = np.searchsorted(part, np.arange(self.parts + 1))
        keys, known = self.hot[k - 1]
        for p in np.unique(part):  # part by part: statistics are wide, and grams are many
            at = order[ends[p] : ends[p + 1]]
            reply = _unpack(replies[int(p)])
            if k == 1:
                got[at], number[at] = reply
                continue
            ctx = b.context_key[at]
            own = np.cumsum(np.concatenate([[True], ctx[1:] != ctx[:-1]])) - 1
            full = reply[1].astype(bool)
            stats = np.zeros((len(full), _STATS))
            stats[full, : K + 2], stats[full, K + 2] = reply[2].reshape(K + 2, -1).T, reply[3]
            count, stats, is_hot = reply[0].astype(np.int64), stats[own], hot[at]
            if is_hot.any():
                stats[is_hot] = _found(keys, known, ctx[is_hot])
            out[at], got[at] = katz(count, stats, lower[at], self.d[k - 1]), count
        if k == 1:
            one = b.number_words(number)
            got = got[one]
            out = katz(got, np.repeat(known if len(known) else np.zeros((1, _STATS)), len(got), 0), np.ones(len(got)), self.d[0])
        return out, got

    def walk(self, b: Block, replies: dict[tuple[int, int], bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, P_k of each gram, its training count), order by order."""
        hot = p = np.ones(len(b.hash))
        for k in range(1, len(self.d) + 1):
            if k > 1:
                lower, hot = self.step(b, p, count)
            else:
                lower = p  # the unknown word takes all that the seen ones leave
            p, count = self.probabilities(b, k, hot, lower, {q: x for (kk, q), x in replies.items() if kk == k})
            yield k, p, count

    def step(self, b: Block, p: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next order's grams: (probability of the shorter gram, is the context split?). Texts' starts always are."""
        b.next_order()
        return p[b.shorter], (b.context < 0) | (count[b.context] > self.limit)


def _found(keys: np.ndarray, known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
    out = np.zeros((len(asked), _STATS))
    if len(keys):
        here = keys[at] == asked
        out[here] = known[at[here]]
    return out


def _ask(model: Model, learn: bool):
    k = len(model.d) + 1

    def send(b: Block, hot: np.ndarray, lower: np.ndarray) -> Iterator[pa.RecordBatch]:
        for p, body in _request(b, k, model.parts, hot, lower, learn):
            yield pa.RecordBatch.from_pydict({"block": pa.array([b.number], pa.int64()), "part": pa.array([p], pa.int32()), "k": pa.array([k], pa.int32()), "body": pa.array([body], pa.binary())})

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block(pa.Table.from_batches([batch.slice(i, 1)]))
                yield from send(b, np.ones(len(b.hash), bool), np.zeros(len(b.hash)))

    def later(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([], pa.schema([("block", pa.int64()), ("part", pa.int32()), ("k", pa.int32()), ("body", pa.binary())]))
        b = Block(left)
        for _, p, count in model.walk(b, _by_part(right)):
            pass
        lower, hot = model.step(b, p, count)
        return pa.Table.from_batches(list(send(b, hot, lower)))

    return first if k == 1 else later


def _by_part(replies: pa.Table) -> dict[tuple[int, int], bytes]:
    return {(r["k"], r["part"]): r["body"] for r in replies.select(["k", "part", "body"]).to_pylist()}


def _replies(tables: list[DataFrame], n: int) -> DataFrame:
    out = None
    for t in tables:
        own = _routed(t.where("kind = 'reply'").select("block", "part", "k", "body"), "block", n)
        out = own if out is None else out.union(own)
    return out.groupBy("block")


def _run(documents: DataFrame, held_out: Column, order: int, stored: Model | None, text_col: str, id_col: str) -> tuple[DataFrame, Model]:
    spark = documents.sparkSession
    own = materialise(blocks(documents, held_out, text_col, id_col), "katz-blocks")
    tokens, n = own.select(F.coalesce(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)), F.count("*")).first()
    model = Model(spark, stored.parts if stored else max(tasks(spark), -(-tokens // PART_TOKENS)), tokens)
    if stored:
        model.limit = stored.limit
    tables: list[DataFrame] = []
    for k in range(1, order + 1):
        light, parts = model.light(), model.parts
        asked = map_arrow(own, _ask(light, stored is None), _MESSAGE) if k == 1 else own.groupBy("block").cogroup(_replies(tables, n)).applyInArrow(_ask(light, stored is None), _MESSAGE)
        asked = _routed(asked, "part", parts).groupBy("part")
        if stored is None:
            answers = asked.applyInArrow(_answers(k, parts)[0], _ANSWER)
        else:
            model_rows = stored.tables[k - 1].where("kind = 'context'").select("part", "context", "stats", "words", "counts", "keys")
            answers = asked.cogroup(model_rows.groupBy("part")).applyInArrow(_answers(k, parts)[1], _ANSWER)
        table = materialise(answers, f"katz-{k}", "kind")
        tables.append(table)
        if stored is None:
            model.learn(table)
        else:
            model.d, model.sums, model.hot = stored.d[:k], stored.sums[:k], stored.hot[:k]
    light = model.light()
    types, total = model.sums[0][K + 1], model.sums[0][K + 2]

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        b, add = Block(left), lambda x: np.add.reduceat(x, b.first)
        for k, p, count in light.walk(b, _by_part(right)):
            if k == 1:
                base, known = add(np.log10((count + 0.5) / (total + 0.5 * (types + 1)))[b.seq]), add((count > 0).astype(np.int64)[b.seq])
        columns = {"id": b.ids, "held_out": pa.array(b.held), "n_tokens": pa.array(b.lens), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(b.lens), int(total)))}
        return pa.table(columns | {"base_score": pa.array(base), "score": pa.array(add(np.log10(p)[b.at]))})

    schema = StructType([StructField("id", own.schema["ids"].dataType.elementType), *spark.createDataFrame([], "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").schema.fields])
    return own.groupBy("block").cogroup(_replies(tables, n)).applyInArrow(last, schema), model


def score(documents: DataFrame, held_out: Column, order: int = ORDER, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, Model]:
    """(scores, the stored model). Scores are one row a text: id (of the type it has), held_out, n_tokens, n_known, train_tokens, base_score,
    score. The model learns from the texts that are not held out; without any, all probability is the unknown word's."""
    return _run(documents, held_out, order, None, text_col, id_col)


def score_new(documents: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The same rows for other texts, by the stored tables of a model alone: nothing is learned, held_out is true for all."""
    return _run(documents, F.lit(True), len(model.d), model, text_col, id_col)[0]


def digest(documents: DataFrame) -> DataFrame:
    """The contract's columns. A null text is empty (its end alone is scored); ids may be of any type, a null doc_id is not held out; repeated
    rows each score and, if not held out, each count; an empty table gives no rows; other columns may have any names."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))
    return score(documents, held)[0].withColumnRenamed("id", "doc_id")
