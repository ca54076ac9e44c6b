"""Benchmark decontamination: template windows joined by hash, decided by coverage and slot consistency.

Numbers, names and units become typed placeholders, so a benchmark item still matches when its values have been changed. A window counts
only if its values stand one to one with those of the whole alignment: the same value of the item is always the same value in the document.
A changed value thus costs the windows that hold it. Names are known by
their capitals, so windows are also joined with names as lower-case words: a copy in capitals or in small letters matches by these.
Windows with too few literal words for a template are joined by their exact lower-case words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wachter.llm.common import GOLD, M1, U64, Remembered, Tokens, distinct, list_array, lookup, map_arrow, materialise, mix, regroup, shingle_hashes, text_hash, without

WINDOW, SHARE, MIN_LITERALS = 8, 0.5, 4
FILTER_BITS = 1 << 24
NUM, NAME, UNIT = U64(0x1F), U64(0x2F), U64(0x3F)
#: Words that are a unit where they follow a number.
UNITS = frozenset("""m km cm mm mi mile miles ft feet foot in inch inches yd yard yards g kg mg lb lbs pound pounds oz ounce ounces t ton tons
l ml cl litre litres liter liters gal gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month
months year years cent cents dollar dollars euro euros usd eur gbp percent degree degrees c f w kw v a hz khz mhz ghz kb mb gb tb""".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*")
_NUMBER_UNIT = re.compile(r"([+-]?[$€£]?\d[\d.,:/]*)(%|°|[a-z]+)")
_EDGE = re.compile(r"^[^\w$€£+%-]+|[^\w%°]+$")
PLAIN, IS_NUM, IS_UNIT, IS_CAP, ENDS = 0, 1, 2, 4, 8
#: Kinds of windows: with names as placeholders, with names as words, with all words as they are; and what all kinds find together.
TEMPLATE, BLIND, EXACT, ANY = 0, 1, 2, 9


def _describe(piece: str) -> tuple[str, int]:
    """(lower-case word without outer punctuation, flags) of a token with the white space that follows it."""
    ends = ENDS if "\n" in piece or piece.rstrip()[-1:] in {".", "!", "?", ":"} else 0
    raw = _EDGE.sub("", piece.strip())
    word = raw.lower()
    if _NUMBER.fullmatch(word) or ((got := _NUMBER_UNIT.fullmatch(word)) and (got[2] in "%°" or got[2] in UNITS)):
        return word, ends | IS_NUM
    return word, ends | (IS_UNIT if word in UNITS else 0) | (IS_CAP if raw[:1].isupper() else 0)


class _Words:
    """What a process knows of words: flags, and the hash of the word without outer punctuation in lower case."""

    def __init__(self, most: int = 1 << 19):
        self.most, self.known = most, Remembered()
        self.flags, self.value = np.zeros(0, np.int64), np.zeros(0, U64)

    def look_up(self, t: Tokens, line_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.flags) > self.most:
            self.known.clear()
            self.flags, self.value = self.flags[:0], self.value[:0]
        a = mix(t.hashes ^ np.where(line_end, GOLD, M1))
        b = mix(a ^ GOLD)
        row = self.known.find(a, b)
        lost = np.flatnonzero(row < 0)
        if len(lost):
            one, which = distinct(a[lost], b[lost])
            one = lost[one]
            data = t.raw.tobytes()
            found = [_describe(data[i:j].decode() + ("\n" if e else " ")) for i, j, e in zip(t.starts[one].tolist(), t.ends[one].tolist(), line_end[one].tolist(), strict=True)]
            words = Tokens(pa.array([w.replace(" ", "_") or "_" for w, _ in found], pa.large_string()), lower=False)
            new = len(self.flags) + np.arange(len(one))
            self.flags = np.concatenate([self.flags, np.array([f for _, f in found], np.int64)])
            self.value = np.concatenate([self.value, words.hashes[words.first]])
            self.known.put(a[one], b[one], new)
            row[lost] = new[which]
        return self.flags[row], self.value[row]


@lru_cache(1)
def _words() -> _Words:
    return _Words()


class Templates:
    """Template code and value of every word of a batch of texts."""

    def __init__(self, column: pa.Array):
        t = Tokens(column, lower=False)
        self.lens = t.lens
        n = len(t.starts)
        if not n:
            self.codes, self.value, self.slot = {}, np.zeros(0, U64), np.zeros(0, bool)
            return
        feeds = np.concatenate([[0], np.cumsum(t.raw == 0x0A)])
        line_end = feeds[np.append(t.starts[1:], len(t.raw))] > feeds[t.ends]
        flags, self.value = _words().look_up(t, line_end)
        start = np.zeros(n, bool)
        start[t.first[t.lens > 0]] = True
        before = np.roll(flags, 1)
        opens = start | ((before & ENDS) > 0)
        number = (flags & IS_NUM) > 0
        unit = ((flags & IS_UNIT) > 0) & ~start & np.roll(number, 1)
        name = ((flags & IS_CAP) > 0) & ~opens & ~number & ~unit
        self.slot = number | unit | name
        blind = np.where(number, NUM, np.where(unit, UNIT, self.value))
        self.codes = {TEMPLATE: np.where(name, NAME, blind), BLIND: blind, EXACT: self.value}
        self.literal = {TEMPLATE: ~self.slot, BLIND: ~(number | unit), EXACT: np.ones(n, bool)}


def _windows(t: Templates, kind: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position in it, hash) of all n-word windows of texts of at least n words. Hashes of different kinds differ."""
    sh, count = shingle_hashes(t.codes[kind], t.lens, n)
    text = np.repeat(np.arange(len(count)), count)
    pos = np.arange(len(sh)) - np.repeat(np.cumsum(count) - count, count)
    ok = t.lens[text] >= n
    return text[ok], pos[ok], mix(sh[ok] ^ U64((n + (kind << 32)) * 0x9E3779B97F4A7C15 % 2**64)).view(np.int64)


def _emit(t: Templates, n: int, text: np.ndarray, pos: np.ndarray, h: np.ndarray, take: np.ndarray, shown: np.ndarray) -> list[pa.Array]:
    text, pos, h = text[take], pos[take], h[take]
    at = (np.cumsum(t.lens) - t.lens)[text] + pos
    cols = at[:, None] + np.arange(n)
    values = np.where(shown[cols], t.value[cols].view(np.int64), 0) if len(at) else np.zeros((0, n), np.int64)
    return [pa.array(pos, pa.int64()), pa.array(h), list_array(values.ravel(), np.full(len(at), n), pa.int64())]


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW, min_literals: int = MIN_LITERALS) -> DataFrame:
    """(item_id, b_pos, n, kind, h, b_slots, windows, every): the item's windows of each kind with enough literal words (exact ones: where
    the template has too few), their number, and that of windows of any kind. Items of fewer than n words have one window, all of them; null
    or empty items have none."""
    src = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("_text"))
    schema = src.drop("_text").schema.simpleString()[7:-1].replace(":", " ") + ", b_pos long, h long, b_slots array<long>, n int, kind int, windows long, every long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in regroup(batches, 1 << 20):
            t = Templates(b.column("_text"))
            for k in range(1, n + 1):
                found = {}
                for kind in t.codes:
                    text, pos, h = _windows(t, kind, k)
                    at = (np.cumsum(t.lens) - t.lens)[text] + pos
                    total = np.concatenate([[0], np.cumsum(t.literal[kind])])
                    found[kind] = h, (t.lens[text] == k if k < n else t.lens[text] >= n) & (total[at + k] - total[at] >= min(min_literals, k))
                if found:
                    found[EXACT] = found[EXACT][0], found[EXACT][1] & ~found[TEMPLATE][1]
                for kind, (h, take) in found.items():
                    # all kinds have the same windows in the same order
                    some = np.logical_or.reduce([x for _, x in found.values()])
                    windows, every = (np.bincount(text[x], minlength=len(t.lens))[text[take]] for x in (take, some))
                    ids = b.column("item_id").take(pa.array(text[take]))
                    yield pa.RecordBatch.from_arrays([ids, *_emit(t, k, text, pos, h, take, t.slot), *(pa.array(np.full(int(take.sum()), x), pa.int32()) for x in (k, kind)), pa.array(windows, pa.int64()), pa.array(every, pa.int64())], ["item_id", "b_pos", "h", "b_slots", "n", "kind", "windows", "every"])

    return map_arrow(src, run, schema)


def matches(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, share: float = SHARE, min_literals: int = MIN_LITERALS) -> DataFrame:
    """(doc_id, text_hash, item_id, matched, windows, at): the documents that hold at least this share of an item's windows with consistent
    slots, and the first word of the match. The windows are those of the template or of names as words, whichever first has the share, or
    else of all kinds together. Rows alike in id and text count once; null ids stay null."""
    bench = materialise(benchmark_windows(benchmark, n, min_literals), "benchmark-windows")
    sorts = sorted((r[0], r[1]) for r in bench.select("kind", "n").distinct().collect())  # at most n of each kind
    words = {r[0]: r[1] for r in bench.select(F.expr(f"pmod(h, {FILTER_BITS})").alias("bit")).groupBy(F.expr("cast(bit div 64 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(bit, 64) as int)))").alias("v")).collect()}  # FILTER_BITS / 64 rows at most
    table = np.zeros(FILTER_BITS // 64, np.int64)
    if words:
        table[list(words)] = list(words.values())
    sent = documents.sparkSession.sparkContext.broadcast(table)
    src = documents.select(F.col("doc_id"), text_hash("text").alias("text_hash"), F.col("text").cast("string").alias("_text"))
    schema = src.drop("_text").schema.simpleString()[7:-1].replace(":", " ") + ", d_pos long, h long, d_slots array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in regroup(batches, 2 << 20):
            t = Templates(b.column("_text"))
            shown = np.ones(len(t.value), bool)  # the item knows which of them are slots
            for kind, k in sorts if len(t.value) else []:
                text, pos, h = _windows(t, kind, k)
                bit = h % FILTER_BITS
                take = np.flatnonzero((sent.value[bit // 64] >> (bit % 64)) & 1)
                if len(take):
                    own = pa.array(text[take])
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(own), b.column("text_hash").take(own), *_emit(t, k, text, pos, h, take, shown)], ["doc_id", "text_hash", "d_pos", "h", "d_slots"])

    hits = map_arrow(src, run, schema).join(lookup(bench), "h")
    pairs = F.array_sort(F.array_distinct(F.filter(F.zip_with("b_slots", "d_slots", lambda x, y: F.struct(x.alias("b"), y.alias("d"))), lambda p: p["b"] != 0)))
    runs = hits.withColumn("window", F.struct("b_pos", pairs.alias("pairs")))
    runs = runs.withColumn("rule", F.explode(F.array("kind", F.lit(ANY)))).where(F.col("rule") != EXACT).withColumn("windows", F.when(F.col("rule") == ANY, F.col("every")).otherwise(F.col("windows")))
    # an item's words bound the windows of one alignment
    runs = runs.groupBy("doc_id", "text_hash", "item_id", "rule", "windows", (F.col("d_pos") - F.col("b_pos")).alias("shift")).agg(F.collect_set("window").alias("held"))
    own = runs.groupBy("doc_id", "text_hash", "item_id", "rule", "windows").agg(F.collect_list(F.struct("shift", "held")).alias("runs"))
    enough = F.size(F.array_distinct(F.flatten(F.transform("runs", lambda r: r["held"]["b_pos"])))) >= F.col("windows") * share
    got = own.where(enough).withColumn("_f", _consistent("runs")).select("doc_id", "text_hash", "item_id", "rule", "windows", "_f.matched", "_f.at")
    best = got.where(F.col("matched") >= F.col("windows") * share).groupBy("doc_id", "text_hash", "item_id").agg(F.min(F.struct("rule", "matched", "windows", "at")).alias("b"))
    return best.select("doc_id", "text_hash", "item_id", "b.matched", "b.windows", "b.at")


def _one_to_one(held: list[dict]) -> list[int]:
    """The windows of an alignment whose slots agree. A value of the item stands for one value of the document and the other way round; the
    pairs that most windows hold are taken first (of equals the smallest), and a window with another pair is out."""
    votes = Counter((p["b"], p["d"]) for w in held for p in w["pairs"])
    left: dict[int, int] = {}
    right: dict[int, int] = {}
    for (b, d), _ in sorted(votes.items(), key=lambda v: (-v[1], v[0])):
        if b not in left and d not in right:
            left[b], right[d] = d, b
    return [w["b_pos"] for w in held if all(left.get(p["b"]) == p["d"] for p in w["pairs"])]


def _consistent(runs: str) -> Column:
    """(matched, at) of array<struct<shift, held>>: distinct windows of the item that some alignment holds with agreeing slots, and the first
    word of the first of them in the document. Only documents with enough windows come here."""

    def count(column: pa.Array) -> pa.Array:
        matched, at = [], []
        for alignments in column.to_pylist():
            good = [(r["shift"] + b, b) for r in alignments for b in _one_to_one(r["held"])]
            matched.append(len({b for _, b in good}))
            at.append(min((p for p, _ in good), default=None))
        return pa.StructArray.from_arrays([pa.array(matched, pa.int64()), pa.array(at, pa.int64())], ["matched", "at"])

    return F.arrow_udf(count, "matched long, at long")(F.col(runs))


def digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a contaminated document and item. Null and empty texts and items match nothing; rows alike in id and text count once; an empty
    table or benchmark gives no rows."""
    return matches(documents, benchmark).select("doc_id", "item_id", "matched", "windows", "at")


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without those that hold a benchmark item. Null and empty texts stay, repeated rows go together, an empty table or benchmark
    changes nothing; columns may have any names."""
    return without(documents, materialise(matches(documents, benchmark).select("doc_id", F.col("text_hash").alias("th")).distinct(), "contaminated"))
