"""Line dedup with a suffix array over line-id sequences, built by distributed prefix doubling.

A suffix is a document from one of its lines on. Its rank at level k is its place in the order of all suffixes by their first 2**k lines;
level k + 1 ranks the pairs (rank at the line, rank 2**k lines on). Ranks are dealt by a range sort of the distinct pairs, so equal
suffixes share a rank; suffixes that are already alone need no further rank. Two overlapping ranks name the interval of all suffixes with a
common prefix of a given length: an interval of two or more suffixes is a repeated run. The first copy of a run stays, later ones go.

A run counts if it has at least MIN_WORDS words; with 1, all do but runs of lines without a word. The longest-common-prefix intervals that
are looked up are the shallowest ones that count: from each line on, and up to each line, the fewest lines with so many words. Every line of
a maximal repeated run lies in one of them that is part of the run, so the later copies of these, merged document by document, are the
later copies of the maximal runs; deeper intervals would add nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wachter.llm.common import Tokens, as_rows, lookup, map_arrow, materialise, mix, regroup, release, tasks, small_batches, text_hash, utf8

MIN_WORDS = 1
_KEY = ["doc_id", "th"]


def lines(documents: DataFrame, min_words: int = MIN_WORDS, text_col: str = "text") -> DataFrame:
    """(doc_id, th, pos, h, t, u): each line's hash, and how many lines from it on (t), or up to it (u), have min_words words (0: too few).
    th is the text's hash; rows alike in id and text are one document."""
    src = documents.select(F.col("doc_id"), text_hash(text_col).alias("th"), F.col(text_col).cast("string").alias("_text"))
    schema = src.drop("_text").schema.simpleString()[7:-1].replace(":", " ") + ", pos int, h long, t int, u int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in regroup(batches):
            raw, at = utf8(b.column("_text"))
            if not len(raw):
                continue
            # a line begins at a text's start and after each line feed; it has the bytes up to the next line feed or the text's end
            feed = np.flatnonzero(raw == 0x0A) + 1
            full = np.flatnonzero(at[1:] > at[:-1])
            begin = np.sort(np.concatenate([at[full], feed]), kind="stable")
            doc = np.repeat(np.arange(b.num_rows), np.bincount(full, minlength=b.num_rows) + np.diff(np.searchsorted(feed, at, "right")))
            stop = np.append(begin[1:], len(raw))
            last = np.append(doc[1:] != doc[:-1], True)
            stop = np.where(last, at[doc + 1], stop - 1)
            data, offs = pa.py_buffer(np.ascontiguousarray(raw)), np.stack([begin, stop], 1).ravel()
            # every second piece of the bytes is a line, the others are line feeds or nothing
            cut = np.append(offs, len(raw)).astype(np.int64)
            pieces = pa.LargeStringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut), data)
            coded = pieces.take(pa.array(np.arange(0, len(cut) - 1, 2))).dictionary_encode()
            which = coded.indices.to_numpy()
            t = Tokens(coded.dictionary, lower=False)
            words = t.lens[which]
            h = _line_hash(coded.dictionary)[which]
            first = np.zeros(b.num_rows + 1, np.int64)
            first[1:] = np.cumsum(np.bincount(doc, minlength=b.num_rows))
            pos = np.arange(len(doc)) - first[doc]
            total = np.concatenate([[0], np.cumsum(words)])
            fore = np.searchsorted(total, total[:-1] + min_words)
            fore = np.where(fore <= first[doc + 1], fore - np.arange(len(doc)), 0)
            back = np.searchsorted(total, total[1:] - min_words, "right") - 1
            back = np.where((total[1:] >= min_words) & (back >= first[doc]), np.arange(1, len(doc) + 1) - back, 0)
            own = pa.array(doc)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(own), b.column("th").take(own), pa.array(pos, pa.int32()), pa.array(h.view(np.int64)), pa.array(fore, pa.int32()), pa.array(back, pa.int32())], ["doc_id", "th", "pos", "h", "t", "u"])

    return map_arrow(src, run, schema)


def _line_hash(column: pa.Array) -> np.ndarray:
    """64 bits of all bytes of each line."""
    none = np.zeros(256, bool)
    t = Tokens(column, white=none, lower=False)
    out = np.zeros(len(column), np.uint64)
    out[t.lens > 0] = t.hashes
    return mix(out + np.uint64(1))


def suffix_ranks(all_lines: DataFrame, longest: int) -> list[DataFrame]:
    """Level by level (doc_id, th, pos, rank) of the suffixes whose first 2**k lines occur again, up to the level that windows of the longest
    length need."""
    spark = all_lines.sparkSession
    # written first: a very frequent line's join can then be split, apart from the count of it
    again = materialise(all_lines.groupBy(F.col("h").alias("rank")).agg(F.count("*").alias("c")).where("c > 1").select("rank"), "lines-again")
    level = materialise(all_lines.select(*_KEY, "pos", F.col("h").alias("rank")).join(lookup(again), "rank").select(*_KEY, "pos", "rank"), "suffix-0")
    levels, step = [level], 1
    while 2 * step <= longest and level.limit(1).count():
        on = level.select(F.col("doc_id").alias("d2"), F.col("th").alias("th2"), (F.col("pos") - F.lit(step)).alias("p2"), F.col("rank").alias("next"))
        pairs = level.join(on, level["doc_id"].eqNullSafe(on["d2"]) & (level["th"] == on["th2"]) & (level["pos"] == on["p2"])).select(*_KEY, "pos", "rank", "next")
        pairs = materialise(pairs, f"suffix-pairs-{len(levels)}")
        many = pairs.groupBy("rank", "next").agg(F.count("*").alias("c")).where("c > 1")
        # the id grows with the partition and in it with the row: it keeps the range sort's order
        ranks = many.repartitionByRange(tasks(spark), "rank", "next").sortWithinPartitions("rank", "next").select("rank", "next", F.monotonically_increasing_id().alias("new"))
        ranks = materialise(ranks, f"suffix-ranks-{len(levels)}")
        level = materialise(pairs.join(ranks, ["rank", "next"]).select(*_KEY, "pos", F.col("new").alias("rank")), f"suffix-{len(levels)}")
        release(pairs, ranks)
        levels.append(level)
        step *= 2
    return levels


def repeated_runs(documents: DataFrame, min_words: int = MIN_WORDS, text_col: str = "text") -> DataFrame:
    """(doc_id, th, runs): by document the lines to delete, as disjoint ascending runs of (from, to), to excluded: those in a later copy of a
    run of at least min_words words. The first copy is that of the smallest (doc_id, text hash, line), null ids first; lines that a later
    copy shares with the first stay."""
    own = materialise(lines(documents, min_words, text_col).dropDuplicates([*_KEY, "pos"]), "lines")
    windows = own.select(*_KEY, "pos", F.col("t").alias("len")).where("len > 0").union(own.where("u > 0").select(*_KEY, (F.col("pos") - F.col("u") + 1).alias("pos"), F.col("u").alias("len"))).distinct()
    longest = own.agg(F.greatest(F.max("t"), F.max("u"))).first()[0] or 0
    levels = suffix_ranks(own, longest)
    table = levels[0].withColumn("k", F.lit(0))
    for k, x in enumerate(levels[1:], 1):
        table = table.union(x.withColumn("k", F.lit(k)))
    windows = windows.withColumn("k", F.floor(F.log2(F.col("len").cast("double") + 0.5)).cast("int"))
    a = table.select(F.col("doc_id").alias("d1"), F.col("th").alias("t1"), F.col("pos").alias("p1"), F.col("k").alias("k1"), F.col("rank").alias("ra"))
    b = table.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), F.col("pos").alias("p2"), F.col("k").alias("k2"), F.col("rank").alias("rb"))
    same = lambda d, t, p, k, at: F.col("doc_id").eqNullSafe(F.col(d)) & (F.col("th") == F.col(t)) & (at == F.col(p)) & (F.col("k") == F.col(k))
    end = F.col("pos") + F.col("len") - F.expr("cast(shiftleft(1, k) as int)")
    named = windows.join(a, same("d1", "t1", "p1", "k1", F.col("pos"))).join(b, same("d2", "t2", "p2", "k2", end)).select(*_KEY, "pos", "len", "ra", "rb")
    named = materialise(named, "line-windows")
    release(*levels)
    first = materialise(named.groupBy("len", "ra", "rb").agg(F.min(F.struct(*_KEY, "pos")).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"), "line-intervals")
    later = named.join(lookup(first), ["len", "ra", "rb"])
    at_home = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    later = later.withColumn("_from", F.when(at_home, F.greatest(F.col("pos"), F.col("first.pos") + F.col("len"))).otherwise(F.col("pos"))).withColumn("_to", F.col("pos") + F.col("len"))
    gone = later.where((~at_home | (F.col("pos") != F.col("first.pos"))) & (F.col("_from") < F.col("_to")))
    # a document's own lines bound its list
    return gone.groupBy(*_KEY).agg(F.collect_list(F.struct(F.col("_from").alias("from"), F.col("_to").alias("to"))).alias("runs")).withColumn("runs", _merged("runs"))


def _merge(column: pa.Array) -> pa.Array:
    """Runs of each list, sorted, those that touch joined."""
    own = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    runs = column.flatten()
    lo, hi = (runs.field(x).to_numpy().astype(np.int64) + (own << 32) for x in ("from", "to"))
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    begin = np.flatnonzero(np.concatenate([[True], lo[1:] > reach[:-1]])) if len(lo) else np.zeros(0, np.int64)
    reach = reach[np.append(begin[1:], len(lo)) - 1] if len(lo) else reach
    own, lo = lo[begin] >> 32, lo[begin] & 0xFFFFFFFF
    ends = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(column)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(lo, pa.int32()), pa.array(reach & 0xFFFFFFFF, pa.int32())], ["from", "to"]))


def _merged(runs: str) -> Column:
    def merge(column: pa.Array) -> pa.Array:
        return _merge(column)

    return F.arrow_udf(merge, "array<struct<from:int,to:int>>")(F.col(runs))


def _cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
    """The texts without their runs of lines, in one pass over each."""
    out = []
    for text, gone in zip(texts, runs, strict=True):
        if not text.is_valid or not gone.is_valid:
            out.append(None)
            continue
        all_lines, kept, at = text.as_py().split("\n"), [], 0
        for r in gone.as_py():
            kept += all_lines[at : r["from"]]
            at = r["to"]
        out.append("\n".join(kept + all_lines[at:]))
    return pa.array(out, pa.string())


def edited(documents: DataFrame, min_words: int = MIN_WORDS, text_col: str = "text") -> DataFrame:
    """(row, text, n_lines, n_deleted): each document's columns in a struct, what is left of its text, the number of its lines and of those
    deleted. Null and empty texts stay as they are; a text of which nothing is left becomes empty."""

    def cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
        return _cut(texts, runs)

    small_batches(documents.sparkSession)
    gone = materialise(repeated_runs(documents, min_words, text_col).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "runs"), "lines-gone")
    text = F.col(f"row.{text_col}")
    named = F.col("row.doc_id").eqNullSafe(F.col("d")) & (text_hash(text) == F.col("t"))
    # most documents lose lines, so both sides are dealt out, at every size; only the deletions are built into tables, and texts aren't sorted
    both = as_rows(documents).join(gone.hint("shuffle_hash"), named, "left")
    # only texts that lose lines go to Python
    left = F.coalesce(F.arrow_udf(cut, "string")(F.when(F.col("runs").isNotNull(), text.cast("string")), F.col("runs")), text.cast("string"))
    known = F.coalesce(text.cast("string"), F.lit(""))
    deleted = F.aggregate(F.coalesce("runs", F.expr("cast(array() as array<struct<from:int,to:int>>)")), F.lit(0), lambda n, r: n + r["to"] - r["from"])
    return both.select("row", left.alias("text"), (F.length(known) - F.length(F.replace(known, F.lit("\n"), F.lit(""))) + 1).alias("n_lines"), deleted.alias("n_deleted"))


def deduplicate(documents: DataFrame, min_words: int = MIN_WORDS, text_col: str = "text") -> DataFrame:
    """documents with the later copies of repeated runs deleted from the text; columns may have any names. Rows alike in id and text are one
    document. Null and empty texts stay as they are; a text of which nothing is left becomes empty; an empty table stays empty."""
    return edited(documents, min_words, text_col).select(*[F.col(f"row.`{c}`") if c != text_col else F.col("text").alias(text_col) for c in documents.columns])


def digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_deleted, text_md5 (of what is left) for every document. Nulls, repeats and empties as in deduplicate; a null or empty
    text has one line."""
    out = edited(documents.select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_deleted", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


#: By maximal runs: equal lines of two places lie on a diagonal; its unbroken stretches that hold a word are the maximal common runs, whose
#: later copies go.
ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
diagonal AS (SELECT DISTINCT a.doc_id AS d1, b.doc_id AS d2, b.pos - a.pos AS shift FROM w a JOIN w b ON a.line = b.line AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.pos < b.pos)) WHERE a.n > 0),
equal AS (SELECT d1, d2, shift, b.pos, b.n FROM diagonal JOIN w a ON a.doc_id = d1 JOIN w b ON b.doc_id = d2 AND b.pos = a.pos + shift AND b.line = a.line),
stretch AS (SELECT *, pos - row_number() OVER (PARTITION BY d1, d2, shift ORDER BY pos) AS s FROM equal),
run AS (SELECT d2 AS doc_id, min(pos) AS i, max(pos) AS j FROM stretch GROUP BY d1, d2, shift, s HAVING sum(n) > 0),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS pos FROM run)
SELECT l.doc_id, CAST(count(*) AS INT) AS n_lines, CAST(count(g.pos) AS INT) AS n_deleted, md5(coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '')) AS text_md5
FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id
"""
