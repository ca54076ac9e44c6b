"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide every pair.

1. Each text gets a fingerprint of its n-gram multiset (equal fingerprints form a class, numbered) and MinHash band hashes. Texts go through
   Python once for this; later steps know a row by its id and the hash of its text.
2. Classes that share a band hash get an edge to the smallest class of that bucket: as many edges as members, never all pairs. The
   components of these edges are the search groups. Buckets of the same classes count once.
3. Pairs are compared on their full n-gram sets in cells of two blocks, which return counts and a spanning forest, never pairs. A group is
   compared as a whole where that takes fewer copies of its sets than its buckets do (all small groups, and large ones of true copies). A
   large group that only chains of buckets hold together is compared bucket by bucket, each pair in the first bucket that it shares: its cost
   follows its buckets, not the square of its size.
4. The components of the verified links give the groups of near duplicates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from wachter.llm.common import GOLD, M1, U64, Tokens, as_rows, block_pairs, components, forest, list_array, lookup, map_arrow, materialise, mix, regroup, shingle_hashes, text_hash, unique_by_text, without

N, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Classes in one block of a group, and n-grams at most unless one class has more; a cell holds two.
BLOCK, BLOCK_GRAMS = 256, 1 << 20
#: Bits of the filter that spares texts outside all groups the shuffle; a fixed size, whatever the input.
FILTER_BITS = 1 << 24


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most so many hashes that finds a pair at the threshold with the target recall."""
    fit = [(math.ceil(math.log(1 - recall) / math.log(1 - threshold**r)), r) for r in range(1, 17)]
    return max((b, r) for b, r in fit if b * r <= most)


def _bands(sh: np.ndarray, count: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes, one row a text that has n-grams."""
    count = count[count > 0]
    starts = np.cumsum(count) - count
    k = bands * rows
    a, b = mix(np.arange(1, k + 1, dtype=U64) * GOLD) | U64(1), mix(np.arange(1, k + 1, dtype=U64) * M1)
    out, i = np.empty((len(count), bands), U64), 0
    while i < len(count):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + (1 << 15))))
        part, at = sh[starts[i] : starts[j - 1] + count[j - 1]], starts[i:j] - starts[i]
        buf, h = np.empty_like(part), np.zeros(j - i, U64)
        for p in range(k):
            np.bitwise_xor(part, b[p], out=buf)
            np.multiply(buf, a[p], out=buf)
            h = mix(h * M1 + np.minimum.reduceat(buf, at))
            if p % rows == rows - 1:
                out[i:j, p // rows] = h + U64(p // rows)
                h = np.zeros(j - i, U64)
        i = j
    return out


def _fingerprints(sh: np.ndarray, count: np.ndarray) -> pa.Array:
    """128 bits of each text's n-gram multiset; null for texts without n-grams."""
    ends = np.concatenate([[0], np.cumsum(count)])
    half = []
    for salt in (GOLD, M1):
        total = np.concatenate([[U64(0)], np.cumsum(mix(sh ^ salt), dtype=U64)])
        half.append(mix((total[ends[1:]] - total[ends[:-1]]) + count.astype(U64)))
    both = np.ascontiguousarray(np.stack(half, 1)).view(np.uint8).tobytes()
    some = np.packbits(count > 0, bitorder="little").tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(count), [pa.py_buffer(some), pa.py_buffer(both)]).cast(pa.binary())


def signatures(documents: DataFrame, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, th, fp, bands): the text's hash, its fingerprint (null for texts without words) and its band hashes."""
    src = documents.select("doc_id", text_hash(text_col).alias("th"), F.col(text_col).cast("string").alias("_text"))
    schema = StructType([*src.drop("_text").schema.fields, StructField("fp", BinaryType()), StructField("bands", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in regroup(batches, 2 << 20):
            t = Tokens(b.column("_text"))
            sh, count = shingle_hashes(t.hashes, t.lens, n)
            h = _bands(sh, count, bands, rows).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), _fingerprints(sh, count), list_array(h, np.where(count > 0, bands, 0), pa.int64())], schema.names)

    return map_arrow(src, run, schema)


def _sets(documents: DataFrame, members: DataFrame, text_col: str, n: int) -> DataFrame:
    """(cid, grams, sh): the packed n-gram sets of members(cid, fp, th), each from the text with this hash. A filter of fixed size spares most
    other texts the tokenising; what passes it by chance, or has the same hash, falls out by the fingerprint."""
    words = {r[0]: r[1] for r in members.select(F.expr(f"pmod(th, {FILTER_BITS})").alias("bit")).groupBy(F.expr("cast(bit div 64 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(bit, 64) as int)))").alias("v")).collect()}  # FILTER_BITS / 64 rows at most
    table = np.zeros(FILTER_BITS // 64, np.int64)
    if words:
        table[list(words)] = list(words.values())
    sent = documents.sparkSession.sparkContext.broadcast(table)
    src = documents.select(text_hash(text_col).alias("th"), F.col(text_col).cast("string").alias("_text"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit = b.column("th").to_numpy() % FILTER_BITS
            yield b.filter(pa.array(((sent.value[bit // 64] >> (bit % 64)) & 1).astype(bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in regroup(chosen(batches), 2 << 20):
            t = Tokens(b.column("_text"))
            sh, count = shingle_hashes(t.hashes, t.lens, n)
            v, c = unique_by_text(sh, count)
            ends = (np.concatenate([[0], np.cumsum(c)]) * 8).astype(np.int64)
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(v.tobytes())]).cast(pa.binary())
            out = pa.RecordBatch.from_arrays([_fingerprints(sh, count), pa.array(c, pa.int64()), packed], ["fp", "grams", "sh"])
            yield out.filter(pa.array(count > 0))

    found = map_arrow(src, run, "fp binary, grams long, sh binary").dropDuplicates(["fp"])
    return found.join(lookup(members.select("cid", "fp")), "fp").select("cid", "grams", "sh")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by matrix products over pieces of the shared n-grams."""
    m = len(sets)
    _, col = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    shared = np.bincount(col) > 1
    new = np.cumsum(shared) - 1
    use = shared[col]
    row, col = row[use], new[col[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((m, m), np.float64)
    for lo in range(0, int(shared.sum()), 2048):
        i, j = np.searchsorted(col, [lo, lo + 2048])
        x = np.zeros((m, 2048), np.float32)
        x[row[i:j], col[i:j] - lo] = 1
        out += x @ x.T
    return out


def _first_shared(cell: pa.Table, pos: int) -> np.ndarray:
    """Which pairs of a bucket's cell share no bucket of an earlier band."""
    kept = cell.column("kept").combine_chunks()
    own, at, band = np.repeat(np.arange(len(kept)), np.diff(kept.offsets.to_numpy())), kept.flatten().field("pos").to_numpy(), kept.flatten().field("band").to_numpy()
    first = np.ones((len(kept), len(kept)), bool)
    for p in np.unique(at[at < pos]):
        here = at == p
        value, has = np.zeros(len(kept), np.int64), np.zeros(len(kept), bool)
        value[own[here]], has[own[here]] = band[here], True
        first &= ~((value[:, None] == value[None, :]) & has[:, None] & has[None, :])
    return first


def _verify(threshold: float):
    def run(cell: pa.Table) -> pa.Table:
        cid, lo, hi, pos = cell.column("cid").to_numpy(), cell.column("lo")[0].as_py(), cell.column("hi")[0].as_py(), cell.column("pos")[0].as_py()
        home, size = cell.column("home").to_numpy(), cell.column("n").to_numpy()
        sets = [np.frombuffer(x, U64) for x in cell.column("sh").to_pylist()]
        both, own = intersections(sets), np.array([len(s) for s in sets], float)
        link = both / (own[:, None] + own[None, :] - both) >= threshold
        np.fill_diagonal(link, False)
        top = forest(link, home)
        if lo != hi:
            link &= home[:, None] != home[None, :]
        if pos >= 0:
            link &= _first_shared(cell, pos)
        linked, some = link @ size, np.flatnonzero(link.any(1) | (top != np.arange(len(cid))))
        return pa.table({"a": cid[some], "b": cid[top[some]], "linked": pa.array(linked[some], pa.int64())})

    return run


def candidates(own: DataFrame, block: int = BLOCK) -> DataFrame:
    """own(cid, bands) -> (grp, pos, cid, kept): the members of what is compared together. pos is -1 where a group is compared as a whole; else
    grp is a bucket of the band pos, and kept all of the class's buckets."""
    entries = own.select("cid", F.posexplode("bands").alias("pos", "band"))
    buckets = entries.groupBy("band").agg(F.min("cid").alias("a"), F.max("cid").alias("z"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("cid")).alias("sum")).where("m > 1")
    # of buckets that hold the same classes one is enough
    buckets = materialise(buckets.groupBy("a", "z", "m", "sum").agg(F.min("band").alias("band")).select("band", "a", "m"), "jaccard-buckets")
    shared = materialise(entries.join(buckets, "band").select("cid", "pos", "band", "a", "m"), "jaccard-shared")
    # a class is linked to the smallest of its buckets' first classes, and these among each other: few edges where buckets overlap
    firsts = shared.groupBy("cid").agg(F.min("a").alias("low"), F.collect_set("a").alias("all"))  # as many as bands at most
    edges = firsts.select(F.explode("all").alias("a"), F.col("low").alias("b")).union(firsts.select("cid", "low")).where("a <> b").distinct()
    groups = components(edges, "jaccard-groups")
    cost = shared.groupBy("cid").agg(F.sum(F.ceil(F.col("m") / block)).alias("cost"))
    sizes = groups.join(cost, groups["id"] == cost["cid"]).groupBy("component").agg(F.count("*").alias("members"), F.sum("cost").alias("cost"))
    split = materialise(sizes.where((F.col("members") > 2 * block) & (F.col("cost") < F.col("members") * F.ceil(F.col("members") / block))).select("component"), "jaccard-split")
    few = lookup(split)
    whole = groups.join(few, "component", "left_anti").select(F.col("component").alias("grp"), F.lit(-1).alias("pos"), F.col("id").alias("cid"), F.expr("cast(null as array<struct<pos:int,band:bigint>>)").alias("kept"))
    apart = groups.join(few, "component", "left_semi").select(F.col("id").alias("cid"))
    kept = shared.join(apart, "cid", "left_semi").groupBy("cid").agg(F.collect_list(F.struct("pos", "band")).alias("kept"))  # as many as bands at most
    return whole.union(kept.select(F.explode("kept").alias("e"), "cid", "kept").select("e.band", "e.pos", "cid", "kept"))


def classes(documents: DataFrame, text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(the documents' doc_id, th and fp, one row each; the classes that have more than one document or a link: fp, low (its first document),
    n (documents), linked (documents of linked other classes), first (the first document that links reach)). A document is given as
    (none, doc_id, th), none if it has no id: the first is that of the smallest id, then text hash."""
    bands, rows = bands_for(threshold, recall)
    sig = materialise(signatures(documents, text_col, n, bands, rows), "jaccard-signatures")
    named = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    own = sig.where("fp is not null").groupBy("fp").agg(F.min(named).alias("low"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    own = materialise(own.withColumn("cid", F.monotonically_increasing_id()), "jaccard-classes")
    members = materialise(candidates(own, block), "jaccard-members")
    ids = members.select("cid").distinct()
    sets = materialise(_sets(documents, materialise(own.join(ids, "cid", "left_semi").select("cid", "fp", "low.th"), "jaccard-texts"), text_col, n), "jaccard-sets")
    told = members.join(own.select("cid", "n"), "cid").join(sets, "cid")
    cells = block_pairs(told, "grp", "cid", block, "grams", BLOCK_GRAMS).groupBy("grp", "pos", "lo", "hi")
    links = materialise(cells.applyInArrow(_verify(threshold), "a long, b long, linked long"), "jaccard-links")
    comps = components(links.select("a", "b").where("a <> b"), "jaccard-components")
    linked = links.groupBy(F.col("a").alias("cid")).agg(F.sum("linked").alias("linked"))
    many = comps.select(F.col("id").alias("cid"), "component").join(linked, "cid", "left").join(own.select("cid", "fp", "low", "n"), "cid")
    many = materialise(many, "jaccard-linked")
    first = materialise(many.groupBy("component").agg(F.min("low").alias("first")), "jaccard-firsts")
    found = many.join(lookup(first), "component").select("fp", "low", "n", F.coalesce("linked", F.lit(0).cast("long")).alias("linked"), "first")
    alone = own.where("n > 1").join(many.select("cid"), "cid", "left_anti").select("fp", "low", "n", F.lit(0).cast("long").alias("linked"), F.col("low").alias("first"))
    return sig.select("doc_id", "th", "fp"), materialise(found.union(alone), "jaccard-result")


def digest(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """One row a document: class_id (smallest doc_id with the same n-grams), n_links (other documents at or over the threshold), component_id
    (smallest doc_id that links reach), kept. A text without words (null, empty, blank) links with nothing and is kept. Rows of a null
    doc_id link like any other but give no id; repeated rows count as copies of each other; an empty table gives no rows."""
    docs, found = classes(documents, text_col)
    own = docs.join(lookup(found.withColumnRenamed("fp", "_fp")), F.col("fp") == F.col("_fp"), "left")
    link = F.col("_fp").isNotNull()
    out = own.select("doc_id", F.when(link, F.col("low.doc_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(link, F.col("n") - 1 + F.col("linked")).otherwise(0).alias("n_links"), F.when(link, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("n_links") == 0))


def deduplicate(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """documents with one row of each group of near duplicates: that of the smallest doc_id, then text hash, ids before nulls. Texts without
    words (null, empty, blank) all stay; of rows alike in id and text one stays; an empty table stays empty. Columns may have any names."""
    docs, found = classes(documents.select("doc_id", F.col(text_col).alias("text")))
    grouped = docs.join(lookup(found.select(F.col("fp").alias("_fp"), "first")), F.col("fp") == F.col("_fp"))
    rows = grouped.groupBy("doc_id", "th").agg(F.first("first").alias("first"), F.count("*").alias("c"))
    rows = materialise(rows.withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))), "jaccard-decisions")
    gone = materialise(rows.where("not stays or c > 1").select("doc_id", "th"), "jaccard-gone")
    kept = without(documents, gone, text_col)
    again = materialise(rows.where("stays and c > 1").select("doc_id", "th"), "jaccard-repeated")
    if again.isEmpty():
        return kept
    # the few rows that are alike in id and text: one of each
    some = as_rows(documents).join(lookup(again), F.col("row.doc_id").eqNullSafe(again["doc_id"]) & (text_hash(f"row.{text_col}") == again["th"]))
    return kept.union(some.dropDuplicates(["doc_id", "th"]).select("row.*"))


#: All pairs that share an n-gram, for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END AS s FROM t),
sh AS (SELECT DISTINCT doc_id, unnest(s) AS x FROM g), c AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT p.a, p.b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE CAST(k AS DOUBLE) / (ca.n + cb.n - k) >= 0.8),
reach AS (SELECT doc_id AS id, doc_id AS r FROM t UNION SELECT reach.id, link.b FROM reach JOIN link ON link.a = reach.r),
comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id), nl AS (SELECT a, count(*) AS n_links FROM link GROUP BY a),
cl AS (SELECT doc_id, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(s)) END AS class_id FROM g)
SELECT cl.doc_id, class_id, coalesce(n_links, 0) AS n_links, component_id, cl.doc_id = component_id AS kept FROM cl JOIN comp ON comp.id = cl.doc_id LEFT JOIN nl ON nl.a = cl.doc_id
"""
