"""WARC fixity audit with Merkle trees.

Records are hashed, and ordered offset ranges of them are hashed range by range up to a root. Ranges are cut at numbers of pages, not at byte
positions, and their hashes hold lengths, not positions: a record that is lost or has grown moves the bytes after it but changes one range a
level. Two replicas are compared from the root down: only the children of ranges that differ are looked at, until the records are reached.

Files are bounded: equal records are one leaf with a number of copies, and a block of pages with too many records (one id with many contents,
or pages without id) is laid out in slices by content. The layout is taken from one replica and holds for all."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wachter.llm.common import lookup, map_arrow, materialise

#: Children of a node, and pages of one file; a slice of a block has about so many records at most.
FANOUT, FILE_RECORDS = 16, 1024
_END = "\r\n\r\n"


# --- records and files ----------------------------------------------------------------------------


def _block(file_records: int) -> Column:
    """The block of pages that a page lies in: that of its number; without one, a negative number from its content."""
    lost = -1 - F.pmod(F.xxhash64("url", "html"), F.lit(1 << 20))
    return F.coalesce(F.floor(F.col("page_id") / F.lit(file_records)).cast("long"), lost)


def _record() -> Column:
    """The bytes of a page's WARC resource record. Nulls are empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), page, F.lit(">\r\nWARC-Target-URI: "), text("url"), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(text("html")).cast("string"), F.lit(_END))
    return F.concat(head, text("html"), F.lit(_END))


def layout(pages: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """(file, slices): the blocks with more records than four files should have, and into how many slices they go. Usually empty."""
    return materialise(pages.groupBy(_block(file_records).alias("file")).agg(F.count("*").alias("n")).where(F.col("n") > 4 * file_records).select("file", F.ceil(F.col("n") / file_records).cast("int").alias("slices")), "warc-layout")


def _placed(pages: DataFrame, slices: DataFrame | None, file_records: int, *more: Column) -> DataFrame:
    rec = _record()
    src = pages.select(_block(file_records).alias("file"), F.col("page_id").cast("long").alias("page_id"), F.octet_length(rec).cast("long").alias("length"), F.sha2(rec, 256).alias("digest"), *more)
    if slices is None:
        return src.withColumn("slice", F.lit(0))
    slices = slices.withColumnRenamed("file", "_file")
    return src.join(lookup(slices), F.col("file") == F.col("_file"), "left").withColumn("slice", F.coalesce(F.pmod(F.xxhash64("digest"), F.col("slices")).cast("int"), F.lit(0))).drop("_file", "slices")


def _offsets(own: DataFrame) -> DataFrame:
    """(file, slice, offset, length, page_id, digest, copies) of (file, slice, length, page_id, digest): records in the order of a file's bytes."""
    own = own.groupBy("file", "slice", "page_id", "length", "digest").agg(F.count("*").alias("copies"))
    # the layout bounds a file's records
    order = Window.partitionBy("file", "slice").orderBy("page_id", "digest")
    return own.withColumn("offset", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).select("file", "slice", "offset", "length", "page_id", "digest", "copies")


def records(pages: DataFrame, slices: DataFrame | None = None, file_records: int = FILE_RECORDS) -> DataFrame:
    """(file, slice, offset, length, page_id, digest, copies): one WARC resource record a page, laid out in files of id ranges in id order, and
    the sha-256 of its bytes. Null urls and contents are empty; pages without id lie in files of their own, by the hash of their content;
    equal pages are one row with copies. slices: layout() of the first replica, needed only where a block can have very many records."""
    return _offsets(_placed(pages, slices, file_records))


def write_warc(pages: DataFrame, path: str, slices: DataFrame | None = None, file_records: int = FILE_RECORDS) -> None:
    """Writes the records as WARC files, a file for each file and slice, in folders of these names."""
    own = _placed(pages, slices, file_records, _record().alias("bytes"))
    # a line end is written after each row: it is the last one of the record
    cut = own.select("file", "slice", "page_id", "digest", F.expr("left(bytes, length(bytes) - 2)").alias("value"))
    placed = cut.repartition("file", "slice").sortWithinPartitions("file", "slice", "page_id", "digest").select("file", "slice", "value")
    placed.write.partitionBy("file", "slice").option("lineSep", "\r\n").text(path)


_HEAD = re.compile(rb"WARC/1\.1\r\n(?:[^\r\n]+\r\n)*?WARC-Record-ID: <urn:page:(-?\d*)>\r\n(?:[^\r\n]+\r\n)*?Content-Length: (\d+)\r\n\r\n")


def parse_warc(raw: bytes) -> Iterator[tuple[int, int, int | None, str]]:
    """(offset, length, page_id, sha-256) of a file's records. Bytes that are no record (a damaged head) are one of their own, without id, up to
    the next head."""
    at = 0
    while at < len(raw):
        head = _HEAD.match(raw, at)
        end = head.end() + int(head[2]) + 4 if head else 0
        if not head or end > len(raw):
            found = _HEAD.search(raw, at + 1)
            end, head = (found.start() if found else len(raw)), None
        yield at, end - at, int(head[1]) if head and head[1] else None, hashlib.sha256(raw[at:end]).hexdigest()
        at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """records() of the files that write_warc wrote, by their bytes as they are now."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, part, raw in zip(b.column("file").to_pylist(), b.column("slice").to_pylist(), b.column("content"), strict=True):
                got = list(parse_warc(raw.as_py()))
                yield pa.RecordBatch.from_pydict({"file": pa.array([file] * len(got), pa.int64()), "slice": pa.array([part] * len(got), pa.int32()), "length": pa.array([x[1] for x in got], pa.int64()), "page_id": pa.array([x[2] for x in got], pa.int64()), "digest": pa.array([x[3] for x in got], pa.string())})

    files = spark.read.format("binaryFile").load(path).select(F.col("file").cast("long").alias("file"), F.col("slice").cast("int").alias("slice"), "content")
    return _offsets(map_arrow(files, run, "file long, slice int, length long, page_id long, digest string"))


# --- trees -------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """leaves: records with their range; levels: (file, slice, range, hash) from just above the records to the root; steps: by level the key
    that the level above divides by the fanout."""

    leaves: DataFrame
    levels: list[DataFrame]
    steps: list[str] = field(default_factory=list)
    fanout: int = FANOUT
    low: int = 0  # the first file's number


def _height(lowest: int, highest: int, fanout: int) -> int:
    h = 0
    while lowest // fanout**h != highest // fanout**h:
        h += 1
    return h


def _up(step: str, fanout: int) -> list[Column]:
    """The parent's key of a node."""
    return [(F.floor(F.col(k) / F.lit(fanout)).cast("long") if k == step else F.col(k).cast("long")).alias(k) for k in ("file", "slice", "range")]


def _hash(*parts: str) -> Column:
    """sha-256 over a node's children in order, which a node has few of."""
    line = lambda x: F.concat_ws(":", *[x[p].cast("string") for p in parts])
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*parts))), line), "\n"), 256).alias("hash")


def trees(replicas: list[DataFrame], fanout: int = FANOUT, file_records: int = FILE_RECORDS, name: str = "warc") -> list[Tree]:
    """Trees of the same shape over records() of the replicas. A node is a range of offsets: in a file that of fanout pages, above that of fanout
    such ranges, slices and files. An empty replica has no nodes."""
    kept = [materialise(r, f"{name}-records") for r in replicas]
    sizes = [r.agg(F.min("file"), F.max("file"), F.max("slice")).first() for r in kept]
    some = [s for s in sizes if s[0] is not None]
    if not some:
        return [Tree(r.withColumn("range", F.lit(0)), []) for r in kept]
    low = min(s[0] for s in some)  # files are counted from the first, so that ranges of negative and positive numbers meet in one root
    width = max(1, -(-file_records // fanout))
    steps = ["range"] * _height(0, width - 1, fanout) + ["slice"] * _height(0, max(s[2] for s in some), fanout) + ["file"] * max(1, _height(0, max(s[1] for s in some) - low, fanout))
    out = []
    for r in kept:
        leaves = r.withColumn("file", F.col("file") - F.lit(low)).withColumn("range", F.coalesce(F.floor(F.pmod("page_id", F.lit(file_records)) / F.lit(fanout)), F.lit(0)).cast("long"))
        levels = [materialise(leaves.groupBy("file", "slice", "range").agg(_hash("page_id", "digest", "length", "copies")), f"{name}-level")]
        for step in steps:
            child = levels[-1].select(*_up(step, fanout), F.col(step).cast("long").alias("child"), "hash")
            levels.append(materialise(child.groupBy("file", "slice", "range").agg(_hash("child", "hash")), f"{name}-level"))
        out.append(Tree(leaves, levels, steps, fanout, low))
    return out


def descend(a: Tree, b: Tree) -> list[DataFrame]:
    """From the root down the nodes (file, slice, range) that differ, level by level: of each level only the children of those above are
    compared. Equal roots end it."""
    out: list[DataFrame] = []
    for h in range(max(len(a.levels), len(b.levels)) - 1, -1, -1):
        x, y = a.levels[h], b.levels[h]
        if out:
            above = out[-1].select(F.col("file").alias("f"), F.col("slice").alias("s"), F.col("range").alias("r"))
            file, part, at = _up(a.steps[h], a.fanout)
            x, y = (t.join(lookup(above), (file == F.col("f")) & (part == F.col("s")) & (at == F.col("r")), "left_semi") for t in (x, y))
        both = x.withColumnRenamed("hash", "ha").join(y.withColumnRenamed("hash", "hb"), ["file", "slice", "range"], "full_outer")
        out.append(materialise(both.where("not (ha <=> hb)").select("file", "slice", "range"), "warc-differs"))
        if out[-1].isEmpty():
            break
    return out


def audit(a: Tree, b: Tree) -> DataFrame:
    """(file, offset, page_id, kind): records of a that b holds otherwise (changed) or lacks (missing), and those that only b has (extra), a row
    for each copy. Equal roots end the audit. Offsets are those of a in its file and slice; extra records have b's."""
    if not a.levels and not b.levels:
        return a.leaves.select("file", "offset", "page_id", F.lit("changed").alias("kind")).limit(0)
    bad = lookup(descend(a, b)[-1])
    x, y = (t.leaves.join(bad, ["file", "slice", "range"], "left_semi") for t in (a, b))
    # records that both have need no more looking at
    y = y.select(*[F.col(c).alias(f"y_{c}") for c in ("file", "slice", "page_id", "digest", "offset", "copies")])
    same = (F.col("file") == F.col("y_file")) & (F.col("slice") == F.col("y_slice")) & F.col("page_id").eqNullSafe(F.col("y_page_id")) & (F.col("digest") == F.col("y_digest"))
    left = x.select("file", "slice", "page_id", "digest", "offset", "copies").join(y, same, "full_outer")
    more = F.coalesce("copies", F.lit(0)) - F.coalesce("y_copies", F.lit(0))
    left = left.withColumn("more", more).where("more <> 0").select(F.coalesce("file", "y_file").alias("file"), F.coalesce("page_id", "y_page_id").alias("page_id"), F.coalesce("offset", "y_offset").alias("offset"), F.coalesce("digest", "y_digest").alias("digest"), "more")
    left = materialise(left.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("more")))).withColumn("lost", F.col("more") > 0).drop("more"), "warc-left")
    # what is left of one page is paired in the order of its bytes: the one has become the other
    nth = Window.partitionBy("file", "page_id", "lost").orderBy("offset", "digest", "copy")
    left = left.withColumn("nth", F.row_number().over(nth)).withColumn("pair", F.when(F.col("page_id").isNotNull(), F.col("nth")).otherwise(F.monotonically_increasing_id()))
    by = left.groupBy("file", "page_id", "pair").agg(F.min(F.when(F.col("lost"), F.col("offset"))).alias("oa"), F.min(F.when(~F.col("lost"), F.col("offset"))).alias("ob"))
    kind = F.when(F.col("ob").isNull(), "missing").when(F.col("oa").isNull(), "extra").otherwise("changed")
    return by.select((F.col("file") + F.lit(a.low)).alias("file"), F.coalesce("oa", "ob").alias("offset"), "page_id", kind.alias("kind"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica to audit: pages whose id's md5 begins with 0 have one more byte, those with ff are lost."""
    code = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), 1, 2)
    return pages.where(code != "ff").withColumn("html", F.when(F.substring(code, 1, 1) == "0", F.concat(F.coalesce("html", F.lit("")), F.lit(" "))).otherwise(F.col("html")))


def digest(pages: DataFrame) -> DataFrame:
    """All that the audit of pages against its damaged replica finds. An empty table gives no rows; nulls and repeats as in records()."""
    own = pages.select("page_id", "url", "html")
    slices = layout(own)
    a, b = trees([records(own, slices), records(damaged(own), slices)])
    return audit(a, b)


#: The damage itself, found by comparing all rows.
ORACLE_SQL = """
WITH r AS (
  SELECT CAST(floor(page_id / 1024) AS BIGINT) AS file, page_id, substr(md5(CAST(page_id AS VARCHAR)), 1, 2) AS code,
         octet_length(encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
           || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
           || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10))) AS n
  FROM pages),
o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM r)
SELECT file, CAST(off AS BIGINT) AS "offset", page_id, CASE code WHEN 'ff' THEN 'missing' ELSE 'changed' END AS kind FROM o WHERE code[1] = '0' OR code = 'ff'
"""
