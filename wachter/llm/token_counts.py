"""Token counts by offset-mapped attribution: whole documents are encoded once, tokens are joined to sections by their spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wachter.llm.common import map_arrow, regroup, utf8
from wachter.llm.token_ids import byte_lengths, default_tokenizer, encode_column

#: How a token that crosses a boundary is allotted: to the section of its first or last byte, or to the one with most of its bytes (of
#: equals the first).
RULES = ("start", "end", "overlap")


def line_sections(text: Column) -> Column:
    """Sections of a text by lines: first_line (with its line feed), body, last_line; a text of one line is all first_line. Characters, end excluded."""
    n, one = F.length(text), F.instr(text, "\n")
    last = n - F.instr(F.reverse(text), "\n") + 1
    span = lambda name, i, j: F.struct(F.lit(name).alias("section"), i.cast("int").alias("start"), j.cast("int").alias("end"))
    parts = F.array(span("first_line", F.lit(0), one), span("body", one, last), span("last_line", last, n))
    return F.when(one == 0, F.array(span("first_line", F.lit(0), n))).otherwise(F.filter(parts, lambda p: p["end"] > p["start"]))


def attribute(documents: DataFrame, sections: str | Column, rule: str = "overlap", path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, tokens, crossing, total): by section of each document its tokens, how many of them cross its boundary, and the
    document's tokens. sections: array<struct<section, start, end>> of character spans; they may leave gaps, whose tokens count in the
    total alone, and if they overlap a token goes to the first that suits. A null text has no tokens, null sections give no rows."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    path = path or default_tokenizer()
    src = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), (F.col(sections) if isinstance(sections, str) else sections).alias("_s"))
    src = src.select("id", "_text", F.expr("transform(_s, x -> x.section)").alias("_n"), F.expr("transform(_s, x -> cast(x.start as bigint))").alias("_i"), F.expr("transform(_s, x -> cast(x.end as bigint))").alias("_j"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = byte_lengths(path)
        for b in regroup(batches):
            text = b.column("_text")
            raw, at = utf8(text)
            ids, n = encode_column(text, path)
            stops = np.cumsum(size[ids])
            starts = stops - size[ids]
            first = np.cumsum(n) - n
            # where each character begins in bytes
            chars = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
            origin = np.searchsorted(chars, at)
            names, lo, hi = b.column("_n"), b.column("_i"), b.column("_j")
            per = np.array([len(x) if x is not None else 0 for x in names.to_pylist()], np.int64)
            doc = np.repeat(np.arange(b.num_rows), per)
            if not len(doc):
                continue
            section = names.flatten()
            clip = lambda x: chars[np.minimum(origin[doc] + np.maximum(x, 0), origin[doc + 1])]
            i, j = clip(lo.flatten().to_numpy()), clip(hi.flatten().to_numpy())
            j = np.maximum(i, j)
            count, crossing = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
            taken = np.full(len(ids), -1)
            most = np.zeros(len(ids), np.int64)
            # tokens with a byte in each section: a range, since spans tile the text
            x, y = np.searchsorted(stops, i, "right"), np.searchsorted(starts, j, "left")
            m = np.where(j > i, np.maximum(0, y - x), 0)
            sec = np.repeat(np.arange(len(doc)), m)
            tok = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(x, m)
            inside = np.minimum(stops[tok], j[sec]) - np.maximum(starts[tok], i[sec])
            if rule != "overlap":
                own = (starts[tok] >= i[sec]) & (starts[tok] < j[sec]) if rule == "start" else (stops[tok] > i[sec]) & (stops[tok] <= j[sec])
                sec, tok, inside = sec[own], tok[own], inside[own]
            order = np.lexsort((-sec, inside)) if rule == "overlap" else np.argsort(-sec, kind="stable")
            taken[tok[order]], most[tok[order]] = sec[order], inside[order]  # the last written stays
            got = taken >= 0
            count += np.bincount(taken[got], minlength=len(doc))
            crossing += np.bincount(taken[got], most[got] < size[ids][got], len(doc)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(doc)), section, pa.array(count), pa.array(crossing), pa.array(n[doc])], ["id", "section", "tokens", "crossing", "total"])

    return map_arrow(src, run, f"id {kind}, section string, tokens long, crossing long, total long").withColumnRenamed("id", id_col)


def digest(documents: DataFrame) -> DataFrame:
    """Tokens of the first line, the body and the last line of every document. A null or empty text is one empty first line of no tokens;
    repeated rows give repeated rows; an empty table gives none. Sections here tile the text, so each token is in one."""
    return attribute(documents, line_sections(F.coalesce(F.col("text"), F.lit(""))))
