"""Mixing sources to target weights by the cube method (Deville and Tillé 2004).

Every document of a source is taken floor(rate) times or once more; the fractions are inclusion probabilities. The flight phase moves
them along vectors of the null space of the balancing constraints (words and documents of the source), which keeps both totals exactly,
until at most two per cell are left; cells are merged level by level, and the last few of a source are the landing problem, solved by enumeration: the choice whose
totals come nearest to what is left of the targets.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wachter.llm.common import WORD, as_rows, lookup, materialise

MAX_REPEAT = 3
#: Documents that one cell of the flight phase moves.
CELL = 4_000
#: Fractions that are left to the landing phase of a source; it looks at two to this power choices.
LANDING = 12
_EPS = 1e-9


def targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, n) with weight and target. Sources in code point order, null last, weigh 1, 2, 3, repeating; a target stops at
    max_repeat times the source's size and the excess is shared among the others by weight, until none is above. One row a source."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", ((F.row_number().over(every) - 1) % 3 + 1).cast("double")).withColumn("_cap", F.lit(float(max_repeat)) * F.col("source_size"))
    # in the order in which they reach their caps, lam is the share of a weight of 1 if just those before have stopped
    by = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    w = w.withColumn("_k", F.row_number().over(by)).withColumn("_lam", (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    w = w.withColumn("_lam", F.min(F.when(F.col("_cap") / F.col("weight") >= F.col("_lam"), F.struct("_k", "_lam"))).over(whole)["_lam"])
    return w.withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("weight") * F.col("_lam"), F.col("_cap")))).drop("_cap", "_k", "_lam")


def size(text: str) -> Column:
    """Words of a text; null: 0."""
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def _steps(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """How far p can go along u, row by row, with all of p in 0 to 1."""
    with np.errstate(divide="ignore", invalid="ignore"):
        room = np.where(u > 0, (1 - p) / u, np.where(u < 0, -p / u, np.inf))
    return room.min(1)


def flight(p: np.ndarray, size: np.ndarray, count: np.ndarray, rng: np.random.Generator, left: int = 2) -> np.ndarray:
    """Moves triples of fractions, many at once, with sum(p * size) and sum(p * count) kept, until at most so many (2 or more) are left."""
    p = p.astype(float).copy()
    size, count = size.astype(float), count.astype(float)
    while True:
        live = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
        if len(live) <= max(2, left):
            return p
        rng.shuffle(live)
        t = live[: max(1, min(len(live) // 3, (len(live) - left) // 3)) * 3].reshape(-1, 3)
        s, c, q = size[t], count[t], p[t]
        u = np.stack([s[:, 1] * c[:, 2] - s[:, 2] * c[:, 1], s[:, 2] * c[:, 0] - s[:, 0] * c[:, 2], s[:, 0] * c[:, 1] - s[:, 1] * c[:, 0]], 1)
        flat = (u == 0).all(1)  # the constraints are parallel: two documents suffice
        u[flat] = np.stack([c[flat, 1], -c[flat, 0], np.zeros(int(flat.sum()))], 1)
        u /= np.abs(u).max(1, keepdims=True)
        up, down = _steps(q, u), _steps(q, -u)
        go = np.where(rng.random(len(t)) * (up + down) < down, up, -down)
        q = q + go[:, None] * u
        p[t] = np.where(q < _EPS, 0.0, np.where(q > 1 - _EPS, 1.0, q))


def land(p: np.ndarray, size: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Decides the last fractions, at most LANDING of them: nearest in words, then in documents."""
    p = p.copy()
    live = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    if len(live):
        choice = (np.arange(1 << len(live))[:, None] >> np.arange(len(live))) & 1
        off = choice - p[live]
        words, docs = np.abs(off @ size[live]), np.abs(off @ count[live])
        p[live] = choice[np.lexsort((docs, np.round(words / max(1.0, size[live].max()), 3)))[0]]
    return np.round(p)


def _cell(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", "doc_id", "size"], kind="stable", ignore_index=True)
        name = pdf["source"][0]
        rng = np.random.default_rng([seed, zlib.crc32(repr(name).encode()), int(pdf["_chunk"][0]), int(pdf["_level"][0])])
        size, count = (pdf["size"] * pdf["rows"]).to_numpy(), pdf["rows"].to_numpy()
        last = pdf["_chunks"][0] == 1
        p = flight(pdf["p"].to_numpy(), size, count, rng, LANDING if last else 2)
        pdf["p"] = land(p, size, count) if last else p
        return pdf

    return run


def plan(documents: DataFrame, text_col: str = "text", cell: int = CELL, max_repeat: int = MAX_REPEAT, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, rows, source_size, target, repeats): how often each document is taken. Rows alike in id, source and size are
    one unit (rows: their number) and are taken equally often. Documents without words are units of size 0."""
    own = documents.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), size(text_col).alias("size"))
    units = materialise(own.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "mix-units")
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n"))
    rate = F.least(F.lit(float(max_repeat)), F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)))
    goal = materialise(targets(sums, max_repeat).withColumn("rate", rate).withColumn("_chunks", F.ceil(F.col("n") / cell).cast("int")), "mix-targets")
    state = units.withColumnRenamed("source", "_s").join(goal, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    state = state.withColumn("base", F.floor("rate").cast("long")).withColumn("p", F.col("rate") - F.floor("rate")).withColumn("_h", F.xxhash64("doc_id", "size", F.lit(seed))).withColumn("_level", F.lit(0))
    most = goal.agg(F.max("_chunks")).first()[0] or 1
    done = None
    for level in range(64):
        cells = state.withColumn("_level", F.lit(level)).withColumn("_chunk", F.pmod(F.xxhash64("_h", F.lit(level)), F.col("_chunks")).cast("int"))
        moved = materialise(cells.groupBy("source", "_chunk").applyInPandas(_cell(seed), cells.schema), f"mix-{level}").drop("_chunk")
        settled = moved.where((F.col("_chunks") == 1) | ~F.col("p").between(_EPS, 1 - _EPS))
        done = settled if done is None else done.union(settled)
        if most == 1:
            break
        # at most two of each cell are left; they meet in fewer cells
        most = math.ceil(2 * most / cell)
        state = moved.where((F.col("_chunks") > 1) & F.col("p").between(_EPS, 1 - _EPS)).withColumn("_chunks", F.ceil(2 * F.col("_chunks") / cell).cast("int"))
    return done.select("doc_id", "source", "size", "rows", "source_size", "target", (F.col("base") + F.round("p").cast("long")).alias("repeats"))


def digest(documents: DataFrame) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken (words that the mix takes of it)."""
    got = plan(documents)
    each = got.withColumn("_r", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return each.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def mix(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """documents, each row as often as the plan takes it (not at all, up to three times). Columns may have any names."""
    got = materialise(plan(documents, text_col).where("repeats > 0").select("doc_id", "source", "size", "repeats"), "mix-plan")
    rows = as_rows(documents)
    on = F.col("row.doc_id").eqNullSafe(got["doc_id"]) & F.col("row.source").cast("string").eqNullSafe(got["source"]) & (size(f"row.{text_col}") == got["size"])
    return rows.join(lookup(got), on).select("row", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")).alias("k")).select("row.*")
