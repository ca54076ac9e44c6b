"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wachter.llm.common import GOLD, M1, M2, NOT_WORD, U64, Tokens, map_arrow, materialise, mix, regroup, small_batches, text_hash

#: The documented bound of the sample that is learned from: labelled rows in the order of the id's hash, whole texts of any length, at most so
#: many rows, and no further row once those before have so many characters.
MAX_TRAIN_ROWS, MAX_TRAIN_CHARS = 12_000, 200_000_000
BITS, EPOCHS = 20, 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 20.0, 0.5
#: Features of fewer examples are left out; a toxic example is learned so many times an epoch, since few are.
MIN_SEEN, POSITIVE = 4, 3


def features(tokens: Tokens, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word, pair of neighbours, and pair with one word between: one for each occurrence."""
    h, lens = tokens.hashes, tokens.lens
    doc = np.repeat(np.arange(len(lens)), lens)
    shift = U64(64 - bits)
    docs, buckets = [doc], [mix(h ^ GOLD) >> shift]
    for gap, salt in ((1, M1), (2, M2)):
        if len(h) > gap:
            same = doc[:-gap] == doc[gap:]
            docs.append(doc[:-gap][same])
            buckets.append(mix(h[:-gap] * salt + h[gap:] + U64(gap))[same] >> shift)
    return np.concatenate(docs), np.concatenate(buckets).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal (McMahan et al. 2013) for binary features; bucket 2**bits is the bias, which L1 does not touch."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2, self.bias = alpha, beta, l1, l2, 1 << bits

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == self.bias, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(examples: DataFrame, bits: int = BITS, epochs: int = EPOCHS, min_seen: int = MIN_SEEN, positive: int = POSITIVE, seed: int = 0) -> DataFrame:
    """examples(key, text, label 0/1), as sample() bounds them -> the non-zero weights (bucket, weight), at most 2**bits + 1 rows. One task
    learns. Null texts are empty; without examples there are no weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[np.ndarray] = []
        labels: list[int] = []
        for b in regroup(batches):
            doc, at = features(Tokens(b.column("text"), NOT_WORD), bits)
            pair = np.unique(doc * (1 << bits) + at)
            doc, at = pair >> bits, (pair & ((1 << bits) - 1)).astype(np.int32)
            rows += np.split(at, np.searchsorted(doc, np.arange(1, b.num_rows)))
            labels += b.column("label").to_pylist()
        if not rows:
            return
        seen = np.zeros(1 << bits, np.int32)
        for r in rows:
            seen[r] += 1
        rows = [np.append(r[seen[r] >= min_seen], 1 << bits) for r in rows]
        model, rng = Ftrl(bits), np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                for _ in range(positive if labels[i] else 1):
                    model.learn(rows[i], labels[i])
        at = np.arange((1 << bits) + 1)
        w = model.weights(at)
        at = at[w != 0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at])], ["bucket", "weight"])

    return map_arrow(examples.repartition(1).sortWithinPartitions(F.xxhash64("key"), "key", F.xxhash64("text")).select("text", "label"), run, "bucket long, weight double")


def scorer(model: DataFrame, text: Column, bits: int = BITS) -> Column:
    """The probability that a whole text is toxic, as a column: only the text goes to Python, and only the number comes back. An empty or null
    text gets the bias's probability; without a model, 0."""
    small_batches(model.sparkSession)
    rows = sorted(model.collect())  # at most 2**bits + 1 rows of 16 bytes
    at, weight = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)
    bias = float(weight[at == 1 << bits].sum()) if rows else -40.0
    sent = model.sparkSession.sparkContext.broadcast((at[at < 1 << bits].astype(np.int32), weight[at < 1 << bits].astype(np.float32)))

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        where, w = sent.value
        table = np.zeros(1 << bits, np.float32)
        table[where] = w
        for t in texts:
            yield pa.concat_arrays([one(b.column(0), table) for b in regroup(iter([pa.record_batch({"t": t})]))] or [pa.array([], pa.float64())])

    def one(column: pa.Array, table: np.ndarray) -> pa.Array:
        doc, f = features(Tokens(column, NOT_WORD), bits)
        hit = table[f] != 0
        pair = np.unique((doc[hit] << bits) + f[hit])  # a feature counts once a text
        x = np.bincount(pair >> bits, table[pair & ((1 << bits) - 1)].astype(float), len(column)) + bias
        return pa.array(1 / (1 + np.exp(-np.clip(x, -35, 35))))

    return F.arrow_udf(run, "double")(text.cast("string"))


def held_out(doc_id: Column) -> Column:
    """Rows that are not learned from: crc32(doc_id as text) mod 5 is 0. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, text_col: str = "text", max_rows: int = MAX_TRAIN_ROWS, max_chars: int = MAX_TRAIN_CHARS) -> DataFrame:
    """(key, text, label): the bounded sample of the labelled documents that are not held out. Of labels that differ for one id the largest
    holds; rows alike in id and text are one. Null ids and labels teach nothing. Which rows are taken is decided by ids and lengths alone;
    only then are their texts read."""
    marks = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    # not all labelled ids have texts, which a multiple of the sample leaves room for
    marks = marks.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64(F.col("doc_id").cast("string"))).limit(2 * max_rows)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = documents.select("doc_id", text_hash(text_col).alias("th"), text.alias("text")).join(F.broadcast(marks), "doc_id")  # 2 * max_rows rows at most
    sizes = own.groupBy("doc_id", "th", "label").agg(F.first(F.length("text")).alias("chars")).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "th").limit(max_rows)
    before = Window.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "th").rowsBetween(Window.unboundedPreceding, -1)  # max_rows rows at most
    taken = materialise(sizes.withColumn("before", F.coalesce(F.sum("chars").over(before), F.lit(0))).where(F.col("before") < max_chars).select("doc_id", "th"), "toxicity-sample")
    got = own.join(F.broadcast(taken), ["doc_id", "th"]).groupBy("doc_id", "th", "label").agg(F.first("text").alias("text"))
    return got.select(F.col("doc_id").cast("string").alias("key"), "text", "label")


def train(documents: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The model learned from the sample, stored."""
    return materialise(fit(sample(documents, labels, text_col)), "toxicity-model")


def drop_toxic(documents: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """documents without those that score the threshold or more. Null and empty texts score as the model's bias does; repeated rows are all
    kept or all dropped; an empty table stays empty; other columns may have any names and types."""
    return documents.where(scorer(train(documents, labels, text_col), F.col(text_col)) < threshold)


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents. A null doc_id is scored and counts as not held out; repeated ids are
    scored row by row; null and empty texts score alike; an empty table gives no rows."""
    out = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(train(documents, labels), F.col("text")).alias("score"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
